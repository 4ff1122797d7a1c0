"""Language-model scoring with a weighted back-off automaton.

Counts. All words and all pairs of neighbouring words of the training part are
counted, without a least count or a most. A task packs its texts into runs; a
run asks each shard of hashes for its distinct words and pairs and brings its
own training counts along, so that one shuffle sums the counts of a shard and
answers all runs. Pairs go to the shard of their first word; those of the few
words that make up more than HOT_SHARE of all go to a second family of shards, by
their next word, and each of these tells a run how many followers of its hot words
it knows, which the run adds up. So no word's followers meet in one group.
Counts travel in as few bytes as a row's largest needs, and what was asked leaves
the disk before the answers are shuffled.
Nothing goes through the driver but three totals and the hot words, 1 / HOT_SHARE
at most; the shards grow in number with the text.

Automaton. Each word is a state, reached by reading it. Arcs hold log10 of the
discounted share of the next word plus what backs off to it; a state's failure
arc holds log10 of the share that its discounts free, and leads to the empty
state, whose arcs are the single words. A run builds the part of the automaton
that its texts touch, from the answers. Its texts are read together, one word
of each at a time, from left to right: each carries its state and the sum of
the arcs taken.

All unseen words share one probability, that of words seen once (Good-Turing).

Defined results: null and empty texts are their end alone; repeated rows are
scored alike and, if they are training rows, counted each; ids that are null
are hashed as an empty string and stay null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut, partitions, release_shuffles

U = np.uint64
FOLDS, HELD_OUT = 5, 1
DISCOUNT, RUN_WORDS, SHARD_BYTES, HOT_SHARE = 0.75, 1_500_000, 4 << 20, 1 / 256
PART_WORDS = 1024  # read on in step at most
END = 0x9AE16A3B2F90404F  # the end of a text among the hashes of words
_BITS = U(20)
_WIDE = U(32)
_MIX = U(0x9FB21C651E98DF25)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def with_ends(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with the end of each text after its last word."""
    ends = np.searchsorted(doc, np.arange(n_docs), "right")
    return np.insert(h, ends, U(END)), np.insert(doc, ends, np.arange(n_docs))


def _cuts(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted words: shards are ranges of hashes."""
    shard = ((words >> _WIDE) * U(shards)) >> _WIDE
    return np.searchsorted(shard, np.arange(shards + 1, dtype=U))


def _runs(it):
    """One row for each run of texts: ids, folds, sorted words, the words' places among them, words of each text; its frequent words and their counts."""

    def emit():
        h, n = np.concatenate(words), np.concatenate(lengths)
        distinct, at = np.unique(h, return_inverse=True)
        times = np.bincount(at)
        often = np.flatnonzero(times > HOT_SHARE / 2 * len(h))  # a word above the share in all runs is above half of it in some
        one = lambda x: pa.array([x], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(x)) for x in (ids, folds)]
        return pa.RecordBatch.from_arrays([*lists, one(distinct.tobytes()), one(at.astype("<u4").tobytes()), one(n.astype("<u4").tobytes()), one(distinct[often].tobytes()), one(times[often].astype("<i8").tobytes()), pa.array([len(h)])], ["ids", "held", "words", "places", "lengths", "often", "times", "tokens"])

    ids, folds, words, lengths, held = [], [], [], [], 0
    for batch in it:
        for lo, hi in K.pieces(batch.column(2)):
            part = batch.slice(lo, hi - lo)
            h, doc, _, _ = K.words(*K.buffers(part.column(2)))
            h, doc = with_ends(h, doc, hi - lo)
            ids.append(part.column(0))
            folds.append(part.column(1))
            words.append(h)
            lengths.append(np.bincount(doc, minlength=hi - lo))
            held += len(h)
            if held >= RUN_WORDS:
                yield emit()
                ids, folds, words, lengths, held = [], [], [], [], 0
    if held:
        yield emit()


def _opened(words: bytes, places: bytes, lengths: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted words, number of each word of the run, text of each word)."""
    n = np.frombuffer(lengths, "<u4")
    return np.frombuffer(words, "<u8"), np.frombuffer(places, "<u4").astype(np.int64), np.repeat(np.arange(len(n)), n)


_ASKED = "shard int, run long, words binary, n binary, followers binary, next binary, c binary"
_ANSWERED = "run long, shard int, n binary, followers binary, c binary, total long, v long, once long"


def _hot_words(runs: DataFrame) -> np.ndarray:
    """The words that are more than HOT_SHARE of all, sorted."""

    def run(it):
        for batch in it:
            for often, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(often, "<i8")), pa.array(np.frombuffer(times, "<i8"))], ["word", "n"])

    total = runs.agg(F.sum("tokens")).first()[0] or 0
    n = runs.select("often", "times").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["word"] for r in n.filter(F.col("n") > HOT_SHARE * total).collect()], np.int64).view(U))


def _dealt(words: np.ndarray, pairs: np.ndarray, hot: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which words are hot, places of other pairs, places of pairs of hot words by shard, where each shard of these begins)."""
    is_hot = np.isin(words, hot)
    of_hot = is_hot[(pairs >> _WIDE).astype(np.int64)]
    own = np.flatnonzero(of_hot)
    shard = ((words[(pairs[own] & U(0xFFFFFFFF)).astype(np.int64)] >> _WIDE) * U(shards)) >> _WIDE
    order = np.argsort(shard, kind="stable")
    return is_hot, np.flatnonzero(~of_hot), own[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=U))


def _asking(shards: int, hot: np.ndarray):
    """A run's distinct words and pairs with the run's training counts, packed by the shard of the word or of the pair's first word; pairs of hot words by the shard of the next one."""

    def run(it):
        for batch in it:
            for r in batch.to_pylist():
                words, numbers, doc = _opened(r["words"], r["places"], r["lengths"])
                train = ~np.array(r["held"], bool)[doc]
                n = np.bincount(numbers[train], minlength=len(words))
                at, keys = _pairs(numbers, doc, _WIDE)
                pairs, back = np.unique(keys, return_inverse=True)
                c = np.bincount(back[train[at]], minlength=len(pairs))
                state, after = (pairs >> _WIDE).astype(np.int64), words[(pairs & U(0xFFFFFFFF)).astype(np.int64)]
                is_hot, cold, warm, begin = _dealt(words, pairs, hot, shards)
                followers = np.bincount(state[cold], minlength=len(words))
                cuts = _cuts(words, shards)
                ends = np.concatenate([[0], np.cumsum(followers)])[cuts]
                full = np.flatnonzero(np.diff(cuts))
                pack = lambda x, e, to=K.narrow: pa.array([to(x[e[s] : e[s + 1]]) for s in full], pa.binary())
                names = ["shard", "run", "words", "n", "followers", "next", "c"]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), r["run"]), pa.int64()), pack(words, cuts, np.ndarray.tobytes), pack(n, cuts), pack(followers, cuts), pack(after[cold], ends, np.ndarray.tobytes), pack(c[cold], ends)], names)
                if not is_hot.any():
                    continue
                # every shard of the second family is asked for the followers that it knows of the run's hot words
                numbered, own, every = np.cumsum(is_hot) - 1, words[is_hot].tobytes(), range(shards)
                some = lambda x, to=K.narrow: pa.array([to(x(warm[begin[s] : begin[s + 1]])) for s in every], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(shards, 2 * shards), pa.int32()), pa.array(np.full(shards, r["run"]), pa.int64()), pa.array([own] * shards, pa.binary()), pa.array([bytes(len(own) // 8)] * shards, pa.binary()),
                     some(lambda p: np.bincount(numbered[state[p]], minlength=len(own) // 8)), some(lambda p: after[p], np.ndarray.tobytes), some(lambda p: c[p])], names,
                )

    return run


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one row of each distinct key, that key's number for every row, sums of n)."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first, back, np.bincount(back, n, minlength=len(first)).astype(np.int64)


def _answer(table):
    """Exact counts of a shard over all runs, for every run in the order in which it asked, and a row of the shard's totals."""
    blobs = {k: table.column(k).to_pylist() for k in ("words", "n", "followers", "next", "c")}
    sizes = {k: np.array([len(b) // 8 for b in blobs[k]]) for k in ("words", "next")}
    joined = lambda k: np.frombuffer(b"".join(blobs[k]), "<u8")
    words = joined("words")
    first, back, n = _summed(words, K.wide(blobs["n"], sizes["words"]))
    state = np.repeat(back, K.wide(blobs["followers"], sizes["words"]))
    one, pair, c = _summed(K.mix(words[first][state] * _MIX + joined("next")), K.wide(blobs["c"], sizes["next"]))
    arcs = np.bincount(state[one], c > 0, minlength=len(first)).astype(np.int64)
    split = lambda x, k: [K.narrow(b) for b in np.split(x, np.cumsum(sizes[k])[:-1])]
    zero = [0] * table.num_rows
    columns = {"run": table.column("run").to_pylist(), "shard": table.column("shard").to_pylist(), "n": split(n[back], "words"), "followers": split(arcs[back], "words"), "c": split(c[pair], "next"), "total": zero, "v": zero, "once": zero}
    own = {"run": None, "shard": columns["shard"][0], "n": None, "followers": None, "c": None, "total": int(n.sum()), "v": int((n > 0).sum()), "once": int((n == 1).sum())}
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array([*columns[k], own[k]], kind) for k, kind in zip(columns, kinds, strict=True)], list(columns))


def _pairs(numbers: np.ndarray, doc: np.ndarray, bits: np.uint64 = _BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of words with a numbered word of the same text before them, if they are numbered too; the arcs' keys."""
    at = np.flatnonzero((doc[1:] == doc[:-1]) & (numbers[1:] >= 0) & (numbers[:-1] >= 0)) + 1
    return at, (numbers[at - 1].astype(U) << bits) | numbers[at].astype(U)


class Automaton:
    """A weighted automaton with failure arcs. State 0 is the empty one; state k + 1 is that of word number k, reached by reading it.

    Its arcs from state 0 hold log10 shares of single words; those of other
    states log10 shares of the words seen after them; a failure arc leads to
    state 0 and holds log10 of the share that the state's discounts free.
    Without the number of a state's followers, the given arcs are all it has."""

    EMPTY = 0

    def __init__(self, words: np.ndarray, n: np.ndarray, total: int, seen_once: int, arcs: np.ndarray, arc_n: np.ndarray, followers: np.ndarray | None = None, bits: np.uint64 = _BITS):
        self.words, self.bits = words, bits
        unseen = max(0.5, min(seen_once, total / 2)) / max(1, total)
        self.unseen = np.log10(unseen)
        known = np.log10(1 - unseen) - np.log10(max(1, total))  # plus log10 of the count
        single = np.where(n > 0, np.log10(np.maximum(n, 1)) + known, self.unseen)
        state = (arcs >> bits).astype(np.int64)
        word = (arcs & ((U(1) << bits) - U(1))).astype(np.int64)
        share = (arc_n - DISCOUNT) / n[state] if len(arcs) else np.zeros(0)
        if followers is None:
            free = 1 - np.bincount(state, share, minlength=len(words))
        else:
            free = np.where(n > 0, DISCOUNT * followers / np.maximum(n, 1), 1.0)
        free = np.maximum(free, 1e-12)
        self.fail = np.concatenate([[0.0], np.log10(free)])
        self.arcs, self.arc = arcs, np.log10(share + free[state] * 10 ** single[word]) if len(arcs) else share
        self.single = np.append(single, self.unseen)  # the last one is any word without a number

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after reading a word in each state, log10 weights of the arcs taken); words without a number are -1."""
        key = (np.maximum(state - 1, 0).astype(U) << self.bits) | np.maximum(word, 0).astype(U)
        at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
        hit = (self.arcs[at] == key) & (state > 0) & (word >= 0) if len(self.arcs) else np.zeros(len(key), bool)
        weight = self.fail[state] + self.single[word]
        weight[hit] = self.arc[at[hit]]
        return word + 1, weight

    def traverse(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 weight of each text's path: all texts are read together from left to right, each with its state and its sum.

        Long texts go on in parts of PART_WORDS, each from the state in which the part before it ends."""
        parts = -(-lengths // PART_WORDS)
        text = np.repeat(np.arange(len(lengths)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = (np.cumsum(lengths) - lengths)[text] + nth * PART_WORDS
        size = np.minimum(PART_WORDS, lengths[text] - nth * PART_WORDS)
        state = np.where(nth > 0, numbers[np.maximum(start - 1, 0)] + 1, self.EMPTY)
        order = np.argsort(-size, kind="stable")
        start, size, state, text = start[order], size[order], state[order], text[order]
        total = np.zeros(len(start))
        live = len(start) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
        for t, n in enumerate(live.tolist()):
            state[:n], weight = self.step(state[:n], numbers[start[:n] + t])
            total[:n] += weight
        return np.bincount(text, total, minlength=len(lengths))


def _scored(total: int, v: int, once: int, shards: int, hot: np.ndarray):
    """The rows of a run from the answers of all shards."""
    scale = float(np.log10(total + 0.5 * (v + 1)))

    def run(runs, answers):
        r = runs.to_pylist()[0]
        words, numbers, doc = _opened(r["words"], r["places"], r["lengths"])
        answers = answers.sort_by("shard")
        arcs = np.unique(_pairs(numbers, doc, _WIDE)[1])
        is_hot, cold, warm, begin = _dealt(words, arcs, hot, shards)
        of_words, of_cold = np.diff(_cuts(words, shards)), np.diff(_cuts(words[(arcs[cold] >> _WIDE).astype(np.int64)], shards))
        main = answers.slice(0, int(np.sum(answers["shard"].to_numpy() < shards)))
        second = answers.slice(main.num_rows)
        got = lambda t, k, sizes: K.wide(t.column(k).to_pylist(), sizes)
        n, followers, c = got(main, "n", of_words), got(main, "followers", of_words), np.empty(len(arcs), np.int64)
        c[cold], c[warm] = got(main, "c", of_cold), got(second, "c", np.diff(begin))
        if is_hot.any():
            followers[is_hot] += got(second, "followers", np.full(shards, is_hot.sum())).reshape(shards, -1).sum(0)
        seen = c > 0
        a = Automaton(words, n, total, once, arcs[seen], c[seen], followers, _WIDE)
        sums = lambda x: pa.array(np.bincount(doc, x, minlength=len(r["ids"])))
        known = sums((n > 0)[numbers]).cast(pa.int64())
        lengths = pa.array(np.frombuffer(r["lengths"], "<u4").astype(np.int64))
        columns = [pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), lengths, known, sums((np.log10(n + 0.5) - scale)[numbers]), pa.array(a.traverse(numbers, lengths.to_numpy()))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    size = docs.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    shards = max(2 * partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    runs = rows.mapInArrow(_runs, "ids array<long>, held array<boolean>, words binary, places binary, lengths binary, often binary, times binary, tokens long")
    runs = cut(runs.withColumn("run", F.monotonically_increasing_id()), "runs")
    hot = _hot_words(runs)
    runs = runs.drop("often", "times", "tokens")
    answers = cut(runs.mapInArrow(_asking(shards, hot), _ASKED).groupBy("shard").applyInArrow(_answer, _ANSWERED), "answers")
    release_shuffles(docs.sparkSession)
    all_ = answers.filter("run is null").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("total", "v", "once")]).first()
    asked = answers.filter("run is not null").select("run", "shard", "n", "followers", "c")
    out = runs.groupBy("run").cogroup(asked.groupBy("run")).applyInArrow(_scored(all_["total"], all_["v"], all_["once"], shards, hot), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_["total"]).cast("long").alias("train_tokens"), "base_score", "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
