"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted words.

Trusted documents fall into two parts by hash of their ids, in the proportion
TRAIN_DOCUMENTS to THRESHOLD_DOCUMENTS: the model counts every word of every
document of the first, the bounds are quantiles over every document of the
second, which the model has not seen. A document is kept if its perplexity is
not above its language's bound; short texts are drawn to their language's middle
before. There is no lower bound: copies of what the model has seen are as
predictable as text can be, and are no junk.

With ``whole``, as in the pipeline, nothing is parted: the model counts every trusted
document, and every trusted document sets the bounds, scored by the model
without what its own row adds to it. So no word is judged by itself, and no
document is lost to either side. Such scores are exact but for the discounts,
which stay those of all: what a text adds to counts, contexts and words is
told by its own n-grams.

Counts. All n-grams live in shards by their keys' hashes. Trigrams are shuffled
once, packed, to the shard of the pair of their last two words, where their
counts and the pairs' are; what they add to contexts and to single words goes on
to the shards of these. So no word's n-grams meet in one group.

Scoring. All texts are scored, in batches of runs by hash. A run asks the shards
for its distinct words, pairs and trigrams, and combines the answers to the
probability of each of its words. Of the model, only sums of counts of counts
come to the driver; quantiles are exact, by counts of ranges of values first.

Defined results: texts without words have no perplexity and are rejected; a
language with fewer than LEAST_TRUSTED trusted documents, or none (null), takes
the quantiles over all languages; without trusted rows of the first part
everything is kept, without any of the second everything that has words;
repeated rows get equal results, and a trusted id counts once for each of its
rows; an id labelled both ways is trusted; other columns pass through ``judge``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut, partitions, release_shuffles

U = np.uint64
TRAIN_DOCUMENTS, THRESHOLD_DOCUMENTS, LEAST_TRUSTED = 4000, 8000, 25  # of so many trusted documents together, so many train
HIGH_QUANTILE, MARGIN, PRIOR_WORDS = 0.995, 0.02, 30
PACKED_WORDS, RUN_BYTES, SHARD_BYTES = 1_500_000, 6 << 20, 12 << 20
BATCHES, BATCH_BYTES, SALTS = 8, 24 << 20, 16
OWN_WORDS, COUNTED_WORDS = 1 << 17, 1 << 19  # of texts scored without their own counts, and counted, at once
BROADCAST_TRUSTED = 1 << 20  # trusted ids told to all tasks; more are joined by shuffles
RANGES = 1024  # of values in one unit of log10, for quantiles
BEGIN = U(0x5DEECE66D)
_A, _B = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)
_WIDE = U(32)
START = K.mix(np.array([BEGIN]) * _A + BEGIN)[0]  # the context of a document's first word
# Kinds of packed rows: the first words of trigrams with counts, pair by pair; pairs with the number of words before;
# what trigrams add to contexts; what pairs add to the word before and after; the model's trigrams, pairs and words.
FAR, NEAR, TO_CONTEXT, TO_BEFORE, TO_AFTER, TRI, PAIR, WORD = range(8)
COLUMNS = {TRI: 1, PAIR: 5, WORD: 5}
_ROW = "shard int, kind int, keys binary, numbers binary, of array<long>"


def _grams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """The two words before each word, far and near (BEGIN outside its document), the keys of (near, word) and of all three."""
    near, far = np.full(len(h), BEGIN), np.full(len(h), BEGIN)
    same = doc[1:] == doc[:-1]
    near[1:][same] = h[:-1][same]
    same = doc[2:] == doc[:-2]
    far[2:][same] = h[:-2][same]
    pair = K.mix(near * _A + h)
    return far, near, pair, K.mix(K.mix(far * _A + near) * _B + pair)


def _cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys: shards are ranges of keys."""
    shard = ((keys >> _WIDE) * U(shards)) >> _WIDE
    return np.searchsorted(shard, np.arange(shards + 1, dtype=U))


def _split(x: np.ndarray, cuts: np.ndarray, shards: np.ndarray) -> pa.Array:
    return pa.array([x[..., cuts[s] : cuts[s + 1]].tobytes() for s in shards], pa.binary())


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sums of each column)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order], at) if len(at) else c for c in columns]
    return keys[at], np.array(sums, "<i8").reshape(len(columns), len(at))


def _kinds_of(n: np.ndarray) -> list[np.ndarray]:
    """The columns that a count adds to what stands before it: itself, and whether it is 1, 2, or 3 and more."""
    return [n, *[(np.minimum(n, 3) == k).astype(np.int64) for k in (1, 2, 3)]]


def _words_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text) of a column."""
    found, begin = [], 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for lo, hi in K.pieces(chunk):
            h, doc, _, _ = K.words(*K.buffers(chunk.slice(lo, hi - lo)))
            found.append((h, doc + (begin + lo)))
        begin += len(chunk)
    h, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), np.zeros(0, np.int64))
    return h.astype(U), doc.astype(np.int64)


def _counted(shards: int):
    """Distinct trigrams of a task's texts with their counts, under their pairs, packed by the pair's shard."""

    def emit(parts):
        far, near, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        pair = K.mix(near * _A + word)
        _, first, n = np.unique(K.mix(K.mix(far * _A + near) * _B + pair), return_index=True, return_counts=True)
        order = np.argsort(pair[first], kind="stable")
        first, n = first[order], n[order].astype("<u4")
        pair = pair[first]
        at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        each = np.diff(np.append(at, len(pair))).astype("<u4")
        cuts, pair_cuts = _cuts(pair, shards), _cuts(pair[at], shards)
        full = np.flatnonzero(np.diff(cuts))
        of_pairs = [_split(x, pair_cuts, full) for x in (near[first[at]], word[first[at]], each)]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *of_pairs, _split(far[first], cuts, full), _split(n, cuts, full)], ["shard", "near", "word", "each", "far", "n"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in it:
            for lo, hi in K.pieces(batch.column(0)):
                h, doc = _words_of(batch.column(0).slice(lo, hi - lo))
                if len(h):
                    far, near, _, _ = _grams(h, doc)
                    parts.append((far, near, h))
                    held += len(h)
                if held >= COUNTED_WORDS:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return run


def _of_counts(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _packed_rows(rows: list[tuple]) -> pa.Table:
    """Rows of shard, kind, keys, numbers, of."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["shard", "kind", "keys", "numbers", "of"])


def _merged(table: pa.Table) -> pa.Table:
    """A shard's distinct trigrams and pairs with their counts, and how many have the counts 1 to 4."""
    got = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    own = table.column("shard")[0].as_py()
    near, word, each = got("near", "<u8"), got("word", "<u8"), got("each", "<u4")
    far, n = got("far", "<u8"), got("n", "<u4").astype(np.int64)
    pair, _, tri = _keys(near, word, each, far)
    of = np.repeat(np.arange(len(pair)), each)
    pairs, at = np.unique(pair, return_index=True)
    _, first = np.unique(tri, return_index=True)
    _, n = _summed(tri, n)
    number = np.searchsorted(pairs, pair[of[first]])
    order = np.argsort(number, kind="stable")
    n, m = n[0][order], np.bincount(number, minlength=len(pairs)).astype("<i8")
    rows = [(own, FAR, far[first[order]].tobytes(), n.tobytes(), _of_counts(n)), (own, NEAR, near[at].tobytes(), np.array([word[at].view("<i8"), m]).tobytes(), _of_counts(m))]
    return _packed_rows(rows)


def _keys(near: np.ndarray, word: np.ndarray, m: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of pairs, and of contexts and trigrams, of which each pair has m."""
    pair, of = K.mix(near * _A + word), np.repeat(np.arange(len(near)), m)
    context = K.mix(far * _A + near[of])
    return pair, context, K.mix(context * _B + pair[of])


def _opened(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(near, word, m, pairs, contexts, trigrams, n) of rows of trigrams and pairs."""
    (near, (word, m)), (far, n) = _gathered(table, NEAR, 2), _gathered(table, FAR, 1)
    word = word.view(U)
    return near, word, m, *_keys(near, word, m, far), n[0]


def _adding(shards: int):
    """What trigrams add to contexts, and pairs to words, packed by the shards of these."""

    def emit(tables):
        rows = []
        near, word, m, _, context, _, n = (np.concatenate(x) for x in zip(*map(_opened, tables), strict=True))
        order = np.argsort(context, kind="stable")  # a context's counts stay apart, for their kinds
        for kind, to, sums in ((TO_CONTEXT, context[order], n[order][None]), (TO_BEFORE, *_summed(near, *_kinds_of(m))), (TO_AFTER, *_summed(word, np.ones(len(word), np.int64)))):
            cuts = _cuts(to, shards)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                rows.append((k, kind, to[cuts[k] : cuts[k + 1]].tobytes(), np.ascontiguousarray(sums[:, cuts[k] : cuts[k + 1]]).tobytes(), None))
        return _packed_rows(rows).to_batches()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = [], 0
        for table in _by_shard(it):
            tables.append(table)
            held += table.nbytes
            if held >= 8 * PACKED_WORDS:
                yield from emit(tables)
                tables, held = [], 0
        if tables:
            yield from emit(tables)

    return run


def _by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after the other; they stand together."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        for k, shard in enumerate(batch.column("shard").to_pylist()):
            if held and held[-1].column("shard")[0].as_py() != shard:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(k, 1))
    if held:
        yield pa.Table.from_batches(held)


def _gathered(table: pa.Table, kind: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, numbers by column) of all rows of a kind."""
    rows = [(np.frombuffer(k, "<u8"), np.frombuffer(x, "<i8").reshape(columns, -1)) for kd, k, x in zip(table.column("kind").to_pylist(), table.column("keys").to_pylist(), table.column("numbers").to_pylist(), strict=True) if kd == kind]
    return (np.concatenate([k for k, _ in rows]), np.concatenate([x for _, x in rows], 1)) if rows else (np.zeros(0, U), np.zeros((columns, 0), np.int64))


def _added(merged: pa.Table, added: pa.Table) -> pa.Table:
    """A shard's part of the model: sorted keys of trigrams with their counts; of pairs with the number of words before, and, as contexts, their
    count and how many words after them were there once, twice and more often; of words with the same of the pairs that they begin, and the number of words before."""
    own = (merged if len(merged) else added).column("shard")[0].as_py()
    _, _, m, pair, _, tri, n = _opened(merged)
    to, c = _gathered(added, TO_CONTEXT, 1)
    none = lambda k, x: [np.zeros(len(x), np.int64)] * k
    beside = lambda a, b: [np.concatenate(x) for x in zip(a, b, strict=True)]
    pairs, of_pairs = _summed(np.concatenate([pair, to]), *beside([m, *none(4, pair)], [*none(1, to), *_kinds_of(c[0])]))
    before, kinds = _gathered(added, TO_BEFORE, 4)
    after, k = _gathered(added, TO_AFTER, 1)
    word, of_words = _summed(np.concatenate([before, after]), *beside([*kinds, *none(1, before)], [*none(4, after), k[0]]))
    k = of_words[4][of_words[4] > 0]
    order = np.argsort(tri)
    model = [(own, TRI, tri[order].tobytes(), n[order].tobytes(), _of_counts(n)), (own, PAIR, pairs.tobytes(), of_pairs.tobytes(), _of_counts(m))]
    return _packed_rows([*model, (own, WORD, word.tobytes(), of_words.tobytes(), [*_of_counts(k), int(k.sum()), len(k), int(np.minimum(k, 3).sum())])])


def _discounts(n: list[int]) -> np.ndarray:
    """The discounts of modified Kneser-Ney for the counts 0, 1, 2, and 3 or more, from counts of counts."""
    n = [float(x) for x in n]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0, *[min(k, max(0.05, k - (k + 1) * y * (n[k] / n[k - 1]))) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]])


class Totals:
    """What every shard must know of all: the discounts of words, pairs and trigrams, and the share of unseen words."""

    def __init__(self, tri: list[int], pair: list[int], word: list[int]):
        self.d3, self.d2, self.d1 = _discounts(tri[:4]), _discounts(pair[:4]), _discounts(word[:4])
        self.total, distinct, capped = word[4:7]
        more = capped - word[0] - 2 * word[1]  # three times the words that were after three words or more
        freed = self.d1[1] * word[0] + self.d1[2] * word[1] + self.d1[3] * (more // 3)
        self.freed, self.distinct = freed, distinct
        self.floor = freed / self.total / (distinct + 1)


class Shards:
    """Packed rows as a table in buckets by shard, so that they are read without a shuffle; ``drop`` removes it with its files."""

    def __init__(self, rows: DataFrame, shards: int):
        self.spark, self.name = rows.sparkSession, f"quality_lm_{uuid.uuid4().hex}"
        rows.write.bucketBy(max(partitions(self.spark), shards // 2), "shard").sortBy("shard").option("compression", "zstd").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def counts(texts: DataFrame, shards: int) -> tuple[Shards, Totals] | None:
    """(the model by shard, totals) of a column of texts; None without words."""
    spark = texts.sparkSession
    packed = texts.mapInArrow(_counted(shards), "shard int, near binary, word binary, each binary, far binary, n binary")
    merged = Shards(packed.groupBy("shard").applyInArrow(_merged, _ROW), shards)
    release_shuffles(spark)
    added = merged.rows.mapInArrow(_adding(shards), _ROW)
    model = Shards(merged.rows.groupBy("shard").cogroup(added.groupBy("shard")).applyInArrow(_added, _ROW), shards)
    merged.drop()
    release_shuffles(spark)
    sums = [F.coalesce(F.sum(F.get("of", F.lit(k))), F.lit(0)).alias(f"n{k}") for k in range(7)]
    of = {r["kind"]: [*r[1:]] for r in model.rows.groupBy("kind").agg(*sums).collect()}  # three rows
    if TRI in of:
        return model, Totals(of[TRI], of[PAIR], of[WORD])
    model.drop()
    return None


def _found(keys: np.ndarray, numbers: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The numbers of asked keys by column, 0 where a key is not there."""
    if not len(keys):
        return np.zeros((len(numbers), len(asked)), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, numbers[:, at], 0)


class Run:
    """The distinct words, pairs and trigrams of texts, and the texts' places among them."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, shards: int):
        _, near, pair, tri = _grams(h, doc)
        self.words, at = np.unique(np.append(h, BEGIN), return_inverse=True)
        self.word, begin = at[:-1], at[-1]
        self.near = np.append(begin, self.word[:-1])
        self.near[near == BEGIN] = begin
        self.pairs, at = np.unique(np.append(pair, START), return_inverse=True)
        self.pair, start = at[:-1], at[-1]
        self.context = np.append(start, self.pair[:-1])
        self.context[near == BEGIN] = start
        tris, first, at = np.unique(tri, return_index=True, return_inverse=True)
        shard = ((pair[first] >> _WIDE) * U(shards)) >> _WIDE
        order = np.argsort(shard, kind="stable")
        self.tris = tris[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.tri = back[at]
        self.cuts = [_cuts(self.words, shards), _cuts(self.pairs, shards), np.searchsorted(shard[order], np.arange(shards + 1, dtype=U))]

    def log_probabilities(self, tri: np.ndarray, pair: np.ndarray, word: np.ndarray, totals: Totals) -> np.ndarray:
        """log10 probability of every word after the two before it, by the numbers of this run's distinct trigrams, pairs and words."""
        k = word[4]
        p = (np.where(k > 0, (k - totals.d1[np.minimum(k, 3)]) / totals.total, 0) + totals.floor)[self.word]
        freed = lambda d, x: d[1] * x[1] + d[2] * x[2] + d[3] * x[3]
        of_word, of_context = (word[0], freed(totals.d2, word[:4])), (pair[1], freed(totals.d3, pair[1:]))
        for n, at, d, (total, free), before in ((pair[0], self.pair, totals.d2, of_word, self.near), (tri[0], self.tri, totals.d3, of_context, self.context)):
            total, own = total[before], n - d[np.minimum(n, 3)]
            p = np.where(total > 0, (own[at] + free[before] * p) / np.maximum(total, 1), p)
        return np.log10(np.maximum(p, 1e-300))

    def without_own(self, doc: np.ndarray, tri: np.ndarray, pair: np.ndarray, word: np.ndarray, totals: Totals) -> np.ndarray:
        """The same for texts that the model has counted, under the model without the word's own text."""
        out, lo, ends = np.zeros(len(doc)), 0, np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
        while lo < len(doc):  # some whole texts after the others
            hi = int(ends[min(np.searchsorted(ends, lo + OWN_WORDS), len(ends) - 1)])
            out[lo:hi] = self._without_own(slice(lo, hi), doc[lo:hi] - doc[lo], tri, pair, word, totals)
            lo = hi
        return out

    def _without_own(self, part: slice, doc: np.ndarray, tri: np.ndarray, pair: np.ndarray, word: np.ndarray, totals: Totals) -> np.ndarray:
        # first place of each n-gram in each text, and the number of the one at each place
        places = lambda x: np.unique(doc * (int(x.max()) + 1) + x, return_index=True, return_inverse=True)[1:]
        grams = [x[part] for x in (self.tri, self.pair, self.context, self.near, self.word)]
        (at_tri, of_tri), (at_pair, of_pair), (at_context, of_context), (at_near, of_near), (at_word, of_word) = map(places, grams)
        less = lambda at, x, size: np.bincount(at, x, minlength=size).astype(np.int64)
        gone = lambda old, new: (old > 0) & (new == 0)
        n, m, k = tri[0][grams[0][at_tri]], pair[0][grams[1][at_pair]], word[4][grams[4][at_word]]
        n_left = np.maximum(n - np.bincount(of_tri), 0)
        m_left = np.maximum(m - less(of_pair[at_tri], gone(n, n_left), len(m)), 0)
        k_left = np.maximum(k - less(of_word[at_pair], gone(m, m_left), len(k)), 0)

        def left(x, at, old, new, d):
            """(total, share that discounts free) of contexts whose followers' counts were old and are new."""
            kinds = [np.maximum(x[j] - less(at, np.minimum(old, 3) == j, x.shape[1]) + less(at, np.minimum(new, 3) == j, x.shape[1]), 0) for j in (1, 2, 3)]
            return np.maximum(x[0] - less(at, old - new, x.shape[1]), 0), d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[2]

        texts, d = int(doc[-1]) + 1, totals.d1
        total = np.maximum(totals.total - less(doc[at_pair], gone(m, m_left), texts), 1)
        freed = np.maximum(totals.freed + np.bincount(doc[at_word], d[np.minimum(k_left, 3)] - d[np.minimum(k, 3)], minlength=texts), 0)
        floor = freed / total / (totals.distinct + 1 - less(doc[at_word], gone(k, k_left), texts))
        p = np.where(k_left > 0, k_left - d[np.minimum(k_left, 3)], 0)[of_word] / total[doc] + floor[doc]
        near = left(word[:4, grams[3][at_near]], of_near[at_pair], m, m_left, totals.d2)
        context = left(pair[1:, grams[2][at_context]], of_context[at_tri], n, n_left, totals.d3)
        for x, at, d, (total, free), before in ((m_left, of_pair, totals.d2, near, of_near), (n_left, of_tri, totals.d3, context, of_context)):
            total, own = total[before], x - d[np.minimum(x, 3)]
            p = np.where(total > 0, (own[at] + free[before] * p) / np.maximum(total, 1), p)
        return np.log10(np.maximum(p, 1e-300))


def _held(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {kind: _gathered(rows, kind, columns) for kind, columns in COLUMNS.items()}


def train(texts: DataFrame) -> dict:
    """A small model as a whole, in memory: sorted keys (tri, pair, uni) with their numbers, and the totals. ``judge`` leaves it in its shards."""
    found = counts(texts, partitions(texts.sparkSession))
    if found is None:
        return {}
    model, out = _held(found[0].rows.orderBy("shard").toArrow()), {"totals": found[1]}
    found[0].drop()
    for name, kind in (("tri", TRI), ("pair", PAIR), ("uni", WORD)):
        order = np.argsort(model[kind][0])
        out[name], out[f"{name}_numbers"] = model[kind][0][order], model[kind][1][:, order]
    return out


def log_probabilities(model: dict, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """log10 probability of every word after the two before it, under a model in memory."""
    r = Run(h, doc, 1)
    of = lambda name, asked: _found(model[name], model[f"{name}_numbers"], asked)
    return r.log_probabilities(of("tri", r.tris), of("pair", r.pairs), of("uni", r.words), model["totals"])


def _asking(shards: int):
    """A run's distinct words, pairs and trigrams, packed by shard."""

    def run(table: pa.Table) -> pa.Table:
        r = Run(*_words_of(table.column("text")), shards)
        full = np.arange(shards)[np.any([np.diff(c) > 0 for c in r.cuts], 0)]
        asked = [_split(x, c, full) for x, c in zip((r.words, r.pairs, r.tris), r.cuts, strict=True)]
        return pa.table([pa.array(full, pa.int32()), pa.array(np.full(len(full), table.column("run")[0].as_py()), pa.int64()), *asked], ["shard", "run", "words", "pairs", "tris"])

    return run


_ANSWERS = [(kind, f"{name}{k}") for kind, name in ((TRI, "tri"), (PAIR, "pair"), (WORD, "word")) for k in range(COLUMNS[kind])]


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """A shard's numbers for all runs that ask it."""
    held, out = _held(model), {c: [] for _, c in _ANSWERS}
    for r in asked.to_pylist():
        found = {kind: _found(*held[kind], np.frombuffer(r[c], "<u8")) for kind, c in ((TRI, "tris"), (PAIR, "pairs"), (WORD, "words"))}
        for (_, c), x in zip(_ANSWERS, [x for kind in COLUMNS for x in found[kind]], strict=True):
            out[c].append(K.narrow(x))
    return pa.table([asked.column("run"), asked.column("shard"), *[pa.array(v, pa.binary()) for v in out.values()]], ["run", "shard", *out])


def _scoring(totals: Totals, shards: int, whole: bool):
    """(hash, salt, n_words, log10 probability) of a run's texts, one row for equal ones; with whole, also that without a text's own counts."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        h, doc = _words_of(texts.column("text"))
        r, answers = Run(h, doc, shards), answers.sort_by("shard")
        sizes = {WORD: np.diff(r.cuts[0]), PAIR: np.diff(r.cuts[1]), TRI: np.diff(r.cuts[2])}
        got = {kind: np.array([K.wide(answers.column(c).to_pylist(), sizes[kind]) for of, c in _ANSWERS if of == kind]) for kind in COLUMNS}
        n = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, r.log_probabilities(got[TRI], got[PAIR], got[WORD], totals), minlength=len(texts))
        own = np.bincount(doc, r.without_own(doc, got[TRI], got[PAIR], got[WORD], totals), minlength=len(texts)) if whole else None
        hash_, salt = texts.column("hash").to_numpy(), texts.column("salt").to_numpy()
        _, at = np.unique(np.array([hash_, salt.astype(np.int64)]), axis=1, return_index=True)
        out = {"hash": hash_[at], "salt": salt[at], "n_words": n[at].astype(np.int64), "total": total[at]}
        return pa.table(out | {"own": own[at]} if whole else out)

    return run


def _text_key(text: Column, id_: Column) -> tuple[Column, Column]:
    """The hash of a text, and a number below SALTS by id, so that many copies of a text are not one group."""
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")


def scores(docs: DataFrame, model: DataFrame, totals: Totals, shards: int, size: int, id_column: str, text_column: str, whole: bool = False) -> DataFrame:
    """(hash, salt, n_words, total): the number of words and log10 probability of every text, by ``_text_key``; with whole, also
    own, that without the text's own counts, for texts that have some. Batches of runs, of which one lies in shuffles at a time."""
    spark = docs.sparkSession
    batches = max(1, min(BATCHES, -(-size // BATCH_BYTES)))
    runs = max(batches, -(-size // (RUN_BYTES // 3 if whole else RUN_BYTES)))  # memory, not results, depends on these
    hash_, salt = _text_key(docs[text_column], docs[id_column])
    texts = docs.select(hash_.alias("hash"), salt.alias("salt"), docs[text_column].alias("text"))
    texts = texts.withColumn("run", F.pmod(F.xxhash64("hash", "salt"), F.lit(runs)))
    out = []
    for k in range(batches):
        of_batch = texts.filter(F.pmod("run", F.lit(batches)) == k)
        asked = of_batch.groupBy("run").applyInArrow(_asking(shards), "shard int, run long, words binary, pairs binary, tris binary")
        answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answer, "run long, shard int, " + ", ".join(f"{c} binary" for _, c in _ANSWERS))
        done = of_batch.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_scoring(totals, shards, whole), "hash long, salt int, n_words long, total double" + ", own double" * whole)
        out.append(cut(done, "scores"))
        del of_batch, asked, answers, done
        release_shuffles(spark)
    return functools.reduce(DataFrame.unionByName, out)


def quantiles(rows: DataFrame, q: float) -> DataFrame:
    """(lang, value, n): the exact quantile of x in each group ``lang``, null being one, as numpy interpolates it.

    Counts of narrow ranges tell where it lies; only the values of those ranges are ranked, equal ones as one."""
    ranges = F.floor(F.col("x") * RANGES)
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.groupBy("lang", ranges.alias("range")).agg(F.count(F.lit(1)).alias("c"))
    place = F.lit(q) * (F.sum("c").over(Window.partitionBy("lang")) - 1)
    counted = counted.withColumn("n", F.sum("c").over(Window.partitionBy("lang"))).withColumn("place", place).withColumn("before", F.sum("c").over(upto(["lang"], "range")) - F.col("c"))
    asked = counted.filter((F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("c") > F.floor("place"))).select(F.col("lang").alias("g"), F.col("range").alias("r"), "n", "place", "before")
    near = rows.join(F.broadcast(asked), F.col("lang").eqNullSafe(F.col("g")) & (ranges == F.col("r")))  # two ranges for each language at most
    near = near.groupBy("lang", "r", "n", "place", "before", "x").agg(F.count(F.lit(1)).alias("c"))
    near = near.withColumn("to", F.col("before") + F.sum("c").over(upto(["lang", "r"], "x"))).withColumn("from", F.col("to") - F.col("c"))
    at = lambda p: F.max(F.when((F.col("from") <= p) & (F.col("to") > p), F.col("x")))
    near = near.groupBy("lang", "n", "place").agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"))
    return near.select("lang", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("value"), "n")


def _drawn(x: Column, n_words: Column, middle: Column) -> Column:
    """log10 perplexity of a text, drawn to the middle as if PRIOR_WORDS more words had it."""
    return (n_words * x + PRIOR_WORDS * middle) / (n_words + PRIOR_WORDS)


def thresholds(rows: DataFrame) -> dict[str | None, tuple[float, float]]:
    """(middle, bound) of each language with LEAST_TRUSTED rows of (lang, n_words, x) or more, and of all rows under None."""
    rows = cut(rows.filter("lang is not null").unionByName(rows.withColumn("lang", F.lit(None).cast("string"))), "bounds")
    middles = quantiles(rows, 0.5).filter((F.col("n") >= LEAST_TRUSTED) | F.col("lang").isNull()).collect()  # one row for each language
    if not middles:
        return {}
    of = rows.sparkSession.createDataFrame([(r["lang"], r["value"]) for r in middles], "g string, middle double")
    drawn = rows.join(F.broadcast(of), F.col("lang").eqNullSafe(F.col("g"))).select("lang", _drawn(F.col("x"), F.col("n_words"), F.col("middle")).alias("x"))
    high = {r["lang"]: r["value"] + MARGIN for r in quantiles(drawn, HIGH_QUANTILE).collect()}
    return {r["lang"]: (r["value"], high[r["lang"]]) for r in middles}


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", whole: bool = False) -> DataFrame:
    """docs with _n_words, _perplexity, _high (the bound on its log10) and _kept, which replace columns of these names.

    With whole, every trusted document is counted and sets the bounds, and its perplexity is that without its own counts."""
    spark = docs.sparkSession
    docs = docs.drop("_n_words", "_perplexity", "_high", "_kept")
    own = {c: f"_{c}_{uuid.uuid4().hex}" for c in ("hash", "salt", "of_hash", "of_salt", "total", "own", "trusted", "lang", "middle")}
    trains = lambda c: F.pmod(F.xxhash64(c), F.lit(TRAIN_DOCUMENTS + THRESHOLD_DOCUMENTS)) < TRAIN_DOCUMENTS
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    size = docs.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    texts = docs.select(docs[id_column].alias("_id"), docs[text_column].alias("_text"))
    if whole:
        shards = max(1, -(-size // (SHARD_BYTES // 6)))  # three times as many words are counted, in groups of half the size
        bounding = trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_TRUSTED else trusted
    else:
        shards = max(1, -(-size // SHARD_BYTES))
        # the part that trains is told by ids alone, so no other text is shuffled to find it
        texts = texts.filter(trains(F.col("_id").cast(trusted.schema["_trusted"].dataType)))
        bounding = trusted.filter(~trains(F.col("_trusted")))
    model = counts(texts.join(trusted, F.col("_id") == F.col("_trusted")).select("_text"), shards)
    if model is None:
        scored = docs.withColumn("_n_words", F.lit(None).cast("long")).withColumn("_perplexity", F.lit(None).cast("double"))
        return scored.withColumn("_high", F.lit(None).cast("double")).withColumn("_kept", F.lit(True))
    of_texts = scores(docs, model[0].rows, model[1], shards, size, id_column, text_column, whole)
    model[0].drop()
    hash_, salt = _text_key(docs[text_column], docs[id_column])
    x = -F.col("own" if whole else "total") / F.col("n_words")
    held_out = docs.select(docs[id_column].alias("_id"), docs[lang_column].cast("string").alias("lang"), hash_.alias("hash"), salt.alias("salt"))
    held_out = held_out.join(bounding, F.col("_id") == F.col("_trusted")).join(of_texts, ["hash", "salt"])
    groups = thresholds(held_out.filter("n_words > 0").select("lang", "n_words", F.least(F.lit(300.0), x).alias("x")))
    middle_all, high_all = groups.pop(None, (0.0, float("inf")))
    bounds = spark.createDataFrame([(lang, *g) for lang, g in groups.items()], f"{own['lang']} string, {own['middle']} double, _high double")
    of_texts = of_texts.toDF(own["of_hash"], own["of_salt"], "_n_words", own["total"], *[own["own"]] * whole)
    scored = docs.withColumns({own["hash"]: hash_, own["salt"]: salt})  # as columns, so that a text that nobody reads further on is not shuffled
    scored = scored.join(of_texts, (F.col(own["hash"]) == F.col(own["of_hash"])) & (F.col(own["salt"]) == F.col(own["of_salt"])), "left")
    total = F.col(own["total"])
    if whole:
        mine = trusted.select(F.col("_trusted").alias(own["trusted"]))
        scored = scored.join(mine, scored[id_column] == F.col(own["trusted"]), "left")
        total = F.when(F.col(own["trusted"]).isNotNull(), F.col(own["own"])).otherwise(total)
    log = F.least(F.lit(300.0), -total / F.col("_n_words"))
    scored = scored.withColumn("_perplexity", F.when(F.col("_n_words") > 0, F.pow(F.lit(10.0), log)))
    out = scored.join(F.broadcast(bounds), scored[lang_column] == bounds[own["lang"]], "left")
    out = out.withColumn("_high", F.coalesce("_high", F.lit(high_all)))
    drawn = F.when(F.col("_n_words") > 0, _drawn(log, F.col("_n_words"), F.coalesce(own["middle"], F.lit(middle_all))))
    return out.withColumn("_kept", F.coalesce(drawn <= F.col("_high"), F.lit(False))).drop(*own.values())


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", F.col("_n_words").alias("n_words"), F.col("_perplexity").alias("perplexity"), F.col("_kept").alias("kept"))
