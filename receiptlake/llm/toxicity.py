"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four context transducers (target, negation, reported speech and quotes, and
announcements of what someone will do) are composed once into one machine whose
states are tuples of theirs; each of its states has a weight for insults and
one for threats, and a final weight. The insult and threat acceptors are
automata over words with failure arcs; their patterns, single words, beginnings
of words or sequences of words, are learned from labelled documents, threats
also have a fixed list. A clause is read once from left to right by the
acceptors and the composed machine in step: the weight of its path is the sum
of the matched patterns' weights, each times the state's, times the final
state's weight, by which a target counts on either side of a pattern. A
document's score is a logistic function of its clauses' total.

Learning uses a bounded sample: SAMPLE labelled documents by hash of their ids,
where documents of equal text, but for case and white space, and equal label
count once. Patterns are chosen one after another by how many toxic documents
they add; threats are learned from words that follow an announcement.

Defined results: texts without words, null or empty, get the score of no match;
labels of held-out rows are never read; a document labelled both ways counts as
toxic; without usable labels only the fixed list is known; repeated rows are
scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import SPACE

FOLDS, HELD_OUT, SAMPLE, CUTOFF = 4, 2, 12_000, 0.3
MIN_DOCUMENTS, MIN_RATIO, LEAST_SHARE, COVER, PREFIXES = 4, 40.0, 0.005, 3, (3, 4, 5, 6, 7)
THREAT_WEIGHT = 1.5

# Words of the grammar in English, German, French and Spanish.
TARGETS = "you your yourself u he she they them him her du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos il elle ils tú usted ustedes ti él ella ellos vosotros".split()
NEGATIONS = "not no never isn aren wasn don nicht kein keine nie niemals pas jamais aucun aucune nunca jamás tampoco ni".split()
REPORTS = "said says say called calls quoted wrote claims claimed alleged sagte sagt nannte schrieb behauptet dit disait appelé écrit affirme dijo dice llamó escribió afirma".split()
THREATS = "kill hurt destroy töten umbringen tuer détruire matar destruir".split()
FUTURE = "will ll gonna shall werde werden wirst wird vais vas va allons allez vont voy vamos van".split()
NEGATION_REACH, REPORT_REACH, FUTURE_REACH = 3, 8, 4
NEGATED, REPORTED, CITED, AIMED, UNANNOUNCED = 0.4, 0.5, 0.25, 1.25, 0.5

CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
QUOTES = set('"“”«»')
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class Acceptor:
    """Weights of word sequences, as an automaton over words: states are beginnings of sequences, with failure arcs.

    A word that ends no sequence has the weight of its longest known beginning."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float] | None = None):
        self.words, self.beginnings = words, beginnings or {}
        self.lengths = sorted({len(b) for b in self.beginnings}, reverse=True)
        sequences = {tuple(w.split(" ")): x for w, x in words.items()}
        known = {(): 0} | {p: 0 for s in sequences for p in (s[:k] for k in range(1, len(s) + 1))}
        number = {p: i for i, p in enumerate(known)}
        self.arcs = {(number[p[:-1]], p[-1]): i for p, i in number.items() if p}
        shorter = lambda p: next(p[k:] for k in range(1, len(p) + 1) if p[k:] in number)
        self.fail = [number[shorter(p)] if p else 0 for p in number]
        self.out = [max((sequences.get(p[k:], 0.0) for k in range(len(p))), default=0.0) for p in number]

    def step(self, state: int, word: str) -> tuple[int, float]:
        """(state after a word, weight emitted with it)."""
        while (state, word) not in self.arcs and state:
            state = self.fail[state]
        state = self.arcs.get((state, word), 0)
        weight = self.out[state]
        for n in self.lengths if not weight else ():
            if len(word) >= n and (weight := self.beginnings.get(word[:n], 0.0)):
                break
        return state, weight


#: Classes of input symbols; a word may be of several.
TARGET, NEGATION, REPORT, QUOTE, ANNOUNCED = 1, 2, 4, 8, 16
BITS: dict[str, int] = {}
for _bit, _words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (ANNOUNCED, FUTURE)):
    for _word in _words:
        BITS[_word] = BITS.get(_word, 0) | _bit


class Transducer(NamedTuple):
    """A machine over symbols: where a symbol leads, and the weights of a state for insults, for threats and at the end."""

    start: str
    arc: Callable[[str, int], str]
    insult: dict[str, float]
    threat: dict[str, float]
    final: dict[str, float]


def _countdown(bit: int, reach: int) -> Callable[[str, int], str]:
    return lambda s, symbol: str(reach) if symbol & bit else s if symbol & QUOTE else str(max(0, int(s) - 1))


def _speech(state: str, symbol: int) -> str:
    """Numbers are words left after a verb of saying; 'cited' is inside quotes after one, 'quoted' inside others."""
    if symbol & QUOTE:
        return "0" if state in ("cited", "quoted") else "quoted" if state == "0" else "cited"
    return state if state in ("cited", "quoted") else _countdown(REPORT, REPORT_REACH)(state, symbol)


_negated = {str(k): NEGATED for k in range(1, NEGATION_REACH + 1)}
_reported = {str(k): REPORTED for k in range(1, REPORT_REACH + 1)} | {"cited": CITED}
CONTEXT = (
    Transducer("none", lambda s, symbol: "seen" if symbol & TARGET else s, {}, {}, {"seen": AIMED}),
    Transducer("0", _countdown(NEGATION, NEGATION_REACH), _negated, _negated, {}),
    Transducer("0", _speech, _reported, _reported, {}),
    Transducer("0", _countdown(ANNOUNCED, FUTURE_REACH), {}, {"0": UNANNOUNCED}, {}),
)


class Composed:
    """The composition of transducers that read the same symbols: reachable tuples of their states, weights multiplied."""

    def __init__(self, parts: tuple[Transducer, ...], symbols: range = range(32)):
        start = tuple(t.start for t in parts)
        self.states, self.arcs = {start: 0}, []
        for state in (order := [start]):  # grows while it is read
            row = []
            for symbol in symbols:
                to = tuple(t.arc(s, symbol) for t, s in zip(parts, state, strict=True))
                if to not in self.states:
                    self.states[to] = len(self.states)
                    order.append(to)
                row.append(self.states[to])
            self.arcs.append(row)
        weights = lambda kind: [math.prod(getattr(t, kind).get(s, 1.0) for t, s in zip(parts, state, strict=True)) for state in order]
        self.insult, self.threat, self.final = weights("insult"), weights("threat"), weights("final")


GRAMMAR = Composed(CONTEXT)


def clause_score(clause: str, insult: Acceptor, threat: Acceptor) -> float:
    """The weight of a clause's path through the acceptors and the composed machine."""
    state, at_insult, at_threat, total = 0, 0, 0, 0.0
    for w in WORD.findall(clause.lower()):
        if w in QUOTES:
            state = GRAMMAR.arcs[state][QUOTE]
            continue
        at_insult, a = insult.step(at_insult, w)
        at_threat, b = threat.step(at_threat, w)
        if a or b:
            total += a * GRAMMAR.insult[state] + b * GRAMMAR.threat[state]
        state = GRAMMAR.arcs[state][BITS.get(w, 0)]
    return total * GRAMMAR.final[state]


def text_score(text: str, insult: Acceptor, threat: Acceptor) -> float:
    return sum(clause_score(c, insult, threat) for c in CLAUSE.findall(text))


def _features(docs: DataFrame) -> DataFrame:
    """(doc, toxic, feature) with features 'w:word', 'p:beginning', 's:two words' and 't:word after an announcement', each once in a document."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nl}\p{No}]+"), lambda w: w != "")
    d = docs.select("doc", "toxic", words.alias("all")).withColumn("n", F.size("all"))
    long = lambda w: F.char_length(w) >= 3
    d = d.withColumn("w", F.array_distinct(F.filter("all", long)))
    shifted = lambda k: F.slice("all", F.lit(k + 1), F.greatest(F.col("n") - k, F.lit(0)))
    named = lambda kind, x: F.transform(x, lambda w: F.concat(F.lit(kind), w))
    begins = lambda k: F.transform(F.filter("w", lambda w: F.char_length(w) >= k), lambda w: F.substring(w, 1, k))
    pairs = F.filter(F.zip_with("all", shifted(1), lambda a, b: F.when(long(a) | long(b), F.concat(a, F.lit(" "), b))), lambda x: x.isNotNull())
    announced = lambda k: F.filter(F.zip_with("all", shifted(k), lambda a, b: F.when(a.isin(FUTURE) & long(b), b)), lambda x: x.isNotNull())
    parts = [named("w:", "w"), named("s:", pairs), *[named("p:", begins(k)) for k in PREFIXES], *[named("t:", announced(k)) for k in range(1, FUTURE_REACH + 1)]]
    return d.select("doc", "toxic", F.explode(F.array_distinct(F.concat(*parts))).alias("feature"))


def _covers(a: str, b: str) -> bool:
    """Whether two patterns would count some of the same words."""
    if "t:" in (a[:2], b[:2]) and a[:2] != b[:2]:
        return False
    begins = lambda p, f: any(w.startswith(p[2:]) for w in f[2:].split(" "))
    if a[:2] == "p:" or b[:2] == "p:":
        return a[:2] == "p:" and begins(a, b) or b[:2] == "p:" and begins(b, a)
    return not {*a[2:].split(" ")}.isdisjoint(b[2:].split(" "))


def learn(labelled: DataFrame) -> tuple[Acceptor, Acceptor, dict]:
    """Insult and threat patterns from (doc, toxic, text), a bounded sample."""
    sums = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_toxic, n_clean = (float(x or 0) for x in sums)
    least = max(MIN_DOCUMENTS, round(LEAST_SHARE * n_toxic))
    features = _features(labelled)
    ratio = ((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1))
    stats = features.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    stats = stats.filter(F.col("t") >= least).withColumn("ratio", ratio).filter(F.col("ratio") >= MIN_RATIO).select("feature", "ratio").persist()
    weight = {r["feature"]: float(np.log(r["ratio"])) for r in stats.collect()}  # as the sample
    in_docs: dict[str, set] = {}
    for r in features.filter("toxic = 1").join(F.broadcast(stats.select("feature")), "feature").select("feature", "doc").toLocalIterator():  # the toxic part of the sample
        in_docs.setdefault(r["feature"], set()).add(r["doc"])
    stats.unpersist()
    # greedy cover by documents added times weight; among equals the longest, so that a beginning is as narrow as its documents allow
    covered: dict = {}
    chosen: dict[str, dict[str, float]] = {"w:": {}, "p:": {}, "s:": {}, "t:": {}}
    gain = {f: len(d) * weight[f] for f, d in in_docs.items()}
    while gain:
        best = max(gain, key=lambda f: (gain[f], len(f), f))
        fresh = sum(covered.get(d, 0) < COVER for d in in_docs[best])
        if fresh * weight[best] < gain[best]:
            gain[best] = fresh * weight[best]
            if fresh < least:
                del gain[best]
            continue
        chosen[best[:2]][best[2:]] = weight[best]
        for d in in_docs[best]:
            covered[d] = covered.get(d, 0) + 1
        gain = {f: g for f, g in gain.items() if f != best and not _covers(best, f)}
    threats = {w: THREAT_WEIGHT for w in THREATS} | chosen["t:"]
    return Acceptor(chosen["w:"] | chosen["s:"], chosen["p:"]), Acceptor(threats), {"toxic": n_toxic, "clean": n_clean}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Logistic regression on one feature by Newton's method."""
    a = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - ridge * np.array([0.01, 1]) * w
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.array([[0.01, 0], [0, 1]]), grad)
        if np.abs(grad).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def plain(column: pa.Array) -> pa.Array:
    """Texts as the grammar reads them, for hashing: those outside ASCII as their lower-case words alone."""
    data, offs = K.buffers(column)
    odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[offs]))
    if not len(odd):
        return column
    texts = column.to_pylist()
    for i in odd.tolist():
        texts[i] = " ".join(NOT_LETTERS.sub(" ", c.lower()) for c in CLAUSE.findall(texts[i]))
    return pa.array(texts, column.type)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def scores(docs: DataFrame, insult: Acceptor, threat: Acceptor, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, total): the clauses' total of every text.

    Single words, beginnings and the first two words of sequences are found by hash first; only texts with one of them are read word by word."""
    sc = docs.sparkSession.sparkContext
    patterns = {*insult.words, *threat.words}
    whole = np.sort(np.array([K.word_hash(w) for w in patterns if " " not in w], np.uint64))
    sequences = [[K.word_hash(w) for w in p.split(" ")][:2] for p in patterns if " " in p]
    pairs = np.sort(_pair(*np.array(sequences, np.uint64).reshape(-1, 2).T))
    begun: dict[int, list[int]] = {}
    for b in {*insult.beginnings, *threat.beginnings}:
        begun.setdefault(len(b.encode()), []).append(K.word_hash(b))
    lengths = tuple(sorted(begun))
    held = sc.broadcast((insult, threat, whole, pairs, [np.sort(np.array(begun[k], np.uint64)) for k in lengths]))

    def among(table, keys):
        at = np.searchsorted(table, keys)
        at[at == len(table)] = 0
        return table[at] == keys if len(table) else np.zeros(len(keys), bool)

    def run(it):
        insult, threat, whole, pairs, tables = held.value
        for batch in it:
            for lo, hi in K.pieces(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                h, doc, _, _, *starts = K.words(*K.buffers(plain(part.column(1))), space=K.NOT_LETTERS, prefixes=lengths)
                hit = among(whole, h)
                if len(h):
                    hit[1:] |= among(pairs, _pair(h[:-1], h[1:]))
                for table, keys in zip(tables, starts, strict=True):
                    hit |= among(table, keys)
                total = np.zeros(hi - lo)
                for i in np.unique(doc[hit]).tolist():
                    total[i] = text_score(part.column(1)[i].as_py(), insult, threat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total)], ["doc_id", "total"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, total double")


def once(labelled: DataFrame) -> DataFrame:
    """(doc, toxic, text): one row, that of the smallest id, for each text and label."""
    normal = F.lower(F.btrim(F.regexp_replace("text", f"[{SPACE}]+", " ")))
    return labelled.groupBy(F.xxhash64(normal).alias("key"), F.hash(normal).alias("key2"), "toxic").agg(F.min(F.struct("doc", "text")).alias("d")).select("d.doc", "toxic", "d.text")


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    usable = labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(F.col("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    labelled = docs.select(F.col(id_column).alias("doc"), text.alias("text")).join(F.broadcast(sample), "doc")
    labelled = once(labelled).persist()
    insult, threat, n = learn(labelled)
    seen = scores(labelled.select("doc", "text"), insult, threat, "doc", "text").join(labelled.select(F.col("doc").alias("doc_id"), "toxic"), "doc_id").select("total", "toxic").toPandas()  # at most SAMPLE rows
    labelled.unpersist()
    a, b = _fit(np.log1p(seen["total"].to_numpy(float)), seen["toxic"].to_numpy(float)) if n["toxic"] and n["clean"] else (-3.0, 1.0)
    out = scores(docs, insult, threat, id_column, text_column)
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(max(b, 0.0)) * F.log1p("total"))))
    return out.select("doc_id", held_out().alias("held_out"), p.alias("score"), (p >= CUTOFF).cast("int").alias("predicted"), F.col("total").alias("clauses_total"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
