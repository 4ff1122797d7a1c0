"""Alignment of two tokenizers' tokens over the same bytes, as an Arrow pipeline inside tasks.

Texts are read in slices of about SLICE bytes. Of a slice, with a space before
each text:

1. the bytes are cut before single spaces between plain characters, where
   neither tokenizer has a token across; the distinct cuts are encoded, the rest
   are dictionary indices (``take`` of list arrays);
2. lists are flattened with their parent indices, token lengths are summed up
   along each document: the byte offset where each token ends;
3. a hash join of both tables on (document, end), one number, gives the links;
4. ``Table.group_by`` counts a slice's links by (document, pair of ids).

What a task makes of a document is one narrow row, written once. From these rows
partial counts of pairs, again by ``Table.group_by``, go to Spark, which adds
them up over the corpus. Linked tokens end together, so that one's bytes are the
end of the other's: the distinct pairs number at most the bytes of both
vocabularies (times the ids that share bytes), some 600,000 for the default
files whatever the corpus, and may be broadcast. Ids have 16 bits at most. A last narrow pass looks them
up; no text is encoded twice and no link is shuffled.

Defined results: texts that are null or empty, or that a tokenizer does not give
back byte for byte after the space, have no tokens: zeros and ''. Strings of
special tokens are plain text. Null and repeated ids are rows like others; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import _AS_TEXT, _PRINTABLE
from .shared import cut
from .textkernel import buffers, pieces

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE, CACHED, JOINED = 2 << 20, 200_000, 1 << 16
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"

_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


class Tokens:
    """One tokenizer: ids of a text, and each id's bytes."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(entries, pa.binary())
        self.lengths = np.array([len(e) for e in entries], np.int64)

    def of(self, ids: np.ndarray) -> bytes:
        made = self.bytes.take(pa.array(ids))
        return made.buffers()[2].to_pybytes()[: int(self.lengths[ids].sum())] if len(ids) else b""


def byte_level(file: str) -> Tokens:
    """A byte-level vocabulary of the tokenizers library; a text is encoded as it is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.encode_special_tokens = True
    back = {chr(b): b for b in _PRINTABLE} | {chr(c): b for b, c in _AS_TEXT.items()}
    names = {i: s for s, i in t.get_vocab().items()}
    entries = [bytes(back[c] for c in names[i]) if all(c in back for c in names[i]) else names[i].encode() for i in range(len(names))]
    return Tokens(lambda text: t.encode(text, add_special_tokens=False).ids, entries)


def piece_level(file: str) -> Tokens:
    """A sentencepiece model with byte fallback, which puts a space before a text itself."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=file)
    entry = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    if any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size())):
        raise ValueError("pieces across words: this model can't be encoded word by word")
    return Tokens(lambda text: m.encode(text[1:]), [entry(i) for i in range(m.get_piece_size())])


def _regular(u: bytes) -> bool:
    """Begins with one space before a plain character and ends with one: it may stand between others of its kind."""
    return len(u) > 1 and (32 < u[1] < 127 or u[1] == 0xC3) and (32 < u[-1] < 127 or (len(u) > 2 and u[-2] == 0xC3))


class Both:
    """Two tokenizers with what they made of the last units: two generations of CACHED units at most."""

    def __init__(self, a: Tokens, b: Tokens):
        if max(len(a.lengths), len(b.lengths)) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.a, self.b = a, b
        self.known: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.older: dict[bytes, tuple[bytes, bytes, bool]] = {}
        most = max(len(a.lengths), len(b.lengths))
        self.numbers = pa.array([f"{i}{s}" for i in range(most) for s in (",", "|", ";", "")])

    def _one(self, unit: bytes) -> tuple[bytes, bytes, bool]:
        text = unit.decode()
        a, b = (np.array(t.encode(text), np.int32) for t in (self.a, self.b))
        return a.tobytes(), b.tobytes(), self.a.of(a) == unit and self.b.of(b) == unit

    def _several(self, units: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        """Regular units in one run: tokens never cross from one to the next."""
        joined = b"".join(units)
        text, ends = joined.decode(), np.cumsum([len(u) for u in units])
        parts = []
        for t in (self.a, self.b):
            ids = np.array(t.encode(text), np.int32)
            upto = np.cumsum(t.lengths[ids])
            at = np.searchsorted(upto, ends)
            if not len(upto) or upto[-1] != ends[-1] or not np.array_equal(upto[at], ends) or t.of(ids) != joined:
                return [self._one(u) for u in units]
            raw, last = ids.tobytes(), ((at + 1) * 4).tolist()
            parts.append([raw[x:y] for x, y in zip([0, *last[:-1]], last, strict=True)])
        return [(a, b, True) for a, b in zip(*parts, strict=True)]

    def units(self, distinct: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        """(ids of a, ids of b, whether both give the bytes back) of each unit."""
        if len(self.known) > CACHED:
            self.older, self.known = self.known, {}
        new, size = [], 0
        for u in distinct:
            if u in self.known:
                continue
            if u in self.older:
                self.known[u] = self.older[u]
            elif not _regular(u):
                self.known[u] = self._one(u)
            else:
                new.append(u)
                size += len(u)
                if size > JOINED:
                    self.known.update(zip(new, self._several(new), strict=True))
                    new, size = [], 0
        if new:
            self.known.update(zip(new, self._several(new), strict=True))
        return [self.known[u] for u in distinct]


def _cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin: texts, and single spaces between plain characters (ASCII, and Latin letters of two bytes)."""
    after = np.zeros(len(data), bool)
    after[:-1] = _SOLID[data[1:]] | (data[1:] == 0xC3)
    before = np.zeros(len(data), bool)
    before[1:] = _SOLID[data[:-1]]
    before[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 128)
    at = (data == 32) & after & before
    at[starts] = True
    return np.flatnonzero(at)


def _lists(parts: list[bytes], indices: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit) of all units in order, from the ids of the distinct ones."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) >> 2 for p in parts], out=ends[1:])
    taken = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32))).take(indices)
    return pc.list_flatten(taken).to_numpy(zero_copy_only=False), pc.list_parent_indices(taken).to_numpy(zero_copy_only=False)


def _valid(both: Both, data, starts, ends, a_ids, a_doc, b_ids, b_doc, doubtful: np.ndarray) -> np.ndarray:
    """Which documents both tokenizers give back; only those with a doubtful unit are compared as a whole."""
    ok = np.ones(len(starts), bool)
    for k in np.flatnonzero(doubtful):
        text = data[starts[k] : ends[k]].tobytes()
        for t, ids, doc in ((both.a, a_ids, a_doc), (both.b, b_ids, b_doc)):
            lo, hi = np.searchsorted(doc, [k, k + 1])
            ok[k] &= t.of(ids[lo:hi]) == text
    return ok


def _links(a_key, a_ids, b_key, b_ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) of all pairs of tokens with one key, by a hash join."""
    left = pa.table({"key": a_key, "a": a_ids})
    right = pa.table({"key": b_key, "b": b_ids})
    t = left.join(right, "key", join_type="inner", use_threads=False)
    return t["key"].to_numpy(), t["a"].to_numpy(), t["b"].to_numpy()


def _digests(both: Both, a_ids, a_group, b_ids, b_group, group_doc, n: int) -> list[str]:
    """Each document's groups as text, hashed: ids of a, ids of b, with the separators in between."""
    total = len(a_ids) + len(b_ids)
    of_a, of_b = np.bincount(a_group, minlength=len(group_doc)), np.bincount(b_group, minlength=len(group_doc))
    a_at = np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[a_group]  # after the tokens of b in the groups before
    b_at = np.arange(len(b_ids)) + np.cumsum(of_a)[b_group]
    ids, group, side = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, bool)
    ids[a_at], ids[b_at], group[a_at], group[b_at], side[b_at] = a_ids, b_ids, a_group, b_group, True
    doc = group_doc[group]
    same = group[1:] == group[:-1]
    sign = np.full(total, 3)
    sign[:-1] = np.where(same & (side[1:] == side[:-1]), 0, np.where(same, 1, np.where(doc[1:] == doc[:-1], 2, 3)))
    text = both.numbers.take(pa.array(ids * 4 + sign))
    offs = np.frombuffer(text.buffers()[1], np.int32)[: total + 1]
    raw = memoryview(text.buffers()[2]) if total else b""
    per = np.bincount(doc, minlength=n)
    hi = np.cumsum(per)
    lo = hi - per
    return [hashlib.sha256(raw[offs[x] : offs[y]]).hexdigest() if y > x else "" for x, y in zip(lo, hi, strict=True)]


def aligned(both: Both, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """A row as in COLUMNS for each text of a slice."""
    data, offs = buffers(texts)
    lengths = np.diff(offs)
    rows = np.flatnonzero(lengths > 0)  # the others have no tokens
    n = len(texts)
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digest, pairs, times = [""] * n, [b""] * n, [b""] * n
    if len(rows):
        data = np.insert(data, offs[:-1][rows], 32)
        ends = np.cumsum(lengths[rows] + 1)
        starts = ends - lengths[rows] - 1
        begin = _cuts(data, starts)
        bounds = pa.py_buffer(np.append(begin, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        made = both.units(coded.dictionary.to_pylist())
        unit_doc = np.searchsorted(starts, begin, "right") - 1
        index = coded.indices
        a_ids, unit = _lists([m[0] for m in made], index)
        a_doc = unit_doc[unit]
        b_ids, unit = _lists([m[1] for m in made], index)
        b_doc = unit_doc[unit]
        doubt = ~np.array([m[2] for m in made])[index.to_numpy()]
        ok = _valid(both, data, starts, ends, a_ids, a_doc, b_ids, b_doc, np.bincount(unit_doc[doubt], minlength=len(rows)) > 0)
        a_ids, a_doc = a_ids[ok[a_doc]], a_doc[ok[a_doc]]
        b_ids, b_doc = b_ids[ok[b_doc]], b_doc[ok[b_doc]]
        # documents that stay follow each other, each one step further than its bytes, so that a key names document and end
        a_key = np.cumsum(both.a.lengths[a_ids]) + a_doc
        b_key = np.cumsum(both.b.lengths[b_ids]) + b_doc
        key, a, b = _links(a_key, a_ids, b_key, b_ids)
        if len(key):
            marked = np.zeros(int(a_key[-1]) + 1, bool)
            marked[key] = True
            upto = np.cumsum(marked, dtype=np.int32)
            a_group, b_group = upto[a_key - 1], upto[b_key - 1]
            ending = marked[a_key] & (np.diff(a_key, append=a_key[-1] + 1) > 0)
            group_doc = a_doc[ending]
            link_doc = group_doc[upto[key] - 1]
            per = lambda x: np.bincount(x, minlength=len(rows))
            for c, x in (("n_a", a_doc), ("n_b", b_doc), ("n_groups", group_doc), ("n_links", link_doc)):
                counts[c][rows] = per(x)
            for r, h in zip(rows, _digests(both, a_ids, a_group, b_ids, b_group, group_doc, len(rows)), strict=True):
                digest[r] = h
            coded = (link_doc << 32) | (a.astype(np.int64) << 16) | b
            g = pa.table({"k": coded}).group_by("k", use_threads=False).aggregate([([], "count_all")])
            k, c = g["k"].to_numpy(), g["count_all"].to_numpy()
            order = np.argsort(k)
            k, c = k[order], c[order].astype("<i4")
            lo = np.searchsorted(k >> 32, np.arange(len(rows) + 1))
            pair = (k & ((1 << 32) - 1)).astype("<i8")
            for r, x, y in zip(rows, lo[:-1], lo[1:], strict=True):
                pairs[r], times[r] = pair[x:y].astype("<u4").tobytes(), c[x:y].tobytes()
    return pa.RecordBatch.from_arrays([ids, *[pa.array(counts[c]) for c in counts], pa.array(digest), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], ["doc_id", *counts, "groups_sha256", "pairs", "counts"])


def _file(name: str) -> str:
    """Where a file of the public tokenizers lies; other paths stay as they are."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[tuple[str, str], Both] = {}


def loaded(a_file: str, b_file: str) -> Both:
    """Both tokenizers, once for each Python worker."""
    key = (a_file, b_file)
    if key not in _LOADED:
        _LOADED[key] = Both(byte_level(_file(a_file)), piece_level(_file(b_file)))
    return _LOADED[key]


def _partial_counts(it):
    """(pair, n): the links of a batch of documents, counted."""
    for batch in it:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            pair, n = (np.frombuffer(b"".join(part.column(i).to_pylist()), kind) for i, kind in ((0, "<u4"), (1, "<i4")))
            g = pa.table({"pair": pair.astype(np.int64), "n": n.astype(np.int64)}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
            yield from g.select(["pair", "n_sum"]).rename_columns(["pair", "n"]).combine_chunks().to_batches()


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row as in COLUMNS for each document; (a, b, pair, links) for each pair of ids linked somewhere."""

    def run(it):
        both = loaded(a_file, b_file)
        for batch in it:
            for lo, hi in pieces(batch.column(1), SLICE):
                yield aligned(both, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    rows = cut(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, COLUMNS), "aligned")
    pairs = rows.filter("n_links > 0").select("pairs", "counts").mapInArrow(_partial_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("links"))
    return rows, pairs.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), "pair", "links")


def scored(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents with n_best, links whose pair is the most frequent one of its b id, and count_sum, the corpus counts of their links."""
    rows, pairs = alignments(docs, a_file, b_file, id_column, text_column)
    table = pairs.select("pair", "b", "links").toArrow().sort_by("pair")  # at most the bytes of both vocabularies
    pair, b, links = (table[c].to_numpy() for c in ("pair", "b", "links"))
    most = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(most, b, links)
    known = docs.sparkSession.sparkContext.broadcast((pair, links, links == most[b]))

    def run(it):
        pair, links, best = known.value
        for batch in it:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                own, n = (np.frombuffer(b"".join(part.column(i).to_pylist()), kind) for i, kind in ((6, "<u4"), (7, "<i4")))
                ends = np.cumsum(np.asarray(pc.binary_length(part.column(6))) >> 2)
                at = np.searchsorted(pair, own)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[at].astype(np.int64), n * links[at])]
                n_best, count_sum = (s[ends] - s[np.concatenate([[0], ends[:-1]]).astype(np.int64)] for s in sums)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(5)], pa.array(n_best), pa.array(count_sum), part.column(5)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
