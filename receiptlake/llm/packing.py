"""Packing documents into sequences by cutting-stock column generation.

Documents become token ids; each whole ``length`` of them is a sequence of its
own, and the rests, shorter than a sequence, are packed:

1. a histogram of the rests' lengths, rounded up to a few hundred bins;
2. a linear program over patterns (how many pieces of each bin one sequence
   takes) that minimises the number of sequences; a knapsack by dynamic
   programming over the capacity finds the pattern to add, until none helps;
3. patterns are taken a whole number of times, what the rounding leaves is
   packed first-fit by falling length;
4. documents are ranked inside their bin and take the pattern's places by rank.

Only the histogram, which has as many rows as there are bins, comes to the
driver. Ranks come from counts of small blocks, so no bin passes through one
task. Padding is what the rounding up of lengths leaves.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; ids that are null stay null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut

LENGTH, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
MOST_BINS, RANK_BLOCKS = 256, 64
CACHED_WORDS, PIECE_BYTES = 300_000, 16 << 20


# The bytes that byte-level vocabularies write as themselves; the others, in order, from code point 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_TEXT = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


def _latin_word(part: str) -> bool:
    """Letters below U+0250 only, before and after lower-casing: one token piece, and no normal form changes it."""
    return part.isalpha() and (part.isascii() or max(part) < "\u0250" and part.lower().isalpha())


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Ids of whole texts, as little-endian 32-bit bytes, by the tokenizers library.

    No token of this vocabulary spans white space, so white-space-separated parts
    are encoded alone and kept, two generations of CACHED_WORDS at most. Texts with
    unusual separators or markers of special tokens are encoded as a whole."""

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.older = Tokenizer.from_file(file), {}
        self.tokenize = self.tokenizer.model.tokenize

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            if _latin_word(part):
                word = part.lower() if part.isascii() else "".join(map(str.lower, part)).encode().decode("latin-1").translate(_AS_TEXT)
                ids = _bytes([t.id for t in self.tokenize(word)])
            elif part[-1] in ".," and _latin_word(part[:-1]):
                ids = self[part[:-1]] + self[part[-1]]
            else:
                ids = self.whole(part)
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))

    def all_ids(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end after it; where each text begins among them). Each distinct part is looked up once."""
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\x1c-\x1f]"))
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))  # as the vocabulary does, so that fewer parts differ
        coded = split.flatten().dictionary_encode()
        parts = [self[w] if w else b"" for w in coded.dictionary.to_pylist()]
        ends = np.full(len(texts), len(parts))
        parts.append(end)
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            ends[k] = len(parts)
            parts.append(self.whole(texts[k].as_py()) + end)
        to = split.offsets.to_numpy().astype(np.int64)
        to -= to[0]
        code = np.insert(coded.indices.to_numpy().astype(np.int64), to[1:], ends)
        ids, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        n = sizes[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        places = np.repeat((np.cumsum(sizes) - sizes)[code] - upto[:-1], n)
        places += np.arange(len(places))
        return ids[places], upto[to + np.arange(len(to))]


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, file: str, length: int = LENGTH, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole sequences and the rest of each document, at most length ids each."""
    end = np.array([end_id], "<u4").tobytes()

    def run(it):
        encoder = _ENCODERS.get(file)
        if encoder is None:
            encoder = _ENCODERS[file] = Encoder(file)
        for batch in it:
            rows: list[list] = [[], [], [], [], []]
            for lo, hi in K.pieces(batch.column(1), PIECE_BYTES):
                ids, begin = encoder.all_ids(batch.column(1).slice(lo, hi - lo), end)
                data, begin = memoryview(ids.view(np.uint8)), begin.tolist()
                for doc_id, at, to in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), begin[:-1], begin[1:], strict=True):
                    for start in range(at, to, length):
                        last = min(to, start + length)
                        for column, value in zip(rows, (doc_id, start - at, last - start, zlib.crc32(data[4 * start : 4 * last]), to - at), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each size, any number of times each, fit in the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            with_one = best[c - s[:k]] + v[:k]
            i = int(with_one.argmax())
            if with_one[i] > best[c] + 1e-12:
                best[c], last[c] = with_one[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[order[last[c]]] += 1
            c -= s[last[c]]
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that serve the demand for each size exactly or with places to spare.

    The revised simplex method on the linear program, one column for each round: the
    inverse of the basis is kept and updated. Stopping at most_rounds costs padding only."""
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)  # columns of the basis
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    for _ in range(most_rounds):
        prices = inverse.sum(0)
        value, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x -= step * d
        x[r] = step
        x = np.maximum(x, 0)
        row = inverse[r] / d[r]
        inverse -= np.outer(d, row)
        inverse[r] = row
        patterns[:, r] = column
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x):
        p = patterns[:, k].astype(np.int64)
        used = p > 0
        times = int(min(np.floor(x[k] + 1e-9), (left[used] // p[used]).min()))
        if times > 0:
            out.append((p, times))
            left -= times * p
    open_room: list[int] = []
    open_pattern: list[np.ndarray] = []
    for i in np.argsort(-sizes):  # what is left: at most one sequence for each pattern
        for _ in range(int(left[i])):
            rooms = np.array(open_room) if open_room else np.zeros(0)
            fit = np.flatnonzero(rooms >= sizes[i])
            if len(fit):
                k = int(fit[rooms[fit].argmin()])
            else:
                k = len(open_room)
                open_room.append(capacity)
                open_pattern.append(np.zeros(m, np.int64))
            open_room[k] -= int(sizes[i])
            open_pattern[k][i] += 1
    return out + [(p, 1) for p in open_pattern]


def places(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each bin, by falling first rank: (first rank, pieces in one sequence, first sequence number)."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        for b in np.flatnonzero(pattern).tolist():
            at = taken.get(b, 0)
            out.setdefault(b, []).append((at, int(pattern[b]), sequence))
            taken[b] = at + int(pattern[b]) * times
        sequence += times
    return {b: tuple(np.array(c) for c in zip(*rows, strict=True)) for b, rows in out.items()}


def pack(docs: DataFrame, file: str | Callable[[], str], length: int = LENGTH, end_id: int = END_ID, **columns) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece."""
    file = file() if callable(file) else file
    all_pieces = cut(pieces(docs, file, length, end_id, **columns), "pieces")
    width = max(1, -(-length // MOST_BINS))
    # blocks by what a piece holds: equal pieces fall into one block, whose size then doesn't matter for their order
    rests = all_pieces.filter(F.col("length") < length).withColumn("bin", F.ceil(F.col("length") / width).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(RANK_BLOCKS)).cast("int"))
    by_block = rests.groupBy("bin", "block").agg(F.count(F.lit(1)).alias("n")).collect()  # at most MOST_BINS * RANK_BLOCKS rows
    counts = np.zeros((MOST_BINS + 1, RANK_BLOCKS), np.int64)
    for row in by_block:
        counts[row["bin"], row["block"]] = row["n"]
    before = np.cumsum(counts, 1) - counts
    demand = counts.sum(1)
    bins = np.flatnonzero(demand)
    plan = solve(bins, demand[bins], length // width) if len(bins) else []  # lengths counted in widths of a bin
    where = {int(bins[b]): v for b, v in places(plan).items()}
    n_sequences = sum(times for _, times in plan)

    def assign(it):
        for batch in it:
            bin_, block, rank = (batch.column(c).to_numpy() for c in ("bin", "block", "rank"))
            rank = rank + before[bin_, block]
            sequence = np.zeros(len(rank), np.int64)
            for b in np.unique(bin_).tolist():
                first, each, start = where[b]
                mine = np.flatnonzero(bin_ == b)
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine] = start[k] + (rank[mine] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence, pa.int64())], [*kept, "sequence_id"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rank = F.row_number().over(Window.partitionBy("bin", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = rests.withColumn("rank", rank.cast("long")).mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)).cast("long"))
    # a whole sequence is named by the partition that holds it and its place there
    whole = all_pieces.filter(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id() + n_sequences).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(whole)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_file)
