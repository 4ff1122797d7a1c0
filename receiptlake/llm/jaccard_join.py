"""Exact n-gram Jaccard self-join, to connected groups of near-duplicate documents.

A document's set is its distinct word shingles. Equal sets are one class, and
all further work is done once for a class.

1. Tiles. Each class lists the first quarter of its shingles, where shingles
   that many documents share come last; two sets at the threshold or above meet
   in one of them (prefix filter), within the size and position bounds. Lists
   travel as packed arrays, one for each tile of the shingle space; the number
   of tiles follows the data. A shingle's classes are a run, ordered by size.
2. Short runs are paired at once. Long runs with the same least class are one
   group, split in size bands a threshold wide; a band is compared with itself
   and the next one only. First every
   member is paired with its neighbour and with the band's most sharing member,
   so that a group of m near copies costs about m pairs. Hashed bitmap
   signatures bound the overlap from above by their bit counts, and sorted
   arrays are intersected exactly where the bound allows a link. The links give
   first components.
3. Every other pair of a band whose classes are not connected yet is checked in
   the same way, in blocks against blocks, once for all groups that hold it;
   blocks carry folded signatures, whose pairs the whole ones check again. The
   largest component of a band is only compared with the others, as pairs
   inside one component can't change it.

Nothing is capped or sampled: the order of shingles by frequency only moves
work, as any fixed order gives the same links. Shingles are 64-bit hashes.

Defined results: null or empty texts have no shingles and link with nothing;
shorter texts are one shingle; repeated rows are copies; ids that are null keep
their size and have the smallest other id of their group, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .linkage import components
from .shared import cut, partitions

U = np.uint64
WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4  # five words; Jaccard of three quarters
#: Only how shingles are ordered depends on these: how many of the most shared ones come last, and from how many in a run of tokens on one is a candidate.
MOST_SHARED, SHARED_FROM, RUN_TOKENS = 200_000, 6, 2_000_000
#: Shingles of which a tile holds the lists; from how many classes on a shingle's list is dealt out over all tiles.
TILE_SHINGLES, HOT_FROM = 2_000_000, 100_000
#: Runs of classes on one shingle up to this length are paired at once; longer ones by neighbours and stars first, then in blocks.
SHORT_RUN, BLOCK, BUCKET_ROWS = 8, 512, 10_000
BROADCAST_IDS = 1_000_000
#: Classes with a label up to which the labels are broadcast; beyond, over how many tasks the rows of a class are dealt out.
BROADCAST_LABELS, SALTS = 200_000, 16
_FACTORS = K.mix(np.arange(11, 11 + 64, dtype=U)) | U(1)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes."""
    h, doc, _, _ = K.words(data, offs)
    n_docs = len(offs) - 1
    per_doc = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    s = np.zeros(max(0, len(h) - size + 1), U)
    for k in range(size):
        s += h[k : k + len(s)] * _FACTORS[k]
    s = K.mix(s)
    ends = np.cumsum(per_doc)
    out = []
    for end, n in zip(ends.tolist(), per_doc.tolist(), strict=True):
        if n >= size:
            a = np.sort(s[end - n : end - size + 1])
            keep = np.empty(len(a), bool)
            keep[0] = True
            np.not_equal(a[1:], a[:-1], out=keep[1:])
            out.append(a[keep])
        elif n:
            out.append(K.mix(np.array([np.append(h[end - n : end] * _FACTORS[8 : 8 + n], _FACTORS[20 + n]).sum(dtype=U)], U)))
        else:
            out.append(s[:0])
    return out


def class_of(a: np.ndarray) -> int:
    """The 64-bit name of a set."""
    x = np.array([a.sum(dtype=U), K.mix(a ^ _FACTORS[41]).sum(dtype=U), len(a)], U) * _FACTORS[42:45]
    return int(K.mix(x.sum(keepdims=True)).view(np.int64)[0])


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The least overlap with any set that a set of n elements can link to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def overlap_for(n, m):
    """The least overlap with which sets of n and m elements link: NUMERATOR * union <= DENOMINATOR * overlap."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def signature(a: np.ndarray) -> np.ndarray:
    """A hashed bitmap, wider in the band of larger sets: 512 to 65,536 bits, as bytes.

    Four to eight bits for an element keep most differing elements visible as differing bits."""
    width = min(65536, max(512, 1 << (8 * len(a) - 1).bit_length() - 1))
    bits = np.zeros(width, np.uint8)
    bits[(a >> U(17)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little")


def folded(sig: np.ndarray, n_bytes: int) -> np.ndarray:
    while sig.shape[-1] > n_bytes:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


def _sets(it: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in it:
        for lo, hi in K.pieces(batch.column(text_at)):
            part = batch.slice(lo, hi - lo)
            yield part, shingles(*K.buffers(part.column(text_at)))


def _classes(it):
    """(doc_id, n, cls) for every text, and (token, df) of shingles that a run of texts shares often."""
    held, held_n, seen = [], 0, set()

    def often():
        t = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n = np.diff(np.append(at, len(t)))
        return t[at[n >= SHARED_FROM]], n[n >= SHARED_FROM]

    def row(ids, text_hash, n, cls, token, df):
        return pa.RecordBatch.from_arrays([ids, text_hash, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(token, pa.int64()), pa.array(df, pa.int64())], ["doc_id", "text_hash", "n", "cls", "token", "df"])

    def shared():
        t, n = often()
        return row(pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int64()), [None] * len(t), [None] * len(t), t.view(np.int64), n)

    for part, sets in _sets(it, 1):
        cls = [class_of(a) for a in sets]
        yield row(part.column(0).cast(pa.int64()), part.column(2), [len(a) for a in sets], cls, [None] * len(cls), [None] * len(cls))
        for c, a in zip(cls, sets, strict=True):
            if c not in seen and len(a):
                seen.add(c)
                held.append(a)
                held_n += len(a)
        if held_n >= RUN_TOKENS:
            yield shared()
            held, held_n, seen = [], 0, set()
    if held:
        yield shared()


def _prefixes(shared_tokens: np.ndarray, shared_rank: np.ndarray, hot: np.ndarray, n_tiles: int):
    """Packed lists for each tile: token, class, size of the set, place from the end. Entries of hot tokens are dealt out by class."""
    kind = np.dtype([("token", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("left", "<i4")])

    def packed(rows: list[np.ndarray]) -> pa.RecordBatch:
        r = np.concatenate(rows)
        tile = (np.where(_among(hot, r["token"]), r["cls"].view(U), r["token"]) % U(n_tiles)).astype(np.int32)
        order = np.argsort(tile, kind="stable")
        r, tile = r[order], tile[order]
        at = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(tile[at], pa.int32()), pa.array([x.tobytes() for x in np.split(r, at[1:])], pa.binary())], ["tile", "entries"])

    def run(it):
        rows, n_rows, seen = [], 0, set()
        for _, sets in _sets(it, 0):
            for a in sets:
                n = len(a)
                if not n or (c := class_of(a)) in seen:
                    continue
                seen.add(c)
                p = n - needed(n) + 1
                if len(shared_tokens):
                    at = np.minimum(np.searchsorted(shared_tokens, a), len(shared_tokens) - 1)
                    common = shared_tokens[at] == a
                    light = a[~common]
                    first = light[:p] if len(light) >= p else np.concatenate([light, a[common][np.argsort(shared_rank[at[common]], kind="stable")][: p - len(light)]])
                else:
                    first = a[:p]
                r = np.empty(len(first), kind)
                r["token"], r["cls"], r["n"], r["left"] = first, c, n, n - np.arange(len(first))
                rows.append(r)
                n_rows += len(r)
            if n_rows >= 500_000:
                yield packed(rows)
                rows, n_rows, seen = [], 0, set()
        if rows:
            yield packed(rows)

    return kind, run


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _tile(kind: np.dtype, hot: np.ndarray):
    """Of one tile: pairs of short runs and of neighbours in long ones, then the members (class, group of runs, size, lengths of its runs) of long ones."""

    def out(a, b=None, run=None, n=None, length=None):
        full = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64())
        return pa.table([full(a), full(b), full(run), full(n), full(length)], ["a", "b", "run", "n", "length"])

    def tile(table):
        r = np.frombuffer(b"".join(table.column("entries").to_pylist()), kind)
        r = r[np.lexsort((r["cls"], r["n"], r["token"]))]
        r = r[np.concatenate([[True], (r["token"][1:] != r["token"][:-1]) | (r["cls"][1:] != r["cls"][:-1])])]
        of_hot = _among(hot, r["token"])
        tables = []
        if of_hot.any():
            h = r[of_hot]
            tables.append(out(h["cls"], None, h["token"].view(np.int64), h["n"], np.full(len(h), HOT_FROM)))
            r = r[~of_hot]
        new = np.concatenate([[True], r["token"][1:] != r["token"][:-1]]) if len(r) else np.zeros(0, bool)
        run_no = np.cumsum(new) - 1
        length = np.bincount(run_no)[run_no] if len(r) else run_no
        r, run_no, length = r[length > 1], run_no[length > 1], length[length > 1]
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(1, min(SHORT_RUN, len(r))):
            ok = (run_no[k:] == run_no[:-k]) & ((length[k:] <= SHORT_RUN) | (k == 1))
            x, y = r[:-k][ok], r[k:][ok]
            ok = np.minimum(x["left"], y["left"]) >= overlap_for(x["n"].astype(np.int64), y["n"].astype(np.int64))
            pairs.append(np.stack([np.minimum(x["cls"], y["cls"])[ok], np.maximum(x["cls"], y["cls"])[ok]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        tables.append(out(pairs[:, 0], pairs[:, 1]))
        # long runs are named by their least class: those of one passage, or of one group of copies, mostly are one group then
        long, run_no, length = r[length > SHORT_RUN], run_no[length > SHORT_RUN], length[length > SHORT_RUN]
        if len(long):
            at = np.flatnonzero(np.concatenate([[True], run_no[1:] != run_no[:-1]]))
            named = np.repeat(np.minimum.reduceat(long["cls"], at), np.diff(np.append(at, len(long))))
            order = np.lexsort((long["cls"], named))
            long, named, length = long[order], named[order], length[order]
            at = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (long["cls"][1:] != long["cls"][:-1])]))
            tables.append(out(long["cls"][at], None, named[at], long["n"][at], np.add.reduceat(length, at)))
        return pa.concat_tables(tables)

    return tile


def _bounded(it):
    """Pairs whose bit counts allow a link."""
    for batch in it:
        d = batch.to_pydict()
        keep = []
        for n, m, x, y in zip(d["n_a"], d["n_b"], d["sig_a"], d["sig_b"], strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            w = min(len(x), len(y))
            differ = int(np.bitwise_count(folded(x, w) ^ folded(y, w)).sum())
            keep.append((n + m - differ) // 2 >= overlap_for(n, m))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _intersected(it):
    """Pairs that link, by intersecting sorted arrays."""
    for batch in it:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            keep.append(int((y[at] == x).sum()) >= overlap_for(len(x), len(y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _described(what: str):
    def run(it):
        for part, sets in _sets(it, 0):
            columns = {"cls": pa.array([class_of(a) for a in sets], pa.int64())}
            if what == "sig":
                signatures = [signature(a) for a in sets]
                columns |= {"n": pa.array([len(a) for a in sets], pa.int32()), "sig": pa.array([g.tobytes() for g in signatures], pa.binary())}
                columns |= {"small": pa.array([folded(g, max(64, len(g) // 4)).tobytes() for g in signatures], pa.binary())}
            else:
                columns |= {"set": pa.array([a.tobytes() for a in sets], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _of_classes(texts: DataFrame, reps: DataFrame, classes: DataFrame, what: str) -> DataFrame:
    """Signatures or sets of some classes, from one document of each."""
    ids = reps.join(classes.select("cls").distinct(), "cls").select("_rep").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    chosen = texts.join(ids, F.xxhash64("doc_id", "text_hash") == F.col("_rep"), "left_semi").select("text")
    return chosen.mapInArrow(_described(what), "cls long, n int, sig binary, small binary" if what == "sig" else "cls long, set binary").dropDuplicates(["cls"])


def _linked(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those that link. Sets are made only of the classes in them."""
    side = lambda df, x: df.select(F.col("cls").alias(x), F.col("set").alias(f"set_{x}"))
    sets = cut(_of_classes(texts, reps, pairs.select(F.explode(F.array("a", "b")).alias("cls")), "set"), "sets")
    joined = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    return cut(joined.select("a", "b", "set_a", "set_b").mapInArrow(_intersected, "a long, b long"), "links")


def _block_pairs(t: dict[str, np.ndarray], sig: list[np.ndarray], runs: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (i, j) of one block against another that the bounds allow, not connected yet, in the first run that both are in."""
    same = left is right
    widths: dict[int, list[int]] = {}
    for j in right.tolist():
        widths.setdefault(len(sig[j]), []).append(j)
    for w, idx in widths.items():
        idx = np.array(idx)
        m = np.stack([sig[j] for j in idx])
        for i in left.tolist():
            need = overlap_for(int(t["n"][i]), t["n"][idx])
            ok = (t["root"][idx] != t["root"][i]) & (np.minimum(t["n"][i], t["n"][idx]) >= need) & ~(t["guest"][i] & t["guest"][idx])
            if same:
                ok &= t["cls"][idx] > t["cls"][i]
            k = np.flatnonzero(ok)
            if not len(k):
                continue
            v = min(w, len(sig[i]))
            differ = np.bitwise_count(folded(m[k], v) ^ folded(sig[i], v)).sum(1, dtype=np.int64)
            for j in idx[k[(t["n"][i] + t["n"][idx[k]] - differ) // 2 >= need[k]]].tolist():
                if np.intersect1d(runs[i], runs[j], assume_unique=True)[0] == t["run"][i]:
                    yield i, j


def _blocks(table):
    """Candidate pairs of all block pairs in one bucket."""
    t = {c: table.column(c).to_numpy() for c in ("run", "band", "kind", "i", "j", "cls", "n", "root", "side")}
    t["guest"] = np.asarray(table.column("guest"))
    sig = [np.frombuffer(x, np.uint8) for x in table.column("sig").to_pylist()]
    runs = [np.array(x, np.int64) for x in table.column("runs").to_pylist()]
    keys = ("j", "i", "kind", "band", "run")
    order = np.lexsort([t[k] for k in keys])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= t[k][order][1:] != t[k][order][:-1]
    found = []
    for rows in np.split(order, np.flatnonzero(new)):
        left = rows[t["side"][rows] == 0]
        right = left if t["kind"][rows[0]] == 0 and t["i"][rows[0]] == t["j"][rows[0]] else rows[t["side"][rows] == 1]
        found += _block_pairs(t, sig, runs, left, right)
    f = t["cls"][np.array(found, np.int64).reshape(-1, 2)]
    return pa.table([pa.array(f.min(1), pa.int64()), pa.array(f.max(1), pa.int64())], ["a", "b"])


def _bands() -> Column:
    """A class of n shingles stands in its own size band and, as a guest, in the next one: sets that link are of the same or of neighbouring bands."""
    band = F.floor(F.log("n") / math.log(DENOMINATOR / NUMERATOR))
    return F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))


def _remaining(long_runs: DataFrame, runs: DataFrame, roots: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of long runs whose classes are not connected yet and whose bit counts allow a link.

    Groups of runs with more members than a block are split in size bands. In
    each band the component with most members is its major one, and needs no
    comparison with itself: the others are dealt out in blocks, against each
    other and against blocks of the major one."""
    spark = long_runs.sparkSession
    sizes = long_runs.groupBy("run").agg(F.count(F.lit(1)).alias("members"))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("band"), F.lit(False).alias("guest")))
    banded = long_runs.join(sizes, "run").withColumn("at", F.explode(F.when(F.col("members") > BLOCK, _bands()).otherwise(whole)))
    held = banded.select("run", "at.band", "at.guest", "cls", "n").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    per_root = held.groupBy("run", "band", "root").agg(F.count(F.lit(1)).alias("m"))
    mixed = per_root.groupBy("run", "band").agg(F.max_by("root", F.struct("m", "root")).alias("major"), F.max("m").alias("most"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    in_blocks = lambda m: F.greatest(F.lit(1), F.ceil(m / BLOCK)).cast("int")
    mixed = mixed.select("run", "band", "major", in_blocks(F.col("m") - F.col("most")).alias("minors"), in_blocks(F.col("most")).alias("majors"))
    held = held.join(mixed, ["run", "band"]).withColumn("minor", F.col("root") != F.col("major"))
    held = held.withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    own, one = F.col("own"), F.lit(1)
    with_minors = F.transform(places("minors"), lambda k: place(0, F.least(own, k), F.greatest(own, k), (own > k).cast("int")))
    with_majors = F.transform(places("majors"), lambda k: place(1, own, k, F.lit(0)))
    of_major = F.transform(places("minors"), lambda k: place(1, k, own, one))
    held = held.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(with_minors, with_majors)).otherwise(of_major)))
    held = cut(held.select("run", "band", "at.*", "cls", "n", "root", "guest"), "blocks")
    buckets = max(partitions(spark), -(-held.count() // BUCKET_ROWS))
    held = held.join(sigs.select("cls", F.col("small").alias("sig")), "cls").join(runs, "cls").withColumn("bucket", F.pmod(F.xxhash64("run", "band", "kind", "i", "j"), F.lit(buckets)))
    return held.groupBy("bucket").applyInArrow(lambda table: _blocks(table), "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, group_id) for every row of docs.

    group_id names the component also where ids are null or repeated; it is null for documents without shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))

    first = cut(texts.mapInArrow(_classes, "doc_id long, text_hash long, n long, cls long, token long, df long"), "classes")
    members = first.filter(F.col("cls").isNotNull()).select("doc_id", "text_hash", "n", "cls")
    shared = first.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(MOST_SHARED).toArrow()
    tokens = shared.column("token").to_numpy().view(U)  # at most MOST_SHARED
    hot = np.sort(tokens[shared.column("df").to_numpy() >= HOT_FROM])
    order = np.argsort(tokens)
    tokens, rank = tokens[order], np.arange(len(tokens), 0, -1)[order]

    entries = members.agg(F.sum("n")).first()[0] or 0
    n_tiles = max(2 * partitions(spark), -(-entries // TILE_SHINGLES))
    kind, prefixes = _prefixes(tokens, rank, hot, n_tiles)
    lists = texts.select("text").mapInArrow(prefixes, "tile int, entries binary")
    tiles = cut(lists.groupBy("tile").applyInArrow(_tile(kind, hot), "a long, b long, run long, n long, length long"), "tiles")
    long_runs = cut(tiles.filter("b is null").groupBy(F.col("a").alias("cls"), "run", "n").agg(F.sum("length").alias("length")), "long-runs")
    runs = cut(long_runs.groupBy("cls").agg(F.sum("length").alias("score"), F.sort_array(F.collect_list("run")).alias("runs")), "runs")

    # stars: the member that shares most, as an original does with its copies, against every other one of its band
    banded = long_runs.join(runs.select("cls", "score"), "cls").withColumn("at", F.explode(_bands())).select("run", "at.band", "cls", "n", "score")
    centre = banded.groupBy("run", "band").agg(F.max(F.struct("score", "cls", "n")).alias("c"))
    stars = banded.join(centre, ["run", "band"]).filter(f"cls <> c.cls and {DENOMINATOR} * least(n, c.n) >= {NUMERATOR} * greatest(n, c.n)")
    stars = stars.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"))
    pairs = cut(tiles.filter("b is not null").select("a", "b").unionByName(stars).distinct(), "pairs")

    # signatures of the classes that meet another one, from one document of each
    meet = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(runs.select("cls")).distinct()
    # a representative is named by the hash of its id and text, so that rows without ids have one, too
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("r")
    reps = members.filter("n > 0").groupBy("cls").agg(least_row).select("cls", F.xxhash64("r.doc_id", "r.text_hash").alias("_rep"))
    reps = cut(reps.join(meet, "cls"), "representatives")
    sigs = cut(_of_classes(texts, reps, reps, "sig"), "signatures")
    side = lambda x: sigs.select(F.col("cls").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "sig")])
    allowed = lambda pairs: cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_bounded, "a long, b long"), "allowed")
    links = _linked(allowed(pairs), texts, reps)
    roots = cut(components(links), "roots")
    more = _linked(allowed(_remaining(long_runs, runs, roots, sigs)), texts, reps)

    whole = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    # named by class first: neither a group of many classes nor a class of many copies is gathered to find its least id
    named = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(whole.withColumnRenamed("id", "cls"), "cls", "left")
    named = named.filter("rows > 1 or root is not null").withColumn("group_id", F.coalesce("root", "cls"))  # a lone row without links needs no label
    lowest = cut(named.groupBy("group_id").agg(F.min("least").alias("component_id")), "components")
    labels = cut(named.join(lowest, "group_id").select("cls", "group_id", "component_id"), "labels")
    rows, on = members.filter("n > 0"), ["cls"]
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    else:  # the rows of one text are dealt out over SALTS tasks
        rows, on = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), ["cls", "salt"]
        labels = labels.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rows = rows.join(labels, on, "left")
    rows = rows.withColumn("component_id", F.when(F.col("group_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).withColumn("group_id", F.coalesce("group_id", "cls"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "group_id"]
    alone = members.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("group_id", F.lit(None).cast("long"))
    return rows.select(*columns).unionByName(alone.select(*columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id
"""
