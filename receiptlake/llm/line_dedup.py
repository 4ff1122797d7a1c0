"""Line deduplication over levelled sorted runs of line hashes.

A store keeps runs of line keys, bucketed and sorted by hash, so that runs are
merged without a shuffle. Each batch of documents merge-anti-joins the runs:
keys that none of them holds become a run of their own on level 0, so that a
key stands in one run only; what the batch adds to known keys is logged as
increments. When a level holds ``fanout`` runs they are compacted into one run
of the next level. A key's documents are its run's plus its increments. The
number of batches follows the size of the texts. DataFrame operations only.

Defined results: a null or empty text is one empty line; rows of one id are one
document when documents are counted, and rows without an id are one if their
texts are equal; every row is rewritten for itself; other columns pass through
``drop_common_lines`` unchanged, but for those named like a new one, which are
replaced. Keys are compared by 96 bits of hash (xxhash64 and murmur3).
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE_CHARS, ascii_lower, cut, keyed, partitions, scratch

MIN_CODE_POINTS, MIN_DOCUMENTS, FANOUT = 1, 10, 4
#: Text of a batch at most, and the least number of batches: enough to fill a level and go on.
BATCH_BYTES, BATCHES = 16 << 30, FANOUT + 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def document_keys(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(id, doc, text_hash, h1, h2): the distinct keys of each row of ``keyed`` documents. The text is lower-cased once, before it is split."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines_of(ascii_lower(F.col("text"))), key_of), lambda k: F.char_length(k) >= min_code_points), _hashes))
    return docs.select("id", "doc", "text_hash", F.explode(keys).alias("k")).select("id", "doc", "text_hash", "k.h1", "k.h2")


class LineRuns:
    """Levelled runs of (h1, h2, n_docs) under one folder that all executors share; every key stands in one run."""

    SCHEMA = "h1 long, h2 int, n_docs long"

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = folder or f"{scratch(spark)}/{self.name}"
        self.levels: list[list[DataFrame]] = [[]]
        self.increments: list[DataFrame] = []
        self.written = self.compactions = 0

    def _write(self, counts: DataFrame) -> DataFrame:
        """A bucketed and sorted table; only its files are kept, not its name in the catalog."""
        self.written += 1
        name = f"{self.name}_{self.written}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{self.written}").option("compression", "zstd").saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Take the names of all tables out of the catalog. What was read from them stays valid."""
        for k in range(1, self.written + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds: merge joins over equal buckets."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch of (doc, h1, h2) rows, none of whose documents is in another batch, then compact full levels."""
        batch = keys.select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
        if self.runs():
            batch = self._write(batch)
            fresh = self._write(self.unseen(batch))
            self.increments.append(batch.join(fresh.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"))
        else:
            fresh = self._write(batch)
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            # runs have equal buckets, and so has their union: it is grouped bucket by bucket, without a shuffle
            merged = functools.reduce(DataFrame.unionByName, self.levels[level]).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            self.compactions += 1
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            self.levels[level] = []
            level += 1

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs and increments."""
        parts = self.runs() + self.increments
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return functools.reduce(DataFrame.unionByName, parts).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_code_points: int = MIN_CODE_POINTS, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES, fanout: int = FANOUT, keep_first: bool = False) -> DataFrame:
    """docs with ``_kept`` (the text without common lines), ``_n_lines`` and ``_n_dropped``.

    A key found in min_documents documents or more loses all its lines; with
    keep_first, but for those in the document with the smallest id that holds
    it. The text is scanned for its keys and to be rewritten; only documents
    that hold a common line are split the second time."""
    spark = docs.sparkSession
    d = keyed(docs, id_column, text_column)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(BATCHES, -(-size // batch_bytes))
    keys = cut(document_keys(d, min_code_points).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")), "line-keys", ["batch"])
    runs = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b))
    common = cut(runs.counts().filter(F.col("n_docs") >= min_documents).select("h1", "h2"), "common-lines")
    runs.close()
    hits = keys.join(common, ["h1", "h2"], "left_semi")
    if keep_first:
        first = hits.groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "doc")).alias("first"))
        hits = hits.join(first, ["h1", "h2"]).filter("doc <> first.doc")
    hits = hits.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("common"))
    joined = d.join(hits, ["doc", "text_hash"], "left").withColumn("lines", lines_of(F.col("text")))
    is_common = lambda line: F.array_contains(F.col("common"), _hashes(ascii_lower(key_of(line))))
    joined = joined.withColumn("left", F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~is_common(x))))
    new = {"_kept": F.array_join("left", "\n"), "_n_lines": F.size("lines").cast("long"), "_n_dropped": (F.size("lines") - F.size("left")).cast("long")}
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[c.alias(name) for name, c in new.items()])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_common_lines(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
h AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, h.k IS NOT NULL AS dropped FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
