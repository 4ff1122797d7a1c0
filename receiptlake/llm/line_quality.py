"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base figures come from one document's text alone. The method's verdict adds:
lines are normalised (white space joined, letters lower-cased, digits as 0) and
hashed; a host's distinct documents that hold a line are counted; lines above
the host's limit are removed; a document left with few words, and with less
than half of its words, is rejected.

Defined results: a null or empty text has no words and fails the base rules; a
null host is a host of its own; rows of one id are one document when documents
are counted, rows without an id if their texts are equal; repeated rows get the
same figures; other columns are ignored. Lines are compared by 64-bit hashes, word windows by
64-bit hashes inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, cut, keyed

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LIMIT_SHARE, LIMIT_LEAST, KEEP_SHARE = 0.02, 10, 0.5
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _shifted(array: Column, by: int, size: Column) -> Column:
    """``size`` elements from position ``by`` (0-based) on."""
    return F.slice(array, by + 1, F.greatest(size, F.lit(0)))


def base_figures(docs: DataFrame, keep: list[str], text_column: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The columns to keep, the base figures and base_failed: projections without a shuffle.

    Words in three-word windows that occur twice: windows are hashed; only
    where two are equal are they sorted with their positions. Each step is a
    column of its own, as a lambda that refers to an outer expression evaluates it
    again for every element."""
    text = F.coalesce(docs[text_column], F.lit(""))
    d = docs.select(*keep, text.alias("_t"), words_of(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = (F.col("n_words") - 2).cast("int")
    zipped = F.arrays_zip(*[_shifted(F.col("_h"), k, n).alias(f"w{k}") for k in range(3)])
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    d = d.withColumn("_g", F.transform(zipped, lambda x: F.xxhash64(x["w0"], x["w1"], x["w2"]))).drop("_h")
    d = d.withColumn("_any", F.size(F.array_distinct("_g")) < F.size("_g"))
    empty = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("_p", F.when(F.col("_any"), F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).otherwise(empty)).drop("_g", "_any")
    m = F.size("_p") - 1
    none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
    near = F.arrays_zip(F.col("_p").alias("x"), F.concat(none, _shifted(F.col("_p"), 0, m)).alias("a"), F.concat(_shifted(F.col("_p"), 1, m), none).alias("b"))
    twice = F.filter(near, lambda z: z["x"].isNotNull() & (z["x"]["h"].eqNullSafe(z["a"]["h"]) | z["x"]["h"].eqNullSafe(z["b"]["h"])))
    d = d.withColumn("_q", F.sort_array(F.transform(twice, lambda z: z["x"]["p"]))).drop("_p")
    m = F.size("_q") - 1
    gaps = F.zip_with(_shifted(F.col("_q"), 0, m), _shifted(F.col("_q"), 1, m), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(m >= 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    d = d.withColumn("n_repeat_words", covered.cast("long")).drop("_q")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return d.select(*keep, *FIGURES, failed.alias("base_failed"))


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, f"[{SPACE}]+", " "), "[0-9]", "0")))


def depleted(d: DataFrame, limit_share: float = LIMIT_SHARE, limit_least: int = LIMIT_LEAST) -> DataFrame:
    """(doc, text_hash, host, gone): the words in lines that too many documents of a host hold, for rows of ``keyed`` documents with a host."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    lines = F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("n")))
    rows = cut(d.select("doc", "text_hash", "host", F.posexplode(lines).alias("place", "l")).select("doc", "text_hash", "host", "place", "l.h", "l.n"), "lines")
    per_host = d.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = rows.select("host", "h", "doc").distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > limit_least)
    frequent = counts.join(per_host, counts["host"].eqNullSafe(per_host["host"])).filter(F.col("seen") > limit_share * F.col("docs")).select(counts["host"].alias("at"), F.col("h").alias("line"))
    hits = rows.join(frequent, rows["host"].eqNullSafe(frequent["at"]) & (rows["h"] == frequent["line"])).select("doc", "text_hash", "host", "place", "n")
    # equal rows hold the same lines at the same places: they count once
    return hits.distinct().groupBy("doc", "text_hash", "host").agg(F.sum("n").alias("gone"))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", keep_share: float = KEEP_SHARE, min_words: int = MIN_WORDS, **limits) -> DataFrame:
    """The id, the base figures, n_words_left and kept for every row of docs."""
    d = keyed(docs, id_column, text_column, docs[host_column].alias("host"))
    base = base_figures(d, ["id", "doc", "text_hash", "host"], "text", min_words)
    gone = depleted(d, **limits).select(F.col("doc").alias("d"), F.col("text_hash").alias("t"), F.col("host").alias("at"), "gone")
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    out = base.join(gone, (base["doc"] == gone["d"]) & (base["text_hash"] == gone["t"]) & base["host"].eqNullSafe(gone["at"]), "left")
    verdict = (left >= min_words) | (left >= keep_share * F.col("n_words"))
    return out.select(F.col("id").alias(id_column), *FIGURES, "base_failed", left.alias("n_words_left"), (~F.col("base_failed") & verdict).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), 't' || hash(coalesce(text, ''))) AS doc FROM documents),
w AS (SELECT rn, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
ln AS (SELECT rn, doc, source, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
        lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))) AS k
      FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rn, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY rn),
win AS (SELECT rn, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rn, i FROM win QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
cov AS (SELECT rn, count(DISTINCT j) AS n_repeat_words FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rn),
base AS (
  SELECT w.rn, w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (rn) LEFT JOIN cov USING (rn)),
hosts AS (SELECT source, count(DISTINCT doc) AS n_docs FROM d GROUP BY source),
freq AS (SELECT l.source, k FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source GROUP BY l.source, k, n_docs
         HAVING count(DISTINCT doc) > 10 AND count(DISTINCT doc) > 0.02 * n_docs),
gone AS (SELECT rn, sum(n) AS gone FROM l JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND l.k = freq.k GROUP BY rn),
f AS (SELECT base.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             n_words - coalesce(gone, 0) AS left_over FROM base LEFT JOIN gone USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(left_over AS BIGINT) AS n_words_left,
       (NOT base_failed AND (left_over >= 50 OR left_over >= 0.5 * n_words)) AS kept FROM f
"""
