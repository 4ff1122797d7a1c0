"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; each of its documents starts with
the same, fractional number of copies. The whole part is taken as it is. For
the fraction, two documents at a time exchange words until one of them has a
whole number of copies, at random with the chances that keep every document's
expected copies; the words of the pair stay the same. A block of documents
leaves one undecided document at most, and blocks' undecided documents are
combined in further rounds, FAN blocks into one, until a source has one left.
The last one takes the nearer whole number, so a source's words differ from
its target by half of one document's size at most. Rows with equal source, id
and text are one unit: its whole copies are spread over them, and the rest is
the fraction of one of them.

Defined results: null texts have size 0; a null source is a source of its own,
ordered last; all randomness is hashed from ids and texts, so reruns agree,
whatever the partitions; null ids are drawn by their texts; repeated rows are
documents of their own, none of which is taken more than the limit; other
columns are ignored.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, keyed

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
BLOCK, FAN = 8192, 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    Targets are one level times the weight, up to ``most`` times the source's
    size; the level follows from the sources in the order in which they reach
    that bound. The windows run over one row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    by_reach = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    after = by_reach.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    # the level of the first source that doesn't reach its bound; none is left over if all reach it
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(everything)
    per = per.withColumn("free", free["level"])
    return per.select("source", "source_size", "n_docs", F.least("bound", F.coalesce(F.col("free") * F.col("weight"), F.col("bound"))).alias("target"))


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide all documents of a block but one, in the order of their hashes."""
    pdf = pdf.sort_values(["draw", "text_hash", "size"], kind="stable").reset_index(drop=True)
    p, size, draw = pdf["part"].to_numpy(copy=True), pdf["size"].to_numpy(float), pdf["draw"].to_numpy(float)
    u = (draw + 2.0**63) / 2.0**64
    # a second, independent looking draw: the order above already uses the first
    u = (u * 1e6) % 1.0
    held = -1
    for k in range(len(p)):
        if size[k] == 0 or not 0.0 < p[k] < 1.0:
            if size[k] == 0:
                p[k] = 0.0
            continue
        if held < 0:
            held = k
            continue
        i, j = held, k
        up, down = min(size[i] * (1 - p[i]), size[j] * p[j]), min(size[i] * p[i], size[j] * (1 - p[j]))
        move = up if u[k] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / size[i], p[j] - move / size[j]
        p[i], p[j] = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (p[i], p[j]))
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    pdf["part"] = p
    return pdf


def units(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 7, **how) -> DataFrame:
    """(doc_id, doc, text_hash, source, size, n_rows, source_size, target, copies) for every unit of equal rows; copies of all of them together."""
    d = keyed(docs, id_column, text_column, docs[source_column].alias("source"))
    size = F.regexp_count("text", F.lit(f"[^{SPACE}]+")).cast("long")
    sizes = cut(d.groupBy(F.col("id").cast("long").alias("doc_id"), "doc", "text_hash", "source", size.alias("size")).agg(F.count(F.lit(1)).alias("n_rows")), "sizes")
    per = cut(targets(sizes.select("source", (F.col("size") * F.col("n_rows")).alias("size")), **how), "targets")
    joined = sizes.join(per.withColumnRenamed("source", "of"), sizes["source"].eqNullSafe(F.col("of")))
    copies = F.col("n_rows") * F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    schema = "doc_id long, doc long, text_hash long, source string, size long, n_rows long, source_size long, target double, whole long, part double, draw long, block long"
    rows = joined.select(
        "doc_id", "doc", "text_hash", "source", "size", "n_rows", "source_size", F.col("target").cast("double").alias("target"), F.floor(copies).alias("whole"),
        (copies - F.floor(copies)).alias("part"), F.xxhash64(F.lit(seed), "doc", "text_hash").alias("draw"), F.pmod(F.xxhash64("doc", "text_hash", F.lit(seed)), F.ceil(F.col("n_docs") / BLOCK)).alias("block"),
    )
    blocks = -(-(per.agg(F.max("n_docs")).first()[0] or 0) // BLOCK)
    decided, undecided = [], (F.col("part") > 0) & (F.col("part") < 1)
    while True:
        rows = cut(rows.groupBy("source", "block").applyInPandas(_round, schema), "rounded")
        decided.append(rows.filter(~undecided))
        rows = rows.filter(undecided).withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN)
    # one unit of a source at most: its nearer whole number keeps the source within half of that document's size
    last = rows.withColumn("part", (F.col("part") >= 0.5).cast("double"))
    out = functools.reduce(DataFrame.unionByName, decided, last)
    return out.select("doc_id", "doc", "text_hash", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.round("part").cast("long")).alias("copies"))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", seed: int = 7, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs; copies is 0, 1 or 2 with the defaults."""
    u = units(docs, id_column, source_column, text_column, seed, **how)
    u = u.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    share = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("row") < F.col("copies") % F.col("n_rows")).cast("long")
    return u.select("doc_id", "source", "size", "source_size", "target", share.cast("int").alias("copies"))


def repeated(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    u = units(docs, id_column, source_column, text_column, **how).filter("copies > 0")
    u = u.select(F.col("doc").alias("d"), F.col("text_hash").alias("t"), F.col("source").alias("of"), "n_rows", "copies")
    d = keyed(docs, id_column, text_column, docs[source_column].alias("source"))
    found = d.join(u, (d["doc"] == u["d"]) & (d["text_hash"] == u["t"]) & d["source"].eqNullSafe(u["of"]))
    # of equal rows one stands for all; rows are equal in what names them, other columns are those of any of them
    found = found.filter("n_rows = 1").unionByName(found.filter("n_rows > 1").dropDuplicates(["doc", "text_hash", "source"]))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
