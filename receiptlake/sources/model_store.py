"""The correction model as keyed, versioned tables: an upsert rewrites the buckets of its keys and nothing else.

Layout, under one path: ``batch=N/{entries,corrections,segments}/bucket=K`` holds
what version N wrote, ``batch=N/manifest`` says for every bucket which version
holds it now, and ``batch=N/done`` is written last, so a version is there as a
whole or not at all. A version that was interrupted is overwritten when it runs
again. What no version but the last two needs is removed after the commit, so
that readers of the version before are not disturbed.
"""

from __future__ import annotations

import functools

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("entries", "corrections", "segments")
BUCKETS = 64


def bucket_of(field: Column, raw: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(field, raw), F.lit(buckets)).cast("int")


def _missing(read):
    """What read() returns, or None where the path is not there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def written(spark: SparkSession, path: str, number: int) -> bool:
    """Whether version ``number`` is committed."""
    return bool(_missing(lambda: spark.read.schema("batch long").parquet(f"{path}/batch={number}/done").count()))


def latest(spark: SparkSession, path: str) -> int | None:
    """The last committed version."""
    done = _missing(lambda: spark.read.schema("version long").parquet(f"{path}/batch=*/done").agg(F.max("version")).first())
    return done[0] if done else None


def manifest(spark: SparkSession, path: str, number: int | None) -> dict[int, int]:
    """Bucket -> version that holds it, at most one entry for each bucket."""
    if number is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{path}/batch={number}/manifest").collect()}


def read_tables(spark: SparkSession, path: str, of: dict[int, int], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The three tables of the buckets in ``of``: of each version the folders of its buckets, and no others."""
    by_version: dict[int, list[int]] = {}
    for bucket, version in of.items():
        by_version.setdefault(version, []).append(bucket)
    out = {}
    for name in TABLES:
        read = lambda v, name=name: spark.read.schema(f"{schemas[name]}, bucket int").parquet(f"{path}/batch={v}/{name}")
        parts = [read(v).filter(F.col("bucket").isin(buckets)).drop("bucket") for v, buckets in by_version.items()]
        out[name] = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas[name])
    return out


def upsert(spark: SparkSession, path: str, number: int, tables: dict[str, DataFrame], touched: list[int], before: dict[int, int], buckets: int = BUCKETS) -> None:
    """Write the touched buckets' tables as version ``number``, name them in its manifest, and commit."""
    at = f"{path}/batch={number}"
    for name in TABLES:
        df = tables[name].withColumn("bucket", bucket_of(F.col("field"), F.col("raw"), buckets))
        df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/{name}")
    now = before | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifest")
    spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{at}/done")


def remove_superseded(spark: SparkSession, path: str, number: int) -> None:
    """Take away the buckets that version number - 2 still needed and number - 1 no longer does."""
    if number < 2:
        return
    old, kept = manifest(spark, path, number - 2), manifest(spark, path, number - 1)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for bucket, version in old.items():
        if kept.get(bucket) != version:
            for name in TABLES:
                p = hadoop(f"{path}/batch={version}/{name}/bucket={bucket}")
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
