"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters between words, for character classes of regular expressions.
SPACE = r"\x20\x09-\x0D"
#: The same six as characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"
_OWN: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only a local session may do without; it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return at.rstrip("/")


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs at most a reread of these files."""
    at = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs: it does so once the driver has collected their plans as garbage, which takes two rounds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else.

    lower() does just that unless a character outside ASCII has a lower case of its own, which the class tests for."""
    odd = c.rlike(r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Mn}]]")
    return F.when((F.octet_length(c) == F.char_length(c)) | ~odd, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keyed(docs: DataFrame, id_column: str, text_column: str, *others: Column) -> DataFrame:
    """(row, id, text, text_hash, doc, *others): every row of docs as a struct, with the keys of a document.

    ``doc`` names the document: rows of one id are one, rows without an id are one if their texts are equal.
    (doc, text_hash) names a row but for equal ones, in any order and partitioning, so that results can be joined back."""
    row = F.struct(*[docs[c] for c in docs.columns])
    d = docs.select(row.alias("row"), docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"), *others)
    d = d.withColumn("text_hash", F.xxhash64("text"))
    return d.withColumn("doc", F.when(F.col("id").isNull(), F.col("text_hash")).otherwise(F.xxhash64("id")))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column], F.lit(""))
