"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

1. quality classifier: documents outside their language's perplexity bounds go; every trusted document is counted by the model and sets the bounds;
2. line dedup: lines that ten documents or more hold stay in the one with the smallest id only; texts left without words go;
3. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays, without an id only if none has one;
4. mixing: every document is repeated as often as its source's target asks, or left out;
5. packing: the rest becomes sequences of token ids, one row for each piece.

All stages but the last return the columns of documents, whatever their names;
n_chars follows the text. Rows that are equal in id and text are one document in stage 3 and as many
as they are elsewhere; rows without an id are told apart by their texts. Stages with random or learned parts can't be told in SQL; tests compare
the pipeline with a plain version instead.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receiptlake.llm import jaccard_join, line_dedup, mixing, packing, quality_lm
from receiptlake.llm.shared import SPACE, cut

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs with columns c0, c1, ..., which clash with none that an operator adds; their new names; and how to get the old ones back."""
    new = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new, [F.col(n).alias(c) for c, n in new.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, new, back = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_lm.judge(d, labels, new["doc_id"], new["text"], new["lang"], whole=True).filter("_kept").select(*back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    d, new, back = _numbered(docs)
    out = line_dedup.drop_common_lines(d, keep_first=True, id_column=new["doc_id"], text_column=new["text"])
    out = out.filter(F.col("_kept").rlike(f"[^{SPACE}]")).withColumn(new["text"], F.col("_kept")).withColumn(new["n_chars"], F.char_length("_kept").cast("long"))
    return out.select(*back)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_duplicate_groups(docs)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    stays = groups.filter("group_id is not null").groupBy("group_id").agg(F.min(key).alias("k")).select("k.doc_id", "k.text_hash")
    stays = stays.unionByName(groups.filter("group_id is null").select("doc_id", "text_hash").distinct()).toDF("_id", "_hash")
    d, new, back = _numbered(docs)
    named = d.withColumn("_text", F.xxhash64(new["text"]))
    out = named.join(stays, named[new["doc_id"]].eqNullSafe(stays["_id"]) & (named["_text"] == stays["_hash"]), "left_semi")
    return out.dropDuplicates([new["doc_id"], "_text"]).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_file)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return functools.reduce(lambda d, stage: cut(stage[1](spark, d, sf_dir), "stage"), STAGES, docs)
