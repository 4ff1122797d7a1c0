"""Reading and writing receipts, templates, feedback, models and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
FEEDBACK_COLUMNS = ["id_unico_imagen", "campo_nombre", "raw_ocr_output", "valor_corregido", "causa_raiz", "timestamp_feedback"]
#: Missing values are told from empty ones, which are quoted.
CSV = {"header": True, "nullValue": "<NA>"}
FEEDBACK_SCHEMA = StructType([StructField(c, StringType()) for c in FEEDBACK_COLUMNS])
FEEDBACK_DDL = ", ".join(f"{c} string" for c in FEEDBACK_COLUMNS)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; without spark.checkpoint.dir only a local session has one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, however often it is read."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def supported(manifest: DataFrame) -> DataFrame:
    """Rows of (path, ...) whose suffix is an image's, with the stem."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return manifest.filter(F.lower(F.regexp_extract("path", r"\.[^.]+$", 0)).isin(SUFFIXES)).withColumn("stem", F.regexp_replace(name, r"\.[^.]+$", ""))


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Images under a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return supported(files.select("path", "modificationTime", "length"))


TEMPLATE_SCHEMA = (
    "template string, anchors array<string>, regions array<struct<name:string,left_rel:double,top_rel:double,width_rel:double,height_rel:double>>, "
    "fields array<struct<field:string,left:int,top:int,width:int,height:int,psm_mode:string,regexes:array<string>,keywords:array<string>,direction:string>>, error string"
)


def parse_templates(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(anchors, regions, fields, skipped) from (template, text) with YAML texts, parsed where they lie."""
    import yaml

    def parse(it):
        for pdf in it:
            rows = []
            for name, text in zip(pdf["template"], pdf["text"], strict=True):
                try:
                    t = yaml.safe_load(text)
                    anchors = [str(a) for a in t.get("huella_texto_clave") or []]
                    regions = [(str(r["nombre"]), float(r["left_rel"]), float(r["top_rel"]), float(r["width_rel"]), float(r["height_rel"])) for r in (t.get("esqueleto_estructural") or {}).get("regiones_esperadas") or []]
                    fields = [(str(f), int(c.get("left", 0)), int(c.get("top", 0)), int(c.get("width", 0)), int(c.get("height", 0)), str(c.get("psm_mode", "7")), [str(x) for x in c.get("regex_validacion") or []], [str(x) for x in c.get("palabras_clave_cercanas") or []], c.get("orientacion_ajuste_dinamico")) for f, c in (t.get("campos") or {}).items()]
                    rows.append((name, anchors, regions, fields, None))
                except Exception as bad:  # a bad file is skipped, and told
                    rows.append((name, [], [], [], str(bad)[:200]))
            yield type(pdf)(rows, columns=["template", "anchors", "regions", "fields", "error"])

    t = staged(texts.select("template", "text").mapInPandas(parse, TEMPLATE_SCHEMA), "templates")  # parsed once for the four tables
    good = t.filter("error is null")
    return good.select("template", F.explode("anchors").alias("anchor")), good.select("template", F.inline("regions")), good.select("template", F.inline("fields")), t.filter("error is not null").select("template", "error")


def load_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """S3: the templates in the YAML files of a folder, named by their stems."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").load(path)
    return parse_templates(files.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("template"), F.decode("content", "utf-8").alias("text")))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a missing path gives no rows."""
    try:
        return spark.read.schema(FEEDBACK_SCHEMA).options(**CSV).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FEEDBACK_SCHEMA)


def append_feedback(df: DataFrame, path: str) -> None:
    """Rows stamped with the time, added as new files."""
    stamped = df.withColumn("timestamp_feedback", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped.select(*FEEDBACK_COLUMNS).write.mode("append").options(**CSV).csv(path)


def write_model(model: tuple[DataFrame, DataFrame], path: str) -> None:
    """The long tables as Parquet."""
    for name, df in zip(("entries", "corrections"), model, strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/corrections")


def model_json(model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The nested JSON form: one row (field, json) for each field, keyed by raw text."""
    entries, corrections = model
    causes = corrections.groupBy("field", "raw", "correction").agg(F.sum("count").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("cause", "count")))).alias("causas"))
    per_raw = causes.groupBy("field", "raw").agg(F.map_from_entries(F.collect_list(F.struct("correction", F.struct("count", "causas")))).alias("corrections"))
    out = entries.join(per_raw, ["field", "raw"], "left")
    value = F.struct("corrections", F.col("total").alias("total_correcciones"), "last_updated", F.col("adjustment").alias("confidence_adjustment"))
    return out.groupBy("field").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("raw", value)))).alias("json"))


MODEL_JSON = "map<string,struct<corrections:map<string,struct<count:bigint,causas:map<string,bigint>>>,total_correcciones:bigint,last_updated:timestamp,confidence_adjustment:double>>"


def model_from_json(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, corrections) from (field, json); when a correction was first seen is not kept in JSON."""
    rows = nested.select("field", F.explode(F.from_json("json", MODEL_JSON)).alias("raw", "e"))
    entries = rows.select("field", "raw", F.col("e.total_correcciones").alias("total"), F.col("e.last_updated").alias("last_updated"), F.col("e.confidence_adjustment").alias("adjustment"))
    rows = rows.select("field", "raw", F.explode("e.corrections").alias("correction", "c")).select("field", "raw", "correction", F.explode("c.causas").alias("cause", "count"))
    return entries, rows.withColumn("first_seen", F.lit(None).cast("string"))


def named_results(results: DataFrame) -> DataFrame:
    """Results with the record name ``timestamp-stem`` and their date."""
    return results.withColumn("record", F.concat_ws("-", F.date_format("processed_at", "yyyyMMdd-HHmmss"), "stem")).withColumn("processing_date", F.to_date("processed_at"))


def commit_json(df: DataFrame, path: str, run: str, partition_by: list[str] | None = None) -> None:
    """df as JSON lines under a run of its own; the run counts from the moment its mark is written, which is last.

    A run that is repeated, whether it was interrupted or only retried, replaces what it has written."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(f"{path}/data/run={run}")
    df.sparkSession.range(1).select(F.lit(run).alias("name")).write.mode("overwrite").json(f"{path}/commits/run={run}")


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed runs, with ``run``; what other runs have left there is not read."""
    try:
        runs = [r["name"] for r in spark.read.schema("name string").json(f"{path}/commits").select("name").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        runs = []
    if not runs:
        return spark.createDataFrame([], f"{schema}, run string")
    return spark.read.schema(f"{schema}, run string").option("basePath", f"{path}/data").json([f"{path}/data/run={r}" for r in runs])


def write_results(results: DataFrame, path: str, run: str) -> None:
    """Few JSON files by date, one document for each line; a repeated run leaves each result once."""
    commit_json(named_results(results), path, run, ["processing_date"])


def archive_feedback(df: DataFrame, path: str, stamp: str, partition_by: list[str] | None = None) -> None:
    """Processed feedback under its stamp; archiving one stamp again replaces it."""
    w = df.write.mode("overwrite").options(**CSV)
    (w.partitionBy(*partition_by) if partition_by else w).csv(f"{path}/archived_at={stamp}")


def write_report(report: DataFrame, path: str, run: str) -> None:
    """A run's report as one JSON line."""
    commit_json(report.coalesce(1), path, run)


def retraining_report(stats: DataFrame, top: DataFrame, entries: DataFrame) -> DataFrame:
    """One row; stats from processing_stats, top from top_problem."""
    s = stats.agg(F.max(F.when(F.col("kind") == "all", F.col("n"))).alias("total_processed"), F.max(F.when(F.col("kind") == "adjustments", F.col("n"))).alias("adjustments"))
    t = top.agg(F.max(F.when(F.col("kind") == "field", F.col("key"))).alias("top_field"), F.max(F.when(F.col("kind") == "cause", F.col("key"))).alias("top_cause"))
    return s.crossJoin(t).crossJoin(entries.agg(F.countDistinct("field").alias("model_size")))
