"""Incremental jobs: the model from new feedback, recent corrections, and extraction of arriving receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, learning
from ..sources import io, model_store

WIDE_SCHEMA = "image_id string, text array<string>, `left` array<int>, top array<int>, width array<int>, height array<int>, conf array<double>"
#: The order in which a key's feedback is folded: by time, then by all columns.
_ORDER = ", ".join(f"{c}:{'timestamp' if c == 'timestamp_feedback' else 'string'}" for c in learning.order_columns(None))
MODEL_SCHEMAS = {
    "entries": "field string, raw string, total long, last_updated timestamp, adjustment double",
    "corrections": f"field string, raw string, correction string, cause string, count long, first_seen struct<{_ORDER}>",
    "segments": "field string, raw string, day date, n long, s double",
}


def _timed(feedback: DataFrame) -> DataFrame:
    return feedback.withColumn("timestamp_feedback", F.to_timestamp("timestamp_feedback"))


def _merged(spark: SparkSession, feedback: DataFrame, archive_path: str, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of the touched buckets after this feedback.

    Totals and corrections add up. A day of a key that got rows is folded anew from
    the archive, which has them all, so a late row takes its place among that
    day's; the key's other days stay as segments."""
    key = ["field", "raw"]
    totals, corrections = learning.merge_counts((old["entries"], old["corrections"]), learning.count_corrections(feedback, None))
    days = feedback.select(F.col("campo_nombre").alias("field"), F.col("raw_ocr_output").alias("raw"), F.to_date("timestamp_feedback").alias("day")).filter("field is not null and raw is not null").distinct()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count_if(F.col("day").isNull()).alias("timeless")).first()
    archived = spark.read.schema(f"{io.FEEDBACK_DDL}, archived_at string, day date").options(**io.CSV).csv(archive_path)
    inside = F.col("day").between(F.lit(span["lo"]), F.lit(span["hi"]))
    archived = archived.filter(inside | F.col("day").isNull() if span["timeless"] else inside)  # whole folders of other days are left out
    d = days.toDF("_field", "_raw", "_day")
    again = archived.join(d, (archived["campo_nombre"] == d["_field"]) & (archived["raw_ocr_output"] == d["_raw"]) & archived["day"].eqNullSafe(d["_day"]), "left_semi")
    rest = old["segments"].alias("o").join(days.alias("n"), F.expr("o.field = n.field and o.raw = n.raw and o.day <=> n.day"), "left_anti")
    segments = io.staged(rest.unionByName(learning.fold_segments(_timed(again.drop("day")), None)), "segments")
    entries = totals.join(learning.combine_segments(segments).drop("n"), key, "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0)))
    return {"entries": entries, "corrections": corrections, "segments": segments}


def retrain_stream(spark: SparkSession, feedback_path: str, model_path: str, archive_path: str, checkpoint: str, buckets: int = model_store.BUCKETS) -> StreamingQuery:
    """ST1: every feedback file once, archived and merged into the model.

    Each batch writes its archive, then the buckets of the model that its keys fall
    in, then the manifest and a mark. A batch that runs again after a failure
    overwrites what it has written; one whose mark is there leaves all as it is, so
    feedback is never counted twice and never missing from the archive. Without the
    model of the batch before, a batch fails instead of starting from nothing. Rows
    that come late are folded in their place."""

    def merge(batch: DataFrame, number: int) -> None:
        if model_store.written(spark, model_path, number):
            return
        if number and not model_store.written(spark, model_path, number - 1):
            raise FileNotFoundError(f"the model of batch {number - 1} is missing in {model_path}")
        before = model_store.manifest(spark, model_path, number - 1 if number else None)
        f = _timed(batch).persist()
        io.archive_feedback(batch.withColumn("day", F.to_date(F.to_timestamp("timestamp_feedback"))), archive_path, f"batch-{number}", ["day"])
        keyed = f.filter("campo_nombre is not null and raw_ocr_output is not null")
        touched = [r[0] for r in keyed.select(model_store.bucket_of(F.col("campo_nombre"), F.col("raw_ocr_output"), buckets)).distinct().collect()]
        old = model_store.read_tables(spark, model_path, {b: v for b, v in before.items() if b in touched}, MODEL_SCHEMAS)
        model_store.upsert(spark, model_path, number, _merged(spark, f, archive_path, old), touched, before, buckets)
        model_store.remove_superseded(spark, model_path, number)
        f.unpersist()

    rows = spark.readStream.schema(io.FEEDBACK_SCHEMA).options(**io.CSV).csv(feedback_path)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_model(spark: SparkSession, model_path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, corrections) of the last committed version."""
    t = model_store.read_tables(spark, model_path, model_store.manifest(spark, model_path, model_store.latest(spark, model_path)), MODEL_SCHEMAS)
    return t["entries"], t["corrections"]


def recent_corrections(feedback: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """ST2: corrections in sliding windows of some days, a day apart; for streams and tables."""
    f = feedback.withWatermark("timestamp_feedback", delay) if feedback.isStreaming else feedback
    w = F.window("timestamp_feedback", f"{days} days", "1 day")
    return f.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("corrections")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "corrections")


def recent_corrections_stream(spark: SparkSession, feedback_path: str, out_path: str, checkpoint: str, days: int = 7, delay: str = "1 day") -> StreamingQuery:
    """ST2 as a stream: a window's count is appended once, when the watermark has passed its end.

    Rows behind the watermark are dropped, as no window waits for them. State lives
    in the checkpoint, and the sink names the files of each batch in its own log, so
    that a restart neither loses nor repeats a window."""
    rows = _timed(spark.readStream.schema(io.FEEDBACK_SCHEMA).options(**io.CSV).csv(feedback_path))
    return recent_corrections(rows, days, delay).writeStream.format("parquet").outputMode("append").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _new_files(spark: SparkSession, path: str, max_age: str) -> DataFrame:
    """Files as they come, from the source's own log of them. What is older than the newest file seen by more than max_age is taken as
    seen, which bounds what the driver has to remember; their content is not read unless it is asked for."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("recursiveFileLookup", "true").option("maxFileAge", max_age).load(path).select("path", "modificationTime", "length")


def manifest_stream(spark: SparkSession, path: str, max_age: str = "30d") -> DataFrame:
    """S1 as a stream: images that have come since the last run."""
    return io.supported(_new_files(spark, path, max_age))


def latest_results_stream(spark: SparkSession, path: str, out_path: str, checkpoint: str, max_age: str = "30d") -> StreamingQuery:
    """W10 as a stream over result files: a run reads new files only, and writes the stems whose last result has changed.

    The state keeps the last result of each stem; a batch that runs again replaces what it has written."""
    named = _new_files(spark, path, max_age).select("path", "modificationTime", F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]+$", "").alias("stem"))
    last = named.groupBy("stem").agg(F.max(F.struct("modificationTime", "path")).alias("r")).select("stem", "r.modificationTime", "r.path")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return last.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_results(spark: SparkSession, out_path: str) -> DataFrame:
    """What latest_results_stream knows: the last row of each stem, as of its last change."""
    rows = spark.read.schema("stem string, modificationTime timestamp, path string, batch long").option("basePath", out_path).parquet(out_path)
    return rows.groupBy("stem").agg(F.max_by(F.struct("modificationTime", "path"), "batch").alias("r")).select("stem", "r.modificationTime", "r.path")


def extract_rows(wide: DataFrame) -> DataFrame:
    """ST3: fields of receipts that are one row each; no state and no shuffle, for streams and tables."""
    folded = extract.fold_fields(extract.listed_wide(wide.select("image_id", "text", "left", "top", "width", "height", "conf")))
    return extract.found_rows(folded).filter("f is not null").select("image_id", "f.field", "f.value", "f.confidence")


def extract_stream(spark: SparkSession, path: str) -> DataFrame:
    return extract_rows(spark.readStream.schema(WIDE_SCHEMA).json(path))
