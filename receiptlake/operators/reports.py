"""Reports over results: issues, summaries, recent and latest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def persistent_issues(results: DataFrame, diagnosis: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """Results has (image_id, overall_confidence, field_confidences, cross_validation_passed)."""
    n = feedback.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("timestamp_feedback") >= now - F.expr("interval 7 days")).alias("recent"))  # one row
    r = results.join(diagnosis.select("image_id", "sharpness", "noise_level"), "image_id", "left").crossJoin(F.broadcast(n))
    low = F.size(F.filter(F.coalesce("field_confidences", F.array().cast("array<double>")), lambda c: c < 40)) >= 3
    issue = lambda ok, name, severity: F.when(ok, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        issue((F.coalesce("overall_confidence", F.lit(100.0)) < 50) & low, "multiple_low_confidence_fields", "high"),
        issue((F.coalesce("sharpness", F.lit(1000.0)) < 100) & (F.coalesce("noise_level", F.lit(0.0)) > 15), "preprocessing_insufficient", "medium"),
        issue(~F.coalesce("cross_validation_passed", F.lit(True)), "validation_failures", "medium"),
        issue((F.col("all") > 10) & (F.col("recent") > 5), "frequent_recent_corrections", "high"),
    ))
    r = r.select("image_id", found.alias("found"))
    return r.select("image_id", F.transform("found", lambda i: i["issue"]).alias("issues"), (F.size("found") >= 2).alias("suggest_update"))


def summary(documents: DataFrame) -> DataFrame:
    """A10: documents as in the data model, with campos a map of structs."""
    ok = F.map_filter("campos", lambda k, v: v["extraction_successful"])
    return documents.select("image_id", "status", "extraction_method", "overall_confidence", "cross_validation_passed", F.size("campos").alias("n_fields"), F.transform_values(ok, lambda k, v: F.struct(v["value"].alias("value"), v["confidence"].alias("confidence"))).alias("values"))


def documents(fields: DataFrame, statistics: DataFrame) -> DataFrame:
    """One row for each image with its fields as a map."""
    c = fields.groupBy("image_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("value", "confidence", "extraction_successful"))))).alias("campos"))
    return statistics.select("image_id", "status", "overall_confidence").join(c, "image_id").withColumn("extraction_method", F.lit("expansion")).withColumn("cross_validation_passed", F.lit(True))


def processed_recently(results: DataFrame, now: Column, days: int = 1) -> DataFrame:
    """Results has a modificationTime."""
    return results.agg(F.count_if((F.col("modificationTime") > now - F.make_dt_interval(F.lit(days))) & (F.col("modificationTime") <= now)).alias("processed"))


def latest_result(results: DataFrame) -> DataFrame:
    """The most recent result of each image stem."""
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("modificationTime"), F.desc("path")))
    return results.withColumn("_r", rank).filter("_r = 1").drop("_r")
