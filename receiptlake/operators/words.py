"""Operators over OCR words: one row for each word, or one for each image with a list of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = ["text", "left", "top", "width", "height", "conf", "word_num", "line_num", "par_num"]


def _conf(words: DataFrame) -> Column:
    return words["conf"].cast("int")


def _text(words: DataFrame) -> Column:
    return F.trim(words["text"]) != ""


def explode_ocr(wide: DataFrame) -> DataFrame:
    """Parallel lists to one row for each word."""
    lists = [c for c in WIDE if c in wide.columns]
    rows = wide.select("image_id", F.posexplode(F.arrays_zip(*lists)).alias("word_idx", "w"))
    return rows.select("image_id", "word_idx", *[F.col(f"w.{c}").alias(c) for c in lists])


def collect_ocr(words: DataFrame) -> DataFrame:
    """The reverse of explode_ocr, in word order."""
    lists = [c for c in WIDE if c in words.columns]
    rows = words.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", *lists))).alias("w"))
    return rows.select("image_id", *[F.col(f"w.{c}").alias(c) for c in lists])


def valid_words(words: DataFrame) -> DataFrame:
    """P1"""
    return words.filter((_conf(words) > 0) & _text(words))


def bounding_boxes(words: DataFrame, min_confidence: int = 30) -> DataFrame:
    """With right and bottom edges."""
    out = words.filter((_conf(words) >= min_confidence) & _text(words))
    return out.withColumn("right", F.col("left") + F.col("width")).withColumn("bottom", F.col("top") + F.col("height"))


def word_list(words: DataFrame) -> DataFrame:
    """Trimmed words above confidence 20 with their centres."""
    out = words.filter((_conf(words) > 20) & _text(words))
    return out.select("image_id", "word_idx", F.trim("text").alias("text"), "left", "top", "width", "height", _conf(words).alias("conf"), F.expr("left + width div 2").cast("int").alias("x"), F.expr("top + height div 2").cast("int").alias("y"))


def ocr_summary(words: DataFrame, images: DataFrame) -> DataFrame:
    """A1"""
    w = valid_words(words).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("conf").cast("int")).alias("c"))
    return images.join(w, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("words_detected"), F.coalesce("c", F.lit(0.0)).alias("average_confidence"), F.length("full_text").alias("text_length"))


def region_text(words: DataFrame, keys: list[str], min_confidence: float = 60) -> DataFrame:
    """A2: words above the confidence, joined in order, their mean confidence and number; '' and 0 where none is."""
    ok = (F.col("conf") > min_confidence) & (F.trim("text") != "")
    listed = F.sort_array(F.collect_list(F.when(ok, F.struct("word_idx", F.trim("text").alias("t")))))
    return words.groupBy(*keys).agg(F.array_join(listed["t"], " ").alias("raw_text"), F.coalesce(F.avg(F.when(ok, F.col("conf"))), F.lit(0.0)).alias("confidence"), F.count_if(ok).alias("word_count"))


def average_confidence(words: DataFrame) -> DataFrame:
    """A3: over all words above zero, blank ones included."""
    c = _conf(words)
    return words.groupBy("image_id").agg(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("average_confidence"))


def reading_order(words: DataFrame) -> DataFrame:
    """O1: the words of an image by top, then left."""
    listed = F.array_sort(F.collect_list(F.struct("top", "left", "word_idx", "text")))
    return words.groupBy("image_id").agg(F.array_join(F.transform(listed, lambda w: w["text"]), " ").alias("ordered_text"))


def unused_words(words: DataFrame, used: DataFrame) -> DataFrame:
    """Words that no earlier field took."""
    return words.join(used.select("image_id", "word_idx"), ["image_id", "word_idx"], "left_anti")


def extraction_efficiency(fields: DataFrame, words: DataFrame) -> DataFrame:
    """Fields has (image_id, used array); used words against all."""
    n = word_list(words).groupBy("image_id").agg(F.count(F.lit(1)).alias("words_processed"))
    out = n.join(fields.select("image_id", F.size(F.array_distinct("used")).alias("words_used")), "image_id", "left")
    out = out.withColumn("words_used", F.coalesce("words_used", F.lit(0)))
    return out.withColumn("efficiency", F.col("words_used") / F.col("words_processed"))
