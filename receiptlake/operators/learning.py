"""Corrections: statistics, the correction model, and its use.

Feedback rows: campo_nombre, raw_ocr_output, valor_corregido, causa_raiz,
timestamp_feedback and an order (a sequence column, or all columns by time).
The model is two long tables: entries(field, raw, total, last_updated,
adjustment) and corrections(field, raw, correction, cause, count, first_seen).

The fold of adjustments is an ordered monoid: rows of a key that follow each
other are a segment (n, s), which takes a value v to v * 0.5 ** n + s, and two
neighbouring segments are one again. So a key needs no window and no task of its
own: rows are dealt out by ranges of (key, order), a hot key over many of them,
and only segments, one for a key and day in each range, meet by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import CAUSE_ADVICE, FIELD_ADVICE, RESERVED_CORRECTIONS
from ..functions.text import confidence_adjustment
from ..sources import io

COLUMNS = ["id_unico_imagen", "campo_nombre", "raw_ocr_output", "valor_corregido", "causa_raiz"]
#: Half-lives after which a row of a fold has no weight left in double precision.
FOLD_ROWS = 1100
#: Corrections of a model that is broadcast; bits of a key filter, as a power of two, and their number for each key; the share of feedback that makes a key hot, and the tasks that share it.
BROADCAST_KEYS, MOST_BITS, HASHES, HOT_SHARE, SALTS = 200_000, 28, 4, 100, 16
SEGMENTS = "field string, raw string, day date, place long, n long, s double"


def order_columns(sequence: str | None = "seq") -> list[str]:
    return ["timestamp_feedback", *([sequence] if sequence else COLUMNS)]


def order_of(feedback: DataFrame, sequence: str | None = "seq") -> Column:
    return F.struct(*[F.col(c) for c in order_columns(sequence)])


def union_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """O2"""
    return old.unionByName(new)


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """A5: one row for all, one for each field, one for each cause."""
    sets = feedback.groupingSets([[F.col("campo_nombre")], [F.col("causa_raiz")], []], F.col("campo_nombre"), F.col("causa_raiz"))
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("entries"), F.max("timestamp_feedback").alias("last_feedback"))
    out = out.withColumn("kind", F.when(F.col("g") == 1, "field").when(F.col("g") == 2, "cause").otherwise("all"))
    key = F.coalesce("campo_nombre", "causa_raiz")
    return out.filter((F.col("kind") == "all") | key.isNotNull()).select("kind", key.alias("key"), "entries", "last_feedback")


def count_corrections(feedback: DataFrame, sequence: str | None = "seq") -> tuple[DataFrame, DataFrame]:
    """(totals, corrections) of feedback, without the fold: (field, raw, total, last_updated) and the corrections table."""
    f = feedback.filter(F.col("campo_nombre").isNotNull() & F.col("raw_ocr_output").isNotNull() & F.col("valor_corregido").isNotNull())
    f = f.withColumn("order", order_of(f, sequence))
    key = [F.col("campo_nombre").alias("field"), F.col("raw_ocr_output").alias("raw")]
    corrections = f.groupBy(*key, F.col("valor_corregido").alias("correction"), F.col("causa_raiz").alias("cause")).agg(F.count(F.lit(1)).alias("count"), F.min("order").alias("first_seen"))
    return f.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.max("timestamp_feedback").alias("last_updated")), corrections


def build_model(feedback: DataFrame, sequence: str | None = "seq") -> tuple[DataFrame, DataFrame]:
    """(entries, corrections) from feedback alone."""
    totals, corrections = count_corrections(feedback, sequence)
    return totals.join(confidence_fold(feedback, sequence), ["field", "raw"], "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0))).drop("n"), corrections


def _segments(it):
    """Rows in order of (field, raw, order) to one (n, s) for each stretch of a key and day, numbered in order."""
    number = TaskContext.get().partitionId() << 36
    for batch in it:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in range(3):
            v = batch.column(c).dictionary_encode()
            code = np.asarray(pc.fill_null(v.indices, -1)) if isinstance(v, pa.DictionaryArray) else np.asarray(v)
            new[1:] |= code[1:] != code[:-1]
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, batch.num_rows))
        from_end = np.repeat(first + n, n) - np.arange(batch.num_rows)  # 1 for the last row of a stretch
        s = np.add.reduceat(np.asarray(batch.column(3)) * 0.5 ** np.minimum(from_end, FOLD_ROWS), first)
        at = pa.array(first)
        place = pa.array(number + np.arange(len(first)))
        number += len(first)
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in range(3)], place, pa.array(n), pa.array(s)], ["field", "raw", "day", "place", "n", "s"])


def _combined(order: str) -> tuple[Column, Column]:
    """n and s of all segments of a group, in order."""
    listed = F.sort_array(F.collect_list(F.struct(order, "n", "s")))
    s = F.aggregate(listed, F.lit(0.0), lambda v, x: v * F.pow(F.lit(0.5), x["n"]) + x["s"])
    return F.sum("n").alias("n"), s.alias("s")


def fold_segments(feedback: DataFrame, sequence: str | None = "seq") -> DataFrame:
    """(field, raw, day, n, s): the segment of each key and day, of rows whose adjustment is not zero."""
    order = order_columns(sequence)
    f = feedback.withColumn("adj", confidence_adjustment(F.col("causa_raiz"))).filter("adj <> 0 and campo_nombre is not null and raw_ocr_output is not null")
    f = f.select(F.col("campo_nombre").alias("field"), F.col("raw_ocr_output").alias("raw"), F.to_date("timestamp_feedback").alias("day"), "adj", *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    by = ["field", "raw", *[f"_{i}" for i in range(len(order))]]
    parts = f.repartitionByRange(*by).sortWithinPartitions(*by).select("field", "raw", "day", "adj").mapInArrow(_segments, SEGMENTS)
    return parts.groupBy("field", "raw", "day").agg(*_combined("place"))


def combine_segments(segments: DataFrame) -> DataFrame:
    """(field, raw, n, adjustment) from the segments of each key's days; rows without a day come first."""
    return segments.groupBy("field", "raw").agg(*_combined("day")).withColumnRenamed("s", "adjustment")


def confidence_fold(feedback: DataFrame, sequence: str | None = "seq", seed: DataFrame | None = None) -> DataFrame:
    """(field, raw, n, adjustment) of new = (current + adjustment) / 2 over rows in order, non-zero ones only.

    n counts all rows of a key. seed has (field, raw, adjustment) to start from."""
    folded = combine_segments(fold_segments(feedback, sequence))
    if seed is None:
        return folded
    old = seed.select("field", "raw", F.col("adjustment").alias("old"))
    out = folded.join(old, ["field", "raw"], "full")
    n = F.coalesce("n", F.lit(0))
    return out.select("field", "raw", n.alias("n"), (F.coalesce("old", F.lit(0.0)) * F.pow(F.lit(0.5), n) + F.coalesce("adjustment", F.lit(0.0))).alias("adjustment"))


def merge_counts(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Totals and corrections of both, added up."""
    key = ["field", "raw", "correction", "cause"]
    corrections = new[1].unionByName(old[1]).groupBy(*key).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    columns = ["field", "raw", "total", "last_updated"]
    return new[0].select(*columns).unionByName(old[0].select(*columns)).groupBy("field", "raw").agg(F.sum("total").alias("total"), F.max("last_updated").alias("last_updated")), corrections


def merge_model(old: tuple[DataFrame, DataFrame], feedback: DataFrame, sequence: str | None = "seq") -> tuple[DataFrame, DataFrame]:
    """Counts add up, the adjustment goes on from the stored value."""
    totals, merged = merge_counts(old, count_corrections(feedback, sequence))
    fold = confidence_fold(feedback, sequence, old[0]).drop("n")
    return totals.join(fold, ["field", "raw"], "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0))), merged


def best_correction(corrections: DataFrame) -> DataFrame:
    """(field, raw, correction) with the most rows, the one seen first on ties; an empty one counts as none."""
    c = corrections.filter(~F.col("correction").isin(RESERVED_CORRECTIONS)).groupBy("field", "raw", "correction").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy("field", "raw").orderBy(F.desc("count"), "first_seen", "correction"))
    return c.filter("count > 0").withColumn("_r", rank).filter("_r = 1").select("field", "raw", F.when(F.col("correction") != "", F.col("correction")).alias("correction"), "count")


def _hot(model: tuple[DataFrame, DataFrame]) -> list[tuple[str, str]]:
    """The keys that hold more than 1 / HOT_SHARE of all feedback, HOT_SHARE at most."""
    whole = model[0].agg(F.sum("total")).first()[0] or 0
    return [(r["field"], r["raw"]) for r in model[0].filter(F.col("total") * HOT_SHARE > whole).select("field", "raw").collect()]


def _bits(field: Column, value: Column, size: int) -> list[Column]:
    """The places of a key in a Bloom filter of ``size`` bits."""
    h = F.xxhash64(field, value)
    step = F.xxhash64(value, field).bitwiseOR(F.lit(1).cast("long"))
    place = h
    out = []
    for _ in range(HASHES):
        out.append(place.bitwiseAND(F.lit(size - 1).cast("long")))
        place = F.xxhash64(place, step)
    return out


def key_filter(keys: DataFrame, size: int) -> DataFrame:
    """One row with a Bloom filter of (field, value) keys: words of 64 bits, made by OR-ing partial words map-side."""
    bits = keys.select(F.explode(F.array(*_bits(F.col("field"), F.col("value"), size))).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b"))
    held = F.map_from_entries(F.collect_list(F.struct("w", "b")))
    return words.agg(held.alias("held")).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max(size // 64 - 1, 0)).cast("long")), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long"))).alias("filter"))


def may_hold(field: Column, value: Column, size: int) -> Column:
    """Whether the filter in column ``filter`` may hold a key; false only if it does not."""
    word = lambda p: F.get("filter", F.shiftright(p, 6).cast("int"))
    tests = [F.getbit(word(p), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1 for p in _bits(field, value, size)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def apply_corrections(fields: DataFrame, model: tuple[DataFrame, DataFrame], broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Fields has (field, value, confidence); adds corrected_value and corrected_confidence.

    A model of broadcast_keys corrections at most is broadcast. Beyond, a Bloom filter
    of its keys lets the fields without a correction pass unshuffled, and the keys
    that hold much of the feedback, such as the empty text, are dealt out over SALTS
    tasks on both sides."""
    key = ["field", "value"]
    best = best_correction(model[1]).filter("correction is not null").select("field", F.col("raw").alias("value"), "correction")
    best = io.staged(best.join(model[0].select("field", F.col("raw").alias("value"), "adjustment"), key), "corrections")
    n = best.count()
    if n <= broadcast_keys:
        out = fields.join(F.broadcast(best), key, "left")
    else:
        size = 1 << min(MOST_BITS, max(6, (n * 10 - 1).bit_length()))
        told = fields.crossJoin(F.broadcast(key_filter(best.select(*key), size)))  # one row of at most 2 ** MOST_BITS bits
        maybe = may_hold(F.col("field"), F.col("value"), size)
        hot = F.struct("field", "value").isin([F.struct(F.lit(f), F.lit(v)) for f, v in keys]) if (keys := _hot(model)) else F.lit(False)
        salted = told.filter(maybe).drop("filter").withColumn("_salt", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0))
        dealt = best.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
        found = salted.join(dealt, [*key, "_salt"], "left").drop("_salt")
        kinds = dict(best.dtypes)
        out = found.unionByName(told.filter(~maybe).drop("filter").withColumns({c: F.lit(None).cast(kinds[c]) for c in ("correction", "adjustment")}))
    changed = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("confidence") + F.col("adjustment")))
    return out.withColumn("corrected_value", F.coalesce("correction", "value")).withColumn("corrected_confidence", F.when(F.col("correction").isNotNull(), changed).otherwise(F.col("confidence"))).drop("correction", "adjustment")


def processing_stats(feedback: DataFrame) -> DataFrame:
    """(kind, key, n): all rows, by field, by cause, and non-zero adjustments."""
    f = feedback.withColumn("nonzero", (confidence_adjustment(F.col("causa_raiz")) != 0).cast("int"))
    sets = f.groupingSets([[F.col("campo_nombre")], [F.col("causa_raiz")], []], F.col("campo_nombre"), F.col("causa_raiz")).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("nonzero").alias("a"))
    row = lambda kind, key, n: F.struct(kind.alias("kind"), key.alias("key"), n.cast("long").alias("n"))
    all_ = F.array(row(F.lit("all"), F.lit(""), F.col("n")), row(F.lit("adjustments"), F.lit(""), F.col("a")))
    one = F.array(row(F.when(F.col("g") == 1, F.lit("field")).otherwise(F.lit("cause")), F.coalesce("campo_nombre", "causa_raiz", F.lit("")), F.col("n")))
    rows = F.when(F.col("g") == 3, all_).otherwise(one)
    return sets.select(F.explode(rows).alias("r")).select("r.kind", "r.key", "r.n")


def top_problem(feedback: DataFrame, sequence: str | None = "seq") -> DataFrame:
    """The field and the cause with most rows, first seen on ties, and what to do about them."""
    f = feedback.withColumn("order", order_of(feedback, sequence))

    def top(kind: str, column: str) -> DataFrame:
        return f.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first")).orderBy(F.desc("n"), "first").limit(1).select(F.lit(kind).alias("kind"), "key", "n")

    advice = F.create_map(*[F.lit(x) for kv in CAUSE_ADVICE.items() for x in kv])
    out = top("field", "campo_nombre").unionByName(top("cause", "causa_raiz"))
    return out.withColumn("recommendation", F.when(F.col("kind") == "field", FIELD_ADVICE).otherwise(F.try_element_at(advice, F.col("key"))))


def retrain(feedback: DataFrame, model: tuple[DataFrame, DataFrame] | None = None, sequence: str | None = "seq") -> tuple[DataFrame, DataFrame]:
    """The model after this feedback."""
    return merge_model(model, feedback, sequence) if model else build_model(feedback, sequence)
