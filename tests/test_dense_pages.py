"""Spatial joins over a grid: the same pairs as plain ones, and no others made on the way."""

import random

import pytest
from pyspark.sql import functions as F

from receiptlake.operators import extract, zones

WORDS = "image_id string, word_idx int, text string, `left` int, top int, width int, height int, conf double"
ZONES = "image_id string, field string, z_left int, z_top int, z_width int, z_height int"


def boxes(n, seed, size=600):
    rng = random.Random(seed)
    return [(f"p{k % 2}", k, f"w{k}", rng.randint(-60, size), rng.randint(-60, size), rng.choice([0, 1, 7, 40, 130]), rng.choice([0, 1, 9, 64]), float(rng.choice([10, 50, 90]))) for k in range(n)]


@pytest.mark.parametrize("radius", [0, 1, 37, 150])
def test_near_words(spark, radius):
    rows = boxes(220, 1)
    w = spark.createDataFrame(rows, WORDS)
    keys = w.filter("word_idx % 5 = 0").withColumn("field", F.lit("f"))
    got = [(r["word_idx"], r["v_idx"]) for r in zones.nearby_values(w, keys, radius).collect()]
    at = lambda r: (r[3] + r[5] / 2, r[4] + r[6] / 2)
    want = [(a[1], b[1]) for a in rows if a[1] % 5 == 0 for b in rows if a[0] == b[0] and b[7] >= 20 and (at(a)[0] - at(b)[0]) ** 2 + (at(a)[1] - at(b)[1]) ** 2 <= radius**2]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("cell", [None, 16, 100, 5000])
def test_words_in_zones(spark, cell):
    rows, rng = boxes(200, 2), random.Random(3)
    z = [(f"p{k % 2}", f"z{k}", rng.randint(-80, 600), rng.randint(-80, 600), rng.choice([0, 1, 30, 400]), rng.choice([0, 2, 50, 300])) for k in range(60)]
    got = [(r["word_idx"], r["field"]) for r in zones.words_in_zone(spark.createDataFrame(rows, WORDS), spark.createDataFrame(z, ZONES), cell).collect()]
    want = [(r[1], f) for r in rows for i, f, x, y, w, h in z if r[0] == i and r[3] < x + w and r[3] + r[5] > x and r[4] < y + h and r[4] + r[6] > y]
    assert sorted(got) == sorted(want) and want


def test_expanding_squares(spark):
    rows = boxes(160, 4)
    anchors = spark.createDataFrame([(f"p{k % 2}", 0, "f", 37 * k - 20, 23 * k % 500, 1) for k in range(25)], "image_id string, field_order int, field string, x int, y int, n_anchors int").withColumn("first", F.struct(F.lit(0).alias("word_idx"), F.lit(0).alias("k")))
    got = [(r["word_idx"], r["x"], r["y"], r["radius"]) for r in extract.expansion_regions(spark.createDataFrame(rows, WORDS), anchors).collect()]
    want = []
    for k in range(25):
        x, y = 37 * k - 20, 23 * k % 500
        for r in rows:
            far = max(abs(r[3] + r[5] // 2 - x), abs(r[4] + r[6] // 2 - y))
            want += [(r[1], x, y, q) for q in extract.RADII if r[0] == f"p{k % 2}" and far <= q]
    assert sorted(got) == sorted(want)


def test_a_page_of_a_hundred_thousand_words(spark):
    """Every second word is a keyword's: all pairs would be five thousand million; each meets those in its nine cells only."""
    n = 100_000
    w = spark.range(n).select(F.lit("page").alias("image_id"), F.col("id").cast("int").alias("word_idx"), F.concat(F.lit("w"), "id").alias("text"), ((F.col("id") % 400) * 50).cast("int").alias("left"), (F.floor(F.col("id") / 400) * 40).cast("int").alias("top"), F.lit(30).alias("width"), F.lit(20).alias("height"), F.lit(90.0).alias("conf"))
    near = zones.nearby_values(w, w.filter("word_idx % 2 = 0").withColumn("field", F.lit("f")), 45)
    got = near.agg(F.count(F.lit(1)), F.count_if(F.col("distance") > 0)).first()
    assert got[0] == 50_000 + got[1] and got[1] == 2 * (50_000 - 400 // 2)  # itself, and the word above and below
