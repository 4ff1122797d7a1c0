"""One pass over an image's words gives what the joins give, and shuffles neither words nor pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from receiptlake.fields import EXPANSION, ZONES_FIXED
from receiptlake.functions import automaton, near, text
from receiptlake.operators import extract, words, zones
from receiptlake.plans import registry

WORDS = "image_id string, word_idx int, text string, `left` int, top int, width int, height int, conf double"
KEYWORDS = [(0, "a", ["bs", "Monto", "mon"]), (1, "b", ["REF", "x", ""]), (2, "c", []), (3, "a", ["ban", None]), (4, "d", None)]


def page(n, seed):
    rng = random.Random(seed)
    pool = ["Monto", "Bs", "REF 1", "montobs", "Banco", "", " ", "0102", None]
    number = lambda: None if rng.random() < 0.05 else rng.randint(-60, 700)
    return [(rng.choice([None, "p0", "p1", "p2"]) if k % 9 == 0 else f"p{k % 3}", k, rng.choice(pool), number(), number(), rng.choice([0, 1, 40, 131]), rng.choice([0, 9, 64]), float(rng.choice([10, 50, 90]))) for k in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    w = spark.createDataFrame(page(240, 8), WORDS).cache()
    return w, spark.createDataFrame([("p0", 801, 600), ("p1", 400, 333), ("p3", 10, 10)], "image_id string, img_width int, img_height int").cache(), spark.createDataFrame(KEYWORDS, "field_order int, field string, keywords array<string>")


def rows(df):
    return sorted(map(str, df.collect()))


def few_shuffles(df):
    """Rows are dealt out by image alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("hashpartitioning(") == len(re.findall(r"hashpartitioning\(image_id#\d+, \d+\)", plan))


@pytest.mark.parametrize("largest", [0, automaton.LARGEST])
@pytest.mark.parametrize("few", [0, 64])
def test_expansion_counts(tables, monkeypatch, largest, few):
    monkeypatch.setattr(automaton, "LARGEST", largest)
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "PAIRS", 50)
    monkeypatch.setattr(near, "ROWS", 20)
    w, images, defs = tables
    want = extract.expansion_regions(w, zones.anchor_points(w, images, defs)).groupBy("image_id", "field", "radius").agg(F.count(F.lit(1)).alias("words"))
    assert rows(extract.expansion_counts(w, images, defs)) == rows(want) and want.count()


def test_expansion_counts_shuffle_no_words(spark):
    assert few_shuffles(registry.QUERIES["J8_expansion_regions"](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("largest", [0, automaton.LARGEST])
@pytest.mark.parametrize("radius", [0, 37, 150])
def test_keyword_neighbours(tables, monkeypatch, largest, radius):
    monkeypatch.setattr(automaton, "LARGEST", largest)
    monkeypatch.setattr(near, "PAIRS", 50)
    monkeypatch.setattr(near, "ROWS", 20)
    w, _, defs = tables
    pairs = zones.nearby_values(w, zones.keyword_boxes(w, defs.select("field", "keywords").filter("field <> 'a' or keywords[0] = 'bs'")), radius)
    got = zones.keyword_neighbours(w, defs.filter("field <> 'a' or keywords[0] = 'bs'"), radius)
    key = ["image_id", "field", "word_idx"]
    assert rows(got.select(*key, "n", "words", F.round("distance", 6))) == rows(pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("v_idx").alias("words"), F.round(F.sum("distance"), 6).alias("round(distance, 6)")))
    nearest = zones.nearest_value(pairs)
    assert rows(got.filter("v_idx is not null").select(*key, *zones.VALUES, F.col("v_distance").alias("distance"))) == rows(nearest.select(*key, *zones.VALUES, "distance"))


@pytest.mark.parametrize("name", ["J3_nearby_values", "W5_nearest_value"])
def test_keyword_neighbours_shuffle_no_pairs(spark, name):
    assert few_shuffles(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_a_dense_page_in_bounded_blocks(spark, monkeypatch):
    """Two thousand million pairs if all were made."""
    monkeypatch.setattr(near, "PAIRS", 10_000)
    n = 60_000
    w = spark.range(n).select(F.lit("page").alias("image_id"), F.col("id").cast("int").alias("word_idx"), F.when(F.col("id") % 2 == 0, "key").otherwise("value").alias("text"), ((F.col("id") % 400) * 50).cast("int").alias("left"), (F.floor(F.col("id") / 400) * 40).cast("int").alias("top"), F.lit(30).alias("width"), F.lit(20).alias("height"), F.lit(90.0).alias("conf"))
    got = zones.keyword_neighbours(w, spark.createDataFrame([("f", ["key"])], "field string, keywords array<string>"), 45)
    assert tuple(got.agg(F.count(F.lit(1)), F.sum("n")).first()) == (n // 2, n // 2 + 2 * (n // 2 - 400 // 2))


@pytest.fixture(scope="module")
def receipts(spark):
    """Field words with values beside them, some without a place, an image without words and one that is unknown."""
    rng = random.Random(5)
    pool = ["Bs", "Monto", "Fecha:", "12/03/2024", "1.234,50", "88,10", "Ref", "000123456789", "V-12345678", "Banco", "a (b) c", "x  y", "ñ#!", "", None]
    spot = lambda: None if rng.random() < 0.05 else rng.randint(0, 400)
    w = [(f"p{k % 3}", k, rng.choice(pool), spot(), spot(), rng.choice([20, 61]), 20, float(rng.choice([40, 61, 70, 88, 95]))) for k in range(150)]
    images = [("p0", 801, 600), ("p1", 400, 333), ("p4", 10, 10)]
    return spark.createDataFrame(w, WORDS).cache(), spark.createDataFrame(images, "image_id string, img_width int, img_height int").cache()


def joined(spark, w, images):
    """W8 over the joined squares of J8 and the region texts of A2."""
    defs = zones.field_table(spark, [(f, k) for f, k, _ in EXPANSION], "field string, keywords array<string>")
    inside = extract.expansion_regions(w.filter("conf > 60"), zones.anchor_points(w, images, defs)).withColumn("text", F.coalesce(text.charset_filter(F.col("text"), F.col("field")), F.lit("")))
    texts = words.region_text(inside, ["image_id", "field", "x", "y", "n_anchors", "first", "radius"])
    return extract.best_expansion(texts.withColumn("value", text.validate_field(F.col("raw_text"), F.col("field"))))


def test_best_regions(spark, receipts, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 50)
    columns = ["image_id", "field", "value", F.round("confidence", 6), "radius", "raw_text"]
    want = rows(joined(spark, *receipts).select(*columns))
    assert rows(extract.best_regions(*receipts).filter("value is not null").select(*columns)) == want and len(want) > 4


def test_expansion_fields_of_words_without_a_place(spark, receipts):
    """A keyword's word without a place has its anchor at the image's centre, as in J2."""
    got = extract.extract_fields_expansion(*receipts)
    best = joined(spark, *receipts).filter("extraction_successful").select("image_id", "field", "value")
    assert rows(got.filter("extraction_successful").select("image_id", "field", "value")) == rows(best)
    assert got.count() == 3 * 8 and got.filter("image_id = 'p4' and anchor_points_found = 0 and confidence = 0 and reason is not null").count() == 8


def test_best_expansion_shuffles_no_words(spark):
    assert few_shuffles(registry.QUERIES["W8_best_expansion"](spark, "/root/testdata/sf0.001"))


def test_keywords_that_begin_alike(spark, monkeypatch):
    """By their first three letters, 3600 million pairs of texts and keywords would meet."""
    monkeypatch.setattr(zones, "LITERALS", 0)
    monkeypatch.setattr(automaton, "LARGEST", 0)
    k = spark.range(60_000).select((F.col("id") % 25).cast("string").alias("field"), F.lpad((F.col("id") * 7).cast("string"), 11, "0").alias("kw")).groupBy("field").agg(F.collect_list("kw").alias("keywords"))
    w = spark.range(60_000).select(F.lit("p").alias("image_id"), F.col("id").cast("int").alias("word_idx"), F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 11, "0")).alias("text"), F.lit(90.0).alias("conf"))
    got = zones.keyword_boxes(w, k)
    assert got.count() == 60_000 // 7 + 1 and got.filter("text = 'x00000000014'").select("field", "keyword").collect() == [("2", "00000000014")]


@pytest.mark.parametrize("pieces", [1, 2, 16])
def test_keywords_of_many_lengths(spark, monkeypatch, pieces):
    monkeypatch.setattr(zones, "PIECES", pieces)
    monkeypatch.setattr(zones, "LITERALS", 0)
    monkeypatch.setattr(automaton, "LARGEST", 0)
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    defs = [(str(i), [letters(rng.randint(1, 9)) for _ in range(4)]) for i in range(12)]
    texts = [letters(rng.randint(0, 12)).upper() for _ in range(60)]
    w = spark.createDataFrame([("p", i, t, 90.0) for i, t in enumerate(texts)], "image_id string, word_idx int, text string, conf double")
    got = zones.keyword_hits(w, spark.createDataFrame(defs, "field string, keywords array<string>"), ["field"], False)
    assert sorted((r["word_idx"], r["field"], r["k"]) for r in got.collect()) == sorted((i, f, k) for i, t in enumerate(texts) for f, ks in defs for k, x in enumerate(ks) if x in t.lower())
    assert zones.keyword_hits(w, spark.createDataFrame([], "field string, keywords array<string>"), ["field"], False).count() == 0


def test_dynamic_zones_of_odd_words(spark, receipts):
    """Against the joins of J1, J3 and W5; words without a place are no boxes, an image without a size has no regions by position."""
    w = receipts[0].withColumn("text", F.when(F.col("word_idx") % 7 == 0, "origen").otherwise(F.col("text")))
    images = receipts[1].union(spark.createDataFrame([("p5", None, None)], receipts[1].schema))
    nearest = zones.nearest_value(zones.nearby_values(w, zones.keyword_boxes(w, zones.field_table(spark, [(f, k) for f, k, _ in ZONES_FIXED], "field string, keywords array<string>").select("field", "keywords")), 150)).join(images, "image_id")
    left, top = F.greatest(F.lit(0), F.col("v_left") - 5), F.greatest(F.lit(0), F.col("v_top") - 5)
    zone = nearest.select("image_id", "field", "word_idx", "v_conf", "v_text", left.alias("l"), top.alias("t"), F.least(F.col("img_width") - left, F.col("v_width") + 10).alias("w"), F.least(F.col("img_height") - top, F.col("v_height") + 10).alias("h")).filter("w > 0 and h > 0")
    best = zone.groupBy("image_id", "field").agg(F.min(F.struct((-F.col("v_conf")).alias("c"), "word_idx", "l", "t", "w", "h", "v_text")).alias("b")).select("image_id", "field", "b.l", "b.t", "b.w", "b.h", "b.v_text")
    got = zones.dynamic_zones_fixed(w, images)
    found = got.filter("method = 'value_box_direct'").select("image_id", "field", *[F.col(c).alias(n) for c, n in zip(("left", "top", "width", "height", "detected_text"), ("l", "t", "w", "h", "v_text"), strict=True)])
    assert rows(found) == rows(best) and best.count()
    assert got.filter("image_id = 'p4'").count() == 1 and got.filter("image_id = 'p5'").count() == 0 and got.filter("detected_text is null and method <> 'fallback_relative_position'").count() == 0


def test_combined_phases(spark):
    """O3: also of repeated rows and nulls, and rows that lie by image stay so."""
    a = spark.createDataFrame([("i", "f", "1"), ("i", None, "2"), (None, "f", "3")], "image_id string, field string, value string")
    g = spark.createDataFrame([("i", "f", "4"), ("i", "g", "5"), ("i", "g", "5"), ("i", None, "6"), (None, "f", "7")], a.schema)
    want = a.unionByName(g.join(a.select("image_id", "field"), ["image_id", "field"], "left_anti"))
    assert rows(extract.combine_phases(a, g)) == rows(want) and want.count() == 7
    assert few_shuffles(registry.QUERIES["O3_combine_phases"](spark, "/root/testdata/sf0.001"))


def test_validated_fields_make_no_row_for_each_field(spark):
    """Nothing is joined with the fields or sorted by them."""
    plan = registry.QUERIES["X3_validate_field"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Sort [" not in plan


def test_words_in_cells_are_not_shuffled(spark, receipts):
    """J4 over a grid; words and zones without an image or a place meet nothing."""
    w = receipts[0].unionByName(receipts[0].filter("word_idx = 1").withColumn("image_id", F.lit(None).cast("string")))
    z = w.select("image_id", F.col("word_idx").cast("string").alias("field"), *[F.col(c).alias(f"z_{c}") for c in ("left", "top", "width", "height")])
    got, want = zones.words_in_zone(w, z, 64), zones.words_in_zone(w, z)
    assert rows(got) == rows(want.select(*got.columns)) and sorted(got.columns) == sorted(want.columns) and want.count()
    assert few_shuffles(registry.QUERIES["J4_words_in_zone_grid"](spark, "/root/testdata/sf0.001"))
