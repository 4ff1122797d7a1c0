"""Many keywords and many templates: every way of looking them up against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from receiptlake.functions import automaton
from receiptlake.functions.automaton import Automaton
from receiptlake.operators import templates, zones

WORDS = "image_id string, word_idx int, text string, `left` int, top int, width int, height int, conf double"


def test_automaton_against_contains():
    rng = random.Random(1)
    for _ in range(200):
        patterns = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12))]
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("abéx") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        at, which = Automaton(patterns).find(pa.array(texts, pa.string()))
        assert list(zip(at.tolist(), which.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if t is not None and p in t]


def receipts(n=25, seed=3):
    rng = random.Random(seed)
    pool = ["Monto", "Bs", "REF", "referencia", "c.i.", "Banco", "", "  ", "İx", "montobs", "Ñandú", "0102"]
    return [(f"r{i}", k, rng.choice(pool), rng.randrange(0, 700, 10), rng.randrange(0, 500, 10), rng.choice([40, 90, 600]), rng.choice([20, 150]), float(rng.choice([10, 20, 21, 31, 71, 95]))) for i in range(n) for k in range(rng.randint(0, 15))]


@pytest.fixture(scope="module")
def tables(spark):
    w = spark.createDataFrame(receipts(), WORDS).cache()
    images = spark.createDataFrame([(f"r{i}", 800 + 7 * i, 600, " ".join(r[2] for r in receipts() if r[0] == f"r{i}") if i % 4 else None) for i in range(26)], "image_id string, img_width int, img_height int, full_text string").cache()
    return w, images


KEYWORDS = [(0, "a", ["bs", "Monto", "mon"]), (1, "b", ["REF", "x", ""]), (2, "c", []), (3, "a", ["ban", "Banco", None]), (4, "d", ["ñand", "c.i."]), (5, "e", None)]
WAYS = {"literals": {}, "automaton": {"LITERALS": 0}, "join": {"LITERALS": 0, "LARGEST": 0}}


def take(monkeypatch, way):
    for name, value in WAYS[way].items():
        monkeypatch.setattr(automaton if name == "LARGEST" else zones, name, value)


@pytest.mark.parametrize("way", WAYS)
def test_keywords(spark, tables, monkeypatch, way):
    take(monkeypatch, way)
    w, images = tables
    defs = spark.createDataFrame(KEYWORDS, "field_order int, field string, keywords array<string>")
    held = [(r, o, f, k, kw) for r in receipts() for o, f, ks in KEYWORDS for k, kw in enumerate(ks or []) if kw is not None and kw.lower() in r[2].lower()]
    got = zones.keyword_hits(w, defs, ["field_order", "field"], False).collect()
    assert sorted((r["image_id"], r["word_idx"], r["field_order"], r["k"], r["keyword"]) for r in got) == sorted((r[0], r[1], o, k, kw) for r, o, f, k, kw in held)
    first = {}
    for r, o, f, k, kw in held:
        if int(r[7]) >= 20 and r[2].strip():
            first.setdefault((r[0], r[1], o), (f, kw))
    got = zones.keyword_boxes(w, defs.select("field", "keywords")).collect()
    assert sorted((r["image_id"], r["word_idx"], r["field"], r["keyword"]) for r in got) == sorted((i, k, *v) for (i, k, _), v in first.items())
    points = zones.anchor_points(w, images, defs)
    assert points.agg(F.sum("n_anchors")).first()[0] == len(held) and points.filter("n_anchors = 0").count() == 26 * 6 - len({(r[0], o) for r, o, *_ in held})


@pytest.mark.parametrize("way", [x for x in WAYS if x != "literals"])
def test_zones_do_not_depend_on_the_way(tables, monkeypatch, way):
    want = sorted(map(str, zones.dynamic_zones_v1(*tables).collect()))
    take(monkeypatch, way)
    assert sorted(map(str, zones.dynamic_zones_v1(*tables).collect())) == want and want


def test_a_hundred_thousand_keywords(spark, tables):
    k = spark.range(100_000).select((F.col("id") % 1000).cast("string").alias("field"), F.concat(F.lit("k"), F.hex("id"), F.when(F.col("id") == 77, "").otherwise("z")).alias("kw")).groupBy("field").agg(F.collect_list("kw").alias("keywords"))
    w = tables[0].withColumn("text", F.when(F.col("word_idx") == 1, "xk1F3z yK4Dy").otherwise(F.col("text")))
    got = zones.keyword_boxes(w, k).groupBy("field", "keyword").count().collect()
    n = w.filter("word_idx = 1 and cast(conf as int) >= 20").count()
    assert sorted((r["field"], r["keyword"], r["count"]) for r in got) == [("499", "k1F3z", n), ("77", "k4D", n)]


def some_templates(n, seed=5):
    rng = random.Random(seed)
    words = ["Monto", "bs", "REF", "Banco", "0102", "nothing", "c.i.", "İx"]
    anchors = [(f"t{i:05d}", rng.choice(words)) for i in range(n) for _ in range(rng.randint(0, 4))]
    regions = [(f"t{i:05d}", f"r{k}", rng.choice([0.0, 0.1, 0.3]), rng.choice([0.0, 0.2, 0.5]), rng.choice([0.0, 0.05, 0.5]), rng.choice([0.04, 0.2])) for i in range(n) for k in range(rng.randint(0, 3))]
    return anchors, regions


def plain_best(anchors, regions, least):
    out = {}
    names = sorted({t for t, *_ in anchors} | {t for t, *_ in regions})
    own_a, own_r = {t: [] for t in names}, {t: [] for t in names}
    for t, a in anchors:
        own_a[t].append(a.upper())
    for t, _, *rel in regions:
        own_r[t].append(rel)
    for i in range(26):
        words = [r for r in receipts() if r[0] == f"r{i}"]
        texts = [r[2].upper() for r in words] + ([" ".join(r[2] for r in words).upper()] if i % 4 else [])
        width, scores = 800 + 7 * i, []
        held = {a: any(a in x for x in texts) for a in {a for v in own_a.values() for a in v}}
        covered = {}
        for rel in {tuple(r) for v in own_r.values() for r in v}:
            x, y, w, h = (int(v * s) for v, s in zip(rel, (width, 600, width, 600), strict=True))
            hit = lambda r: max(0, min(r[3] + r[5], x + w) - max(r[3], x)) * max(0, min(r[4] + r[6], y + h) - max(r[4], y)) > 0.3 * w * h > 0  # noqa: B023, E731
            covered[rel] = any(int(r[7]) > 30 and hit(r) for r in words)
        for t in names:
            text = sum(held[a] for a in own_a[t]) / len(own_a[t]) if own_a[t] else None
            structure = sum(covered[tuple(r)] for r in own_r[t]) / len(own_r[t]) if own_r[t] else None
            score = 0.6 * (text or 0.0) + 0.4 * (structure or 0.0)
            if score > 0 and score >= least:
                scores.append((-score, t, text, structure))
        if scores:
            best = min(scores, key=lambda x: x[:2])
            out[f"r{i}"] = (*best[1:], -best[0])
    return out


@pytest.mark.parametrize(("n", "part", "step"), [(10_000, 200_000, 256), (400, 300, 7), (9, 200_000, 2)])
def test_best_of_many_templates(spark, tables, monkeypatch, n, part, step):
    monkeypatch.setattr(templates, "PART", part)
    monkeypatch.setattr(templates, "STEP", step)
    monkeypatch.setattr(zones, "TEMPLATE_LITERALS", 0)
    anchors, regions = some_templates(n)
    a = spark.createDataFrame(anchors, "template string, anchor string")
    r = spark.createDataFrame(regions, "template string, name string, left_rel double, top_rel double, width_rel double, height_rel double")
    for least in (0.4, 0.7):
        got = {x["image_id"]: (x["template"], x["text_score"], x["structural_score"], x["score"]) for x in zones.best_template(*tables, a, r, least).collect()}
        assert got == plain_best(anchors, regions, least)


def test_all_scores_do_not_depend_on_the_way(spark, tables, monkeypatch):
    anchors, regions = some_templates(12)
    a = spark.createDataFrame(anchors, "template string, anchor string")
    r = spark.createDataFrame(regions, "template string, name string, left_rel double, top_rel double, width_rel double, height_rel double")
    want = sorted(map(str, zones.template_scores(*tables, a, r).collect()))
    best = sorted(map(str, zones.best_template(*tables, a, r).collect()))
    monkeypatch.setattr(zones, "TEMPLATE_LITERALS", 0)
    assert sorted(map(str, zones.template_scores(*tables, a, r).collect())) == want and len(want) == 26 * len({t for t, *_ in anchors} | {t for t, *_ in regions})
    assert sorted(map(str, zones.best_template(*tables, a, r).collect())) == best
    none = a.limit(0), r.limit(0)
    assert zones.best_template(*tables, *none).count() == 0 and zones.template_scores(*tables, *none).count() == 0


def test_templates_or_zones(spark, tables):
    """C4 with both kinds of zones: an image has its template's fields or zones, never both."""
    a, r = zones.template_tables(spark)
    campos = spark.createDataFrame([(zones.TEMPLATE, "monto", 1, 2, 3, 4)], "template string, field string, left int, top int, width int, height int")
    best = {x["image_id"] for x in zones.best_template(*tables, a, r).collect()}
    for kind, plain in (("v1", zones.dynamic_zones_v1), ("fixed", zones.dynamic_zones_fixed)):
        got = zones.identify_template_or_zones(*tables, a, r, campos, kind).collect()
        assert {x["image_id"] for x in got if x["template"]} == best
        rest = [(x["image_id"], x["field"], x["left"]) for x in got if not x["template"]]
        assert sorted(rest) == sorted((x["image_id"], x["field"], x["left"]) for x in plain(*tables).collect() if x["image_id"] not in best)
