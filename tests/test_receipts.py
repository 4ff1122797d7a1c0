"""Receipt operators: fixed cases, boundaries, and plain versions of the extraction folds."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from receiptlake.fields import EXPANSION, FLEXIBLE, GENERAL_SCAN
from receiptlake.functions import text as X
from receiptlake.operators import extract, learning, quality, words, zones
from receiptlake.sources import io
from receiptlake.streaming import jobs

WORDS = "image_id string, word_idx int, text string, `left` int, top int, width int, height int, conf double"


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_amounts(spark):
    rows = [("522,70",), ("150.000,00",), ("1.234.567",), ("Bs. 12",), ("abc",), (None,), ("1,5",)]
    assert values(spark, X.normalize_amount(F.col("t")), rows, "t string") == ["522.70", "150.00000", None, ".12", None, None, "1.5"]
    assert values(spark, X.normalize_amount(F.col("t"), "last_separator"), rows[:2] + [("1,234.50",)], "t string") == ["522.70", "150000.00", "1234.50"]


def test_field_validation(spark):
    rows = [("fecha", "28/12/2024", "28/12/2024"), ("fecha", "2024-12-28", None), ("fecha", "8/12/2024", None), ("operacion", "003039965664", "003039965664"), ("operacion", "12345678", None), ("monto", " 522,70 ", "522.70"), ("identificacion", "v-27061025", "v-27061025"), ("origen_numero", "0102****5071", None), ("destino_numero", "04125318244", "04125318244"), ("otro", "x", None)]
    got = values(spark, X.validate_field(F.col("t"), F.col("f")), [r[:2] for r in rows], "f string, t string")
    assert got == [r[2] for r in rows]


def test_confidence_boundaries(spark):
    rows = [("i", k, "a", 0, 0, 1, 1, c) for k, c in enumerate([0.0, 0.9, 1.0, 20.0, 20.9, 21.0, 30.0, 60.0, 60.5])] + [("i", 20, "  ", 0, 0, 1, 1, 99.0)]
    w = spark.createDataFrame(rows, WORDS)
    assert words.valid_words(w).count() == 7
    assert words.word_list(w).count() == 4
    assert words.bounding_boxes(w).count() == 3
    r = words.region_text(w, ["image_id"]).first()
    assert (r["raw_text"], r["confidence"], r["word_count"]) == ("a", 60.5, 1)


def random_receipts(n=60):
    rng = random.Random(8)
    pool = [k for _, ks, *_ in FLEXIBLE for k in ks if " " not in k] + ["522,70", "12/10/2024", "003039965664", "V-12345678", "04125318244", "MERCANTIL", "Pedro Perez", "Gomez", "0102", "casa"]
    for i in range(n):
        for k in range(rng.randint(1, 25)):
            yield (f"r{i}", k, rng.choice(pool), rng.randrange(0, 700, 10), rng.randrange(0, 500, 10), rng.choice([40, 90, 150]), 20, float(rng.choice([10, 20, 21, 50, 51, 60, 70, 71, 85, 95])))


def plain_flexible(receipt):
    w = [dict(text=t.strip(), left=x, top=y, width=a, height=b, conf=int(c)) for _, _, t, x, y, a, b, c in receipt if int(c) > 20 and t.strip()]
    used, out = set(), {}
    for name, keywords, pattern, dx, dy, multiword in FLEXIBLE:
        full = lambda t, p=pattern: re.fullmatch(p.replace("$", ""), t, re.A) or re.match(rf"\A(?:{p})\Z", t, re.A)
        anchor = next((i for i, x in enumerate(w) if i not in used and x["conf"] > 70 and any(k.lower() in x["text"].lower() for k in keywords)), None)
        if anchor is None:
            continue
        used.add(anchor)
        a = w[anchor]
        left, top, right, bottom = a["left"] + a["width"], a["top"], a["left"] + a["width"] + dx, a["top"] + dy + a["height"]
        inside = [i for i, x in enumerate(w) if i not in used and x["conf"] > 50 and x["left"] < right and x["left"] + x["width"] > left and x["top"] < bottom and x["top"] + x["height"] > top]
        hits = [i for i in inside if full(w[i]["text"])]
        if not hits:
            continue
        v = w[max(hits, key=lambda i: (w[i]["conf"], -i))]
        out[name] = (v["text"], float(v["conf"]))
        used |= {i for i, x in enumerate(w) if v["left"] <= x["left"] <= v["left"] + v["width"] and v["top"] <= x["top"] <= v["top"] + v["height"]}
    for i, x in enumerate(w):
        if i not in used and x["conf"] >= GENERAL_SCAN[2] and re.fullmatch(r"[A-Za-zÀ-ÿ\s]{5,}", x["text"]):
            out[GENERAL_SCAN[0]] = (x["text"], float(x["conf"]))
            break
    return out


def test_flexible_extraction_against_a_plain_version(spark):
    receipts = list(random_receipts())
    w = spark.createDataFrame(receipts, WORDS)
    want = {(i, f): v for i in {r[0] for r in receipts} for f, v in plain_flexible([r for r in receipts if r[0] == i]).items()}
    got = {(r["image_id"], r["field"]): (r["value"], r["confidence"]) for r in extract.extract_fields_flexible(w).collect()}
    assert got == want and len(want) > 40
    rows = {(r["image_id"], r["field"]): (r["value"], r["confidence"]) for r in jobs.extract_rows(words.collect_ocr(w)).collect()}
    assert rows == want


def plain_amount(text):
    t = re.sub(r"[^\d.,]", "", text)
    t = t.replace(",", "") if "," in t and "." in t else t.replace(",", ".")
    try:
        float(t)
    except ValueError:
        return None
    return t


def plain_value(text, field, pattern):
    t = re.sub(r"\s+", " ", text).strip()
    if not re.search(pattern, t, re.I):
        return None
    if field == "monto":
        return plain_amount(t)
    if field == "fecha" and not re.match(r"\d{2}[/-]\d{2}[/-]\d{2,4}", t):
        return None
    if field == "operacion" and len(re.sub(r"\D", "", t)) < 10:
        return None
    return t


def plain_expansion(receipt, field, keywords, pattern):
    charset = {"monto": r"[^0-9.,\-]", "fecha": r"[^0-9/\-:]"}.get(field, r"[^0-9A-Za-z.,:\-/() ]")
    centre = lambda r: (r[3] + r[5] // 2, r[4] + r[6] // 2)
    anchors = [centre(r) for r in receipt for k in keywords if k.lower() in r[2].lower()] or [(400, 300)]
    best = None
    for x, y in dict.fromkeys(anchors):
        own = None
        for radius in (50, 75, 100, 125, 150):
            inside = [(re.sub(charset, "", r[2]).strip(), r[7]) for r in receipt if max(abs(centre(r)[0] - x), abs(centre(r)[1] - y)) <= radius]
            inside = [(t, c) for t, c in inside if t and c > 60]
            value = plain_value(" ".join(t for t, _ in inside), field, pattern) if inside else None
            if value is not None:
                conf = sum(c for _, c in inside) / len(inside)
                if own is None or conf > own[1]:
                    own = (value, conf)
                if own[1] > 85:
                    break
        if own and (best is None or own[1] > best[1]):
            best = own
    return best


def test_expansion_against_a_plain_version(spark):
    receipts = list(random_receipts(25))
    w = spark.createDataFrame(receipts, WORDS)
    images = w.select("image_id").distinct().select("image_id", F.lit(800).alias("img_width"), F.lit(600).alias("img_height"), F.lit("").alias("full_text"))
    got = {(r["image_id"], r["field"]): (r["value"], round(r["confidence"], 6)) for r in extract.extract_fields_expansion(w, images).collect() if r["extraction_successful"]}
    want = {}
    for i in {r[0] for r in receipts}:
        for f, k, p in EXPANSION:
            if v := plain_expansion([r for r in receipts if r[0] == i], f, k, p):
                want[i, f] = (v[0], round(v[1], 6))
    assert got == want and want


def test_fold_of_adjustments_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("i", "monto", rng.choice(["", "a"]), "v", rng.choice(["otro", "ruido_imagen", "x", "mala_segmentacion"]), f"2024-01-01 00:00:{k % 60:02d}", k) for k in range(60)]
    f = spark.createDataFrame(rows, "id_unico_imagen string, campo_nombre string, raw_ocr_output string, valor_corregido string, causa_raiz string, t string, seq long").withColumn("timestamp_feedback", F.to_timestamp("t"))
    want = {}
    for r in rows:
        a = {"otro": -2.0, "ruido_imagen": -7.0, "mala_segmentacion": -10.0}.get(r[4], 0.0)
        if a:
            want[r[2]] = (want.get(r[2], 0.0) + a) / 2
    got = {r["raw"]: r["adjustment"] for r in learning.confidence_fold(f).collect()}
    assert got == pytest.approx(want)
    old = learning.build_model(f.filter("seq < 20"))
    merged = {r["raw"]: r["adjustment"] for r in learning.merge_model(old, f.filter("seq >= 20"))[0].collect()}
    assert merged == pytest.approx(want)


def test_best_correction_rules(spark):
    rows = [("f", "r1", "a", "c", 2, 5), ("f", "r1", "b", "c", 2, 1), ("f", "r2", "", "c", 3, 1), ("f", "r3", "last_updated", "c", 9, 1), ("f", "r3", "z", "c", 1, 2)]
    c = spark.createDataFrame(rows, "field string, raw string, correction string, cause string, count long, first_seen long")
    assert {r["raw"]: r["correction"] for r in learning.best_correction(c).collect()} == {"r1": "b", "r2": None, "r3": "z"}


def test_pixel_metrics(spark):
    flat, spike = [10] * 9, [0, 0, 0, 0, 9, 0, 0, 0, 0]
    p = spark.createDataFrame([("flat", 3, 3, flat), ("spike", 3, 3, spike), ("white", 3, 3, [255] * 9)], "image_id string, width int, height int, gray array<int>")
    t = {r["image_id"]: r for r in quality.texture(p).collect()}
    assert t["flat"]["sharpness"] == 0 and t["flat"]["noise_level"] == 0
    assert t["spike"]["sharpness"] == pytest.approx(np.var([0, 18, 0, 18, -36, 18, 0, 18, 0]))
    d = {r["image_id"]: r for r in quality.dark_background(quality.brightness_stats(p)).collect()}
    assert d["flat"]["is_dark"] and d["flat"]["dark_confidence"] == 1.0
    assert d["white"]["bright_percentage"] == 0 and not d["white"]["is_dark"]


def test_edges_of_zones(spark):
    w = spark.createDataFrame([("i", 0, "a", 0, 0, 10, 10, 90.0), ("i", 1, "b", 20, 0, 10, 10, 90.0)], WORDS)
    z = spark.createDataFrame([("i", "f", 10, 0, 10, 10)], "image_id string, field string, z_left int, z_top int, z_width int, z_height int")
    assert zones.words_in_zone(w, z).count() == 0  # touching is not meeting


def test_templates_and_bad_files(spark, tmp_path):
    (tmp_path / "good.yaml").write_text("huella_texto_clave: [Monto, Bs]\nesqueleto_estructural:\n  regiones_esperadas:\n    - {nombre: h, left_rel: 0.1, top_rel: 0.1, width_rel: 0.5, height_rel: 0.2}\ncampos:\n  monto: {left: 1, top: 2, width: 3, height: 4, psm_mode: '7', regex_validacion: ['a'], palabras_clave_cercanas: [Monto]}\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    anchors, regions, fields, skipped = io.load_templates(spark, str(tmp_path))
    assert sorted(r["anchor"] for r in anchors.collect()) == ["Bs", "Monto"]
    assert regions.first()["name"] == "h" and fields.first()["keywords"] == ["Monto"]
    assert [r["template"] for r in skipped.collect()] == ["bad"]


def test_images_are_listed_by_suffix(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.txt", "sub/d.tiff"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["stem"] for r in io.image_manifest(spark, str(tmp_path)).collect()) == ["a", "b", "d"]


def feedback_rows(spark, n):
    rows = [(f"i{k}", "monto", "003039965664", "v", "otro") for k in range(n)]
    return spark.createDataFrame(rows, "id_unico_imagen string, campo_nombre string, raw_ocr_output string, valor_corregido string, causa_raiz string")


def test_feedback_keeps_leading_zeros(spark, tmp_path):
    path = str(tmp_path / "fb")
    assert io.read_feedback(spark, path).count() == 0
    io.append_feedback(feedback_rows(spark, 2), path)
    io.append_feedback(feedback_rows(spark, 1), path)
    assert {r["raw_ocr_output"] for r in io.read_feedback(spark, path).collect()} == {"003039965664"}
    assert io.read_feedback(spark, path).count() == 3


def test_retraining_stream_counts_once(spark, tmp_path):
    source, model, archive, state = (str(tmp_path / x) for x in ("fb", "model", "archive", "state"))
    for n in (2, 3):
        io.append_feedback(feedback_rows(spark, n), source)
        jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()
    jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()
    entries, _ = io.read_model(spark, f"{model}/batch=1")
    assert entries.first()["total"] == 5
    assert entries.first()["adjustment"] == pytest.approx(-2 * (1 - 0.5**5))
    assert spark.read.option("header", True).csv(archive).count() == 5


def test_a_batch_that_failed_after_its_model_is_archived_once_more(spark, tmp_path):
    """Without its mark a batch runs again in whole; without the model before it, it fails."""
    import shutil

    source, model, archive, state = (str(tmp_path / x) for x in ("fb", "model", "archive", "state"))
    io.append_feedback(feedback_rows(spark, 2), source)
    jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()
    for lost in (f"{model}/batch=0/done", archive, f"{state}/commits"):
        shutil.rmtree(lost)
    jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()
    assert io.read_model(spark, f"{model}/batch=0")[0].first()["total"] == 2
    assert spark.read.options(**io.CSV).csv(archive).count() == 2
    shutil.rmtree(model)
    io.append_feedback(feedback_rows(spark, 1), source)
    with pytest.raises(Exception, match="missing"):
        jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()


def test_fold_counts_all_rows_of_a_frequent_key(spark):
    n = learning.FOLD_ROWS + 500
    f = spark.range(n).selectExpr("'i' AS id_unico_imagen", "'monto' AS campo_nombre", "'a' AS raw_ocr_output", "'v' AS valor_corregido", "'otro' AS causa_raiz", "timestamp_seconds(id) AS timestamp_feedback", "id AS seq")
    r = learning.confidence_fold(f).first()
    assert (r["n"], r["adjustment"]) == (n, pytest.approx(-2.0))


def test_model_survives_json_and_missing_values_survive_csv(spark, tmp_path):
    rows = [("i", "f", "", "a", "c"), ("i", "f", "", "a", "d"), ("i", "f", "x", "", "c"), ("i", "f", None, "a", "c")]
    path = str(tmp_path / "fb")
    io.append_feedback(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in learning.COLUMNS)), path)
    f = io.read_feedback(spark, path)
    assert sorted(map(str, f.select(*learning.COLUMNS).collect())) == sorted(map(str, spark.createDataFrame(rows, f.select(*learning.COLUMNS).schema).collect()))
    model = learning.build_model(f.withColumn("timestamp_feedback", F.to_timestamp("timestamp_feedback")), None)
    entries, corrections = io.model_from_json(io.model_json(model))
    key = ["field", "raw", "correction", "cause", "count"]
    assert sorted(map(str, corrections.select(key).collect())) == sorted(map(str, model[1].select(key).collect()))
    assert sorted(map(str, entries.select("field", "raw", "total", "adjustment").collect())) == sorted(map(str, model[0].select("field", "raw", "total", "adjustment").collect()))


def test_one_decimal_rounds_ties_to_even(spark):
    rows = [(x,) for x in (1.25, 1.75, -1.25, 2.0, 1.26, 0.05, 2.5)]
    assert values(spark, quality.one_decimal(F.col("x")), rows, "x double") == ["1.2", "1.8", "-1.2", "2.0", "1.3", "0.1", "2.5"]


def test_extraction_stream(spark, tmp_path):
    w = spark.createDataFrame(list(random_receipts(10)), WORDS)
    wide = words.collect_ocr(w)
    wide.write.json(str(tmp_path / "in"))
    q = jobs.extract_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("extracted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("extracted").count() == jobs.extract_rows(wide).count() > 0
