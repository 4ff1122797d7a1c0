"""Queries over the receipt operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fields import ADJUSTMENTS, CAUSE_ADVICE, EXPANSION, FIELD_ADVICE, FLEXIBLE, GENERAL_SCAN, RESERVED_CORRECTIONS, TEMPLATE, TEMPLATE_ANCHORS, TEMPLATE_FIELDS, TEMPLATE_REGIONS, ZONES_FIXED, ZONES_V1
from ..functions import text as X
from ..operators import extract, learning, quality, reports, words, zones
from ..sources import io
from ..streaming import jobs
from . import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows(values) -> str:
    one = lambda v: q(v) if isinstance(v, str) else "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values)


W, FB, PX = fx.WORDS_ORACLE, fx.FEEDBACK_ORACLE, fx.PIXELS_ORACLE
OKTEXT = "trim(text) <> ''"
FIXED_DEFS = rows([(f, k) for f, k, _ in ZONES_FIXED])
FLEX_DEFS = rows([(f, k, p, dx, dy) for f, k, p, dx, dy, _ in FLEXIBLE])
ADJ = "coalesce(CASE causa_raiz " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ADJUSTMENTS.items()) + " END, 0.0)"


def flexible_defs(spark):
    return zones.field_table(spark, [(f, k, p, dx, dy) for f, k, p, dx, dy, _ in FLEXIBLE], "field string, keywords array<string>, regex string, max_dx int, max_dy int")


def fixed_defs(spark):
    return zones.field_table(spark, [(f, k) for f, k, _ in ZONES_FIXED], "field string, keywords array<string>")


def both(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    return w, fx.images(w)


# words

@query("S2_explode_ocr", W + ' SELECT image_id, word_idx, text, "left", top, conf FROM words')
def _(spark, d):
    return words.explode_ocr(words.collect_ocr(fx.words(spark, d))).select("image_id", "word_idx", "text", "left", "top", "conf")


@query("P1_valid_words", W + f" SELECT image_id, word_idx, text FROM words WHERE conf::INT > 0 AND {OKTEXT}")
def _(spark, d):
    return words.valid_words(fx.words(spark, d)).select("image_id", "word_idx", "text")


@query("P2_bounding_boxes", W + f' SELECT image_id, word_idx, "left" + width AS "right", top + height AS bottom FROM words WHERE conf::INT >= 85 AND {OKTEXT}')
def _(spark, d):
    return words.bounding_boxes(fx.words(spark, d), 85).select("image_id", "word_idx", "right", "bottom")


@query("P3_word_list", W + f' SELECT image_id, word_idx, trim(text) AS text, "left", top, width, height, conf::INT AS conf, "left" + width // 2 AS x, top + height // 2 AS y FROM words WHERE conf::INT > 20 AND {OKTEXT}')
def _(spark, d):
    return words.word_list(fx.words(spark, d))


@query("A1_ocr_summary", W + f", v AS (SELECT image_id, count(*) AS n, avg(conf::INT) AS c FROM words WHERE conf::INT > 0 AND {OKTEXT} GROUP BY image_id) SELECT image_id, coalesce(n, 0) AS words_detected, coalesce(c, 0) AS average_confidence, length(full_text) AS text_length FROM images LEFT JOIN v USING (image_id)")
def _(spark, d):
    return words.ocr_summary(*both(spark, d))


@query("A2_region_text", W + f", k AS (SELECT *, conf > 60 AND {OKTEXT} AS ok FROM words) SELECT image_id, coalesce(string_agg(trim(text), ' ' ORDER BY word_idx) FILTER (WHERE ok), '') AS raw_text, coalesce(avg(conf) FILTER (WHERE ok), 0) AS confidence, count(*) FILTER (WHERE ok) AS word_count FROM k GROUP BY image_id")
def _(spark, d):
    return words.region_text(fx.words(spark, d), ["image_id"])


@query("A3_average_confidence", W + " SELECT image_id, coalesce(avg(conf::INT) FILTER (WHERE conf::INT > 0), 0) AS average_confidence FROM words GROUP BY image_id")
def _(spark, d):
    return words.average_confidence(fx.words(spark, d))


@query("O1_reading_order", W + " SELECT image_id, string_agg(text, ' ' ORDER BY top, \"left\", word_idx) AS ordered_text FROM words GROUP BY image_id")
def _(spark, d):
    return words.reading_order(fx.words(spark, d))


@query("J9_unused_words", W + " SELECT image_id, count(*) AS n, string_agg(text, ' ' ORDER BY word_idx) AS unused FROM words w WHERE NOT EXISTS (SELECT 1 FROM words u WHERE u.image_id = w.image_id AND u.word_idx = w.word_idx AND u.conf > 80) GROUP BY image_id")
def _(spark, d):
    w = fx.words(spark, d)
    left = words.unused_words(w, w.filter("conf > 80"))
    listed = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    return left.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("unused"))


@query("A12_extraction_efficiency", W + f", p AS (SELECT image_id, count(*) AS words_processed FROM words WHERE conf::INT > 20 AND {OKTEXT} GROUP BY image_id), u AS (SELECT image_id, count(DISTINCT word_idx) AS words_used FROM words WHERE conf > 90 GROUP BY image_id) SELECT image_id, words_processed, coalesce(words_used, 0) AS words_used, coalesce(words_used, 0) / words_processed AS efficiency FROM p LEFT JOIN u USING (image_id)")
def _(spark, d):
    w = fx.words(spark, d)
    used = w.filter("conf > 90").groupBy("image_id").agg(F.concat(F.collect_list("word_idx"), F.collect_list("word_idx")).alias("used"))
    return words.extraction_efficiency(used, w)


# scalars

@query("X1_clean_text", W + " SELECT image_id, trim(regexp_replace(concat(' ', text, '  ', text, chr(9)), '\\s+', ' ', 'g')) AS clean FROM words")
def _(spark, d):
    return fx.words(spark, d).select("image_id", X.clean_text(F.concat(F.lit(" "), "text", F.lit("  "), "text", F.lit("\t"))).alias("clean"))


AMOUNT = "(SELECT text, regexp_replace(text, '[^0-9.,]', '', 'g') AS t FROM (SELECT DISTINCT text FROM words))"


@query("X2_normalize_amount", W + f", a AS (SELECT text, CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(t, ',', '') ELSE replace(t, ',', '.') END AS v FROM {AMOUNT}) SELECT text, CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN v END AS amount FROM a")
def _(spark, d):
    return fx.words(spark, d).select("text").distinct().select("text", X.normalize_amount(F.col("text")).alias("amount"))


def _validated() -> str:
    t = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
    amount = f"regexp_replace({t}, '[^0-9.,]', '', 'g')"
    amount = f"CASE WHEN contains({amount}, ',') AND contains({amount}, '.') THEN replace({amount}, ',', '') ELSE replace({amount}, ',', '.') END"
    parts = []
    for f, _, p in EXPANSION:
        ok = f"regexp_matches({t}, {q('(?i)' + p)})"
        v = {"monto": f"CASE WHEN {ok} AND try_cast({amount} AS DOUBLE) IS NOT NULL THEN {amount} END", "fecha": f"CASE WHEN {ok} AND regexp_matches({t}, '^\\d{{2}}[/-]\\d{{2}}[/-]\\d{{2,4}}') THEN {t} END", "operacion": f"CASE WHEN {ok} AND length(regexp_replace({t}, '[^0-9]', '', 'g')) >= 10 THEN {t} END"}.get(f, f"CASE WHEN {ok} THEN {t} END")
        parts.append(f"SELECT {q(f)} AS field, count({v}) AS n, min({v}) AS low, max({v}) AS high FROM words")
    return W + " " + " UNION ALL ".join(parts)


@query("X3_validate_field", _validated())
def _(spark, d):
    """Each text is read once for all fields, and no row is made for each of them."""
    t = fx.words(spark, d).select(X.clean_text(F.col("text")).alias("t"))
    v = t.select(*[X.value_of(F.col("t"), f, p).alias(f) for f, _, p in EXPANSION])
    one = v.agg(*[F.struct(F.lit(f).alias("field"), F.count(f).alias("n"), F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f, *_ in EXPANSION])
    return one.select(F.inline(F.array(*[f for f, *_ in EXPANSION])))


@query("X4_fullmatch", W + f", f(field, keywords, pattern, dx, dy) AS (VALUES {FLEX_DEFS}) SELECT field, count(*) AS n, count(DISTINCT text) AS texts FROM words, f WHERE regexp_matches(text, pattern) GROUP BY field")
def _(spark, d):
    w = fx.words(spark, d).crossJoin(zones.small(flexible_defs(spark))).filter(X.fullmatch(F.col("text"), F.col("regex")))
    return w.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts"))


@query("X5_confidence_adjustment", FB + f" SELECT causa_raiz, {ADJ} AS adjustment, count(*) AS n FROM feedback GROUP BY ALL")
def _(spark, d):
    return fx.feedback(spark, d).groupBy("causa_raiz", X.confidence_adjustment(F.col("causa_raiz")).alias("adjustment")).agg(F.count(F.lit(1)).alias("n"))


@query("X6_parse_orientation", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0.0 ELSE CAST(o_orderkey % 4 * 90 AS DOUBLE) END AS angle FROM orders")
def _(spark, d):
    o = fx.read(spark, d, "orders")
    text = F.concat(F.lit("Page number: 0\nOrientation in degrees: 270\n"), F.when(F.col("o_orderkey") % 5 != 4, F.concat(F.lit("Rotate: "), (F.col("o_orderkey") % 4 * 90).cast("string"), F.lit("\n"))).otherwise(""), F.lit("Script: Latin\n"))
    return o.select("o_orderkey", X.parse_orientation(text).alias("angle"))


@query("X8_charset_filter", W + " SELECT image_id, word_idx, nullif(regexp_replace(text, '[^0-9.,\\-]', '', 'g'), '') AS monto, nullif(regexp_replace(text, '[^0-9/\\-:]', '', 'g'), '') AS fecha, nullif(regexp_replace(text, '[^0-9A-Za-z.,:\\-/() ]', '', 'g'), '') AS other FROM words")
def _(spark, d):
    f = lambda name: X.charset_filter(F.col("text"), F.lit(name))
    return fx.words(spark, d).select("image_id", "word_idx", f("monto").alias("monto"), f("fecha").alias("fecha"), f("concepto").alias("other"))


# joins, zones and templates

BOXES = f", defs(field, keywords) AS (VALUES {FIXED_DEFS}), boxes AS (SELECT * FROM (SELECT w.*, field, list_filter(keywords, lambda k: contains(lower(text), lower(k)))[1] AS keyword FROM words w, defs WHERE conf::INT >= 20 AND {OKTEXT}) WHERE keyword IS NOT NULL)"


@query("J1_keyword_boxes", W + BOXES + " SELECT image_id, field, word_idx, keyword FROM boxes")
def _(spark, d):
    return zones.keyword_boxes(fx.words(spark, d), fixed_defs(spark).select("field", "keywords")).select("image_id", "field", "word_idx", "keyword")


@query("J2_anchor_points", W + f", f(ord, field, keywords) AS (VALUES {rows([(i, f, k) for i, (f, k, _) in enumerate(EXPANSION)])}), h AS (SELECT image_id, field, \"left\" + width // 2 AS x, top + height // 2 AS y, count(*) AS n FROM words, (SELECT field, unnest(keywords) AS kw FROM f) k WHERE contains(lower(text), lower(kw)) GROUP BY ALL) SELECT image_id, field, coalesce(x, 400) AS x, coalesce(y, 300) AS y, coalesce(n, 0) AS n_anchors FROM (SELECT image_id, field FROM images, f) LEFT JOIN h USING (image_id, field)")
def _(spark, d):
    w, im = both(spark, d)
    defs = zones.field_table(spark, [(f, k) for f, k, _ in EXPANSION], "field string, keywords array<string>")
    return zones.anchor_points(w, im, defs).select("image_id", "field", "x", "y", "n_anchors")


NEAR = BOXES + f', near AS (SELECT b.*, v.word_idx AS v_idx, v.text AS v_text, v."left" AS v_left, v.top AS v_top, v.width AS v_width, v.height AS v_height, v.conf::INT AS v_conf, sqrt(pow(v."left" + v.width / 2 - b."left" - b.width / 2, 2) + pow(v.top + v.height / 2 - b.top - b.height / 2, 2)) AS distance FROM boxes b JOIN words v USING (image_id) WHERE v.conf::INT >= 20 AND trim(v.text) <> \'\' AND pow(v."left" + v.width / 2 - b."left" - b.width / 2, 2) + pow(v.top + v.height / 2 - b.top - b.height / 2, 2) <= 150 * 150)'


@query("J3_nearby_values", W + NEAR + " SELECT image_id, field, word_idx, count(*) AS n, CAST(sum(v_idx) AS BIGINT) AS words, round(sum(distance), 4) AS distance FROM near GROUP BY ALL")
def _(spark, d):
    near = zones.keyword_neighbours(fx.words(spark, d), fixed_defs(spark).select("field", "keywords"), 150)
    return near.select("image_id", "field", "word_idx", "n", "words", F.round("distance", 4).alias("distance"))


ANCHORS = W + f", f(field, keywords, pattern, dx, dy) AS (VALUES {FLEX_DEFS}), pw AS (SELECT image_id, word_idx, trim(text) AS text, \"left\", top, width, height, conf::INT AS conf, top + height // 2 AS y FROM words WHERE conf::INT > 20 AND {OKTEXT}), anchor AS (SELECT * FROM (SELECT pw.*, field, pattern, dx, dy FROM pw, f WHERE conf > 70 AND len(list_filter(keywords, lambda k: contains(lower(text), lower(k)))) > 0) QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY word_idx) = 1), zone AS (SELECT image_id, field, pattern, word_idx AS anchor_idx, \"left\" + width AS zl, top AS zt, dx AS zw, dy + height AS zh FROM anchor), inzone AS (SELECT pw.*, field, pattern, anchor_idx FROM pw JOIN zone USING (image_id) WHERE \"left\" < zl + zw AND \"left\" + width > zl AND top < zt + zh AND top + height > zt)"


@query("W2_first_anchor", ANCHORS + " SELECT image_id, field, word_idx, text FROM anchor")
def _(spark, d):
    return zones.first_anchor(words.word_list(fx.words(spark, d)), flexible_defs(spark)).select("image_id", "field", "word_idx", "text")


@query("J4_words_in_zone", ANCHORS + " SELECT image_id, field, count(*) AS n, CAST(sum(word_idx) AS BIGINT) AS words FROM inzone GROUP BY ALL")
def _(spark, d):
    w, defs = words.word_list(fx.words(spark, d)), flexible_defs(spark)
    inside = zones.words_in_zone(w, zones.after_anchor(zones.first_anchor(w, defs), defs))
    return inside.groupBy("image_id", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("word_idx").alias("words"))


@query("J4_words_in_zone_grid", ANCHORS + " SELECT image_id, field, count(*) AS n, CAST(sum(word_idx) AS BIGINT) AS words FROM inzone GROUP BY ALL")
def _(spark, d):
    """The same pairs over a grid, as for pages with many zones."""
    w, defs = words.word_list(fx.words(spark, d)), flexible_defs(spark)
    inside = zones.words_in_zone(w, zones.after_anchor(zones.first_anchor(w, defs), defs), cell=128)
    return inside.groupBy("image_id", "field").agg(F.count(F.lit(1)).alias("n"), F.sum("word_idx").alias("words"))


@query("W3_best_value_in_zone", ANCHORS + " SELECT image_id, field, text AS value, conf AS confidence FROM inzone WHERE conf > 50 AND word_idx <> anchor_idx AND regexp_matches(text, pattern) QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY conf DESC, word_idx) = 1")
def _(spark, d):
    w, defs = words.word_list(fx.words(spark, d)), flexible_defs(spark)
    found = zones.best_value_in_zone(w, zones.after_anchor(zones.first_anchor(w, defs), defs), patterns=[p for _, _, p, *_ in FLEXIBLE])
    return found.select("image_id", "field", F.col("text").alias("value"), F.col("conf").alias("confidence"))


TWO_WORDS = r"^[A-Za-z]+: .+$"


@query("W4_multiword_spans", ANCHORS + f", o AS (SELECT *, row_number() OVER w AS s, list({{'t': text, 'y': y, 'c': conf}}) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM inzone WHERE conf > 50 AND word_idx <> anchor_idx AND field IN ('banco_completo', 'concepto') WINDOW w AS (PARTITION BY image_id, field ORDER BY top, \"left\", word_idx)), n AS (SELECT *, run[1 : k] AS r FROM (SELECT *, unnest(range(1, len(run) + 1)) AS k FROM o)), v AS (SELECT image_id, field, s, k, array_to_string(list_transform(r, lambda x: x.t), ' ') AS value, list_avg(list_transform(r, lambda x: x.c)) AS confidence, list_max(list_transform(r, lambda x: x.y)) - list_min(list_transform(r, lambda x: x.y)) AS dy FROM n) SELECT image_id, field, value, confidence FROM v WHERE dy <= 30 AND regexp_matches(value, {q(TWO_WORDS)}) QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY confidence DESC, s, k) = 1")
def _(spark, d):
    w = words.word_list(fx.words(spark, d))
    defs = flexible_defs(spark).filter("field in ('banco_completo', 'concepto')")
    zone = zones.after_anchor(zones.first_anchor(w, defs), defs).withColumn("regex", F.lit(TWO_WORDS))
    return zones.multiword_spans(w, zone).select("image_id", "field", "value", "confidence")


NEAREST = NEAR + ", nearest AS (SELECT * FROM near WHERE lower(v_text) <> lower(text) QUALIFY row_number() OVER (PARTITION BY image_id, field, word_idx ORDER BY distance, v_idx) = 1)"


@query("W5_nearest_value", W + NEAREST + " SELECT image_id, field, word_idx, v_idx, v_text FROM nearest")
def _(spark, d):
    near = zones.keyword_neighbours(fx.words(spark, d), fixed_defs(spark).select("field", "keywords"), 150)
    return near.filter("v_idx is not null").select("image_id", "field", "word_idx", "v_idx", "v_text")


V1 = f", f(field, keywords, place, zw) AS (VALUES {rows(ZONES_V1)}), k AS (SELECT field, place, zw, unnest(keywords) AS kw, generate_subscripts(keywords, 1) AS ki FROM f), h AS (SELECT image_id, field, ki, word_idx, conf::INT AS confidence, lower(text) AS keyword_found, greatest(0, CASE WHEN place = 'beside' THEN \"left\" + width + 10 ELSE \"left\" END) AS l, greatest(0, CASE WHEN place = 'beside' THEN top ELSE top + height + 5 END) AS t, zw, CASE WHEN place = 'beside' THEN height + 10 ELSE 30 END AS zh FROM words, k WHERE conf::INT > 20 AND {OKTEXT} AND contains(lower(text), kw)), v1 AS (SELECT image_id, field, l AS \"left\", t AS top, least(zw, 800 - l) AS width, least(zh, 600 - t) AS height, confidence, keyword_found FROM h WHERE least(zw, 800 - l) > 0 AND least(zh, 600 - t) > 0 QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY confidence DESC, ki, word_idx) = 1)"


@query("C2_dynamic_zones_v1", W + V1 + " SELECT * FROM v1")
def _(spark, d):
    return zones.dynamic_zones_v1(*both(spark, d))


FIXED = NEAREST + f", z AS (SELECT image_id, field, greatest(0, v_left - 5) AS l, greatest(0, v_top - 5) AS t, v_width + 10 AS w0, v_height + 10 AS h0, v_conf, v_text, word_idx FROM nearest), bestz AS (SELECT image_id, field, l, t, least(800 - l, w0) AS w, least(600 - t, h0) AS h, v_conf, v_text FROM z WHERE least(800 - l, w0) > 0 AND least(600 - t, h0) > 0 QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY v_conf DESC, word_idx) = 1), fb(field, x, y, rw, rh) AS (VALUES {rows([(f, *[int(a * b) for a, b in zip((800, 600, 800, 600), r, strict=True)]) for f, _, r in ZONES_FIXED])}), c3 AS (SELECT image_id, field, coalesce(l, x) AS \"left\", coalesce(t, y) AS top, coalesce(w, least(rw, 800 - x)) AS width, coalesce(h, least(rh, 600 - y)) AS height, coalesce(v_conf, 30) AS confidence, v_text AS detected_text, CASE WHEN l IS NULL THEN 'fallback_relative_position' ELSE 'value_box_direct' END AS method FROM (SELECT image_id, fb.* FROM images, fb) LEFT JOIN bestz USING (image_id, field))"


@query("C3_dynamic_zones_fixed", W + FIXED + " SELECT * FROM c3")
def _(spark, d):
    return zones.dynamic_zones_fixed(*both(spark, d))


TEXT = f", an(a) AS (VALUES {rows([(a,) for a in TEMPLATE_ANCHORS])}), ts AS (SELECT image_id, avg(CAST(contains(upper(full_text), upper(a)) OR EXISTS (SELECT 1 FROM words w WHERE w.image_id = i.image_id AND contains(upper(w.text), upper(a))) AS INT)) AS text_score FROM images i, an GROUP BY image_id)"
STRUCTURE = f", rg AS (SELECT name, CAST(trunc(xl * 800) AS INT) AS rl, CAST(trunc(xt * 600) AS INT) AS rt, CAST(trunc(xw * 800) AS INT) AS rw, CAST(trunc(xh * 600) AS INT) AS rh FROM (SELECT name, xl::DOUBLE AS xl, xt::DOUBLE AS xt, xw::DOUBLE AS xw, xh::DOUBLE AS xh FROM (VALUES {rows(TEMPLATE_REGIONS)}) v(name, xl, xt, xw, xh))), ss AS (SELECT image_id, avg(hit) AS structural_score FROM (SELECT i.image_id, name, max(CASE WHEN greatest(0, least(\"left\" + width, rl + rw) - greatest(\"left\", rl)) * greatest(0, least(top + height, rt + rh) - greatest(top, rt)) > 0.3 * rw * rh THEN 1 ELSE 0 END) AS hit FROM images i CROSS JOIN rg JOIN words w ON w.image_id = i.image_id AND conf::INT > 30 GROUP BY ALL) GROUP BY image_id)"
BEST = TEXT + STRUCTURE + f", best AS (SELECT image_id, {q(TEMPLATE)} AS template, text_score, structural_score, 0.6::DOUBLE * text_score + 0.4::DOUBLE * structural_score AS score FROM ts JOIN ss USING (image_id) WHERE 0.6::DOUBLE * text_score + 0.4::DOUBLE * structural_score >= 0.4::DOUBLE)"


@query("J5_text_anchor_score", W + TEXT + f" SELECT image_id, {q(TEMPLATE)} AS template, text_score FROM ts")
def _(spark, d):
    return zones.text_anchor_score(*both(spark, d), zones.template_tables(spark)[0])


@query("J6_structural_score", W + STRUCTURE + f" SELECT image_id, {q(TEMPLATE)} AS template, structural_score FROM ss")
def _(spark, d):
    return zones.structural_score(*both(spark, d), zones.template_tables(spark)[1])


@query("W1_best_template", W + BEST + " SELECT * FROM best")
def _(spark, d):
    return zones.best_template(*both(spark, d), *zones.template_tables(spark))


CAMPOS = [("monto", 150, 200, 200, 40), ("referencia", 150, 320, 250, 30)]


def campos(spark):
    return spark.createDataFrame([(TEMPLATE, *c) for c in CAMPOS], "template string, field string, left int, top int, width int, height int")


@query("J10_template_fields", W + BEST + f', cp(field, "left", top, width, height) AS (VALUES {rows(CAMPOS)}) SELECT template, image_id, score, field, "left", top, width, height FROM best, cp')
def _(spark, d):
    return zones.template_fields(zones.best_template(*both(spark, d), *zones.template_tables(spark)), campos(spark))


@query("C4_identify_template_or_zones", W + BEST + V1 + f', cp(field, "left", top, width, height) AS (VALUES {rows(CAMPOS)}) SELECT image_id, field, "left", top, width, height, template FROM best, cp UNION ALL SELECT image_id, field, "left", top, width, height, NULL FROM v1 WHERE image_id NOT IN (SELECT image_id FROM best)')
def _(spark, d):
    return zones.identify_template_or_zones(*both(spark, d), *zones.template_tables(spark), campos(spark))


@query("C4_identify_template_or_fixed_zones", W + BEST + FIXED + f', cp(field, "left", top, width, height) AS (VALUES {rows(TEMPLATE_FIELDS)}) SELECT image_id, field, "left", top, width, height, template FROM best, cp UNION ALL SELECT image_id, field, "left", top, width, height, NULL FROM c3 WHERE image_id NOT IN (SELECT image_id FROM best)')
def _(spark, d):
    """With the fields of the template that ships."""
    fields = spark.createDataFrame([(TEMPLATE, *c) for c in TEMPLATE_FIELDS], "template string, field string, left int, top int, width int, height int")
    return zones.identify_template_or_zones(*both(spark, d), *zones.template_tables(spark), fields, "fixed")


# many definitions: keywords and templates made from customers

MANY_KEYWORDS = "SELECT concat('n', CAST(c_nationkey AS STRING)) AS field, c_custkey, lpad(CAST(c_custkey * 7 AS STRING), 11, '0') AS keyword FROM {customer}"


@query("J1_many_keywords", W + f", kw AS ({MANY_KEYWORDS.replace('{customer}', 'customer')}), hit AS (SELECT t, field, arg_min(keyword, c_custkey) AS keyword FROM (SELECT DISTINCT lower(text) AS t FROM words) JOIN kw ON contains(t, keyword) GROUP BY ALL) SELECT image_id, field, word_idx, keyword FROM words JOIN hit ON lower(text) = t WHERE conf::INT >= 20")
def _(spark, d):
    """A keyword for each customer, by nation: one automaton."""
    k = spark.sql(MANY_KEYWORDS, customer=fx.read(spark, d, "customer")).groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    return zones.keyword_boxes(fx.words(spark, d), k).select("image_id", "field", "word_idx", "keyword")


CUSTOMER_TEMPLATE = "concat('T', lpad(CAST(c_custkey AS STRING), 7, '0'))"
MANY_ANCHORS = "lpad(CAST(c_custkey * 7 AS STRING), 11, '0'), concat('V-', lpad(CAST(c_custkey AS STRING), 8, '0'))"
MANY_REGIONS = [(f"r{k}", 0.1, round(0.2 + 0.01 * k, 2), 0.8, 0.2) for k in range(7)] + [("r7", 0.3, 0.7, 0.05, 0.03)]
MANY_SQL = f""", c AS (SELECT c_custkey, {CUSTOMER_TEMPLATE} AS template FROM customer), an AS (SELECT template, unnest(['Monto', 'Referencia', 'Banco', {MANY_ANCHORS}]) AS a FROM c),
hit AS (SELECT image_id, a FROM images, (SELECT DISTINCT a FROM an) WHERE contains(upper(full_text), upper(a))), ts AS (SELECT image_id, template, count(*) / 5 AS text_score FROM hit JOIN an USING (a) GROUP BY ALL),
rel AS (SELECT name, CAST(trunc(xl::DOUBLE * 800) AS INT) AS rl, CAST(trunc(xt::DOUBLE * 600) AS INT) AS rt, CAST(trunc(xw::DOUBLE * 800) AS INT) AS rw, CAST(trunc(xh::DOUBLE * 600) AS INT) AS rh FROM (VALUES {rows(MANY_REGIONS)}) v(name, xl, xt, xw, xh)),
cover AS (SELECT DISTINCT image_id, name FROM words, rel WHERE conf::INT > 30 AND greatest(0, least("left" + width, rl + rw) - greatest("left", rl)) * greatest(0, least(top + height, rt + rh) - greatest(top, rt)) > 0.3 * rw * rh),
own AS (SELECT template, 'r' || (c_custkey % 7) AS name FROM c UNION ALL SELECT template, 'r7' FROM c), ss AS (SELECT image_id, template, count(*) / 2 AS structural_score FROM cover JOIN own USING (name) GROUP BY ALL),
every AS (SELECT image_id, template, coalesce(text_score, 0) AS text_score, coalesce(structural_score, 0) AS structural_score FROM ts FULL JOIN ss USING (image_id, template))
SELECT *, 0.6::DOUBLE * text_score + 0.4::DOUBLE * structural_score AS score FROM every WHERE 0.6::DOUBLE * text_score + 0.4::DOUBLE * structural_score >= 0.4::DOUBLE QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY 0.6::DOUBLE * text_score + 0.4::DOUBLE * structural_score DESC, template) = 1"""


@query("W1_many_templates", W + MANY_SQL)
def _(spark, d):
    """A template for each customer: an index, and regions tested only where a template can win."""
    c = fx.read(spark, d, "customer").select("c_custkey", F.expr(CUSTOMER_TEMPLATE).alias("template"))
    anchors = c.select("template", F.explode(F.expr(f"array('Monto', 'Referencia', 'Banco', {MANY_ANCHORS})")).alias("anchor"))
    own = c.select("template", F.explode(F.array(F.concat(F.lit("r"), (F.col("c_custkey") % 7).cast("string")), F.lit("r7"))).alias("name"))
    rel = spark.createDataFrame(MANY_REGIONS, "name string, left_rel double, top_rel double, width_rel double, height_rel double")
    return zones.best_template(*both(spark, d), anchors, own.join(F.broadcast(rel), "name"))


@query("O3_combine_phases", ANCHORS + ", a AS (SELECT image_id, field, text AS value FROM anchor WHERE conf > 90), g AS (SELECT image_id, field, text AS value FROM anchor) SELECT * FROM a UNION ALL SELECT * FROM g WHERE (image_id, field) NOT IN (SELECT (image_id, field) FROM a)")
def _(spark, d):
    a = zones.first_anchor(words.word_list(fx.words(spark, d)), flexible_defs(spark))
    pick = lambda df: df.select("image_id", "field", F.col("text").alias("value"))
    return extract.combine_phases(pick(a.filter("conf > 90")), pick(a))


# extraction jobs

def _value(t: str) -> str:
    """The value of a field's cleaned text ``t``, by field."""
    digits = f"regexp_replace({t}, '[^0-9.,]', '', 'g')"
    amount = f"CASE WHEN contains({digits}, ',') AND contains({digits}, '.') THEN replace({digits}, ',', '') ELSE replace({digits}, ',', '.') END"
    rules = {"monto": f"try_cast({amount} AS DOUBLE) IS NOT NULL", "fecha": f"regexp_matches({t}, '^\\d{{2}}[/-]\\d{{2}}[/-]\\d{{2,4}}')", "operacion": f"length(regexp_replace({t}, '[^0-9]', '', 'g')) >= 10"}
    return "CASE field " + " ".join(f"WHEN {q(f)} THEN CASE WHEN regexp_matches({t}, {q('(?i)' + p)}) AND {rules.get(f, 'true')} THEN {amount if f == 'monto' else t} END" for f, _, p in EXPANSION) + " END"


EXPANDED = W + f", f(ord, field, keywords) AS (VALUES {rows([(i, f, k) for i, (f, k, _) in enumerate(EXPANSION)])}), kws AS (SELECT field, unnest(keywords) AS kw, generate_subscripts(keywords, 1) AS ki FROM f), pts AS (SELECT image_id, field, \"left\" + width // 2 AS x, top + height // 2 AS y, count(*) AS n, min((word_idx, ki)) AS first FROM words, kws WHERE contains(lower(text), lower(kw)) GROUP BY ALL), a AS (SELECT image_id, field, coalesce(x, 400) AS x, coalesce(y, 300) AS y, coalesce(n, 0) AS n, coalesce(first, (0, 0)) AS first FROM (SELECT image_id, field FROM images, f) LEFT JOIN pts USING (image_id, field)), cw AS (SELECT image_id, word_idx, \"left\" + width // 2 AS x, top + height // 2 AS y, conf, trim(regexp_replace(text, '[^0-9.,\\-]', '', 'g')) AS monto, trim(regexp_replace(text, '[^0-9/\\-:]', '', 'g')) AS fecha, trim(regexp_replace(text, '[^0-9A-Za-z.,:\\-/() ]', '', 'g')) AS other FROM words WHERE conf > 60), near AS (SELECT a.image_id, field, a.x, a.y, first, word_idx, conf, CASE field WHEN 'monto' THEN monto WHEN 'fecha' THEN fecha ELSE other END AS t, greatest(abs(cw.x - a.x), abs(cw.y - a.y)) AS far FROM a JOIN cw USING (image_id)), r AS (SELECT image_id, field, x, y, first, radius, string_agg(t, ' ' ORDER BY word_idx) AS raw_text, sum(conf) / count(*) AS confidence FROM near JOIN (SELECT unnest([50, 75, 100, 125, 150]) AS radius) ON far <= radius WHERE t <> '' GROUP BY ALL), v AS (SELECT *, {_value("trim(regexp_replace(raw_text, '\\s+', ' ', 'g'))")} AS value FROM r), one AS (SELECT * FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id, field, x, y ORDER BY confidence > 85 DESC, CASE WHEN confidence > 85 THEN radius END, confidence DESC, radius) = 1), best AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY image_id, field ORDER BY confidence DESC, first) = 1)"


@query("C6_extract_fields_expansion", EXPANDED + " SELECT image_id, field, CAST(sum(n) AS BIGINT) AS anchor_points_found, coalesce(any_value(confidence) >= 60, false) AS extraction_successful, CASE WHEN any_value(confidence) >= 60 THEN any_value(value) END AS value, round(coalesce(any_value(confidence), 0), 6) AS confidence, any_value(radius) AS radius, any_value(raw_text) AS raw_text, CASE WHEN any_value(value) IS NULL THEN 'No se encontró valor válido' WHEN any_value(confidence) < 60 THEN 'Confianza insuficiente' END AS reason FROM (SELECT image_id, field, n FROM a) LEFT JOIN best USING (image_id, field) GROUP BY image_id, field")
def _(spark, d):
    return extract.extract_fields_expansion(*both(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("W8_best_expansion", EXPANDED + " SELECT image_id, field, value, round(confidence, 6) AS confidence, radius, confidence >= 60 AS extraction_successful FROM best")
def _(spark, d):
    """The same choice as C6's, of fields with a value."""
    best = extract.best_regions(*both(spark, d)).filter("value is not null")
    return best.select("image_id", "field", "value", F.round("confidence", 6).alias("confidence"), "radius", (F.col("confidence") >= 60).alias("extraction_successful"))


def _folded() -> str:
    """C1 as tables: for each field in turn its anchors, zone words, values, and the words used so far."""
    parts = [W + f", pw AS MATERIALIZED (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY word_idx) - 1 AS INT) AS i, trim(text) AS text, \"left\", top, width, height, conf::INT AS conf, top + height // 2 AS y FROM words WHERE conf::INT > 20 AND {OKTEXT}), u0 AS (SELECT image_id, i FROM pw WHERE false)"]
    for k, (name, keywords, pattern, dx, dy, multiword) in enumerate(FLEXIBLE):
        free = f"NOT EXISTS (SELECT 1 FROM u{k} u WHERE u.image_id = p.image_id AND u.i = p.i)"
        holds = " OR ".join(f"contains(lower(text), {q(x.lower())})" for x in keywords)
        parts.append(f"a{k} AS MATERIALIZED (SELECT * FROM pw p WHERE conf > 70 AND ({holds}) AND {free} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i) = 1)")
        parts.append(f"c{k} AS MATERIALIZED (SELECT p.*, a.text AS keyword FROM pw p JOIN a{k} a USING (image_id) WHERE p.conf > 50 AND p.i <> a.i AND p.\"left\" < a.\"left\" + a.width + {dx} AND p.\"left\" + p.width > a.\"left\" + a.width AND p.top < a.top + a.height + {dy} AND p.top + p.height > a.top AND {free})")
        one = f"SELECT image_id, text AS value, CAST(conf AS DOUBLE) AS confidence, \"left\", top, width, height, keyword FROM c{k} WHERE regexp_matches(text, {q(pattern)}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, i) = 1"
        parts.append(f"s{k} AS MATERIALIZED ({one})")
        if multiword:
            run = f"SELECT image_id, keyword, row_number() OVER w AS s, list({{'t': text, 'y': y, 'c': conf, 'l': \"left\", 'p': top, 'w': width, 'h': height}}) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM c{k} WINDOW w AS (PARTITION BY image_id ORDER BY top, \"left\", i)"
            spans = f"SELECT image_id, keyword, s, n, run[1 : n] AS r FROM (SELECT *, unnest(range(1, len(run) + 1)) AS n FROM ({run}))"
            of = lambda f, x: f"list_{f}(list_transform(r, lambda x: {x}))"
            best = f"SELECT * FROM (SELECT *, array_to_string(list_transform(r, lambda x: x.t), ' ') AS value, {of('avg', 'x.c')} AS confidence FROM ({spans})) WHERE {of('max', 'x.y')} - {of('min', 'x.y')} <= 30 AND regexp_matches(value, {q(pattern)}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, s, n) = 1"
            parts.append(f"v{k} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT image_id, value, confidence, {of('min', 'x.l')}, {of('min', 'x.p')}, {of('max', 'x.l + x.w')} - {of('min', 'x.l')}, {of('max', 'x.p + x.h')} - {of('min', 'x.p')}, keyword FROM ({best}) WHERE image_id NOT IN (SELECT image_id FROM s{k}))")
        else:
            parts.append(f"v{k} AS (SELECT * FROM s{k})")
        parts.append(f"u{k + 1} AS MATERIALIZED (SELECT * FROM u{k} UNION SELECT image_id, i FROM a{k} UNION SELECT p.image_id, p.i FROM pw p JOIN v{k} v USING (image_id) WHERE p.\"left\" BETWEEN v.\"left\" AND v.\"left\" + v.width AND p.top BETWEEN v.top AND v.top + v.height)")
    name, pattern, least = GENERAL_SCAN
    last = len(FLEXIBLE)
    parts.append(f"g AS (SELECT * FROM pw p WHERE conf >= {least} AND regexp_matches(text, {q(pattern)}) AND NOT EXISTS (SELECT 1 FROM u{last} u WHERE u.image_id = p.image_id AND u.i = p.i) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i) = 1)")
    found = " UNION ALL ".join(f"SELECT image_id, {q(f)} AS field, value, confidence, \"left\", top, width, height, keyword, 'keyword_anchored' AS method FROM v{k}" for k, (f, *_) in enumerate(FLEXIBLE))
    parts.append(f"found AS ({found} UNION ALL SELECT image_id, {q(name)}, text, CAST(conf AS DOUBLE), \"left\", top, width, height, NULL, 'general_scan' FROM g)")
    return ", ".join(parts)


FOUND = _folded()


@query("C1_extract_fields_flexible", FOUND + " SELECT * REPLACE (round(confidence, 6) AS confidence) FROM found")
def _(spark, d):
    return extract.extract_fields_flexible(fx.words(spark, d)).withColumn("confidence", F.round("confidence", 6))


FALLBACK = ["Monto", "Bs", "Total", "Referencia"]


@query("C5_identify_flexible", FOUND + f", n AS (SELECT image_id, count(*) FILTER (WHERE field IS NOT NULL) AS n FROM (SELECT DISTINCT image_id FROM pw) LEFT JOIN found USING (image_id) GROUP BY image_id), m AS (SELECT image_id, full_text, n, coalesce(n, 0) = 0 AND n IS NOT NULL AND ({' OR '.join(f'contains(lower(full_text), {q(k.lower())})' for k in FALLBACK)}) AS fits FROM images LEFT JOIN n USING (image_id)) SELECT image_id, CASE WHEN n IS NULL THEN 'flexible_zoi_v2_no_words' WHEN n > 0 THEN 'flexible_zoi_v2' WHEN fits THEN 'template_based_fallback' ELSE 'all_strategies_failed' END AS method, coalesce(n, 0) AS n_fields, CASE WHEN fits THEN {q(TEMPLATE)} END AS template FROM m")
def _(spark, d):
    w, im = both(spark, d)
    keywords = spark.createDataFrame([(TEMPLATE, k) for k in FALLBACK], "template string, keyword string")
    return extract.identify_flexible(w, im, keywords)


@query("J8_expansion_regions", W + f", f(ord, field, keywords) AS (VALUES {rows([(i, f, k) for i, (f, k, _) in enumerate(EXPANSION)])}), h AS (SELECT DISTINCT image_id, field, \"left\" + width // 2 AS x, top + height // 2 AS y FROM words, (SELECT field, unnest(keywords) AS kw FROM f) k WHERE contains(lower(text), lower(kw))), a AS (SELECT image_id, field, coalesce(x, 400) AS x, coalesce(y, 300) AS y FROM (SELECT image_id, field FROM images, f) LEFT JOIN h USING (image_id, field)) SELECT image_id, field, radius, count(*) AS words FROM a JOIN words w USING (image_id) JOIN (SELECT unnest([50, 75, 100, 125, 150]) AS radius) r ON greatest(abs(w.\"left\" + w.width // 2 - x), abs(w.top + w.height // 2 - y)) <= radius GROUP BY ALL")
def _(spark, d):
    w, im = both(spark, d)
    defs = zones.field_table(spark, [(f, k) for f, k, _ in EXPANSION], "field string, keywords array<string>")
    return extract.expansion_counts(w, im, defs)


FIELDS = "fields AS (SELECT image_id, CAST(word_idx AS VARCHAR) AS field, conf > 60 AS ok, CASE WHEN conf > 60 THEN text END AS value, conf FROM words)"


def derived_fields(spark, d):
    """One field for each word of a receipt."""
    w = fx.words(spark, d)
    return w.select("image_id", F.col("word_idx").cast("string").alias("field"), (F.col("conf") > 60).alias("extraction_successful"), F.when(F.col("conf") > 60, F.col("text")).alias("value"), F.col("conf").alias("confidence"))


@query("A4_extraction_statistics", W + f", {FIELDS} SELECT image_id, count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok) / count(*) * 100 AS extraction_rate, coalesce(avg(conf) FILTER (WHERE ok), 0) AS overall_confidence, CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'success' ELSE 'error' END AS status FROM fields GROUP BY image_id")
def _(spark, d):
    return extract.extraction_statistics(derived_fields(spark, d))


@query("X7_exit_code", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS code FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    status = F.when(k == 0, "success").when(k == 1, "low_confidence").when(k == 2, "validation_failed").otherwise("failed")
    return fx.read(spark, d, "orders").select("o_orderkey", X.exit_code(status).alias("code"))


# feedback and learning

@query("A5_feedback_statistics", FB + " SELECT 'all' AS kind, NULL AS key, count(*) AS entries, max(timestamp_feedback) AS last_feedback FROM feedback UNION ALL SELECT 'field', campo_nombre, count(*), max(timestamp_feedback) FROM feedback GROUP BY campo_nombre UNION ALL SELECT 'cause', causa_raiz, count(*), max(timestamp_feedback) FROM feedback GROUP BY causa_raiz")
def _(spark, d):
    return learning.feedback_statistics(fx.feedback(spark, d))


@query("O2_union_feedback", FB + " SELECT campo_nombre, causa_raiz, count(*) AS n, CAST(sum(seq) AS BIGINT) AS rows FROM (SELECT * FROM feedback WHERE causa_raiz = 'otro' UNION ALL SELECT * FROM feedback WHERE raw_ocr_output <> '') GROUP BY ALL")
def _(spark, d):
    f = fx.feedback(spark, d)
    both = learning.union_feedback(f.filter("causa_raiz = 'otro'"), f.filter("raw_ocr_output <> ''"))
    return both.groupBy("campo_nombre", "causa_raiz").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("rows"))


@query("A6_build_model", FB + " SELECT campo_nombre AS field, raw_ocr_output AS raw, valor_corregido AS correction, causa_raiz AS cause, count(*) AS count FROM feedback GROUP BY ALL")
def _(spark, d):
    return learning.build_model(fx.feedback(spark, d))[1].drop("first_seen")


FOLD = f", adj AS (SELECT campo_nombre AS field, raw_ocr_output AS raw, {ADJ} AS a, row_number() OVER (PARTITION BY campo_nombre, raw_ocr_output ORDER BY timestamp_feedback DESC, seq DESC) AS rn, seq FROM feedback WHERE {ADJ} <> 0)"


@query("W7_confidence_fold", FB + FOLD + " SELECT field, raw, count(*) AS n, round(sum(CASE WHEN rn <= 1100 THEN a * pow(0.5, rn) END), 6) AS adjustment FROM adj GROUP BY ALL")
def _(spark, d):
    return learning.confidence_fold(fx.feedback(spark, d)).withColumn("adjustment", F.round("adjustment", 6))


BESTC = f", bc AS (SELECT campo_nombre AS field, raw_ocr_output AS raw, valor_corregido AS correction, count(*) AS count FROM feedback WHERE valor_corregido NOT IN ({', '.join(map(q, RESERVED_CORRECTIONS))}) GROUP BY campo_nombre, raw_ocr_output, valor_corregido QUALIFY row_number() OVER (PARTITION BY campo_nombre, raw_ocr_output ORDER BY count(*) DESC, min((timestamp_feedback, seq)), valor_corregido) = 1)"


@query("W6_best_correction", FB + BESTC + " SELECT * FROM bc")
def _(spark, d):
    return learning.best_correction(learning.build_model(fx.feedback(spark, d))[1])


ENTRIES = f", folded AS (SELECT campo_nombre AS field, raw_ocr_output AS raw, sum(a * pow(0.5, rn)) AS adjustment FROM (SELECT *, {ADJ} AS a, row_number() OVER (PARTITION BY campo_nombre, raw_ocr_output ORDER BY timestamp_feedback DESC, seq DESC) AS rn FROM feedback WHERE {ADJ} <> 0) WHERE rn <= 1100 GROUP BY ALL), entries AS (SELECT t.*, coalesce(adjustment, 0) AS adjustment FROM (SELECT campo_nombre AS field, raw_ocr_output AS raw, count(*) AS total FROM feedback GROUP BY ALL) t LEFT JOIN folded USING (field, raw))"


@query("J7_apply_corrections", FB + BESTC + ENTRIES + " SELECT f.field, value, confidence, coalesce(correction, value) AS corrected_value, round(CASE WHEN correction IS NULL THEN confidence ELSE least(100, greatest(0, confidence + adjustment)) END, 6) AS corrected_confidence FROM (SELECT campo_nombre AS field, raw_ocr_output || CASE WHEN seq % 2 = 0 THEN '' ELSE '?' END AS value, CAST(40 + seq % 60 AS DOUBLE) AS confidence FROM feedback) f LEFT JOIN bc ON bc.field = f.field AND bc.raw = value LEFT JOIN entries e ON e.field = f.field AND e.raw = value")
def _(spark, d):
    f = fx.feedback(spark, d)
    fields = f.select(F.col("campo_nombre").alias("field"), F.concat("raw_ocr_output", F.when(F.col("seq") % 2 == 0, "").otherwise("?")).alias("value"), (40 + F.col("seq") % 60).cast("double").alias("confidence"))
    return learning.apply_corrections(fields, learning.build_model(f)).withColumn("corrected_confidence", F.round("corrected_confidence", 6))


@query("J7_filtered_join", FB + BESTC + ENTRIES + " SELECT f.field, value, confidence, coalesce(correction, value) AS corrected_value, round(CASE WHEN correction IS NULL THEN confidence ELSE least(100, greatest(0, confidence + adjustment)) END, 6) AS corrected_confidence FROM (SELECT campo_nombre AS field, raw_ocr_output || CASE WHEN seq % 2 = 0 THEN '' ELSE '?' END AS value, CAST(40 + seq % 60 AS DOUBLE) AS confidence FROM feedback) f LEFT JOIN bc ON bc.field = f.field AND bc.raw = value LEFT JOIN entries e ON e.field = f.field AND e.raw = value")
def _(spark, d):
    """The way of a large model: a key filter, and hot keys dealt out."""
    f = fx.feedback(spark, d)
    fields = f.select(F.col("campo_nombre").alias("field"), F.concat("raw_ocr_output", F.when(F.col("seq") % 2 == 0, "").otherwise("?")).alias("value"), (40 + F.col("seq") % 60).cast("double").alias("confidence"))
    return learning.apply_corrections(fields, learning.build_model(f), broadcast_keys=0).withColumn("corrected_confidence", F.round("corrected_confidence", 6))


@query("A7_merge_model", FB + ENTRIES + " SELECT field, raw, total, round(adjustment, 6) AS adjustment FROM entries")
def _(spark, d):
    f = fx.feedback(spark, d).withColumn("timestamp_feedback", F.col("timestamp_feedback"))
    at = f.agg(F.expr("percentile_approx(timestamp_feedback, 0.5)").alias("at"))
    f = f.crossJoin(F.broadcast(at))
    old, new = f.filter("timestamp_feedback <= at").drop("at"), f.filter("timestamp_feedback > at").drop("at")
    return learning.merge_model(learning.build_model(old), new)[0].select("field", "raw", "total", F.round("adjustment", 6).alias("adjustment"))


@query("A7_merge_corrections", FB + " SELECT campo_nombre AS field, raw_ocr_output AS raw, valor_corregido AS correction, causa_raiz AS cause, count(*) AS count, CAST(epoch_us(min(timestamp_feedback)) AS BIGINT) AS first_seen FROM feedback GROUP BY ALL")
def _(spark, d):
    f = fx.feedback(spark, d)
    half = F.xxhash64("seq") % 2 == 0
    merged = learning.merge_model(learning.build_model(f.filter(half)), f.filter(~half))[1]
    return merged.select("field", "raw", "correction", "cause", "count", F.unix_micros(F.col("first_seen.timestamp_feedback")).alias("first_seen"))


@query("A8_processing_stats", FB + f" SELECT 'all' AS kind, '' AS key, count(*) AS n FROM feedback UNION ALL SELECT 'adjustments', '', count(*) FROM feedback WHERE {ADJ} <> 0 UNION ALL SELECT 'field', campo_nombre, count(*) FROM feedback GROUP BY campo_nombre UNION ALL SELECT 'cause', causa_raiz, count(*) FROM feedback GROUP BY causa_raiz")
def _(spark, d):
    return learning.processing_stats(fx.feedback(spark, d))


TOP = f", top AS ((SELECT 'field' AS kind, campo_nombre AS key, count(*) AS n, {q(FIELD_ADVICE)} AS recommendation FROM feedback GROUP BY campo_nombre ORDER BY count(*) DESC, min((timestamp_feedback, seq)) LIMIT 1) UNION ALL (SELECT 'cause', causa_raiz, count(*), CASE causa_raiz {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in CAUSE_ADVICE.items())} END FROM feedback GROUP BY causa_raiz ORDER BY count(*) DESC, min((timestamp_feedback, seq)) LIMIT 1))"


@query("W9_top_problem", FB + TOP + " SELECT * FROM top")
def _(spark, d):
    return learning.top_problem(fx.feedback(spark, d))


@query("C7_retrain", FB + ENTRIES + BESTC + " SELECT field, raw, total, round(adjustment, 6) AS adjustment, correction FROM entries JOIN bc USING (field, raw)")
def _(spark, d):
    entries, corrections = learning.retrain(fx.feedback(spark, d))
    return entries.join(learning.best_correction(corrections), ["field", "raw"]).select("field", "raw", "total", F.round("adjustment", 6).alias("adjustment"), "correction")


@query("S9_retraining_report", FB + TOP + f" SELECT (SELECT count(*) FROM feedback) AS total_processed, (SELECT count(*) FROM feedback WHERE {ADJ} <> 0) AS adjustments, (SELECT key FROM top WHERE kind = 'field') AS top_field, (SELECT key FROM top WHERE kind = 'cause') AS top_cause, (SELECT count(DISTINCT campo_nombre) FROM feedback) AS model_size")
def _(spark, d):
    f = fx.feedback(spark, d)
    return io.retraining_report(learning.processing_stats(f), learning.top_problem(f), learning.build_model(f)[0])


@query("ST2_recent_corrections", FB + ", s AS (SELECT date_trunc('day', timestamp_feedback) - INTERVAL 1 DAY * k AS window_start FROM feedback, (SELECT unnest(range(0, 7)) AS k)) SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS corrections FROM s GROUP BY window_start")
def _(spark, d):
    return jobs.recent_corrections(fx.feedback(spark, d))


@query("ST2_recent_corrections_stream", FB + ", s AS (SELECT date_trunc('day', timestamp_feedback) - INTERVAL 1 DAY * k AS window_start FROM feedback, (SELECT unnest(range(0, 7)) AS k)) SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, count(*) AS corrections FROM s WHERE window_start + INTERVAL 7 DAY <= (SELECT max(timestamp_feedback) - INTERVAL 1 DAY FROM feedback) GROUP BY window_start")
def _(spark, d):
    """The stream, started twice: windows that the watermark has passed, each written once."""
    source, out, state = (fx.scratch(spark, x) for x in ("feedback", "windows", "state"))
    feedback_text(spark, d).write.options(**io.CSV).csv(source)
    for _ in range(2):
        jobs.recent_corrections_stream(spark, source, out, state).awaitTermination()
    return spark.read.schema("window_start timestamp, window_end timestamp, corrections long").parquet(out)


@query("ST3_extract_rows", FOUND + " SELECT image_id, field, value, round(confidence, 6) AS confidence FROM found")
def _(spark, d):
    return jobs.extract_rows(words.collect_ocr(fx.words(spark, d))).withColumn("confidence", F.round("confidence", 6))


@query("S6_model_json", FB + ENTRIES + ", c AS (SELECT campo_nombre AS field, raw_ocr_output AS raw, valor_corregido AS correction, causa_raiz AS cause, count(*) AS count FROM feedback GROUP BY ALL) SELECT field, raw, correction, cause, count, total, round(adjustment, 6) AS adjustment FROM c JOIN entries USING (field, raw)")
def _(spark, d):
    """The model written as nested JSON and read back."""
    entries, corrections = io.model_from_json(io.model_json(learning.build_model(fx.feedback(spark, d))))
    return corrections.join(entries, ["field", "raw"]).select("field", "raw", "correction", "cause", "count", "total", F.round("adjustment", 6).alias("adjustment"))


YAML = "concat('huella_texto_clave: [\"', s_name, '\", Monto]\nesqueleto_estructural:\n  regiones_esperadas:\n    - {nombre: r', s_nationkey, ', left_rel: 0.1, top_rel: 0.2, width_rel: 0.5, height_rel: 0.25}\ncampos:\n  monto: {left: ', s_nationkey, ', top: ', s_suppkey % 100, ', width: 30, height: 4, regex_validacion: [\"a\", \"b\"]}\n', CASE WHEN s_suppkey % 7 = 0 THEN 'bad: [' ELSE '' END)"


@query("S3_load_templates", "SELECT 't' || s_suppkey AS template, s_name AS anchor, 'r' || s_nationkey AS region, 0.25::DOUBLE AS height_rel, CAST(s_nationkey AS INT) AS \"left\", CAST(s_suppkey % 100 AS INT) AS top, 'a|b' AS regexes FROM supplier WHERE s_suppkey % 7 <> 0")
def _(spark, d):
    """A template for each supplier, every seventh of them broken."""
    texts = fx.read(spark, d, "supplier").selectExpr("concat('t', s_suppkey) AS template", f"{YAML} AS text")
    anchors, regions, fields, _ = io.parse_templates(texts)
    t = anchors.filter("anchor <> 'Monto'").join(regions.select("template", F.col("name").alias("region"), "height_rel"), "template").join(fields, "template")
    return t.select("template", "anchor", "region", "height_rel", "left", "top", F.array_join("regexes", "|").alias("regexes"))


def feedback_text(spark, d):
    """Feedback as its CSV files hold it."""
    return fx.feedback(spark, d).select("id_unico_imagen", "campo_nombre", "raw_ocr_output", "valor_corregido", "causa_raiz", F.date_format("timestamp_feedback", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp_feedback"))


FILES = " SELECT campo_nombre, raw_ocr_output, count(*) AS n, count(DISTINCT id_unico_imagen) AS images"


@query("S4_read_feedback", FB + FILES + ", strftime(max(timestamp_feedback), '%Y-%m-%dT%H:%M:%S.%f') AS last FROM feedback GROUP BY ALL")
def _(spark, d):
    at = fx.scratch(spark, "feedback")
    feedback_text(spark, d).write.options(**io.CSV).csv(at)
    f = io.read_feedback(spark, at).unionByName(io.read_feedback(spark, fx.scratch(spark, "missing")))
    return f.groupBy("campo_nombre", "raw_ocr_output").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id_unico_imagen").alias("images"), F.max("timestamp_feedback").alias("last"))


@query("S5_append_feedback", FB + FILES + ", true AS stamped FROM feedback GROUP BY ALL")
def _(spark, d):
    at, f = fx.scratch(spark, "feedback"), fx.feedback(spark, d)
    io.append_feedback(f.filter("seq % 2 = 0"), at)
    io.append_feedback(f.filter("seq % 2 = 1"), at)
    f = io.read_feedback(spark, at)
    return f.groupBy("campo_nombre", "raw_ocr_output").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id_unico_imagen").alias("images"), F.bool_and(F.to_timestamp("timestamp_feedback").isNotNull()).alias("stamped"))


@query("S8_archive_feedback", FB + " SELECT CASE WHEN seq % 3 = 0 THEN 'a' ELSE 'b' END AS archived_at, campo_nombre, count(*) AS n FROM feedback GROUP BY ALL")
def _(spark, d):
    at, f = fx.scratch(spark, "archive"), fx.feedback(spark, d).drop("timestamp_feedback")
    io.archive_feedback(f, at, "b")
    io.archive_feedback(f.filter("seq % 3 = 0"), at, "a")
    io.archive_feedback(f.filter("seq % 3 <> 0"), at, "b")
    return spark.read.option("header", True).csv(at).groupBy("archived_at", "campo_nombre").agg(F.count(F.lit(1)).alias("n"))


@query("ST1_retrain_stream", FB + f", half AS (SELECT *, timestamp_feedback > (SELECT median(timestamp_feedback) FROM feedback) AS late FROM feedback), adj AS (SELECT campo_nombre AS field, raw_ocr_output AS raw, {ADJ} AS a, row_number() OVER (PARTITION BY campo_nombre, raw_ocr_output ORDER BY timestamp_feedback DESC, id_unico_imagen DESC, valor_corregido DESC, causa_raiz DESC) AS rn FROM feedback WHERE {ADJ} <> 0), folded AS (SELECT field, raw, sum(CASE WHEN rn <= 1100 THEN a * pow(0.5, rn) END) AS adjustment FROM adj GROUP BY ALL) SELECT t.*, round(coalesce(adjustment, 0), 6) AS adjustment FROM (SELECT campo_nombre AS field, raw_ocr_output AS raw, count(*) AS total, CAST((SELECT count(*) FROM feedback) AS BIGINT) AS archived FROM feedback GROUP BY ALL) t LEFT JOIN folded USING (field, raw)")
def _(spark, d):
    """Feedback that arrives in two parts, by time."""
    source, model, archive, state = (fx.scratch(spark, x) for x in ("feedback", "model", "archive", "state"))
    f = feedback_text(spark, d).withColumn("at", F.unix_micros(F.to_timestamp("timestamp_feedback")))
    late = F.col("at") > F.lit(f.agg(F.median("at")).first()[0])
    for part in (~late, late):
        f.filter(part).drop("at").write.mode("append").options(**io.CSV).csv(source)
        jobs.retrain_stream(spark, source, model, archive, state).awaitTermination()
    entries, _ = jobs.current_model(spark, model)
    archived = spark.read.option("header", True).csv(archive).count()
    return entries.select("field", "raw", "total", F.lit(archived).cast("long").alias("archived"), F.round("adjustment", 6).alias("adjustment"))


# image quality

@query("M1_brightness_stats", PX + ", e AS (SELECT image_id, unnest(gray) AS g FROM pixels) SELECT image_id, round(avg(g), 6) AS brightness, round(stddev_pop(g), 6) AS std, min(g) AS min, max(g) AS max, median(g) AS median FROM e GROUP BY image_id")
def _(spark, d):
    s = quality.brightness_stats(fx.pixels(spark, d))
    return s.select("image_id", F.round("brightness", 6).alias("brightness"), F.round("std", 6).alias("std"), "min", "max", "median")


DARK = ", e AS (SELECT image_id, unnest(gray) AS g FROM pixels), dk AS (SELECT image_id, avg(g) AS brightness, median(g) AS med, count(*) FILTER (WHERE g < 85) / count(*) * 100 AS dark_percentage FROM e GROUP BY image_id)"


@query("M2_dark_background", PX + DARK + ", k AS (SELECT *, brightness < 85 AND med < 85 AND dark_percentage > 60 AS is_dark FROM dk) SELECT image_id, dark_percentage, is_dark, CASE WHEN is_dark THEN dark_percentage / 100 ELSE 0 END AS dark_confidence FROM k")
def _(spark, d):
    return quality.dark_background(quality.brightness_stats(fx.pixels(spark, d))).select("image_id", "dark_percentage", "is_dark", "dark_confidence")


@query("M5_tiled_images", PX + DARK + ", t AS (SELECT image_id, stddev_pop(g) AS std, min(g) AS min, max(g) AS max, count(*) FILTER (WHERE g >= 170 AND g < 255) / count(*) * 100 AS bright_percentage FROM e GROUP BY image_id) SELECT image_id, round(brightness, 6) AS brightness, round(std, 6) AS std, min, max, med AS median, dark_percentage, bright_percentage FROM dk JOIN t USING (image_id)")
def _(spark, d):
    """The same counts from tiles of 3 x 3 pixels."""
    m = quality.measured_tiles(quality.split(fx.pixels(spark, d), 3))
    return m.select("image_id", F.round("brightness", 6).alias("brightness"), F.round("std", 6).alias("std"), "min", "max", "median", "dark_percentage", "bright_percentage")


@query("M3_sharpness", PX + ", p AS (SELECT image_id, unnest(gray) AS g, generate_subscripts(gray, 1) - 1 AS i FROM pixels), c AS (SELECT image_id, i // 8 AS y, i % 8 AS x, g FROM p), n AS (SELECT c.image_id, u.g + d.g + l.g + r.g - 4 * c.g AS v FROM c JOIN c u ON u.image_id = c.image_id AND u.x = c.x AND u.y = abs(c.y - 1) JOIN c d ON d.image_id = c.image_id AND d.x = c.x AND d.y = 7 - abs(7 - c.y - 1) JOIN c l ON l.image_id = c.image_id AND l.y = c.y AND l.x = abs(c.x - 1) JOIN c r ON r.image_id = c.image_id AND r.y = c.y AND r.x = 7 - abs(7 - c.x - 1)) SELECT image_id, CAST(round(var_pop(v) * 4096) AS BIGINT) AS sharpness FROM n GROUP BY image_id")
def _(spark, d):
    return quality.texture(fx.pixels(spark, d)).select("image_id", F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness"))


@query("M3_sharpness_tiled", PX + ", p AS (SELECT image_id, unnest(gray) AS g, generate_subscripts(gray, 1) - 1 AS i FROM pixels), c AS (SELECT image_id, i // 8 AS y, i % 8 AS x, g FROM p), n AS (SELECT c.image_id, u.g + d.g + l.g + r.g - 4 * c.g AS v FROM c JOIN c u ON u.image_id = c.image_id AND u.x = c.x AND u.y = abs(c.y - 1) JOIN c d ON d.image_id = c.image_id AND d.x = c.x AND d.y = 7 - abs(7 - c.y - 1) JOIN c l ON l.image_id = c.image_id AND l.y = c.y AND l.x = abs(c.x - 1) JOIN c r ON r.image_id = c.image_id AND r.y = c.y AND r.x = 7 - abs(7 - c.x - 1)) SELECT image_id, CAST(round(var_pop(v) * 4096) AS BIGINT) AS sharpness FROM n GROUP BY image_id")
def _(spark, d):
    m = quality.measured_tiles(quality.split(fx.pixels(spark, d), 5))
    return m.select("image_id", F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness"))


@query("M4_noise_level", PX + ", p AS (SELECT image_id, unnest(gray) AS g, generate_subscripts(gray, 1) - 1 AS i FROM pixels), c AS (SELECT image_id, i // 8 AS y, i % 8 AS x, g FROM p), k AS (SELECT unnest([1, 4, 6, 4, 1]) AS w, unnest([-2, -1, 0, 1, 2]) AS o), b AS (SELECT c.image_id, c.y, c.x, any_value(c.g) AS g, (sum(kx.w * ky.w * s.g) + 128) // 256 AS blurred FROM c, k kx, k ky, c s WHERE s.image_id = c.image_id AND s.x = 7 - abs(7 - abs(c.x + kx.o)) AND s.y = 7 - abs(7 - abs(c.y + ky.o)) GROUP BY ALL) SELECT image_id, round(stddev_pop(abs(g - blurred)), 6) AS noise_level FROM b GROUP BY image_id")
def _(spark, d):
    return quality.texture(fx.pixels(spark, d)).select("image_id", F.round("noise_level", 6).alias("noise_level"))


TYPE = "CASE WHEN is_dark THEN 'Captura Fondo Oscuro' WHEN sharpness < 100 AND brightness > 180 THEN 'Captura WhatsApp' WHEN sharpness > 500 AND noise_level < 15 THEN 'Escaneo Digital' WHEN noise_level > 15 THEN 'Foto Física' ELSE 'Imagen Mixta' END"
PIXEL_METRICS = PX + DARK + ", s AS (SELECT image_id, stddev_pop(g) AS std, min(g) AS min, max(g) AS max FROM e GROUP BY image_id), p AS (SELECT image_id, unnest(gray) AS g, generate_subscripts(gray, 1) - 1 AS i FROM pixels), c AS (SELECT image_id, i // 8 AS y, i % 8 AS x, g FROM p), sharp AS (SELECT c.image_id, var_pop(u.g + d.g + l.g + r.g - 4 * c.g) AS sharpness FROM c JOIN c u ON u.image_id = c.image_id AND u.x = c.x AND u.y = abs(c.y - 1) JOIN c d ON d.image_id = c.image_id AND d.x = c.x AND d.y = 7 - abs(7 - c.y - 1) JOIN c l ON l.image_id = c.image_id AND l.y = c.y AND l.x = abs(c.x - 1) JOIN c r ON r.image_id = c.image_id AND r.y = c.y AND r.x = 7 - abs(7 - c.x - 1) GROUP BY c.image_id), k AS (SELECT unnest([1, 4, 6, 4, 1]) AS w, unnest([-2, -1, 0, 1, 2]) AS o), b AS (SELECT c.image_id, c.y, c.x, any_value(c.g) AS g, (sum(kx.w * ky.w * s.g) + 128) // 256 AS blurred FROM c, k kx, k ky, c s WHERE s.image_id = c.image_id AND s.x = 7 - abs(7 - abs(c.x + kx.o)) AND s.y = 7 - abs(7 - abs(c.y + ky.o)) GROUP BY ALL), noise AS (SELECT image_id, stddev_pop(abs(g - blurred)) AS noise_level FROM b GROUP BY image_id), diag AS (SELECT dk.image_id, brightness, std, min, max, med, dark_percentage, brightness < 85 AND med < 85 AND dark_percentage > 60 AS is_dark, sharpness, noise_level FROM dk JOIN s USING (image_id) JOIN sharp USING (image_id) JOIN noise USING (image_id))"
CATEGORIES = "CASE WHEN sharpness > 500 THEN 'high' WHEN sharpness > 100 THEN 'medium' ELSE 'low' END AS sharpness_category, CASE WHEN brightness > 180 THEN 'high' WHEN brightness < 80 THEN 'low' ELSE 'normal' END AS brightness_category, CASE WHEN noise_level > 15 THEN 'high' ELSE 'normal' END AS noise_category"


@query("M5_diagnose_images", PIXEL_METRICS + f" SELECT image_id, round(brightness, 6) AS brightness, round(std, 6) AS std, min, max, med AS median, dark_percentage, is_dark, CAST(round(sharpness * 4096) AS BIGINT) AS sharpness, round(noise_level, 6) AS noise_level, {CATEGORIES}, {TYPE} AS image_type FROM diag")
def _(spark, d):
    g = quality.diagnose_images(fx.pixels(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return g.select("image_id", r("brightness"), r("std"), "min", "max", "median", "dark_percentage", "is_dark", F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness"), r("noise_level"), "sharpness_category", "brightness_category", "noise_category", "image_type")


DIAG = "WITH diag AS (SELECT o_orderkey AS k, CAST(o_orderkey * 7 % 700 AS DOUBLE) AS sharpness, CAST(o_orderkey * 3 % 256 AS DOUBLE) AS brightness, CAST(o_orderkey % 40 AS DOUBLE) / 2 AS noise_level, o_orderkey % 6 = 0 AS is_dark, CASE WHEN o_orderkey % 6 = 0 THEN CAST(61 + o_orderkey % 30 AS DOUBLE) / 100 ELSE 0.0 END AS dark_confidence, CAST(400 + o_orderkey * 37 % 900 AS INT) AS img_width, CAST(300 + o_orderkey * 53 % 800 AS INT) AS img_height, CAST(o_orderkey % 41 - 20 AS DOUBLE) / 5 AS skew_angle FROM orders)"


def diag(spark, d):
    return spark.sql(DIAG.replace("FROM orders", "FROM {orders}") + " SELECT * FROM diag", orders=fx.read(spark, d, "orders"))


FACTOR = "greatest(1.0::DOUBLE, CASE WHEN sharpness <= 100 THEN 2.5 ELSE 1 END, CASE WHEN img_width < 800 OR img_height < 600 THEN greatest(800 / img_width, 600 / img_height) ELSE 1 END, CASE WHEN img_width < 1000 OR img_height < 800 THEN 2 ELSE 1 END)"


@query("P4_image_categories", DIAG + " SELECT k, CASE WHEN sharpness > 500 THEN 'high' WHEN sharpness > 100 THEN 'medium' ELSE 'low' END AS sharpness_category, CASE WHEN brightness > 180 THEN 'high' WHEN brightness < 80 THEN 'low' ELSE 'normal' END AS brightness_category, CASE WHEN noise_level > 15 THEN 'high' ELSE 'normal' END AS noise_category FROM diag")
def _(spark, d):
    return quality.image_categories(diag(spark, d)).select("k", "sharpness_category", "brightness_category", "noise_category")


@query("P5_image_type", DIAG + f" SELECT k, {TYPE} AS image_type FROM diag")
def _(spark, d):
    g = diag(spark, d)
    return g.select("k", quality.image_type(g).alias("image_type"))


@query("P6_inversion_decision", DIAG + " SELECT k, is_dark AND dark_confidence >= 0.7::DOUBLE AS apply FROM diag")
def _(spark, d):
    g = diag(spark, d)
    return g.select("k", quality.inversion_decision(g).alias("apply"))


@query("P7_upscale_plan", DIAG + f", f AS (SELECT k, img_width, img_height, CASE WHEN {FACTOR} > 1.1::DOUBLE THEN {FACTOR} ELSE 1 END AS factor FROM diag) SELECT k, factor, CAST(trunc(img_width * factor) AS INT) AS new_width, CAST(trunc(img_height * factor) AS INT) AS new_height FROM f")
def _(spark, d):
    g = diag(spark, d)
    f = quality.upscale_factor(g)
    return g.select("k", f.alias("factor"), (g["img_width"] * f).cast("int").alias("new_width"), (g["img_height"] * f).cast("int").alias("new_height"))


@query("P8_denoise_plan", DIAG + " SELECT k, CASE WHEN noise_level > 15 THEN 'fastNlMeansDenoisingColored_aggressive,medianBlur_5' WHEN noise_level > 8 THEN 'fastNlMeansDenoisingColored_moderate' ELSE 'gaussianBlur_light' END || ',bilateralFilter' AS steps FROM diag")
def _(spark, d):
    g = diag(spark, d)
    return g.select("k", F.array_join(quality.denoise_plan(g), ",").alias("steps"))


@query("P9_preprocessing_plan", DIAG + f", f AS (SELECT *, is_dark AND dark_confidence >= 0.7::DOUBLE AS inv, {TYPE} AS kind FROM diag) SELECT k, concat_ws(',', CASE WHEN inv THEN 'smart_color_inversion_bitwise_not_with_clahe' END, CASE WHEN abs(skew_angle) > 1 THEN printf('skew_correction_%.1fdeg', skew_angle) END, CASE WHEN {FACTOR} > 1.1::DOUBLE THEN printf('upscale_%.1fx_LANCZOS4', CAST({FACTOR} AS DOUBLE)) END, CASE WHEN noise_level > 15 THEN 'fastNlMeansDenoisingColored_aggressive,medianBlur_5' WHEN noise_level > 8 THEN 'fastNlMeansDenoisingColored_moderate' ELSE 'gaussianBlur_light' END, 'bilateralFilter', CASE kind WHEN 'Captura Fondo Oscuro' THEN 'dark_background_optimization' WHEN 'Captura WhatsApp' THEN 'whatsapp_optimization' WHEN 'Foto Física' THEN 'physical_photo_enhancement' WHEN 'Escaneo Digital' THEN 'scan_sharpening' END, CASE WHEN NOT inv AND brightness < 80 THEN 'brightness_boost_high' WHEN NOT inv AND brightness > 180 THEN 'brightness_reduction_high' END) AS steps FROM f")
def _(spark, d):
    g = diag(spark, d)
    return g.select("k", F.array_join(quality.preprocessing_plan(g), ",").alias("steps"))


# reports, manifests and results

@query("A9_persistent_issues", DIAG + ", fb AS (SELECT count(*) AS n, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent FROM events), r AS (SELECT k, k % 100 AS overall, k % 7 < 3 AS low, k % 5 <> 0 AS passed, sharpness, noise_level FROM diag), i AS (SELECT k, list_filter([CASE WHEN overall < 50 AND low THEN 'multiple_low_confidence_fields' END, CASE WHEN sharpness < 100 AND noise_level > 15 THEN 'preprocessing_insufficient' END, CASE WHEN NOT passed THEN 'validation_failures' END, CASE WHEN n > 10 AND recent > 5 THEN 'frequent_recent_corrections' END], lambda x: x IS NOT NULL) AS issues FROM r, fb) SELECT k AS image_id, array_to_string(issues, ',') AS issues, len(issues) >= 2 AS suggest_update FROM i")
def _(spark, d):
    g = diag(spark, d).withColumnRenamed("k", "image_id")
    low = F.when(F.col("image_id") % 7 < 3, F.array(*[F.lit(x) for x in (10.0, 20.0, 39.0)])).otherwise(F.array(F.lit(10.0), F.lit(40.0)))
    results = g.select("image_id", (F.col("image_id") % 100).cast("double").alias("overall_confidence"), low.alias("field_confidences"), (F.col("image_id") % 5 != 0).alias("cross_validation_passed"))
    f = fx.feedback(spark, d)
    now = F.lit(f.agg(F.max("timestamp_feedback")).first()[0])
    return reports.persistent_issues(results, g, f, now).withColumn("issues", F.array_join("issues", ","))


@query("A10_summary", W + f", {FIELDS} SELECT image_id, count(*) AS n_fields, string_agg(field || '=' || value, ';' ORDER BY field) FILTER (WHERE ok) AS extracted FROM fields GROUP BY image_id")
def _(spark, d):
    f = derived_fields(spark, d)
    s = reports.summary(reports.documents(f, extract.extraction_statistics(f)))
    entries = F.array_sort(F.transform(F.map_entries("values"), lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.select("image_id", F.col("n_fields").cast("long").alias("n_fields"), F.when(text != "", text).alias("extracted"))


def results(spark, d):
    e = fx.read(spark, d, "events")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".png", ".JPG", ".txt", ".bmp", ".jpeg", ".tiff", ".gif")]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.concat(F.lit("/in/img-"), F.col("user_id").cast("string"), suffix).alias("path"), F.col("ts").cast("timestamp").alias("modificationTime"), F.col("event_id"))


RESULTS = "WITH r AS (SELECT '/in/img-' || user_id || ['.png', '.JPG', '.txt', '.bmp', '.jpeg', '.tiff', '.gif'][event_id % 7 + 1] AS path, 'img-' || user_id AS stem, CAST(ts AS TIMESTAMP) AS t, event_id FROM events), s AS (SELECT * FROM r WHERE event_id % 7 NOT IN (2, 6))"


@query("S1_image_manifest", RESULTS + " SELECT event_id, path, stem FROM s")
def _(spark, d):
    return io.supported(results(spark, d)).select("event_id", "path", "stem")


@query("W10_latest_result", RESULTS + " SELECT stem, path, t AS \"modificationTime\" FROM s QUALIFY row_number() OVER (PARTITION BY stem ORDER BY t DESC, path DESC) = 1")
def _(spark, d):
    return reports.latest_result(io.supported(results(spark, d)).drop("event_id")).select("stem", "path", "modificationTime")


@query("A11_processed_recently", RESULTS + " SELECT count(*) AS processed FROM r WHERE t > (SELECT max(t) FROM r) - INTERVAL 1 DAY")
def _(spark, d):
    r = results(spark, d)
    return reports.processed_recently(r, F.lit(r.agg(F.max("modificationTime")).first()[0]))


@query("S7_named_results", RESULTS + " SELECT event_id, strftime(t, '%Y%m%d-%H%M%S') || '-' || stem AS record, CAST(t AS DATE) AS processing_date FROM s")
def _(spark, d):
    return io.named_results(io.supported(results(spark, d)).withColumnRenamed("modificationTime", "processed_at")).select("event_id", "record", "processing_date")


@query("S7_write_results", RESULTS + " SELECT event_id, strftime(t, '%Y%m%d-%H%M%S') || '-' || stem AS record, CAST(t AS DATE) AS processing_date, 'b' AS run FROM s")
def _(spark, d):
    """Written, interrupted before its mark, retried and read back."""
    at = fx.scratch(spark, "results")
    r = io.supported(results(spark, d)).select("event_id", "stem", F.col("modificationTime").alias("processed_at"))
    io.named_results(r.filter("event_id % 3 = 0")).write.partitionBy("processing_date").json(f"{at}/data/run=b")
    for _ in range(2):
        io.write_results(r, at, "b")
    return io.read_committed(spark, at, "event_id long, record string, processing_date date").select("event_id", "record", "processing_date", "run")


@query("S9_write_report", FB + TOP + f" SELECT 'r' AS run, (SELECT count(*) FROM feedback) AS total_processed, (SELECT count(*) FROM feedback WHERE {ADJ} <> 0) AS adjustments, (SELECT key FROM top WHERE kind = 'field') AS top_field, (SELECT count(DISTINCT campo_nombre) FROM feedback) AS model_size")
def _(spark, d):
    f, at = fx.feedback(spark, d), fx.scratch(spark, "report")
    report = io.retraining_report(learning.processing_stats(f), learning.top_problem(f), learning.build_model(f)[0])
    for _ in range(2):
        io.write_report(report, at, "r")
    return io.read_committed(spark, at, "total_processed long, adjustments long, top_field string, model_size long")
