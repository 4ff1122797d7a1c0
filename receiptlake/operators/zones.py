"""Keyword boxes, values near them, search zones, and templates.

Every spatial join has the image as its equality key, so pairs stay inside one
image. A few definitions (fields, keywords, anchors, regions) become literals of
one expression for each word. Many keywords become one automaton, broadcast as
far as its bound goes, and beyond it a join on the first letters of keywords.
Many templates are looked up in an index (``templates``). The three ways give
the same rows; which one is taken depends on the number of definitions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fields import TEMPLATE, TEMPLATE_ANCHORS, TEMPLATE_REGIONS, ZONES_FIXED, ZONES_V1
from ..functions import automaton, near
from ..functions.text import fullmatch
from ..sources import io
from . import templates

MOST_DEFINITIONS = 10_000
#: Keywords, and anchors or regions of templates, up to which they are literals.
LITERALS, TEMPLATE_LITERALS = 256, 64
#: Lengths of first letters that a join with keywords is keyed by.
PIECES = 16


def small(df: DataFrame) -> DataFrame:
    """Broadcast a table of definitions if it has the size of one; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(MOST_DEFINITIONS + 1).count() <= MOST_DEFINITIONS else df


def field_table(spark: SparkSession, definitions, schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(definitions)], f"field_order int, {schema}")


def each_match(words: DataFrame, matches: Callable[[Column], list[Column]], alias: str) -> DataFrame:
    """One row for every match, of those made from a word's lower-case text, that is not null. That text is made once for all of them."""
    found = words.withColumn("_low", F.lower("text")).withColumn(alias, F.explode(F.array(*matches(F.col("_low")))))
    return found.filter(F.col(alias).isNotNull()).drop("_low")


def _listed(spark: SparkSession, definitions: DataFrame | Sequence[tuple], columns: list[str], schema: str) -> tuple[list[tuple] | None, DataFrame]:
    """(rows if they are few enough for literals, table) of definitions (*columns, keywords)."""
    if not isinstance(definitions, DataFrame):
        rows, table = [tuple(d) for d in definitions], spark.createDataFrame([tuple(d) for d in definitions], schema)
    else:
        table = definitions.select(*columns, "keywords")
        rows = [tuple(r) for r in table.limit(LITERALS + 1).withColumn("keywords", F.slice("keywords", 1, LITERALS + 1)).collect()]
    few = len(rows) <= LITERALS and sum(len(r[-1] or []) for r in rows) <= LITERALS
    return (rows if few else None), table


def keyword_hits(words: DataFrame, definitions: DataFrame | Sequence[tuple], columns: list[str], first: bool, schema: str = "") -> DataFrame:
    """Words with (*columns, k, keyword) for each keyword that their lower-case text holds, or each definition's first one.

    definitions: (*columns, keywords); k is a keyword's place in its list. Lists that are null, and null keywords, hold nothing."""
    rows, table = _listed(words.sparkSession, definitions, columns, schema)
    if rows is not None:
        kinds = table.schema

        def made(low: Column) -> list[Column]:
            out = []
            for *values, keywords in rows:
                own = [F.lit(v).cast(kinds[c].dataType).alias(c) for c, v in zip(columns, values, strict=True)]
                each = [F.when(low.contains(k.lower()), F.struct(*own, F.lit(i).alias("k"), F.lit(k).alias("keyword"))) for i, k in enumerate(keywords or []) if k is not None]
                out += [F.coalesce(*each)] if first and each else each
            return out or [F.lit(None).cast("struct<" + ",".join(f"{c}:{kinds[c].dataType.simpleString()}" for c in columns) + ",k:int,keyword:string>")]

        return each_match(words, made, "_hit").select(*words.columns, "_hit.*")
    each = table.withColumn("_d", F.monotonically_increasing_id()).select(*columns, "_d", F.posexplode("keywords").alias("k", "keyword")).filter("keyword is not null")
    size = each.agg(F.sum(F.char_length("keyword") + 1)).first()[0] or 0
    return _by_automaton(words, each, columns, first) if size <= automaton.LARGEST else _by_join(words, each, columns, first)


def _by_automaton(words: DataFrame, each: DataFrame, columns: list[str], first: bool) -> DataFrame:
    """One pass over the words with an automaton of all keywords; what a keyword stands for is joined by its number, a table of the same bound."""
    rows = each.orderBy("_d", "k").collect()
    numbers: dict[int, int] = {}
    groups = [numbers.setdefault(r["_d"], len(numbers)) for r in rows]
    known = words.sparkSession.createDataFrame([(i, *[r[c] for c in (*columns, "k", "keyword")]) for i, r in enumerate(rows)], "_id int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in each.select(*columns, "k", "keyword").schema))
    ids = automaton.held_patterns(words.sparkSession, F.lower("text"), [r["keyword"].lower() for r in rows], groups if first else None)
    return words.withColumn("_id", F.explode(ids)).join(F.broadcast(known), "_id").select(*words.columns, *columns, "k", "keyword")


def _by_join(words: DataFrame, each: DataFrame, columns: list[str], first: bool) -> DataFrame:
    """Distinct texts meet the keywords that begin with a piece of them, of a few lengths: a keyword is found by its first letters up to
    the longest of these lengths that it has, so that keywords which begin alike don't meet every text with that beginning."""
    keyed = each.withColumn("_low", F.lower("keyword"))
    found = sorted((r["n"], r["count"]) for r in keyed.groupBy(F.char_length("_low").alias("n")).count().collect())
    if not found:
        return words.withColumn("_hit", F.lit(None).cast(each.select(F.struct(*columns, "k", "keyword")).schema[0].dataType)).filter("false").select(*words.columns, "_hit.*")
    ends = np.cumsum([n for _, n in found])
    steps = np.arange(PIECES) * ends[-1] / PIECES
    lengths = sorted({found[int(at)][0] for at in np.searchsorted(ends, steps, "right")})  # the least is among them
    piece = F.greatest(*[F.when(F.char_length("_low") >= n, n).otherwise(lengths[0]) for n in lengths], F.lit(0))
    keyed = keyed.withColumn("_gram", F.substr("_low", F.lit(1), piece))
    held = words.withColumn("_text", F.lower("text")).filter(F.char_length("_text") >= lengths[0])
    size = F.char_length("_text")
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(F.col("_text"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = held.select("_text").distinct().withColumn("_gram", F.explode(F.array_distinct(F.concat(*map(of, lengths)))))
    hits = grams.join(keyed, "_gram").filter(F.contains("_text", "_low")).select("_text", "_d", *columns, "k", "keyword")
    if first:
        hits = hits.groupBy("_text", "_d").agg(F.min(F.struct("k", "keyword", *columns)).alias("h")).select("_text", "h.*")
    return held.join(hits, "_text").select(*words.columns, *columns, "k", "keyword")


def keyword_boxes(words: DataFrame, field_keywords: DataFrame, min_confidence: int = 20, strict: bool = False) -> DataFrame:
    """Words holding a keyword of a field, with the first such keyword of its list. field_keywords: (field, keywords)."""
    c = F.col("conf").cast("int")
    w = words.filter(((c > min_confidence) if strict else (c >= min_confidence)) & (F.trim("text") != ""))
    return keyword_hits(w, field_keywords, ["field"], first=True).drop("k")


def anchor_points(words: DataFrame, images: DataFrame, field_keywords: DataFrame) -> DataFrame:
    """The centre of every word for each keyword that it holds; the image's centre for fields without any.
    n_anchors counts equal points, which are kept once. field_keywords: (field_order, field, keywords)."""
    hits = keyword_hits(words, field_keywords, ["field_order", "field"], first=False)
    hits = hits.select("image_id", "field_order", "field", "k", "word_idx", F.expr("cast(left + width div 2 as int)").alias("x"), F.expr("cast(top + height div 2 as int)").alias("y"))
    hits = hits.groupBy("image_id", "field_order", "field", "x", "y").agg(F.count(F.lit(1)).alias("n_anchors"), F.min(F.struct("word_idx", "k")).alias("first"))
    every = images.select("image_id", "img_width", "img_height").crossJoin(small(field_keywords.select("field_order", "field")))
    out = every.join(hits, ["image_id", "field_order", "field"], "left")
    return out.select("image_id", "field_order", "field", F.coalesce("x", F.expr("cast(img_width div 2 as int)")).alias("x"), F.coalesce("y", F.expr("cast(img_height div 2 as int)")).alias("y"), F.coalesce("n_anchors", F.lit(0)).alias("n_anchors"), F.coalesce("first", F.struct(F.lit(0).alias("word_idx"), F.lit(0).alias("k"))).alias("first"), "img_width", "img_height")


def _centre(prefix: str = "") -> tuple[Column, Column]:
    return F.expr(f"{prefix}left + {prefix}width / 2"), F.expr(f"{prefix}top + {prefix}height / 2")


def cell_of(x: Column, size: float) -> Column:
    """The number of the grid line's cell that a coordinate lies in."""
    return F.floor(x / size)


def around(x: Column, y: Column, size: float) -> Column:
    """The nine cells (cx, cy) that hold every point within ``size`` of a point: its own and those beside it."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return F.transform(steps, lambda s: F.struct((cell_of(x, size) + s["a"]).alias("cx"), (cell_of(y, size) + s["b"]).alias("cy")))


def nearby_values(words: DataFrame, boxes: DataFrame, radius: float = 100, min_confidence: int = 20) -> DataFrame:
    """Words whose centre lies within the radius of a keyword box's centre.

    Words lie in the cells of a grid as wide as the radius, and boxes ask their own
    cell and the eight beside it, so that a dense page costs its near pairs only."""
    size = max(float(radius), 1.0)
    c = F.col("conf").cast("int")
    v = words.filter((c >= min_confidence) & (F.trim("text") != "")).select("image_id", F.col("word_idx").alias("v_idx"), F.col("text").alias("v_text"), *[F.col(x).alias(f"v_{x}") for x in ("left", "top", "width", "height")], c.alias("v_conf"))
    (x, y), (vx, vy) = _centre(), _centre("v_")
    square = (vx - x) * (vx - x) + (vy - y) * (vy - y)
    v = v.withColumns({"_cx": cell_of(vx, size), "_cy": cell_of(vy, size)})
    asked = boxes.withColumn("_at", F.explode(around(x, y, size))).withColumns({"_cx": F.col("_at.cx"), "_cy": F.col("_at.cy")}).drop("_at")
    near = asked.join(v, ["image_id", "_cx", "_cy"]).withColumn("square", square).filter(F.col("square") <= radius * radius)
    return near.withColumn("distance", F.sqrt("square")).drop("square", "_cx", "_cy")


def bounded(definitions: DataFrame, columns: list[str]) -> list[tuple] | None:
    """The rows (*columns, keywords) of definitions whose keywords one automaton may have."""
    size = definitions.agg(F.sum(F.aggregate("keywords", F.lit(0), lambda n, k: n + F.coalesce(F.char_length(k), F.lit(0)) + 1))).first()[0] or 0
    return [tuple(r) for r in definitions.select(*columns, "keywords").collect()] if size <= automaton.LARGEST else None


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, with 0 for nulls, and where it has any."""
    return np.asarray(pc.fill_null(column, 0)), np.asarray(column.is_valid())


def ranks(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first row of each distinct combination, in order; every row's combination)."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns]) if len(order) else False
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


VALUES = {"v_idx": "int", "v_text": "string", "v_left": "int", "v_top": "int", "v_width": "int", "v_height": "int", "v_conf": "int"}


def _values_by_box(t: pa.Table, image: np.ndarray, field: np.ndarray, held: near.Held, radius: float) -> tuple[np.ndarray, ...]:
    """For each keyword box, by image, field and place: (its row, its field, the number of words within the radius, the sums of their
    places and distances, the row of the nearest one with another text or -1, its distance). field: each pattern's."""
    row, pattern = held.find(t.column("low"))
    x, y = (np.asarray(t.column(e)) for e in ("x", "y"))
    place, low = numbers(t.column("word_idx"))[0], np.asarray(t.column("low").combine_chunks().dictionary_encode().indices)
    hit, _ = ranks(row, field[pattern])  # a word is a field's box once
    row, of = row[hit], field[pattern[hit]]
    boxes, box = ranks(image[row], of, place[row])
    n, places, total, best = np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64), np.zeros(len(boxes)), []
    for i, j in near.near(image, x, y, image[row], x[row], y[row], radius):
        square = (x[j] - x[row[i]]) ** 2 + (y[j] - y[row[i]]) ** 2
        close = square <= radius * radius
        i, j, far = i[close], j[close], np.sqrt(square[close])
        n += np.bincount(box[i], minlength=len(boxes))
        total += np.bincount(box[i], far, len(boxes))
        np.add.at(places, box[i], place[j].astype(np.int64))
        other = low[j] != low[row[i]]
        i, j, far = i[other], j[other], far[other]
        order = np.lexsort((place[j], far, box[i]))
        i, j, far = i[order], j[order], far[order]
        new = np.append(True, box[i][1:] != box[i][:-1])[: len(i)]
        best.append((box[i][new], j[new], far[new]))
    b, j, far = (np.concatenate(v) for v in zip(*[*best, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], strict=True))
    order = np.lexsort((place[j], far, b))
    b, j, far = b[order], j[order], far[order]
    new = np.append(True, b[1:] != b[:-1])[: len(b)]
    nearest, distance = np.full(len(boxes), -1), np.zeros(len(boxes))
    nearest[b[new]], distance[b[new]] = j[new], far[new]
    return row[boxes], of[boxes], n, places, total, nearest, distance


def keyword_neighbours(words: DataFrame, field_keywords: DataFrame, radius: float = 100, min_confidence: int = 20) -> DataFrame:
    """J3 and W5 in one pass over an image's words, without a row for each pair: for each keyword box (image_id, field, word_idx)
    with a word within the radius their number, the sums of their places and distances, and the nearest one with another text (else nulls).

    Rows as nearby_values and nearest_value give them, which make the pairs; those are asked where keywords are too many for one automaton."""
    key = ["image_id", "field", "word_idx"]
    rows = bounded(field_keywords, ["field"])
    if rows is None:
        pairs = nearby_values(words, keyword_boxes(words, field_keywords, min_confidence), radius, min_confidence)
        other = F.lower("v_text") != F.lower("text")
        best = F.min(F.when(other, F.struct("distance", *VALUES))).alias("b")
        out = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("v_idx").alias("words"), F.sum("distance").alias("total"), best)
        return out.select(*key, "n", "words", F.col("total").alias("distance"), *[F.col(f"b.{c}").cast(t).alias(c) for c, t in VALUES.items()], F.col("b.distance").alias("v_distance"))
    names = sorted({f for f, _ in rows}, key=str)
    kept = [(names.index(f), k.lower()) for f, ks in rows for k in ks or [] if k is not None]
    known = words.sparkSession.sparkContext.broadcast((names, np.array([f for f, _ in kept], np.int64), near.Held([k for _, k in kept])))
    c, (x, y) = F.col("conf").cast("int"), _centre()
    w = words.filter((c >= min_confidence) & (F.trim("text") != "") & x.isNotNull() & y.isNotNull() & F.col("image_id").isNotNull())
    w = w.select("image_id", F.col("word_idx").cast("int").alias("word_idx"), "text", F.lower("text").alias("low"), *[F.col(e).cast("int").alias(e) for e in ("left", "top", "width", "height")], c.alias("conf"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    def run(t: pa.Table, image: np.ndarray):
        names, field, held = known.value
        row, of, n, places, total, nearest, distance = _values_by_box(t, image, field, held, radius)
        some = np.flatnonzero(n)
        at, to = row[some], pa.array(nearest[some], mask=nearest[some] < 0)
        columns = {"image_id": t.column("image_id").take(pa.array(at)), "field": pa.array(names, pa.string()).take(pa.array(of[some])), "word_idx": t.column("word_idx").take(pa.array(at)), "n": pa.array(n[some]), "words": pa.array(places[some]), "distance": pa.array(total[some])}
        columns |= {v: t.column({"v_idx": "word_idx"}.get(v, v[2:])).take(to) for v in VALUES} | {"v_distance": pa.array(distance[some], mask=nearest[some] < 0)}
        yield from pa.table(columns).combine_chunks().to_batches()

    return near.by_image(w, run, "image_id string, field string, word_idx int, n long, words long, distance double, " + ", ".join(f"{v} {kind}" for v, kind in VALUES.items()) + ", v_distance double")


def intersects(word: str, zone: str) -> Column:
    """Strict rectangle intersection of columns with these prefixes."""
    return F.expr(f"{word}left < {zone}left + {zone}width and {word}left + {word}width > {zone}left and {word}top < {zone}top + {zone}height and {word}top + {word}height > {zone}top")


def _covered(prefix: str, size: int) -> Column:
    """The grid cells (cx, cy) that a rectangle touches."""
    span = lambda a, b: F.sequence(cell_of(F.col(f"{prefix}{a}"), size), cell_of(F.greatest(F.col(f"{prefix}{a}"), F.expr(f"{prefix}{a} + {prefix}{b} - 1")), size))
    return F.flatten(F.transform(span("left", "width"), lambda cx: F.transform(span("top", "height"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def words_in_zone(words: DataFrame, zones: DataFrame, cell: int | None = None) -> DataFrame:
    """Zones has (image_id, field, z_left, z_top, z_width, z_height).

    An image has few zones, so all its words meet each of them. Where it has many,
    ``cell`` gives the width of a grid: rectangles meet in the cells that both touch,
    and a pair counts in the cell of its intersection's corner only. Cells are groups
    of one table of both kinds, not keys of a join: what is dealt out by image is
    not shuffled by cell."""
    if cell is None:
        return words.join(zones, "image_id").filter(intersects("", "z_"))
    own, others = ([c for c in df.columns if c != "image_id"] for df in (words, zones))
    in_cells = lambda df, prefix, name, columns: df.filter("image_id is not null").select("image_id", F.explode(_covered(prefix, cell)).alias("_at"), F.struct(*columns).alias(name))
    both = in_cells(words, "", "_w", own).unionByName(in_cells(zones, "z_", "_z", others), allowMissingColumns=True)
    met = both.groupBy("image_id", F.col("_at.cx").alias("_cx"), F.col("_at.cy").alias("_cy")).agg(F.collect_list("_w").alias("_w"), F.collect_list("_z").alias("_z"))
    met = met.select("image_id", "_cx", "_cy", "_w", F.explode("_z").alias("_z")).select("image_id", "_cx", "_cy", "_z", F.explode("_w").alias("_w"))
    met = met.select("image_id", "_cx", "_cy", *[F.col(f"_w.`{c}`").alias(c) for c in own], *[F.col(f"_z.`{c}`").alias(c) for c in others]).filter(intersects("", "z_"))
    corner = lambda c: cell_of(F.greatest(F.col(c), F.col(f"z_{c}")), cell)
    return met.filter((F.col("_cx") == corner("left")) & (F.col("_cy") == corner("top"))).select("image_id", *own, *others)


def first_anchor(words: DataFrame, field_defs: DataFrame, min_confidence: int = 70) -> DataFrame:
    """Per image and field the first word above the confidence that holds a keyword; words as from word_list."""
    hits = keyword_boxes(words, field_defs.select("field", "keywords"), min_confidence, strict=True)
    first = hits.groupBy("image_id", "field").agg(F.min(F.struct("word_idx", "text", "left", "top", "width", "height", "conf")).alias("a"))
    return first.select("image_id", "field", "a.*")


def after_anchor(anchors: DataFrame, field_defs: DataFrame) -> DataFrame:
    """The search zone to the right of an anchor."""
    out = anchors.join(small(field_defs.select("field", "max_dx", "max_dy", "regex")), "field")
    return out.select("image_id", "field", "regex", F.col("word_idx").alias("anchor_idx"), F.expr("left + width").alias("z_left"), F.col("top").alias("z_top"), F.col("max_dx").alias("z_width"), F.expr("max_dy + height").alias("z_height"))


def _matches(text: Column, regex: Column, patterns: list[str]) -> Column:
    """Whole match of a column's pattern; those known beforehand are compiled once, not for each row."""
    out = None
    for p in dict.fromkeys(patterns):
        out = F.when(regex == p, fullmatch(text, p)) if out is None else out.when(regex == p, fullmatch(text, p))
    return fullmatch(text, regex) if out is None else out.otherwise(fullmatch(text, regex))


def best_value_in_zone(words: DataFrame, zones: DataFrame, min_confidence: int = 50, patterns: list[str] | None = None) -> DataFrame:
    """The most confident word of each zone that matches the zone's pattern as a whole; the first one on ties."""
    w = words_in_zone(words.filter(F.col("conf") > min_confidence), zones)
    w = w.filter((F.col("word_idx") != F.col("anchor_idx")) & _matches(F.col("text"), F.col("regex"), patterns or []))
    best = F.min(F.struct((-F.col("conf")).alias("low"), *[c for c in w.columns if c not in ("image_id", "field")])).alias("b")
    return w.groupBy("image_id", "field").agg(best).select("image_id", "field", "b.*").drop("low")


def multiword_spans(words: DataFrame, zones: DataFrame, most: int = 3, line_height: int = 30, min_confidence: int = 50) -> DataFrame:
    """The best run of one to ``most`` neighbouring words of a zone, in reading order, that matches as a whole."""
    w = words_in_zone(words.filter(F.col("conf") > min_confidence), zones).filter("word_idx <> anchor_idx")
    order = Window.partitionBy("image_id", "field").orderBy("top", "left", "word_idx")
    run = F.collect_list(F.struct("text", "y", "conf", "left", "top", "width", "height")).over(order.rowsBetween(0, most - 1))
    spans = w.select("image_id", "field", "regex", F.row_number().over(order).alias("start"), run.alias("run"))
    spans = spans.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("run")))).withColumn("run", F.slice("run", 1, F.col("n")))
    y = F.transform("run", lambda r: r["y"])
    value = F.array_join(F.transform("run", lambda r: r["text"]), " ")
    total = F.aggregate("run", F.lit(0.0), lambda a, r: a + r["conf"])
    spans = spans.filter(F.array_max(y) - F.array_min(y) <= line_height).withColumn("value", value).withColumn("confidence", total / F.col("n"))
    spans = spans.filter(fullmatch(F.col("value"), F.col("regex")))
    rank = F.row_number().over(Window.partitionBy("image_id", "field").orderBy(F.desc("confidence"), "start", "n"))
    edge = lambda f, a, b: f(F.transform("run", lambda r: r[a] + (r[b] if b else 0)))
    best = spans.withColumn("_r", rank).filter("_r = 1")
    left, top = edge(F.array_min, "left", None), edge(F.array_min, "top", None)
    return best.select("image_id", "field", "value", "confidence", left.alias("left"), top.alias("top"), (edge(F.array_max, "left", "width") - left).alias("width"), (edge(F.array_max, "top", "height") - top).alias("height"))


def nearest_value(near: DataFrame) -> DataFrame:
    """Of nearby_values, for each keyword box the nearest word with another text."""
    key = ["image_id", "field", "word_idx"]
    least = F.min(F.struct("distance", "v_idx", *[c for c in near.columns if c not in (*key, "distance", "v_idx")])).alias("n")
    return near.filter(F.lower("v_text") != F.lower("text")).groupBy(*key).agg(least).select(*key, "n.*").select(*near.columns)


def dynamic_zones_v1(words: DataFrame, images: DataFrame, definitions: DataFrame | Sequence[tuple] = ZONES_V1) -> DataFrame:
    """(image_id, field, left, top, width, height, confidence, keyword_found) from the most confident keyword word.
    definitions: (field, keywords, place, zone_width), the place beside the keyword or below it."""
    c = F.col("conf").cast("int")
    columns = ["field", "place", "zone_width"]
    defs = definitions if isinstance(definitions, DataFrame) else [(f, p, w, k) for f, k, p, w in definitions]
    hits = keyword_hits(words.filter((c > 20) & (F.trim("text") != "")), defs, columns, False, "field string, place string, zone_width int, keywords array<string>")
    hits = hits.withColumn("beside", F.col("place") == "beside").join(images.select("image_id", "img_width", "img_height"), "image_id")
    left = F.greatest(F.lit(0), F.when(F.col("beside"), F.expr("left + width + 10")).otherwise(F.col("left")))
    top = F.greatest(F.lit(0), F.when(F.col("beside"), F.col("top")).otherwise(F.expr("top + height + 5")))
    box = [left.alias("left"), top.alias("top"), F.least("zone_width", F.col("img_width") - left).alias("width"), F.least(F.when(F.col("beside"), F.expr("height + 10")).otherwise(30), F.col("img_height") - top).alias("height")]
    z = hits.select("image_id", "field", "k", "word_idx", c.alias("confidence"), F.lower("text").alias("keyword_found"), *box).filter("width > 0 and height > 0")
    best = F.min(F.struct((-F.col("confidence")).alias("low"), "k", "word_idx", "left", "top", "width", "height", "confidence", "keyword_found")).alias("b")
    return z.groupBy("image_id", "field").agg(best).select("image_id", "field", "b.*").drop("low", "k", "word_idx")


def dynamic_zones_fixed(words: DataFrame, images: DataFrame, radius: float = 150, margin: int = 5) -> DataFrame:
    """The box of the nearest value of the best keyword box, or a region by position.

    Keyword boxes meet the usable words of their image in one pass over its words, which carry the image's size."""
    names = [f for f, *_ in ZONES_FIXED]
    kept = [(d, k) for d, (_, ks, _) in enumerate(ZONES_FIXED) for k in ks]
    known = words.sparkSession.sparkContext.broadcast((np.array([d for d, _ in kept], np.int64), near.Held([k for _, k in kept]), np.array([r for *_, r in ZONES_FIXED])))
    c, (x, y), whole = F.col("conf").cast("int"), _centre(), lambda e: F.col(e).cast("int").alias(e)
    w = words.filter((c >= 20) & (F.trim("text") != ""))
    w = w.select("image_id", whole("word_idx"), "text", F.lower("text").alias("low"), *map(whole, ("left", "top", "width", "height")), c.alias("conf"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    w = images.select("image_id", whole("img_width"), whole("img_height")).hint("shuffle_hash").join(w, "image_id", "left")

    def run(every: pa.Table, image: np.ndarray):
        field, held, share = known.value
        first = np.unique(image, return_index=True)[1]  # a row of each image
        usable = np.asarray(pc.and_(every.column("x").is_valid(), every.column("y").is_valid()))
        t, at = every.filter(pa.array(usable)), image[usable]
        box, of, *_, value, _ = _values_by_box(t, at, field, held, radius)
        box, of, value = (v[value >= 0] for v in (box, of, value))
        (w_left, _), (w_top, _), (w_width, _), (w_height, _), (conf, _), (place, _) = (numbers(t.column(e)) for e in ("left", "top", "width", "height", "conf", "word_idx"))
        left, top = np.maximum(0, w_left[value] - margin), np.maximum(0, w_top[value] - margin)

        def size(e: str, start: np.ndarray, own: np.ndarray) -> np.ndarray:
            all_, known_ = numbers(t.column(e))
            return np.where(known_[box], np.minimum(all_[box] - start, own[value] + 2 * margin), own[value] + 2 * margin)

        width, height = size("img_width", left, w_width), size("img_height", top, w_height)
        ok = np.flatnonzero((width > 0) & (height > 0) & (conf[value] > 0))
        order = ok[np.lexsort((place[box[ok]], -conf[value[ok]], of[ok], at[box[ok]]))]
        group = at[box[order]] * len(names) + of[order]
        order, group = order[np.unique(group, return_index=True)[1]], np.unique(group)
        # by position, where no value is near
        iw, ih = (numbers(every.column(e))[0][first].astype(np.int64)[:, None] for e in ("img_width", "img_height"))
        cut = lambda a, b: np.trunc(a * b).astype(np.int64)
        r_left, r_top = np.maximum(0, np.minimum(cut(iw, share[:, 0]), iw - 1)), np.maximum(0, np.minimum(cut(ih, share[:, 1]), ih - 1))
        out = [v.ravel() for v in (r_left, r_top, np.minimum(cut(iw, share[:, 2]), iw - r_left), np.minimum(cut(ih, share[:, 3]), ih - r_top))]
        confidence, text = np.full(len(out[0]), 30), np.full(len(out[0]), -1)
        for column, of_value in zip((*out, confidence, text), (left, top, width, height, conf[value], value), strict=True):
            column[group] = of_value[order]
        some = np.flatnonzero((text >= 0) | ((out[2] > 0) & (out[3] > 0)))
        found, rows = text[some] >= 0, np.broadcast_to(first[:, None], (len(first), len(names))).ravel()[some]
        columns = {"image_id": every.column("image_id").take(pa.array(rows)), "field": pa.array(names).take(pa.array(some % len(names)))}
        columns |= {e: pa.array(v[some], pa.int32()) for e, v in zip(("left", "top", "width", "height", "confidence"), (*out, confidence), strict=True)}
        columns |= {"detected_text": t.column("text").take(pa.array(text[some], mask=~found)), "method": pa.array(np.where(found, "value_box_direct", "fallback_relative_position"))}
        yield from pa.table(columns).combine_chunks().to_batches()

    return near.by_image(w, run, "image_id string, field string, `left` int, top int, width int, height int, confidence int, detected_text string, method string")


def template_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The anchors and regions of the template that ships with the library."""
    anchors = spark.createDataFrame([(TEMPLATE, a) for a in TEMPLATE_ANCHORS], "template string, anchor string")
    regions = spark.createDataFrame([(TEMPLATE, *r) for r in TEMPLATE_REGIONS], "template string, name string, left_rel double, top_rel double, width_rel double, height_rel double")
    return anchors, regions


def _few_templates(anchors: DataFrame, regions: DataFrame) -> tuple[list[tuple], list[tuple]] | None:
    """The rows of both tables if they are few enough for literals."""
    a = [tuple(x) for x in anchors.select("template", "anchor").limit(TEMPLATE_LITERALS + 1).collect()]
    r = [tuple(x) for x in regions.select("template", "name", "left_rel", "top_rel", "width_rel", "height_rel").limit(TEMPLATE_LITERALS + 1).collect()] if len(a) <= TEMPLATE_LITERALS else []
    return (a, r) if max(len(a), len(r)) <= TEMPLATE_LITERALS else None


def template_scores(words: DataFrame, images: DataFrame, anchors: DataFrame, regions: DataFrame, min_confidence: int = 30, share: float = 0.3) -> DataFrame:
    """(image_id, template, text_score, structural_score) for every image and template, in one grouped pass over the words.

    A word says for each anchor whether it holds it and for each region whether
    it covers enough of it: flags that are joined by the aggregation. Many
    templates are scored from an index instead."""
    few = _few_templates(anchors, regions)
    if few is None:
        return templates.every_score(words, images, anchors, regions, min_confidence, share)
    a, r = few
    if not a and not r:
        return images.select("image_id", F.lit("").alias("template"), F.lit(0.0).alias("text_score"), F.lit(0.0).alias("structural_score")).limit(0)
    sizes = images.select("image_id", "img_width", "img_height", F.upper("full_text").alias("_full"))
    for i, (_, _, *rel) in enumerate(r):
        sizes = sizes.withColumns({f"_{c}{i}": (F.lit(x) * F.col(f"img_{d}")).cast("int") for c, x, d in zip("lewh", rel, ("width", "height", "width", "height"), strict=True)})
    in_word = F.flatten(F.transform(F.array(F.upper("text")), lambda up: F.array(*[up.contains(k.upper()) for _, k in a]))) if a else F.array()
    w = words.select("image_id", in_word.alias("_in"), (F.col("conf").cast("int") > min_confidence).alias("_ok"), "left", "top", "width", "height")
    w = sizes.join(w, "image_id", "left")
    holds = [(F.coalesce(F.col("_full").contains(k.upper()), F.lit(False)) | F.coalesce(F.get("_in", i), F.lit(False))).alias(f"a{i}") for i, (_, k) in enumerate(a)]

    def covers(i: int) -> Column:
        across = F.expr(f"greatest(0, least(left + width, _l{i} + _w{i}) - greatest(left, _l{i})) * greatest(0, least(top + height, _e{i} + _h{i}) - greatest(top, _e{i}))")
        area = F.expr(f"_w{i} * _h{i}")
        return F.coalesce(F.col("_ok") & (area > 0) & (across > share * area), F.lit(False)).alias(f"r{i}")

    w = w.select("image_id", *holds, *[covers(i) for i in range(len(r))])
    flags = w.groupBy("image_id").agg(*[F.max(c).alias(c) for c in w.columns if c != "image_id"])
    mean = lambda columns: sum((F.col(c).cast("int") for c in columns), F.lit(0)) / F.lit(len(columns)) if columns else F.lit(None).cast("double")
    names = sorted({t for t, *_ in a} | {t for t, *_ in r})
    scores = [F.struct(F.lit(t).alias("template"), mean([f"a{i}" for i, x in enumerate(a) if x[0] == t]).alias("text_score"), mean([f"r{i}" for i, x in enumerate(r) if x[0] == t]).alias("structural_score")) for t in names]
    return flags.select("image_id", F.inline(F.array(*scores)))


def text_anchor_score(words: DataFrame, images: DataFrame, anchors: DataFrame) -> DataFrame:
    """The share of a template's anchors found in the full text or in any word."""
    none = template_tables(words.sparkSession)[1].limit(0)
    return template_scores(words, images, anchors, none).select("image_id", "template", "text_score")


def structural_score(words: DataFrame, images: DataFrame, regions: DataFrame, min_confidence: int = 30, share: float = 0.3) -> DataFrame:
    """The share of a template's regions that one word covers by more than ``share``."""
    none = template_tables(words.sparkSession)[0].limit(0)
    return template_scores(words, images, none, regions, min_confidence, share).select("image_id", "template", "structural_score")


def best_template(words: DataFrame, images: DataFrame, anchors: DataFrame, regions: DataFrame, least: float = 0.4) -> DataFrame:
    """The best template of each image, if it reaches ``least``; the first by name on ties."""
    if _few_templates(anchors, regions) is None:
        return templates.best_score(words, images, anchors, regions, least)
    s = template_scores(words, images, anchors, regions)
    score = 0.6 * F.coalesce("text_score", F.lit(0.0)) + 0.4 * F.coalesce("structural_score", F.lit(0.0))
    s = s.withColumn("score", score).filter((F.col("score") > 0) & (F.col("score") >= least))
    best = s.groupBy("image_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "template", "text_score", "structural_score", "score")).alias("b"))
    return best.select("image_id", "b.*").drop("low")


def template_fields(best: DataFrame, campos: DataFrame) -> DataFrame:
    """The field regions of each image's template."""
    return best.select("image_id", "template", "score").join(small(campos), "template")


def identify_template_or_zones(words: DataFrame, images: DataFrame, anchors: DataFrame, regions: DataFrame, campos: DataFrame, zones: str = "v1") -> DataFrame:
    """C4: template regions, or dynamic zones (v1 or fixed) for images without a template.

    Images are scored once: the winners, a row for an image at most, are written to
    the shared folder and read twice, for their fields and to leave them out before
    any zone is made."""
    best = io.staged(best_template(words, images, anchors, regions), "best-template")
    known = best.select("image_id")
    rest = images.join(known, "image_id", "left_anti")
    fixed = template_fields(best, campos).select("image_id", "field", "left", "top", "width", "height", F.col("template"))
    z = (dynamic_zones_v1 if zones == "v1" else dynamic_zones_fixed)(words.join(known, "image_id", "left_anti"), rest)
    return fixed.unionByName(z.select("image_id", "field", "left", "top", "width", "height", F.lit(None).cast("string").alias("template")))
