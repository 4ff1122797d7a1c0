"""Scores of many templates: an index from anchors to templates, and bounds that spare most region tests.

One automaton of all distinct anchors reads full texts and words, and images
become one row each: the anchors found, and the boxes that count. The index
gives a template's share of found anchors. 0.6 of that and 0.4 of the share of
its regions that the image's largest box could cover at all is a bound; regions
are tested only for templates whose bound reaches the best score so far, so that
the winner is the one that scoring all of them would give.

Indexes are broadcast in parts of at most PART rows of anchors and regions, by
template; parts are scored one by one, and the best of them is an image's.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import held_patterns

PART, STEP = 200_000, 256
RELATIVE = ["left_rel", "top_rel", "width_rel", "height_rel"]


class Index:
    def __init__(self, anchors: list[tuple[str, str]], regions: list[tuple]):
        self.names = sorted({t for t, *_ in anchors} | {t for t, *_ in regions})
        number = {t: i for i, t in enumerate(self.names)}
        n = len(self.names)
        self.anchors = sorted({a.upper() for _, a in anchors})
        place = {a: i for i, a in enumerate(self.anchors)}
        pairs = np.array(sorted((place[a.upper()], number[t]) for t, a in anchors), np.int64).reshape(-1, 2)
        self.of_anchor = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(self.anchors)))) if self.anchors else []
        self.n_anchors = np.bincount(pairs[:, 1], minlength=n)
        boxes: dict[tuple, int] = {}
        owned = np.array(sorted((number[t], boxes.setdefault(tuple(rel), len(boxes))) for t, _, *rel in regions), np.int64).reshape(-1, 2)
        self.owner, self.region = owned[:, 0], owned[:, 1]
        self.n_regions = np.bincount(self.owner, minlength=n)
        self.first = np.cumsum(self.n_regions) - self.n_regions
        self.relative = np.array(list(boxes), np.float64).reshape(-1, 4)

    def text(self, found: np.ndarray) -> np.ndarray:
        """Each template's share of anchors found; 0 without anchors."""
        hits = [self.of_anchor[a] for a in found]
        counts = np.bincount(np.concatenate(hits), minlength=len(self.names)) if hits else np.zeros(len(self.names), np.int64)
        return counts / np.maximum(self.n_anchors, 1)


class Page:
    """An image's boxes against the distinct regions of an index; a region is tested once at most."""

    def __init__(self, index: Index, width: int, height: int, boxes: np.ndarray, share: float):
        self.index, self.share = index, share
        self.boxes = boxes.astype(np.int64)
        self.at = np.trunc(index.relative * [width, height, width, height]).astype(np.int64)  # as a cast to int does
        self.area = self.at[:, 2] * self.at[:, 3]
        largest = int((self.boxes[:, 2] * self.boxes[:, 3]).max()) if len(boxes) else 0
        self.possible = (self.area > 0) & (share * self.area < largest)
        self.covered = np.full(len(self.at), -1, np.int8)

    def _regions(self, templates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.index.n_regions[templates]
        at = np.repeat(self.index.first[templates] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.index.region[at], np.repeat(np.arange(len(templates)), n)

    def reachable(self) -> np.ndarray:
        """The most that each template's share of covered regions can be."""
        some = self.possible[self.index.region]
        return np.bincount(self.index.owner[some], minlength=len(self.index.names)) / np.maximum(self.index.n_regions, 1)

    def structure(self, templates: np.ndarray) -> np.ndarray:
        """The share of each template's regions that a box covers enough of; 0 without regions."""
        regions, owner = self._regions(templates)
        new = np.unique(regions[self.covered[regions] < 0])
        if len(new):
            self.covered[new] = 0
            test = new[self.possible[new]]
            if len(test):
                left, top, width, height = (self.at[test, k][:, None] for k in range(4))
                x, y, w, h = (self.boxes[:, k][None, :] for k in range(4))
                across = np.maximum(0, np.minimum(x + w, left + width) - np.maximum(x, left)) * np.maximum(0, np.minimum(y + h, top + height) - np.maximum(y, top))
                self.covered[test] = (across > self.share * self.area[test][:, None]).any(1)
        hits = np.bincount(owner[self.covered[regions] == 1], minlength=len(templates))
        return hits / np.maximum(self.index.n_regions[templates], 1)


def _rows(words: DataFrame, images: DataFrame, anchors: list[str], min_confidence: int) -> DataFrame:
    """(image_id, img_width, img_height, found, boxes): one row for each image."""
    spark = words.sparkSession
    ok = F.col("conf").cast("int") > min_confidence
    w = words.select("image_id", held_patterns(spark, F.upper("text"), anchors).alias("ids"), F.when(ok, F.struct("left", "top", "width", "height")).alias("box"))
    w = w.groupBy("image_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("in_words"), F.collect_list("box").alias("boxes"))
    i = images.select("image_id", "img_width", "img_height", held_patterns(spark, F.upper("full_text"), anchors).alias("ids"))
    none = F.array().cast("array<int>")
    return i.join(w, "image_id", "left").select("image_id", "img_width", "img_height", F.array_union(F.col("ids"), F.coalesce("in_words", none)).alias("found"), F.coalesce("boxes", F.array().cast(w.schema["boxes"].dataType)).alias("boxes"))


def _pages(batch: pa.RecordBatch):
    """(image_id, width, height, found, boxes) of each row."""
    found, boxes = batch.column(3), batch.column(4)
    parts = boxes.flatten()
    flat = np.stack([np.asarray(parts.field(k)) for k in range(4)], 1) if len(parts) else np.zeros((0, 4), np.int64)
    ids = np.asarray(found.flatten())
    fe, be = np.cumsum([0, *found.value_lengths().to_pylist()]), np.cumsum([0, *boxes.value_lengths().to_pylist()])
    for i, (image, width, height) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
        yield image, width, height, ids[fe[i] : fe[i + 1]], flat[be[i] : be[i + 1]]


def _winner(index: Index, page: Page, text: np.ndarray, least: float) -> tuple[int, float, float] | None:
    """(template, structural score, score) of the best template that has a score and reaches least; the first on ties."""
    if not len(text):
        return None
    bound = 0.6 * text + 0.4 * page.reachable()
    best, won = least, None

    def tried(some: np.ndarray):
        nonlocal best, won
        s = page.structure(some)
        score = 0.6 * text[some] + 0.4 * s
        ok = np.flatnonzero((score >= best) & (score > 0))
        if len(ok):
            k = ok[np.lexsort((some[ok], -score[ok]))[0]]
            if won is None or (-score[k], some[k]) < (-won[2], won[0]):
                best, won = score[k], (int(some[k]), float(s[k]), float(score[k]))

    tried(np.array([int(bound.argmax())]))
    left = np.flatnonzero(bound >= best)
    left = left[np.argsort(-bound[left], kind="stable")]
    for lo in range(0, len(left), STEP):
        some = left[lo : lo + STEP]
        some = some[bound[some] >= best]
        if not len(some):
            break
        tried(some)
    return won


def _parts(anchors: DataFrame, regions: DataFrame):
    """Indexes of at most about PART rows each, every template whole in one."""
    rows = anchors.select("template").unionByName(regions.select("template"))
    parts = max(1, ceil(rows.count() / PART))
    own = lambda df, p: df.filter(F.pmod(F.xxhash64("template"), F.lit(parts)) == p)
    for p in range(parts):
        yield Index([tuple(x) for x in own(anchors, p).select("template", "anchor").collect()], [tuple(x) for x in own(regions, p).select("template", "name", *RELATIVE).collect()])


SCORES = "image_id string, template string, text_score double, structural_score double"


def every_score(words: DataFrame, images: DataFrame, anchors: DataFrame, regions: DataFrame, min_confidence: int = 30, share: float = 0.3) -> DataFrame:
    """(image_id, template, text_score, structural_score) of every image and template; null where a template has no anchors or no regions."""
    outs = []
    for index in _parts(anchors, regions):
        known = words.sparkSession.sparkContext.broadcast(index)

        def run(it, known=known):
            index = known.value
            every = np.arange(len(index.names))
            names = pa.array(index.names)
            for batch in it:
                for image, width, height, found, boxes in _pages(batch):
                    text, structure = index.text(found), Page(index, width, height, boxes, share).structure(every)
                    yield pa.RecordBatch.from_arrays([pa.array([image] * len(names), pa.string()), names, pa.array(text, mask=index.n_anchors == 0), pa.array(structure, mask=index.n_regions == 0)], ["image_id", "template", "text_score", "structural_score"])

        outs.append(_rows(words, images, index.anchors, min_confidence).mapInArrow(run, SCORES))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def best_score(words: DataFrame, images: DataFrame, anchors: DataFrame, regions: DataFrame, least: float = 0.4, min_confidence: int = 30, share: float = 0.3) -> DataFrame:
    """(image_id, template, text_score, structural_score, score): the best template of each image that reaches ``least``."""
    outs = []
    for index in _parts(anchors, regions):
        known = words.sparkSession.sparkContext.broadcast(index)

        def run(it, known=known):
            index = known.value
            for batch in it:
                rows = []
                for image, width, height, found, boxes in _pages(batch):
                    text = index.text(found)
                    won = _winner(index, Page(index, width, height, boxes, share), text, least)
                    if won:
                        t, s, score = won
                        rows.append((image, index.names[t], float(text[t]) if index.n_anchors[t] else None, s if index.n_regions[t] else None, score))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.string(), pa.string(), *[pa.float64()] * 3], strict=True)], ["image_id", "template", "text_score", "structural_score", "score"])

        outs.append(_rows(words, images, index.anchors, min_confidence).mapInArrow(run, SCORES + ", score double"))
    out = outs[0]
    if len(outs) == 1:
        return out
    for o in outs[1:]:
        out = out.unionByName(o)
    best = out.groupBy("image_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "template", "text_score", "structural_score", "score")).alias("b"))
    return best.select("image_id", "b.*").drop("low")
