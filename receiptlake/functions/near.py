"""Words of an image that lie near each other, on flat columns.

Rows are dealt out by image, ordered by a hash of it inside each partition, and
read as Arrow batches that end where an image ends, so that neither an image's
words nor pairs of them are shuffled. Pairs come from a grid as wide as the reach:
a dense page costs its near pairs only, and they are handed on in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton

#: Pairs that are looked at together, and rows that are read together unless one image has more.
PAIRS, ROWS = 2_000_000, 100_000
#: Patterns up to which texts are searched for one after another.
FEW = 64


def whole_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some ROWS rows; rows with the same hash, which is the first column, are in one."""
    kept, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        h = np.asarray(batch.column(0))
        cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on in the next batch
        if not cut and (len(kept) == 1 or kept[-2].column(0)[-1].as_py() == h[-1]):
            continue
        yield pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)])
        kept, n = [batch.slice(cut)], batch.num_rows - cut
    if kept:
        yield pa.Table.from_batches(kept)


def numbered(images: pa.ChunkedArray) -> np.ndarray:
    """Each row's image by number; null is one too."""
    coded = images.combine_chunks().dictionary_encode()
    return np.asarray(pc.fill_null(coded.indices, len(coded.dictionary))).astype(np.int64)


def by_image(rows: DataFrame, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run on tables of whole images and each row's image by number; rows has image_id."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "image_id").select(F.xxhash64("image_id").alias("_h"), *rows.columns).sortWithinPartitions("_h")

    def each(batches):
        for t in whole_images(batches):
            yield from run(t, numbered(t.column("image_id")))

    return dealt.mapInArrow(each, schema)


class Held:
    """The patterns that texts hold, as a broadcast value."""

    def __init__(self, patterns: Sequence[str], groups: Sequence[int] | None = None):
        self.patterns, self.groups = list(patterns), None if groups is None else np.array(groups, np.int64)
        self.automaton = Automaton(patterns) if len(self.patterns) > FEW else None

    def find(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern) for each pattern that a row's text holds, or the first of each group, in order."""
        coded = texts.combine_chunks().dictionary_encode()
        if self.automaton:
            at, pattern = self.automaton.find(coded.dictionary)
        else:
            hit = np.stack([np.asarray(pc.match_substring(coded.dictionary, p)) for p in self.patterns], 1) if self.patterns else np.zeros((len(coded.dictionary), 0), bool)
            at, pattern = np.nonzero(hit)
        if self.groups is not None and len(at):
            pair = at * (int(self.groups.max()) + 1) + self.groups[pattern]
            first = np.sort(np.unique(pair, return_index=True)[1])
            at, pattern = at[first], pattern[first]
        lo = np.searchsorted(at, np.arange(len(coded.dictionary) + 1))
        code = np.asarray(pc.fill_null(coded.indices, len(coded.dictionary)))
        n = np.append(np.diff(lo), 0)[code]  # a null text holds nothing
        return np.repeat(np.arange(len(code)), n), pattern[np.repeat(lo[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def near(image: np.ndarray, x: np.ndarray, y: np.ndarray, of: np.ndarray, to_x: np.ndarray, to_y: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in blocks: points i of images ``of`` at (to_x, to_y), and points j of the same image in the nine cells around, each pair once; i rises.

    image, x, y: the points j. All pairs within the reach in both directions are among them."""
    size = max(float(reach), 1.0)
    if not len(x) or not len(to_x):
        return
    cell = lambda v: np.floor(v / size).astype(np.int64)
    cx, cy, tx, ty = cell(x), cell(y), cell(to_x), cell(to_y)
    low_x, low_y = min(cx.min(), tx.min()) - 1, min(cy.min(), ty.min()) - 1
    cx, cy, tx, ty = cx - low_x, cy - low_y, tx - low_x, ty - low_y
    wide, high = int(max(cx.max(), tx.max())) + 2, int(max(cy.max(), ty.max())) + 2
    columns, column = np.unique(image * wide + cx, return_inverse=True)
    key = column * high + cy
    order = np.argsort(key, kind="stable")
    key = key[order]
    lo, hi = [], []
    for step in (-1, 0, 1):
        asked = of * wide + tx + step
        at = np.minimum(np.searchsorted(columns, asked), len(columns) - 1)
        known = columns[at] == asked
        lo.append(np.searchsorted(key, at * high + ty - 1))
        hi.append(np.where(known, np.searchsorted(key, at * high + ty + 1, "right"), lo[-1]))
    lo, n = np.stack(lo, 1), np.stack(hi, 1) - np.stack(lo, 1)
    ends = np.cumsum(n.sum(1))
    start = 0
    while start < len(of):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        m = n[start:stop].ravel()
        at = np.repeat(lo[start:stop].ravel() - (np.cumsum(m) - m), m) + np.arange(m.sum())
        yield np.repeat(np.arange(start, stop), n[start:stop].sum(1)), order[at]
        start = stop
