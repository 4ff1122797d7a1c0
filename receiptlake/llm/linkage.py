"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

CHUNK = 1_000_000


def _forest(it):
    """Stars with the same components as the edges of a task, chunk by chunk: never more rows than the chunk has nodes."""
    held, n = [], 0

    def stars():
        e = np.concatenate(held)
        ids, ends = np.unique(e, return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        inner = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(ids[label[inner]])], ["u", "v"])

    for batch in it:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
            n += batch.num_rows
        if n >= CHUNK:
            yield stars()
            held, n = [], 0
    if held:
        yield stars()


def _are_stars(pairs: DataFrame) -> bool:
    """Each u has one v, and no v is a u: then every v is its component's smallest id."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("least"))
    return not seen.filter("out > 1 or (out > 0 and least = 0)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest reachable id for every id that occurs in edges (a, b).

    Tasks first turn their own edges into stars. Every step then points nodes at
    the smallest neighbour known so far: two grouped minimums with joins back,
    in a table that never exceeds the edges plus the nodes. The loop ends when
    the table is a set of stars; the number of steps is logarithmic in the
    longest path."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    pairs = cut(pairs.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.filter("u <> v").mapInArrow(_forest, "u long, v long").distinct(), "edges")
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
