"""Pixel metrics in one pass and from tiles, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from receiptlake.operators import quality

ARRAYS, BYTES = "image_id string, width int, height int, gray array<int>", "image_id string, width int, height int, gray binary"


def plain(g):
    """All metrics of a 2-d image, written out."""
    h, w = g.shape
    lap, noise = np.zeros(g.shape), np.zeros(g.shape)
    at = lambda i, n, reach: (abs(i) if i < 0 else 2 * (n - 1) - i if i >= n else i) if min(h, w) > reach else min(max(i, 0), n - 1)
    k = [1, 4, 6, 4, 1]
    for y in range(h):
        for x in range(w):
            near = lambda dy, dx, r, y=y, x=x: int(g[at(y + dy, h, r), at(x + dx, w, r)])
            lap[y, x] = near(-1, 0, 1) + near(1, 0, 1) + near(0, -1, 1) + near(0, 1, 1) - 4 * int(g[y, x])
            rows = sum(k[i] * k[j] * near(i - 2, j - 2, 2) for i in range(5) for j in range(5))
            noise[y, x] = abs(int(g[y, x]) - (rows + 128) // 256)
    flat = g.ravel().astype(float)
    return dict(brightness=flat.mean(), std=flat.std(), min=int(flat.min()), max=int(flat.max()), median=float(np.median(flat)), dark_percentage=(flat < 85).mean() * 100, bright_percentage=((flat >= 170) & (flat < 255)).mean() * 100, sharpness=lap.var(), noise_level=noise.std())


def images():
    rng = np.random.default_rng(6)
    shapes = [(1, 1), (1, 5), (2, 2), (2, 7), (3, 3), (3, 9), (5, 4), (8, 8), (17, 13), (20, 31)]
    return {f"i{k}": rng.integers(0, 256, s).astype(np.uint8) if k % 3 else np.full(s, 255 * (k % 2), np.uint8) for k, s in enumerate(shapes)}


@pytest.mark.parametrize("schema", [ARRAYS, BYTES])
def test_one_pass(spark, schema):
    rows = [(i, g.shape[1], g.shape[0], g.ravel().tolist() if schema == ARRAYS else bytes(g.ravel())) for i, g in images().items()]
    table = spark.createDataFrame([*rows, ("null", 2, 2, None), ("empty", 0, 0, [] if schema == ARRAYS else b""), ("torn", 2, 2, rows[4][3])], schema)
    got = {r["image_id"]: r.asDict() for r in quality.measured(table).drop("gray").collect()}
    for i, g in images().items():
        for name, value in plain(g).items():
            assert got[i][name] == pytest.approx(value, abs=1e-9), (i, name)
    assert got["null"]["brightness"] is None and got["empty"]["median"] is None and got["torn"]["sharpness"] is None and got["torn"]["brightness"] is not None
    assert quality.diagnose_images(table.limit(0)).count() == 0


def test_values_that_are_no_gray(spark):
    r = quality.measured(spark.createDataFrame([("i", 2, 2, [-5, 300, 10, 10])], ARRAYS)).first()
    assert (r["min"], r["max"], r["median"], r["brightness"]) == (-5, 300, 10.0, 78.75)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 100])
def test_any_tiling_equals_the_image(spark, size):
    rows = [(i, g.shape[1], g.shape[0], bytes(g.ravel())) for i, g in images().items() if min(g.shape) > 2 or min(g.shape) == 1]
    table = spark.createDataFrame(rows, BYTES)
    tiles = quality.split(table, size)
    assert tiles.filter(F.greatest("width", "height") > size).count() == 0
    names = [*plain(np.zeros((1, 1), np.uint8))]
    whole = {r["image_id"]: [r[n] for n in names] for r in quality.measured(table).collect()}
    got = {r["image_id"]: [r[n] for n in names] for r in quality.measured_tiles(tiles.repartition(5)).collect()}
    assert got == whole


def test_large_images_in_one_pass(spark):
    """2000 x 2000 pixels, several to a batch, as arrays made where they are read."""
    table = spark.range(6).select(F.col("id").cast("string").alias("image_id"), F.lit(2000).alias("width"), F.lit(2000).alias("height"), F.transform(F.sequence(F.lit(0), F.lit(3_999_999)), lambda i: ((i * 7 + F.col("id") * i) % 256).cast("int")).alias("gray"))
    got = {r["image_id"]: r for r in quality.measured(table).drop("gray").collect()}
    g = ((np.arange(4_000_000, dtype=np.int64) * 8) % 256).astype(np.uint8)
    assert len(got) == 6 and got["1"]["brightness"] == pytest.approx(g.mean()) and got["1"]["median"] == np.median(g)
    p = np.pad(g.reshape(2000, 2000).astype(int), 1, mode="reflect")
    assert got["1"]["sharpness"] == pytest.approx((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())
