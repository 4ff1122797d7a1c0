"""Image diagnosis from gray pixels, and the preprocessing that follows from it.

Pixels of an image stay in its row: nothing is exploded, nothing is shuffled. One
pass over an image's pixels counts them by gray value, from which mean, deviation,
least, greatest and median value and all shares follow, and sums what its texture
needs. Pixels are an array of whole numbers, or bytes, which take a quarter of the
room. An image too large for a row comes as tiles (``split``); their counts and
sums are whole numbers and add up to the image's, so any tiling gives the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARP_HIGH, SHARP_MEDIUM, BRIGHT_HIGH, BRIGHT_LOW, NOISE_HIGH, NOISE_MEDIUM = 500, 100, 180, 80, 15, 8
#: Gray values 0..84 are dark, 170..254 bright.
DARK, BRIGHT, GRAYS = (0, 85), (170, 255), 256
HALO = 2
BLUR = np.array([1, 4, 6, 4, 1])
LIGHT = "brightness double, std double, min int, max int, median double, dark_percentage double, bright_percentage double"
TEXTURE = "sharpness double, noise_level double"


def _light(values: np.ndarray, counts: np.ndarray) -> tuple:
    """M1 and M2's shares from the gray values of an image, in order, and how often each occurs."""
    n = int(counts.sum())
    if not n:
        return (None,) * 7
    upto = np.cumsum(counts)
    at = lambda i: int(values[np.searchsorted(upto, i, "right")])
    mean, square = int((values * counts).sum()) / n, int((values * values * counts).sum())
    share = lambda lo, hi: int(counts[(values >= lo) & (values < hi)].sum()) / n * 100
    return mean, max(0.0, square / n - mean * mean) ** 0.5, int(values[0]), int(values[-1]), (at((n - 1) // 2) + at(n // 2)) / 2, share(*DARK), share(*BRIGHT)


def _histogram(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if g.dtype != np.uint8 and len(g) and (g.min() < 0 or g.max() >= GRAYS):  # no gray values, but counted as they are
        return np.unique(g.astype(np.int64), return_counts=True)
    counts = np.bincount(g, minlength=GRAYS)
    values = np.flatnonzero(counts)
    return values, counts[values]


def _sums(p: np.ndarray) -> tuple[int, int, int, int]:
    """Sums of the Laplacian, its square, and of the difference from the 5 x 5 Gaussian blur and its square. p: pixels with HALO more on each side, whole numbers."""
    h, w = p.shape[0] - 2 * HALO, p.shape[1] - 2 * HALO
    g = p[2:-2, 2:-2]
    laplacian = p[1 : 1 + h, 2:-2] + p[3 : 3 + h, 2:-2] + p[2:-2, 1 : 1 + w] + p[2:-2, 3 : 3 + w] - 4 * g
    rows = sum(k * p[i : i + h] for i, k in enumerate(BLUR))
    noise = np.abs(g - (sum(k * rows[:, i : i + w] for i, k in enumerate(BLUR)) + 128) // 256)
    return int(laplacian.sum()), int((laplacian * laplacian).sum()), int(noise.sum()), int((noise * noise).sum())


def _mode(width: int, height: int, reach: int) -> str:
    return "reflect" if min(width, height) > reach else "edge"


def _padded(g: np.ndarray, pad: tuple[int, int, int, int], width: int, height: int) -> np.ndarray | None:
    """g with what its image's borders reflect (top, bottom, left, right); None if an image is so small that both metrics need borders of their own."""
    if _mode(width, height, 1) != _mode(width, height, HALO):
        return None
    return np.pad(g.astype(np.int32 if g.dtype == np.uint8 else np.int64), (pad[:2], pad[2:]), mode=_mode(width, height, HALO))


def _spread(total: int, square: int, n: int) -> float:
    """The population variance of n whole numbers from their sum and the sum of their squares."""
    return (square * n - total * total) / (n * n)


def _texture(g: np.ndarray, width: int, height: int) -> tuple:
    """M3 and M4 of a whole image."""
    if not len(g) or len(g) != width * height:
        return None, None
    g = g.reshape(height, width)
    g = g.astype(np.uint8 if g.min() >= 0 and g.max() < GRAYS else np.int64)
    p = _padded(g, (HALO,) * 4, width, height)
    if p is not None:
        a, b, c, d = _sums(p)
    else:
        g = g.astype(np.int64)
        one, two = (np.pad(np.pad(g, r, mode=_mode(width, height, r)), HALO - r, mode="edge") for r in (1, HALO))
        (a, b), (c, d) = _sums(one)[:2], _sums(two)[2:]
    return _spread(a, b, g.size), max(0.0, _spread(c, d, g.size)) ** 0.5


def _pixels(column: pa.Array):
    """Each image's pixels, or None; rows of bytes and of numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    for v in column:
        if not v.is_valid:
            yield None
        elif raw:
            yield np.frombuffer(v.as_buffer(), np.uint8)
        else:
            yield None if v.values.null_count else v.values.to_numpy(zero_copy_only=False)


def measured(pixels: DataFrame, light: bool = True, texture: bool = True) -> DataFrame:
    """pixels with M1 and the shares of M2 (light), M3 and M4 (texture), all made in one pass.

    Images that are null, empty or hold nulls have null metrics; so has the texture of those whose pixels are not width x height."""
    parts = [p for p, on in ((LIGHT, light), (TEXTURE, texture)) if on]
    names = [f.split()[0] for p in parts for f in p.split(", ")]
    kinds = [pa.int32() if n in ("min", "max") else pa.float64() for n in names]

    def run(gray: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        rows = []
        for g, w, h in zip(_pixels(gray), width.to_pylist(), height.to_pylist(), strict=True):
            row = () if not light else _light(*_histogram(g)) if g is not None else (None,) * 7
            rows.append(row + (() if not texture else _texture(g, w or 0, h or 0) if g is not None else (None, None)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    made = F.arrow_udf(run, "struct<" + ", ".join(parts).replace(" ", ":").replace(",:", ",") + ">")
    out = pixels.withColumn("_m", made("gray", "width", "height"))
    return out.select(*[c for c in pixels.columns if c not in names], *[F.col(f"_m.{n}").alias(n) for n in names])


def brightness_stats(pixels: DataFrame) -> DataFrame:
    """M1: mean, population deviation, least, greatest and median gray; with the shares that M2 needs, as they come from the same counts."""
    return measured(pixels, texture=False)


def dark_background(d: DataFrame) -> DataFrame:
    """M2, on brightness_stats: shares of values 0..84 and 170..254, and whether the background is dark."""
    dark = (F.col("brightness") < 85) & (F.col("median") < 85) & (F.col("dark_percentage") > 60)
    return d.withColumn("is_dark", dark).withColumn("dark_confidence", F.when(dark, F.col("dark_percentage") / 100).otherwise(0.0))


def texture(pixels: DataFrame) -> DataFrame:
    """M3 and M4: variance of the Laplacian, and deviation from a 5 x 5 Gaussian blur."""
    return measured(pixels, light=False)


# images in tiles

TILES = "image_id string, img_width int, img_height int, x int, y int, width int, height int, pixels binary"


def split(pixels: DataFrame, size: int) -> DataFrame:
    """Tiles of at most size x size pixels, each with up to HALO neighbours on every side that is not the image's border: (image_id, img_width, img_height, x, y, width, height, pixels).
    x, y, width and height are the tile's own; pixels are bytes, its halo included."""

    def run(it):
        for batch in it:
            for image, w, h, g in zip(*(batch.column(k).to_pylist() for k in range(3)), _pixels(batch.column(3)), strict=True):
                if g is None or len(g) != w * h:
                    continue
                g = g.astype(np.uint8).reshape(h, w)
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        x1, y1 = min(w, x + size), min(h, y + size)
                        part = g[max(0, y - HALO) : y1 + HALO, max(0, x - HALO) : x1 + HALO]
                        yield pa.RecordBatch.from_pylist([{"image_id": image, "img_width": w, "img_height": h, "x": x, "y": y, "width": x1 - x, "height": y1 - y, "pixels": part.tobytes()}], pa.schema([("image_id", pa.string()), *[(c, pa.int32()) for c in ("img_width", "img_height", "x", "y", "width", "height")], ("pixels", pa.binary())]))

    return pixels.select("image_id", "width", "height", "gray").mapInArrow(run, TILES)


def measured_tiles(tiles: DataFrame) -> DataFrame:
    """(image_id, *M1, *M2's shares, *M3, *M4) of images that come as tiles with halos.

    A tile becomes counts by gray value and four sums of its own pixels; these are
    added up by image, so that no task holds more than a tile's pixels."""
    sums = ["a", "b", "c", "d"]

    def run(it):
        for batch in it:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows = []
            for image, w, h, x, y, tw, th, raw in zip(*(column[c].to_pylist() for c in ("image_id", "img_width", "img_height", "x", "y", "width", "height")), column["pixels"], strict=True):
                left, top = min(HALO, x), min(HALO, y)
                right, bottom = min(HALO, w - x - tw), min(HALO, h - y - th)
                g = np.frombuffer(raw.as_buffer(), np.uint8).reshape(top + th + bottom, left + tw + right)
                own = g[top : top + th, left : left + tw].ravel()
                p = _padded(g, (HALO - top, HALO - bottom, HALO - left, HALO - right), w, h)
                if p is None:
                    raise ValueError(f"image {image} of {w} x {h} pixels needs no tiles")
                values, counts = _histogram(own)
                rows.append({"image_id": image, "bins": [{"g": int(v), "n": int(n)} for v, n in zip(values, counts, strict=True)], **dict(zip(sums, _sums(p), strict=True))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.string()), ("bins", pa.list_(pa.struct([("g", pa.int32()), ("n", pa.int64())]))), *[(c, pa.int64()) for c in sums]]))

    parts = tiles.mapInArrow(run, "image_id string, bins array<struct<g:int,n:long>>, a long, b long, c long, d long")
    # one row for each gray value and one for the sums, so that both are added up in one shuffle
    rows = F.concat(F.transform("bins", lambda x: F.struct(x["g"].alias("g"), x["n"].alias("n"), *[F.lit(0).cast("long").alias(c) for c in sums])), F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("n"), *sums)))
    rows = parts.select("image_id", F.inline(rows)).groupBy("image_id", "g").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])
    listed = rows.groupBy("image_id").agg(F.sort_array(F.collect_list(F.when(F.col("g") >= 0, F.struct("g", "n")))).alias("bins"), *[F.sum(c).alias(c) for c in ("n", *sums)])
    names = [f.split()[0] for p in (LIGHT, TEXTURE) for f in p.split(", ")]

    def finish(bins: pa.Array, n: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        rows = []
        for own, k, *s in zip(bins.to_pylist(), *(x.to_pylist() for x in (n, a, b, c, d)), strict=True):
            light = _light(np.array([x["g"] for x in own], np.int64), np.array([x["n"] for x in own], np.int64))
            rows.append((*light, _spread(s[0], s[1], k), max(0.0, _spread(s[2], s[3], k)) ** 0.5))
        kinds = [pa.int32() if x in ("min", "max") else pa.float64() for x in names]
        return pa.StructArray.from_arrays([pa.array(col, kind) for col, kind in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names)

    done = F.arrow_udf(finish, "struct<" + f"{LIGHT}, {TEXTURE}".replace(" ", ":").replace(",:", ",") + ">")
    return listed.select("image_id", done("bins", "n", *sums).alias("m")).select("image_id", "m.*")


def image_categories(d: DataFrame) -> DataFrame:
    """P4"""
    s, b, n = F.col("sharpness"), F.col("brightness"), F.col("noise_level")
    d = d.withColumn("sharpness_category", F.when(s > SHARP_HIGH, "high").when(s > SHARP_MEDIUM, "medium").otherwise("low"))
    d = d.withColumn("brightness_category", F.when(b > BRIGHT_HIGH, "high").when(b < BRIGHT_LOW, "low").otherwise("normal"))
    return d.withColumn("noise_category", F.when(n > NOISE_HIGH, "high").otherwise("normal"))


def image_type(d: DataFrame) -> Column:
    """P5"""
    s, b, n = d["sharpness"], d["brightness"], d["noise_level"]
    return F.when(d["is_dark"], "Captura Fondo Oscuro").when((s < SHARP_MEDIUM) & (b > BRIGHT_HIGH), "Captura WhatsApp").when((s > SHARP_HIGH) & (n < NOISE_HIGH), "Escaneo Digital").when(n > NOISE_HIGH, "Foto Física").otherwise("Imagen Mixta")


def inversion_decision(d: DataFrame) -> Column:
    """P6"""
    return d["is_dark"] & (d["dark_confidence"] >= 0.7)


def upscale_factor(d: DataFrame) -> Column:
    """1.0 if nothing is to be done."""
    w, h = d["img_width"], d["img_height"]
    f = F.greatest(F.lit(1.0), F.when(d["sharpness"] <= SHARP_MEDIUM, 2.5).otherwise(1.0), F.when((w < 800) | (h < 600), F.greatest(800 / w, 600 / h)).otherwise(1.0), F.when((w < 1000) | (h < 800), 2.0).otherwise(1.0))
    return F.when(f > 1.1, f).otherwise(1.0)


def one_decimal(x: Column) -> Column:
    """A number with one decimal place, exact ties to the even digit."""
    return F.format_string("%.1f", F.when(F.abs(x * 4) % 2 == 1, F.bround(x, 1)).otherwise(x))


def denoise_plan(d: DataFrame, color: bool = True) -> Column:
    """P8"""
    n, kind = d["noise_level"], "fastNlMeansDenoisingColored" if color else "fastNlMeansDenoising"
    first = F.when(n > NOISE_HIGH, F.array(F.lit(f"{kind}_aggressive"), F.lit("medianBlur_5"))).when(n > NOISE_MEDIUM, F.array(F.lit(f"{kind}_moderate"))).otherwise(F.array(F.lit("gaussianBlur_light")))
    return F.array_append(first, "bilateralFilter")


def preprocessing_plan(d: DataFrame) -> Column:
    """The names of the steps, in order; the names are fixed values."""
    inverted, factor = inversion_decision(d), upscale_factor(d)
    kind = image_type(d)
    skew = d["skew_angle"] if "skew_angle" in d.columns else F.lit(0.0)
    special = F.create_map(*[F.lit(x) for x in ("Captura Fondo Oscuro", "dark_background_optimization", "Captura WhatsApp", "whatsapp_optimization", "Foto Física", "physical_photo_enhancement", "Escaneo Digital", "scan_sharpening")])
    first = F.array(F.when(inverted, "smart_color_inversion_bitwise_not_with_clahe"), F.when(F.abs(skew) > 1.0, F.concat(F.lit("skew_correction_"), one_decimal(skew), F.lit("deg"))), F.when(factor > 1.1, F.concat(F.lit("upscale_"), one_decimal(factor), F.lit("x_LANCZOS4"))))
    light = F.when(~inverted & (d["brightness"] < BRIGHT_LOW), "brightness_boost_high").when(~inverted & (d["brightness"] > BRIGHT_HIGH), "brightness_reduction_high")
    return F.array_compact(F.concat(first, denoise_plan(d), F.array(F.try_element_at(special, kind), light)))


def diagnose_images(pixels: DataFrame) -> DataFrame:
    """M5"""
    d = image_categories(dark_background(measured(pixels)))
    return d.withColumn("image_type", image_type(d)).drop("gray")
