"""Glyph features: a 107-number description of an ink raster.

``extract`` is one vectorised pandas function per batch. Its parts also exist as plans over the
pixel table, which say the same in SQL terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The layout of the vector.
DIMS = 107
GRID = 32
BLOCKS = {"zones": (0, 16), "gradient": (16, 80), "rows": (80, 88), "columns": (88, 96), "holes": (96, 97), "crossings": (97, 103), "geometry": (103, 107)}
HOLES = 96


def resample(ink):
    """Exact area resampling onto 32 x 32 cells; the centroid goes to the middle of cell 15."""
    import numpy as np

    h, w = ink.shape
    y, x = np.nonzero(ink)
    cy, cx = ((y + 0.5).mean(), (x + 0.5).mean()) if len(y) else (h / 2, w / 2)
    scale = max(w, h) / GRID

    def cover(n, centre):
        """Share of each cell's extent that falls on each pixel, along one axis."""
        edges = centre + (np.arange(GRID + 1) - 15.5 - 0.5 + 0.0) * scale
        low, high = edges[:-1, None], edges[1:, None]
        at = np.arange(n)[None, :]
        return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) / scale

    return cover(h, cy) @ ink.astype(float) @ cover(w, cx).T


def holes(ink) -> int:
    """Background regions (4-connected) that don't touch the border, at most 2."""
    import numpy as np

    h, w = ink.shape
    free = np.pad(~ink.astype(bool), 1, constant_values=True)
    seen = np.zeros_like(free)

    def flood(start):
        stack = [start]
        seen[start] = True
        while stack:
            a, b = stack.pop()
            for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= p[0] < h + 2 and 0 <= p[1] < w + 2 and free[p] and not seen[p]:
                    seen[p] = True
                    stack.append(p)

    flood((0, 0))
    n = 0
    for p in zip(*np.nonzero(free)):
        if not seen[p]:
            n += 1
            flood(p)
    return min(n, 2)


def describe(ink, baseline: float, x_height: float):
    """The vector of one raster (a 2-D boolean array)."""
    import numpy as np

    h, w = ink.shape
    g = resample(ink) if h and w else np.zeros((GRID, GRID))
    out = np.zeros(DIMS)
    out[0:16] = g.reshape(4, 8, 4, 8).mean((1, 3)).ravel()
    p = np.pad(g, 1)
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.hypot(gx, gy)
    fold = np.where(gy < 0, -1, 1)
    fx, fy = gx * fold, gy * fold
    kind = np.where(fx > 0, np.where(fy < fx, 0, 1), np.where(fy >= -fx, 2, 3))
    zone = (np.arange(GRID) // 8)[:, None] * 4 + (np.arange(GRID) // 8)[None, :]
    if size.sum() > 0:
        out[16:80] = np.bincount((zone * 4 + kind).ravel(), size.ravel(), 64) / size.sum()
    if g.sum() > 0:
        out[80:88], out[88:96] = g.reshape(8, -1).sum(1) / g.sum(), g.T.reshape(8, -1).sum(1) / g.sum()
    out[96] = holes(ink) if h and w else 0
    for i, line in enumerate([g[c] for c in (8, 16, 24)] + [g[:, c] for c in (8, 16, 24)]):
        out[97 + i] = min(int((np.diff(line >= 0.5, prepend=False) & (line >= 0.5)).sum()), 6) / 6
    out[103] = (w - h) / (w + h) if w + h else 0
    out[104] = ink.mean() if h and w else 0
    out[105:107] = [np.clip(v / x_height, -1, 4) for v in (baseline, h - baseline)] if x_height > 0 else [-1, -1]
    return out.astype(np.float32)


def extract(glyphs: DataFrame, ink: str, width: str, baseline: str, x_height: str) -> Column:
    """Feature column from a row-major 0/1 array, its width, its baseline and its x-height."""

    @F.pandas_udf("array<float>")
    def run(i, w, b, x):
        import numpy as np
        import pandas as pd

        return pd.Series([describe(np.asarray(a, bool).reshape(-1, int(n)), float(p), float(q)).tolist() for a, n, p, q in zip(i, w, b, x)])

    return run(ink, width, baseline, x_height)


# --- parts as plans over cells ``(img, y, x, v)`` of a square grid ------------------------------


def centroid(mask: DataFrame, width: int, height: int) -> DataFrame:
    """Mean position of the ink; the middle of the box where there is none."""
    x, y = (F.avg(F.when(F.col("ink"), F.col(c))) for c in ("x", "y"))
    return mask.groupBy("img").agg(F.coalesce(x, F.lit(width / 2)).alias("cx"), F.coalesce(y, F.lit(height / 2)).alias("cy"))


def zone_density(cells: DataFrame, size: int) -> DataFrame:
    return cells.groupBy("img", (F.floor(F.col("y") / size) * 4 + F.floor(F.col("x") / size)).cast("int").alias("zone")).agg(F.avg("v").alias("density"))


def projections(cells: DataFrame, size: int) -> DataFrame:
    """Share of the total in each band of rows and of columns; 0 for an empty grid."""
    sums = cells.groupBy("img", F.floor(F.col("y") / size).cast("int").alias("r"), F.floor(F.col("x") / size).cast("int").alias("c")).agg(F.sum("v").alias("s"))
    total = F.sum("s").over(Window.partitionBy("img"))
    both = sums.withColumn("t", total).select("img", "t", "s", F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("r").alias("band")), F.struct(F.lit("column").alias("axis"), F.col("c").alias("band")))).alias("k"))
    return both.groupBy("img", "k.axis", "k.band").agg(F.coalesce(F.try_divide(F.sum("s"), F.first("t")), F.lit(0.0)).alias("share"))


def gradient_bins(cells: DataFrame, size: int) -> DataFrame:
    """Zero-padded Sobel magnitudes by zone and folded direction, over the image's total."""
    along = Window.partitionBy("img", "y").orderBy("x")
    down = Window.partitionBy("img", "x").orderBy("y")
    left, right = F.lag("v", 1, 0.0).over(along), F.lead("v", 1, 0.0).over(along)
    first = cells.withColumns({"dx": right - left, "sx": left + 2 * F.col("v") + right})
    gx = F.lag("dx", 1, 0.0).over(down) + 2 * F.col("dx") + F.lead("dx", 1, 0.0).over(down)
    gy = F.lead("sx", 1, 0.0).over(down) - F.lag("sx", 1, 0.0).over(down)
    both = first.withColumns({"gx": gx, "gy": gy}).withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).filter("m > 0")
    fx, fy = (F.when(F.col("gy") < 0, -F.col(c)).otherwise(F.col(c)) for c in ("gx", "gy"))
    kind = F.when((fx > 0) & (fy < fx), 0).when(fx > 0, 1).when(fy >= -fx, 2).otherwise(3)
    zone = (F.floor(F.col("y") / size) * 4 + F.floor(F.col("x") / size)).cast("int")
    sums = both.groupBy("img", zone.alias("zone"), kind.alias("bin")).agg(F.sum("m").alias("m"))
    return sums.select("img", "zone", "bin", (F.col("m") / F.sum("m").over(Window.partitionBy("img"))).alias("share"))


def crossings(mask: DataFrame, cuts: list[int]) -> DataFrame:
    """Rising edges along the given rows and columns, at most 6, over 6."""
    out = None
    for axis, along in (("y", "x"), ("x", "y")):
        before = F.lag("ink", 1, False).over(Window.partitionBy("img", axis).orderBy(along))
        lines = mask.filter(F.col(axis).isin(cuts)).withColumn("up", F.col("ink") & ~before)
        part = lines.groupBy("img", F.lit("row" if axis == "y" else "column").alias("axis"), F.col(axis).alias("cut")).agg((F.least(F.count_if("up"), F.lit(6)) / 6).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def hole_class(value: Column) -> Column:
    return F.least(F.greatest(F.round(value), F.lit(0)), F.lit(2)).cast("int")


def moments(vectors: DataFrame, vector: str) -> DataFrame:
    """Per dimension: population mean and deviation, 1 where there is none."""
    sd = F.stddev_pop("e")
    return vectors.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "e")).groupBy("dim").agg(F.avg("e").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def standardise(vectors: DataFrame, vector: str, stats: DataFrame) -> DataFrame:
    """``(raw - mean) / sd`` by one row of statistics per dimension, as two arrays on every row."""
    arrays = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("s"))
    z = F.zip_with(F.col(vector).cast("array<double>"), F.col("s"), lambda v, s: (v - s["mean"]) / s["sd"])
    return vectors.join(F.broadcast(arrays)).withColumn("z", z).drop("s")


def expand_weights(dims: DataFrame, blocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """A weight per dimension: its block's, unless it has one of its own."""
    inside = dims.join(F.broadcast(blocks), (dims["dim"] >= blocks["lo"]) & (dims["dim"] < blocks["hi"]), "left")
    own = overrides.select("dim", F.col("weight").alias("own"))
    return inside.join(F.broadcast(own), "dim", "left").select("dim", F.coalesce("own", "weight").alias("weight"))


def differences(a: Column, b: Column) -> Column:
    """Positions where two float vectors differ in any bit; -1 stands for a difference in length."""
    bits = lambda v: v.cast("string")
    places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~bits(F.get(a, i)).eqNullSafe(bits(F.get(b, i))))
    return F.when(F.size(a) == F.size(b), places).otherwise(F.array(F.lit(-1)))
