"""Raster operators on pixel tables ``(img, y, x, v)``: windows and aggregates, no Python.

Connected components and skew are the exceptions: one function over batches of images, that holds a bounded number of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pixels(images: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """A row-major vector as pixels; values are scaled to 0..255 and truncated."""
    rows = images.select(F.col(key).alias("img"), F.posexplode(vector).alias("i", "e"))
    return rows.select("img", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), grey(F.col("e")).alias("v"))


def grey(e: Column) -> Column:
    return F.greatest(F.least(F.floor(e.cast("double") * 400 + 128), F.lit(255)), F.lit(0)).cast("int")


def _along(axis: str, lo: int | None = None, hi: int | None = None) -> Window:
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy("img", other).orderBy(axis)
    return w.rangeBetween(Window.unboundedPreceding if lo is None else lo, 0 if hi is None else hi)


def integrals(px: DataFrame) -> DataFrame:
    """Summed-area tables of the values and of their squares."""
    rows = px.withColumns({"s": F.sum("v").over(_along("x")), "q": F.sum(F.col("v") * F.col("v")).over(_along("x"))})
    return rows.withColumns({"s": F.sum("s").over(_along("y")), "q": F.sum("q").over(_along("y"))})


def box_sum(tables: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sum over inclusive boxes ``(img, box, x0, y0, x1, y1)`` by the four corners of a table."""
    corners = boxes.select(
        "img",
        "box",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(sign).alias("sign"), y.alias("y"), x.alias("x"))
                    for sign, y, x in ((1, F.col("y1"), F.col("x1")), (-1, F.col("y0") - 1, F.col("x1")), (-1, F.col("y1"), F.col("x0") - 1), (1, F.col("y0") - 1, F.col("x0") - 1))
                ]
            )
        ).alias("c"),
    ).select("img", "box", "c.sign", "c.y", "c.x")
    return corners.join(tables.select("img", "y", "x", "s"), ["img", "y", "x"]).groupBy("img", "box").agg(F.sum(F.col("sign") * F.col("s")).alias("total"))


def _box(px: DataFrame, half: int, **aggregates) -> DataFrame:
    """Separable box aggregates: ``name=(function, column)``; windows are clamped at the edges."""
    first = px.withColumns({k: f(c).over(_along("x", -half, half)) for k, (f, c) in aggregates.items()})
    return first.withColumns({k: f(k).over(_along("y", -half, half)) for k, (f, _) in aggregates.items()})


def local_moments(px: DataFrame, half: int) -> DataFrame:
    one = px.withColumn("one", F.lit(1))
    sums = _box(one, half, n=(F.sum, "one"), s=(F.sum, "v"), q=(F.sum, F.col("v") * F.col("v")))
    mean = F.col("s") / F.col("n")
    return sums.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))}).drop("one", "s", "q", "n")


def sauvola(px: DataFrame, window: int = 25, k: float = 0.34, r: float = 128.0) -> DataFrame:
    """Ink where ``v < mean * (1 + k * (sd / r - 1))``; inverted where ink is over half the image."""
    t = F.col("mean") * (1 + k * (F.col("sd") / r - 1))
    mask = local_moments(px, window // 2).select("img", "y", "x", (F.col("v") < t).alias("ink"))
    flipped = F.count_if("ink").over(Window.partitionBy("img")) * 2 > F.count("*").over(Window.partitionBy("img"))
    return mask.select("img", "y", "x", (F.col("ink") != flipped).alias("ink"))


def wolf(px: DataFrame, window: int = 25, k: float = 0.5) -> DataFrame:
    """Threshold from the local moments, the least value and the largest deviation; ink is ``v <= t``."""
    rows = local_moments(px, window // 2)
    whole = Window.partitionBy("img")
    least, most = F.min("v").over(whole), F.max("sd").over(whole)
    t = F.col("mean") - k * (1 - F.coalesce(F.try_divide("sd", most), F.lit(0.0))) * (F.col("mean") - least)
    return rows.select("img", "y", "x", (F.col("v") <= t).alias("ink"))


def stretch_local(px: DataFrame, window: int = 61, floor: int = 24) -> DataFrame:
    """Map the local range to 0..255; 255 where the range is under the floor."""
    rows = _box(px, window // 2, lo=(F.min, "v"), hi=(F.max, "v"))
    spread = F.col("hi") - F.col("lo")
    return rows.select("img", "y", "x", F.when(spread < floor, 255).otherwise(F.floor((F.col("v") - F.col("lo")) * 255 / spread)).cast("int").alias("v"))


def quantiles(px: DataFrame, **shares: float) -> DataFrame:
    """Per image the named quantiles: ``low * (1 - part) + high * part`` between the two values around.

    The first product isn't rounded before the sum, as in the SQL engine; ``F.percentile`` rounds both.
    """
    counts = px.groupBy("img", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("img")
    below = counts.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "last": F.sum("n").over(w) - 1})

    def quantile(share: float) -> Column:
        at = F.col("last") * F.lit(share)
        low, high = (F.min(F.when(F.col("upto") > rank, F.col("v"))).cast("double") for rank in (F.floor(at), F.ceil(at)))
        part = F.max(at - F.floor(at))
        return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")

    return below.groupBy("img").agg(*[quantile(share).alias(name) for name, share in shares.items()])


def stretch_contrast(px: DataFrame) -> DataFrame:
    """The 0.5th percentile goes to 0 and the median to 255, clamped."""
    ends = quantiles(px.filter("v is not null"), lo=0.005, hi=0.5)
    mapped = (F.col("v") - F.col("lo")) * 255 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))
    return px.join(ends, "img").select("img", "y", "x", F.floor(F.least(F.greatest(mapped, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))


def morph(mask: DataFrame, erode: bool) -> DataFrame:
    """3 x 3 minimum or maximum; outside the image counts as background."""
    shape = Window.partitionBy("img")
    f = F.min if erode else F.max
    rows = _box(mask.withColumn("i", F.col("ink").cast("int")), 1, m=(f, "i"))
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.max("x").over(shape)) | (F.col("y") == F.max("y").over(shape))
    value = F.when(edge, 0).otherwise(F.col("m")) if erode else F.col("m")
    return rows.select("img", "y", "x", (value > 0).alias("ink"))


def blur3(px: DataFrame) -> DataFrame:
    """Mean over the 3 x 3 cells inside the image."""
    rows = _box(px.withColumn("one", F.lit(1)), 1, n=(F.sum, "one"), s=(F.sum, "v"))
    return rows.select("img", "y", "x", (F.col("s") / F.col("n")).alias("v"))


def border_value(px: DataFrame) -> DataFrame:
    """Upper median of the border's pixels, corners counted twice."""
    shape = Window.partitionBy("img")
    rows = px.withColumns({"h": F.max("y").over(shape), "w": F.max("x").over(shape)})
    edge = ((F.col("y") == 0) | (F.col("y") == F.col("h"))).cast("int") + ((F.col("x") == 0) | (F.col("x") == F.col("w"))).cast("int")
    counts = rows.groupBy("img", "v").agg(F.sum(edge).alias("k")).filter("k > 0")
    upto = F.sum("k").over(shape.orderBy("v"))
    n = F.sum("k").over(shape)
    placed = counts.select("img", "v", upto.alias("upto"), n.alias("n"))
    return placed.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("img").agg(F.min("v").alias("border"))


# --- skew and slant ----------------------------------------------------------------------------


def sharpness(ink: DataFrame, slopes: Column) -> DataFrame:
    """Sum of squared row counts of the ink for each slope of an array, after shearing."""
    rows = ink.select("img", "y", "x", F.explode(slopes).alias("slope"))
    counts = rows.groupBy("img", "slope", F.floor(F.col("y") - F.col("x") * F.col("slope")).alias("row")).agg(F.count("*").alias("n"))
    return counts.groupBy("img", "slope").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def best_slope(scores: DataFrame) -> DataFrame:
    """The largest score; ties go to the smaller slope in size, then to the negative one."""
    best = F.max(F.struct("score", (-F.abs("slope")).alias("flat"), (-F.col("slope")).alias("minus")))
    return scores.groupBy("img").agg(best.alias("b")).select("img", (-F.col("b.minus")).alias("slope"), "b.score")


def _row_scores(img, y, x, slopes):
    """Sum of squared row counts of each image's pixels, sheared by the image's slope."""
    import numpy as np

    row = np.floor(y - x * slopes[img]).astype(np.int64)
    low = row.min(initial=0)
    span = int(row.max(initial=0) - low) + 1
    counts = np.bincount(img * span + row - low, minlength=len(slopes) * span).reshape(-1, span)
    return (counts**2).sum(1)


def estimate_skew(img, y, x, images: int, max_slope: float = 0.0874, steps=(1 / 128, 1 / 1024, 1 / 8192)):
    """A slope for each of the images 0.. whose ink is at ``(img, y, x)``, all arrays.

    Three searches, each around the last one's best slope and finer; clamped to ``max_slope``. The best has the largest
    score; ties go to the smaller slope in size, then to the negative one.
    """
    import numpy as np

    slopes, span = np.zeros(images), max_slope
    for step in steps:
        n = round(span / step)
        best, most = slopes, np.full(images, -1)
        for i in range(-n, n + 1):
            slope = np.clip(slopes + i * step, -max_slope, max_slope)
            score = _row_scores(img, y, x, slope)
            flat, least = np.abs(slope), np.abs(best)
            better = (score > most) | ((score == most) & ((flat < least) | ((flat == least) & (slope < best))))
            best, most = np.where(better, slope, best), np.where(better, score, most)
        slopes, span = best, step
    return slopes


def unshear(y: Column, x: Column, slope: Column, height: Column) -> Column:
    return F.least(F.greatest(F.round(y + x * slope), F.lit(0)), height - 1).cast("int")


def _upper_median(v, begins, weight):
    """Of each image, whose values begin there: the value that ``weight`` copies of each put in the upper middle."""
    import numpy as np

    img = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(v)))
    order = np.lexsort((v, img))
    upto = np.cumsum(weight[order])
    total = np.add.reduceat(weight, begins)
    before = np.cumsum(total) - total
    return v[order][np.searchsorted(upto, before + total // 2, side="right")]


def correct_skew(v, begins, width: int, slopes, min_slope: float = 0.0015):
    """Shift each column by its skew with linear interpolation; the upper median of the border, corners twice, fills the rest.

    ``v``: the row-major values of images of that width, which begin at ``begins``; ``slopes``: one for each.
    """
    import numpy as np

    size = np.diff(begins, append=len(v))
    img = np.repeat(np.arange(len(begins)), size)
    at = np.arange(len(v)) - begins[img]
    y, x = at // width, at % width
    weight = ((y == 0) | (y == ((size - 1) // width)[img])).astype(int) + ((x == 0) | (x == (np.minimum(size, width) - 1)[img]))
    fill = _upper_median(v, begins, weight)[img]
    moved = y + x * slopes[img]
    y0 = np.floor(moved).astype(np.int64)
    part = moved - y0
    source = y0 * width + x
    inside = (y0 >= 0) & (source < size[img])
    below = inside & (source + width < size[img])
    v0 = np.where(inside, v[np.where(inside, begins[img] + source, 0)], fill)
    v1 = np.where(below, v[np.where(below, begins[img] + source + width, 0)], fill)
    mixed = v0 * (1 - part) + v1 * part
    whole = np.floor(mixed)
    return np.where(np.abs(slopes[img]) < min_slope, v, (whole + (mixed - whole >= 0.5)).astype(v.dtype))


#: Pixels of the images that ``deskew`` holds at a time, unless one image has more.
PIXELS = 1 << 20


def deskew(images: DataFrame, key: str, vector: str, width: int, threshold: int = 128, max_slope: float = 0.0874) -> DataFrame:
    """Straightened images ``img, y, x, v, slope``; ink is under the threshold, images without ink have no rows.

    ``images`` has a row-major vector for each; values are scaled as ``pixels`` does. An image is told and straightened
    where its row is, a bounded number of pixels at a time: no pixels are shuffled or aggregated.
    """

    def straightened(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ends = np.cumsum(np.diff(batch.column("v").offsets.to_numpy()))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + PIXELS, side="right")))
                rows = batch.slice(start, stop - start)
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False)
                size = np.diff(rows.column("v").offsets.to_numpy())
                start = stop
                inked = np.add.reduceat(np.append(v < threshold, False).astype(int), np.cumsum(size) - size) > 0
                inked &= size > 0
                keep = np.flatnonzero(inked)
                if not len(keep):
                    continue
                v, size = v[np.repeat(inked, size)], size[inked]
                begins = np.cumsum(size) - size
                img = np.repeat(np.arange(len(keep)), size)
                at = np.arange(len(v)) - begins[img]
                y, x = at // width, at % width
                ink = v < threshold
                slopes = estimate_skew(img[ink], y[ink], x[ink], len(keep), max_slope)
                flat = correct_skew(v, begins, width, slopes)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("img").take(pa.array(keep[img])), *(pa.array(a.astype(np.int32)) for a in (y, x, flat)), pa.array(slopes[img])], names=["img", "y", "x", "v", "slope"]
                )

    rows = images.select(F.col(key).alias("img"), F.transform(vector, grey).alias("v")).filter("img is not null and size(v) > 0")
    # vectors are small and the search is long, so images are dealt over all cores and not by bytes
    dealt = rows.repartition(4 * images.sparkSession.sparkContext.defaultParallelism, "img")
    return dealt.mapInArrow(straightened, f"img {dict(images.dtypes)[key]}, y int, x int, v int, slope double")


def round_div(n: Column, d: Column) -> Column:
    """Integer division rounding half away from zero; 0 for a zero divisor."""
    size = F.floor((F.abs(n) + F.floor(F.abs(d) / 2)) / F.nullif(F.abs(d), F.lit(0)))
    return F.coalesce(F.sign(n) * F.sign(d) * size, F.lit(0.0)).cast("long")


def angle_scores(ink: DataFrame, baseline: Column, degrees: int = 20) -> DataFrame:
    """Sum of squared column counts for each whole shear angle, in 12-bit fixed point."""
    import math

    table = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(round(math.tan(math.radians(a)) * 4096)).alias("q")) for a in range(degrees + 1)])
    rows = ink.select("img", "x", (baseline - F.col("y")).alias("up"), F.explode(table).alias("a"))
    column = F.col("x") - round_div(F.col("up") * F.col("a.q"), F.lit(4096))
    counts = rows.groupBy("img", F.col("a.angle").alias("angle"), column.alias("c")).agg(F.count("*").alias("n"))
    return counts.groupBy("img", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def slant(scores: DataFrame, min_degrees: float = 6.0, margin: float = 1.08, degrees: int = 20) -> DataFrame:
    """The first best angle, and whether it is slanted: steep enough, inside the range, clearly better."""
    best = scores.groupBy("img").agg(F.max(F.struct("score", (-F.col("angle")).alias("flat"))).alias("b"), F.max(F.when(F.col("angle") == 0, F.col("score"))).alias("upright"))
    angle = -F.col("b.flat")
    return best.select("img", angle.alias("angle"), ((angle < degrees) & (angle >= min_degrees) & (F.col("b.score") >= margin * F.col("upright"))).alias("slanted"))


# --- components --------------------------------------------------------------------------------


def label(ink: DataFrame, eight: bool = True) -> DataFrame:
    """Connected components of the ink: labels 1.. in raster order of each one's first pixel.

    The ink of an image is one row; horizontal runs are linked to those of the next row, for a batch of images at once.
    """
    reach = 1 if eight else 0

    def labelled(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ink = batch.column("ink")
            y, x = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in ink.flatten().flatten())
            img = np.repeat(np.arange(batch.num_rows), np.diff(ink.offsets.to_numpy()))
            if not len(y):
                continue
            width = int(x.max() - x.min()) + 4
            row = img * (int(y.max() - y.min()) + 2) + y - y.min()
            key = row * width + x - x.min() + 1
            order = np.argsort(key, kind="stable")
            key, y, x, img = key[order], y[order], x[order], img[order]
            first = np.flatnonzero(np.diff(key, prepend=-2) > 1)
            last = np.append(first[1:], len(key)) - 1
            # runs of the next row from the first that ends at or after this one's start
            low = np.searchsorted(key[last], key[first] + width - reach)
            high = np.searchsorted(key[first], key[last] + width + reach, side="right")
            n = np.maximum(high - low, 0)
            u = np.repeat(np.arange(len(first)), n)
            v = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            root = np.arange(len(first))
            while len(u):
                a, b = root[u], root[v]
                apart = a != b
                u, v, a, b = u[apart], v[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
            roots = np.unique(root)
            owner = img[first[roots]]
            number = np.arange(len(roots)) - np.searchsorted(owner, owner) + 1
            labels = number[np.searchsorted(roots, root)][np.repeat(np.arange(len(first)), last - first + 1)]
            yield pa.RecordBatch.from_arrays([batch.column("img").take(pa.array(img)), *(pa.array(a.astype(np.int32)) for a in (y, x, labels))], names=["img", "y", "x", "label"])

    kind = dict(ink.dtypes)["img"]
    images = ink.filter("ink").groupBy("img").agg(F.collect_list(F.struct("y", "x")).alias("ink"))
    return images.repartition(int(ink.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img").mapInArrow(labelled, f"img {kind}, y int, x int, label int")


def boxes(labelled: DataFrame, *by: str) -> DataFrame:
    """Half-open box, area and the share of each side that has ink within a twelfth of the height."""
    keys = ["img", "label", *by]
    box = labelled.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("area"))
    t = F.greatest(F.lit(1), F.round((F.col("y1") - F.col("y0")) / 12).cast("int"))
    rows = labelled.join(box, keys)
    side = lambda near, along, size: (F.count_distinct(F.when(near, F.col(along))) / F.first(size)).alias
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cover = rows.groupBy(*keys).agg(
        side(F.col("y") - F.col("y0") < t, "x", w)("top"), side(F.col("y1") - F.col("y") <= t, "x", w)("bottom"), side(F.col("x") - F.col("x0") < t, "y", h)("left"), side(F.col("x1") - F.col("x") <= t, "y", h)("right")
    )
    return box.join(cover, keys)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two half-open intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def runs(mask: DataFrame, axis: str = "x") -> DataFrame:
    """Maximal runs of ink along an axis: ``img, line, start, stop`` (half open)."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy("img", other).orderBy(axis)
    island = F.col(axis) - F.row_number().over(w)
    return mask.filter("ink").withColumn("island", island).groupBy("img", F.col(other).alias("line"), "island").agg(F.min(axis).alias("start"), (F.max(axis) + 1).alias("stop")).drop("island")


def single_runs(mask: DataFrame, floor: int) -> DataFrame:
    """Rows that have just one run of at least ``floor``."""
    long = runs(mask).filter(F.col("stop") - F.col("start") >= floor)
    return long.groupBy("img", "line").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min("stop").alias("stop")).filter("n = 1").drop("n")


def rule_bands(single: DataFrame, move: int = 2, rows: int = 2) -> DataFrame:
    """Consecutive rows whose run's ends move by at most ``move`` are a band; short bands are dropped."""
    w = Window.partitionBy("img").orderBy("line")
    same = (F.col("line") - F.lag("line").over(w) == 1) & (F.abs(F.col("start") - F.lag("start").over(w)) <= move) & (F.abs(F.col("stop") - F.lag("stop").over(w)) <= move)
    marked = single.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("band", F.sum("new").over(w))
    return marked.groupBy("img", "band").agg(F.min("line").alias("y0"), (F.max("line") + 1).alias("y1"), F.min("start").alias("x0"), F.max("stop").alias("x1")).filter(F.col("y1") - F.col("y0") >= rows)


def strip_rules(mask: DataFrame, floor: int, reach: int = 1) -> DataFrame:
    """The mask without its rule bands, except where a vertical stroke crosses one."""
    bands = rule_bands(single_runs(mask, floor)).select("img", *[F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")])
    strokes = runs(mask, "y").select("img", F.col("line").alias("x"), "start", "stop")
    cells = mask.filter("ink").join(bands, "img").filter("y >= ry0 and y < ry1 and x >= rx0 and x < rx1")
    crossed = cells.join(strokes, ["img", "x"]).filter("y >= start and y < stop").filter((F.col("start") < F.col("ry0") - reach + 1) | (F.col("stop") > F.col("ry1") + reach - 1))
    doomed = cells.select("img", "y", "x").join(crossed.select("img", "y", "x"), ["img", "y", "x"], "left_anti").distinct().withColumn("gone", F.lit(True))
    return mask.join(doomed, ["img", "y", "x"], "left").select("img", "y", "x", (F.col("ink") & F.col("gone").isNull()).alias("ink"))


def column_profile(mask: DataFrame) -> DataFrame:
    return mask.groupBy("img", "x").agg(F.count_if("ink").alias("ink"))


def crop(mask: DataFrame, spans: DataFrame) -> DataFrame:
    """Ink inside each ``(img, edge, x0, x1)`` re-based to its tight box; empty spans have no row."""
    inside = mask.filter("ink").join(spans, "img").filter("x >= x0 and x < x1")
    w = Window.partitionBy("img", "edge")
    return inside.select("img", "edge", (F.col("y") - F.min("y").over(w)).alias("y"), (F.col("x") - F.min("x").over(w)).alias("x"))


def bilinear(px: DataFrame, points: DataFrame) -> DataFrame:
    """Sample at real-valued ``(img, point, x, y)``; outside the image is 0."""
    near = points.withColumns({"bx": F.floor("x").cast("int"), "by": F.floor("y").cast("int")}).select(
        "img",
        "point",
        F.explode(
            F.array(*[F.struct((F.col("by") + dy).alias("y"), (F.col("bx") + dx).alias("x"), ((F.col("x") - F.col("bx")) if dx else (1 - F.col("x") + F.col("bx"))).alias("wx"), ((F.col("y") - F.col("by")) if dy else (1 - F.col("y") + F.col("by"))).alias("wy")) for dy in (0, 1) for dx in (0, 1)])
        ).alias("c"),
    ).select("img", "point", "c.*")
    return near.join(px, ["img", "y", "x"], "left").groupBy("img", "point").agg(F.sum(F.coalesce("v", F.lit(0)) * F.col("wx") * F.col("wy")).alias("v"))


def augment(glyphs: DataFrame, width: int, variants: int = 3, seed: int = 1) -> DataFrame:
    """Seeded shifts, blurs and erosions of ``(img, raster array<double>)``."""

    def varied(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            rows = []
            for img, raster in zip(frame["img"], frame["raster"]):
                g = np.asarray(raster, float).reshape(-1, width)
                for k in range(variants):
                    rng = np.random.default_rng([seed, int(img), k])
                    dy, dx = rng.integers(-1, 2, 2)
                    moved = np.roll(g, (int(dy), int(dx)), (0, 1))
                    padded = np.pad(moved, 1, mode="edge")
                    near = np.stack([padded[a : a + g.shape[0], b : b + width] for a in range(3) for b in range(3)])
                    out = (moved, near.mean(0), near.min(0), near.max(0))[k % 4]
                    rows.append((img, k, out.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["img", "variant", "raster"])

    return glyphs.select("img", "raster").mapInPandas(varied, f"img {dict(glyphs.dtypes)['img']}, variant int, raster array<double>")
