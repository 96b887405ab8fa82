"""Layout: gap segmentation, interval merges, histograms and ordered folds over boxes.

Boxes are rows ``(page, [line,] pos, x0, x1, ...)``; a page or line is the partition of every window.
"""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ordered(by: list[str], *order: str) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def reach_before(by: list[str], order: list[str], stop: str = "x1") -> Column:
    """Running maximum of the right edges of the boxes before this one."""
    return F.max(stop).over(_ordered(by, *order).rowsBetween(Window.unboundedPreceding, -1))


def gaps(boxes: DataFrame, by: list[str], start: str = "x0", stop: str = "x1") -> DataFrame:
    """Gap to everything before: start less the running right edge, floored at 0; null for the first."""
    reach = reach_before(by, [start, stop], stop)
    return boxes.withColumn("gap", F.when(reach.isNotNull(), F.greatest(F.col(start) - reach, F.lit(0))))


def segment(rows: DataFrame, by: list[str], order: list[str], cut: Column, name: str = "segment") -> DataFrame:
    """Number the segments: a new one starts where ``cut`` holds."""
    return rows.withColumn(name, F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(_ordered(by, *order)))


def split_at_gaps(boxes: DataFrame, by: list[str], factor: float, scale: str, start: str = "x0", stop: str = "x1") -> DataFrame:
    """Cut where the gap is over ``factor`` times the group's scale."""
    return segment(gaps(boxes, by, start, stop), by, [start, stop], F.col("gap") > factor * F.col(scale))


def merge_intervals(boxes: DataFrame, by: list[str], start: str = "x0", stop: str = "x1") -> DataFrame:
    """Coalesce overlapping intervals: ``by, x0, x1, n``."""
    cut = F.col(start) >= reach_before(by, [start, stop], stop)
    cells = segment(boxes, by, [start, stop], cut, "cell")
    return cells.groupBy(*by, "cell").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("n"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value whose cumulative weight is over half of the total, in whole numbers."""
    sums = rows.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    upto, total = F.sum("w").over(_ordered(by, value)), F.sum("w").over(Window.partitionBy(*by))
    placed = sums.withColumns({"upto": upto, "total": total})
    return placed.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def smoothed_histogram(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Histogram smoothed by (1, 2, 1): ``by, bin, h``."""
    parts = F.explode(F.array(*[F.struct((F.col(value) + d).alias("bin"), (F.col(weight) * k).alias("w")) for d, k in ((-1, 1), (0, 2), (1, 1))]))
    return rows.select(*by, parts.alias("p")).groupBy(*by, F.col("p.bin").alias("bin")).agg(F.sum("p.w").alias("h"))


def first_mode(histogram: DataFrame, by: list[str]) -> DataFrame:
    """The first largest bin; none where all are empty."""
    best = F.max(F.struct("h", (-F.col("bin")).alias("b")))
    return histogram.groupBy(*by).agg(best.alias("m")).filter("m.h > 0").select(*by, (-F.col("m.b")).alias("mode"))


def body(rows: DataFrame, by: list[str], height: str, reference: str, share: float = 0.5) -> DataFrame:
    """Members at least ``share`` of the reference in height; all of them where none is."""
    tall = F.col(height) >= share * F.col(reference)
    return rows.withColumns({"__tall": tall, "__any": F.bool_or(tall).over(Window.partitionBy(*by))}).filter("__tall or not __any").drop("__tall", "__any")


def valley(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Otsu's cut over the distinct values: ``by, cut, eta``; the first best cut, the lower group's
    largest value; null where all values are equal."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = _ordered(by, value)
    whole = Window.partitionBy(*by)
    v = F.col(value).cast("double")
    sums = counts.withColumns({"cn": F.sum("n").over(upto), "cs": F.sum(F.col("n") * v).over(upto), "tn": F.sum("n").over(whole), "ts": F.sum(F.col("n") * v).over(whole), "tq": F.sum(F.col("n") * v * v).over(whole)})
    low, high = F.col("cs") / F.col("cn"), (F.col("ts") - F.col("cs")) / (F.col("tn") - F.col("cn"))
    between = F.col("cn") * (F.col("tn") - F.col("cn")) / (F.col("tn") * F.col("tn")) * (low - high) * (low - high)
    variance = F.col("tq") / F.col("tn") - (F.col("ts") / F.col("tn")) * (F.col("ts") / F.col("tn"))
    open_ = sums.filter("cn < tn").select(*by, value, F.round(between, 9).alias("between"), (between / F.nullif(variance, F.lit(0.0))).alias("eta"))
    best = open_.groupBy(*by).agg(F.max(F.struct("between", (-F.col(value)).alias("v"), "eta")).alias("b"))
    return best.select(*by, (-F.col("b.v")).alias("cut"), F.col("b.eta").alias("eta"))


def threshold_at(x: Column, factor: float) -> Column:
    """Truncated to whole pixels, at least 1."""
    return F.greatest((x * factor).cast("int"), F.lit(1))


def space_rule(lines: DataFrame, min_gaps: int = 3, min_eta: float = 0.7, lone: float = 0.7, fallback: float = 0.4, floor: float = 0.3) -> DataFrame:
    """The ladder over a line's gap figures ``(x_height, n, least, most, cut, eta, next)``.

    Uniform gaps (or none) take the ceiling; too few gaps, a weak valley or a narrow space the
    fallback; a cut at or over the ceiling is capped; else the valley itself.
    """
    ceiling, fall, low = (threshold_at(F.col("x_height"), k) for k in (lone, fallback, floor))
    source = (
        F.when((F.col("n") == 0) | (F.col("least") == F.col("most")), "uniform")
        .when((F.col("n") < min_gaps) | F.col("cut").isNull() | (F.col("eta") < min_eta) | (F.col("next") <= low), "fallback")
        .when(F.col("cut") >= ceiling, "capped")
        .otherwise("valley")
    )
    named = lines.withColumn("source", source)
    return named.withColumn("threshold", F.when(F.col("source").isin("uniform", "capped"), ceiling).when(F.col("source") == "fallback", fall).otherwise(F.col("cut")))


def pitch(rows: DataFrame, by: list[str], centre: str, tolerance: float = 0.22) -> DataFrame:
    """Median centre distance, and the share of distances near a whole multiple of it."""
    steps = rows.withColumn("step", F.lead(centre).over(_ordered(by, centre)) - F.col(centre)).filter("step is not null")
    medians = steps.groupBy(*by).agg(F.median("step").alias("pitch"))
    ratio = F.col("step") / F.nullif(F.col("pitch"), F.lit(0.0))
    near = F.abs(ratio - F.greatest(F.round(ratio), F.lit(1))) <= tolerance
    return steps.join(medians, by).groupBy(*by).agg(F.first("pitch").alias("pitch"), F.avg(F.coalesce(near, F.lit(False)).cast("double")).alias("agreement"))


def fitted_grid(rows: DataFrame, by: list[str], centre: str, pitches: DataFrame) -> DataFrame:
    """Least squares of the centres on indices counted in rounded pitches: ``slope, intercept``."""
    step = F.col(centre) - F.lag(centre).over(_ordered(by, centre))
    stepped = rows.join(pitches, by).withColumn("inc", F.coalesce(F.greatest(F.round(step / F.nullif(F.col("pitch"), F.lit(0.0))), F.lit(1)), F.lit(0)))
    indexed = stepped.withColumn("idx", F.sum("inc").over(_ordered(by, centre)))
    return indexed.groupBy(*by).agg(F.regr_slope(centre, "idx").alias("slope"), F.regr_intercept(centre, "idx").alias("intercept"))


def nearest_host(marks: DataFrame, hosts: DataFrame, page: str, reach: float, bucket: float) -> DataFrame:
    """Each mark's nearest x-overlapping host within ``reach`` of its height; ties go to a host below.

    A range join in buckets of x: a mark meets the hosts of the buckets it lies in, not all of its page.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1e-9) / bucket))
    m = marks.select(page, F.col("id").alias("mark"), *[F.col(c).alias("m" + c) for c in ("x0", "x1", "y0", "y1")]).withColumn("cell", F.explode(span("mx0", "mx1")))
    h = hosts.select(page, F.col("id").alias("host"), *[F.col(c).alias("h" + c) for c in ("x0", "x1", "y0", "y1")]).withColumn("cell", F.explode(span("hx0", "hx1")))
    gap = F.greatest(F.col("hy0") - F.col("my1"), F.col("my0") - F.col("hy1"), F.lit(0))
    both = m.join(h, [page, "cell"]).filter((F.least("mx1", "hx1") > F.greatest("mx0", "hx0")) & (F.col("mark") != F.col("host")))
    near = both.withColumns({"gap": gap, "above": (F.col("hy0") < F.col("my0")).cast("int")}).filter(F.col("gap") <= reach * (F.col("my1") - F.col("my0")))
    best = near.groupBy(page, "mark").agg(F.min(F.struct("gap", "above", "host")).alias("b"))
    return best.select(page, "mark", F.col("b.host").alias("host"), F.col("b.gap").alias("gap"))


def contained(inner0: Column, inner1: Column, outer0: Column, outer1: Column) -> Column:
    return (inner0 >= outer0) & (inner1 <= outer1)


def columns_overlap(a0: Column, a1: Column, b0: Column, b1: Column, share: float) -> Column:
    """Overlap of at least ``share`` of the narrower interval."""
    shared = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    return shared >= share * F.least(a1 - a0, b1 - b0)


def checkbox_shaped(width: Column, height: Column, area: Column, aspect: float = 1.25, fill: float = 0.95) -> Column:
    return (F.greatest(width, height) <= aspect * F.least(width, height)) & (area <= fill * width * height)


def lattice(atoms: DataFrame, by: list[str], max_merge: int = 3) -> DataFrame:
    """Edges of a word's segmentation graph: single atoms and runs of up to ``max_merge`` of them."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(max_merge))).alias("k")
    last = atoms.groupBy(*by).agg((F.max("pos") + 1).alias("n"))
    ends = atoms.join(last, by).select(*by, F.col("pos").alias("src"), "n", steps).filter(F.col("src") + F.col("k") <= F.col("n"))
    named = ends.select(*by, "src", (F.col("src") + F.col("k")).cast("int").alias("dst"), F.when(F.col("k") == 1, "single").otherwise("merge").alias("kind"))
    a = atoms.select(*by, F.col("pos").alias("src"), "x0")
    b = atoms.select(*by, (F.col("pos") + 1).cast("int").alias("dst"), "x1")
    return named.join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, "src", "dst", "kind", "x0", "x1")


def interior_cuts(profile: DataFrame, by: list[str], at_most: int = 3, share: float = 0.65) -> DataFrame:
    """Local minima of a profile under a share of its peak; the lowest ones, in order of x."""
    w = _ordered(by, "x")
    rows = profile.withColumns({"before": F.lag("ink").over(w), "after": F.lead("ink").over(w), "peak": F.max("ink").over(Window.partitionBy(*by))})
    low = rows.filter((F.col("ink") <= F.col("before")) & (F.col("ink") < F.col("after")) & (F.col("ink") < share * F.col("peak")))
    ranked = low.withColumn("k", F.row_number().over(_ordered(by, "ink", "x"))).filter(F.col("k") <= at_most)
    return ranked.select(*by, "x", "ink")


def visual_rows(boxes: DataFrame, page: str) -> DataFrame:
    """Rows of a page: a box whose middle leaves the rows' running extent starts the next one.

    The extent depends on every earlier decision, so it is a fold, one page per group.
    """

    def fold(frame):
        frame = frame.sort_values(["y0", "x0", "id"], kind="stable")
        row, lo, hi, out = -1, 0.0, -1.0, []
        for y0, y1 in zip(frame["y0"], frame["y1"]):
            middle = (y0 + y1) / 2
            if row < 0 or middle > hi:
                row, lo, hi = row + 1, y0, y1
            else:
                lo, hi = min(lo, y0), max(hi, y1)
            out.append(row)
        return frame[[page, "id"]].assign(row=out)

    return boxes.groupBy(page).applyInPandas(fold, f"{page} {dict(boxes.dtypes)[page]}, id long, row int")


def absorb(band: dict, x0: float, y0: float, x1: float, y1: float) -> None:
    """Take a box into a band: its heights stay sorted, for a running median, and its extent grows."""
    insort(band["heights"], y1 - y0)
    band.update(x0=min(band["x0"], x0), y0=min(band["y0"], y0), x1=max(band["x1"], x1), y1=max(band["y1"], y1))


def best_bands(boxes: DataFrame, page: str, share: float = 0.5) -> DataFrame:
    """Greedy bands: boxes, tallest first, join the band they overlap most, or open one."""

    def assign(frame):
        frame = frame.assign(h=frame["y1"] - frame["y0"]).sort_values(["h", "id"], ascending=[False, True], kind="stable")
        tops: list = []
        bottoms: list = []
        out = []
        for y0, y1 in zip(frame["y0"].tolist(), frame["y1"].tolist()):
            best, at = 0.0, -1
            for k, (b0, b1) in enumerate(zip(tops, bottoms)):
                ratio = max(min(y1, b1) - max(y0, b0), 0) / max(min(y1 - y0, b1 - b0), 1e-9)
                if ratio > best:
                    best, at = ratio, k
            if best >= share:
                tops[at], bottoms[at] = min(tops[at], y0), max(bottoms[at], y1)
            else:
                tops.append(y0)
                bottoms.append(y1)
                at = len(tops) - 1
            out.append(at)
        return frame[[page, "id"]].assign(band=out)

    return boxes.groupBy(page).applyInPandas(assign, f"{page} {dict(boxes.dtypes)[page]}, id long, band int")


def split_baselines(rows: DataFrame, by: str, value: str, separation: float, support: float = 0.25) -> DataFrame:
    """Recursively split a band at a bimodal set of bottoms; ``by, id, part``."""

    def parts(values: list[float]) -> list[float]:
        """Cut values, ascending."""
        import numpy as np

        v = np.sort(np.asarray(values, float))
        if len(v) < 4:
            return []
        k = int(np.argmax(np.diff(v)))
        left, right = v[: k + 1], v[k + 1 :]
        if np.median(right) - np.median(left) < separation or min(len(left), len(right)) < support * len(v):
            return []
        return [*parts(left), float(left[-1]), *parts(right)]

    def split(frame):
        import numpy as np

        cuts = parts(frame[value].tolist())
        return frame[[by, "id"]].assign(part=np.searchsorted(np.array(cuts), frame[value].to_numpy(), side="left").astype(int))

    return rows.groupBy(by).applyInPandas(split, f"{by} {dict(rows.dtypes)[by]}, id long, part int")


def run_lengths(rows: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """Length of each run of equal keys."""
    cut = ~F.col(key).eqNullSafe(F.lag(key).over(_ordered(by, order))) & F.lag(F.lit(1)).over(_ordered(by, order)).isNotNull()
    runs = segment(rows, by, [order], cut, "run")
    return runs.groupBy(*by, "run").agg(F.first(key).alias(key), F.min(order).alias("first"), F.count("*").alias("n"))


def edge_centre(x0: Column, x1: Column, pitch: Column, left: bool) -> Column:
    """Centre of the outer slice of a run of touching cells, which holds at least two."""
    half = (x1 - x0) / F.greatest(F.floor((x1 - x0) / pitch + 0.5), F.lit(2)) / 2
    return x0 + half if left else x1 - half


def shares_column(a0: Column, a1: Column, b0: Column, b1: Column, share: float) -> Column:
    """Whether two spans overlap in at least ``share`` of the narrower one."""
    return F.least(a1, b1) - F.greatest(a0, b0) >= share * F.least(a1 - a0, b1 - b0)


def column_matches(anchors: DataFrame, boxes: DataFrame, by: list[str], share: float, strict: bool = False) -> DataFrame:
    """``by, row, found, right_edge``: for each row other than the anchor's, how many boxes share its column.

    ``anchors`` has one box per group (``row, x0, x1``). The right edge is null unless exactly one box
    matches. ``strict``: a box alone in its row doesn't match if it overlaps a sibling of the anchor.
    """
    anchor = anchors.select(*by, F.col("row").alias("own_row"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    rows = boxes.join(anchor, by)
    match = shares_column(F.col("a0"), F.col("a1"), F.col("x0"), F.col("x1"), share)
    if strict:
        siblings = rows.filter((F.col("row") == F.col("own_row")) & ~((F.col("x0") == F.col("a0")) & (F.col("x1") == F.col("a1"))))
        spans = siblings.select(*by, F.col("x0").alias("s0"), F.col("x1").alias("s1"))
        numbered = rows.withColumn("alone", F.count("*").over(Window.partitionBy(*by, "row")) == 1)
        touched = numbered.filter("alone and row <> own_row").join(spans, by).filter("x0 < s1 and s0 < x1").select(*by, "row").distinct().withColumn("touched", F.lit(True))
        rows = numbered.join(touched, [*by, "row"], "left")
        match &= F.col("touched").isNull()
    counted = rows.filter("row <> own_row").groupBy(*by, "row").agg(F.count_if(match).alias("found"), F.max(F.when(match, F.col("x1"))).alias("right_edge"))
    return counted.withColumn("right_edge", F.when(F.col("found") == 1, F.col("right_edge")))


def column_extents(anchors: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """``by, extent``: the widest right edge over the unbroken rows around the anchor with one match each."""
    m = matches.join(anchors.select(*by, F.col("row").alias("own_row"), F.col("x1").alias("a1")), by)
    group = Window.partitionBy(*by)
    above = F.max(F.when((F.col("found") != 1) & (F.col("row") < F.col("own_row")), F.col("row"))).over(group)
    below = F.min(F.when((F.col("found") != 1) & (F.col("row") > F.col("own_row")), F.col("row"))).over(group)
    near = m.withColumns({"above": above, "below": below}).filter("(above is null or row > above) and (below is null or row < below)")
    widest = near.groupBy(*by).agg(F.max("right_edge").alias("widest"))
    return anchors.join(widest, by, "left").select(*by, F.greatest("x1", F.coalesce("widest", "x1")).alias("extent"))


def wrap_run_lengths(lines: DataFrame, by: list[str], share: float, low: float, high: float) -> DataFrame:
    """``by, run``: how many single-box rows after a group's first line go on in its column at a steady pitch.

    ``lines``: ``row`` (from 0, gapless), ``boxes`` in the row, and its ``x0, x1, y``.
    """
    w = _ordered(by, "row")
    before = {f"p_{c}": F.lag(c).over(w) for c in ("x0", "x1", "y")}
    steps = lines.withColumns(before).withColumn("gap", F.col("y") - F.col("p_y"))
    first = F.max(F.when(F.col("row") == 1, F.col("gap"))).over(Window.partitionBy(*by))
    steady = (F.col("row") == 1) | F.coalesce(F.try_divide("gap", first).between(low, high), F.lit(False))
    goes_on = (F.col("boxes") == 1) & shares_column(F.col("p_x0"), F.col("p_x1"), F.col("x0"), F.col("x1"), share) & (F.col("gap") > 0) & steady
    stops = steps.withColumn("stop", F.when((F.col("row") > 0) & ~goes_on, F.col("row")))
    return stops.groupBy(*by).agg(F.coalesce(F.min("stop") - 1, F.max("row")).cast("long").alias("run"))
