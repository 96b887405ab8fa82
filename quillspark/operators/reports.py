"""Grouped reports, quantiles, sweeps and differences of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linear_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per group."""
    return rows.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("quantiles"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The value at index ``round((n - 1) * share)``, through counts of distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    placed = counts.withColumns({"upto": F.sum("k").over(w.orderBy(value)), "n": F.sum("k").over(w)})
    at = F.round((F.col("n") - 1) * share)
    return placed.filter(F.col("upto") > at).groupBy(*by).agg(F.min(value).alias("quantile"))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Summary of ``b - a`` by key: improved (less), worsened, flat, and quartiles."""
    delta = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).select((F.col("b") - F.col("a")).alias("d"))
    return delta.agg(F.count_if(F.col("d") < 0).alias("improved"), F.count_if(F.col("d") > 0).alias("worsened"), F.count_if(F.col("d") == 0).alias("flat"), F.percentile("d", F.lit(0.25)).alias("q1"), F.percentile("d", F.lit(0.75)).alias("q3"))


def cumulative_share(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The least number of rows, largest first, that carry each share of the positive total."""
    positive = rows.filter(F.col(value) > 0)
    w = Window.partitionBy(*by)
    ordered = w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = positive.withColumns({"__cum": F.sum(value).over(ordered), "__rn": F.row_number().over(w.orderBy(F.desc(value))), "__total": F.sum(value).over(w)})
    return placed.groupBy(*by).agg(*[F.min(F.when(F.col("__cum") >= s * F.col("__total"), F.col("__rn"))).alias(name) for name, s in shares.items()])


def histogram_difference(a: DataFrame, b: DataFrame, key: str, top: int) -> DataFrame:
    """Counts of ``b`` less those of ``a`` over the union of keys, largest changes first."""
    left, right = a.groupBy(key).agg(F.count("*").alias("a")), b.groupBy(key).agg(F.count("*").alias("b"))
    d = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return left.join(right, key, "full").select(key, d.alias("d")).orderBy(F.desc(F.abs("d")), key).limit(top)


def timing_ratio(runs: DataFrame) -> DataFrame:
    """Least time per page and arm over repeats; quartiles of B / A and the ratio of totals."""
    least = runs.groupBy("page").pivot("arm", ["A", "B"]).agg(F.min("ms")).filter("A is not null and B is not null")
    ratio = F.col("B") / F.col("A")
    return least.agg(F.count("*").alias("pages"), F.percentile(ratio, F.lit(0.25)).alias("q1"), F.median(ratio).alias("median"), F.percentile(ratio, F.lit(0.75)).alias("q3"), (F.sum("B") / F.sum("A")).alias("total"))


def grid(spark, axes: dict[str, list[float]]) -> DataFrame:
    """All combinations of a few parameter values, in row-major order."""
    out = spark.range(1).select(F.lit(0).cast("long").alias("point"))
    for name, values in axes.items():
        v = F.posexplode(F.array(*[F.lit(float(x)) for x in values])).alias("__i", name)
        out = out.select("*", v).withColumn("point", F.col("point") * len(values) + F.col("__i")).drop("__i")
    return out


def sweep_summary(points: DataFrame, by: list[str], point: str, metric: str) -> DataFrame:
    """The first point with the least metric, and whether the metric never moves."""
    best = F.min(F.struct(metric, point))
    return points.groupBy(*by).agg(best.alias("b"), (F.count_distinct(metric) == 1).alias("inert")).select(*by, F.col(f"b.{point}").alias("best"), F.col(f"b.{metric}").alias(metric), "inert")


def sampled(rows: DataFrame, by: list[str], order: str, where: Column, offset: int, stride: int, limit: int) -> DataFrame:
    """Filter, skip, take every ``stride``-th, stop after ``limit``, per group: a sampling operator."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    k = F.col("__rn") - offset
    return rows.filter(where).withColumn("__rn", rn).filter((k >= 0) & (k % stride == 0) & (k / stride < limit)).drop("__rn")


def beats(a: dict[str, Column], b: dict[str, Column], eps: float) -> Column:
    """Better than ``b`` by ``eps`` on one metric (less is better) and worse on none."""
    better, worse = F.lit(False), F.lit(False)
    for k in a:
        better, worse = better | (a[k] < b[k] - eps), worse | (a[k] > b[k] + eps)
    return better & ~worse


def coordinate_descent(start: dict[str, float], axes: dict[str, list[float]], evaluate, eps: float = 1e-9) -> tuple[dict[str, float], float]:
    """Sweep one parameter after the other, keeping a value that improves by ``eps``.

    ``evaluate`` maps a list of settings to their metrics, so each sweep is one distributed job.
    The optimum at the edge of an axis is followed by up to three further steps beyond it.
    """
    best = dict(start)
    score = evaluate([best])[0]
    for name, values in axes.items():
        values = list(values)
        metrics = evaluate([best | {name: v} for v in values])
        k = min(range(len(values)), key=lambda i: (metrics[i], i))
        if metrics[k] >= score - eps:
            continue
        best, score = best | {name: values[k]}, metrics[k]
        if len(values) < 2 or k not in (0, len(values) - 1):
            continue
        step = values[k] - values[k - 1] if k else values[0] - values[1]
        for _ in range(3):
            further = best | {name: best[name] + step}
            metric = evaluate([further])[0]
            if metric >= score - eps:
                break
            best, score = further, metric
    return best, score
