"""Calibrated confidences and threshold work on labelled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

#: Knots (ratio, confidence) of the default calibration.
KNOTS = ((0.0, 0.999), (0.5, 0.99), (0.7, 0.95), (0.85, 0.8), (0.95, 0.6), (1.0, 0.5))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def character(ratio: Column, knots=KNOTS) -> Column:
    """Piecewise linear between the knots; outside and where not finite, the nearest or last knot."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        out = F.when(ratio < x1, y0 + (y1 - y0) * (ratio - x0) / (x1 - x0)).otherwise(out)
    out = F.when(ratio <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)
    return clamp01(F.when(finite(ratio), out).otherwise(F.lit(float(knots[-1][1]))))


def adjust(base: Column, agreement: Column, floor: float = 0.6) -> Column:
    """``base * (floor + (1 - floor) * agreement)``; an agreement that isn't finite counts as one."""
    known = F.when(finite(agreement), agreement).otherwise(1.0)
    return clamp01(base * (floor + (1 - floor) * known))


def ratio_from_margin(margin: Column) -> Column:
    return F.when(margin == float("inf"), 0.0).when(margin.isNull() | F.isnan(margin) | (margin < 0), 1.0).otherwise(1 / (1 + margin))


def geometric_mean(value: Column, weight: Column | None = None, least: float = 1e-4) -> Column:
    """Aggregate: (weighted) geometric mean with a floor."""
    logs = F.ln(F.greatest(value, F.lit(least)))
    return F.exp(F.avg(logs)) if weight is None else F.exp(F.try_divide(F.sum(weight * logs), F.sum(weight)))


def reliability(scored: DataFrame, score: str, correct: str) -> DataFrame:
    """Count and accuracy per tenth of confidence."""
    decile = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")
    return scored.groupBy(decile.alias("decile")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def class_medians(rows: DataFrame, group: str, value: str, at_least: int) -> DataFrame:
    return rows.groupBy(group).agg(F.median(value).alias("median"), F.count("*").alias("n")).filter(F.col("n") >= at_least)


def below_median_share(rows: DataFrame, medians: DataFrame, group: str, value: str) -> DataFrame:
    """Share of rows under their class's median, and rows whose class has none."""
    joined = rows.join(medians.select(group, "median"), group, "left")
    return joined.agg(F.avg(F.when(F.col("median").isNotNull(), (F.col(value) < F.col("median")).cast("double"))).alias("share"), F.count_if(F.col("median").isNull()).alias("excluded"))


def sweep(scored: DataFrame, value: str, positive: str, thresholds: list[float]) -> DataFrame:
    """Recall and false-flag rate of ``value < threshold`` for each threshold, in one pass."""
    v, p = F.col(value), F.col(positive)
    sums = scored.agg(
        F.count_if(p).alias("p"), F.count_if(~p).alias("q"), *[F.count_if(p & (v < x)).alias(f"p{i}") for i, x in enumerate(thresholds)], *[F.count_if(~p & (v < x)).alias(f"q{i}") for i, x in enumerate(thresholds)]
    )
    rows = [F.struct(F.lit(float(x)).alias("threshold"), F.try_divide(F.col(f"p{i}"), F.col("p")).alias("recall"), F.try_divide(F.col(f"q{i}"), F.col("q")).alias("false_flag")) for i, x in enumerate(thresholds)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def youden(scored: DataFrame, value: str, positive: str) -> DataFrame:
    """The distinct value with the largest recall less false-flag rate of ``value <= it``; the least wins.

    Values are counted, then dealt to ranges; running sums go over a range, on top of the sums of those before.
    """
    counts = scored.groupBy(F.col(value).alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    ranged = materialise(counts.repartitionByRange("threshold").withColumn("part", F.spark_partition_id()), "value-ranges")
    sums = ranged.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("sp", "sq")], F.sum("sp").over(every).alias("tp"), F.sum("sq").over(every).alias("tq"))
    upto = Window.partitionBy("part").orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)
    gains = ranged.withColumns({"cp": F.sum("p").over(upto), "cq": F.sum("q").over(upto)}).join(bases, "part")
    youden = F.round((F.col("cp") + F.col("before_sp")) / F.col("tp") - (F.col("cq") + F.col("before_sq")) / F.col("tq"), 12)
    best = gains.select("threshold", youden.alias("j")).agg(F.min(F.struct(-F.col("j"), F.col("threshold"))).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), (-F.col("b.col1")).alias("j"))


def describe(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, median, population deviation, quartiles by index, least and largest."""
    n = F.count("*")
    return rows.groupBy(group).agg(
        n.alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("largest")
    ).join(index_quartiles(rows, group, value), group)


def index_quartiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``v[n div 4]`` and ``v[3n div 4]`` of the sorted values, through counts of distinct values."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("k"))
    by = Window.partitionBy(group)
    upto = by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    places = counts.withColumns({"upto": F.sum("k").over(upto), "n": F.sum("k").over(by)})
    pick = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col(value)))
    return places.groupBy(group).agg(pick(0.25).alias("q1"), pick(0.75).alias("q3"))
