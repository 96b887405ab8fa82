"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import discard, scratch_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung under the node's least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung under the least of these neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u")
    return (
        hung.select(F.col("m").alias("a"), F.col("v").alias("b"))
        .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        .filter("a <> b")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` with the least node it can reach.

    Returns ``(node, component)`` for nodes that have an edge to another node; self loops and
    edges with a null end are ignored. Rounds grow with the logarithm of a component's
    diameter; each is written to the shared folder, and only a row count reaches the driver.
    """
    spark = edges.sparkSession
    path = scratch_path(spark, "edges")
    edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct().write.parquet(path)
    current, before = spark.read.parquet(path), None
    for _ in range(max_rounds):
        former, path = path, scratch_path(spark, "stars")
        _small_star(_large_star(current)).write.parquet(path)
        current = spark.read.parquet(path)
        discard(spark, former)  # nothing is computed from it any more
        n, total = current.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return members.union(roots)
