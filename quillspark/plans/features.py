"""Feature queries over 8 x 8 rasters and their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import features as ft
from quillspark.plans.base import Suite
from quillspark.plans.raster import INK, PX, mask, px

SUITE = Suite()


def _cells(t):
    return px(t).withColumn("v", F.col("v").cast("double"))


@SUITE.query("f01_f12_extract")
def _(t):
    glyphs = t.embeddings.select("vec_id", F.transform("embedding", lambda e: (e < 0).cast("int")).alias("ink"), F.lit(8).alias("w"), F.lit(6.0).alias("b"), F.lit(5.0).alias("x"))
    return glyphs.select("vec_id", ft.extract(glyphs, "ink", "w", "b", "x").alias("features"))


@SUITE.query("f03_centroid", f"WITH {INK} SELECT img, coalesce(avg(x) FILTER (WHERE ink), 4.0) AS cx, coalesce(avg(y) FILTER (WHERE ink), 4.0) AS cy FROM mask GROUP BY img")
def _(t):
    return ft.centroid(mask(t), 8, 8)


@SUITE.query("f06_zone_density", f"WITH {PX} SELECT img, CAST(y // 2 * 4 + x // 2 AS INT) AS zone, avg(v) AS density FROM px GROUP BY ALL")
def _(t):
    return ft.zone_density(_cells(t), 2)


@SUITE.query(
    "f07_gradient",
    f"""WITH {PX}, n AS (SELECT a.img, a.y, a.x,
            sum(b.v * (b.x - a.x) * CASE WHEN b.y = a.y THEN 2.0 ELSE 1.0 END) AS gx, sum(b.v * (b.y - a.y) * CASE WHEN b.x = a.x THEN 2.0 ELSE 1.0 END) AS gy
          FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL),
        f AS (SELECT img, y, x, sqrt(gx * gx + gy * gy) AS m, CASE WHEN gy < 0 THEN -gx ELSE gx END AS fx, abs(gy) AS fy FROM n),
        s AS (SELECT img, CAST(y // 2 * 4 + x // 2 AS INT) AS zone, CASE WHEN fx > 0 AND fy < fx THEN 0 WHEN fx > 0 THEN 1 WHEN fy >= -fx THEN 2 ELSE 3 END AS bin, sum(m) AS m FROM f WHERE m > 0 GROUP BY ALL)
        SELECT img, zone, bin, m / sum(m) OVER (PARTITION BY img) AS share FROM s""",
)
def _(t):
    return ft.gradient_bins(_cells(t), 2)


@SUITE.query(
    "f08_projections",
    f"""WITH {PX}, t AS (SELECT img, sum(v) AS t FROM px GROUP BY img) SELECT img, axis, band, sum(v) / any_value(t) AS share FROM (
          SELECT img, 'row' AS axis, CAST(y // 2 AS INT) AS band, v FROM px UNION ALL SELECT img, 'column', CAST(x // 2 AS INT), v FROM px) JOIN t USING (img) GROUP BY ALL""",
)
def _(t):
    return ft.projections(_cells(t), 2)


@SUITE.query(
    "f09_crossings",
    f"""WITH {INK}, c AS (SELECT img, 'row' AS axis, y AS cut, x AS p, ink FROM mask WHERE y IN (2, 4, 6) UNION ALL SELECT img, 'column', x, y, ink FROM mask WHERE x IN (2, 4, 6)),
          u AS (SELECT *, ink AND NOT coalesce(lag(ink) OVER (PARTITION BY img, axis, cut ORDER BY p), false) AS up FROM c)
        SELECT img, axis, cut, least(count(*) FILTER (WHERE up), 6) / 6 AS share FROM u GROUP BY ALL""",
)
def _(t):
    return ft.crossings(mask(t), [2, 4, 6])


@SUITE.query(
    "f10_f11_holes",
    f"""WITH RECURSIVE {INK}, bg AS (SELECT img, y * 8 + x AS i, y, x FROM mask WHERE NOT ink),
          reach(img, i, j) AS (SELECT img, i, i FROM bg UNION SELECT r.img, r.i, b.i FROM reach r JOIN bg a ON a.img = r.img AND a.i = r.j JOIN bg b ON b.img = a.img AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
          c AS (SELECT img, i, min(j) AS f FROM reach GROUP BY img, i), k AS (SELECT img, f, bool_or(y IN (0, 7) OR x IN (0, 7)) AS edge FROM c JOIN bg USING (img, i) GROUP BY img, f)
        SELECT vec_id AS img, CAST(least(count(f) FILTER (WHERE NOT edge), 2) AS INT) AS holes FROM embeddings LEFT JOIN k ON img = vec_id GROUP BY vec_id""",
)
def _(t):
    from quillspark.operators import raster as rs

    m = mask(t)
    regions = rs.label(m.withColumn("ink", ~F.col("ink")), eight=False)
    edge = F.col("x").isin(0, 7) | F.col("y").isin(0, 7)
    inner = regions.groupBy("img", "label").agg(F.bool_or(edge).alias("edge")).filter("not edge").groupBy("img").agg(F.count("*").alias("n"))
    return m.select("img").distinct().join(inner, "img", "left").select("img", ft.hole_class(F.coalesce("n", F.lit(0)).cast("double")).alias("holes"))


_VEC = "(SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings)"


@SUITE.query("f14_moments", f"SELECT CAST(dim AS INT) AS dim, avg(e) AS mean, CASE WHEN stddev_pop(e) > 0 THEN stddev_pop(e) ELSE 1.0 END AS sd FROM {_VEC} GROUP BY dim")
def _(t):
    return ft.moments(t.embeddings, "embedding")


@SUITE.query(
    "f13_standardise",
    f"""WITH m AS (SELECT dim, avg(e) AS mean, CASE WHEN stddev_pop(e) > 0 THEN stddev_pop(e) ELSE 1.0 END AS sd FROM {_VEC} GROUP BY dim)
        SELECT vec_id, CAST(dim AS INT) AS dim, (e - mean) / sd AS z FROM {_VEC} JOIN m USING (dim)""",
)
def _(t):
    z = ft.standardise(t.embeddings.select("vec_id", "embedding"), "embedding", ft.moments(t.embeddings, "embedding"))
    return z.select("vec_id", F.posexplode("z").alias("dim", "z"))


@SUITE.query("f15_weights", "SELECT CAST(range AS INT) AS dim, CASE range WHEN 3 THEN 9.0 WHEN 40 THEN 0.0 ELSE CASE WHEN range < 16 THEN 1.5 WHEN range < 80 THEN 1.0 ELSE 0.5 END END AS weight FROM range(107)")
def _(t):
    dims = t.spark.range(ft.DIMS).select(F.col("id").cast("int").alias("dim"))
    blocks = t.spark.createDataFrame([(0, 16, 1.5), (16, 80, 1.0), (80, 107, 0.5)], "lo int, hi int, weight double")
    return ft.expand_weights(dims, blocks, t.spark.createDataFrame([(3, 9.0), (40, 0.0)], "dim int, weight double"))


@SUITE.query(
    "f16_f17_differences",
    """SELECT a.vec_id, len(d) AS n, d[1] AS first FROM (SELECT a.vec_id, list_filter(range(0, len(a.embedding)), lambda i: a.embedding[i + 1] <> b.embedding[i + 1]) AS d
         FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""",
)
def _(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = t.embeddings.join(other, "vec_id").select("vec_id", ft.differences(F.col("embedding"), F.col("other")).alias("d"))
    return d.select("vec_id", F.size("d").cast("long").alias("n"), F.get("d", F.lit(0)).cast("long").alias("first"))
