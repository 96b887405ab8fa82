"""Raster queries; each vector of ``embeddings`` is an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import raster as rs
from quillspark.plans.base import Suite

SUITE = Suite()

PX = """px AS (SELECT vec_id AS img, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(greatest(least(floor(CAST(e AS DOUBLE) * 400 + 128), 255), 0) AS INT) AS v
              FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
INK = PX + ", mask AS (SELECT img, y, x, v < 128 AS ink FROM px)"


def px(t):
    return rs.pixels(t.embeddings, "vec_id", "embedding", 8)


def mask(t):
    return px(t).select("img", "y", "x", (F.col("v") < 128).alias("ink"))


@SUITE.query("p01_integrals", f"WITH {PX} SELECT a.img, a.y, a.x, a.v, sum(b.v) AS s, sum(b.v * b.v) AS q FROM px a JOIN px b ON a.img = b.img AND b.y <= a.y AND b.x <= a.x GROUP BY ALL")
def _(t):
    return rs.integrals(px(t))


@SUITE.query("p02_box_sum", f"WITH {PX} SELECT img, img % 3 AS box, sum(v) AS total FROM px WHERE x BETWEEN 1 + img % 3 AND 6 AND y BETWEEN 2 AND 5 + img % 3 GROUP BY img")
def _(t):
    boxes = t.embeddings.select(F.col("vec_id").alias("img"), (F.col("vec_id") % 3).alias("box")).select("img", "box", (1 + F.col("box")).cast("int").alias("x0"), F.lit(2).alias("y0"), F.lit(6).alias("x1"), (5 + F.col("box")).cast("int").alias("y1"))
    return rs.box_sum(rs.integrals(px(t)), boxes)


_MOM = f"""{PX}, m AS (SELECT a.img, a.y, a.x, any_value(a.v) AS v, avg(b.v) AS mean, sqrt(greatest(sum(b.v * b.v) / count(*) - (sum(b.v) / count(*)) * (sum(b.v) / count(*)), 0.0)) AS sd, min(b.v) AS lo, max(b.v) AS hi
           FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.img, a.y, a.x)"""


@SUITE.query(
    "p03_sauvola",
    f"""WITH {_MOM}, k AS (SELECT img, y, x, v < mean * (1 + 0.34 * (sd / 128.0 - 1)) AS ink FROM m)
        SELECT img, y, x, ink <> (count(*) FILTER (WHERE ink) OVER (PARTITION BY img) * 2 > count(*) OVER (PARTITION BY img)) AS ink FROM k""",
)
def _(t):
    return rs.sauvola(px(t), window=5)


@SUITE.query(
    "p28_wolf",
    f"""WITH {_MOM} SELECT img, y, x, v <= mean - 0.5 * (1 - coalesce(sd / nullif(max(sd) OVER (PARTITION BY img), 0), 0)) * (mean - min(v) OVER (PARTITION BY img)) AS ink FROM m""",
)
def _(t):
    return rs.wolf(px(t), window=5)


@SUITE.query("p29_local_stretch", f"WITH {_MOM} SELECT img, y, x, CAST(CASE WHEN hi - lo < 24 THEN 255 ELSE floor((v - lo) * 255 / (hi - lo)) END AS INT) AS v FROM m")
def _(t):
    return rs.stretch_local(px(t), window=5)


@SUITE.query(
    "p27_contrast_stretch",
    f"""WITH {PX}, e AS (SELECT img, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.5) AS hi FROM px GROUP BY img)
        SELECT img, y, x, CAST(floor(least(greatest((v - lo) * 255 / greatest(hi - lo, 1.0), 0), 255)) AS INT) AS v FROM px JOIN e USING (img)""",
)
def _(t):
    return rs.stretch_contrast(px(t))


@SUITE.query(
    "p24_morphology",
    f"""WITH {INK} SELECT a.img, a.y, a.x, bool_or(b.ink) AS dilated, bool_and(b.ink) AND a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 AS eroded
        FROM mask a JOIN mask b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x""",
)
def _(t):
    m = mask(t)
    return rs.morph(m, False).withColumnRenamed("ink", "dilated").join(rs.morph(m, True).withColumnRenamed("ink", "eroded"), ["img", "y", "x"])


@SUITE.query("p25_blur", f"WITH {PX} SELECT a.img, a.y, a.x, avg(b.v) AS v FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x")
def _(t):
    return rs.blur3(px(t))


@SUITE.query(
    "p08_border_value",
    f"""WITH {PX}, b AS (SELECT img, list_sort(list(v)) AS s FROM (SELECT img, v FROM px WHERE y IN (0, 7) UNION ALL SELECT img, v FROM px WHERE x IN (0, 7)) GROUP BY img) SELECT img, s[len(s) // 2 + 1] AS border FROM b""",
)
def _(t):
    return rs.border_value(px(t))


_SHARP = f"""{INK}, c AS (SELECT img, slope, floor(y - x * slope) AS r, count(*) AS n FROM mask, (SELECT unnest([-0.25, -0.125, 0.0, 0.125, 0.25])::DOUBLE AS slope) WHERE ink GROUP BY ALL),
             s AS (SELECT img, slope, sum(n * n) AS score FROM c GROUP BY ALL)"""


def _scores(t):
    return rs.sharpness(mask(t).filter("ink"), F.array(*[F.lit(x) for x in (-0.25, -0.125, 0.0, 0.125, 0.25)]))


@SUITE.query("p05_sharpness", f"WITH {_SHARP} SELECT * FROM s")
def _(t):
    return _scores(t)


@SUITE.query("p06_best_slope", f"WITH {_SHARP} SELECT img, slope, score FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, abs(slope), slope) AS k FROM s) WHERE k = 1")
def _(t):
    return rs.best_slope(_scores(t))


@SUITE.query("p04_p07_p22_deskew")
def _(t):
    flat = rs.deskew(t.embeddings, "vec_id", "embedding", 8, max_slope=0.25)
    return flat.select("img", "y", "x", "v", rs.unshear(F.col("y"), F.col("x"), F.col("slope"), F.lit(8)).alias("from_y"))


@SUITE.query(
    "p18_p19_slant",
    f"""WITH {INK}, a AS (SELECT range AS angle, CAST(round(tan(radians(range)) * 4096) AS BIGINT) AS q FROM range(21)),
          c AS (SELECT img, angle, x - sign(7 - y) * ((abs((7 - y) * q) + 2048) // 4096) AS col, count(*) AS n FROM mask, a WHERE ink GROUP BY ALL), s AS (SELECT img, angle, sum(n * n) AS score FROM c GROUP BY ALL),
          b AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, angle) AS k, max(CASE WHEN angle = 0 THEN score END) OVER (PARTITION BY img) AS upright FROM s)
        SELECT img, angle, angle < 20 AND angle >= 6.0 AND score >= 1.08 * upright AS slanted FROM b WHERE k = 1""",
)
def _(t):
    return rs.slant(rs.angle_scores(mask(t).filter("ink"), F.lit(7)))


_LABEL = f"""{INK}, ink AS (SELECT img, y, x, y * 8 + x AS i FROM mask WHERE ink),
     reach(img, i, j) AS (SELECT img, i, i FROM ink UNION SELECT r.img, r.i, b.i FROM reach r JOIN ink a ON a.img = r.img AND a.i = r.j JOIN ink b ON b.img = a.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
     lab AS (SELECT img, y, x, dense_rank() OVER (PARTITION BY img ORDER BY f) AS label FROM (SELECT img, i, min(j) AS f FROM reach GROUP BY img, i) JOIN ink USING (img, i))"""


@SUITE.query("p09_label", f"WITH RECURSIVE {_LABEL} SELECT * FROM lab")
def _(t):
    return rs.label(mask(t))


@SUITE.query(
    "p10_p11_components",
    f"""WITH RECURSIVE {_LABEL}, b AS (SELECT img, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM lab GROUP BY ALL)
        SELECT img, label, x0, y0, x1, y1, area, count(DISTINCT CASE WHEN y = y0 THEN x END) / any_value(x1 - x0) AS top, count(DISTINCT CASE WHEN y = y1 - 1 THEN x END) / any_value(x1 - x0) AS bottom,
               count(DISTINCT CASE WHEN x = x0 THEN y END) / any_value(y1 - y0) AS left, count(DISTINCT CASE WHEN x = x1 - 1 THEN y END) / any_value(y1 - y0) AS right
        FROM b JOIN lab USING (img, label) GROUP BY img, label, x0, y0, x1, y1, area""",
)
def _(t):
    return rs.boxes(rs.label(mask(t)))


@SUITE.query(
    "p12_r07_overlaps",
    f"""WITH RECURSIVE {_LABEL}, b AS (SELECT img, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab GROUP BY ALL)
        SELECT a.img, a.label, b.label AS other, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS over_y, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) > 0 AS over_x
        FROM b a JOIN b ON a.img = b.img AND a.label < b.label""",
)
def _(t):
    c = ["x0", "y0", "x1", "y1"]
    b = rs.label(mask(t)).groupBy("img", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    other = b.select("img", F.col("label").alias("other"), *[F.col(k).alias("o" + k) for k in c])
    both = b.join(other, "img").filter("label < other")
    over = lambda axis: rs.overlap(F.col(axis + "0"), F.col(axis + "1"), F.col("o" + axis + "0"), F.col("o" + axis + "1"))
    return both.select("img", "label", "other", over("y").alias("over_y"), (over("x") > 0).alias("over_x"))


_RUNS = f"""{INK}, r AS (SELECT img, y AS line, min(x) AS start, max(x) + 1 AS stop FROM (SELECT img, y, x, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS k FROM mask WHERE ink) GROUP BY img, y, k)"""
_SINGLE = f"{_RUNS}, s AS (SELECT img, line, min(start) AS start, min(stop) AS stop FROM r WHERE stop - start >= 3 GROUP BY img, line HAVING count(*) = 1)"


@SUITE.query("p15_p16_runs", f"WITH {_SINGLE} SELECT * FROM s")
def _(t):
    return rs.single_runs(mask(t), 3)


@SUITE.query(
    "p14_rule_bands",
    f"""WITH {_SINGLE}, n AS (SELECT *, CASE WHEN line - lag(line) OVER w = 1 AND abs(start - lag(start) OVER w) <= 2 AND abs(stop - lag(stop) OVER w) <= 2 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY img ORDER BY line)),
          b AS (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY line) AS band FROM n)
        SELECT img, band, min(line) AS y0, max(line) + 1 AS y1, min(start) AS x0, max(stop) AS x1 FROM b GROUP BY img, band HAVING count(*) >= 2""",
)
def _(t):
    return rs.rule_bands(rs.single_runs(mask(t), 3))


@SUITE.query("p13_p17_strip_rules")
def _(t):
    return rs.strip_rules(mask(t), 3)


@SUITE.query("p20_column_profile", f"WITH {INK} SELECT img, x, count(*) FILTER (WHERE ink) AS ink FROM mask GROUP BY ALL")
def _(t):
    return rs.column_profile(mask(t))


@SUITE.query("p21_crop", f"WITH {INK}, e AS (SELECT * FROM (VALUES (0, 0, 4), (1, 3, 8)) AS e(edge, x0, x1)) SELECT img, edge, y - min(y) OVER (PARTITION BY img, edge) AS y, x - min(x) OVER (PARTITION BY img, edge) AS x FROM mask, e WHERE ink AND x >= x0 AND x < x1")
def _(t):
    spans = t.embeddings.select(F.col("vec_id").alias("img"), F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for e, a, b in ((0, 0, 4), (1, 3, 8))])).alias("s")).select("img", "s.*")
    return rs.crop(mask(t), spans)


@SUITE.query(
    "p26_bilinear",
    f"""WITH {PX}, p AS (SELECT vec_id AS img, 0 AS point, 1.5 + vec_id % 4 * 0.25 AS x, 6.75 AS y FROM embeddings)
        SELECT p.img, point, sum(v * greatest(0, 1 - abs(p.x - px.x)) * greatest(0, 1 - abs(p.y - px.y))) AS v FROM p JOIN px USING (img) GROUP BY ALL""",
)
def _(t):
    points = t.embeddings.select(F.col("vec_id").alias("img"), F.lit(0).alias("point"), (1.5 + F.col("vec_id") % 4 * 0.25).alias("x"), F.lit(6.75).alias("y"))
    return rs.bilinear(px(t), points)


@SUITE.query("p23_augment")
def _(t):
    return rs.augment(t.embeddings.select(F.col("vec_id").alias("img"), F.col("embedding").cast("array<double>").alias("raster")), 8)
