"""Layout queries: a user's events stand for the boxes of a line, line items for boxes of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import layout as ly
from quillspark.plans.base import Suite

SUITE = Suite()

_BOX = """box AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS id, CAST(l_partkey % 200 AS INT) AS x0, CAST(l_partkey % 200 + 1 + l_quantity AS INT) AS x1, CAST(l_suppkey % 40 AS INT) AS y0,
                 CAST(l_suppkey % 40 + 4 + l_linenumber AS INT) AS y1 FROM lineitem)"""


def boxes(t):
    x0, y0 = (F.col("l_partkey") % 200).cast("int"), (F.col("l_suppkey") % 40).cast("int")
    return t.lineitem.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), x0.alias("x0"), (x0 + 1 + F.col("l_quantity")).cast("int").alias("x1"), y0.alias("y0"), (y0 + 4 + F.col("l_linenumber")).cast("int").alias("y1")
    )


_REACH = "max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_GAPS = f"{_BOX}, g AS (SELECT *, CASE WHEN {_REACH} IS NOT NULL THEN greatest(x0 - {_REACH}, 0) END AS gap FROM box)"


@SUITE.query("l23_gaps", f"WITH {_GAPS} SELECT page, x0, x1, gap FROM g")
def _(t):
    return ly.gaps(boxes(t), ["page"]).select("page", "x0", "x1", "gap")


@SUITE.query(
    "l09_l28_column_gaps",
    f"WITH {_GAPS}, s AS (SELECT page, x0, x1, sum(CASE WHEN gap > 1.75 * 8 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1) AS segment FROM g) SELECT page, segment, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY ALL",
)
def _(t):
    cut = ly.split_at_gaps(boxes(t).withColumn("scale", F.lit(8)), ["page"], 1.75, "scale")
    return cut.groupBy("page", "segment").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@SUITE.query(
    "l31_l36_x13_merge_intervals",
    f"WITH {_BOX}, s AS (SELECT page, x0, x1, sum(CASE WHEN x0 >= r THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1) AS cell FROM (SELECT *, {_REACH} AS r FROM box)) SELECT page, cell, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY ALL",
)
def _(t):
    return ly.merge_intervals(boxes(t), ["page"])


@SUITE.query(
    "l13_l15_weighted_median",
    f"""WITH {_BOX}, c AS (SELECT page, v, sum(w) AS w FROM (SELECT page % 50 AS page, y1 - y0 AS v, x1 - x0 AS w FROM box) GROUP BY ALL), u AS (SELECT page, v, sum(w) OVER (PARTITION BY page ORDER BY v) AS upto, sum(w) OVER (PARTITION BY page) AS total FROM c)
        SELECT page, min(v) AS median FROM u WHERE upto > total // 2 GROUP BY page""",
)
def _(t):
    rows = boxes(t).select((F.col("page") % 50).alias("page"), (F.col("y1") - F.col("y0")).alias("v"), (F.col("x1") - F.col("x0")).alias("w"))
    return ly.weighted_median(rows, ["page"], "v", "w")


_HIST = f"{_BOX}, h AS (SELECT page, bin, sum(w) AS h FROM (SELECT page % 50 AS page, y1 + d AS bin, (x1 - x0) * k AS w FROM box, (VALUES (-1, 1), (0, 2), (1, 1)) AS o(d, k)) GROUP BY ALL)"


def histogram(t):
    rows = boxes(t).select((F.col("page") % 50).alias("page"), "y1", (F.col("x1") - F.col("x0")).alias("w"))
    return ly.smoothed_histogram(rows, ["page"], "y1", "w")


@SUITE.query("l11_smoothed_histogram", f"WITH {_HIST} SELECT * FROM h")
def _(t):
    return histogram(t)


@SUITE.query("l10_l12_x10_mode", f"WITH {_HIST} SELECT page, arg_min(bin, (-h, bin)) AS mode FROM h GROUP BY page")
def _(t):
    return ly.first_mode(histogram(t), ["page"])


@SUITE.query("l14_body", f"WITH {_BOX}, b AS (SELECT page, id, y1 - y0 >= 9.5 AS tall, bool_or(y1 - y0 >= 9.5) OVER (PARTITION BY page) AS found FROM box) SELECT page, id FROM b WHERE tall OR NOT found")
def _(t):
    rows = boxes(t).select("page", "id", (F.col("y1") - F.col("y0")).alias("h"), F.lit(19).alias("ref"))
    return ly.body(rows, ["page"], "h", "ref").select("page", "id")


_VALLEY = f"""{_GAPS}, c AS (SELECT page % 500 AS page, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL),
     u AS (SELECT *, sum(n) OVER w AS cn, sum(n * gap) OVER w AS cs, sum(n) OVER p AS tn, sum(n * gap) OVER p AS ts, sum(n * gap * gap) OVER p AS tq FROM c WINDOW w AS (PARTITION BY page ORDER BY gap), p AS (PARTITION BY page)),
     e AS (SELECT page, gap, cn * (tn - cn) / (tn * tn) * (cs / cn - (ts - cs) / (tn - cn)) * (cs / cn - (ts - cs) / (tn - cn)) AS between_, tq / tn - (ts / tn) * (ts / tn) AS variance FROM u WHERE cn < tn),
     v AS (SELECT page, gap AS cut, between_ / variance AS eta FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(between_, 9) DESC, gap) AS k FROM e) WHERE k = 1)"""


def line_gaps(t):
    return ly.gaps(boxes(t), ["page"]).filter("gap is not null").select((F.col("page") % 500).alias("page"), "gap")


@SUITE.query("l24_valley", f"WITH {_VALLEY} SELECT * FROM v")
def _(t):
    return ly.valley(line_gaps(t), ["page"], "gap")


@SUITE.query(
    "l25_l27_x07_space_rule",
    f"""WITH {_VALLEY}, s AS (SELECT page, 10 + page % 30 AS x_height, sum(n) AS n, min(gap) AS least, max(gap) AS most, min(CASE WHEN gap > cut THEN gap END) AS nxt, any_value(cut) AS cut, any_value(eta) AS eta FROM c LEFT JOIN v USING (page) GROUP BY page),
          k AS (SELECT *, greatest(CAST(trunc(x_height * 0.7) AS INT), 1) AS ceil_, greatest(CAST(trunc(x_height * 0.4) AS INT), 1) AS fall, greatest(CAST(trunc(x_height * 0.3) AS INT), 1) AS low,
                CASE WHEN n = 0 OR least = most THEN 'uniform' WHEN n < 3 OR cut IS NULL OR eta < 0.7 OR nxt <= greatest(CAST(trunc(x_height * 0.3) AS INT), 1) THEN 'fallback' WHEN cut >= greatest(CAST(trunc(x_height * 0.7) AS INT), 1) THEN 'capped' ELSE 'valley' END AS source FROM s)
        SELECT page, source, CASE WHEN source IN ('uniform', 'capped') THEN ceil_ WHEN source = 'fallback' THEN fall ELSE cut END AS threshold FROM k""",
)
def _(t):
    g = line_gaps(t)
    cuts = ly.valley(g, ["page"], "gap")
    joined = g.join(cuts, "page", "left").groupBy("page").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.min(F.when(F.col("gap") > F.col("cut"), F.col("gap"))).alias("next"), F.first("cut").alias("cut"), F.first("eta").alias("eta"))
    return ly.space_rule(joined.withColumn("x_height", 10 + F.col("page") % 30)).select("page", "source", "threshold")


@SUITE.query(
    "l26_x03_pooled_spaces",
    f"""WITH {_VALLEY}, b AS (SELECT page % 500 AS page, page AS line, gap FROM g WHERE gap IS NOT NULL) SELECT page, line, count(*) FILTER (WHERE gap > coalesce(cut, 4)) AS spaces FROM b LEFT JOIN v USING (page) GROUP BY ALL""",
)
def _(t):
    cuts = ly.valley(line_gaps(t), ["page"], "gap").select("page", "cut")
    lines = ly.gaps(boxes(t), ["page"]).filter("gap is not null").select((F.col("page") % 500).alias("page"), F.col("page").alias("line"), "gap")
    return lines.join(cuts, "page", "left").groupBy("page", "line").agg(F.count_if(F.col("gap") > F.coalesce("cut", F.lit(4))).alias("spaces"))


@SUITE.query(
    "l29_x36_run_lengths",
    """WITH k AS (SELECT l_orderkey AS page, l_linenumber AS pos, min(l_returnflag) AS key FROM lineitem GROUP BY ALL), r AS (SELECT *, CASE WHEN key <> lag(key) OVER w THEN 1 ELSE 0 END AS cut FROM k WINDOW w AS (PARTITION BY page ORDER BY pos)),
          s AS (SELECT *, sum(cut) OVER (PARTITION BY page ORDER BY pos) AS run FROM r) SELECT page, run, any_value(key) AS key, min(pos) AS first, count(*) AS n FROM s GROUP BY page, run""",
)
def _(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos")).agg(F.min("l_returnflag").alias("key"))
    return ly.run_lengths(rows, ["page"], "pos", "key")


_EV = "e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS c FROM events)"


def centres(t):
    return t.events.select("user_id", "event_id", F.unix_timestamp("ts").alias("c"))


@SUITE.query("l30_x05_medians", f"WITH {_EV}, s AS (SELECT user_id, lead(c) OVER (PARTITION BY user_id ORDER BY c) - c AS step FROM e) SELECT user_id, median(step) AS pitch FROM s WHERE step IS NOT NULL GROUP BY user_id")
def _(t):
    return ly.pitch(centres(t), ["user_id"], "c").select("user_id", "pitch")


@SUITE.query(
    "l32_pitch",
    f"""WITH {_EV}, s AS (SELECT user_id, lead(c) OVER (PARTITION BY user_id ORDER BY c) - c AS step FROM e), m AS (SELECT user_id, median(step) AS pitch FROM s WHERE step IS NOT NULL GROUP BY user_id)
        SELECT user_id, any_value(pitch) AS pitch, avg(CAST(coalesce(abs(step / nullif(pitch, 0) - greatest(round(step / nullif(pitch, 0)), 1)) <= 0.22, false) AS DOUBLE)) AS agreement FROM s JOIN m USING (user_id) WHERE step IS NOT NULL GROUP BY user_id""",
)
def _(t):
    return ly.pitch(centres(t), ["user_id"], "c")


@SUITE.query(
    "l33_l34_x04_fitted_grid",
    f"""WITH {_EV}, s AS (SELECT user_id, c, c - lag(c) OVER (PARTITION BY user_id ORDER BY c) AS step FROM e), m AS (SELECT user_id, median(step) AS pitch FROM s WHERE step IS NOT NULL GROUP BY user_id),
          i AS (SELECT user_id, c, sum(coalesce(greatest(round(step / nullif(pitch, 0)), 1), 0)) OVER (PARTITION BY user_id ORDER BY c) AS idx FROM s JOIN m USING (user_id))
        SELECT user_id, round(regr_slope(c, idx), 3) AS slope FROM i GROUP BY user_id""",
)
def _(t):
    rows = centres(t)
    grid = ly.fitted_grid(rows, ["user_id"], "c", ly.pitch(rows, ["user_id"], "c").select("user_id", "pitch"))
    return grid.select("user_id", F.round("slope", 3).alias("slope"))


_NEAR = f"""{_BOX}, n AS (SELECT m.page, m.id AS mark, h.id AS host, greatest(h.y0 - m.y1, m.y0 - h.y1, 0) AS gap, h.y0 < m.y0 AS above, m.y1 - m.y0 AS mh
             FROM box m JOIN box h ON m.page = h.page AND m.id <> h.id AND least(m.x1, h.x1) > greatest(m.x0, h.x0))"""


@SUITE.query(
    "l05_l06_x11_nearest_host",
    f"WITH {_NEAR} SELECT page, mark, host, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, mark ORDER BY gap, above, host) AS k FROM n WHERE gap <= 2.0 * mh) WHERE k = 1",
)
def _(t):
    return ly.nearest_host(boxes(t), boxes(t), "page", 2.0, 50)


@SUITE.query(
    "l18_l22_overlap_predicates",
    f"""WITH {_BOX} SELECT a.page, a.id, b.id AS other, a.x0 >= b.x0 AND a.x1 <= b.x1 AS inside, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) >= 0.5 * least(a.x1 - a.x0, b.x1 - b.x0) AS columns
        FROM box a JOIN box b ON a.page = b.page AND a.id < b.id""",
)
def _(t):
    a, b = boxes(t), boxes(t).select("page", F.col("id").alias("other"), F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    c = [F.col(k) for k in ("x0", "x1", "o0", "o1")]
    return a.join(b, "page").filter("id < other").select("page", "id", "other", ly.contained(*c).alias("inside"), ly.columns_overlap(*c, 0.5).alias("columns"))


@SUITE.query("l01_l04_l20_l21_l35_predicates", f"WITH {_BOX} SELECT page, id, greatest(x1 - x0, y1 - y0) <= 1.25 * least(x1 - x0, y1 - y0) AND (x1 - x0) * 4 <= 0.95 * (x1 - x0) * (y1 - y0) AS checkbox, (x1 - x0) * (y1 - y0) >= 2 AS glyphish, x1 - x0 >= (2 - 0.22) * 12 AS touching, y1 - 30 <= 0.4 * 12 AND y0 < 30 AS hangs FROM box")
def _(t):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return boxes(t).select("page", "id", ly.checkbox_shaped(w, h, w * 4).alias("checkbox"), (w * h >= 2).alias("glyphish"), (w >= (2 - 0.22) * 12).alias("touching"), ((F.col("y1") - 30 <= 0.4 * 12) & (F.col("y0") < 30)).alias("hangs"))


_ATOM = "a AS (SELECT l_orderkey AS word, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS pos, CAST(l_linenumber * 10 AS INT) AS x0, CAST(l_linenumber * 10 + 8 AS INT) AS x1 FROM lineitem)"


@SUITE.query(
    "l37_l38_x14_lattice",
    f"WITH {_ATOM} SELECT a.word, a.pos AS src, b.pos + 1 AS dst, CASE WHEN a.pos = b.pos THEN 'single' ELSE 'merge' END AS kind, a.x0, b.x1 FROM a JOIN a b ON a.word = b.word AND b.pos BETWEEN a.pos AND a.pos + 2",
)
def _(t):
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    atoms = t.lineitem.select(F.col("l_orderkey").alias("word"), pos.cast("int").alias("pos"), (F.col("l_linenumber") * 10).alias("x0"), (F.col("l_linenumber") * 10 + 8).alias("x1")).dropDuplicates(["word", "pos"])
    return ly.lattice(atoms, ["word"])


@SUITE.query(
    "l39_interior_cuts",
    """WITH p AS (SELECT vec_id AS img, CAST(i % 8 AS INT) AS x, count(*) FILTER (WHERE floor(CAST(e AS DOUBLE) * 400 + 128) < 128) AS ink FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL),
          n AS (SELECT *, lag(ink) OVER w AS b, lead(ink) OVER w AS a, max(ink) OVER (PARTITION BY img) AS peak FROM p WINDOW w AS (PARTITION BY img ORDER BY x))
        SELECT img, x, ink FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY ink, x) AS k FROM n WHERE ink <= b AND ink < a AND ink < 0.65 * peak) WHERE k <= 3""",
)
def _(t):
    from quillspark.operators import raster as rs
    from quillspark.plans.raster import mask

    return ly.interior_cuts(rs.column_profile(mask(t)), ["img"])


@SUITE.query(
    "l41_banded_words",
    """WITH w AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER v THEN 1 ELSE 0 END AS cut FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
       SELECT conv_id, band, any_value(role) AS role, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS band FROM w) GROUP BY conv_id, band""",
)
def _(t):
    return ly.run_lengths(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").select("conv_id", F.col("run").alias("band"), "role", "n")


@SUITE.query("l40_visual_rows")
def _(t):
    return ly.visual_rows(_pages(t), "page")


@SUITE.query("l02_l03_best_bands")
def _(t):
    return ly.best_bands(_pages(t), "page")


def _pages(t):
    """300 pages of many boxes."""
    return boxes(t).withColumns({"id": F.col("page") * 10 + F.col("id"), "page": F.col("page") % 300})


@SUITE.query("l07_l08_split_baselines")
def _(t):
    rows = boxes(t).select((F.col("page") % 500).alias("page"), (F.col("page") * 10 + F.col("id")).alias("id"), "y1")
    return ly.split_baselines(rows, "page", "y1", 6.0)
