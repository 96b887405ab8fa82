"""Report queries over orders, line items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import reports as rp
from quillspark.plans.base import Suite

SUITE = Suite()


@SUITE.query("r13_linear_quantiles", "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1")
def _(t):
    q = rp.linear_quantiles(t.orders, ["o_orderpriority"], "o_totalprice", [0.1, 0.9])
    return q.select("o_orderpriority", F.get("quantiles", F.lit(0)).alias("p10"), F.get("quantiles", F.lit(1)).alias("p90"))


@SUITE.query("r14_r26_nearest_rank", "WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, v[CAST(round((len(v) - 1) * 0.9) AS BIGINT) + 1] AS quantile FROM s")
def _(t):
    return rp.nearest_rank(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.9)


_ARM = "a AS (SELECT l_orderkey AS page, sum(l_quantity) AS m FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS page, sum(l_quantity * (1 + (l_linenumber - 2) * 0.25)) AS m FROM lineitem GROUP BY 1)"


def arms(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.sum("l_quantity").alias("m"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg(F.sum(F.col("l_quantity") * (1 + (F.col("l_linenumber") - 2) * 0.25)).alias("m"))
    return a, b


@SUITE.query("r12_paired_difference", f"WITH {_ARM}, d AS (SELECT b.m - a.m AS d FROM a JOIN b USING (page)) SELECT count(*) FILTER (WHERE d < 0) AS improved, count(*) FILTER (WHERE d > 0) AS worsened, count(*) FILTER (WHERE d = 0) AS flat, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM d")
def _(t):
    return rp.paired_difference(*arms(t), "page", "m")


@SUITE.query(
    "r15_cumulative_share",
    """WITH o AS (SELECT o_orderpriority, sum(o_totalprice) OVER w AS cum, row_number() OVER w AS rn, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS total FROM orders WHERE o_totalprice > 0
                  WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       SELECT o_orderpriority, CAST(min(rn) FILTER (WHERE cum >= 0.5 * total) AS INT) AS n50, CAST(min(rn) FILTER (WHERE cum >= 0.8 * total) AS INT) AS n80 FROM o GROUP BY 1""",
)
def _(t):
    return rp.cumulative_share(t.orders, ["o_orderpriority"], "o_totalprice", {"n50": 0.5, "n80": 0.8})


@SUITE.query(
    "r16_histogram_difference",
    "SELECT l_partkey, coalesce(b, 0) - coalesce(a, 0) AS d FROM (SELECT l_partkey, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) FULL JOIN (SELECT l_partkey, count(*) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (l_partkey) ORDER BY abs(coalesce(b, 0) - coalesce(a, 0)) DESC, l_partkey LIMIT 40",
)
def _(t):
    return rp.histogram_difference(t.lineitem.filter("l_returnflag = 'A'"), t.lineitem.filter("l_returnflag = 'R'"), "l_partkey", 40)


@SUITE.query(
    "r17_timing_ratio",
    """WITH m AS (SELECT l_orderkey, min(l_quantity) FILTER (WHERE l_returnflag = 'A') AS a, min(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)
       SELECT count(*) AS pages, quantile_cont(b / a, 0.25) AS q1, median(b / a) AS median, quantile_cont(b / a, 0.75) AS q3, sum(b) / sum(a) AS total FROM m""",
)
def _(t):
    arm = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B")
    return rp.timing_ratio(t.lineitem.select(F.col("l_orderkey").alias("page"), arm.alias("arm"), F.col("l_quantity").alias("ms")))


@SUITE.query("r18_parameter_grid", "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS point, a, b, c FROM (SELECT unnest([0.1, 0.2])::DOUBLE AS a), (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS b), (SELECT unnest([5.0, 6.0])::DOUBLE AS c)")
def _(t):
    return rp.grid(t.spark, {"a": [0.1, 0.2], "b": [1, 2, 3], "c": [5, 6]})


_SWEEP = "s AS (SELECT l_suppkey, l_linenumber AS point, round(sum(abs(l_quantity - 25)), 6) AS cer FROM lineitem GROUP BY ALL)"


def sweep(t):
    return t.lineitem.groupBy("l_suppkey", F.col("l_linenumber").alias("point")).agg(F.round(F.sum(F.abs(F.col("l_quantity") - 25)), 6).alias("cer"))


@SUITE.query("r19_x29_sweep", f"WITH {_SWEEP} SELECT l_suppkey, arg_min(point, (cer, point)) AS best, min(cer) AS cer, count(DISTINCT cer) = 1 AS inert FROM s GROUP BY 1")
def _(t):
    return rp.sweep_summary(sweep(t), ["l_suppkey"], "point", "cer")


@SUITE.query("x30_edge_parameters", f"WITH {_SWEEP}, b AS (SELECT l_suppkey, arg_min(point, (cer, point)) AS best, min(point) AS lo, max(point) AS hi FROM s GROUP BY 1) SELECT l_suppkey, best, best = lo AS at_low, best = hi AS at_high FROM b")
def _(t):
    s = sweep(t)
    ends = s.groupBy("l_suppkey").agg(F.min("point").alias("lo"), F.max("point").alias("hi"))
    best = rp.sweep_summary(s, ["l_suppkey"], "point", "cer")
    return best.join(ends, "l_suppkey").select("l_suppkey", "best", (F.col("best") == F.col("lo")).alias("at_low"), (F.col("best") == F.col("hi")).alias("at_high"))


@SUITE.query(
    "r20_stride_sample",
    "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 - 1 AS k FROM documents WHERE text LIKE '%the%') SELECT source, doc_id FROM r WHERE k >= 0 AND k % 3 = 0 AND k / 3 < 5",
)
def _(t):
    return rp.sampled(t.documents.select("source", "doc_id", "text"), ["source"], "doc_id", F.col("text").contains("the"), 1, 3, 5).select("source", "doc_id")


@SUITE.query("r21_top_k", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(25)


@SUITE.query("r24_seeded_shuffle")
def _(t):
    """A seeded permutation of all documents: the order of a seeded hash."""
    return t.documents.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).orderBy("h", "doc_id")


@SUITE.query(
    "r11_r25_r34_x18_grouping_sets",
    """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level, count(*) AS n, avg(l_discount) AS mean, sum(l_quantity) / sum(l_extendedprice) AS micro
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())""",
)
def _(t):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.groupingSets([[f, s], [f], [s], []], f, s).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("l_discount").alias("mean"), (F.sum("l_quantity") / F.sum("l_extendedprice")).alias("micro")
    )


@SUITE.query("r28_beats", "SELECT l_orderkey, l_linenumber, (l_discount < l_tax - 0.01 OR l_quantity < 25 - 0.01) AND NOT (l_discount > l_tax + 0.01 OR l_quantity > 25 + 0.01) AS wins FROM lineitem")
def _(t):
    mine, theirs = {"a": F.col("l_discount"), "b": F.col("l_quantity")}, {"a": F.col("l_tax"), "b": F.lit(25.0)}
    return t.lineitem.select("l_orderkey", "l_linenumber", rp.beats(mine, theirs, 0.01).alias("wins"))


@SUITE.query(
    "r27_x21_coordinate_descent",
    None,
)
def _(t):
    rows = t.lineitem.select("l_quantity", "l_discount")

    def evaluate(settings):
        """One aggregation for a whole sweep."""
        sums = rows.agg(*[F.avg(F.abs(F.col("l_quantity") - s["a"]) + 100 * F.abs(F.col("l_discount") - s["b"])).alias(f"m{i}") for i, s in enumerate(settings)]).first()
        return list(sums)

    best, score = rp.coordinate_descent({"a": 10.0, "b": 0.0}, {"a": [15.0, 20.0, 25.0, 30.0], "b": [0.02, 0.04, 0.06]}, evaluate)
    return t.spark.createDataFrame([(best["a"], best["b"], score)], "a double, b double, score double")


@SUITE.query(
    "r29_x19_x20_route_replay",
    """WITH g AS (SELECT m, p FROM (SELECT unnest([0.3, 0.6])::DOUBLE AS m), (SELECT unnest([0.2, 0.5])::DOUBLE AS p)),
          c AS (SELECT m, p, sum(CASE WHEN l_discount * 10 < m AND l_tax * 10 >= p THEN l_linenumber ELSE l_quantity / 10 END) AS errors, count(*) FILTER (WHERE l_discount * 10 < m AND l_tax * 10 >= p) AS relabels FROM lineitem, g GROUP BY ALL)
       SELECT m, p, round(errors, 6) AS errors, relabels FROM c ORDER BY round(errors, 6), relabels LIMIT 1""",
)
def _(t):
    points = rp.grid(t.spark, {"m": [0.3, 0.6], "p": [0.2, 0.5]})
    changed = (F.col("l_discount") * 10 < F.col("m")) & (F.col("l_tax") * 10 >= F.col("p"))
    rows = t.lineitem.select("l_discount", "l_tax", "l_linenumber", "l_quantity").join(F.broadcast(points))  # four grid points
    scored = rows.groupBy("m", "p").agg(F.round(F.sum(F.when(changed, F.col("l_linenumber")).otherwise(F.col("l_quantity") / 10)), 6).alias("errors"), F.count_if(changed).alias("relabels"))
    return scored.orderBy("errors", "relabels").limit(1)


@SUITE.query(
    "r30_r31_ratios_and_extremes",
    """SELECT p_brand, min(p_retailprice / p_size) AS lo, median(p_retailprice / p_size) AS mid, max(p_retailprice / p_size) AS hi, arg_max(p_partkey, (p_retailprice / p_size, -p_partkey)) AS at FROM part GROUP BY 1""",
)
def _(t):
    r = F.col("p_retailprice") / F.col("p_size")
    return t.part.groupBy("p_brand").agg(F.min(r).alias("lo"), F.median(r).alias("mid"), F.max(r).alias("hi"), F.max_by("p_partkey", F.struct(r, -F.col("p_partkey"))).alias("at"))


@SUITE.query(
    "r32_r33_bless_plan",
    """SELECT key, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'error' WHEN old <> new THEN 'changed' ELSE 'unchanged' END AS state FROM (SELECT doc_id AS key, md5(text) AS old FROM documents WHERE doc_id % 7 <> 0)
         FULL JOIN (SELECT doc_id AS key, md5(CASE WHEN doc_id % 5 = 0 THEN lower(text) ELSE text END) AS new FROM documents WHERE doc_id % 11 <> 0) USING (key)""",
)
def _(t):
    old = t.documents.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("key"), F.md5("text").alias("old"))
    new = t.documents.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "error").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return old.join(new, "key", "full").select("key", state.alias("state"))


@SUITE.query("r37_external_engine", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l USING (doc_id)".replace("l.doc_id IS NOT NULL", "l.toxic IS NOT NULL"))
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("toxic").isNotNull().alias("present"))


@SUITE.query("r08_foreign_keys", "SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(t):
    return t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("orphans"))


@SUITE.query("x34_keyed_queue", "SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 0) a JOIN (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1) b USING (h, k)")
def _(t):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    side = lambda r, name: t.documents.filter(F.col("doc_id") % 2 == r).select("doc_id", F.md5("text").alias("h")).withColumn("k", k).withColumnRenamed("doc_id", name)
    return side(0, "doc_id").join(side(1, "other"), ["h", "k"]).select("doc_id", "other")


@SUITE.query("x35_escaped_dump", "SELECT doc_id, md5(replace(text, chr(10), '\\n')) AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.replace("text", F.lit("\n"), F.lit("\\n"))).alias("line"))


@SUITE.query("x15_x16_rounding", "SELECT event_id, sign(event_id - 500) * ((abs(event_id - 500) + 3) // 7) AS q, round(power(value + 1, 1.0 / 3), 9) AS root FROM events")
def _(t):
    from quillspark.operators.raster import round_div

    return t.events.select("event_id", round_div(F.col("event_id") - 500, F.lit(7)).alias("q"), F.round(F.pow(F.col("value") + 1, F.lit(1 / 3)), 9).alias("root"))
