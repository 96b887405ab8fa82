"""Confidence queries over orders, line items, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import confidence as cf
from quillspark.plans.base import Suite

SUITE = Suite()


@SUITE.query(
    "c01_c03_calibration",
    """SELECT event_id, conf, least(greatest(conf * (0.6 + 0.4 * CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 1.0 END), 0.0), 1.0) AS adjusted, ratio FROM (
         SELECT event_id, user_id, CASE WHEN m IS NULL OR m < 0 THEN 1.0 ELSE 1 / (1 + m) END AS ratio,
           CASE WHEN r IS NULL THEN 0.5 WHEN r <= 0 THEN 0.999 WHEN r < 0.5 THEN 0.999 + (0.99 - 0.999) * (r - 0.0) / (0.5 - 0.0) WHEN r < 0.7 THEN 0.99 + (0.95 - 0.99) * (r - 0.5) / (0.7 - 0.5)
                WHEN r < 0.85 THEN 0.95 + (0.8 - 0.95) * (r - 0.7) / (0.85 - 0.7) WHEN r < 0.95 THEN 0.8 + (0.6 - 0.8) * (r - 0.85) / (0.95 - 0.85) WHEN r < 1 THEN 0.6 + (0.5 - 0.6) * (r - 0.95) / (1 - 0.95) ELSE 0.5 END AS conf
         FROM (SELECT event_id, user_id, value / 100 AS r, value - 20 AS m FROM events))""",
)
def _(t):
    e = t.events.select("event_id", "user_id", (F.col("value") / 100).alias("r"), (F.col("value") - 20).alias("m"))
    conf = cf.character(F.col("r"))
    return e.select("event_id", conf.alias("conf"), cf.adjust(conf, F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(1.0)).alias("adjusted"), cf.ratio_from_margin(F.col("m")).alias("ratio"))


@SUITE.query(
    "c04_c06_geometric_means",
    "SELECT l_orderkey, exp(avg(ln(greatest(l_discount, 1e-4)))) AS word, exp(sum(l_quantity * ln(greatest(l_discount, 1e-4))) / sum(l_quantity)) AS line FROM lineitem GROUP BY l_orderkey",
)
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(cf.geometric_mean(F.col("l_discount")).alias("word"), cf.geometric_mean(F.col("l_discount"), F.col("l_quantity")).alias("line"))


@SUITE.query("c07_reliability", "SELECT CAST(least(floor(l_discount * 10 * 9), 9) AS INT) AS decile, count(*) AS n, avg(CAST(l_returnflag = 'N' AS DOUBLE)) AS accuracy FROM lineitem GROUP BY 1")
def _(t):
    return cf.reliability(t.lineitem.select((F.col("l_discount") * 9).alias("s"), (F.col("l_returnflag") == "N").alias("ok")), "s", "ok")


@SUITE.query("c08_class_medians", "SELECT l_suppkey, median(l_extendedprice) AS median, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600")
def _(t):
    return cf.class_medians(t.lineitem, "l_suppkey", "l_extendedprice", 600)


@SUITE.query(
    "c09_below_median_share",
    """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS med FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600)
       SELECT avg(CASE WHEN med IS NOT NULL THEN CAST(l_extendedprice < med AS DOUBLE) END) AS share, count(*) FILTER (WHERE med IS NULL) AS excluded FROM lineitem LEFT JOIN m USING (l_suppkey)""",
)
def _(t):
    return cf.below_median_share(t.lineitem, cf.class_medians(t.lineitem, "l_suppkey", "l_extendedprice", 600), "l_suppkey", "l_extendedprice")


def _labelled(t):
    return t.documents.join(t.labels, "doc_id").filter("quality is not null").select("doc_id", F.length("text").cast("double").alias("v"), (F.col("quality") == 0).alias("bad"))


_LAB = "(SELECT doc_id, CAST(length(text) AS DOUBLE) AS v, quality = 0 AS bad FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


@SUITE.query(
    "c10_threshold_sweep",
    f"""SELECT threshold, count(*) FILTER (WHERE bad AND v < threshold) / count(*) FILTER (WHERE bad) AS recall, count(*) FILTER (WHERE NOT bad AND v < threshold) / count(*) FILTER (WHERE NOT bad) AS false_flag
        FROM {_LAB}, (SELECT CAST(unnest([200, 500, 1000, 2000, 4000]) AS DOUBLE) AS threshold) GROUP BY threshold""",
)
def _(t):
    return cf.sweep(_labelled(t), "v", "bad", [200, 500, 1000, 2000, 4000])


@SUITE.query(
    "c11_youden",
    f"""WITH c AS (SELECT v, count(*) FILTER (WHERE bad) AS p, count(*) FILTER (WHERE NOT bad) AS q FROM {_LAB} GROUP BY v),
          g AS (SELECT v, round(sum(p) OVER (ORDER BY v) / (SELECT sum(p) FROM c) - sum(q) OVER (ORDER BY v) / (SELECT sum(q) FROM c), 12) AS j FROM c)
        SELECT v AS threshold, j FROM g ORDER BY j DESC, v LIMIT 1""",
)
def _(t):
    return cf.youden(_labelled(t), "v", "bad")


@SUITE.query(
    "c12_describe",
    """WITH s AS (SELECT o_orderpriority AS g, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
       SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean, median(o_totalprice) AS median, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS largest,
              any_value(v[len(v) // 4 + 1]) AS q1, any_value(v[3 * len(v) // 4 + 1]) AS q3 FROM orders JOIN s ON g = o_orderpriority GROUP BY o_orderpriority""",
)
def _(t):
    return cf.describe(t.orders, "o_orderpriority", "o_totalprice")


@SUITE.query(
    "c13_confidence_split",
    "SELECT l_linestatus, count(*) FILTER (WHERE l_discount >= 0.05) AS at_least, median(l_discount) FILTER (WHERE l_returnflag = 'R') AS median_r, median(l_discount) FILTER (WHERE l_returnflag <> 'R') AS median_other FROM lineitem GROUP BY 1",
)
def _(t):
    d, r = F.col("l_discount"), F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_linestatus").agg(F.count_if(d >= 0.05).alias("at_least"), F.median(F.when(r, d)).alias("median_r"), F.median(F.when(~r, d)).alias("median_other"))
