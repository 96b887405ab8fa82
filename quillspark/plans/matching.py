"""Matching queries over ``embeddings``.

A search takes the rows with ``vec_id % 20 = 0`` as queries, against all rows but the query itself. Held-out
evaluation takes ``vec_id % 5 = 0`` against the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import matching as mt
from quillspark.plans.base import Suite

SUITE = Suite()

_VEC = "CAST(embedding AS DOUBLE[]) AS vec"
_Q = f"q AS (SELECT vec_id AS q, label AS truth, {_VEC}, CAST(vec_id % 3 AS INT) AS hole FROM embeddings WHERE vec_id % 20 = 0)"
_B = f"b AS (SELECT vec_id AS proto_id, label AS class, {_VEC}, CAST(vec_id % 7 + 1 AS INT) AS holes, CAST(vec_id % 4 AS INT) AS face FROM embeddings)"
_APART = "sqrt(list_sum(list_transform(list_zip(q.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_D = f"""{_Q}, {_B}, d AS (SELECT q, class, min(d) AS d FROM (SELECT q, class, CAST({_APART} AS FLOAT) AS d FROM q, b WHERE q <> proto_id) GROUP BY ALL)"""
_HQ, _HB = _Q.replace("vec_id % 20 = 0", "vec_id % 5 = 0"), _B.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 5 <> 0")
_HD = f"""{_HQ}, {_HB}, d AS (SELECT q, class, min(d) AS d FROM (SELECT q, class, CAST({_APART} AS FLOAT) AS d FROM q, b) GROUP BY ALL)"""


def queries(t, held_out=False):
    return t.embeddings.filter("vec_id % 5 = 0" if held_out else "vec_id % 20 = 0").select(
        F.col("vec_id").alias("q"), F.col("label").alias("truth"), F.col("embedding").alias("vec"), (F.col("vec_id") % 3).cast("int").alias("hole"), F.col("vec_id").alias("self")
    )


def bank(t, held_out=False):
    return (t.embeddings.filter("vec_id % 5 <> 0") if held_out else t.embeddings).select(
        F.col("vec_id").alias("proto_id"), F.col("label").alias("class"), F.col("embedding").alias("vec"), (F.col("vec_id") % 7 + 1).cast("int").alias("holes"), (F.col("vec_id") % 4).cast("int").alias("face"), F.col("vec_id").alias("self")
    )


def rounded(c):
    return F.round(c, 4)


@SUITE.query(
    "m01_m04_nearest",
    f"""WITH {_D}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, class) AS rank, min(d) OVER (PARTITION BY q) AS d1 FROM d), s AS (SELECT q, d AS d2 FROM r WHERE rank = 2)
        SELECT q, class, rank, round(CAST(d AS DOUBLE), 4) AS d, round(CAST(d1 / d2 AS DOUBLE), 4) AS ratio FROM r JOIN s USING (q) WHERE rank <= 3""",
)
def _(t):
    top = mt.top_classes(mt.class_distances(queries(t), bank(t), exclude="self"), 3)
    return top.select("q", "class", F.col("rank").cast("long").alias("rank"), rounded("d").alias("d"), rounded(mt.ratio(F.col("d1"), F.col("d2"))).alias("ratio"))


@SUITE.query(
    "m02_m05_m10_hole_gate",
    f"""WITH {_Q}, {_B}, d AS (SELECT q, class, min(d) AS d FROM (SELECT q, class, (holes >> hole) & 1 = 1 AS ok, sqrt(list_sum(list_transform(list_zip(q.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM q, b WHERE q <> proto_id) WHERE ok GROUP BY ALL)
        SELECT q, round(min(d), 4) AS d1, count(*) AS classes FROM d GROUP BY q""",
)
def _(t):
    d = mt.class_distances(queries(t), bank(t), gate=True, exclude="self")
    return d.groupBy("q").agg(rounded(F.min("d")).alias("d1"), F.count("*").alias("classes"))


@SUITE.query(
    "m07_class_gates",
    "SELECT label AS class, min(embedding[1]) AS lo, max(embedding[1]) AS hi, bit_or(1 << CAST(vec_id % 3 AS INT)) AS holes FROM embeddings GROUP BY label",
)
def _(t):
    return mt.class_gates(_measured(t).withColumnRenamed("q", "id"))


def _measured(t):
    return t.embeddings.select(F.col("vec_id").alias("q"), F.col("label").alias("class"), F.get("embedding", F.lit(0)).alias("aspect"), (F.col("vec_id") % 3).cast("int").alias("hole"))


@SUITE.query(
    "m08_admits",
    """WITH g AS (SELECT label AS class, min(embedding[1]) AS lo, max(embedding[1]) AS hi FROM embeddings GROUP BY label)
       SELECT vec_id AS q, count(*) AS classes FROM embeddings, g WHERE vec_id % 20 = 0 AND embedding[1] BETWEEN lo AND hi GROUP BY vec_id""",
)
def _(t):
    gates = mt.class_gates(_measured(t))
    return mt.admitted(_measured(t).filter("q % 20 = 0").drop("class"), gates, 0.0).groupBy("q").agg(F.count("*").alias("classes"))


@SUITE.query(
    "m19_held_out_confusion",
    f"WITH {_HD}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, class) AS k FROM d) SELECT truth, class, count(*) AS n FROM r JOIN q USING (q) WHERE k = 1 GROUP BY ALL",
)
def _(t):
    best = mt.top_classes(mt.class_distances(queries(t, True), bank(t, True)), 1)
    return mt.confusion(best.join(queries(t, True).select("q", "truth"), "q"), "truth", "class")


_FACE = f"""{_Q}, {_B}, f AS (SELECT q, face, min((d, class)) AS m FROM (SELECT q, face, class, CAST(sqrt(list_sum(list_transform(list_zip(q.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS FLOAT) AS d FROM q, b WHERE q <> proto_id) GROUP BY ALL)"""


def face_best(t):
    """Best class per query and face by squared distance, over one search of (face, class) pairs."""
    paired = bank(t).withColumn("class", F.col("face") * 1000 + F.col("class"))
    d = mt.class_distances(queries(t), paired, exclude="self").withColumns({"face": F.floor(F.col("class") / 1000).cast("int"), "class": F.col("class") % 1000})
    return d.groupBy("q", "face").agg(F.min(F.struct("d", "class")).alias("m")).select("q", "face", "m.d", "m.class")


@SUITE.query("m09_m11_m12_per_face", f"WITH {_FACE} SELECT q, face, round(CAST(m[1] AS DOUBLE), 4) AS d, m[2] AS class FROM f")
def _(t):
    return face_best(t).select("q", "face", rounded("d").alias("d"), "class")


@SUITE.query(
    "m13_m14_style_labels",
    f"""WITH {_FACE}, g AS (SELECT q // 50 AS field, q, face, CAST(m[1] AS DOUBLE) AS d, m[2] AS class FROM f), s AS (SELECT field, face, sum(d) AS total FROM g GROUP BY ALL),
          k AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY total, face) AS k FROM s) SELECT field, q AS glyph, face, class FROM g JOIN k USING (field, face) WHERE k = 1""",
)
def _(t):
    return mt.style_labels(face_best(t).select(F.floor(F.col("q") / 50).alias("field"), F.col("q").alias("glyph"), "face", "class", "d"))


@SUITE.query(
    "m20_leave_one_face_out",
    f"""WITH {_HQ}, {_HB}, d AS (SELECT q, gone, class, truth, min(CAST(sqrt(list_sum(list_transform(list_zip(q.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS FLOAT)) AS d
            FROM q, b, (SELECT unnest(range(4)) AS gone) WHERE face <> gone GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q, gone ORDER BY d, class) AS k FROM d)
        SELECT CAST(gone AS INT) AS gone, avg(CAST(class = truth AS DOUBLE)) AS accuracy, count(*) AS n FROM r WHERE k = 1 GROUP BY gone""",
)
def _(t):
    runs = None
    for gone in range(4):  # one pass per face of the model, a fixed few
        best = mt.top_classes(mt.class_distances(queries(t, True), bank(t, True).filter(F.col("face") != gone)), 1)
        part = best.join(queries(t, True).select("q", "truth"), "q").agg(F.lit(gone).alias("gone"), F.avg((F.col("class") == F.col("truth")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
        runs = part if runs is None else runs.union(part)
    return runs


_SC = "s AS (SELECT dim, max(abs(e)) / 127 AS scale FROM (SELECT generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) GROUP BY dim)"


@SUITE.query(
    "m15_m16_quantise",
    f"WITH {_SC} SELECT vec_id, CAST(dim AS INT) AS dim, CAST(round(e / scale) AS INT) AS code, CAST(round(e / scale) AS INT) * scale AS back FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings) JOIN s USING (dim)",
)
def _(t):
    return _quantised(t).select("vec_id", F.posexplode(F.arrays_zip("code", "back")).alias("dim", "x")).select("vec_id", "dim", F.col("x.code").cast("int").alias("code"), F.col("x.back").alias("back"))


def _quantised(t):
    scales = mt.quantise(t.embeddings, "embedding").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "scale"))), lambda s: s["scale"]).alias("scales"))
    coded = t.embeddings.join(F.broadcast(scales)).withColumn("code", mt.codes(F.col("embedding"), F.col("scales")))
    return coded.withColumn("back", mt.dequantised(F.col("code"), F.col("scales")))


@SUITE.query("m17_row_scale", "SELECT vec_id, list_max(list_transform(embedding, lambda e: abs(CAST(e AS DOUBLE)))) / 127 AS scale FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", mt.row_scale(F.col("embedding")).alias("scale"))


@SUITE.query("m18_quantised_agreement")
def _(t):
    back = _quantised(t).filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("proto_id"), F.col("label").alias("class"), F.col("back").alias("vec"))
    a = mt.top_classes(mt.class_distances(queries(t, True), bank(t, True)), 1).select("q", "class")
    b = mt.top_classes(mt.class_distances(queries(t, True), back), 1).select("q", F.col("class").alias("other"))
    return a.join(b, "q").agg(F.count("*").alias("n"), F.avg((F.col("class") == F.col("other")).cast("double")).alias("agreement"))


@SUITE.query(
    "m21_category_veto",
    """WITH c AS (SELECT l_orderkey AS word, l_linenumber AS pos, l_returnflag AS category, CASE WHEN l_linenumber = 1 THEN 'X' ELSE l_returnflag END AS other FROM lineitem)
       SELECT word, pos, category <> other AND count(*) OVER (PARTITION BY word, category) = count(*) OVER (PARTITION BY word) AS vetoed FROM c""",
)
def _(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("word"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("category"), F.when(F.col("l_linenumber") == 1, "X").otherwise(F.col("l_returnflag")).alias("other"))
    return mt.category_veto(c).select("word", "pos", "vetoed")


@SUITE.query(
    "m22_x31_network_candidates",
    """WITH l AS (SELECT vec_id AS q, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS class, CAST(unnest(embedding) AS DOUBLE) AS logp FROM embeddings),
          r AS (SELECT *, row_number() OVER w AS rank, lead(logp) OVER w AS nxt FROM l WHERE class <> 0 WINDOW w AS (PARTITION BY q ORDER BY logp DESC, class))
       SELECT q, class, rank, -logp AS d, max(CASE WHEN rank = 1 THEN logp - nxt END) OVER (PARTITION BY q) AS margin FROM r QUALIFY rank <= 3""",
)
def _(t):
    logits = t.embeddings.select(F.col("vec_id").alias("q"), F.posexplode(F.col("embedding").cast("array<double>")).alias("class", "logp"))
    return mt.network_candidates(logits, 0).withColumn("rank", F.col("rank").cast("long"))


@SUITE.query("m23_route", "SELECT event_id, value / 100 < 0.7 AND user_id % 10 / 10 >= 0.7 AND event_type <> 'click' AS relabel FROM events")
def _(t):
    return t.events.select("event_id", mt.route(F.col("value") / 100, F.col("user_id") % 10 / 10, F.col("event_type") == "click").alias("relabel"))


@SUITE.query("m06_x17_uncovered", "SELECT DISTINCT label AS class FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id % 100 = 1)")
def _(t):
    return t.embeddings.select(F.col("label").alias("class")).distinct().join(t.embeddings.filter("vec_id % 100 = 1").select(F.col("label").alias("class")).distinct(), "class", "left_anti")


@SUITE.query(
    "r35_r36_restricted_accuracy",
    f"""WITH {_HQ}, {_HB}, d AS (SELECT q, truth, w, class, min(CAST(sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.vec[i] - b.vec[i]) * (q.vec[i] - b.vec[i]) * CASE WHEN i <= 32 THEN w ELSE 1.0 END))) AS FLOAT)) AS d
            FROM q, b, (SELECT unnest([0.5, 2.0])::DOUBLE AS w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q, w ORDER BY d, class) AS k FROM d)
        SELECT w, avg(CAST(class = truth AS DOUBLE)) AS accuracy FROM r WHERE k = 1 GROUP BY w""",
)
def _(t):
    out = None
    for w in (0.5, 2.0):
        best = mt.top_classes(mt.class_distances(queries(t, True), bank(t, True), [w] * 32 + [1.0] * 32), 1)
        part = best.join(queries(t, True).select("q", "truth"), "q").agg(F.lit(w).alias("w"), F.avg((F.col("class") == F.col("truth")).cast("double")).alias("accuracy"))
        out = part if out is None else out.union(part)
    return out
