"""Vector-math and network queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import neural as nn
from quillspark.plans.base import Suite

SUITE = Suite()

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_LS = "list_transform({v}, lambda x: x - list_max({v}) - ln(list_sum(list_transform({v}, lambda y: exp(y - list_max({v}))))))"


@SUITE.query("n05_log_softmax", f"WITH {_E}, s AS (SELECT vec_id, {_LS.format(v='v')} AS s FROM e) SELECT vec_id, round(s[1], 9) AS first, round(list_sum(list_transform(s, lambda x: exp(x))), 9) AS total FROM s")
def _(t):
    s = t.embeddings.select("vec_id", nn.log_softmax(F.col("embedding")).alias("s"))
    return s.select("vec_id", F.round(F.get("s", F.lit(0)), 9).alias("first"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x)), 9).alias("total"))


@SUITE.query("n04_n11_dense", f"WITH {_E} SELECT vec_id, round(0.5 + list_sum(list_transform(range(1, 65), lambda i: v[i] * (i % 5 - 2) * 0.5)), 9) AS a, round(-1.0 + list_sum(list_transform(range(1, 65), lambda i: v[i] * (i % 3 - 1))), 9) AS b FROM e")
def _(t):
    w = [[(i % 5 - 2) * 0.5 for i in range(1, 65)], [float(i % 3 - 1) for i in range(1, 65)]]
    out = t.embeddings.select("vec_id", nn.dense(F.col("embedding").cast("array<double>"), w, [0.5, -1.0]).alias("y"))
    return out.select("vec_id", F.round(F.get("y", F.lit(0)), 9).alias("a"), F.round(F.get("y", F.lit(1)), 9).alias("b"))


@SUITE.query(
    "n13_rmsnorm_silu_rope",
    f"""WITH {_E} SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64 + 1e-6), 9) AS norm, round(v[2] / (1 + exp(-v[2])), 9) AS act,
          round(v[3] * cos((vec_id % 100) / power(10000.0, 2 / 32.0)) - v[35] * sin((vec_id % 100) / power(10000.0, 2 / 32.0)), 9) AS turned FROM e""",
)
def _(t):
    v = F.col("embedding")
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 9)
    return t.embeddings.select("vec_id", at(nn.rmsnorm(v), 0).alias("norm"), at(nn.silu(v), 1).alias("act"), at(nn.rope(v, F.col("vec_id") % 100), 2).alias("turned"))


@SUITE.query(
    "n14_kl",
    f"""WITH {_E}, p AS (SELECT a.vec_id, {_LS.format(v='a.v')} AS p, {_LS.format(v='b.v')} AS q FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: exp(p[i]) * (p[i] - q[i]))), 9) AS kl FROM p""",
)
def _(t):
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(nn.kl(F.col("embedding"), F.col("o")), 9).alias("kl"))


@SUITE.query("n06_concat", "SELECT vec_id, len(list_concat(embedding, embedding[1:4])) AS n FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size(F.concat("embedding", F.slice("embedding", 1, 4))).cast("long").alias("n"))


@SUITE.query("n01_n03_forward")
def _(t):
    net = nn.Convolutional(8, 4, 10)
    rows = t.embeddings.select("vec_id", "embedding", F.slice("embedding", 1, 4).alias("extra"))
    out = rows.select("vec_id", nn.classify(rows, net, "embedding", "extra", 8).alias("logp"))
    return out.select("vec_id", F.array_position("logp", F.array_max("logp")).alias("class"), F.array_max("logp").alias("best"))
