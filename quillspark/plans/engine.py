"""The public engine over stored tables: settings, recognition of rasters, nested and flat output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import features
from quillspark.operators.engine import Engine
from quillspark.operators.pages import typeset
from quillspark.plans.base import Suite

SUITE = Suite()


def engine(t) -> Engine:
    bank = t.embeddings.select(F.col("vec_id").alias("proto_id"), F.col("label").cast("string").alias("class"), F.col("embedding").alias("vec"), F.col("vec_id").alias("self"))
    return Engine(bank, exclude="self")


def glyphs(t):
    return t.embeddings.filter("vec_id % 20 = 0").select(
        F.floor(F.col("vec_id") / 400).alias("page"), F.floor(F.col("vec_id") / 200).alias("line"), F.floor(F.col("vec_id") / 100).alias("word"), F.col("vec_id").alias("q"), F.col("embedding").alias("vec"), F.col("vec_id").alias("self")
    )


_READ = """WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS p, label AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     d AS (SELECT q, CAST(c AS VARCHAR) AS c, CAST(min(sqrt(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS FLOAT) AS d FROM q, b WHERE q <> p GROUP BY ALL),
     r AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS k FROM d) WHERE k = 1),
     w AS (SELECT q // 400 AS page, q // 200 AS line, q // 100 AS word, string_agg(c, '' ORDER BY q) AS text FROM r GROUP BY ALL)"""


@SUITE.query("a01_a02_recognize", f"{_READ} SELECT page, line, word, text FROM w")
def _(t):
    return engine(t).recognize(glyphs(t)).select("page", "line", "word", "text")


@SUITE.query("a03_x02_recognize_lines", f"{_READ} SELECT page, line, count(*) AS words, string_agg(text, ' ' ORDER BY word) AS text FROM w GROUP BY ALL")
def _(t):
    lines = engine(t).recognize_lines(glyphs(t))
    return lines.select("page", "line", F.size("words").cast("long").alias("words"), F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))


@SUITE.query(
    "a05_a08_probe",
    """WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT vec_id AS p, CAST(label AS VARCHAR) AS class, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
          d AS (SELECT q, class, CAST(min(sqrt(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS FLOAT) AS d FROM q, b WHERE q <> p GROUP BY ALL),
          r AS (SELECT *, row_number() OVER w AS rank, nth_value(d, 1) OVER e AS d1, nth_value(d, 2) OVER e AS d2 FROM d WINDOW w AS (PARTITION BY q ORDER BY d, class), e AS (PARTITION BY q ORDER BY d, class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
          k(x0, y0, x1, y1) AS (VALUES (0.0, 0.999, 0.5, 0.99), (0.5, 0.99, 0.7, 0.95), (0.7, 0.95, 0.85, 0.8), (0.85, 0.8, 0.95, 0.6), (0.95, 0.6, 1.0, 0.5)),
          x AS (SELECT *, CASE WHEN d2 IS NULL THEN 0.0 WHEN d2 = 0 THEN 1.0 ELSE CAST(d1 AS DOUBLE) / CAST(d2 AS DOUBLE) END AS ratio FROM r WHERE rank <= 2)
       SELECT q, class, rank, CAST(d AS DOUBLE) AS d, coalesce((SELECT CAST(y0 AS DOUBLE) + CAST(y1 - y0 AS DOUBLE) * (ratio - x0) / CAST(x1 - x0 AS DOUBLE) FROM k WHERE ratio >= x0 AND ratio < x1), 0.5) AS conf, 'no network tables in the model' AS fallback FROM x""",
)
def _(t):
    e = engine(t)
    e.set_param("match.top_k", 2)
    e.set_feature_weights([1.0] * 64)
    return e.probe(glyphs(t)).withColumn("rank", F.col("rank").cast("long")).withColumn("fallback", F.lit(e.classifier_fallback()))


@SUITE.query(
    "x27_oracle_read",
    f"{_READ} SELECT e.vec_id AS q, CASE WHEN vec_id % 40 = 20 THEN coalesce(r.c, '?') ELSE CAST(label AS VARCHAR) END AS text, vec_id % 40 = 20 AND r.c <> CAST(label AS VARCHAR) AS wrong FROM embeddings e LEFT JOIN r ON r.q = vec_id WHERE vec_id % 20 = 0",
)
def _(t):
    truth = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("label").cast("string").alias("ch"), (F.col("vec_id") % 40 == 20).alias("boxed"))
    read = engine(t).probe(glyphs(t)).filter("rank = 1").select("q", "class")
    text = F.when(F.col("boxed"), F.coalesce("class", F.lit("?"))).otherwise(F.col("ch"))
    return truth.join(read, "q", "left").select("q", text.alias("text"), (F.col("boxed") & (F.col("class") != F.col("ch"))).alias("wrong"))


def face():
    """A made-up face: characters of 12 x 12, a frame around 8 x 8 bits that differ from one to the other."""
    import numpy as np

    glyphs = {}
    for k, ch in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"):
        ink = np.ones((12, 12), np.uint8)
        ink[2:10, 2:10] = np.random.default_rng(k).random((4, 4)).repeat(2, 0).repeat(2, 1) < 0.5
        glyphs[ch] = ink
    return glyphs


def face_bank(t):
    rows = [(k, ch, [int(v) for v in ink.ravel()], 12.0) for k, (ch, ink) in enumerate(face().items())]
    glyphs = t.spark.createDataFrame(rows, "proto_id int, class string, ink array<int>, size double")
    return glyphs.select("proto_id", "class", features.extract(glyphs, "ink", F.col("size"), "size", "size").alias("vec"))


@SUITE.query(
    "a04_x01_x12_p31_recognize_bytes",
    """WITH l AS (SELECT n_regionkey AS page, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line, [n_name, reverse(n_name)] AS w FROM nation)
       SELECT page, CAST(line AS INT) AS line, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS word, unnest(w) AS text FROM l""",
)
def _(t):
    """Names, forward and backward, set as pages of pixels, and read back from the bytes."""
    lines = t.nation.select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("line"), F.concat_ws(" ", "n_name", F.reverse("n_name")).alias("text"))
    pages = typeset(lines, face())
    return Engine(face_bank(t)).recognize_bytes(pages).select("page", "line", F.col("word").cast("long").alias("word"), "text")
