"""Scores of a reading against a reference; pairs are a conversation's turns and the next ones.

Characters outside ASCII become question marks, as in a print set of that size.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import is_identifier
from quillspark.operators import scoring
from quillspark.plans.base import Suite

SUITE = Suite()
KEY = ["conv_id", "turn"]


def pairs(t):
    """A turn and the turn after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    plain = lambda c: F.regexp_replace(c, "[^ -~\n]", "?")
    return t.conversations.withColumn("other", after).filter("other is not null and text is not null").select(*KEY, "role", plain("text").alias("ref"), plain("other").alias("got"))


_P = r"""(SELECT conv_id, turn, role, regexp_replace(text, '[^ -~\n]', '?', 'g') AS ref, regexp_replace(other, '[^ -~\n]', '?', 'g') AS got
          FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations) WHERE other IS NOT NULL AND text IS NOT NULL)"""
_TOKS = r"list_filter(regexp_split_to_array({c}, '[ \t\r\n\f\v]+'), lambda s: s <> '')"
_COUNTS = f"(SELECT conv_id, turn, role, levenshtein(ref, got) AS char_errors, length(ref) AS chars, len({_TOKS.format(c='ref')}) AS words FROM {_P})"


@SUITE.query("t04_t06_edit_counts", f"SELECT conv_id, turn, char_errors, chars, words, char_errors / nullif(chars, 0) AS cer FROM {_COUNTS}")
def _(t):
    counts = scoring.edit_counts(pairs(t), "ref", "got")
    return counts.select(*KEY, "char_errors", "chars", "words", scoring.rate(F.col("char_errors"), F.col("chars")).alias("cer"))


@SUITE.query("t05_word_errors")
def _(t):
    """Token-level distances; DuckDB's distance is over bytes and can't take coded tokens."""
    counts = scoring.edit_counts(pairs(t), "ref", "got")
    return counts.select(*KEY, "word_errors", "words", scoring.rate(F.col("word_errors"), F.col("words")).alias("wer"))


@SUITE.query(
    "t07_t08_pooled",
    f"SELECT role, count(*) AS pages, sum(char_errors) / nullif(sum(chars), 0) AS micro_cer, avg(char_errors / nullif(chars, 0)) AS macro_cer FROM {_COUNTS} GROUP BY role",
)
def _(t):
    return scoring.pooled(scoring.edit_counts(pairs(t), "ref", "got"), "role").select("role", "pages", "micro_cer", "macro_cer")


_HITS = f"""WITH p AS (SELECT conv_id, turn, {_TOKS.format(c="ref")} AS r, {_TOKS.format(c="got")} AS g FROM {_P}),
     a AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS tok FROM p) GROUP BY ALL),
     b AS (SELECT conv_id, turn, tok, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS tok FROM p) GROUP BY ALL),
     h AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS hits FROM a JOIN b USING (conv_id, turn, tok) GROUP BY ALL),
     s AS (SELECT conv_id, turn, CAST(coalesce(hits, 0) AS BIGINT) AS hits, len(r) AS expected, len(g) AS found FROM p LEFT JOIN h USING (conv_id, turn))"""


@SUITE.query(
    "t09_t10_token_score",
    f"""{_HITS} SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision + recall = 0 THEN 0.0 END AS f1
        FROM (SELECT *, hits / nullif(expected, 0) AS recall, hits / nullif(found, 0) AS precision FROM s)""",
)
def _(t):
    return scoring.token_rates(scoring.token_hits(pairs(t), KEY, "ref", "got"))



@SUITE.query("t11_t12_substitutions")
def _(t):
    return scoring.substitution_counts(pairs(t), "ref", "got")


@SUITE.query("t13_t14_line_matched")
def _(t):
    return scoring.line_pairs(pairs(t), KEY, "ref", "got")


@SUITE.query("t15_t16_t19_word_outcomes")
def _(t):
    aligned = scoring.aligned_words(pairs(t), KEY, "ref", "got")
    known = t.benchmark.select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("want")).filter("want <> ''").distinct().withColumn("known", F.lit(True))
    outcome = scoring.classify_word(F.col("want"), F.col("got"), is_identifier(F.col("want")), F.coalesce("known", F.lit(False)))
    return aligned.join(known, "want", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("want").alias("forms"))


@SUITE.query(
    "t18_lexicon_membership",
    r"""SELECT conv_id, turn, count(*) AS toks, count(*) FILTER (WHERE tok IN (SELECT unnest(regexp_split_to_array(text, '[^a-zA-Z]+')) FROM benchmark)) AS known
        FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[^a-zA-Z]+'), lambda s: s <> '')) AS tok FROM conversations) GROUP BY ALL""",
)
def _(t):
    lexicon = t.benchmark.select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("tok")).distinct().withColumn("hit", F.lit(1))
    toks = t.conversations.select(*KEY, F.explode(F.split("text", "[^a-zA-Z]+")).alias("tok")).filter("tok <> ''")
    return toks.join(lexicon, "tok", "left").groupBy(*KEY).agg(F.count("*").alias("toks"), F.count("hit").alias("known"))
