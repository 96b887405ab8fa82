"""Language-table and decoding queries; the benchmark's words are the lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import decoding as dc
from quillspark.plans.base import Suite

SUITE = Suite()

_W = "w AS (SELECT word, count(*) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word)"
_PAIRS = f"""{_W}, p AS (SELECT prev, next, CAST(sum(weight) AS BIGINT) AS n FROM (SELECT weight, unnest(list_concat([''], string_split(word, ''))) AS prev, unnest(list_concat(string_split(word, ''), [''])) AS next FROM w) GROUP BY ALL)"""


def lexicon(t):
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("weight"))


def vowel():
    return F.when(F.col("next") == "", "border").when(F.col("next").isin(*"aeiou"), "vowel").otherwise("consonant")


_CAT = "CASE WHEN next = '' THEN 'border' WHEN next IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' ELSE 'consonant' END"


@SUITE.query("d11_bigram_pairs", f"WITH {_PAIRS} SELECT * FROM p")
def _(t):
    return dc.bigram_pairs(lexicon(t))


@SUITE.query(
    "d10_d13_bigram_scores",
    f"""WITH {_PAIRS}, l AS (SELECT prev, next, greatest(log2(0.85 * n / sum(n) OVER (PARTITION BY prev)), -40) AS logp FROM p),
          c AS (SELECT {_CAT} AS category, log2(sum(n) / (SELECT sum(n) FROM p)) AS cat_logp FROM p GROUP BY 1),
          q AS (SELECT a.prev, b.next, CASE WHEN b.next = '' THEN 'border' WHEN b.next IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' ELSE 'consonant' END AS category FROM (SELECT DISTINCT prev FROM p UNION ALL SELECT '#') a, (SELECT DISTINCT next FROM p) b)
        SELECT q.prev, q.next, coalesce(logp, CASE WHEN q.prev <> '#' THEN log2(1 - 0.85) + cat_logp END, -40.0) AS score FROM q LEFT JOIN l USING (prev, next) LEFT JOIN c USING (category)""",
)
def _(t):
    pairs = dc.bigram_pairs(lexicon(t))
    logp, backoff, cat = dc.bigram_model(pairs, vowel())
    # every pair over a-z and the border
    firsts = pairs.select("prev").distinct().union(t.spark.createDataFrame([("#",)], "prev string"))
    asked = firsts.join(F.broadcast(pairs.select("next").distinct()))
    return dc.score_bigrams(asked, logp, backoff, cat, vowel())


_RULES = "r AS (SELECT DISTINCT CAST(l_partkey % 20 AS INT) AS a, CAST(l_suppkey % 10 + 30 AS INT) AS b, CAST(1 << (l_linenumber % 3) AS INT) AS context, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 20 ELSE l_suppkey % 10 + 30 END AS INT) AS favour, l_linenumber * 0.25 AS adjust FROM lineitem)"
_ADJ = f"{_RULES}, t AS (SELECT class, context, sum(adjust) AS adjust FROM (SELECT favour AS class, context, adjust / 2 AS adjust FROM r UNION ALL SELECT CASE WHEN favour = a THEN b ELSE a END, context, -adjust / 2 FROM r) GROUP BY ALL HAVING sum(adjust) <> 0)"


def rules(t):
    a, b = (F.col("l_partkey") % 20).cast("int"), (F.col("l_suppkey") % 10 + 30).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_linenumber") % 3).cast("int"))
    return t.lineitem.select(a.alias("a"), b.alias("b"), bit.alias("context"), F.when(F.col("l_linenumber") % 2 == 0, a).otherwise(b).alias("favour"), (F.col("l_linenumber") * 0.25).alias("adjust")).distinct()


@SUITE.query("d15_confusion_table", f"WITH {_ADJ} SELECT * FROM t")
def _(t):
    return dc.confusion_adjustments(rules(t))


@SUITE.query("d16_confusion_pairs", f"WITH {_RULES} SELECT count(DISTINCT (a, b)) AS pairs FROM r")
def _(t):
    return rules(t).agg(F.count_distinct("a", "b").alias("pairs"))


@SUITE.query(
    "d14_confusion_adjust",
    f"WITH {_ADJ} SELECT event_id AS id, coalesce(sum(adjust), 0.0) AS adjust FROM events LEFT JOIN t ON class = user_id % 40 AND (context & (event_id % 8)) <> 0 GROUP BY event_id",
)
def _(t):
    asked = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).cast("int").alias("class"), (F.col("event_id") % 8).cast("int").alias("mask"))
    return dc.adjust(asked, dc.confusion_adjustments(rules(t)))


@SUITE.query(
    "d17_d19_lexicon_lookup",
    f"WITH {_W} SELECT tok, weight IS NOT NULL AS known, CASE WHEN weight >= 20 THEN 1 WHEN weight >= 5 THEN 2 WHEN weight IS NOT NULL THEN 3 END AS tier, CASE WHEN weight IS NOT NULL THEN 1.0 ELSE 0.0 END AS agreement FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS tok FROM documents) LEFT JOIN w ON word = lower(tok)",
)
def _(t):
    toks = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("tok")).distinct()
    lex = lexicon(t).select("word", F.when(F.col("weight") >= 20, 1).when(F.col("weight") >= 5, 2).otherwise(3).alias("tier"))
    found = toks.join(lex, F.lower("tok") == F.col("word"), "left")
    return found.select("tok", F.col("tier").isNotNull().alias("known"), "tier", dc.agreement(F.lit(False), F.col("tier")).alias("agreement"))


@SUITE.query(
    "d20_lexicon_expansion",
    f"""WITH {_W}, e AS (SELECT word, CASE WHEN weight >= 5 THEN 1 ELSE 2 END AS tier FROM w WHERE length(word) >= 3),
          f AS (SELECT word, tier FROM e UNION ALL SELECT CASE WHEN word ~ '(s|x|z|ch|sh)$' THEN word || 'es' WHEN word ~ '[^aeiou]y$' THEN left(word, -1) || 'ies' ELSE word || 's' END, tier + 1 FROM e
                UNION ALL SELECT CASE WHEN word ~ 'y$' THEN left(word, -1) || 'ily' WHEN word ~ 'ic$' THEN word || 'ally' WHEN word ~ '[^aeiou]le$' THEN left(word, -1) || 'y' ELSE word || 'ly' END, tier + 1 FROM e)
        SELECT word, min(tier) AS tier FROM f GROUP BY word""",
)
def _(t):
    entries = lexicon(t).filter("length(word) >= 3").select("word", F.when(F.col("weight") >= 5, 1).otherwise(2).alias("tier"))
    return dc.lexicon_tiers(entries, [tx.plural(F.col("word")), tx.adverb(F.col("word"))])


@SUITE.query("d18_prefixes", f"WITH {_W} SELECT DISTINCT left(word, CAST(i AS INT)) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)")
def _(t):
    return dc.prefixes(lexicon(t))


@SUITE.query(
    "d30_identifier_audit",
    r"SELECT tok, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\v]+'), lambda s: s <> '')) AS tok FROM documents) WHERE length(tok) >= 2 AND length(regexp_replace(tok, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(tok, '[^0-9]', '', 'g')) >= 0.2 * length(tok) GROUP BY tok",
)
def _(t):
    toks = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("tok"))
    return toks.filter(tx.is_identifier(F.col("tok"))).groupBy("tok").agg(F.count("*").alias("n"))


@SUITE.query(
    "d08_segmentation_prior",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN -0.7 WHEN l_returnflag = 'R' THEN -0.75 ELSE 0.0 END - greatest(abs(l_quantity / 40.0 - 0.45) - 0.35, 0.0) / 0.35 AS prior FROM lineitem",
)
def _(t):
    kind = F.when(F.col("l_returnflag") == "A", "merge").when(F.col("l_returnflag") == "R", "split").otherwise("single")
    return t.lineitem.select("l_orderkey", "l_linenumber", dc.segmentation_prior(kind, F.col("l_quantity"), F.lit(40.0)).alias("prior"))


def edges(words):
    """A chain of two candidates per character of each word, and one merged edge where it has two."""
    chars = words.select("word", F.posexplode(F.split("word", "")).alias("src", "ch"))
    other = F.translate("ch", "aeioust", "eaouits")
    one = chars.select("word", "src", (F.col("src") + 1).alias("dst"), "ch", F.lit(1.0).alias("d"), F.lit(0.0).alias("prior"))
    two = chars.select("word", "src", (F.col("src") + 1).alias("dst"), other.alias("ch"), F.lit(0.9).alias("d"), F.lit(0.0).alias("prior"))
    merged = chars.filter("src = 0 and length(word) > 1").select("word", "src", F.lit(2).alias("dst"), F.lit("m").alias("ch"), F.lit(2.5).alias("d"), F.lit(-0.7).alias("prior"))
    return one.unionByName(two).unionByName(merged)


@SUITE.query("d01_d03_decode")
def _(t):
    pairs = dc.bigram_pairs(lexicon(t))
    logp, _, _ = dc.bigram_model(pairs, vowel())
    # words are of a-z only, so the model has no more than 27 * 27 pairs
    bigrams = {(r.prev, r.next): r.logp for r in logp.collect()}
    return dc.decode_words(edges(lexicon(t)), dc.Decoder(bigrams, {}), lexicon(t).select("word", F.lit(1).alias("tier")))


@SUITE.query(
    "d06_probe_reading",
    f"""WITH {_W}, c AS (SELECT word, CAST(unnest(range(0, length(word))) AS INT) AS src FROM w), k AS (SELECT word, src, word[src + 1] AS ch FROM c),
          e AS (SELECT word, src, src + 1 AS dst, ch, 1.0 AS d FROM k UNION ALL SELECT word, src, src + 1, translate(ch, 'aeioust', 'eaouits'), 0.9 FROM k UNION ALL SELECT word, src, 2, 'm', 2.5 FROM k WHERE src = 0 AND length(word) > 1)
        SELECT word, src, dst, ch FROM (SELECT *, row_number() OVER (PARTITION BY word, src ORDER BY d, ch, dst) AS r FROM e) WHERE r = 1""",
)
def _(t):
    return dc.probe_reading(edges(lexicon(t)))


_PARAMS = "p AS (SELECT p_name || p_partkey AS name, CAST(p_size AS DOUBLE) AS value FROM part)"


def params(t):
    return t.part.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("double").alias("value"))


@SUITE.query("d31_d32_overrides", f"WITH {_PARAMS} SELECT name, CASE WHEN value > 40 THEN value * 2 ELSE value END AS value, value > 40 AS overridden FROM p")
def _(t):
    p = params(t)
    return dc.apply_overrides(p, p.filter("value > 40").select("name", (F.col("value") * 2).alias("value")))


@SUITE.query("d33_difference", f"WITH {_PARAMS} SELECT name, value AS left, CASE WHEN value <= 45 THEN value + 1 END AS right FROM p WHERE value > 40")
def _(t):
    p = params(t)
    return dc.table_difference(p, p.filter("value <= 45").select("name", F.when(F.col("value") > 40, F.col("value") + 1).otherwise(F.col("value")).alias("value")), "name", "value")


@SUITE.query("d34_r38_census", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"))


@SUITE.query("d05_d29_character_classes", r"SELECT ch, count(*) AS n, ch ~ '^[0-9]$' AS digit, ch ~ '^\p{L}$' AS letter, ch ~ '^\p{Lu}$' AS upper, lower(ch) AS folded FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def _(t):
    ch = F.col("ch")
    chars = t.documents.select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", "n", ch.rlike("^[0-9]$").alias("digit"), ch.rlike(r"^\p{L}$").alias("letter"), ch.rlike(r"^\p{Lu}$").alias("upper"), F.lower(ch).alias("folded"))
