"""Text scalar functions over the documents (T01-T03, T16-T21, T26-T41, D07, D12, D20-D30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import hashing, text as tx
from quillspark.plans.base import Suite

SUITE = Suite()

_WS = r"[ \t\r\f\v]+"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '{ws}', ' ', 'g'))), lambda s: s <> '')"


@SUITE.query("t01_normalise", f"SELECT doc_id, array_to_string({_LINES.format(ws=_WS)}, chr(10)) AS norm FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalise(F.col("text")).alias("norm"))


@SUITE.query("t02_clean_lines", f"SELECT doc_id, array_to_string(({_LINES.format(ws='[ ' + chr(9) + chr(160) + ']+')})[2:], chr(10)) AS clean FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.clean_lines(F.col("text"), drop=1).alias("clean"))


_FLAT = r"trim(regexp_replace(lower(text), '[ \t\r\n\f\v]+', ' ', 'g'))"
_WORDS = f"(CASE WHEN {_FLAT} = '' THEN [] ELSE string_split({_FLAT}, ' ') END)"


@SUITE.query("t03_flat_lower", f"SELECT doc_id, md5({_FLAT}) AS digest, length({_FLAT}) AS n FROM documents")
def _(t):
    flat = tx.flat_lower(F.col("text"))
    return t.documents.select("doc_id", F.md5(flat).alias("digest"), F.length(flat).alias("n"))


@SUITE.query(
    "t20_shingles",
    f"""SELECT doc_id, count(DISTINCT s) AS n_shingles, min(s) AS least FROM (
          SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5)
        GROUP BY doc_id""",
)
def _(t):
    s = t.documents.select("doc_id", tx.shingles(tx.words(F.col("text"))).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.array_min("s").alias("least"))


@SUITE.query(
    "t21_shingles_or_whole",
    f"""SELECT conv_id, turn, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))))
               WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM (SELECT conv_id, turn, {_WORDS} AS w FROM conversations)""",
)
def _(t):
    s = tx.shingles(tx.words(F.col("text")), 5, "whole")
    return t.conversations.select("conv_id", "turn", F.size(s).cast("long").alias("n"))


_TOK = r"unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\v]+'), lambda s: s <> ''))"
_IDENT = r"(length(tok) >= 2 AND length(regexp_replace(tok, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(tok, '[^0-9]', '', 'g')) >= 0.2 * length(tok))"


@SUITE.query(
    "t17_identifier_tokens",
    f"SELECT doc_id, count(*) FILTER (WHERE {_IDENT}) AS identifiers, count(*) AS toks FROM (SELECT doc_id, {_TOK} AS tok FROM documents) GROUP BY doc_id",
)
def _(t):
    toks = t.documents.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("tok"))
    return toks.groupBy("doc_id").agg(F.count_if(tx.is_identifier(F.col("tok"))).alias("identifiers"), F.count("*").alias("toks"))


@SUITE.query(
    "t26_tokenise_classify",
    rf"""SELECT kind, count(*) AS n, count(DISTINCT tok) AS forms FROM (
           SELECT tok, CASE WHEN {_IDENT} THEN 'identifier' WHEN regexp_replace(tok, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g') ~ '^\p{{L}}+$' THEN 'word' ELSE 'discarded' END AS kind
           FROM (SELECT {_TOK} AS tok FROM documents)) GROUP BY kind""",
)
def _(t):
    tok = F.col("tok")
    kind = F.when(tx.is_identifier(tok), "identifier").when(tx.bare_word(tok).rlike(r"^\p{L}+$"), "word").otherwise("discarded")
    toks = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("tok"))
    return toks.groupBy(kind.alias("kind"), "tok").count().groupBy("kind").agg(F.sum("count").alias("n"), F.count("*").alias("forms"))


@SUITE.query("t32_t33_digests", "SELECT doc_id, sha256(text) AS sha2, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha2"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


@SUITE.query(
    "t34_t35_row_ids",
    "SELECT doc_id, printf('%s#%06d', source, doc_id) AS row_id, source AS shard, doc_id AS row_no, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS shard_no FROM documents",
)
def _(t):
    ids = t.documents.select("doc_id", tx.row_id(F.col("source"), F.col("doc_id")).alias("row_id"))
    shard, row = tx.split_row_id(F.col("row_id"))
    return ids.select("doc_id", "row_id", shard.alias("shard"), row.alias("row_no"), tx.shard_index(shard).alias("shard_no"))


@SUITE.query("t29_t31_sample_fraction")
def _(t):
    """FNV-1a, its finaliser and the sampling fraction; wrapping 64-bit products have no DuckDB form."""
    h = hashing.fnv1a64(F.concat(F.col("source"), F.lit("\x1f"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", F.hex(h).alias("fnv"), F.hex(hashing.fmix64(h)).alias("mixed"), hashing.fraction(hashing.fmix64(h)).alias("fraction"))


@SUITE.query(
    "t37_pretokens",
    r"""SELECT doc_id, len(p) AS n, array_to_string(p, '') = text AS whole, p[1] AS head FROM (
          SELECT doc_id, text, regexp_extract_all(text, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+') AS p FROM documents)""",
)
def _(t):
    p = t.documents.select("doc_id", "text", tx.pretokens(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), (F.array_join("p", "") == F.col("text")).alias("whole"), F.get("p", F.lit(0)).alias("head"))


@SUITE.query(
    "t39_byte_alphabet",
    """SELECT b, CASE WHEN plain THEN b ELSE 255 + sum(CASE WHEN plain THEN 0 ELSE 1 END) OVER (ORDER BY b) END AS shown
       FROM (SELECT range AS b, range BETWEEN 33 AND 126 OR range BETWEEN 161 AND 172 OR range BETWEEN 174 AND 255 AS plain FROM range(256))""",
)
def _(t):
    return hashing.byte_alphabet(t.spark)


_EN = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) BETWEEN 2 AND 9"
_DBL = "(CASE WHEN w ~ '^[^aeiou]*[aeiou][^aeiouwxy]$' THEN w || right(w, 1) ELSE w END)"


@SUITE.query(
    "d20_d27_inflections",
    f"""SELECT w,
          CASE WHEN w ~ '(s|x|z|ch|sh)$' THEN w || 'es' WHEN w ~ '[^aeiou]y$' THEN left(w, -1) || 'ies' ELSE w || 's' END AS plural,
          CASE WHEN w ~ 'e$' THEN w || 'd' WHEN w ~ '[^aeiou]y$' THEN left(w, -1) || 'ied' ELSE {_DBL} || 'ed' END AS past,
          CASE WHEN w ~ '(ee|oe|ye)$' THEN w || 'ing' WHEN w ~ 'e$' THEN left(w, -1) || 'ing' ELSE {_DBL} || 'ing' END AS gerund,
          CASE WHEN w ~ 'e$' THEN left(w, -1) || 'est' WHEN w ~ '[^aeiou]y$' THEN left(w, -1) || 'iest' ELSE {_DBL} || 'est' END AS superlative,
          CASE WHEN w ~ 'y$' THEN left(w, -1) || 'ily' WHEN w ~ 'ic$' THEN w || 'ally' WHEN w ~ '[^aeiou]le$' THEN left(w, -1) || 'y' ELSE w || 'ly' END AS adverb,
          len(regexp_extract_all(w, '[aeiou]+')) = 1 AS mono, upper(left(w, 1)) || w[2:] AS title
        FROM ({_EN})""",
)
def _(t):
    w = F.col("w")
    base = t.documents.filter("lang = 'en'").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).filter("length(w) between 2 and 9").distinct()
    return base.select(
        "w", tx.plural(w).alias("plural"), tx.past(w).alias("past"), tx.gerund(w).alias("gerund"), tx.comparative(w, "est").alias("superlative"), tx.adverb(w).alias("adverb"), tx.monosyllabic(w).alias("mono"), tx.title_case(w).alias("title")
    )


@SUITE.query(
    "d04_case_shape",
    r"""SELECT case_shape, count(*) AS n FROM (
          SELECT CASE WHEN tok !~ '\p{L}' THEN 'none' WHEN tok ~ '^\P{L}*\p{Lu}\P{L}*$' THEN 'initial' WHEN tok = lower(tok) THEN 'lower' WHEN tok = upper(tok) THEN 'upper'
                 WHEN tok ~ '^\P{L}*\p{Lu}(\P{L}|\p{Ll})*$' THEN 'title' ELSE 'mixed' END AS case_shape
          FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\v]+'), lambda s: s <> '')) AS tok FROM documents)) GROUP BY case_shape""",
)
def _(t):
    from quillspark.operators.decoding import case_shape

    toks = t.documents.select(F.explode(tx.tokens(F.col("text"))).alias("tok"))
    return toks.groupBy("tok").count().groupBy(case_shape(F.col("tok")).alias("case_shape")).agg(F.sum("count").alias("n"))


@SUITE.query(
    "k06_s29_markup",
    r"""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
               md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS stripped FROM pages""",
)
def _(t):
    html = F.col("html")
    return t.pages.select("page_id", F.md5(tx.xml_escape(html)).alias("escaped"), F.md5(tx.strip_tags(html)).alias("stripped"))
