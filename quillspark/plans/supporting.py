"""Supporting queries: automaton sizes, column blocks, validations, digests, byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import hashing, text as tx
from quillspark.operators import bpe, corpus, decoding as dc, layout as ly, neural as nn
from quillspark.plans.base import Suite
from quillspark.plans.corpus import _CONTAIN
from quillspark.plans.decoding import _W, lexicon
from quillspark.plans.layout import _BOX, boxes
from quillspark.plans.neural import _E, _LS
from quillspark.plans.text import _IDENT, _TOK, _WORDS
from quillspark.sources import readers as rd
from quillspark.storage import scratch_path

SUITE = Suite()


@SUITE.query(
    "d07_d09_word_agreement",
    f"WITH {_W} SELECT tok, CAST({_IDENT} AS BOOLEAN) AS identifier, CASE WHEN {_IDENT} OR lower(tok) IN (SELECT word FROM w) THEN 1.0::DOUBLE ELSE 0.0 END AS agreement FROM (SELECT DISTINCT {_TOK} AS tok FROM conversations)",
)
def _(t):
    toks = t.conversations.select(F.explode(tx.tokens(F.col("text"))).alias("tok")).distinct()
    known = lexicon(t).select("word", F.lit(1).alias("tier"))
    identifier = tx.is_identifier(F.col("tok"))
    return toks.join(known, F.lower("tok") == F.col("word"), "left").select("tok", identifier.alias("identifier"), dc.agreement(identifier, F.col("tier")).alias("agreement"))


@SUITE.query("d12_title_case", f"WITH {_W} SELECT word, upper(left(word, 1)) || substr(word, 2) AS title FROM w")
def _(t):
    return lexicon(t).select("word", F.concat(F.upper(F.left("word", F.lit(1))), F.expr("substring(word, 2)")).alias("title"))


@SUITE.query(
    "d28_automaton_size",
    f"""WITH {_W}, c AS (SELECT DISTINCT word, unnest(range(0, length(word) + 1)) AS i FROM w),
          s AS (SELECT left(word, CAST(i AS INT)) AS prefix, string_agg(substr(word, CAST(i + 1 AS INT)), ',' ORDER BY substr(word, CAST(i + 1 AS INT))) AS state FROM c GROUP BY 1),
          x AS (SELECT DISTINCT state, substr(word, CAST(i + 1 AS INT), 1) AS next FROM c JOIN s ON s.prefix = left(word, CAST(i AS INT)) WHERE i < length(word))
        SELECT (SELECT count(DISTINCT state) FROM s) AS states, (SELECT count(*) FROM x) AS transitions""",
)
def _(t):
    return dc.automaton_size(lexicon(t))


_RULES = "SELECT CAST(l_partkey % 40 AS INT) AS a, CAST(l_suppkey % 40 AS INT) AS b, CAST(l_linenumber % 3 AS INT) AS context, CAST(l_orderkey % 40 AS INT) AS favour, l_quantity - 2 AS adjust FROM lineitem"


@SUITE.query(
    "s21_confusion_violations",
    f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY a, b, context) AS n FROM ({_RULES}))
        SELECT a, b, context, 'duplicate' AS violation FROM r WHERE n > 1 UNION ALL SELECT a, b, context, 'same class' FROM r WHERE a = b
        UNION ALL SELECT a, b, context, 'favours neither' FROM r WHERE favour NOT IN (a, b) UNION ALL SELECT a, b, context, 'not positive' FROM r WHERE adjust <= 0""",
)
def _(t):
    rows = t.lineitem.selectExpr("cast(l_partkey % 40 as int) a", "cast(l_suppkey % 40 as int) b", "cast(l_linenumber % 3 as int) context", "cast(l_orderkey % 40 as int) favour", "l_quantity - 2 as adjust")
    return dc.rule_violations(rows)


@SUITE.query(
    "s22_weight_blocks",
    """WITH named AS (SELECT DISTINCT p_type AS block FROM part WHERE p_size < 26), known AS (SELECT DISTINCT p_type AS block FROM part WHERE p_size > 20)
       SELECT coalesce(n.block, k.block) AS block, CASE WHEN k.block IS NULL THEN 'unknown' ELSE 'missing' END AS problem FROM named n FULL JOIN known k ON n.block = k.block WHERE n.block IS NULL OR k.block IS NULL""",
)
def _(t):
    """Every block must be named, and nothing else."""
    named, known = (t.part.filter(f).select(F.col("p_type").alias("block")).distinct() for f in ("p_size < 26", "p_size > 20"))
    return named.join(known, "block", "left_anti").withColumn("problem", F.lit("unknown")).unionByName(known.join(named, "block", "left_anti").withColumn("problem", F.lit("missing")))


@SUITE.query("s34_s35_dequantise", f"WITH {_E} SELECT vec_id, list_transform(v, lambda x, i: floor(x * 64) * (1 + i % 4) / 64) AS v FROM e")
def _(t):
    """Whole numbers times their column's scale; a row of another width is an error."""
    q = t.embeddings.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("q"))
    scales = F.array(*[F.lit((1 + i % 4) / 64) for i in range(1, 65)])
    checked = F.when(F.size("q") == F.size(scales), F.col("q")).otherwise(F.raise_error(F.lit("values and scales differ in length")))
    return q.select("vec_id", F.zip_with(checked, scales, lambda x, s: x * s).alias("v"))


_XOR = "xor({0}, {0} >> 33)"
_MIX = _XOR.format(f"(({_XOR.format('((' + _XOR.format('k') + ' * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)')}) * 14181476777654086739::UHUGEINT % 18446744073709551616::UHUGEINT)")


@SUITE.query("t30_fmix64", f"SELECT o_orderkey, hex(CAST({_MIX} AS UBIGINT)) AS mixed FROM (SELECT o_orderkey, CAST(o_orderkey AS UHUGEINT) AS k FROM orders)")
def _(t):
    return t.orders.select("o_orderkey", F.hex(hashing.fmix64(F.col("o_orderkey"))).alias("mixed"))


@SUITE.query("t41_class_table_digest", """SELECT sha256('[' || string_agg('{"index":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']') AS digest FROM nation""")
def _(t):
    """The class table is a small dimension: its canonical JSON is one value."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("index"), F.col("n_name").alias("name"))))
    return t.nation.agg(F.sha2(F.to_json(rows), 256).alias("digest"))


@SUITE.query(
    "x28_page_shingles",
    f"""SELECT page_id, len(s) AS n, list_min(s) AS least FROM (SELECT page_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT page_id, {_WORDS} AS w FROM (SELECT page_id, html AS text FROM pages)))""",
)
def _(t):
    s = t.pages.select("page_id", tx.shingles(tx.words(F.col("html")), 5, "whole").alias("s"))
    return s.select("page_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("least"))


@SUITE.query("x06_edge_centres", f"WITH {_BOX} SELECT page, id, x0 + (x1 - x0) / greatest(floor((x1 - x0) / 8 + 0.5), 2) / 2 AS near_left, x1 - (x1 - x0) / greatest(floor((x1 - x0) / 8 + 0.5), 2) / 2 AS near_right FROM box")
def _(t):
    x0, x1 = F.col("x0"), F.col("x1")
    return boxes(t).select("page", "id", ly.edge_centre(x0, x1, F.lit(8), True).alias("near_left"), ly.edge_centre(x0, x1, F.lit(8), False).alias("near_right"))


_ROWS = f"""{_BOX}, r AS (SELECT page, id, x0, x1, y1, y0 // 10 AS row FROM box), a AS (SELECT page, id, x0, x1, row FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id, x0, x1, y1, row) AS n FROM r) WHERE n = 1),
     m AS (SELECT r.page, r.row, count(*) FILTER (WHERE hit) AS found, CASE WHEN count(*) FILTER (WHERE hit) = 1 THEN max(r.x1) FILTER (WHERE hit) END AS right_edge
           FROM (SELECT r.*, least(r.x1, a.x1) - greatest(r.x0, a.x0) >= 0.4 * least(r.x1 - r.x0, a.x1 - a.x0) AND NOT (
                     count(*) OVER (PARTITION BY r.page, r.row) = 1 AND EXISTS (SELECT 1 FROM r s WHERE s.page = a.page AND s.row = a.row AND (s.x0 <> a.x0 OR s.x1 <> a.x1) AND r.x0 < s.x1 AND s.x0 < r.x1)) AS hit
                 FROM r JOIN a ON r.page = a.page WHERE r.row <> a.row) r GROUP BY r.page, r.row)"""


def anchors(t):
    rows = boxes(t).withColumn("row", F.floor(F.col("y0") / 10).cast("int"))
    first = F.row_number().over(Window.partitionBy("page").orderBy("id", "x0", "x1", "y1", "row"))
    return rows.withColumn("n", first).filter("n = 1").drop("n"), rows


@SUITE.query("x08_x09_single_column", f"WITH {_ROWS} SELECT * FROM m")
def _(t):
    return ly.column_matches(*anchors(t), ["page"], 0.4, strict=True)


@SUITE.query(
    "l19_column_extents",
    f"""WITH {_ROWS}, n AS (SELECT m.*, max(CASE WHEN found <> 1 AND m.row < a.row THEN m.row END) OVER w AS above, min(CASE WHEN found <> 1 AND m.row > a.row THEN m.row END) OVER w AS below FROM m JOIN a USING (page) WINDOW w AS (PARTITION BY m.page))
        SELECT a.page, greatest(a.x1, coalesce(max(n.right_edge), a.x1)) AS extent FROM a LEFT JOIN n ON a.page = n.page AND (above IS NULL OR n.row > above) AND (below IS NULL OR n.row < below) GROUP BY a.page, a.x1""",
)
def _(t):
    anchor, rows = anchors(t)
    return ly.column_extents(anchor, ly.column_matches(anchor, rows, ["page"], 0.4, strict=True), ["page"])


@SUITE.query(
    "l17_wrap_runs",
    f"""WITH {_BOX}, g AS (SELECT page, y0 // 10 AS band, count(*) AS boxes, min(x0) AS x0, max(x1) AS x1, max(y1) AS y FROM box GROUP BY ALL),
          l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band) - 1 AS row FROM g),
          p AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, y - lag(y) OVER w AS gap FROM l WINDOW w AS (PARTITION BY page ORDER BY row)),
          f AS (SELECT *, max(CASE WHEN row = 1 THEN gap END) OVER (PARTITION BY page) AS first FROM p)
        SELECT page, coalesce(min(CASE WHEN row > 0 AND NOT (boxes = 1 AND least(px1, x1) - greatest(px0, x0) >= 0.1 * least(px1 - px0, x1 - x0) AND gap > 0 AND (row = 1 OR coalesce(gap / nullif(first, 0) BETWEEN 0.3 AND 3, false))) THEN row END) - 1, max(row)) AS run FROM f GROUP BY page""",
)
def _(t):
    band = boxes(t).groupBy("page", F.floor(F.col("y0") / 10).alias("band")).agg(F.count("*").alias("boxes"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y"))
    rows = band.withColumn("row", F.row_number().over(Window.partitionBy("page").orderBy("band")) - 1)
    return ly.wrap_run_lengths(rows, ["page"], 0.1, 0.3, 3.0)


@SUITE.query(
    "n10_x33_continuation_score",
    f"WITH {_E}, s AS (SELECT vec_id, {_LS.format(v='v')} AS s FROM e) SELECT vec_id // 16 AS candidate, round(sum(s[vec_id % 64 + 1]), 7) AS score, count(*) AS tokens FROM s GROUP BY 1",
)
def _(t):
    """A vector stands for a step's logits, its id for the candidate's token there."""
    step = F.get(nn.log_softmax(F.col("embedding")), (F.col("vec_id") % 64).cast("int"))
    return t.embeddings.groupBy(F.floor(F.col("vec_id") / 16).alias("candidate")).agg(F.round(F.sum(step), 7).alias("score"), F.count("*").alias("tokens"))


@SUITE.query(
    "n07_load_status",
    """SELECT status, status <> 'Loaded' AS falls_back, count(*) AS n FROM (SELECT CASE WHEN label IS NULL OR label = 0 THEN 'Absent' WHEN label % 3 = 1 THEN 'Unsupported' WHEN len(embedding) <> 64 OR embedding[1] < 0 THEN 'Malformed' ELSE 'Loaded' END AS status FROM embeddings) GROUP BY ALL""",
)
def _(t):
    tables = t.embeddings.select(nn.load_status(F.coalesce(F.col("label") != 0, F.lit(False)), F.col("label") % 3 != 1, (F.size("embedding") == 64) & (F.get("embedding", F.lit(0)) >= 0)).alias("status"))
    return tables.groupBy("status", (F.col("status") != "Loaded").alias("falls_back")).agg(F.count("*").alias("n"))


@SUITE.query("k17_containment_tsv", f"WITH {_CONTAIN} SELECT source AS shard, doc_id AS row, round_even(containment, 4) AS containment, CAST(coalesce(best_item, -1) AS BIGINT) AS best FROM c JOIN documents USING (doc_id)")
def _(t):
    """Written sorted by shard and row with four decimals, and read back at that precision."""
    path = scratch_path(t.spark, "containment")
    rows = corpus.containment(t.documents, t.benchmark).join(t.documents.select("doc_id", "source"), "doc_id").orderBy("source", "doc_id")
    rows.select(F.concat_ws("\t", "source", F.col("doc_id").cast("string"), F.format_string("%.4f", F.bround("containment", 4)), F.coalesce("best_item", F.lit(-1)).cast("string"))).write.text(path)
    return rd.read_tsv(t.spark, path, "shard string, row long, containment double, best long")


@SUITE.query("t36_t38_byte_pairs")
def _(t):
    """Ids of the benchmark's items under a public vocabulary; the tests hold them against its library."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = bpe.BytePairEncoder.from_json(f.read())
    ids = bpe.encode_texts(t.benchmark, encoder, "item_id", "text")
    return ids.select("item_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").cast("binary")).alias("digest"))
