"""Source and sink queries: text forms of the tables are written by one side and parsed by the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.base import Suite
from quillspark.plans.layout import boxes
from quillspark.sources import fixtures as fx
from quillspark.sources import readers as rd
from quillspark.sources import writers as wr
from quillspark.storage import scratch_path

SUITE = Suite()

_BITS = "b AS (SELECT vec_id, list_transform(embedding, lambda e: CASE WHEN e < 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"


def bitmaps(t):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda e: (e < 0).cast("int")).alias("bits"))


@SUITE.query("k02_pbm_text", f"WITH {_BITS} SELECT vec_id, 'P1' || chr(10) || '8 8' || chr(10) || array_to_string(list_transform(range(0, 8), lambda y: array_to_string(bits[y * 8 + 1 : y * 8 + 8], ' ')), chr(10)) || chr(10) AS pbm FROM b")
def _(t):
    return bitmaps(t).select("vec_id", wr.pbm_text(F.lit(8), F.col("bits")).alias("pbm"))


@SUITE.query("s06_parse_pbm", f"WITH {_BITS} SELECT CAST(vec_id AS VARCHAR) AS stem, 8 AS w, 8 AS h, array_to_string(bits, '') AS bits FROM b")
def _(t):
    texts = bitmaps(t).select(F.col("vec_id").cast("string").alias("stem"), F.replace(wr.pbm_text(F.lit(8), F.col("bits")), F.lit("P1\n"), F.lit("P1\n# a comment 1 1\n")).alias("value"))
    return rd.parse_pbm(texts).withColumn("bits", F.array_join("bits", ""))


@SUITE.query("k01_s01_s02_pgm_round_trip", "SELECT CAST(vec_id AS VARCHAR) AS stem, 8 AS w, 8 AS h, md5(array_to_string(list_transform(embedding, lambda e: CASE WHEN e < 0 THEN 'a' ELSE 'b' END), '')) AS digest FROM embeddings")
def _(t):
    body = F.encode(F.array_join(F.transform("embedding", lambda e: F.when(e < 0, "a").otherwise("b")), ""), "UTF-8")
    files = t.embeddings.select(F.col("vec_id").cast("string").alias("stem"), wr.pgm_bytes(F.lit(8), F.lit(8), body).alias("content"))
    return rd.parse_pgm(files).select("stem", "w", "h", F.md5("pixels").alias("digest"))


@SUITE.query("s03_s05_s11_listing", "SELECT source AS stem, count(*) AS n, true AS has_truth FROM documents GROUP BY source")
def _(t):
    """Files of two folders joined by stem; the union of the stems is kept, so a missing side shows."""
    path = scratch_path(t.spark, "listing")
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    counts.write.parquet(f"{path}/pages")
    pages = rd.list_files(t.spark, f"{path}/pages", "*.parquet")
    assert pages.filter(F.length("content") > 0).count() > 0
    back = t.spark.read.parquet(f"{path}/pages")
    truth = counts.select("source", F.lit(True).alias("has_truth"))
    return back.join(truth, "source", "full").select(F.col("source").alias("stem"), "n", F.coalesce("has_truth", F.lit(False)).alias("has_truth"))


@SUITE.query("s12_s16_s18_k07_tsv", "SELECT source AS dataset, doc_id AS row, lang AS licence, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'score' END AS split, n_chars AS chars FROM documents")
def _(t):
    """A manifest written as TSV with a comment, read back with its schema, splits validated."""
    path = scratch_path(t.spark, "tsv")
    rows = t.documents.select(F.col("source").alias("dataset"), F.col("doc_id").alias("row"), F.col("lang").alias("licence"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("score").alias("split"), F.col("n_chars").alias("chars"))
    lines = wr.manifest_lines(rows, rows.columns)
    lines.union(t.spark.createDataFrame([("# dataset row licence split chars",)], "value string")).write.text(path)
    return rd.validated_manifest(rd.read_tsv(t.spark, path, "dataset string, row long, licence string, split string, chars long"))


@SUITE.query("s13_s15_s20_s23_nullable_tsv", "SELECT doc_id AS row, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    path = scratch_path(t.spark, "tsv")
    rows = t.documents.select(F.col("doc_id").alias("row")).join(t.labels.withColumnRenamed("doc_id", "row"), "row", "left")
    wr.manifest_lines(rows, ["row", "quality", "toxic"]).write.text(path)
    return rd.read_tsv(t.spark, path, "row long, quality int, toxic int")


@SUITE.query(
    "s04_k14_truth_json",
    "SELECT doc_id, lang AS family, 0.0::DOUBLE AS px_per_em, len(string_split(text, chr(10))) AS lines, md5(text) AS digest, least(length(text), 3) AS glyphs, left(text, 1) AS first, 20 * least(length(text), 3) AS x_sum FROM documents WHERE text <> ''",
)
def _(t):
    """A truth record for each document, with lines and its first three characters as glyphs; a scalar is missing and gets its default."""
    path = scratch_path(t.spark, "truth")
    at = F.sequence(F.lit(1), F.least(F.length("text"), F.lit(3)))
    box = [F.lit(v).alias(k) for k, v in (("line", 0), ("x", 20), ("y", 2), ("w", 8), ("h", 9), ("baseline", 11.0), ("x_height", 7.0))]
    glyphs = F.transform(at, lambda i: F.struct(F.substr("text", i, F.lit(1)).alias("ch"), *box))
    t.documents.filter("text <> ''").select(F.col("lang").alias("family"), F.split("text", "\n").alias("lines"), glyphs.alias("glyphs"), "doc_id").write.json(path)
    back = t.spark.read.schema(rd.TRUTH + ", doc_id long").option("mode", "FAILFAST").json(path)
    return back.select(
        "doc_id", "family", F.coalesce("px_per_em", F.lit(0.0)).alias("px_per_em"), F.size("lines").cast("long").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest"),
        F.size("glyphs").cast("long").alias("glyphs"), F.get("glyphs.ch", F.lit(0)).alias("first"), F.aggregate("glyphs.x", F.lit(0), lambda a, x: a + x).cast("long").alias("x_sum"),
    )


@SUITE.query("s08_golden_vectors", "SELECT CAST(vec_id AS VARCHAR) AS stem, 'feature' AS stage, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS values FROM embeddings")
def _(t):
    """Vectors written as golden JSON and parsed: bit by bit the same floats."""
    texts = t.embeddings.select(F.col("vec_id").cast("string").alias("stem"), wr.feature_json(F.col("vec_id").cast("string"), F.col("embedding")).alias("value"))
    return fx.parse_golden(texts).select("stem", "stage", F.col("values").cast("array<double>").alias("values"))


@SUITE.query("s09_lattices", "SELECT p_partkey, CAST(i AS INT) AS src, ch, CASE WHEN k = 0 THEN 1.0 ELSE 1.5 END AS d FROM (SELECT p_partkey, unnest(range(0, length(p_brand))) AS i, p_brand FROM part), (VALUES (0), (1)) k(k), LATERAL (SELECT CASE WHEN k = 0 THEN p_brand[i + 1] ELSE '?' END AS ch)")
def _(t):
    """A lattice for each part, of its brand's characters with a rival each, written as JSON and parsed into edges."""
    pair = lambda ch, d: F.concat(F.lit("["), F.to_json(F.array(ch)).substr(F.lit(2), F.length(F.to_json(F.array(ch))) - 2), F.lit(f", {d}]"))
    positions = F.transform(F.split("p_brand", ""), lambda ch: F.concat(F.lit("["), pair(ch, 1.0), F.lit(", "), pair(F.lit("?"), 1.5), F.lit("]")))
    texts = t.part.select(F.col("p_partkey").cast("string").alias("stem"), F.concat(F.lit('{"why": "a test", "positions": ['), F.array_join(positions, ", "), F.lit("]}")).alias("value"))
    return fx.lattice_edges(fx.parse_lattice(texts)).select(F.col("word").cast(t.part.schema["p_partkey"].dataType).alias("p_partkey"), "src", "ch", "d")


@SUITE.query(
    "k04_expectation",
    r"""SELECT doc_id, '{' || chr(10) || '  "fixture": ' || to_json(source) || ',' || chr(10) || '  "stage": "decode",' || chr(10) || '  "text": ' || to_json(left(text, 40)) || ',' || chr(10) || '  "identifier": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ',' || chr(10)
        || '  "score": "' || CAST(doc_id AS VARCHAR) || '.5"' || chr(10) || '}' || chr(10) AS json FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", fx.expectation_json(F.col("source"), F.substring("text", 1, 40), F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".5"))).alias("json"))


@SUITE.query("s14_score_rows", "SELECT source AS shard, doc_id AS row FROM documents")
def _(t):
    path = scratch_path(t.spark, "score-rows")
    lines = wr.manifest_lines(t.documents, ["source", "doc_id"])
    lines.union(t.spark.createDataFrame([("# shard row",)], "value string")).write.text(path)
    return fx.read_score_rows(t.spark, path)


@SUITE.query("s17_charset", "SELECT CAST(n AS INT) AS index, chr(CAST(65 + n AS INT)) AS ch, CASE WHEN n % 2 = 0 THEN CAST(n + 1 AS INT) END AS case_twin FROM (SELECT n_nationkey AS n FROM nation)")
def _(t):
    path = scratch_path(t.spark, "charset")
    n = F.col("n_nationkey")
    rows = t.nation.select(n.alias("a"), F.format_string("U+%04X", n + 65).alias("b"), F.lit("x").alias("c"), F.lit("letter").alias("d"), F.lit("ascender").alias("e"), F.lit(0.1).alias("f"), F.lit(0.9).alias("g"), F.lit("measured").alias("h"), F.when(n % 2 == 0, n + 1).otherwise(-1).alias("i"), F.lit("-").alias("j"))
    wr.manifest_lines(rows, list("abcdefghij")).write.text(path)
    return fx.read_charset(t.spark, path).select("index", "ch", "case_twin")


@SUITE.query(
    "s19_sectioned",
    "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, pos - 1 AS pos, (SELECT 'sec' || CAST(floor((l.pos - 1) / 3) AS INT)) AS section FROM l WHERE (pos - 1) % 3 <> 0 AND trim(line) <> '' AND line !~ '^\\[.*\\]$'",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    headed = lines.withColumn("line", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("[sec"), F.floor(F.col("pos") / 3).cast("string"), F.lit("]"))).otherwise(F.col("line")))
    return rd.sectioned(headed, ["doc_id"], "pos", "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "section")


@SUITE.query("s25_image_bytes", "SELECT doc_id, md5(text) AS a, md5(text) AS b, md5(text) AS c FROM documents")
def _(t):
    raw = F.encode("text", "UTF-8")
    rows = t.documents.select("doc_id", raw.alias("plain"), F.struct(raw.alias("bytes")).alias("nested"), F.base64(raw).alias("coded"))
    return rows.select("doc_id", F.md5(rd.image_bytes(rows, "plain")).alias("a"), F.md5(rd.image_bytes(rows, "nested")).alias("b"), F.md5(rd.image_bytes(rows, "coded")).alias("c"))


@SUITE.query("s27_s28_nested_words", "SELECT doc_id, CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS INT) AS pos, unnest(string_split(text, ' ')) AS text, 3 AS x0, 9 AS x1 FROM documents")
def _(t):
    quad = F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 3), ("x2", 9), ("x3", 9), ("x4", 3), ("y1", 1), ("y2", 1), ("y3", 4), ("y4", 4))])
    words = F.transform(F.split("text", " "), lambda s: F.struct(s.alias("text"), quad.alias("quad")))
    raw = t.documents.select("doc_id", F.to_json(F.struct(F.array(F.struct(words.alias("words"))).alias("valid_line"))).alias("raw"))
    flat = rd.flat_words(raw, "raw", "doc_id").withColumn("box", rd.quad_box(F.col("quad")))
    return flat.select("doc_id", "pos", "text", "box.x0", "box.x1")


@SUITE.query(
    "s29_hocr_lines",
    r"""WITH p AS (SELECT page_id, regexp_split_to_array(html, '<p\b[^>]*>') AS s FROM pages), l AS (SELECT page_id, generate_subscripts(CASE WHEN len(s) > 1 THEN s[2:] ELSE s END, 1) - 1 AS line, unnest(CASE WHEN len(s) > 1 THEN s[2:] ELSE s END) AS raw FROM p)
        SELECT page_id, CAST(line AS INT) AS line, text FROM (SELECT page_id, line, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM l) WHERE text <> ''""",
)
def _(t):
    return rd.hocr_lines(t.pages, "page_id", "html")


@SUITE.query("s24_s26_wanted_rows", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND length(text) >= 200")
def _(t):
    return rd.wanted_rows(t.documents.filter("length(text) >= 200").select("doc_id", "n_chars"), t.labels.filter("toxic = 1"), "doc_id")


@SUITE.query("s32_s36_checksums", "SELECT doc_id, length(text) AS n FROM documents")
def _(t):
    tables = t.documents.select("doc_id", F.col("source").alias("name"), F.lit(1).alias("version"), F.encode("text", "UTF-8").alias("body"), "text").withColumn("crc", F.crc32("body"))
    return rd.checked_container(tables, 1).select("doc_id", F.length(F.decode("body", "UTF-8")).cast("long").alias("n"))


@SUITE.query("s33_k11_model_folder", "SELECT label AS class, count(*) AS prototypes FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label")
def _(t):
    path = scratch_path(t.spark, "model")
    wr.write_model({"prototypes": t.embeddings.filter("vec_id % 5 <> 0").select("vec_id", "label", "embedding")}, path, {"version": 1})
    _, tables = wr.read_model(t.spark, path, 1)
    return tables["prototypes"].groupBy(F.col("label").alias("class")).agg(F.count("*").alias("prototypes"))


@SUITE.query("s37_s38_json_paths", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@SUITE.query("s07_s10_k03_feature_json", "SELECT vec_id, len(embedding) AS dims, embedding[1] AS first FROM embeddings")
def _(t):
    """Float vectors survive the text form bit by bit."""
    text = t.embeddings.select("vec_id", wr.feature_json(F.col("vec_id").cast("string"), F.col("embedding")).alias("j"))
    back = text.select("vec_id", F.from_json("j", "fixture string, stage string, dims int, values array<float>").alias("f"))
    return back.select("vec_id", F.col("f.dims").cast("long").alias("dims"), F.get("f.values", F.lit(0)).alias("first"))


def words(t):
    return boxes(t).select("page", F.lit(0).alias("line"), F.col("id").alias("pos"), "x0", "y0", "x1", "y1", F.concat(F.lit("w&"), F.col("id").cast("string")).alias("text"), (F.col("x0") / 200).alias("conf"))


@SUITE.query("k05_hocr", "SELECT l_orderkey AS page, count(*) AS words FROM lineitem GROUP BY 1")
def _(t):
    hocr = wr.hocr_words(words(t))
    return hocr.select("page", F.regexp_count("hocr", F.lit("ocrx_word")).cast("long").alias("words"))


@SUITE.query("k13_page_text", "WITH w AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS band, text FROM conversations), b AS (SELECT conv_id, band, string_agg(text, ' ' ORDER BY turn) AS s FROM w GROUP BY ALL) SELECT conv_id AS page, md5(string_agg(s, chr(10) ORDER BY band)) AS digest FROM b GROUP BY conv_id")
def _(t):
    from pyspark.sql.window import Window

    band = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    w = t.conversations.select(F.col("conv_id").alias("page"), band.alias("band"), F.col("turn").alias("line"), F.lit(0).alias("pos"), "text")
    return wr.page_text(w).select("page", F.md5("text").alias("digest"))


@SUITE.query("k12_rate_csv", "SELECT o_orderkey, printf('%.8f', o_totalprice / 7) AS rate FROM orders")
def _(t):
    return wr.rounded_rates(t.orders.select("o_orderkey", (F.col("o_totalprice") / 7).alias("rate")), "o_orderkey", "rate")
