"""The operators' queries over the given tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, embedding_dedup, html_text, line_dedup, packing, quality, sharding, simhash, token_files, warc

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "lines_total", "lines_deleted")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_text, op3_packing, op4_simhash, op5_line_dedup, op6_embedding_dedup, op7_warc, op8_token_files, op9_quality, op10_sharding)}

ORACLE_SQL = {
    "op1_decontamination": r"""
        WITH doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), item AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
            FROM item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s)
            WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM win),
        place AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
            FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)
        ), found AS (SELECT doc_id, item_id, s, win.n FROM place JOIN win ON place.phrase = win.phrase AND place.n = win.n),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
        )
        SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
             last AS (SELECT h, max(page_id) AS page_id FROM p WHERE n >= 1000 GROUP BY h)
        SELECT p.page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN last.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, nullif(last.page_id, p.page_id) AS refers_to
        FROM p LEFT JOIN last ON p.h = last.h
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), edge AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(u, v) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u
        ), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
        degree AS (SELECT u, count(*) AS n FROM edge GROUP BY u)
        SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = v.vec_id AS kept
        FROM v JOIN least ON v.vec_id = least.u LEFT JOIN degree ON v.vec_id = degree.u
    """,
}
