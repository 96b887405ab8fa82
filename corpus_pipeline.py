"""The corpus pipeline: five stages, each stored and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, line_dedup, packing, quality, simhash
from quillspark.llm.queries import tokenizer_path
from quillspark.storage import scratch_path

ORACLE_SQL = None  # hashing, learned scores, alignment and tokenisation have no SQL form


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    return quality.keep_documents(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: aligned blocks go from the later document; one left without any text goes too."""
    deduped = line_dedup.dedup_lines(docs)
    emptied = (F.col("lines_deleted") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = deduped.filter(~F.coalesce(emptied, F.lit(False)))
    changed = F.col("lines_deleted") > 0
    return kept.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup over five-word shingles at a similarity of 0.8: the least id stays."""
    return _columns(simhash.drop_near_duplicates(docs, similarity=0.8, size=5))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of a benchmark item go."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("mix").alias("__mix")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    return _columns(keyed.join(hit.hint("merge"), keyed["doc_id"].eqNullSafe(hit["__id"]) & (keyed["__key"] == hit["__mix"]), "left_anti"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all kept documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", delete_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
