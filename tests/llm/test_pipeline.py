"""Each stage of the corpus pipeline on a small table with planted cases, and the queries' columns and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, mix string, __id string, row string"


def draw(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    good = {i: draw(rng, 90) for i in range(60)}
    junk = {i: " ".join(w + "###" for w in draw(rng, 90).split()) for i in range(100, 160)}
    passage = "\n".join(draw(rng, 30) for _ in range(3))
    leak = draw(rng, 20)
    texts = list((good | junk).items())
    texts += [(200, good[3]), (201, good[4].replace(" ", "  ", 5)), (202, f"{draw(rng, 60)}\n{passage}"), (203, f"{passage}\n{draw(rng, 60)}"), (204, f"{draw(rng, 60)} {leak} {draw(rng, 20)}")]
    texts += [(205, None), (206, ""), (None, draw(rng, 80)), (7, good[7])]
    out = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", None if t is None else len(t), "k", "m", "i", "r") for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i < 100), 0) for i in list(good) + list(junk)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), passage


def test_stages(spark, folder):
    path, passage = folder
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    kept = stages["quality_classifier"](spark, docs, path)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = ids(kept)
    assert sum(i in found for i in range(60)) >= 57 and sum(i in found for i in range(100, 160)) <= 3
    plain = docs.filter("doc_id is null or doc_id < 100 or doc_id >= 200")
    lines = {r.doc_id: r for r in stages["line_dedup"](spark, plain, path).collect()}
    assert passage in lines[202].text and passage not in lines[203].text and lines[203].n_chars == len(lines[203].text)
    assert 3 in lines and 200 not in lines  # a copy of one long line has nothing left
    assert lines[205].text is None and lines[206].text == "" and None in lines
    near = stages["simhash_near_dedup"](spark, plain, path)
    assert ids(near) == ids(plain) - {200, 201, 206} and near.filter("doc_id = 7").count() == 2
    clean = stages["benchmark_decontamination"](spark, plain, path)
    assert ids(clean) == ids(plain) - {204} and clean.count() == plain.count() - 1
    packed = stages["packing"](spark, plain, path)
    assert ids(packed) == ids(plain)
    for name, stage in stages.items():
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_pipeline_runs_its_stages_in_order(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {0, 3, 202} <= ids and not ids & {200, 201, 204, 206}


def test_queries_have_the_contract_columns_and_equal_their_sql(spark):
    wanted = {
        "op1_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
        "op2_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op3_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op4_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
        "op6_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
        "op7_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op8_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    }
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, FOLDER)
        kinds = dict(frame.dtypes)
        assert columns.items() <= kinds.items(), (name, kinds)
        if name in queries.ORACLE_SQL:
            names = sorted(frame.columns)
            result = con.execute(queries.ORACLE_SQL[name])
            at = [[d[0] for d in result.description].index(c) for c in names]
            assert sorted(tuple(r) for r in frame.select(names).collect()) == sorted(tuple(r[i] for i in at) for r in result.fetchall()), name
    prints = queries.QUERIES["op4_simhash"](spark, FOLDER).filter(~F.col("fingerprint").rlike("^[0-9a-f]{16}$"))
    assert prints.count() == 0
