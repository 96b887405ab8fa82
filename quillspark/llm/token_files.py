"""Flat token-ID files with 64-bit document offsets (operator 8).

File format, per partition ``k`` of the documents in ascending id order:

* ``*.bin`` - the ids of all its documents, end marks included, as flat little-endian unsigned
  integers: 16 bits wide where every id of the vocabulary fits, else 32;
* ``*.idx`` - one little-endian signed 64-bit offset per document plus a last one: the ids
  before it *in this file*;
* ``*.ids`` - the documents' ids, signed 64-bit. Null ids come first; the manifest counts them.

The manifest (a table) has a row per partition; its prefix sums give each file's base in the
whole stream, so any document is found by ``base + offset`` without reading other files.
Files carry the attempt's own name and the manifest names those of successful attempts only:
a task that is run again, or twice at once, can't damage the result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.files import filesystem, open_for_read
from quillspark.llm.wordcache import encoder, read_tokenizer
from quillspark.storage import materialise, scratch_path

MANIFEST = "part int, path string, n_docs long, n_null long, n_tokens long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
BLOCK = 1 << 20


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    partitions: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str | None = None,
) -> DataFrame:
    """Tokenise whole texts, append ``end_id``, write the files; returns the stored manifest.

    Null texts are empty; rows with equal ids (and those whose id is null, which come first)
    are ordered by text. An empty table has an empty manifest. Other columns are ignored.
    Rows are dealt by ranges of (id, hash of text), so repeated ids don't meet in one task.
    """
    spark = docs.sparkSession
    table = read_tokenizer(tokenizer_path)
    shared = spark.sparkContext.broadcast(table)
    width = _width(table, end_id)
    out = out or scratch_path(spark, "token-files")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("mix", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "mix")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text")
    )

    def write(batches):
        import uuid

        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end = encoder(shared.value).encode, int(end_id).to_bytes(4, "little")
        store, root = filesystem(out)
        store.create_dir(root, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}"
        offset = nulls = docs_seen = 0
        with (
            store.open_output_stream(f"{root}/{name}.bin", compression=None, buffer_size=BLOCK) as tokens,
            store.open_output_stream(f"{root}/{name}.idx", compression=None, buffer_size=BLOCK) as index,
            store.open_output_stream(f"{root}/{name}.ids", compression=None, buffer_size=BLOCK) as ids,
        ):
            index.write(np.int64(0).tobytes())
            for batch in batches:
                keys = batch.column("doc_id")
                nulls += keys.null_count
                ids.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                for text in batch.column("text"):
                    raw = encode(text.as_py()) + end
                    offset += len(raw) // 4
                    docs_seen += 1
                    tokens.write(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                    index.write(np.int64(offset).tobytes())
        if docs_seen:
            import pyarrow as pa

            yield pa.RecordBatch.from_pylist(
                [{"part": part, "path": f"{out}/{name}", "n_docs": docs_seen, "n_null": nulls, "n_tokens": offset, "width": width}],
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]),
            )

    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _width(tokenizer_json: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def bases(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with each file's base. It has a row per partition, never per document."""
    rows = manifest.orderBy("part").collect()
    before = accumulate((r.n_tokens for r in rows), initial=0)
    return spark.createDataFrame([(*r, b) for r, b in zip(rows, before)], f"{MANIFEST}, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Map the files into memory and return a row per document: id, start, count and crc32."""
    spark = manifest.sparkSession
    files = bases(spark, manifest)
    n = max(1, files.count())

    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for row in (r for b in batches for r in b.to_pylist()):
            width = row["width"]
            with open_for_read(f"{row['path']}.bin") as tokens, open_for_read(f"{row['path']}.idx") as index, open_for_read(f"{row['path']}.ids") as ids:
                for at in range(0, row["n_docs"], 4096):
                    m = min(4096, row["n_docs"] - at)
                    index.seek(8 * at)
                    ends = np.frombuffer(index.read_buffer(8 * (m + 1)), "<i8")
                    ids.seek(8 * at)
                    keys = np.frombuffer(ids.read_buffer(8 * m), "<i8")
                    tokens.seek(width * int(ends[0]))
                    crcs = []
                    for count in np.diff(ends):
                        piece = np.frombuffer(tokens.read_buffer(width * int(count)), f"<u{width}")
                        crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                    known = np.arange(at, at + m) >= row["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=~known), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())],
                        schema=schema,
                    )

    return files.repartition(n, "part").mapInArrow(read, ROWS)
