"""Sequence packing by first-fit decreasing on a tournament tree (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.wordcache import encoder, read_tokenizer
from quillspark.storage import materialise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths, capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item, by first-fit decreasing; ties keep the given order.

    The leaves of the tournament tree are the bins' free room and each inner node holds the
    larger of its two, so the leftmost bin with room is one walk from the root. There are no
    more bins than items.
    """
    n = len(lengths)
    size = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * size)
    placed: list[tuple[int, int]] = [(0, 0)] * n
    for i in sorted(range(n), key=lambda k: -lengths[k]):
        need, node = lengths[i], 1
        if need > capacity:
            raise ValueError(f"an item of {need} is larger than the capacity, {capacity}")
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        placed[i] = (node - size, capacity - tree[node])
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return placed


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut each document's ids, end mark included, at multiples of ``capacity``.

    Only the pieces' sizes and checksums travel on; the stored table keeps texts from being
    tokenised twice. Null texts are empty and have the end mark alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        import random
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        # the same numbers when a task is run again
        rng = random.Random(TaskContext.get().partitionId())
        encode, end = encoder(shared.value).encode, int(end_id).to_bytes(4, "little")
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread")
        step = 4 * capacity
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw, spread = encode(text.as_py()) + end, rng.getrandbits(62)
                for at in range(0, len(raw), step):
                    piece = raw[at : at + step]
                    for column, value in zip(columns, (key, at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4, spread)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return materialise(inputs.mapInArrow(cut, PIECES), "token-pieces")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_docs: int = 4096) -> DataFrame:
    """Pack pieces by first-fit decreasing, independently in randomised groups of documents.

    A group has about ``group_docs`` documents whatever the corpus holds; documents fall into
    groups by a random number drawn per row, so equal ids or texts don't meet in one task.
    """
    groups = max(1, -(-pieces.filter("start = 0").count() // group_docs))

    def fit(key, frame):
        import pandas as pd

        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        placed = first_fit_decreasing(frame["length"].tolist(), capacity)
        group = int(key[0])
        return pd.DataFrame(
            {
                **{c: frame[c].to_numpy() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")},
                "sequence_id": [(group << 32) + b for b, _ in placed],
                "offset": [o for _, o in placed],
            }
        ).astype({"doc_id": "Int64"})

    return pieces.withColumn("group", F.pmod("spread", F.lit(groups))).groupBy("group").applyInPandas(fit, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """One row per piece: document, span, checksum, sequence and offset within it.

    Null ids stay null, repeated rows are packed each, an empty table gives no rows, and
    columns other than ``doc_id`` and ``text`` are ignored.
    """
    return pack_pieces(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, group_docs)
