"""WARC archives through a chunked record table (operator 7).

A payload travels as rows ``(record, chunk number, bytes)``: the writer streams them into the
archive and the reader streams them out again, each with an incremental SHA-1, so no Python
process holds a whole record. Each record is a gzip member of its own. Of records with equal payloads (same SHA-256 and length) the one
with the largest page id is stored; the others are ``revisit`` records of it, which keep the HTTP
header (and so the payload's length) and its digest but no payload.

Archives go to the shared folder under names of their own attempt; the stored manifest lists
those of successful attempts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.files import filesystem, open_for_read
from quillspark.storage import materialise, scratch_path

CHUNK = 1 << 20
ARCHIVE_BYTES = 1 << 28
MANIFEST = "path string, records long"
CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
    "chunk long, last boolean, stored_bytes long, stored_digest string, data binary"
)


def warc_records(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Pages with payload, its size and digests, and the page whose payload a revisit refers to.

    A null html is an empty payload. Rows that share the largest page id of their payload are
    all responses; a null page id is less than any other.
    """
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"size": F.length("payload").cast("long"), "sha1": F.sha1("payload"), "same": F.sha2("payload", 256)})
    groups = (
        keyed.filter(F.col("size") >= min_revisit)
        .groupBy("same", "size")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
        .filter("n > 1 and response is not null")
        .drop("n")
    )
    other = F.coalesce(F.col("page_id") < F.col("response"), F.col("response").isNotNull())
    return keyed.join(groups, ["same", "size"], "left").select("page_id", "url", "payload", "size", "sha1", F.when(other, F.col("response")).alias("refers_to"))


def chunk_rows(records: DataFrame) -> DataFrame:
    """A row per chunk of at most ``CHUNK`` bytes, in order; revisits and empty payloads have one."""
    stored = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.ceil(F.length(stored) / CHUNK), F.lit(1)).cast("int")
    return records.select("page_id", "url", "size", "sha1", "refers_to", stored.alias("stored"), count.alias("chunks")).select(
        "page_id", "url", "size", "sha1", "refers_to", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "stored"
    ).select("page_id", "url", "size", "sha1", "refers_to", "chunks", "chunk", F.substring("stored", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("data"))


def _head(page_id, url, size: int, sha1: str, refers_to, date: str) -> bytes:
    import base64
    from urllib.parse import quote

    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + http


def write_archives(chunks: DataFrame, out: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Stream chunk rows into archives of about ``ARCHIVE_BYTES``; returns the stored manifest."""
    out = out or scratch_path(chunks.sparkSession, "warc")

    def write(batches):
        import hashlib
        import uuid
        import zlib

        import pyarrow as pa

        store, root = filesystem(out)
        store.create_dir(root, recursive=True)
        schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
        sink, path, records, written, digest, length = None, None, 0, 0, None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "size", "sha1", "refers_to", "chunks", "chunk")]
            for i, (page, url, size, sha1, refers_to, n, k) in enumerate(zip(*columns)):
                if k == 0:
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        path, records, written = f"{out}/{name}", 0, 0
                        sink = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=CHUNK)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    sink.write(member.compress(_head(page, url, size, sha1, refers_to, date)))
                    digest, length = hashlib.sha1(), 0
                data = batch.column("data")[i].as_buffer()
                sink.write(member.compress(data))
                digest.update(data)
                length += len(data)
                if k == n - 1:
                    if refers_to is None and (length, digest.hexdigest()) != (size, sha1):
                        raise ValueError(f"page {page}: chunks don't add up to the payload")
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
                    records, written = records + 1, written + length
                    if written >= ARCHIVE_BYTES:
                        sink.close()
                        sink = None
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records])], schema=schema)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records])], schema=schema)

    return materialise(chunks.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archive(stream, chunk_bytes: int = CHUNK):
    """Yield a dict per chunk of each record of an archive, with running length and SHA-1."""
    import base64
    import hashlib

    def header(first: bytes) -> dict[str, str]:
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields | {"": first.decode().strip()}

    page = lambda s: None if s == "<urn:x-page:None>" else int(s[len("<urn:x-page:") : -1])
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        fields = header(first)
        block = int(fields["content-length"])
        at = stream.tell()
        http = header(stream.readline())
        left = block - (stream.tell() - at)
        record = {
            "page_id": page(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_digest": base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "payload_bytes": int(http["content-length"]),
        }
        digest, length, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError("the archive ends inside a record")
            left -= len(data)
            length += len(data)
            digest.update(data)
            yield record | {"chunk": k, "last": not left, "stored_bytes": length, "stored_digest": digest.hexdigest(), "data": data}
            k += 1
            if not left:
                break
        if record["record_type"] == "response" and (length, digest.hexdigest()) != (record["payload_bytes"], record["payload_digest"]):
            raise ValueError(f"page {record['page_id']}: the stored payload doesn't match its digest")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives in the manifest."""
    # a row per archive, which has a bounded size: no more rows than tasks that wrote
    files = manifest.repartition(max(1, manifest.count()), "path")

    def read(batches):
        import gzip
        import io

        import pyarrow as pa

        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "chunk": pa.int64(), "last": pa.bool_(), "stored_bytes": pa.int64(), "data": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

        def batch_of(rows):
            return pa.RecordBatch.from_pylist([r if with_data else r | {"data": None} for r in rows], schema=schema)

        for row in (r for b in batches for r in b.to_pylist()):
            with open_for_read(row["path"]) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, CHUNK) as stream:
                held, size, seen = [], 0, 0
                for chunk in read_archive(stream):
                    seen += chunk["last"]
                    held.append(chunk)
                    size += len(chunk["data"])
                    if not with_data:
                        chunk["data"] = None
                    if size >= 8 * CHUNK or len(held) >= 5000:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)
                if seen != row["records"]:
                    raise ValueError(f"{row['path']} has {seen} records, not {row['records']}")

    return files.mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write all pages as WARC records and read them back: one row per page row.

    Repeated rows are records each, an empty table writes no archive, other columns are ignored.
    """
    manifest = write_archives(chunk_rows(warc_records(pages, min_revisit)))
    return read_archives(manifest, with_data=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
