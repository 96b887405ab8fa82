"""Readers: Portable graymaps and bitmaps, truth JSON, fixed-width TSV, sectioned text, hOCR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TRUTH = "family string, px_per_em double, lines array<string>, glyphs array<struct<ch string, line int, x int, y int, w int, h int, baseline double, x_height double>>"
MANIFEST = "dataset string, row_id string, split string, licence string, reason string"
SPLITS = ("train", "validation", "score", "excluded")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, stem, content`` of the matching files; an empty folder is an error, not an empty result."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return files.select("path", stem(F.col("path")).alias("stem"), "content")


def parse_pgm(files: DataFrame) -> DataFrame:
    """Binary graymaps: ``stem, w, h, pixels``. Headers may hold comments; a short body is an error."""
    head = F.decode(F.substring("content", 1, 200), "ISO-8859-1")
    parts = F.regexp_extract_all(head, F.lit(r"^P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s"), F.lit(0))
    header = F.get(parts, F.lit(0))
    numbers = F.regexp_extract_all(F.regexp_replace(header, r"#[^\n]*\n|^P5", " "), F.lit(r"\d+"), F.lit(0))
    rows = files.select("stem", F.get(numbers, F.lit(0)).cast("int").alias("w"), F.get(numbers, F.lit(1)).cast("int").alias("h"), F.substr("content", F.length(header) + 1, F.length("content")).alias("pixels"))
    bad = F.col("w").isNull() | (F.length("pixels") != F.col("w") * F.col("h"))
    return rows.withColumn("pixels", F.when(bad, F.raise_error(F.concat(F.lit("not a P5 graymap: "), F.col("stem"))).cast("binary")).otherwise(F.col("pixels")))


def parse_pbm(texts: DataFrame) -> DataFrame:
    """ASCII bitmaps ``stem, value``: ``stem, w, h, bits`` (array of 0/1)."""
    plain = F.regexp_replace("value", r"#[^\n]*", " ")
    parts = F.filter(F.split(plain, r"\s+"), lambda s: s != "")
    w, h = F.get(parts, F.lit(1)).cast("int"), F.get(parts, F.lit(2)).cast("int")
    bits = F.transform(F.filter(F.split(F.array_join(F.slice(parts, 4, F.size(parts)), ""), ""), lambda s: s != ""), lambda s: s.cast("int"))
    return texts.select("stem", w.alias("w"), h.alias("h"), bits.alias("bits"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth JSON: missing scalars get defaults, missing arrays are an error."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", stem(F.col("_metadata.file_path")).alias("stem"))
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"truth without {c}")).cast(dict(rows.dtypes)[c])).otherwise(F.col(c))
    return rows.select("stem", F.coalesce("family", F.lit("")).alias("family"), F.coalesce("px_per_em", F.lit(0.0)).alias("px_per_em"), need("lines").alias("lines"), need("glyphs").alias("glyphs"))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows of a fixed width; ``#`` comments are skipped, a wrong width is an error."""
    width = len(schema.split(","))
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    checked = F.when(F.size(cells) == width, cells).otherwise(F.raise_error(F.concat(F.lit(f"not {width} columns: "), F.col("value"))).cast("array<string>"))
    named = [p.split() for p in schema.split(",")]
    return lines.select(checked.alias("c")).select(*[F.nullif(F.get("c", F.lit(i)), F.lit("")).cast(kind).alias(name) for i, (name, kind) in enumerate(named)])


def validated_manifest(rows: DataFrame) -> DataFrame:
    known = F.col("split").isin(*SPLITS)
    return rows.withColumn("split", F.when(known, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no such split: "), F.col("split")))))


def sectioned(lines: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Words under ``[header]`` lines, each with the last header before it."""
    header = F.nullif(F.regexp_extract(value, r"^\[(.*)\]$", 1), F.lit(""))
    w = Window.partitionBy(*by).orderBy(order)
    filled = lines.withColumn("section", F.last(header, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.filter(~F.col(value).rlike(r"^\[.*\]$") & (F.trim(value) != ""))


def image_bytes(frame: DataFrame, column: str) -> Column:
    """Binary from a binary, a struct with ``bytes``, or a base64 string column."""
    kind = frame.schema[column].dataType.typeName()
    if kind == "binary":
        return F.col(column)
    return F.col(f"{column}.bytes") if kind == "struct" else F.try_to_binary(F.col(column), F.lit("base64"))


def flat_words(frame: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Words of nested receipt JSON: one row per word of each valid line, with its quad."""
    schema = "valid_line array<struct<words array<struct<text string, quad struct<x1 int, x2 int, x3 int, x4 int, y1 int, y2 int, y3 int, y4 int>>>>>"
    lines = frame.select(*keys, F.posexplode(F.from_json(raw, schema)["valid_line"]).alias("line", "l"))
    return lines.select(*keys, "line", F.posexplode("l.words").alias("pos", "w")).select(*keys, "line", "pos", "w.text", "w.quad")


def quad_box(quad: Column) -> Column:
    """Least and largest corner of a quad; null where a corner is missing."""
    xs, ys = (F.array(*[quad[f"{a}{i}"] for i in (1, 2, 3, 4)]) for a in "xy")
    whole = F.forall(F.concat(xs, ys), lambda v: v.isNotNull())
    return F.when(whole, F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))


def hocr_lines(pages: DataFrame, key: str, html: str, opener: str = r"<p\b[^>]*>") -> DataFrame:
    """Text of each line element, tags stripped and entities decoded; a page without any is one line."""
    from quillspark.functions.text import strip_tags, xml_unescape

    pieces = F.split(html, opener)
    parts = F.when(F.size(pieces) > 1, F.slice(pieces, 2, F.size(pieces))).otherwise(pieces)
    lines = pages.select(key, F.posexplode(parts).alias("line", "raw"))
    text = F.trim(F.regexp_replace(xml_unescape(strip_tags(F.col("raw"))), r"[ \t\r\n]+", " "))
    return lines.select(key, "line", text.alias("text")).filter("text <> ''")


def wanted_rows(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Column-pruned fetch of some rows."""
    return docs.join(wanted.select(key).distinct(), key, "left_semi")


def checked_container(tables: DataFrame, version: int) -> DataFrame:
    """Tables ``(name, version, body, crc)``: an unknown version or a wrong checksum is an error."""
    fault = F.when(F.col("version") != version, "unknown version of ").when(F.crc32("body") != F.col("crc"), "checksum of ")
    return tables.withColumn("body", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("name"))).cast("binary")).otherwise(F.col("body")))
