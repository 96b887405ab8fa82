"""Writers: text forms of bitmaps, features, hOCR, page text, manifests and model folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import xml_escape


def pgm_bytes(w: Column, h: Column, pixels: Column) -> Column:
    return F.concat(F.encode(F.format_string("P5\n%d %d\n255\n", w, h), "ISO-8859-1"), pixels)


def pbm_text(w: Column, bits: Column) -> Column:
    """ASCII bitmap; one line per row."""
    h = (F.size(bits) / w).cast("int")
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.array_join(F.slice(bits, y * w + 1, w), " "))
    return F.concat(F.format_string("P1\n%d %d\n", w, h), F.array_join(rows, "\n"), F.lit("\n"))


def feature_json(fixture: Column, values: Column) -> Column:
    return F.to_json(F.struct(fixture.alias("fixture"), F.lit("feature").alias("stage"), F.size(values).alias("dims"), values.alias("values")))


def hocr_words(words: DataFrame) -> DataFrame:
    """One element per word of ``(page, line, pos, x0, y0, x1, y1, text, conf)``, joined by line and page.

    Words of a line and lines of a page are gathered: bounded by the page.
    """
    span = F.format_string(
        "<span class='ocrx_word' title='bbox %d %d %d %d; x_wconf %d'>%s</span>", "x0", "y0", "x1", "y1", F.round(F.col("conf") * 100).cast("int"), xml_escape(F.col("text"))
    )
    ordered = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "s"))), lambda x: x["s"]), "\n")
    lines = words.select("page", "line", "pos", "x0", "y0", "x1", "y1", span.alias("s")).groupBy("page", "line").agg(ordered("pos").alias("body"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    line = F.format_string("<span class='ocr_line' title='bbox %d %d %d %d'>\n%s\n</span>", "x0", "y0", "x1", "y1", "body")
    return lines.select("page", "line", line.alias("s")).groupBy("page").agg(F.concat(F.lit("<div class='ocr_page'>\n"), ordered("line"), F.lit("\n</div>")).alias("hocr"))


def page_text(words: DataFrame) -> DataFrame:
    """Words joined by spaces; fragments of one band by a space, bands by newlines: ``page, text``."""
    ordered = lambda name, value: F.transform(F.array_sort(F.collect_list(F.struct(name, value))), lambda x: x[value])
    lines = words.groupBy("page", "band", "line").agg(F.array_join(ordered("pos", "text"), " ").alias("s"))
    bands = lines.groupBy("page", "band").agg(F.array_join(ordered("line", "s"), " ").alias("s"))
    return bands.groupBy("page").agg(F.array_join(ordered("band", "s"), "\n").alias("text"))


def manifest_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """TSV lines; a tab or newline in a cell becomes a space, null an empty cell."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\t\n]", " "), F.lit(""))
    return rows.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))


def write_model(tables: dict[str, DataFrame], path: str, meta: dict) -> None:
    """A model as a folder: Parquet per table and ``meta`` with its version."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_model(spark, path: str, version: int) -> tuple[dict, dict[str, DataFrame]]:
    """The tables that ``meta`` lists; an unknown version is refused, an unknown table is skipped."""
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta.get("version") != version:
        raise ValueError(f"model version {meta.get('version')}, not {version}")
    return meta, {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def rounded_rates(rows: DataFrame, key: str, *rates: str) -> DataFrame:
    return rows.select(key, *[F.format_string("%.8f", F.col(r)).alias(r) for r in rates])


