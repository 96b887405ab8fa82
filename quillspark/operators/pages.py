"""Pages of pixels: typesetting from stored glyph rasters, and recognition from bytes to words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators import layout, raster

GLYPHS = "array<struct<ch:string,line:int,x:int,y:int,w:int,h:int>>"


def typeset(lines: DataFrame, face: dict, gap: int = 1, space: int = 8, leading: int = 6, margin: int = 4) -> DataFrame:
    """Pages of ``lines(page, line, text)``: ``page, width, height, pixels`` (0 is ink, 255 paper) and ``glyphs``, the truth.

    ``face`` maps characters to 2-D arrays of ink, set on a common bottom line; it is a model and travels with the
    function. Characters that it lacks are spaces. The lines of a page are one row, in order of ``line``.
    """
    pages = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        tall = max((g.shape[0] for g in face.values()), default=1)
        for batch in batches:
            for page, rows in zip(batch.column("page"), batch.column("lines").to_pylist()):
                truth, width = [], 0
                for n, row in enumerate(rows):
                    x = margin
                    for ch in row["text"] or "":
                        if ch not in face:
                            x += space
                            continue
                        h, w = face[ch].shape
                        truth.append({"ch": ch, "line": n, "x": x, "y": margin + n * (tall + leading) + tall - h, "w": w, "h": h})
                        x += w + gap
                    width = max(width, x + margin)
                height = 2 * margin + max(len(rows), 1) * (tall + leading)
                sheet = np.full((height, max(width, 2 * margin)), 255, np.uint8)
                for g in truth:
                    sheet[g["y"] : g["y"] + g["h"], g["x"] : g["x"] + g["w"]][face[g["ch"]].astype(bool)] = 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page.as_py()], page.type), pa.array([sheet.shape[1]], pa.int32()), pa.array([height], pa.int32()), pa.array([sheet.tobytes()], pa.binary()), pa.array([truth], kind)],
                    names=["page", "width", "height", "pixels", "glyphs"],
                )

    import pyarrow as pa

    kind = pa.list_(pa.struct([("ch", pa.string()), *((c, pa.int32()) for c in ("line", "x", "y", "w", "h"))]))
    return pages.mapInArrow(draw, f"page {dict(lines.dtypes)['page']}, width int, height int, pixels binary, glyphs {GLYPHS}")


def ink_pixels(pages: DataFrame, darker: int = 128) -> DataFrame:
    """``img, y, x, ink`` of the pixels darker than the threshold; pixels that aren't width x height are an error."""

    def find(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for page, w, h, pixels in zip(*(batch.column(c) for c in ("page", "width", "height", "pixels"))):
                v = np.frombuffer(pixels.as_py() or b"", np.uint8)
                if len(v) != w.as_py() * h.as_py():
                    raise ValueError(f"page {page.as_py()}: {len(v)} pixels, not {w.as_py()} x {h.as_py()}")
                y, x = np.nonzero(v.reshape(h.as_py(), w.as_py()) < darker)
                at = pa.array(np.zeros(len(y), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([page.as_py()], page.type).take(at), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(np.ones(len(y), bool))], names=["img", "y", "x", "ink"])

    return pages.select("page", "width", "height", "pixels").mapInArrow(find, f"img {dict(pages.dtypes)['page']}, y int, x int, ink boolean")


def page_glyphs(pages: DataFrame, word_gap: float = 0.5, darker: int = 128) -> DataFrame:
    """Glyphs of pages in reading order: ``page, line, word, q, x0, y0, x1, y1, ink, baseline, x_height``.

    Connected components join bands; components of a band that overlap in x are one glyph; a gap of over ``word_gap`` times
    the band's median height starts a word. ``ink`` is the glyph's box as a row-major array of 0 and 1.
    """
    labelled = raster.label(ink_pixels(pages, darker)).withColumnRenamed("img", "page")
    parts = labelled.groupBy("page", F.col("label").cast("long").alias("id")).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    banded = parts.join(layout.best_bands(parts, "page"), ["page", "id"])
    tops = banded.groupBy("page", "band").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).alias("median"))
    tops = tops.withColumn("line", F.row_number().over(Window.partitionBy("page").orderBy("top", "band")) - 1)
    boxes = banded.join(tops, ["page", "band"])
    by = ["page", "line"]
    cut = F.col("x0") >= layout.reach_before(by, ["x0", "x1"])
    cells = layout.segment(boxes, by, ["x0", "x1"], cut, "cell")
    box = cells.groupBy(*by, "cell").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("median").alias("median"), F.first("bottom").alias("bottom"))
    words = layout.split_at_gaps(box, by, word_gap, "median").withColumnRenamed("segment", "word")
    inked = labelled.join(cells.select("page", F.col("id").alias("label"), "line", "cell"), ["page", "label"]).groupBy(*by, "cell").agg(F.collect_set(F.struct("y", "x")).alias("at"))
    full = words.join(inked, [*by, "cell"])
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    dots = F.transform("at", lambda p: (p["y"] - F.col("y0")) * w + p["x"] - F.col("x0"))
    ink = F.transform(F.sequence(F.lit(0), w * h - 1), lambda k: F.array_contains("dots", k).cast("int"))
    named = full.withColumn("dots", dots).withColumn("q", F.format_string("%s/%06d/%06d", F.col("page").cast("string"), "line", "cell"))
    return named.select(*by, "word", "q", "x0", "y0", "x1", "y1", ink.alias("ink"), (F.col("bottom") - F.col("y0")).cast("double").alias("baseline"), F.col("median").cast("double").alias("x_height"))
