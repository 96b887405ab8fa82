"""Fixture files: folders of pages with truth beside them, golden vectors and lattices, class tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.readers import list_files, parse_pgm, read_truth, read_tsv

GOLDEN = "fixture string, stage string, dims int, values array<float>"
LATTICE = "why string, params map<string,float>, positions array<array<array<string>>>"
#: The columns of a class table.
CHARSET = "index int, codepoint string, glyph string, category string, baseline_class string, aspect_min double, aspect_max double, aspect_source string, case_twin int, notes string"


def _or_error(ok: Column, value: Column, kind: str, *message) -> Column:
    told = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(ok, value).otherwise(F.raise_error(told).cast(kind))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, w, h, pixels`` of every graymap of a folder; a folder without any is an error."""
    return parse_pgm(list_files(spark, folder, "*.pgm"))


def pages_with_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the truth JSON of the same stem beside them; a page without one is an error that names it."""
    truth = read_truth(spark, f"{folder}/*.json")
    joined = read_pages(spark, folder).join(truth.withColumn("found", F.lit(True)), "stem", "left")
    return joined.withColumn("lines", _or_error(F.col("found").isNotNull(), F.col("lines"), "array<string>", "no truth beside ", F.col("stem"))).drop("found")


def discover_fixtures(spark: SparkSession, members: dict[str, tuple[str, str]]) -> DataFrame:
    """``stem`` and a boolean for each member: the union of the stems of several listings.

    ``members``: name -> (folder, suffix). A stem that some listing lacks stays, with false there. A folder
    that doesn't exist is an error, one without such files isn't.
    """
    parts = []
    for name, (folder, suffix) in members.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"))
        parts.append(files.select(F.substr("file", F.lit(1), F.length("file") - len(suffix)).alias("stem"), F.lit(name).alias("member")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("stem").agg(*[F.bool_or(F.col("member") == name).alias(name) for name in members])


def missing_members(found: DataFrame) -> DataFrame:
    """``stem, member`` for each member that a fixture lacks."""
    names = [c for c in found.columns if c != "stem"]
    return found.select("stem", F.explode(F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("there")) for c in names])).alias("m")).filter("not m.there").select("stem", "m.member")


def parse_golden(texts: DataFrame) -> DataFrame:
    """Golden vectors ``stem, value``: ``stem, fixture, stage, values``; a missing field or another count than ``dims`` is an error."""
    rows = texts.select("stem", F.from_json("value", GOLDEN).alias("g")).select("stem", "g.*")
    whole = F.col("fixture").isNotNull() & F.col("stage").isNotNull() & F.col("values").isNotNull() & (F.size("values") == F.col("dims")) & F.forall("values", lambda v: v.isNotNull())
    return rows.select("stem", "fixture", "stage", _or_error(F.coalesce(whole, F.lit(False)), F.col("values"), "array<float>", "not a golden vector: ", F.col("stem")).alias("values"))


def parse_lattice(texts: DataFrame) -> DataFrame:
    """Lattices ``stem, value``: ``stem, why, params, positions``, an array of candidates ``(ch, distance)`` for each position.

    An error are a missing ``why``, no positions, a position without candidates, and a candidate that isn't one character
    and a finite distance. Missing ``params`` are empty.
    """
    rows = texts.select("stem", F.from_json("value", LATTICE).alias("f")).select("stem", "f.*")
    good = lambda c: F.coalesce((F.size(c) == 2) & (F.length(c[0]) == 1) & c[1].rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.lit(False))
    fine = F.forall("positions", lambda p: (F.size(p) > 0) & F.forall(p, good))
    checked = _or_error(F.coalesce(F.col("why").isNotNull() & (F.size("positions") > 0) & fine, F.lit(False)), F.col("positions"), "array<array<array<string>>>", "not a lattice: ", F.col("stem"))
    pairs = F.transform(checked, lambda p: F.transform(p, lambda c: F.struct(c[0].alias("ch"), c[1].cast("float").alias("distance"))))
    return rows.select("stem", "why", F.coalesce("params", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<float>"))).alias("params"), pairs.alias("positions"))


def lattice_edges(lattices: DataFrame) -> DataFrame:
    """The linear chain of a lattice as a decoder's edges: ``word, src, dst, ch, d, prior``."""
    steps = lattices.select(F.col("stem").alias("word"), F.posexplode("positions").alias("src", "p"))
    return steps.select("word", "src", (F.col("src") + 1).alias("dst"), F.explode("p").alias("c")).select("word", "src", "dst", "c.ch", F.col("c.distance").cast("double").alias("d"), F.lit(0.0).alias("prior"))


def expectation_json(fixture: Column, text: Column, identifier: Column, score: Column) -> Column:
    """A decode golden: fields in a reader's order, an indent of two, the score as text; ends with a newline."""
    quoted = lambda c: F.substr(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    fields = [("fixture", quoted(fixture)), ("stage", F.lit('"decode"')), ("text", quoted(text)), ("identifier", identifier.cast("string")), ("score", quoted(score))]
    body = F.concat_ws(",\n", *[F.concat(F.lit(f'  "{name}": '), value) for name, value in fields])
    return F.concat(F.lit("{\n"), body, F.lit("\n}\n"))


def read_score_rows(spark: SparkSession, path: str) -> DataFrame:
    """``shard, row`` of a two-column list of score rows; another width or a row that isn't a number is an error."""
    rows = read_tsv(spark, path, "shard string, row string")
    return rows.select("shard", _or_error(F.coalesce(F.col("row").rlike(r"^\d+$"), F.lit(False)), F.col("row").cast("long"), "bigint", "bad row number: ", F.coalesce("row", F.lit(""))).alias("row"))


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a class table: ``index, ch, category, baseline_class, aspect_min, aspect_max, case_twin``.

    A class is its place: an index that is repeated or missing is an error, as is a bad code point or an empty
    table. A negative twin is none.
    """
    rows = read_tsv(spark, path, CHARSET)
    n, least, most, distinct = rows.agg(F.count("*"), F.min("index"), F.max("index"), F.count_distinct("index")).first()
    if n == 0:
        raise ValueError(f"{path} has no classes")
    if (least, most, distinct) != (0, n - 1, n):
        raise ValueError(f"{path}: class indices are out of sequence")
    code = F.conv(F.regexp_extract("codepoint", r"^U\+([0-9A-Fa-f]{4,6})$", 1), 16, 10).cast("int")
    ch = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return rows.select(
        "index", _or_error(F.col("codepoint").rlike(r"^U\+[0-9A-Fa-f]{4,6}$"), ch, "string", "bad code point: ", F.col("codepoint")).alias("ch"), "category", "baseline_class", "aspect_min", "aspect_max", F.when(F.col("case_twin") >= 0, F.col("case_twin")).alias("case_twin")
    )


def assert_train_dir(path: str) -> str:
    """``path``, unless its folder isn't named ``*-train``: an allow-list, so that no scoring folder is ever counted."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if not name.endswith("-train"):
        raise ValueError(f"{path}: refusing to count from a folder that isn't named *-train")
    return path
