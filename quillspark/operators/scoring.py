"""Error rates, token scores and alignments between a reference text and a reading of it."""

from __future__ import annotations

from collections import Counter
from itertools import islice
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quillspark.functions.text import tokens

#: Cells of the alignment table beyond which ``edit_script`` gives no alignment.
MAX_CELLS = 16_000_000
#: Bits of the alignment table that are held in any case.
BLOCK_BITS = 1 << 26
#: Rows that are held as Python's values at a time: read, and made.
SLICE, OUT_ROWS = 256, 20_000


def rate(errors: Column, total: Column) -> Column:
    """Null on an empty reference; may exceed one."""
    return F.try_divide(errors.cast("double"), F.nullif(total, F.lit(0)).cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).when(both == 0, F.lit(0.0))


def encode_tokens(pairs: DataFrame, ref: str, got: str) -> DataFrame:
    """Adds ``ref_code`` and ``got_code``: each token of the pair as one private character.

    Codes count the distinct tokens of the pair, so the character-level distance of the codes is
    the token-level distance; two planes of private use hold 131,000 of them.
    """
    both = F.array_distinct(F.concat(tokens(F.col(ref)), tokens(F.col(got))))

    def code(text: str) -> Column:
        return F.array_join(F.transform(tokens(F.col(text)), lambda s: F.decode(F.unhex(F.format_string("%08X", F.array_position("__both", s) + F.lit(0xEFFFF))), "UTF-32")), "")

    return pairs.withColumn("__both", both).withColumns({"ref_code": code(ref), "got_code": code(got)}).drop("__both")


def dealt(pairs: DataFrame) -> DataFrame:
    """Rows over all cores: a pair costs with its lengths' product, so tasks cut by bytes are few and long."""
    return pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)


def edit_counts(pairs: DataFrame, ref: str, got: str) -> DataFrame:
    """Adds ``char_errors, chars, word_errors, words``; distances are over code points and tokens."""
    coded = encode_tokens(dealt(pairs), ref, got)
    return coded.withColumns(
        {
            "char_errors": F.levenshtein(ref, got).cast("long"),
            "chars": F.length(ref).cast("long"),
            "word_errors": F.levenshtein("ref_code", "got_code").cast("long"),
            "words": F.array_size(tokens(F.col(ref))).cast("long"),
        }
    ).drop("ref_code", "got_code")


def pooled(scores: DataFrame, *by: str) -> DataFrame:
    """Micro (``sum/sum``) and macro (mean of rates) error rates of mergeable counts, by group."""
    cer, wer = rate(F.col("char_errors"), F.col("chars")), rate(F.col("word_errors"), F.col("words"))
    return scores.groupBy(*by).agg(
        F.count("*").alias("pages"),
        rate(F.sum("char_errors"), F.sum("chars")).alias("micro_cer"),
        rate(F.sum("word_errors"), F.sum("words")).alias("micro_wer"),
        F.avg(cer).alias("macro_cer"),
        F.avg(wer).alias("macro_wer"),
    )


def token_hits(pairs: DataFrame, key: list[str], ref: str, got: str) -> DataFrame:
    """Multiset intersection of tokens: ``hits, expected, found`` per pair, order-free."""

    def counted(column: str, name: str) -> DataFrame:
        return pairs.select(*key, F.explode(tokens(F.col(column))).alias("tok")).groupBy(*key, "tok").agg(F.count("*").alias(name))

    joined = counted(ref, "a").join(counted(got, "b"), [*key, "tok"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    sums = joined.groupBy(*key).agg(F.sum(F.least(a, b)).alias("hits"), F.sum(a).alias("expected"), F.sum(b).alias("found"))
    zero = F.lit(0).cast("long")
    return pairs.select(*key).join(sums, key, "left").select(*key, *[F.coalesce(c, zero).alias(c) for c in ("hits", "expected", "found")])


def token_rates(hits: DataFrame) -> DataFrame:
    recall, precision = rate(F.col("hits"), F.col("expected")), rate(F.col("hits"), F.col("found"))
    return hits.withColumns({"recall": recall, "precision": precision}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _hits(a, b):
    """A function from a symbol to its places in ``a``, as bits; frequent ones are kept, the others made anew."""
    places: dict = {v: [] for v in b}
    for i, v in enumerate(a):
        if v in places:
            places[v].append(i)
    kept = {v: sum(1 << i for i in at) for v, at in places.items() if len(at) > len(a) >> 12}

    def of(v) -> int:
        return kept[v] if v in kept else sum(1 << i for i in places[v])

    return of


def _column(full: int, hit: int, plus: int, minus: int) -> tuple[int, int, int]:
    """One column of the edit table on, by bits (Hyyrö): where the diagonal step is free, where a column rises, where it falls."""
    zero = (((hit & plus) + plus) ^ plus | hit | minus) & full
    up = ((minus | full ^ (zero | plus)) << 1 | 1) & full
    return zero, ((zero & plus) << 1 & full) | full ^ (zero | up), zero & up


def distance(a, b) -> int:
    """Edit distance of two sequences; a row of bits is held at a time."""
    if len(a) < len(b):
        a, b = b, a
    full, hits = (1 << len(a)) - 1, _hits(a, b)
    plus, minus = full, 0
    for v in b:
        _, plus, minus = _column(full, hits(v), plus, minus)
    return len(b) + plus.bit_count() - minus.bit_count()


def edit_steps(a, b) -> list[tuple[str, object, object]]:
    """Backtrace of the edit distance; at ties substitution, then deletion, then insertion.

    Columns are bits. Those of a block are held, of the others each block's first; going back, blocks are made again.
    Long sequences so take memory with the power 1.5 of their length.
    """
    n, m = len(a), len(b)
    full, hits = (1 << n) - 1, _hits(a, b)
    block = max(isqrt(m) + 1, BLOCK_BITS // (n + 1))
    firsts: list[tuple[int, int]] = []
    state = (full, 0)

    def columns(start: int, plus: int, minus: int) -> tuple[list[tuple[int, int]], tuple[int, int]]:
        held = []
        for v in b[start : start + block]:
            zero, plus, minus = _column(full, hits(v), plus, minus)
            held.append((zero, plus))
        return held, (plus, minus)

    held, start = [], 0
    for start in range(0, m, block):
        firsts.append(state)
        held, state = columns(start, *state)
    out, i, j = [], n, m
    while i and j:
        if j <= start:
            start -= block
            held, _ = columns(start, *firsts[start // block])
        zero, plus = held[j - 1 - start]
        same = a[i - 1] == b[j - 1]
        if same or not zero >> (i - 1) & 1:
            out.append(("match" if same else "sub", a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif plus >> (i - 1) & 1:
            out.append(("del", a[i - 1], ""))
            i -= 1
        else:
            out.append(("ins", "", b[j - 1]))
            j -= 1
    out += [("del", v, "") for v in reversed(a[:i])] + [("ins", "", v) for v in reversed(b[:j])]
    return out[::-1]


def edit_script(a, b) -> list[tuple[str, object, object]] | None:
    """``edit_steps``, or null where the table would have over ``MAX_CELLS`` cells. No operator here uses that limit."""
    return None if len(a) * len(b) > MAX_CELLS else edit_steps(a, b)


def _rows(batches, *columns: str):
    """Rows of Arrow batches; few are held as Python's values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(batch.column(c).slice(at, SLICE).to_pylist() for c in columns))


def align_characters(pairs: DataFrame, key: list[str], ref: str, got: str) -> DataFrame:
    """One row per step of each pair's edit script: key, ``step, op, want, got``."""
    schema = StructType([*(pairs.schema[k] for k in key), StructField("step", IntegerType()), *(StructField(c, StringType()) for c in ("op", "want", "got"))])

    def aligned(batches):
        import pyarrow as pa

        types = to_arrow_schema(schema)

        def steps():
            for *k, a, b in _rows(batches, *key, ref, got):
                if a is not None and b is not None:
                    yield from ((*k, i, *s) for i, s in enumerate(edit_steps(a, b)))

        rows = steps()
        while part := list(islice(rows, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), types)], schema=types)

    return dealt(pairs.select(*key, ref, got)).mapInArrow(aligned, schema)


def substitution_counts(pairs: DataFrame, ref: str, got: str) -> DataFrame:
    """``substitutions`` of ``align_characters``, added up where the pairs are: no row per step is made."""

    def counted(batches):
        import pyarrow as pa

        def batch():
            return pa.RecordBatch.from_pydict({"want": [k[0] for k in n], "got": [k[1] for k in n], "n": pa.array(n.values(), pa.int64())})

        n: Counter = Counter()
        for a, b in _rows(batches, ref, got):
            if a is not None and b is not None:
                n.update(s[1:] for s in edit_steps(a, b) if s[0] != "match")
            if len(n) > OUT_ROWS:
                yield batch()
                n.clear()
        if n:
            yield batch()

    return dealt(pairs.select(ref, got)).mapInArrow(counted, "want string, got string, n long").groupBy("want", "got").agg(F.sum("n").alias("n"))


def substitutions(aligned: DataFrame) -> DataFrame:
    """Counts of what was wanted and what was read; one side is empty for a gap."""
    return aligned.filter("op <> 'match'").groupBy("want", "got").agg(F.count("*").alias("n"))


def aligned_words(pairs: DataFrame, key: list[str], ref: str, got: str) -> DataFrame:
    """For each token of the reference the position of the token read for it, or null."""
    schema = StructType([*(pairs.schema[k] for k in key), StructField("pos", IntegerType()), StructField("want", StringType()), StructField("at", IntegerType()), StructField("got", StringType())])

    def aligned(batches):
        import pyarrow as pa

        types = to_arrow_schema(schema)

        def words():
            for *k, x, y in _rows(batches, *key, "want", "read"):
                at, pos = 0, 0
                for op, want, read in edit_steps(x, y) if x is not None and y is not None else ():
                    if op != "ins":
                        yield (*k, pos, want, at, read) if op != "del" else (*k, pos, want, None, None)
                        pos += 1
                    at += op != "del"

        rows = words()
        while part := list(islice(rows, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), types)], schema=types)

    return dealt(pairs.select(*key, tokens(F.col(ref)).alias("want"), tokens(F.col(got)).alias("read"))).mapInArrow(aligned, schema)


def classify_word(want: Column, got: Column, identifier: Column, known: Column) -> Column:
    """In this order: exact; an identifier or a known word that was read as another; anything else."""
    other = got.isNotNull() & (got != "")
    return (
        F.when(want == got, "exact")
        .when(other & identifier, "rewritten_identifier")
        .when(other & known, "rewritten_lexicon")
        .otherwise("dropped_or_garbled")
    )


def line_pairs(pairs: DataFrame, key: list[str], ref: str, got: str) -> DataFrame:
    """Greedy one-to-one pairing of lines by normalised distance; ties by the lines' order.

    Then the lines that are left are folded into a neighbour while that lowers its distance.
    Returns ``key, errors, chars``: an error rate that forgives the reading order.
    """
    schema = ", ".join([*(f"{k} {dict(pairs.dtypes)[k]}" for k in key), "errors long", "chars long", "paired long"])

    def matched(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for *k, a, b in frame[[*key, ref, got]].itertuples(index=False):
                rows.append((*k, *line_matched_errors([s for s in (a or "").split("\n") if s], [s for s in (b or "").split("\n") if s])))
            yield pd.DataFrame(rows, columns=[*key, "errors", "chars", "paired"])

    return dealt(pairs.select(*key, ref, got)).mapInPandas(matched, schema)


def line_matched_errors(a: list[str], b: list[str]) -> tuple[int, int, int]:
    costs = sorted((distance(x, y) / max(len(x), len(y), 1), i, j) for i, x in enumerate(a) for j, y in enumerate(b))
    to: dict[int, list[int]] = {}
    used: set[int] = set()
    for _, i, j in costs:
        if i not in to and j not in used:
            to[i] = [j]
            used.add(j)
    paired = len(to)
    better = True
    while better:
        better = False
        for i, js in to.items():
            for j in (js[0] - 1, js[-1] + 1):
                if 0 <= j < len(b) and j not in used:
                    joined = sorted([*js, j])
                    old = distance(a[i], " ".join(b[q] for q in js)) + len(b[j])
                    if distance(a[i], " ".join(b[q] for q in joined)) < old:
                        js[:] = joined
                        used.add(j)
                        better = True
                        break
    errors = sum(distance(x, " ".join(b[j] for j in to[i])) if i in to else len(x) for i, x in enumerate(a))
    return errors + sum(len(s) for j, s in enumerate(b) if j not in used), sum(map(len, a)), paired
