"""Nearest-prototype search with gates, quantised banks and style-consistent labels.

The prototype bank is a model, so it goes to the queries: broadcast while it is under ``BANK_BYTES``, else in
slices of that size, one after another, whose best candidates are stored and merged. The search
is one matrix product for each ``STEP`` queries and ``BLOCK`` prototypes; nothing quadratic is emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

BANK_BYTES = 64 << 20
#: Queries and prototypes of one matrix product.
STEP, BLOCK = 64, 8192
#: Rows of a class table up to which it is broadcast.
CLASS_ROWS = 100_000


def _slices(bank: DataFrame, vector: str):
    """The number of slices, and the bank as Arrow tables, each within the bound. Null vectors are nobody's prototypes."""
    bank = bank.filter(F.col(vector).isNotNull())
    n, size = bank.agg(F.count("*"), F.sum(F.size(vector) * 8)).first()
    parts = max(1, -(-(size or 0) // BANK_BYTES))
    for p in range(parts):
        yield parts, (bank if parts == 1 else bank.filter(F.pmod(F.xxhash64("proto_id"), F.lit(parts)) == p)).orderBy("proto_id").toArrow()


def _packed(table, gate: bool, exclude: str | None):
    """A slice as arrays, by class and then in its order, without vectors that aren't finite; and the classes' names."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.combine_chunks()
    vectors = np.empty((0, 1))
    if table.num_rows:
        vectors = pc.list_flatten(table["vec"]).to_numpy().reshape(table.num_rows, -1)
    kind = table.schema.field("class").type
    names = pa.array(sorted(pc.unique(table["class"]).to_pylist(), key=lambda c: (c is None, c)), kind)
    inverse = pc.index_in(table["class"], names).to_numpy().astype(np.int64)
    order = np.argsort(inverse, kind="stable")
    order = order[np.isfinite(vectors).all(1)[order]]
    columns = [table[c].to_numpy()[order] if c else None for c in ("holes" if gate else None, exclude)]
    return vectors[order], inverse[order], names, table["proto_id"].combine_chunks().take(pa.array(order)), *columns


def class_distances(queries: DataFrame, bank: DataFrame, weights: list[float] | None = None, gate: bool = False, exclude: str | None = None) -> DataFrame:
    """Per query and class the least distance and the first prototype that has it.

    ``queries(q, vec[, hole][, exclude])``, ``bank(proto_id, class, vec[, holes][, exclude])``. Distances are
    weighted, summed in double and rooted, then rounded to float, so ties are ties of floats. With
    ``gate``, only classes whose mask has the query's hole bit; the gate is dropped where it leaves none. Prototypes whose
    ``exclude`` column equals the query's are left out. Queries with a component that isn't finite have no rows.
    """
    extra = [c for c in (("hole",) if gate else ()) + ((exclude,) if exclude else ())]
    kinds = dict(queries.dtypes)
    schema = f"q {kinds['q']}, class {dict(bank.dtypes)['class']}, d double, proto_id {dict(bank.dtypes)['proto_id']}, gated boolean"
    # vectors are small and a search is long, so queries are dealt over all cores and not by bytes
    dealt = queries.filter("vec is not null").select("q", F.col("vec").cast("array<double>").alias("vec"), *extra).repartition(4 * queries.sparkSession.sparkContext.defaultParallelism)
    found = None
    for parts, rows in _slices(bank.withColumn("vec", F.col("vec").cast("array<double>")), "vec"):
        shared = queries.sparkSession.sparkContext.broadcast(_packed(rows, gate, exclude))

        def search(frames, shared=shared):
            import numpy as np
            import pandas as pd
            import pyarrow as pa

            bank_, inverse, names, protos, masks, marks = shared.value
            w = np.ones(bank_.shape[1]) if weights is None else np.array(weights, float)
            blocks = [slice(at, at + BLOCK) for at in range(0, len(bank_), BLOCK)]
            norms = np.concatenate([np.empty(0), *((bank_[b] ** 2) @ w for b in blocks)])

            def open_to(part, gated, b):
                """Where a query may meet a prototype of the block."""
                ok = np.ones((len(part), len(bank_[b])), bool)
                if marks is not None:
                    ok &= marks[b][None, :] != part[exclude].to_numpy()[:, None]
                if masks is not None:
                    ok &= ((masks[b][None, :] >> part["hole"].to_numpy().astype(int)[:, None]) & 1 == 1) | ~gated[:, None]
                return ok

            def apart(x, i, k):
                """Distances of pairs, a bounded number at a time."""
                d = [np.sqrt((((bank_[k[at : at + BLOCK]] - x[i[at : at + BLOCK]]) ** 2) * w).sum(1)) for at in range(0, len(i), BLOCK)]
                return np.concatenate([np.empty(0), *d]).astype(np.float32)

            def first(i, k, d):
                """Of each query and class the least distance, and the first that has it."""
                best = np.lexsort((k, d, inverse[k], i))
                best = best[np.flatnonzero(np.diff(i[best] * len(names) + inverse[k[best]], prepend=-1))]
                return i[best], k[best], d[best]

            for frame in frames:
                for at in range(0, len(frame), STEP):
                    part = frame.iloc[at : at + STEP]
                    x = np.array(part["vec"].tolist(), float).reshape(len(part), -1)
                    part, x = part[np.isfinite(x).all(1)], x[np.isfinite(x).all(1)]
                    if not len(x) or not blocks:
                        continue
                    # squared distances as one product a block; where they come near the least, they are summed again
                    own, gated, every = (x**2) @ w, np.zeros(len(x), bool), np.ones(len(x), bool)
                    if masks is not None:
                        for b in blocks:
                            gated |= open_to(part, every, b).any(1)
                    found = []
                    for b in blocks:
                        rough = (x * w) @ bank_[b].T
                        rough *= -2
                        rough += norms[b]
                        if marks is not None or masks is not None:
                            rough[~open_to(part, gated, b)] = np.inf
                        begins = np.flatnonzero(np.diff(inverse[b], prepend=-1))
                        lows = np.minimum.reduceat(rough, begins, axis=1)
                        least = np.maximum(lows + own[:, None], 0)
                        room = least * 1e-6 + 1e-11 * (own[:, None] + np.maximum.reduceat(norms[b], begins)[None, :])
                        ends = np.where(np.isfinite(lows), least + room - own[:, None], -np.inf)
                        i, k = np.nonzero(rough <= np.repeat(ends, np.diff(begins, append=rough.shape[1]), axis=1))
                        k += b.start
                        found.append(first(i, k, apart(x, i, k)))
                    i, k, d = first(*(np.concatenate(c) for c in zip(*found)))
                    yield pd.DataFrame({"q": part["q"].to_numpy()[i], "class": names.take(pa.array(inverse[k])).to_pandas(), "d": d.astype(float), "proto_id": protos.take(pa.array(k)).to_pandas(), "gated": gated[i]})

        part = dealt.mapInPandas(search, schema)
        if parts > 1:  # one slice is sent, searched and stored after another
            part = materialise(part, "slice-distances")
            shared.unpersist()
        found = part if found is None else found.union(part)
    if parts > 1:
        if gate:
            # a slice's gate may have been dropped where another slice has classes that it admits
            admitted = found.groupBy("q").agg(F.max("gated").alias("any"))
            found = found.join(admitted, "q").filter("gated = any").drop("any")
        found = found.groupBy("q", "class").agg(F.min(F.struct("d", "proto_id", "gated")).alias("b")).select("q", "class", "b.*")
    return found


def top_classes(distances: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest classes (ties: the lower class), with the two least distances of all classes."""
    w = Window.partitionBy("q").orderBy("d", "class")
    ranked = distances.withColumns({"rank": F.row_number().over(w), "second": F.lead("d").over(w)})
    both = Window.partitionBy("q")
    ends = ranked.withColumns({"d1": F.min("d").over(both), "d2": F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("second"))).over(both), F.lit(float("inf")))})
    return ends.filter(F.col("rank") <= k).drop("second")


def ratio(d1: Column, d2: Column) -> Column:
    """0 without a rival, 1 where the rival is at distance 0."""
    return F.when(d2 == float("inf"), 0.0).when(d2 == 0, 1.0).otherwise(d1 / d2)


def class_gates(glyphs: DataFrame) -> DataFrame:
    """Per class: least and largest measure, and the holes seen as a bit mask."""
    return glyphs.groupBy("class").agg(F.min("aspect").alias("lo"), F.max("aspect").alias("hi"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("hole"))).alias("holes"))


def admitted(queries: DataFrame, gates: DataFrame, slack: float) -> DataFrame:
    """Classes whose range, widened by ``slack``, and whose hole mask admit a query.

    A class table of up to ``CLASS_ROWS`` is broadcast and the query side isn't moved; a larger one is a join without equality.
    """
    gates = materialise(gates, "gates")
    gates = F.broadcast(gates) if gates.limit(CLASS_ROWS + 1).count() <= CLASS_ROWS else gates
    bit = F.call_function("shiftleft", F.lit(1), F.col("hole"))
    return queries.join(gates, (F.col("aspect") >= F.col("lo") - slack) & (F.col("aspect") <= F.col("hi") + slack) & (F.col("holes").bitwiseAND(bit) != 0)).select("q", gates["class"])


def quantise(vectors: DataFrame, vector: str) -> DataFrame:
    """Per-column 8-bit codes: the scale is the column's largest size over 127. ``dim, scale``."""
    return vectors.select(F.posexplode(vector).alias("dim", "e")).groupBy("dim").agg((F.max(F.abs(F.col("e").cast("double"))) / 127).alias("scale"))


def codes(vector: Column, scales: Column) -> Column:
    return F.zip_with(vector.cast("array<double>"), scales, lambda v, s: F.when(s > 0, F.round(v / s)).otherwise(0.0).cast("tinyint"))


def dequantised(code: Column, scales: Column) -> Column:
    return F.zip_with(code, scales, lambda c, s: c * s)


def row_scale(vector: Column) -> Column:
    return F.array_max(F.transform(vector.cast("array<double>"), lambda v: F.abs(v))) / 127


def confusion(pairs: DataFrame, truth: str, read: str) -> DataFrame:
    return pairs.groupBy(truth, read).agg(F.count("*").alias("n"))


def style_labels(distances: DataFrame) -> DataFrame:
    """One face per field: that with the least sum of distances, if it has a candidate for each glyph.

    ``distances(field, glyph, face, class, d)`` holds each glyph's best class per face. Returns
    ``field, glyph, face, class``; ties go to the lower face.
    """
    size = distances.groupBy("field").agg(F.count_distinct("glyph").alias("size"))
    sums = distances.groupBy("field", "face").agg(F.sum("d").alias("total"), F.count_distinct("glyph").alias("n")).join(size, "field").filter("n = size")
    best = sums.groupBy("field").agg(F.min(F.struct("total", "face")).alias("b")).select("field", F.col("b.face").alias("face"))
    return distances.join(best, ["field", "face"]).select("field", "glyph", "face", "class")


def category_veto(words: DataFrame) -> DataFrame:
    """A digit/letter change of one character is vetoed if all others of its word keep the old category.

    ``words(word, pos, category, other)``: ``other`` is the category after relabelling.
    """
    w = Window.partitionBy("word")
    known = F.count("category").over(w)
    # one category in all of the word (or none at all), told by a single sort of the words
    alone = (known == 0) | ((known == F.count("*").over(w)) & (F.min("category").over(w) == F.max("category").over(w)))
    return words.withColumn("vetoed", (F.col("category") != F.col("other")) & alone)


def route(confidence: Column, probability: Column, same: Column, margin: float = 0.7, least: float = 0.7) -> Column:
    """Take the network's class where the matcher is unsure and the network sure and of another mind."""
    return (confidence < margin) & (probability >= least) & ~same


def network_candidates(logits: DataFrame, junk: int, k: int = 3, scale: float = 1.0) -> DataFrame:
    """Best classes but junk: rank, distance ``-logp * scale`` and the margin of the first two."""
    w = Window.partitionBy("q").orderBy(F.desc("logp"), "class")
    ranked = logits.filter(F.col("class") != junk).withColumns({"rank": F.row_number().over(w), "next": F.lead("logp").over(w)})
    margin = F.max(F.when(F.col("rank") == 1, F.col("logp") - F.col("next"))).over(Window.partitionBy("q"))
    return ranked.withColumn("margin", margin).filter(F.col("rank") <= k).select("q", "class", "rank", (-F.col("logp") * scale).alias("d"), "margin")
