"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

A document's score is ``sigmoid(base + sum of one lookup per feature + one per feature pair)``.
The tables are learned by cyclic boosting: round after round, each feature in turn gets a
shallow tree on the current residuals, whose leaves are added into the feature's table; then
the pairs that the residuals favour get two-way trees in the same manner. Scoring bins the features
and adds table entries, whole batches at a time.

Labels come from at most ``max_rows`` labelled documents outside the held-out fold, those with the least
hash of the id: that bounds the driver's share. All documents are read, measured and scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quillspark.storage import materialise

FEATURES = (
    "log_words", "log_lines", "mean_word", "mean_line", "upper", "digit", "symbol", "mark", "comma_stop", "wide", "space",
    "distinct_words", "top_word", "short_words", "long_words", "all_upper_words", "repeated_lines", "repeated_triples", "entropy", "compressed", "longest_run", "line_stops",
)
_RUN = re.compile(rb"([^\s])\1{3,}")
_LINE = re.compile("\n")


#: Characters of a text whose words or lines are held at once.
SLICE = 1 << 20
_SPACE = re.compile(r"\s")


def _slices(text: str, pattern: re.Pattern):
    """Parts of a text of about ``SLICE`` characters, cut where the pattern stands."""
    at = 0
    while at < len(text):
        end = pattern.search(text, at + SLICE) if at + SLICE < len(text) else None
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end


def _hashes(words):
    import numpy as np

    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def measure(text: str | None) -> list[float]:
    """The features of a whole text; an empty or null one has zeros.

    Words and lines of one slice are held at a time; of the whole text, a 64-bit hash for each.
    """
    import math
    import zlib

    import numpy as np

    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    every = np.frombuffer(raw, np.uint8)
    byte = sum(np.bincount(every[at : at + SLICE], minlength=256) for at in range(0, n, SLICE))
    letters = int(byte[65:91].sum() + byte[97:123].sum() + byte[128:].sum())
    marks = int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum())
    plain = int(byte[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    share = byte[byte > 0] / n
    hashed, shorts, longs, loud = [], 0, 0, 0
    for part in _slices(text, _SPACE):
        words = part.split()
        hashed.append(_hashes(words))
        for w, c in Counter(words).items():
            shorts += c * (len(w) <= 3)
            longs += c * (len(w) >= 13)
            loud += c * (w.isupper() and len(w) > 1)
    lined, stops = [], 0
    for part in _slices(text, _LINE):
        lines = [s for s in part.split("\n") if s]
        lined.append(_hashes(lines))
        stops += sum(s[-1] in ".!?" for s in lines)
    word = np.concatenate(hashed)
    line = np.concatenate(lined)
    m = len(word)
    counts = np.unique(word, return_counts=True)[1]
    # a triple of words by a mix of their hashes that tells their order
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    triples = len(np.unique(word[:-2] * odd[0] + word[1:-1] * odd[1] + word[2:] * odd[2])) if m > 2 else 0
    return [
        math.log1p(m),
        math.log1p(len(line)),
        n / m,
        m / len(line),
        byte[65:91].sum() / max(letters, 1),
        byte[48:58].sum() / n,
        (marks - plain) / n,
        byte[33] / n + byte[63] / n,
        (byte[44] + byte[46]) / m,
        byte[128:].sum() / n,
        (byte[32] + byte[9] + byte[10]) / n,
        len(counts) / m,
        counts.max() / m,
        shorts / m,
        longs / m,
        loud / m,
        1 - len(np.unique(line)) / len(line),
        1 - triples / (m - 2) if m > 2 else 0.0,
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / n,
        math.log1p(max((len(x.group()) for x in _RUN.finditer(raw)), default=0)),
        stops / len(line),
    ]


@dataclass
class AdditiveModel:
    """Bin edges, a table per feature, and a table per pair of features over coarser bins."""

    base: float
    edges: list
    tables: list
    pairs: list
    pair_edges: list
    pair_tables: list

    def score(self, x):
        import numpy as np

        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_edges[f], x[:, f], side="right")
            b = np.searchsorted(self.pair_edges[g], x[:, g], side="right")
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantile_edges(x, bins: int):
    import numpy as np

    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]


def _leaf(g, h, ridge: float):
    return g / (h + ridge)


def _tree(g, h, leaves: int, ridge: float):
    """Values per bin of a best-first tree with at most ``leaves`` leaves over ordered bins."""
    import numpy as np

    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a, b):
        if b - a < 2:
            return 0.0, a
        left_g, left_h = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        all_g, all_h = cg[b] - cg[a], ch[b] - ch[a]
        gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + 1 + k

    spans = {(0, len(g)): best(0, len(g))}
    while len(spans) < leaves:
        span = max(spans, key=lambda s: spans[s][0])
        gain, cut = spans[span]
        if gain <= 1e-9:
            break
        del spans[span]
        spans[span[0], cut], spans[cut, span[1]] = best(span[0], cut), best(cut, span[1])
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a], ridge)
    return out


def _pair_tree(g, h, ridge: float):
    """Values of the best cut on one axis followed by the best cut of each half on the other."""
    import numpy as np

    best_gain, best_table = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        cg, ch = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for cut in range(1, len(gg)):
            table, gain = np.zeros_like(gg), 0.0
            for part, (pg, ph) in ((slice(0, cut), (cg[cut - 1], ch[cut - 1])), (slice(cut, None), (cg[-1] - cg[cut - 1], ch[-1] - ch[cut - 1]))):
                row = _tree(pg, ph, 2, ridge)
                table[part] = row
                gain += float((row * pg).sum())
            if gain > best_gain:
                best_gain, best_table = gain, table.T if turned else table
    return best_gain, best_table


def fit_additive(x, y, rounds: int = 120, rate: float = 0.1, bins: int = 48, leaves: int = 3, pair_bins: int = 8, pairs: int = 6, pair_rounds: int = 30, ridge: float = 2.0) -> AdditiveModel:
    """Learn the tables; without rows, or with one class, the score is constant."""
    import numpy as np

    edges, pair_edges = (_quantile_edges(x, bins), _quantile_edges(x, pair_bins)) if len(x) else ([np.zeros(0)] * x.shape[1],) * 2
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = AdditiveModel(float(np.log(mean / (1 - mean))), edges, tables, [], pair_edges, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f, table in enumerate(tables):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(binned[f], y - p, len(table))
            h = np.bincount(binned[f], p * (1 - p), len(table))
            step = rate * _tree(g, h, leaves, ridge)
            table += step
            total += step[binned[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    p = 1 / (1 + np.exp(-total))

    def grids(f, k, p):
        shape = (len(pair_edges[f]) + 1, len(pair_edges[k]) + 1)
        code = coarse[f] * shape[1] + coarse[k]
        return [np.bincount(code, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p))]

    gains = {(f, k): _pair_tree(*grids(f, k, p), ridge)[0] for f in range(len(edges)) for k in range(f)}
    model.pairs = sorted(gains, key=lambda q: (-gains[q], q))[:pairs]
    model.pair_tables = [np.zeros((len(pair_edges[f]) + 1, len(pair_edges[k]) + 1)) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for (f, k), table in zip(model.pairs, model.pair_tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _pair_tree(*grids(f, k, p), ridge)[1]
            table += step
            total += step[coarse[f], coarse[k]]
    return model


def _rows(texts):
    """The features of a column of texts, a row for each."""
    import numpy as np

    return np.array([measure(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))


def _fold(id_column):
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on labelled documents outside fold 0. Several labels of a document count as their mean, cut at 0.5.

    Only ids are read to choose the documents, and only the chosen ones are measured. Of rows with equal ids, that with the
    least hash of its text is taken (a null text before all others).
    """
    import numpy as np

    one = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label")).filter("label is not null and id is not null")
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    labelled = ids.join(one.filter(_fold(F.col("id")) != 0), "id").distinct()
    chosen = materialise(labelled.orderBy(F.xxhash64("id"), "id").limit(max_rows), "training-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most max_rows ids are broadcast
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.struct(F.col("text").isNotNull(), F.xxhash64("text"))).alias("text"), F.first("label").alias("label"))

    def measured(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(_rows(batch.column("text")).tolist(), pa.list_(pa.float64()))], names=["id", "label", "features"])

    rows = found.select("id", "label", "text").mapInArrow(measured, "id long, label int, features array<double>").collect()
    rows.sort(key=lambda r: r.id)
    x = np.array([r.features for r in rows], float).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array([r.label for r in rows], float))


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 30_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row, stored: ``doc_id, held_out, score, predicted``.

    Empty and null texts are scored like any other; a null id counts as the empty string in
    the fold and has no label; repeated rows get a row each; without usable labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, max_rows, id_col, text_col))

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(shared.value.score(_rows(batch.column("text")))))], names=["doc_id", "score"])

    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scores = materialise(inputs.mapInArrow(scored, "doc_id long, score double"), "scores")
    return scores.select("doc_id", (_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 30_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns, in one pass without a shuffle.

    Rows are scored as in ``score_documents``; repeated rows stay or go together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label_col, max_rows, id_col, text_col))
    at = docs.columns.index(text_col)

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(_rows(batch.column("row").field(at))) >= threshold))

    # the row travels as one column, so that no column of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(kept, StructType([StructField("row", docs.schema)])).select("row.*")
