"""Benchmark decontamination by a distributed positional inverted index (operator 1).

The index is built once, of the training texts alone, and is sharded by documents. A *segment* covers some
hundred thousand consecutive words of the corpus and is one row of a stored table: the ids and lengths of its
documents and, for every term (a word's 64-bit hash), the sorted positions at which it stands: its posting list.
Searching a segment starts, for each window, from the posting list of the window's rarest term
over the *whole corpus*, shifts it to the window's start, and intersects it with the shifted
lists of the other terms in order of rising frequency.

Benchmark items are cut into pieces that overlap by a window less one word. Pieces of up to
``max_window_words`` words of windows are sent to the workers at a time; a larger benchmark is searched in
several passes over the same index, and the partial results are merged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialise

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_OTHER = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
#: Bytes of a text whose words are held at once.
SLICE = 1 << 20
#: Positions between two documents of a segment.
GAP = 1_000
#: Bytes of segments that a scan holds at once.
BLOCK = 16 << 20
#: Candidate places of windows that are held at once.
PLACES = 1 << 19
SEGMENTS = (
    "doc_ids array<long>, mix array<long>, n_words array<int>, spread array<long>, terms array<long>, counts array<int>, positions binary"
)
HITS = "doc_id long, mix long, spread long, n_words long, hits array<int>, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) maximal runs of ASCII letters and digits and of non-ASCII characters."""
    return _WORD.findall(text.encode().lower()) if text else []


def word_hashes(text: str | None):
    """The 64-bit hash of each word, as an int64 array; the words of one slice are held at a time."""
    import numpy as np
    import xxhash

    raw = text.encode() if text else b""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        end = _OTHER.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = end.start() if end else len(raw)
        found = _WORD.findall(raw[at:end].lower())
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
        at = end
    return np.concatenate(parts).view(np.int64)


def windows(text: str | None, size: int) -> list[tuple[bytes, ...]]:
    """Runs of ``size`` consecutive words; a shorter text is one window, no words give none."""
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class PhraseSet:
    """Windows of benchmark items, as term numbers, with the items that each belongs to."""

    def __init__(self, items: list[tuple[str, list[int]]], size: int):
        import numpy as np

        found: dict[tuple[int, ...], set[str]] = {}
        for item, terms in items:
            for i in range(max(1, len(terms) - size + 1)) if terms else ():
                found.setdefault(tuple(terms[i : i + size]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.vocabulary = np.unique(np.array([t for w in found for t in w], np.int64))
        shape = (len(found), max(map(len, found), default=1))
        self.terms, self.offsets = np.full(shape, -1, np.int32), np.zeros(shape, np.int16)
        for i, w in enumerate(found):
            self.terms[i, : len(w)] = np.searchsorted(self.vocabulary, np.array(w, np.int64))
            self.offsets[i, : len(w)] = np.arange(len(w))

    def order_by_rarity(self, frequency: dict[int, int]) -> None:
        """Each window's terms with the rarest first (ties: the earlier in the window)."""
        import numpy as np

        count = np.array([frequency.get(int(t), 0) for t in self.vocabulary] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(count[self.terms], axis=1, kind="stable")  # -1, for no term, comes last
        self.terms, self.offsets = np.take_along_axis(self.terms, order, 1), np.take_along_axis(self.offsets, order, 1)


def match_segment(phrases: PhraseSet, terms, counts, positions, slop: int = 0):
    """``(window number, positions of its terms)`` of every occurrence in a segment, in no order; -1 is no term.

    ``terms`` (sorted), ``counts`` and ``positions`` are the segment's posting lists. ``slop`` 0 finds exact phrases. A
    larger one finds proximity matches: each further term at most ``slop`` words from its place in the
    phrase, counted from an occurrence of the rarest term; of several, the earliest. Terms may share one.
    """
    import numpy as np

    longest = phrases.terms.shape[1]
    none = np.zeros(0, np.int64), np.zeros((0, longest), np.int64)
    if not len(terms) or not len(phrases.terms):
        return none
    slot = np.minimum(np.searchsorted(terms, phrases.vocabulary), len(terms) - 1)
    present = np.append(terms[slot] == phrases.vocabulary, True)
    begins = np.cumsum(counts) - counts
    first, many = begins[slot], np.where(present[:-1], counts[slot], 0)
    # the lists of the benchmark's terms, one after another, in the order of their numbers
    own_begin = np.cumsum(many) - many
    at = np.repeat(first - own_begin, many) + np.arange(many.sum())
    keys = np.repeat(np.arange(len(many)), many) << 32 | positions[at].astype(np.int64)
    alive = np.flatnonzero(present[phrases.terms].all(1))
    out = [none]
    load = np.cumsum(many[phrases.terms[alive, 0]]) if len(alive) else np.zeros(0, np.int64)
    done = 0
    while done < len(alive):
        until = max(done + 1, int(np.searchsorted(load, (load[done - 1] if done else 0) + PLACES, side="right")))
        chosen, done = alive[done:until], until
        n = many[phrases.terms[chosen, 0]]
        which = np.repeat(chosen, n)
        base = np.repeat(own_begin[phrases.terms[chosen, 0]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = [keys[base] & 0xFFFFFFFF]
        starts = found[0] - phrases.offsets[which, 0]
        for k in range(1, longest):
            term = phrases.terms[which, k].astype(np.int64)
            place = starts + phrases.offsets[which, k]
            at = np.minimum(np.searchsorted(keys, term << 32 | np.maximum(place - slop, 0)), len(keys) - 1)
            there = np.where(term < 0, -1, keys[at] & 0xFFFFFFFF)
            kept = (term < 0) | ((keys[at] >> 32 == term) & (there >= place - slop) & (there <= place + slop))
            which, starts, found = which[kept], starts[kept], [f[kept] for f in (*found, there)]
        out.append((which, np.stack(found, 1)))
    return np.concatenate([w for w, _ in out]), np.concatenate([f for _, f in out])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = 400_000) -> DataFrame:
    """Store the posting lists of all words; one row per segment.

    Documents of a segment are ``GAP`` positions apart, so no window spans two. A document
    longer than ``segment_words`` is a segment of its own.
    """
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mix"), F.col(text_col).cast("string").alias("text"))

    def index(batches):
        import random

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        rng = random.Random(TaskContext.get().partitionId())
        schema = _segment_schema()

        def segment(held):
            ids, mix, spread, found = zip(*held)
            lengths = np.array([len(t) for t in found], np.int64)
            at = np.repeat(_starts(lengths) - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            flat = np.concatenate(found)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            cut = np.flatnonzero(np.diff(flat, prepend=flat[:1] - 1 if len(flat) else 0)) if len(flat) else np.zeros(0, np.int64)
            counts = np.diff(np.append(cut, len(flat)))
            columns = [pa.array(x, f.type) for x, f in zip(([list(ids)], [list(mix)], [lengths.tolist()], [list(spread)]), schema)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), pa.array(x)) for x in (flat[cut], counts.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([at[order].astype("<i4").tobytes()], pa.binary())], schema=schema)

        held, total = [], 0
        for batch in batches:
            for key, mix, text in zip(batch.column("doc_id").to_pylist(), batch.column("mix").to_pylist(), batch.column("text")):
                held.append((key, mix, rng.getrandbits(62), word_hashes(text.as_py())))
                total += len(held[-1][3])
                if total >= segment_words or len(held) >= 20_000:
                    yield segment(held)
                    held, total = [], 0
        if held:
            yield segment(held)

    return materialise(inputs.mapInArrow(index, SEGMENTS), "postings", BLOCK)


def _starts(lengths):
    """Where each document of a segment begins; documents are GAP apart."""
    import numpy as np

    return np.cumsum(lengths + GAP) - (lengths + GAP)


def _segment_schema():
    import pyarrow as pa

    return pa.schema(
        [("doc_ids", pa.list_(pa.int64())), ("mix", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("spread", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())]
    )


def term_frequencies(index: DataFrame, vocabulary) -> dict[int, int]:
    """Occurrences in the whole corpus of the given terms (a sorted array): no more rows than there are terms."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
            at = np.searchsorted(shared.value, terms)
            known = shared.value[np.minimum(at, len(shared.value) - 1)] == terms
            sums += np.bincount(at[known], counts[known], len(sums)).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[some]), pa.array(sums[some])], names=["term", "n"])

    if not len(vocabulary):
        return {}
    rows = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in rows.collect()}


def search_index(index: DataFrame, phrases: PhraseSet, slop: int = 0) -> DataFrame:
    """Per document: its words, the hit word numbers, and the items that have a window in it."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("mix", pa.int64()), ("spread", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
        sought = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("doc_ids", "mix", "n_words", "spread", "terms", "counts")}
                lengths = row["n_words"].astype(np.int64)
                begins = _starts(lengths)
                which, places = match_segment(sought, row["terms"], row["counts"].astype(np.int64), np.frombuffer(batch.column("positions")[at].as_buffer(), "<i4"), slop)
                doc = np.searchsorted(begins, places[:, 0], side="right") - 1
                # empty documents share no position with others: each has GAP of its own
                hits: list = [[] for _ in lengths]
                items: list = [[] for _ in lengths]
                order = np.argsort(doc, kind="stable")
                doc, which, places = doc[order], which[order], places[order]
                edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    d = int(doc[lo])
                    marked = np.unique(places[lo:hi])
                    hits[d] = (marked[marked >= 0] - begins[d]).tolist()
                    items[d] = sorted({i for w in np.unique(which[lo:hi]) for i in sought.items[w]})
                ids = batch.column("doc_ids")[at].values  # ids may be null
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["mix"]), pa.array(row["spread"]), pa.array(lengths), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], schema=schema)

    return index.mapInArrow(search, HITS)


def _pieces(benchmark: DataFrame, size: int, piece_words: int, item_col: str, text_col: str) -> DataFrame:
    """``item, piece, terms``: items in pieces of bounded length that have all their windows, stored."""
    inputs = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null and item is not null")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                terms = word_hashes(text.as_py())
                for n, at in enumerate(range(0, max(1, len(terms) - size + 1), piece_words)):
                    part = terms[at : at + piece_words + size - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], pa.string()), pa.array([n], pa.int32()), pa.array([part], pa.list_(pa.int64()))], names=["item", "piece", "terms"])

    return materialise(inputs.mapInArrow(cut, "item string, piece int, terms array<long>").filter("size(terms) > 0"), "benchmark-pieces")


def _partitions(pieces: DataFrame, max_window_words: int, size: int):
    """Lists of (item, terms), each of about ``max_window_words`` words of windows, that together hold all pieces."""
    volume = pieces.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    parts = max(1, -(-volume * size // max_window_words))
    for p in range(parts):
        yield [(r.item, r.terms) for r in pieces.filter(F.pmod(F.xxhash64("item", "piece", "terms"), F.lit(parts)) == p).select("item", "terms").collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    slop: int = 0,
    max_window_words: int = 8_000_000,
    id_col: str = "doc_id",
    item_col: str = "item_id",
) -> DataFrame:
    """Find the windows of ``benchmark`` items in whole documents.

    One row per document row: ``doc_id, n_words, n_hit, items`` (sorted as strings), and ``mix``,
    the hash of its text. Null or
    wordless texts have no words; null items and items without words match nothing; repeated
    rows each get a row; an empty benchmark hits nothing. Other columns are ignored. With ``slop``, windows match
    where their words are that much out of place, and the words that matched are hit. Words are told apart by a 64-bit hash.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window and slop must stay under {GAP} words")
    index = build_index(docs, id_col)
    merged = None
    for items in _partitions(_pieces(benchmark, window, max(1, max_window_words // (8 * window)), item_col, "text"), max_window_words, window):
        phrases = PhraseSet(items, window)
        phrases.order_by_rarity(term_frequencies(index, phrases.vocabulary))
        found = search_index(index, phrases, slop)
        merged = found if merged is None else merged.unionByName(found)
    one = merged.withColumn("n_hit", F.size("hits").cast("long"))
    if merged is not found:
        # spread tells rows of the index apart
        one = (
            merged.groupBy("doc_id", "mix", "spread", "n_words")
            .agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .withColumn("n_hit", F.size("hits").cast("long"))
        )
    return one.select("doc_id", "n_words", "n_hit", "items", "mix")
