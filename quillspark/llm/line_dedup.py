"""Line deduplication by pairwise alignment (operator 5).

Deleted are blocks of consecutive lines with at least ``min_words`` words that an earlier document has
too, lines being equal but for white space around them; blank lines match blank lines.

*Pairs.* The documents of each line (blank ones aside) are counted; one that a single document has breaks every block.
Between such lines, each *run* (from each line on, and back from each line, the fewest lines that reach
``min_words``) is listed under its rarest line, that of the fewest documents, with the run's own hash beside it. Two
documents with a common block have a run in common, so the same rare line, and meet there. The holders of a run aren't
paired with one another but each with the first of them, the least id: a passage in a third of all documents
makes one pair for each of them. No block is lost by it, for each of its runs has a first holder.

*Alignment.* The runs that a pair shares say which lines match. Patience diff takes the lines that match just one line
on either side, keeps a longest increasing sequence of them, grows it along equal lines, and
aligns what lies between in the same manner. The runs that it holds whole make up the aligned blocks of ``min_words``
words, and these go from the later document. With ``moved`` (the default) the other runs are aligned again, so
that blocks in another order go too; after ``ROUNDS`` rounds what is left is aligned run by run.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.storage import materialise

#: Odd multiplier of the runs' polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Alignments of a pair before the rest is taken block by block.
ROUNDS = 8


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        tails[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience_diff(matches: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """An alignment: matches ``(line, earlier line)`` that increase on both sides, in order.

    Lines that match one line only, on both sides, are anchors. Where there are none, all
    matches are candidates, the nearest earlier line first.
    """
    out: list[tuple[int, int]] = []
    todo = [sorted(matches)]
    while todo:
        part = todo.pop()
        ours: dict[int, int] = {}
        theirs: dict[int, int] = {}
        for i, j in part:
            ours[i] = ours.get(i, 0) + 1
            theirs[j] = theirs.get(j, 0) + 1
        anchors = [(i, j) for i, j in part if ours[i] == 1 == theirs[j]]
        if not anchors:  # for a line, the later of its matches come first, so that only one of them increases
            part.sort(key=lambda m: (m[0], -m[1]))
            out += [part[k] for k in longest_increasing([j for _, j in part])]
            continue
        have, kept = set(part), []
        for i, j in (anchors[k] for k in longest_increasing([j for _, j in anchors])):
            if kept and (i <= kept[-1][0] or j <= kept[-1][1]):
                continue  # grown over already
            back = []
            while (i - len(back) - 1, j - len(back) - 1) in have and not (kept and (i - len(back) - 1 <= kept[-1][0] or j - len(back) - 1 <= kept[-1][1])):
                back.append((i - len(back) - 1, j - len(back) - 1))
            kept += back[::-1] + [(i, j)]
            while (kept[-1][0] + 1, kept[-1][1] + 1) in have:
                kept.append((kept[-1][0] + 1, kept[-1][1] + 1))
        out += kept
        gaps: dict[int, list[tuple[int, int]]] = {}
        for i, j in part:
            k = bisect_left(kept, (i, j))
            if (k == 0 or (kept[k - 1][0] < i and kept[k - 1][1] < j)) and (k == len(kept) or (i < kept[k][0] and j < kept[k][1])):
                gaps.setdefault(k, []).append((i, j))
        todo += gaps.values()
    return sorted(out)


def aligned_runs(runs: list[tuple[int, int, int]], moved: bool) -> list[tuple[int, int, int]]:
    """Those of a pair's shared runs ``(line, earlier line, lines)`` that an alignment holds whole, sorted.

    A run has just the words that it takes, so an aligned block has enough of them if and only if it holds one,
    and each line of such a block is in one. ``moved``: the runs left over are aligned again, until none is.
    """
    left, out = sorted(set(runs)), []
    for _ in range(ROUNDS if moved else 1):
        aligned = set(patience_diff({(i + k, j + k) for i, j, n in left for k in range(n)}))
        whole = [all((i + k, j + k) in aligned for k in range(n)) for i, j, n in left]
        out += [r for r, w in zip(left, whole) if w]
        left = [r for r, w in zip(left, whole) if not w]
        if not left or not any(whole):
            break
    return sorted(out + left if moved else out)


def covered(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ``(first, length)`` blocks as disjoint ``(first, end)`` ranges, in order."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(blocks):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], first + n)
        else:
            out.append((first, first + n))
    return out


def minimal_runs(hashes, sizes, blanks, begins, min_words: int):
    """Minimal runs of many stretches of lines at once: ``start, end, hash``, by their start.

    ``hashes``, ``sizes`` and ``blanks``: of the lines of all stretches, one after another, and of the number of
    blank lines before each, which the hash covers inside a run; ``begins``: where each stretch begins, and the end.
    """
    import numpy as np

    n = len(hashes)
    words = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.arange(n)
    ends = np.searchsorted(words, words[:-1] + min_words, side="left")
    on = ends <= begins[owner + 1]
    starts = np.searchsorted(words, words[1:] - min_words, side="right") - 1
    back = starts >= begins[owner]
    code = np.unique(np.concatenate([at[on] * (n + 1) + ends[on], starts[back] * (n + 1) + at[back] + 1]))
    start, end = code // (n + 1), code % (n + 1)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
    own = hashes.view(np.uint64) + blanks.astype(np.uint64) * np.uint64(BASE)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * power[:n])])
    inner = (prefix[end] - prefix[start + 1]) * inverse[start]
    return start, end, (inner + hashes.view(np.uint64)[start]).view(np.int64)


def rarest_lines(start, end, hashes, holders):
    """For each run, the hash of its line that the fewest documents have (ties: the least hash)."""
    import numpy as np

    best = start.copy()
    todo, k = np.flatnonzero(end - start > 1), 1
    while len(todo):
        at = start[todo] + k
        better = (holders[at] < holders[best[todo]]) | ((holders[at] == holders[best[todo]]) & (hashes[at] < hashes[best[todo]]))
        best[todo[better]] = at[better]
        k += 1
        todo = todo[end[todo] - start[todo] > k]
    return hashes[best]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mix, lines`` (number, hash, words and blank lines before, of each line that isn't blank), stored."""
    inputs = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mix"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            begins, numbers, hashes = [0], [], []
            for text in batch.column("text"):
                before = -1
                for pos, line in enumerate(text.as_buffer().to_pybytes().split(b"\n")):
                    if words := len(line.split()):
                        numbers.append((pos, words, pos - before - 1))
                        hashes.append(xxhash.xxh64_intdigest(line.strip()))
                        before = pos
                begins.append(len(hashes))
            pos, words, blanks = (pa.array(c) for c in np.array(numbers, np.int32).reshape(-1, 3).T.copy())
            flat = pa.StructArray.from_arrays([pos, pa.array(np.array(hashes, np.uint64).view(np.int64)), words, blanks], names=["pos", "hash", "words", "blanks"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mix"), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), flat)], names=["doc_id", "mix", "lines"])

    return materialise(inputs.mapInArrow(hashed, "doc_id long, mix long, lines array<struct<pos:int,hash:long,words:int,blanks:int>>"), "lines")


def _runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """``rare, run, n, doc_id, mix, pos``: the runs of lines that several documents have, stored; ``n`` lines from ``pos``."""
    lines = _lines(docs, id_col, text_col)
    holders = lines.select(F.explode(F.array_distinct("lines.hash")).alias("hash")).groupBy("hash").agg(F.count("*").alias("holders")).filter("holders > 1")
    each = lines.select("doc_id", "mix", F.explode("lines").alias("line")).select("doc_id", "mix", "line.*")
    common = each.join(holders.hint("merge"), "hash").groupBy("doc_id", "mix").agg(F.array_sort(F.collect_set(F.struct("pos", "hash", "words", "blanks", "holders"))).alias("lines"))

    def find(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("lines")
            begins = column.offsets.to_numpy().astype(np.int64)
            pos, hashes, words, blanks, holders = (c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten())
            owner = np.repeat(np.arange(batch.num_rows), np.diff(begins))
            cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(pos) != 1 + blanks[1:])) + 1
            start, end, value = minimal_runs(hashes, words, blanks, np.concatenate([[0], cut, [len(pos)]]), max(1, min_words))
            data = [rarest_lines(start, end, hashes, holders), value, pos[end - 1] - pos[start] + 1, *(batch.column(c).to_numpy()[owner[start]] for c in ("doc_id", "mix")), pos[start]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["rare", "run", "n", "doc_id", "mix", "pos"])

    return materialise(common.mapInArrow(find, "rare long, run long, n int, doc_id long, mix long, pos int"), "runs")


def line_duplicates(docs: DataFrame, min_words: int = 50, moved: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mix, ranges, n_deleted``: line numbers to delete (first, end), for documents that have any.

    ``mix`` is the hash of the text: with the id it names a row, and equal rows share a decision.
    """
    key = ["rare", "run", "n"]
    runs = _runs(docs, min_words, id_col, text_col)
    first = (
        runs.groupBy(*key)
        .agg(F.min(F.struct("doc_id", "mix", "pos")).alias("first"), F.max("doc_id").alias("last_id"))
        .filter("last_id > first.doc_id")
        .select(*key, F.col("first.doc_id").alias("holder"), F.col("first.mix").alias("holder_mix"), F.col("first.pos").alias("holder_pos"))
    )
    first = materialise(first, "first-holders")
    matches = (
        runs.join(first.hint("merge"), key)
        .filter("doc_id > holder")
        .groupBy("doc_id", "mix")
        .agg(F.collect_set(F.struct("holder", "holder_mix", "pos", "holder_pos", "n")).alias("matches"))
    )

    def decide(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            ranges = [_ranges(m.as_py(), moved) for m in batch.column("matches")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mix"), pa.array([[{"first": a, "end": b} for a, b in r] for r in ranges], kind), pa.array([sum(b - a for a, b in r) for r in ranges], pa.int32())],
                names=["doc_id", "mix", "ranges", "n_deleted"],
            )

    return materialise(matches.mapInArrow(decide, "doc_id long, mix long, ranges array<struct<first:int,end:int>>, n_deleted int").filter("n_deleted > 0"), "duplicate-lines")


def _ranges(matches: list[dict], moved: bool) -> list[tuple[int, int]]:
    """Line numbers to delete from a document, given the runs it shares with their first holders."""
    partners: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for m in matches:
        partners.setdefault((m["holder"], m["holder_mix"]), []).append((m["pos"], m["holder_pos"], m["n"]))
    return covered([(pos, n) for runs in partners.values() for pos, _, n in aligned_runs(runs, moved)])


def dedup_lines(docs: DataFrame, min_words: int = 50, moved: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated blocks deleted from ``text``, plus ``lines_total`` and ``lines_deleted``.

    Null texts and ids are passed through, as are blank lines unless inside a deleted block's
    place; documents with equal ids aren't paired with each other. A document left without
    lines has an empty text. An empty table stays empty, and further columns are kept, but for any of the
    names ``lines_total`` and ``lines_deleted``, which are replaced.
    """
    doomed = line_duplicates(docs, min_words, moved, id_col, text_col)
    # the row travels as one column, so that no column of its own can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    # sorted and merged at every size: the list of lines grows with the corpus and isn't broadcast
    joined = keyed.join(doomed.hint("merge"), (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("mix")), "left")
    split = F.split(F.col("row")[text_col], "\n")
    inside = lambda i: F.exists("ranges", lambda r: (r["first"] <= i) & (i < r["end"]))
    kept = F.array_join(F.filter(split, lambda s, i: ~inside(i)), "\n")
    changed = F.col("n_deleted").isNotNull()
    return joined.select(
        *[(F.when(changed, kept).otherwise(F.col("row")[c]) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("lines_total", "lines_deleted")],
        F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(split)).alias("lines_total"),
        F.coalesce("n_deleted", F.lit(0)).alias("lines_deleted"),
    )
