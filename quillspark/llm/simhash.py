"""SimHash near-duplicates by pigeonhole blocks (operator 4).

Two uses share the machinery. ``simhash_components`` links 64-bit majority fingerprints at a small
Hamming distance, exactly. ``drop_near_duplicates`` works at a *similarity* of shingle sets, for which
64 bits are too few: it takes 2048-bit fingerprints, many blocks, and a loose budget on 256 bits. What
this connects is searched again by all 2048 bits, and each link is decided by the sets themselves.

Fingerprints are cut into blocks. If two differ in at most ``k`` bits, they agree on all but ``k``
of the blocks, so they share the key made of some ``blocks - k`` of them. Distinct fingerprints
are joined on these keys and each candidate pair is verified by its Hamming distance.

A key's bucket isn't expanded into pairs. Inside it, fingerprints are visited breadth-first:
each is compared, as vectors of words, with those not reached yet, and only the edges of the
resulting trees leave the task. So a bucket of m close fingerprints costs about m comparisons
and m rows, and every link still counts towards connectivity. Buckets are streamed from
sorted partitions. Of 64-bit fingerprints, a bucket of more than ``BUCKET`` is first split exactly: see
``_split_hot``. A larger bucket of wide fingerprints becomes one group of candidates without being compared, and
large groups are searched in chunks: see ``similar_edges``.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.graph import connected_components
from quillspark.storage import materialise

BUCKET = 50_000


#: Bytes of a text whose words are held at once.
SLICE = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_slices(text: str | None, size: int):
    """XXH64 (seed 42) of each run of ``size`` words, repeats included, as uint64 arrays; fewer words make one run.

    The words of one slice of the text are held at a time; a slice ends where a word does.
    """
    import numpy as np
    import xxhash

    raw = text.encode() if text else b""
    kept: list[bytes] = []
    at, total = 0, 0
    while at < len(raw):
        end = _SPACE.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = end.start() if end else len(raw)
        w = kept + raw[at:end].translate(_LOWER).split()
        at, total = end, total + len(w) - len(kept)
        if len(w) >= size:
            yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(len(w) - size + 1)), np.uint64)
        kept = w[-(size - 1) :] if size > 1 else []
    if 0 < total < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), 42)], np.uint64)


def majority_fingerprint(slices) -> int:
    """Bit i is set if it is set in over half of the hashes; no hashes give zero."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        for at in range(0, len(hashes), 1 << 14):
            part = np.ascontiguousarray(hashes[at : at + (1 << 14)], "<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of whole texts; stored, since it is used several times."""
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [majority_fingerprint(shingle_slices(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], names=["doc_id", "fp"])

    return materialise(inputs.mapInArrow(hashed, "doc_id long, fp long"), "fingerprints")


def block_keys(fp: Column, k: int, blocks: int) -> Column:
    """One key per choice of ``blocks - k`` blocks: a struct of the choice and the masked bits."""
    width = [64 * (b + 1) // blocks - 64 * b // blocks for b in range(blocks)]
    masks, at = [], 0
    for w in width:
        masks.append(((1 << w) - 1) << at)
        at += w
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - k)):
        mask = sum(masks[b] for b in chosen)
        keys.append(F.struct(F.lit(n).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def link_forest(ids, words, k: int):
    """Edges of a breadth-first forest over one bucket; rows of ``words`` link within ``k`` bits."""
    import numpy as np

    edges = []
    while len(ids) > 1:
        frontier, ids, words = [(ids[0], words[0])], ids[1:], words[1:]
        while frontier and len(ids):
            x, own = frontier.pop()
            near = np.bitwise_count(words ^ own).sum(1, dtype=np.int64) <= k
            if near.any():
                edges.append(np.stack([np.full(int(near.sum()), x), ids[near]], 1))
                frontier.extend(zip(ids[near], words[near]))
                ids, words = ids[~near], words[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)


#: Buckets up to this size are compared all at once, shifted against themselves.
SMALL = 16


def bucket_edges(keys, ids, words, k: int):
    """Edges within each run of equal (sorted) keys."""
    import numpy as np

    cut = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
    sizes = end - begin
    left = np.repeat(end, sizes) - np.arange(len(keys)) - 1  # rows after this one in its bucket
    left[np.repeat(sizes > SMALL, sizes)] = 0
    found = []
    for shift in range(1, SMALL):
        at = np.flatnonzero(left >= shift)
        if not len(at):
            break
        at = at[np.bitwise_count(words[at] ^ words[at + shift]).sum(1, dtype=np.int64) <= k]
        found.append(np.stack([ids[at], ids[at + shift]], 1))
    found += [link_forest(ids[b:e], words[b:e], k) for b, e in zip(begin[sizes > SMALL], end[sizes > SMALL])]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _bucket_linker(row_of, k: int):
    """A ``mapInArrow`` function over partitions sorted by key; holds one bucket over batch ends."""

    def link(batches):
        import numpy as np
        import pyarrow as pa

        def edges(rows):
            e = bucket_edges(*rows, k)
            e = np.unique(np.sort(e[e[:, 0] != e[:, 1]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, i]), pa.int64()) for i in (0, 1)], names=["u", "v"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = row_of(batch)
            if rest is not None:
                rows = tuple(np.concatenate(x) for x in zip(rest, rows))
            last = np.searchsorted(rows[0], rows[0][-1])  # the last bucket may go on
            if last:
                yield edges(tuple(x[:last] for x in rows))
            rest = tuple(x[last:] for x in rows)
        if rest is not None:
            yield edges(rest)

    return link


def _split_hot(keyed: DataFrame, hot: DataFrame, k: int) -> DataFrame:
    """Edges inside buckets too large for a task, exactly.

    Two fingerprints differ in at most 2 bits just if flipping at most one bit of each makes them
    equal. So each member is listed under its own value and its 64 one-bit changes, and joins the
    least member of every such list: the lists hold at most 65 fingerprints each.
    """
    if k != 2:
        raise ValueError("buckets over the limit can be split only for a distance of 2; use more blocks")
    inside = keyed.join(hot, "key").select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    near = inside.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).filter("u < v")
    return near.join(least.select("near", "u"), "near").filter("fp <> u").select("u", F.col("fp").alias("v"))


def fingerprint_edges(distinct: DataFrame, k: int = 2, blocks: int = 5) -> DataFrame:
    """Edges ``(u, v)`` that connect whatever fingerprints differ in at most ``k`` bits."""
    keyed = materialise(
        distinct.select("fp", F.explode(block_keys(F.col("fp"), k, blocks)).alias("key")).select(
            F.xxhash64("key.choice", "key.bits").alias("key"), "fp"
        ),
        "blocks",
    )
    sizes = materialise(keyed.groupBy("key").count().filter("count > 1"), "buckets")
    shared = keyed.join(sizes.filter(F.col("count") <= BUCKET).select("key"), "key")

    def row_of(batch):
        import numpy as np

        fps = batch.column("fp").to_numpy()
        return batch.column("key").to_numpy(), fps, fps.astype(np.uint64)[:, None]

    edges = shared.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_linker(row_of, k), "u long, v long")
    hot = sizes.filter(F.col("count") > BUCKET).select("key")
    if hot.limit(1).count():
        edges = edges.union(_split_hot(keyed, hot, k))
    return edges.distinct()


def simhash_components(docs: DataFrame, size: int = 3, k: int = 2, blocks: int = 5, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: ``doc_id``, ``fp`` and ``component_id``, the least id reachable.

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null
    id have a fingerprint, and the component's least non-null id (null if it has none).
    Repeated rows get a row each; an empty table gives none. Other columns are ignored.
    """
    hashed = fingerprints(docs, size, id_col)
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = connected_components(fingerprint_edges(distinct.select("fp"), k, blocks)).withColumnRenamed("node", "fp")
    labelled = distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(least, "component").select("fp", "component_id")
    return hashed.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# --- near-duplicates at a similarity, on wide fingerprints -----------------------------------

WIDTH = 2048
CHECKED = 256
#: Cells of a shingle, unlike in weight so that their sums are hardly ever zero.
CELLS = (1.0, 0.7, 0.45)
#: Standard deviations that a pair at the similarity may exceed its expected distance by.
SLACK = 3


def few_shingles(similarity: float) -> int:
    """Two sets, one of fewer shingles than this, are as similar only if the other has the same and at most one more."""
    import math

    return math.ceil(round(2 * similarity / max(1 - similarity, 0.03), 9))


def shingle_set(text: str | None, size: int):
    """The distinct shingle hashes of a text, sorted, as a uint64 array."""
    import numpy as np

    parts = [np.unique(h) for h in shingle_slices(text, size)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def projected_fingerprints(sets):
    """2048-bit SimHash of each set of shingles, as a uint8 array of packed bits.

    The set is summed into 2048 signed cells, a few by hash for each shingle, and a Walsh-Hadamard
    transform turns these into as many projections, whose signs are the bits. Two bits differ with the probability of
    the angle between the sets over pi, as with one projection per bit.
    """
    import numpy as np

    x = np.zeros((len(sets), WIDTH), np.float32)
    for i, h in enumerate(sets):
        for at in range(0, len(h), 1 << 18):
            for c, weight in enumerate(CELLS):  # 12 bits of the hash each: a sign and a cell
                own = (h[at : at + (1 << 18)] >> np.uint64(12 * c)).astype(np.int64)
                x[i] += np.bincount(own & (WIDTH - 1), np.where(own & WIDTH, weight, -weight), WIDTH)
    x *= np.random.default_rng(42).choice(np.array([-1, 1], np.float32), WIDTH)
    step = 1
    while step < WIDTH:
        y = x.reshape(len(x), WIDTH // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), WIDTH)
        step *= 2
    return np.packbits(x > 0, axis=1)


def _apart(similarity: float) -> float:
    """Share of bits that differ: a Jaccard similarity s of sets of like size is a cosine of 2s / (1 + s)."""
    import math

    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_budget(similarity: float, width: int) -> int:
    """Bits of ``width`` in which a pair at ``similarity`` or more differs at most, but for ``SLACK``."""
    import math

    apart = _apart(similarity)
    return math.ceil(width * apart + SLACK * math.sqrt(width * apart * (1 - apart)))


def block_plan(similarity: float, n: int, recall: float = 0.98) -> tuple[int, int]:
    """Bits per block and number of blocks.

    Blocks are wide enough that unrelated documents seldom share one, and as many as a pair at
    exactly ``similarity`` needs to share one with probability ``recall``.
    """
    import math

    bits = max(16, math.ceil(math.log2(max(n, 2))) - 4)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - _apart(similarity)) ** bits))


def similarities(own, sets):
    """Jaccard similarities of a sorted set to others, none of them empty."""
    import numpy as np

    sizes = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    both = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
    return both / (len(own) + sizes - both)


def similar_forest(ids, words, sets, similarity: float):
    """Like ``link_forest``, with each link decided by the sets; fingerprints only leave out far ones."""
    import numpy as np

    budget, sizes = distance_budget(similarity, WIDTH), np.array([len(x) for x in sets])
    edges, left = [], np.arange(len(ids))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.minimum(sizes[left], sizes[x]) / np.maximum(sizes[left], sizes[x]) >= similarity
            near[near] = np.bitwise_count(words[left[near]] ^ words[x]).sum(1, dtype=np.int64) <= budget
            at = np.flatnonzero(near)
            for n in range(0, len(at), 1024):
                part = at[n : n + 1024]
                near[part] = similarities(sets[x], [sets[i] for i in left[part]]) >= similarity
            reached, left = left[near], left[~near]
            edges += [(ids[x], ids[i]) for i in reached]
            frontier.extend(reached)
    return edges


def _sorted_groups(batches, columns: list[str]):
    """``(key, rows)`` of consecutive equal values of ``task``; rows are lists of values by column."""
    now, held = None, [[] for _ in columns]
    for batch in batches:
        for task, *row in zip(*(batch.column(c).to_pylist() for c in ("task", *columns))):
            if task != now:
                if held[0]:
                    yield held
                now, held = task, [[] for _ in columns]
            for part, x in zip(held, row):
                part.append(x)
    if held[0]:
        yield held


def _edge_batch(found):
    import numpy as np
    import pyarrow as pa

    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], names=["u", "v"])


def _forest_of_task(similarity: float):
    """A ``mapInArrow`` function over ``task, class, fp, shingles`` sorted by task; holds one task's sets."""

    def link(batches):
        import numpy as np

        for ids, fps, sets in _sorted_groups(batches, ["class", "fp", "shingles"]):
            ids, first = np.unique(np.array(ids, np.int64), return_index=True)  # a row and its repeats
            words = np.stack([np.frombuffer(fps[i], "<u8") for i in first])
            yield _edge_batch(similar_forest(ids, words, [np.frombuffer(sets[i], "<u8") for i in first], similarity))

    return link


def _outsiders_of_task(similarity: float):
    """A ``mapInArrow`` function over ``task, asks, class, fp, shingles, label`` sorted by task.

    Each row that ``asks`` is compared with those of other labels; one edge to each label is enough.
    """
    budget = distance_budget(similarity, WIDTH)

    def link(batches):
        import numpy as np

        for asks, ids, fps, sets, labels in _sorted_groups(batches, ["asks", "class", "fp", "shingles", "label"]):
            asks, ids, labels = np.array(asks, bool), np.array(ids, np.int64), np.array(labels, np.int64)
            words = np.stack([np.frombuffer(f, "<u8") for f in fps])
            sets = [np.frombuffer(s, "<u8") for s in sets]
            sizes, found = np.array([len(s) for s in sets]), []
            members = np.flatnonzero(~asks)
            for x in np.flatnonzero(asks):
                near = members[(labels[members] != labels[x]) & (np.minimum(sizes[members], sizes[x]) / np.maximum(sizes[members], sizes[x]) >= similarity)]
                near = near[np.bitwise_count(words[near] ^ words[x]).sum(1, dtype=np.int64) <= budget]
                for at in range(0, len(near), 1024):
                    part = near[at : at + 1024]
                    linked = part[similarities(sets[x], [sets[i] for i in part]) >= similarity]
                    linked = linked[np.unique(labels[linked], return_index=True)[1]]
                    found += [(ids[x], ids[i]) for i in linked]
            yield _edge_batch(found)

    return link


#: Bytes of shingle sets that a task of the exact search takes, and members of a group that all its tasks see.
GROUP_BYTES = 16 << 20
PIVOTS = 32
#: Rows of a block's bucket that one task compares.
WIDE_BUCKET = 8192
#: Rows of a table of hot keys up to which it is broadcast.
HOT_ROWS = 100_000


def _bounded_broadcast(small: DataFrame) -> DataFrame:
    """``small``, to be broadcast if it has no more than ``HOT_ROWS`` rows, else to be merged."""
    return F.broadcast(small) if small.limit(HOT_ROWS + 1).count() <= HOT_ROWS else small.hint("merge")


def _with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``component, class, fp, shingles`` of ``members``; sets are made again from one text a class."""
    wanted = members.select("component", "class", "fp", F.col("holder.doc_id").alias("__id"), F.col("holder.mix").alias("__mix"))
    texts = docs.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mix") == F.col("__mix"))).select("component", "class", "fp", "text")

    def sets(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [shingle_set(t.as_py(), size).astype("<u8").tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("component", "class", "fp")), pa.array(made, pa.binary())], names=["component", "class", "fp", "shingles"])

    return texts.mapInArrow(sets, "component long, class long, fp binary, shingles binary")


def _in_tasks(rows: DataFrame, function) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(function, "u long, v long")


def similar_edges(docs: DataFrame, classes: DataFrame, close: DataFrame, similarity: float, size: int) -> DataFrame:
    """Edges that connect what links of the similarity or more connect inside the components of ``close``.

    A group of more than ``GROUP_BYTES`` of sets is dealt to several tasks by hash. A few of its members, the
    pivots, are in each of them, so near copies of one text become one component. Then its *outsiders*, the members
    outside the group's largest component, are compared with all members, in tiles: of two
    members that aren't connected yet, one is an outsider, so no link between components is missed. The work
    is outsiders x members; no task holds more than two chunks.
    """
    members = materialise(classes.join(connected_components(close).withColumnRenamed("node", "class"), "class"), "candidates")
    large = materialise(
        members.groupBy("component").agg(F.count("*").alias("members"), F.sum(F.col("n").cast("long")).alias("shingles")).filter(F.col("shingles") * 8 > GROUP_BYTES).withColumn("chunks", F.ceil(F.col("shingles") * 8 / GROUP_BYTES).cast("int")), "large-groups"
    )
    if large.limit(1).count() == 0:
        return _in_tasks(_with_sets(docs, members, size).withColumnRenamed("component", "task"), _forest_of_task(similarity))
    by_group = _bounded_broadcast(large)
    small = members.join(by_group.select("component"), "component", "left_anti")
    edges = _in_tasks(_with_sets(docs, small, size).withColumnRenamed("component", "task"), _forest_of_task(similarity))
    sets = materialise(_with_sets(docs, members.join(by_group.select("component"), "component", "left_semi"), size).distinct(), "large-group-sets")
    chosen = (F.pmod(F.xxhash64("class", F.lit(1)), F.col("members")) < PIVOTS) & (F.length("shingles") <= 4 * 8 * F.col("shingles_of_group") / F.col("members"))
    dealt = sets.join(by_group.withColumnRenamed("shingles", "shingles_of_group"), "component").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    places = F.when(chosen, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    inside = materialise(
        _in_tasks(dealt.withColumn("place", F.explode(places)).select(F.xxhash64("component", "place").alias("task"), "class", "fp", "shingles"), _forest_of_task(similarity)).distinct(), "edges-in-chunks"
    )
    labels = sets.select("component", "class").join(connected_components(inside).toDF("class", "label"), "class", "left").select("component", "class", F.coalesce("label", "class").alias("label"))
    labels = materialise(labels, "labels-in-groups")
    largest = labels.groupBy("component", "label").count().groupBy("component").agg(F.max(F.struct("count", "label")).alias("x")).select("component", F.col("x.label").alias("largest"))
    outside = labels.join(_bounded_broadcast(materialise(largest, "largest-labels")), "component").filter("label <> largest").select("class", "label")
    labelled = dealt.join(labels.select("class", "label").hint("merge"), "class")
    asking = labelled.join(outside.select("class").hint("merge"), "class", "left_semi")
    rounds = asking.groupBy("component").agg(F.ceil(F.sum(F.length("shingles")) / GROUP_BYTES).cast("int").alias("askers"))
    rounds = _bounded_broadcast(materialise(rounds, "outsiders"))
    task = F.xxhash64("component", "chunk", "asker").alias("task")
    columns = ["class", "fp", "shingles", "label"]
    # outsiders go to every chunk of members, members to every chunk of outsiders
    asks = asking.join(rounds, "component").withColumn("asker", F.pmod(F.xxhash64("class", F.lit(2)), F.col("askers")).cast("int")).drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    answers = labelled.join(rounds, "component").withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("askers") - 1)))
    tiles = asks.select(task, F.lit(True).alias("asks"), *columns).union(answers.select(task, F.lit(False).alias("asks"), *columns))
    return edges.union(inside).union(_in_tasks(tiles, _outsiders_of_task(similarity)))


def few_shingle_edges(classes: DataFrame, similarity: float) -> DataFrame:
    """Edges from sets of under ``few_shingles``, exactly; ``less`` has a set's hash without each shingle."""
    # n - 1 over n is the similarity of a set of n to one without one of its shingles
    wider = classes.filter((F.col("n") > 1) & ((F.col("n") - 1) / F.col("n") >= similarity)).select(F.col("class").alias("v"), (F.col("n") - 1).alias("n"), F.explode("less").alias("u"))
    few = classes.filter(F.col("n") < few_shingles(similarity)).select(F.col("class").alias("u"), "n")
    return wider.join(few.hint("merge"), ["u", "n"]).select("u", "v")


def near_duplicate_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mix, keep``: of each row, its id, its text's hash and its group's least id.

    A class is a set of shingles, named by the wrapping sum of its hashes: texts of other shingles are
    never merged for an equal fingerprint. Groups are connected by pairs of the similarity or more,
    decided on their sets; a pair at exactly that is found with a probability of about 0.98, closer
    ones with more. Texts without words are one group. Null ids are never a
    group's least id unless it has no other.
    """
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mix"), F.col(text_col).alias("text"))

    limit = few_shingles(similarity)

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, size) for t in part.column("text").to_pylist()]
                sums = [h.sum(dtype=np.uint64) for h in sets]
                bits = iter(projected_fingerprints([h for h in sets if len(h) >= limit]))
                columns = {
                    "class": pa.array(np.array(sums, np.uint64).view(np.int64)),
                    "n": pa.array([len(h) for h in sets], pa.int32()),
                    "less": pa.array([(s - h).view(np.int64) if len(h) <= limit else None for s, h in zip(sums, sets)], pa.list_(pa.int64())),
                    "fp": pa.array([next(bits).tobytes() if len(h) >= limit else None for h in sets], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mix"), *columns.values()], names=["doc_id", "mix", *columns])

    rows = materialise(inputs.mapInArrow(hashed, "doc_id long, mix long, class long, n int, less array<long>, fp binary"), "wide-fingerprints")
    classes = materialise(rows.groupBy("class").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mix")).alias("holder"), F.min("n").alias("n"), F.min("less").alias("less"), F.min("fp").alias("fp")), "shingle-set-classes")
    bits, blocks = block_plan(similarity, classes.count())

    def blocked(batches):
        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng(7)
        places = [CHECKED + rng.choice(WIDTH - CHECKED, bits, replace=False) for _ in range(blocks)]
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                packed = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in part.column("fp")])
                wide = np.unpackbits(packed, axis=1)
                keys = np.stack([wide[:, p] @ weights + (b << bits) for b, p in enumerate(places)], 1).ravel()
                checked = np.repeat(np.ascontiguousarray(packed[:, : CHECKED // 8]).view("<i8"), blocks, axis=0)
                ids = np.repeat(part.column("class").to_numpy(), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids), *(pa.array(np.ascontiguousarray(checked[:, i])) for i in range(CHECKED // 64))], names=["key", "class", *(f"w{i}" for i in range(CHECKED // 64))])

    def row_of(batch):
        import numpy as np

        words = np.stack([batch.column(f"w{i}").to_numpy().astype(np.uint64) for i in range(CHECKED // 64)], 1)
        return batch.column("key").to_numpy(), batch.column("class").to_numpy(), words

    words = ", ".join(f"w{i} long" for i in range(CHECKED // 64))
    keyed = classes.filter("fp is not null").select("class", "fp").mapInArrow(blocked, f"key long, class long, {words}")
    hot = materialise(keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("class").alias("u")).filter(F.col("rows") > WIDE_BUCKET).select("key", "u"), "hot-buckets")
    shared = keyed
    if hot.limit(1).count():
        listed = _bounded_broadcast(hot)
        shared = keyed.join(listed.select("key"), "key", "left_anti")
        # too many to compare in a task: all of them are candidates of one group, which is searched in chunks
        starred = keyed.join(listed, "key").filter("class <> u").select("u", F.col("class").alias("v"))
    close = shared.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_linker(row_of, distance_budget(similarity, CHECKED)), "u long, v long").distinct()
    close = close.union(starred.distinct()) if shared is not keyed else close
    edges = similar_edges(inputs, classes, close, similarity, size).union(few_shingle_edges(classes, similarity))
    linked = connected_components(edges).withColumnRenamed("node", "class")
    labelled = classes.select("class", "least").join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = labelled.groupBy("component").agg(F.min("least").alias("keep"))
    return rows.select("doc_id", "mix", "class").join(labelled.join(least, "component").select("class", "keep"), "class").select("doc_id", "mix", "keep")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with only the least id of each group; rows that repeat the kept id and text stay."""
    groups = near_duplicate_groups(docs, similarity, size, id_col, text_col)
    dropped = groups.filter(~F.col("doc_id").eqNullSafe(F.col("keep"))).select(F.col("doc_id").alias("__id"), F.col("mix").alias("__mix")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"))
    kept = keyed.join(dropped.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__mix")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
