"""Minimax contiguous partition of atomic groups into shards (operator 10, native).

Groups (rows with an equal key) are ordered by a 64-bit key and never split. The smallest
capacity for which a greedy left-to-right filling needs no more than the given shards is found
by binary search. Cutting where that filling cuts would leave all slack to the last shards, so a cut is
put as near to an equal share of what remains as that capacity allows.

The driver never sees the groups. It holds sums over ranges of the key; a greedy check over
ranges that hold several groups gives a bound from both sides, and only where the two
disagree are the ranges that a cut falls into divided further, 256-fold, by one aggregation
over the stored group sizes. What the driver holds is bounded by shards x 256 x key bytes.
For an equal share's sake, a range of under a thousandth of the share isn't divided.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from heapq import nlargest
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.storage import materialise

KEY_BITS = 64
STEP_BITS = 8
FIRST_BITS = 12


@dataclass(frozen=True)
class KeyRange:
    """Groups whose (unsigned) key starts with ``prefix``, of ``bits`` bits."""

    bits: int
    prefix: int
    size: int
    groups: int
    largest: int

    @property
    def low(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.bits >= KEY_BITS


def _signed(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def _fill(ranges: list[KeyRange], capacity: int, optimistic: bool) -> tuple[int, list[int]]:
    """Shards needed by greedy filling, and the ranges where it was unsure.

    A range of several groups that doesn't fit as a whole may be cut inside. The optimist
    splits it to the byte; the pessimist opens a new shard before it if it fits there, else
    counts one more shard for each capacity's worth that can surely be filled.
    """
    shards, room, unsure = 1, capacity, []
    for i, r in enumerate(ranges):
        if r.size <= room:
            room -= r.size
            continue
        if r.atomic:
            if r.size > capacity:
                return 1 << 60, unsure
            shards, room = shards + 1, capacity - r.size
            continue
        unsure.append(i)
        if optimistic:
            left = r.size - room
            more = -(-left // capacity)
            shards, room = shards + more, more * capacity - left
        else:
            # all shards but the last that it fills have less than its largest group left over
            more = 1 if r.size <= capacity else -(-r.size // (capacity - r.largest + 1))
            shards, room = shards + more, capacity - r.size if more == 1 else 0
    return shards, unsure


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity over ``groups(key long, size long)`` and the first (unsigned)
    key of each shard but the first. ``groups`` has one row per key and should be stored."""

    def summed(bits: int, within: list[KeyRange] | None) -> list[KeyRange]:
        rows = groups
        if within is not None:
            parents: dict[int, list[int]] = {}
            for r in within:
                parents.setdefault(r.bits, []).append(r.prefix)
            test = F.lit(False)
            for b, prefixes in parents.items():
                test = test | F.shiftrightunsigned("key", KEY_BITS - b).isin([_signed(p) for p in prefixes])
            rows = rows.filter(test)
        prefix = F.shiftrightunsigned("key", KEY_BITS - bits) if bits < KEY_BITS else F.col("key")
        out = rows.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).collect()
        return [KeyRange(bits, r.p & ((1 << 64) - 1), r.s, r.n, r.m) for r in out]

    ranges = sorted(summed(FIRST_BITS, None), key=lambda r: r.low)
    if not ranges:
        return 0, []
    total = sum(r.size for r in ranges)
    low, high = max(max(r.largest for r in ranges), -(-total // shards)), total
    while low < high:
        capacity = (low + high) // 2
        if _fill(ranges, capacity, optimistic=False)[0] <= shards:
            high = capacity
            continue
        needed, unsure = _fill(ranges, capacity, optimistic=True)
        if needed > shards:
            low = capacity + 1
            continue
        ranges = _divide(ranges, unsure, summed)
    while True:
        starts, coarse = _even_starts(ranges, low, shards)
        if not coarse:
            return low, [ranges[i].low for i in starts if i < len(ranges)]
        ranges = _divide(ranges, sorted(coarse), summed)


def _share(ranges: list[KeyRange], shards: int) -> float:
    """What a shard would hold of ``ranges`` if each group larger than that had a shard to itself."""
    total = sum(r.size for r in ranges)
    for size in nlargest(shards - 1, (r.largest for r in ranges)):
        if size * shards <= total:
            break
        total, shards = total - size, shards - 1
    return total / shards


def _even_starts(ranges: list[KeyRange], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """First range of each shard but the first, or else the ranges that are too coarse to cut.

    ``earliest[j]`` is the least start of shard j from which it and those after it hold the rest. From
    there or later, a shard reaches the earliest start of the next, so any choice leaves one to make.
    No shard is empty while ranges are left.
    """
    n, ends = len(ranges), [0, *accumulate(r.size for r in ranges)]
    earliest, coarse = [n] * (shards + 1), set()
    for j in range(shards - 1, 0, -1):
        bound = ends[earliest[j + 1]] - capacity
        earliest[j] = bisect_left(ends, bound) if bound > 0 else 0
        if ends[earliest[j]] > bound > 0 and not ranges[earliest[j] - 1].atomic:
            coarse.add(earliest[j] - 1)
    if coarse:
        return [], coarse
    starts, at = [], 0
    for j in range(1, shards):
        share = _share(ranges[at:], shards - j + 1)
        aim = ends[at] + share
        last = bisect_right(ends, ends[at] + capacity) - 1
        over = min(bisect_left(ends, aim), n)
        if over > at and ends[over] > aim and not ranges[over - 1].atomic and ranges[over - 1].size * 1000 > share:
            coarse.add(over - 1)
        near = over - 1 if over and aim - ends[over - 1] < ends[over] - aim else over
        at = min(max(near, earliest[j], at + 1), last)
        starts.append(at)
    return starts, coarse


def _divide(ranges: list[KeyRange], unsure: list[int], summed) -> list[KeyRange]:
    chosen = [ranges[i] for i in unsure]
    finer: list[KeyRange] = []
    for bits in sorted({r.bits for r in chosen}):
        finer += summed(min(KEY_BITS, bits + STEP_BITS), [r for r in chosen if r.bits == bits])
    gone = set(unsure)
    return sorted([r for i, r in enumerate(ranges) if i not in gone] + finer, key=lambda r: r.low)


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 100_000
) -> DataFrame:
    """Put every row into a shard so that the largest shard is as small as contiguous cuts allow, and the others near equal.

    Returns ``doc_id, size, text_crc32, shard, slot``. Equal texts (all null texts are one)
    stay together. ``size`` is the UTF-8 length plus one; a null text has size 1 and the
    checksum of an empty text. Slots count from 0 in each shard, by sub-buckets of about
    ``slot_rows`` rows whose bases are prefix sums, so no task sees a whole shard. Repeated
    rows and null ids are rows like any other; an empty table gives an empty result.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.xxhash64(F.col(text_col)).alias("key"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = minimax_cuts(groups, shards)
    # unsigned order of a signed key: flip its sign bit
    flip = lambda u: _signed(u ^ (1 << 63))
    ordered = F.col("key").bitwiseXOR(F.lit(_signed(1 << 63)))
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (ordered >= F.lit(flip(cut))).cast("int")
    buckets = max(1, -(-rows.count() // (shards * slot_rows)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)))
    placed = materialise(placed.drop("key"), "shard-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        placed.groupBy("shard", "bucket")
        .count()
        .withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(base, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
    )
