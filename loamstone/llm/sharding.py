"""Minimax contiguous sharding, in DataFrame functions only.

Rows with equal texts form a group. Groups are ordered by a hash of the text; those larger than an equal share come first,
the largest ahead, and have a shard each, so that one group with a third of all bytes doesn't leave other shards empty. Of
the others, the capacity of a shard is the smallest for which greedy filling in order needs no more shards than are left,
found by binary search, and the order is cut where greedy filling with that capacity cuts it.

The driver never holds all groups. It holds the sizes of ranges of the order, at first ``1 << RANGE_BITS`` of them. Taken as
whole they give an upper bound of the capacity, taken as divisible a lower one, and both tell where each cut may fall. Only
ranges there are split, ``1 << STEP_BITS`` ways a scan, until no cut can fall inside a range of several groups: the result is
that over single groups. A scan's ranges are bounded by the number of shards squared, whatever the number of groups.

Slots number a shard's rows without gaps. They are counted within (shard, range, salt) and offset by the counts before;
ranges with many rows are salted, so no task sorts more than a share of a hot group.

Defined results: a null text counts as no bytes and is grouped with empty texts; ties in size need no rule, the order is by
hash; repeated rows are rows of their own with slots of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.llm.common import materialize

RANGE_BITS, STEP_BITS = 14, 6
SALTS = 64
ROW_BYTES = 16


@dataclass(frozen=True, order=True)
class Range:
    """The groups whose hashes begin with the ``bits`` bits of ``prefix``; ``single`` if that is one group."""

    first: int  # the smallest hash with that prefix
    bits: int
    size: int
    single: bool


def ends_of(upto: list[int], firm: list[bool], capacity: int) -> list[int] | None:
    """Ends, in bytes, of the shards that greedy filling makes of ranges with the running sums ``upto``; one that isn't ``firm`` can be cut anywhere. None if a firm one is larger than the capacity."""
    out, done = [], 0
    while done < upto[-1]:
        end = min(done + capacity, upto[-1])
        at = bisect_right(upto, end)
        if at < len(upto) and firm[at]:
            end = upto[at - 1] if at else 0
        if end == done:
            return None
        out.append(end)
        done = end
    return out


def smallest_capacity(sizes: list[int], shards: int, firm: list[bool] | None = None) -> int:
    """Smallest capacity with which greedy filling of ``sizes`` in order needs at most ``shards`` shards."""
    if not sizes:
        return 0
    firm = firm or [True] * len(sizes)
    upto = list(accumulate(sizes))
    low, high = max([-(-upto[-1] // shards), *(s for s, f in zip(sizes, firm, strict=True) if f)]), upto[-1]
    while low < high:
        middle = (low + high) // 2
        ends = ends_of(upto, firm, middle)
        if ends is not None and len(ends) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """The shard of each atom, in order."""
    if not sizes:
        return []
    upto = list(accumulate(sizes))
    ends = ends_of(upto, [True] * len(sizes), smallest_capacity(sizes, shards))
    return [bisect_right(ends, u - 1) for u in upto]


def oversized(ranges: list[Range], shards: int) -> tuple[list[Range], list[Range]]:
    """Groups larger than an equal share of what is left, largest first; and a range of several groups that has to be split to tell."""
    out, total = [], sum(r.size for r in ranges)
    for r in sorted(ranges, key=lambda r: (-r.size, r.first)):
        left = shards - len(out)
        if left < 2 or r.size * left <= total:
            break
        if not r.single:
            return out, [r]
        out.append(r)
        total -= r.size
    return out, []


def undecided(ranges: list[Range], shards: int) -> list[Range]:
    """The ranges of several groups, in order, inside which a cut may fall."""
    if not ranges or all(r.single for r in ranges):
        return []
    sizes, firm = [r.size for r in ranges], [r.single for r in ranges]
    whole = [True] * len(ranges)
    low, high = smallest_capacity(sizes, shards, firm), smallest_capacity(sizes, shards)
    if low == high:
        return []
    large = [r for r in ranges if not r.single and r.size > low]
    if large:
        return large
    upto = list(accumulate(sizes))
    near, far = ends_of(upto, whole, low), ends_of(upto, [False] * len(ranges), high)
    out = set()
    for a, z in zip(near, far + [upto[-1]] * len(near), strict=False):
        out |= {i for i in range(bisect_right(upto, a), min(bisect_right(upto, z), len(upto) - 1) + 1) if not firm[i]}
    return [ranges[i] for i in sorted(out)]


def _ranges(df: DataFrame, bits: int) -> list[Range]:
    """Size and singleness of the ranges of ``df`` (size, h: an unsigned hash turned into a signed one of the same order)."""
    flip = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    found = df.groupBy(F.shiftrightunsigned(flip, 64 - bits).alias("p")).agg(F.sum("size").alias("size"), F.min("h").alias("a"), F.max("h").alias("z")).collect()
    return sorted(Range(r.p << (64 - bits), bits, r["size"], r.a == r.z) if r.a != r.z else Range(r.a + (1 << 63), bits, r["size"], True) for r in found)


def _split(df: DataFrame, split: list[Range], step: int) -> list[Range]:
    """The ranges that ``split`` consist of."""
    out = []
    for bits in sorted({r.bits for r in split}):
        flip = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
        part = df.sparkSession.createDataFrame([(r.first >> (64 - bits),) for r in split if r.bits == bits], "__p long")
        out += _ranges(df.join(F.broadcast(part), F.shiftrightunsigned(flip, 64 - bits) == F.col("__p"), "left_semi"), min(64, bits + step))
    return out


def cut(df: DataFrame, shards: int, bits: int = RANGE_BITS, step: int = STEP_BITS) -> tuple[list[int], list[int]]:
    """Hashes (unsigned) of the groups that have a shard of their own, and the first hashes of the shards after the first of the others."""
    ranges = _ranges(df, bits)
    while True:
        hot, split = oversized(ranges, shards)
        rest = [r for r in ranges if r not in hot]
        split = split or undecided(rest, shards - len(hot))
        if not split:
            break
        gone = set(split)
        ranges = sorted([r for r in ranges if r not in gone] + _split(df, split, step))
    shard = minimax_cuts([r.size for r in rest], shards - len(hot))
    return [r.first for r in hot], [r.first for r, a, b in zip(rest[1:], shard, shard[1:], strict=False) if a != b]


def sharded(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, size, text_crc32, shard and slot of each row."""
    spark, full = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    lean = materialize(docs.select(
        F.col(key), (F.octet_length(full) + ROW_BYTES).cast("long").alias("size"), F.crc32(full.cast("binary")).alias("text_crc32"),
        F.xxhash64(full).bitwiseXOR(F.lit(-(1 << 63))).alias("h"),
    ), "sharding-rows")
    hot, firsts = cut(lean, shards)
    signed = lambda x: F.lit(x - (1 << 63))
    place = F.lit(len(hot))
    for x in firsts:
        place = place + (F.col("h") >= signed(x)).cast("int")
    for i, x in enumerate(hot):
        place = F.when(F.col("h") == signed(x), F.lit(i)).otherwise(place)
    df = lean.withColumn("shard", place.cast("int")).withColumn("__atom", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - RANGE_BITS).cast("int"))
    found = df.groupBy("shard", "__atom").agg(F.count("*").alias("n")).collect()
    rows = sum(r.n for r in found)
    many = sorted({r["__atom"] for r in found if r.n * 512 > rows + 512 * 64})
    salt = F.when(F.col("__atom").isin(many), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)) if many else F.lit(0)
    df = df.withColumn("__salt", salt)
    counts = {(r.shard, r["__atom"], 0): r.n for r in found if r["__atom"] not in many}
    if many:
        for r in df.filter(F.col("__atom").isin(many)).groupBy("shard", "__atom", "__salt").agg(F.count("*").alias("n")).collect():
            counts[r.shard, r["__atom"], r["__salt"]] = r.n
    filled, places = [0] * shards, []
    for (s, atom, t), n in sorted(counts.items()):
        places.append((s, atom, t, filled[s]))
        filled[s] += n
    offsets = F.broadcast(spark.createDataFrame(places, "__b int, __a int, __s int, __offset long"))  # as many as ranges, shards and salts at most
    within = Window.partitionBy("shard", "__atom", "__salt").orderBy(F.col(key).asc_nulls_first(), "text_crc32")
    out = df.withColumn("__row", F.row_number().over(within)).join(offsets, (F.col("shard") == F.col("__b")) & (F.col("__atom") == F.col("__a")) & (F.col("__salt") == F.col("__s")))
    return out.select(key, "size", "text_crc32", "shard", (F.col("__offset") + F.col("__row") - 1).alias("slot"))
