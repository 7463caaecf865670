"""Sharding by minimax contiguous partition, in DataFrame operations only.

Documents are ordered by a hash of their text; equal texts are one atomic group. The
driver sees sums over stretches of that order, at first coarse ones. They bound the smallest
capacity of a shard (binary search, each trial checked greedily) from above, by cutting between
stretches only, and from below, by cutting anywhere but inside a single group. Until the
bounds meet, the stretches in which a cut can fall are looked at more finely, so that the
capacity is the smallest one over the groups themselves and a few numbers reach the driver.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossalake.llm.common import dropped, inputs, stored

#: Bits of the hash that part the first stretches, and further bits for each closer look.
FIRST, CLOSER = 16, 8
#: Bytes that a row takes beside its text.
OVERHEAD = 8
#: Slots are numbered within COARSE x SALTS pieces of the order, so that no task numbers a whole shard or a hot text.
COARSE, SALTS = 1024, 64


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def place(text: Column) -> Column:
    """Where a text stands in the order, a signed 64-bit number; null counts as empty."""
    return F.xxhash64(_text(text))


def size(text: Column) -> Column:
    return (F.octet_length(_text(text)) + F.lit(OVERHEAD)).cast("bigint")


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Ends (exclusive) of the shards over ordered group sizes: none exceeds the smallest feasible capacity, and within it sizes are as even as the order allows."""
    ends = [0, *accumulate(sizes)]
    groups, total = len(sizes), ends[-1]
    low = capacity(sizes, shards)
    out, start = [], 0
    for left in range(shards, 0, -1):
        most = _reach(ends, start, low)
        aim = ends[start] + (total - ends[start]) / left
        at = bisect_left(ends, aim)
        at = at if at <= groups and (at == 0 or ends[min(at, groups)] - aim <= aim - ends[at - 1]) else at - 1
        a, b = start, most  # the least end from which the rest still fits
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if _fits(ends, mid, left - 1, low) else (mid + 1, b)
        start = min(most, max(a, at))
        out.append(start)
    return out


def _reach(ends: list[int], start: int, most: int) -> int:
    return bisect_right(ends, ends[start] + most) - 1


def _fits(ends: list[int], start: int, shards: int, most: int) -> bool:
    for _ in range(shards):
        start = _reach(ends, start, most)
    return start >= len(ends) - 1


def _smallest(low: int, high: int, feasible) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity of which ``shards`` shards hold all groups in order."""
    ends = [0, *accumulate(sizes)]
    return _smallest(max([-(-ends[-1] // shards), *sizes], default=0), ends[-1], lambda most: _fits(ends, 0, shards, most))


@dataclass(frozen=True)
class Stretch:
    """A stretch of the order: its first possible place, the bits of the hash that part it from others, its bytes, and whether it is a single group."""

    start: int
    bits: int
    bytes: int
    single: bool


def open_stretches(parts: list[Stretch], shards: int) -> list[int]:
    """Numbers of the stretches that a closer look must part, four for each cut at most; none once the capacity is the smallest one over the groups.

    Bounds on the capacity are those of cutting at any byte of a stretch of several groups, and between stretches only. Filled greedily, each shard ends in
    one stretch: those in which cuts fall, for the lower bound and for the middle of the two, are parted. While the bounds differ, the lower one has such
    a cut, or the upper one would be as low.
    """
    sizes = [p.bytes for p in parts]
    ends = [0, *accumulate(sizes)]
    total, above = ends[-1], capacity(sizes, shards)

    def walk(most: int, anywhere: bool) -> tuple[bool, set[int]]:
        """Whether all fits, and the stretches of several groups within which shards would end."""
        at, inside = 0, set()
        for _ in range(shards):
            to = min(at + most, total)
            k = bisect_right(ends, to) - 1
            if ends[k] != to:
                if not parts[k].single:
                    inside.add(k)
                if not anywhere or parts[k].single:
                    to = max(at, ends[k])
            at = to
        return at >= total, inside

    least = max([-(-total // shards), *(p.bytes for p in parts if p.single)], default=0)
    below = _smallest(least, above, lambda most: walk(most, True)[0])
    if below >= above:
        return []
    middle = (below + above) // 2
    return sorted(set().union(*(walk(most, anywhere)[1] for most in (below, middle) for anywhere in (True, False))))


def settled(first: list[Stretch], shards: int, closer: Callable[[list[Stretch]], list[Stretch]]) -> list[Stretch]:
    """first with stretches parted, as closer() parts those it is given, until the capacity is the smallest one over the groups."""
    parts = first
    while wanted := open_stretches(parts, shards):
        gone = set(wanted)
        parts = sorted([p for k, p in enumerate(parts) if k not in gone] + closer([parts[k] for k in wanted]), key=lambda p: p.start)
    return parts


def plan(df: DataFrame, shards: int, text_col: str = "text", first: int = FIRST, closer: int = CLOSER) -> list[int]:
    """The places at which a new shard begins, in order, one less than there are shards; an empty table gives empty shards.

    No shard exceeds the smallest capacity that the groups of equal texts allow in their order (groups of one
    64-bit hash count as equal). At most 2 ** first sums reach the driver, and in a closer look 2 ** closer for each of a few stretches a cut.
    """
    text = F.col(text_col)
    groups = stored(df.select(place(text).alias("h"), size(text).alias("bytes")).groupBy("h").agg(F.sum("bytes").alias("bytes")), "groups")

    def look(wanted: list[Stretch]) -> list[Stretch]:
        out = []
        for bits in {p.bits for p in wanted}:
            numbers = [(p.start >> (64 - bits),) for p in wanted if p.bits == bits]  # a few for each shard
            inside = F.broadcast(df.sparkSession.createDataFrame(numbers, "n bigint"))
            out += _sums(groups.join(inside, F.shiftright("h", 64 - bits) == F.col("n"), "left_semi"), min(64, bits + closer))
        return out

    parts = settled(_sums(groups, first), shards, look)
    dropped(df.sparkSession, groups)
    ends = cuts([p.bytes for p in parts], shards)
    past = (1 << 63) - 1  # a shard after the last group begins nowhere
    return [parts[e].start if e < len(parts) else past for e in ends[:-1]]


def _sums(groups: DataFrame, bits: int) -> list[Stretch]:
    """Bytes of the stretches that the first bits of the hash part."""
    rows = groups.groupBy(F.shiftright("h", 64 - bits).alias("at")).agg(F.sum("bytes").alias("bytes"), (F.count("*") == 1).alias("single")).collect()
    return sorted((Stretch(r["at"] << (64 - bits), bits, r["bytes"], r["single"] or bits == 64) for r in rows), key=lambda p: p.start)


def _shard(at: Column, begins: list[int]) -> Column:
    return sum(((at >= b).cast("int") for b in begins), F.lit(0))


def assign(df: DataFrame, begins: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row, by the places that plan() gives.

    A null text counts as empty. Equal texts share a shard. Slots of a shard run from 0
    without gaps, roughly in the order of places; repeated rows take slots of their own.
    """
    text = F.col("text")
    rows = inputs(df, id_col, text_col).select("doc_id", size(text).alias("size"), F.crc32(_text(text).cast("binary")).alias("text_crc32"), place(text).alias("at"))
    coarse = F.shiftright("at", 64 - (COARSE.bit_length() - 1)).cast("int")
    rows = rows.select("*", _shard(F.col("at"), begins).alias("shard"), coarse.alias("coarse"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    piece = ["shard", "coarse", "salt"]
    before = Window.partitionBy("shard").orderBy("coarse", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*piece).agg(F.count("*").alias("n")).select(*piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy(*piece).orderBy("at", "doc_id", "text_crc32")))
    return placed.join(offsets, piece).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("k") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, text_col: str = "text") -> None:
    """Write df's rows, all columns, to one folder per shard (``shard=0`` ...); several files to a folder.

    A null text counts as empty, equal texts and repeated rows share a folder, an empty table gives no folder. df has no column ``shard``.
    """
    if "shard" in df.columns:
        raise ValueError("the table has a column named shard")
    at = place(F.col(text_col))
    spread = df.withColumn("shard", _shard(at, plan(df, shards, text_col))).repartition(F.col("shard"), F.pmod(at, F.lit(16)))
    spread.write.partitionBy("shard").parquet(path)
