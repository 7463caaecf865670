"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (hashes of ``least`` consecutive
words). For each pair found, the longest common stretches are marked one after another
without overlap (running Karp-Rabin, from long to short), so that reordered passages count
in full; the share of an item's words that is marked decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from glossalake.llm.common import inputs, small_batches, unused

LEAST = 5
THRESHOLD = 0.5
#: Bytes of benchmark text up to which it is broadcast; beyond it, seeds meet in a shuffle.
BROADCAST_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _numbers(tokens: list[str]) -> np.ndarray:
    """A 64-bit number for each word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in tokens), np.uint64, len(tokens))


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all stretches of a length."""
    n = len(numbers) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + numbers[k : n + k]
    return out ^ (out >> np.uint64(29))


class Stretches:
    """Karp-Rabin hashes of a row of numbers (0 matches nothing), by prefix sums, of the stretches that are still free."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
            self.down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _INVERSE))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_spread(numbers) * up[:n], dtype=np.uint64)))
        self.free = numbers > 0

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the free stretches of a length, and their hashes."""
        taken = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
        return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def tile(item: list, text: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item place, text place, length >= least), longest first; equal lengths in order of place.

    Each round jumps to the longest length of which both sides have an equal free stretch (halving, as shorter
    stretches of it are equal too) and marks all of that length. Of each hash the free places of the text are a
    queue, since a place once taken stays so: no pairs of places are listed.
    """
    numbers = {w: k + 1 for k, w in enumerate(dict.fromkeys(item))}
    a, b = (np.array([numbers.get(w, 0) for w in x], np.int64) for x in (item, text))
    left, right = Stretches(a), Stretches(b)
    tiles, most = [], min(len(a), len(b))

    def shared(length: int) -> bool:
        return bool(np.isin(left.of(length)[1], right.of(length)[1]).any())

    while most >= least and shared(least):
        low, high = least, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if shared(mid) else (low, mid - 1)
        places: dict[int, list[int]] = {}
        for j, h in zip(*(x.tolist() for x in right.of(low)), strict=True):
            places.setdefault(h, []).append(j)
        begun = dict.fromkeys(places, 0)
        for i, h in zip(*(x.tolist() for x in left.of(low)), strict=True):
            if not left.free[i : i + low].all():
                continue
            queue = places.get(h, ())
            while begun.get(h, 0) < len(queue):
                j = queue[begun[h]]
                if right.free[j : j + low].all() and (a[i : i + low] == b[j : j + low]).all():
                    left.free[i : i + low] = right.free[j : j + low] = False
                    tiles.append((i, j, low))
                    break
                begun[h] += 1
        most = low - 1  # none of this length is left
    return tiles


@dataclass
class Benchmark:
    """Items with enough words, and the items that hold each seed."""

    items: dict[object, list[str]]
    seeds: np.ndarray
    owners: list[list[object]]
    vocabulary: dict[str, int]
    numbers: np.ndarray
    least: int

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]], least: int) -> Benchmark:
        items = {k: w for k, t in rows if len(w := words(t)) >= least}
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for x in items.values() for w in x))}
        numbers = _numbers(list(vocabulary))
        held: dict[int, set] = {}
        for k, x in items.items():
            for h in rolling(numbers[[vocabulary[w] for w in x]], least).tolist():
                held.setdefault(h, set()).add(k)
        seeds = np.array(sorted(held), np.uint64)
        return cls(items, seeds, [sorted(held[h]) for h in seeds.tolist()], vocabulary, numbers, least)

    def candidates(self, tokens: list[str]) -> dict[object, list[int]]:
        """Item -> places of the seeds that it shares with a document."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        if len(ids) < self.least or not len(self.seeds) or (ids >= 0).sum() < self.least:
            return {}
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        whole = np.flatnonzero(unknown[self.least :] == unknown[: -self.least])
        if not len(whole):
            return {}
        hashes = rolling(self.numbers[ids], self.least)[whole]
        at = np.minimum(np.searchsorted(self.seeds, hashes), len(self.seeds) - 1)
        out: dict[object, list[int]] = {}
        for k in np.flatnonzero(self.seeds[at] == hashes):
            for item in self.owners[at[k]]:
                out.setdefault(item, []).append(int(whole[k]))
        return out

    def coverage(self, item: object, tokens: list[str], places: list[int]) -> tuple[float, int]:
        """Share of the item's words that tiles mark, and their number; only stretches round shared seeds matter."""
        near, last = [], -1
        for at in places:
            if last >= 0 and at > last:
                near.append(None)  # stretches that don't touch stay apart
            near += tokens[max(at, last) : at + self.least]
            last = max(last, at + self.least)
        tiles = tile(self.items[item], near, self.least)
        return sum(n for *_, n in tiles) / len(self.items[item]), len(tiles)

    def hopeful(self, item: object, places: list[int], threshold: float) -> bool:
        """Whether so many seeds can make tiles of the threshold: a tile of n words has n + 1 - least seeds, a least-th of n or more."""
        return len(places) * self.least >= threshold * len(self.items[item])


def contaminations(df: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, coverage and tiles for each document and item of which it holds the threshold or more.

    Words are compared in lower case. Null and empty texts hold nothing; items of fewer than
    ``least`` words match nothing; of items with one id, the last in order of text counts, even if it is
    too short; item ids are of any type and keep it. The ways in which small and large benchmarks meet the documents give the same rows.
    Repeated documents give repeated rows.
    """
    small_batches(df.sparkSession)
    # one text an item, whichever way they meet
    items = benchmark.where("item_id is not null").groupBy("item_id").agg(F.max("text").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    meet = _by_broadcast if size <= broadcast_bytes else _by_shuffle
    found = meet(inputs(df, id_col, text_col), items, least, threshold)
    return found.where(F.col("coverage") >= threshold)


def _by_broadcast(docs: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark.of(rows, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for k, text in zip(ids, batch.column("text"), strict=True):
                tokens = words(text.as_py())
                for item, places in sorted(shared.value.candidates(tokens).items()):
                    if shared.value.hopeful(item, places, threshold):
                        found.append((k, item, *shared.value.coverage(item, tokens, places)))
            if found:
                kinds = batch.column("doc_id").type, item_kind, pa.float64(), pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "coverage", "tiles"])

    item_kind = to_arrow_type(items.schema["item_id"].dataType)
    kind, item = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    return docs.mapInArrow(run, f"doc_id {kind}, item_id {item}, coverage double, tiles int")


def _by_shuffle(docs: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """For a benchmark too large to broadcast: equal seeds meet in a join, and texts follow only for the pairs found."""

    @F.pandas_udf("array<bigint>")
    def seeds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: rolling(_numbers(words(t)), least).view(np.int64), na_action=None)

    @F.pandas_udf("struct<coverage:double,tiles:int>")
    def cover(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
        out = []
        for text, other in zip(texts, others, strict=True):
            one = Benchmark.of([(0, other)], least)
            tokens = words(text)
            out.append(one.coverage(0, tokens, one.candidates(tokens).get(0, [])) if one.items else (0.0, 0))
        return pd.DataFrame(out, columns=["coverage", "tiles"])

    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # the same whenever the table is read; equal rows share it
    left = docs.select("doc_id", "key", F.explode(seeds("text")).alias("seed")).distinct()
    items = items.withColumnRenamed("text", "item")
    seeded = items.select("item_id", seeds("item").alias("seeds"))
    places = seeded.select("item_id", F.size("seeds").alias("m"), F.explode("seeds").alias("seed")).groupBy("item_id", "m", "seed").agg(F.count("*").alias("n"))
    met = left.join(places, "seed").groupBy("doc_id", "key", "item_id", "m").agg(F.sum("n").alias("n"))
    # an item of n words has n + 1 - least seeds, and so has a tile: a least-th of its words or more
    pairs = met.where(F.col("n") * least >= F.lit(threshold) * (F.col("m") + least - 1))
    pairs = pairs.select(F.col("doc_id").alias("p_id"), F.col("key").alias("p_key"), "item_id")
    both = pairs.join(items, "item_id").join(docs, (F.col("p_key") == docs["key"]) & docs["doc_id"].eqNullSafe(F.col("p_id")))
    return both.select("doc_id", "item_id", cover("text", "item").alias("c")).select("doc_id", "item_id", "c.coverage", "c.tiles")


def remove_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """df's rows, columns unchanged, without the documents that hold a benchmark item.

    All rows of an id go if one of them does, those with a null id as one. Null and empty texts stay, repeated
    rows stay as often as they come; an empty benchmark leaves df as it is.
    """
    id_col = options.get("id_col", "doc_id")
    held = contaminations(df, benchmark, **options).select("doc_id").distinct().withColumnRenamed("doc_id", (name := unused(df, "held")))
    return df.join(held, df[id_col].eqNullSafe(F.col(name)), "left_anti")
