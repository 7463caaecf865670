"""Byte-level BPE encoding and decoding.

A word (one match of the split pattern) starts as an array of single bytes; a fold of
Spark's higher-order functions joins, again and again, the leftmost pair of lowest
rank. Ranks are a literal map in the plan, dealt into small maps by crc32 since Spark
searches a map in order; pieces are written in hex, which concatenates as bytes do.

Every distinct word among the ``head_words`` most frequent is folded once, in the
cluster, and its ids are broadcast. Texts and tokens are never shuffled. A fold takes
some 150 microseconds, so the rare words beyond that bound are merged, by the same
ranks, where the ids of a text are put together (see the README for figures).
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.llm.common import dropped, inputs, short_plans, small_batches, stored

#: Bound on the words whose ids are broadcast; tens of MB.
HEAD_WORDS = 1 << 18
#: Longer words (in bytes) aren't folded: the fold's cost grows with the square of the length.
LONG = 256
#: Bytes up to which plain lists merge a word faster than a heap.
SHORT = 48
#: Rare words that a worker remembers before it starts afresh.
REMEMBERED = 50_000
_NONE = 1 << 30


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of the bytes, a blank and the rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _literal(entries: dict[str, object], kind: str) -> tuple[Column, int]:
    """entries as a constant array of small maps, and their number (a power of two)."""
    n = 1 << max(0, len(entries) // 2).bit_length()
    maps: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        maps[zlib.crc32(k.encode()) & (n - 1)][k] = v
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>"), n


def _bound(entries: dict[str, object], kind: str, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body(look up in entries), with the literal in the plan once however often body uses it."""
    table, n = _literal(entries, kind)
    return _let(table, lambda t: body(lambda key: F.try_element_at(F.get(t, F.crc32(key.cast("binary")).bitwiseAND(F.lit(n - 1)).cast("int")), key)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(rank: Callable[[Column], Column], word: Column) -> Column:
    """Ranks of a word (hex), comma-joined, by merging its bytes in order of rank."""

    def joined(a: Column, b: Column) -> Column:
        return F.coalesce(rank(F.concat(a, b)), F.lit(_NONE))

    def join(state: Column, i: Column) -> Column:
        p, r = state["p"], state["r"]
        return _let(
            F.concat(F.get(p, i - 1), F.get(p, i)),
            lambda m: F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(m), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(
                    F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))),
                    F.when(i > 1, F.array(joined(F.get(p, i - 2), m))).otherwise(F.array().cast("array<int>")),
                    F.when(i + 1 < F.size(p), F.array(joined(m, F.get(p, i + 1)))).otherwise(F.array().cast("array<int>")),
                    F.slice(r, i + 2, F.size(p)),
                ).alias("r"),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state["r"]), lambda low: F.when(low < _NONE, join(state, F.array_position(state["r"], low).cast("int"))).otherwise(state))

    size = (F.length(word) / 2).cast("int")
    p = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.substring(word, k * 2 + 1, F.lit(2)))
    start = _let(p, lambda p: F.struct(p.alias("p"), F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda a, k: joined(a, F.get(p, k + 1))).alias("r")))
    merged = F.aggregate(F.sequence(F.lit(1), size - 1), start, step, lambda s: s["p"])
    return F.coalesce(rank(word).cast("string"), F.array_join(F.transform(merged, lambda x: rank(x).cast("string")), ","))


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges for one word: by plain lists for a short one, by a heap of (rank, place) over a linked list for a long one."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT:
        get, parts = ranks.get, [word[k : k + 1] for k in range(n)]
        joins = [get(word[k : k + 2], _NONE) for k in range(n - 1)]
        while joins and (low := min(joins)) < _NONE:
            k = joins.index(low)
            parts[k] += parts.pop(k + 1)
            del joins[k]
            if k < len(joins):
                joins[k] = get(parts[k] + parts[k + 1], _NONE)
            if k:
                joins[k - 1] = get(parts[k - 1] + parts[k], _NONE)
        return [ranks[p] for p in parts]
    end, before, live = [k + 1 for k in range(n)], [k - 1 for k in range(n)], [True] * n
    heap = [(ranks[word[k : k + 2]], k, k + 2) for k in range(n - 1) if word[k : k + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not live[a] or b >= n or end[b] != stop or not live[b]:
            continue  # one of the two has been merged since
        live[b], end[a] = False, stop
        if stop < n:
            before[stop] = a
            if (r := ranks.get(word[a : end[stop]])) is not None:
                heapq.heappush(heap, (r, a, end[stop]))
        if (c := before[a]) >= 0 and (r := ranks.get(word[c:stop])) is not None:
            heapq.heappush(heap, (r, c, stop))
    return [ranks[word[k : end[k]]] for k in range(n) if live[k]]


def _packed(head: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, head.schema) as stream:
        stream.write_table(head)
    return out.getvalue().to_pybytes()


_HEAD: list = [b"", {}]


def _unpacked(head: bytes) -> dict[str, str]:
    """Word -> ids; made once in a worker and kept until it sees another head."""
    if _HEAD[0] is not head:
        table = pa.ipc.open_stream(head).read_all()
        _HEAD[:] = head, dict(zip(table.column("w").to_pylist(), table.column("ids").to_pylist(), strict=True))
    return _HEAD[1]


class Tokenizer:
    """Encodes and decodes by a rank table and a split pattern; every single byte must have a rank."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> None:
        short_plans(spark)  # the literals below are a megabyte each
        self.spark, self.ranks = spark, ranks
        self.pattern = f"(?U){pattern}"  # blanks as Unicode has them
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            pieces[v] = k.hex()
        self.pieces = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
        self.head = pa.table({"w": pa.array([], pa.string()), "ids": pa.array([], pa.string())})

    @property
    def hex_ranks(self) -> dict[str, int]:
        """The rank of each piece, written in hex."""
        return {k.hex().upper(): v for k, v in self.ranks.items()}

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def learn_words(self, df: DataFrame, text_col: str = "text", head_words: int = HEAD_WORDS) -> Tokenizer:
        """Count the words of all texts and encode the frequent ones, each once: as many counts, from the highest, as fit head_words."""
        counts = stored(df.select(F.explode(self.words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "words")
        level = F.floor(F.log2("n") * 8).cast("int")
        # counts differ, so what reaches the driver is at most 8 numbers for each doubling of the corpus
        levels = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
        least, total = math.inf, 0
        for at, words in levels:
            total += words
            if total > head_words:
                break
            least = at
        if least < math.inf:
            chosen = counts.where((level >= least) & (F.octet_length("w") <= LONG))
            # written first: the plan that holds the rank map has no shuffle, and so is made once
            spread = stored(chosen.select("w").repartition(max(1, min(200, self.spark.sparkContext.defaultParallelism * 2))), "head")
            ids = _bound(self.hex_ranks, "int", lambda rank: fold(rank, F.hex(F.col("w").cast("binary"))))
            self.head = spread.select("w", ids.alias("ids")).toArrow()  # stays in Arrow here; workers make a dict of it
            dropped(self.spark, spread)
        dropped(self.spark, counts)
        return self

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """doc_id and ids (ranks, comma-joined) for every row, repeated ones and those with a null id too, after it ``text`` if kept; '' for null and empty texts."""
        small_batches(self.spark)
        # a vocabulary and at most head_words entries, whatever the data
        shared = self.spark.sparkContext.broadcast((self.ranks, _packed(self.head)))

        @F.arrow_udf("string")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ranks, head = shared.value[0], _unpacked(shared.value[1])
            rare: dict[str, str] = {}

            def one(word: str) -> str:
                if (got := rare.get(word)) is None:
                    if len(rare) >= REMEMBERED:
                        rare.clear()
                    got = ",".join(map(str, merge(ranks, word.encode())))
                    if len(word) <= LONG:
                        rare[word] = got
                return got

            for rows in batches:
                found = rows.flatten().dictionary_encode()  # a batch's distinct words
                encoded = pa.array([head.get(w) or one(w) for w in found.dictionary.to_pylist()], pa.string())
                sizes = pc.list_value_length(rows).to_numpy()
                starts = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                yield pc.binary_join(pa.ListArray.from_arrays(starts, encoded.take(found.indices)), ",")

        return inputs(df, id_col, text_col).select("doc_id", ids(self.words(F.col("text"))).alias("ids"), *keep)

    def decode(self, ids: Column) -> Column:
        """The bytes of comma-joined ids, piece after piece."""
        pieces = F.transform(F.split(ids, ","), lambda k: F.get(self.pieces, k.cast("int")))
        return F.when(ids == "", F.lit(b"")).otherwise(F.unhex(F.array_join(pieces, "")))


def count_ids(ids: Column) -> Column:
    return F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","))) + 1).cast("bigint")
