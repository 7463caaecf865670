"""Substring dedup: seed and extend.

Anchors are winnowed word sequences: every window of ``window`` words holds, by its own
content alone, exactly one anchor (its least k-gram). All windows that share an anchor
occurrence form a run. Occurrences meet by anchor in a sorted stream, of which a task holds
one row: runs that come twice as a whole are settled there. Where an anchor has several
different runs, one copy of each meets the others with its words: every two are extended from
the anchor to both sides, word by word, and the maximal repeats of a window's length or more
are kept. Of an anchor with more than ``CROWD`` runs, the windows of the runs meet by hash
instead, as pairs of runs would be too many. Nothing is kept but windows that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import inputs, small_batches, stored

WINDOW, SEED = 35, 8
#: Different runs of an anchor up to which every two are extended.
CROWD = 64
#: Kinds of occurrence rows.
SINGLE, SETTLED, HIT = 0, 1, 2
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


class _Numbers(dict):
    """Word -> 64-bit number, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_KNOWN = _Numbers()
_POWERS: dict[str, np.ndarray] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(4096, 2 * n)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            _POWERS[name] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of a text's words, from prefix sums."""

    def __init__(self, tokens: list[bytes]) -> None:
        n = len(tokens)
        up, self.down = _powers(n)
        numbers = np.fromiter(map(_KNOWN.__getitem__, tokens), np.uint64, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers * up, dtype=np.uint64)))

    def stretch(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        at = np.arange(len(self.sums) - length)
        return self.stretch(at, at + length)


def runs(tokens: list[bytes], window: int = WINDOW, seed: int = SEED) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Per anchor occurrence: hash of the anchor, first window, windows, hash of the run, and place of the anchor; None for a text shorter than a window."""
    n = len(tokens) - window + 1
    if n < 1:
        return None
    hashes = Hashes(tokens)
    value = hashes.every(seed)
    place = np.arange(len(value))
    left, span = window - seed + 1, 1  # the least of `left` neighbours, by doubling; the first one on a tie
    best, at = value, place
    while span < left:
        by = min(span, left - span)
        lower = best[by:] < best[:-by]
        best, at = np.where(lower, best[by:], best[:-by]), np.where(lower, at[by:], at[:-by])
        span += by
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    anchor = at[first]
    # a run is known by its words and by where the anchor stands in it
    run = _mixed(hashes.stretch(first, first + count + window - 1) ^ _mixed((anchor - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)))
    return hashes, value[anchor], first, count, run, anchor


def _batch(names: list[str], columns: list, types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _occurrences(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """A row for each anchor occurrence: where it is, and its run.

    Runs that come twice within a batch are settled there: their occurrences are rows of kind HIT, dealt evenly, and
    one row of kind SETTLED meets the rest of the corpus. So a run that a third of all rows hold sends a row a batch.
    """
    names = ["anchor", "run", "kind", "key", "doc_id", "first", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owner = [], []
            for k, text in enumerate(batch.column("text")):
                if (got := runs(words(text.as_py()), window, seed)) is not None:
                    _, anchor, first, count, whole, _ = got
                    out.append((anchor.view(np.int64), whole.view(np.int64), first.astype(np.int32), count.astype(np.int32)))
                    owner.append(np.full(len(first), k))
            if out:
                anchor, whole, first, count = (np.concatenate(c) for c in zip(*out, strict=True))
                owners = np.concatenate(owner)
                order = np.lexsort((whole, anchor))
                fresh = np.concatenate(([True], (np.diff(anchor[order]) != 0) | (np.diff(whole[order]) != 0)))
                size = np.diff(np.append(np.flatnonzero(fresh), len(order)))
                alone = np.repeat(size == 1, size)
                rows = np.concatenate([order, order[fresh & ~alone]])
                kind = np.concatenate([np.where(alone, SINGLE, HIT), np.full(int((fresh & ~alone).sum()), SETTLED)]).astype(np.int8)
                anchor, whole, first, count, owners = (c[rows] for c in (anchor, whole, first, count, owners))
                anchor = np.where(kind == HIT, _mixed((owners * 100_003 + first).astype(np.uint64)).view(np.int64), anchor)
                at = pa.array(owners)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(whole), pa.array(kind), batch.column("key").take(at), batch.column("doc_id").take(at), pa.array(first), pa.array(count)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"anchor bigint, run bigint, kind tinyint, key bigint, doc_id {kind}, first int, count int")


def _meet(crowd: int):
    """Occurrences sorted by anchor and run -> hits (runs that come twice or more: each occurrence) and, where an
    anchor has several runs, one occurrence of each (``wanted``; ``single`` if it is the only one; ``few`` unless the anchor is crowded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = words_hash = one = None
        count, held, crowded = 0, [], False
        out: list[list] = [[] for _ in range(7)]

        def emit(row: list, *flags: bool) -> None:
            for c, x in zip(out, (*row, *flags), strict=True):
                c.append(x)

        def run_over() -> None:
            nonlocal held, crowded
            if one is not None:
                held.append((one, count == 1))
            if crowded or len(held) > crowd:
                crowded = True
                for row, single in held:
                    emit(row, True, single, False)
                held = []

        def anchor_ends() -> None:
            nonlocal held, crowded
            if len(held) > 1:
                for row, single in held:
                    emit(row, True, single, True)
            held, crowded = [], False

        def made(kind: pa.DataType) -> pa.RecordBatch:
            batch = _batch(["key", "doc_id", "first", "count", "wanted", "single", "few"], out, [pa.int64(), kind, pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()])
            for c in out:
                c.clear()
            return batch

        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            for a, r, sort, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run", "kind", "key", "doc_id", "first", "count")), strict=True):
                if sort == HIT:
                    emit(row, False, False, False)
                    continue
                if a == anchor and r == words_hash:
                    if count == 1:
                        emit(one, False, False, False)
                    if sort == SINGLE:
                        emit(row, False, False, False)
                    count += 1
                    continue
                run_over()
                if a != anchor:
                    anchor_ends()
                anchor, words_hash, one, count = a, r, row, 1 if sort == SINGLE else 2
            yield made(kind)
        if kind is not None:
            run_over()
            anchor_ends()
            yield made(kind)

    return run


def _wanted_runs(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """The runs that ``wanted`` names by their first window, for rows (key, doc_id, text, wanted): those of few whole, with their words and the anchor's place
    among them (``window`` is 0), those of a crowded anchor as their single windows."""
    names = ["anchor", "window", "key", "doc_id", "first", "count", "single", "at", "words"]
    types = [pa.int64(), pa.int64(), pa.int64(), None, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, doc, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text", "wanted")), strict=True):
                tokens = words(text)
                hashes, anchor, first, count, _, place = runs(tokens, window, seed)
                for w in wanted:
                    k = int(np.searchsorted(first, w["first"]))
                    start, n, a = int(first[k]), int(count[k]), int(anchor[k].view(np.int64))
                    if w["few"]:
                        rows = [(a, 0, key, doc, start, n, w["single"], int(place[k]) - start, b" ".join(tokens[start : start + n + window - 1]))]
                    else:
                        single = hashes.stretch(np.arange(start, start + n), np.arange(start + window, start + n + window)).view(np.int64).tolist()
                        rows = [(a, h, key, doc, start + j, 1, w["single"], None, None) for j, h in enumerate(single)]
                    for row in rows:
                        for c, x in zip(out, row, strict=True):
                            c.append(x)
            yield _batch(names, out, [batch.column("doc_id").type if t is None else t for t in types])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"anchor bigint, window bigint, key bigint, doc_id {kind}, first int, count int, single boolean, at int, words binary")


def extended(found: list[tuple[int, list[bytes]]], window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """run x run -> first word and number of words of the maximal repeat round their anchor, within the first of the two (0 words if it is shorter than a window).

    Runs are given as the anchor's place and their words. Words are compared, to the left of the anchor and from it to the right.
    """
    numbers: dict[bytes, int] = {}
    ids = [[numbers.setdefault(w, len(numbers)) for w in words] for _, words in found]
    alone = -1 - np.arange(len(found))  # what fills a row up equals nothing in others

    def same(rows: list[list[int]]) -> np.ndarray:
        """Equal words from the start, for every two rows."""
        most = max(map(len, rows))
        m = np.repeat(alone[:, None], most, axis=1)
        for k, row in enumerate(rows):
            m[k, : len(row)] = row
        return np.logical_and.accumulate(m[:, None] == m[None], axis=2).sum(axis=2)

    at = np.array([a for a, _ in found])
    left = same([x[:a][::-1] for (a, _), x in zip(found, ids, strict=True)])
    right = same([x[a:] for (a, _), x in zip(found, ids, strict=True)])
    size = np.where((right >= seed) & (left + right >= window), left + right, 0)
    np.fill_diagonal(size, 0)
    return np.stack([at[:, None] - left, size], axis=2)


def _meet_runs(window: int, seed: int):
    """Rows sorted by anchor and window -> the windows of single runs that come again in another run (those of other runs are hits already).

    Runs of an anchor are extended, those of few; windows of crowded ones are compared by hash, one being held.
    """
    names = ["key", "doc_id", "first", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, count, group, kind = None, None, 0, [], None
        out: list[list] = [[] for _ in names]

        def emit(row: tuple) -> None:
            for c, x in zip(out, row, strict=True):
                c.append(x)

        def group_ends() -> None:
            if len(group) > 1:
                found = extended([(a, w.split(b" ")) for *_, a, w in group], window, seed)
                for (key, doc, first, _, single, *_), repeats in zip(group, found.tolist(), strict=True):
                    if single:
                        for start, n in {(start, n) for start, n in repeats if n}:
                            emit((key, doc, first + start, n - window + 1))
            group.clear()

        for batch in batches:
            kind = batch.column("doc_id").type
            for a, w, *row, text in zip(*(batch.column(c).to_pylist() for c in ("anchor", "window", "key", "doc_id", "first", "count", "single", "at", "words")), strict=True):
                if (a, w) != at:
                    group_ends()
                    at, one, count = (a, w), None, 0
                if text is not None:
                    group.append((*row, text))
                    continue
                count += 1
                key, doc, first, _, single, _ = row
                if count == 1:
                    one = (key, doc, first, 1) if single else None
                else:
                    if one is not None:
                        emit(one)
                        one = None
                    if single:
                        emit((key, doc, first, 1))
            yield _batch(names, out, [pa.int64(), kind, pa.int32(), pa.int32()])
            for c in out:
                c.clear()
        group_ends()
        if kind is not None:
            yield _batch(names, out, [pa.int64(), kind, pa.int32(), pa.int32()])

    return run


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """With a key that equal rows share, so that it is the same whenever the table is read."""
    docs = inputs(df, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("key", F.xxhash64("doc_id", "text"))


def _with(docs: DataFrame, other: DataFrame, column: str, how: str) -> DataFrame:
    """docs joined with one row (key, doc_id, column) each; the id is compared beside the key."""
    right = other.withColumnsRenamed({"key": "__key", "doc_id": "__id"})
    return docs.join(right, (docs["key"] == right["__key"]) & docs["doc_id"].eqNullSafe(right["__id"]), how).select(docs["doc_id"], docs["text"], docs["key"], column)


def repeated(df: DataFrame, window: int = WINDOW, seed: int = SEED, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and hits (first window and number of windows that have a second occurrence) for every row of df.

    A window occurs a second time if its words start anywhere else, in the same row or another; repeated rows are
    other occurrences. Null and empty texts, and texts shorter than a window, have no hits.
    """
    small_batches(df.sparkSession)
    docs = _keyed(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _occurrences(docs, window, seed).repartition("anchor").sortWithinPartitions("anchor", "run")
    met = stored(found.mapInArrow(_meet(crowd), f"key bigint, doc_id {kind}, first int, count int, wanted boolean, single boolean, few boolean"), "runs")
    wanted = met.where("wanted").groupBy("key", "doc_id").agg(F.collect_list(F.struct("first", "single", "few")).alias("wanted"))
    # rows that are there twice have no single runs and so no say here
    once = _wanted_runs(_with(docs, wanted, "wanted", "inner"), window, seed).repartition("anchor", "window").sortWithinPartitions("anchor", "window")
    parts = stored(once.mapInArrow(_meet_runs(window, seed), f"key bigint, doc_id {kind}, first int, count int"), "repeats")
    hits = met.where("not wanted").select("key", "doc_id", "first", "count").unionByName(parts)
    return _with(docs, hits.groupBy("key", "doc_id").agg(F.collect_list(F.struct("first", "count")).alias("hits")), "hits", "left")


def covered(hits: list, window: int) -> list[tuple[int, int]]:
    """Disjoint stretches of words (first, past the last) under the windows of hits."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((h["first"], h["first"] + h["count"] + window - 1) for h in hits or ()):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def remove(df: DataFrame, window: int = WINDOW, seed: int = SEED, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (stretches of words, first and past the last) and kept (the words left, joined by one blank) for every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, hits in zip(batch.column("text"), batch.column("hits").to_pylist(), strict=True):
                tokens = words(text.as_py())
                some, left, at = covered(hits, window), [], 0
                for first, end in some:
                    left += tokens[at:first]
                    at = end
                left += tokens[at:]
                n.append(len(tokens))
                gone.append(len(tokens) - len(left))
                spans.append([{"first": a, "end": b} for a, b in some])
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield _batch(["doc_id", "n_words", "n_removed", "removed", "kept"], [batch.column("doc_id"), n, gone, spans, kept], [batch.column("doc_id").type, pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])), pa.string()])

    marked = repeated(df, window, seed, crowd, id_col, text_col)
    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, removed array<struct<first:int,end:int>>, kept string")
