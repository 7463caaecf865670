"""Which of many terms each text contains: Aho-Corasick automata over the terms' bytes.

An automaton is a table of next states in numpy: the goto function with failures resolved, so that every byte is one
step. Texts are cut into lanes of one length, each beginning as far before its own bytes as the longest term reaches,
and all lanes take their steps together. Terms whose table would exceed a bound are dealt into several automata, each of
which passes over the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes that an automaton's table may take, about; it is broadcast.
TABLE_BYTES = 64 << 20
#: Bytes of a lane, and of the texts that are searched together (a longer text by itself).
LANE, TOGETHER = 1024, 4 << 20
_PARTED = b"\xff"  # no text in UTF-8 holds this byte


@dataclass(frozen=True)
class Automaton:
    """``classes`` of bytes; ``steps``: next state by state and class, both times the number of classes; per state the term that ends there (-1: none) and
    the longest shorter suffix at which one ends (0: none). From ``first`` on, states have either."""

    terms: list[bytes]
    classes: np.ndarray
    width: int
    steps: np.ndarray
    ends: np.ndarray
    link: np.ndarray
    first: int
    longest: int


def automaton(terms: list[bytes]) -> Automaton:
    """Over distinct, non-empty terms, built level by level: all states of one depth at a time."""
    sizes = np.array([len(t) for t in terms], np.int64)
    flat = np.frombuffer(b"".join(terms), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    classes = np.zeros(256, np.uint8)
    used = np.unique(flat)
    classes[used] = np.arange(1, len(used) + 1)
    width, most = len(used) + 1, int(sizes.sum()) + 1
    steps = np.zeros((most, width), np.int64)
    fail, link, ends = np.zeros(most, np.int64), np.zeros(most, np.int64), np.full(most, -1, np.int64)
    at, states = np.zeros(len(terms), np.int64), 1
    for depth in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > depth)
        edges, of = np.unique(at[on] * width + classes[flat[starts[on] + depth]], return_inverse=True)
        parent, letter = np.divmod(edges, width)
        new = np.arange(states, states + len(edges))
        states += len(edges)
        fail[new] = steps[fail[parent], letter] if depth else 0  # of a shallower state, whose own edges are there
        steps[parent, letter] = new
        steps[new] = steps[fail[new]]
        link[new] = np.where(ends[fail[new]] >= 0, fail[new], link[fail[new]])
        at[on] = new[of]
        done = on[sizes[on] == depth + 1]
        ends[at[done]] = done
    steps, ends, link = steps[:states], ends[:states], link[:states]
    hit = (ends >= 0) | (link > 0)
    order = np.argsort(hit, kind="stable")  # states at which something ends come last, so that one comparison finds them
    place = np.empty(states, np.int64)
    place[order] = np.arange(states)
    kind = np.int32 if states * width < 1 << 31 else np.int64
    return Automaton(terms, classes, width, (place[steps[order]] * width).astype(kind).ravel(), ends[order], place[link[order]], int((~hit).sum()), int(sizes.max(initial=0)))


def search(found: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and of the terms that they contain, each pair once."""
    body = found.classes[np.frombuffer(_PARTED.join(texts), np.uint8)]
    before, lane = max(found.longest - 1, 0), max(LANE, 4 * found.longest)
    lanes = -(-len(body) // lane)
    padded = np.zeros(before + lanes * lane, np.uint8)
    padded[before : before + len(body)] = body
    columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (before + lane, lanes), (1, lane)))
    state = np.zeros(lanes, found.steps.dtype)
    reached = np.empty((lane, lanes), found.steps.dtype)
    for k, letters in enumerate(columns):
        state = found.steps[state + letters]
        if k >= before:
            reached[k - before] = state
    step, of = np.nonzero(reached >= found.first * found.width)
    state = reached[step, of] // found.width
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), of * lane + step, "right")
    pairs = []
    while len(state):
        here = found.ends[state] >= 0
        pairs.append(np.unique(text[here] * len(found.terms) + found.ends[state[here]]))
        state = found.link[state]
        state, text = state[state > 0], text[state > 0]
    return np.divmod(np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64), max(1, len(found.terms)))


def automata(terms: DataFrame, term: str, table_bytes: int = TABLE_BYTES) -> Iterator[Automaton]:
    """The terms (null and empty ones left out), dealt by hash into as many automata as keep each table within its bound; one at a time is in the driver.

    The bound holds for terms that are themselves within it.
    """
    own = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    size = F.sum(F.octet_length("term")).alias("bytes")
    letters = F.array_distinct(F.regexp_extract_all(F.hex(F.col("term").cast("binary")), F.lit("(..)"), F.lit(1)))
    total = own.agg(size).first()["bytes"] or 0
    used = own.select(F.explode(letters).alias("b")).distinct().count()  # 256 at most
    parts = max(1, math.ceil((total + 1) * (used + 1) * 4 / table_bytes))
    for k in range(parts if total else 0):
        dealt = own.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        if found := sorted(r["term"].encode() for r in dealt.collect()):
            yield automaton(found)


def terms_in_texts(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """key, term for each distinct term that the text of a row contains; nothing for a null or empty term or text.

    Texts are read where they lie, once for each automaton, and never shuffled.
    """
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([StructField(key, texts.schema[key].dataType), StructField(term, StringType())])
    out = None
    for found in automata(terms, term, table_bytes):
        shared = texts.sparkSession.sparkContext.broadcast(found)  # its table is within table_bytes
        part = rows.mapInArrow(_search_batches(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def _portions(texts: pa.Array, longest: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Row numbers and texts, about TOGETHER bytes at a time; a text beyond that comes in pieces that overlap as far as a term reaches."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for row, text in enumerate(texts):
        body = text.as_py() or b""
        for at in range(0, len(body), TOGETHER):
            if size and size + len(body) > TOGETHER:
                yield np.array(rows), held
                rows, held, size = [], [], 0
            piece = body[max(0, at - longest + 1) : at + TOGETHER]
            rows.append(row)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(rows), held


def _search_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Automaton = shared.value
        names = pa.array([t.decode() for t in found.terms], pa.string())
        for batch in batches:
            pairs = []
            for rows, texts in _portions(batch.column(1).cast(pa.binary()), found.longest):
                text, which = search(found, texts)
                pairs.append(rows[text] * len(names) + which)
            if pairs:
                row, which = np.divmod(np.unique(np.concatenate(pairs)), len(names))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.take(pa.array(which))], names=["key", "term"])

    return run
