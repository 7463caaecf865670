"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

A worker encodes texts by both and merges the ends of their tokens with two pointers: common ends cut a text
into groups, and the tokens that end there are linked. Neither tokenizer has a token over the end of a word and
the blank behind it, so this is done once for each different word that a worker meets, and texts are put together
from words. What it emits for some MB of text is one row: the documents with their groups, the distinct pairs
linked, how often, and which of them each document has. Pairs are counted over these rows, so that a pair sends
a row a batch, not a document; counts, and the highest count of each id of the second tokenizer, are joined back
to the batches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import inputs, small_batches, stored

#: Characters of text whose documents share a row, and documents that are encoded in one call.
BATCH_BYTES, FEW = 4 << 20, 64
#: Words that a worker remembers beyond a row, before it starts afresh.
REMEMBERED = 1 << 18


class Side:
    """A tokenizer: ids of a list of texts; the bytes of each id (none empty that a text can hold), their number, and the id as text."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], by_word: bool) -> None:
        self.encode, self.pieces = encode, pieces
        self.by_word = by_word  # a text's tokens are those of its words, each with the blank before it
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.names = [str(i) for i in range(len(pieces))]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str) -> Side:
    """A byte-level BPE vocabulary (JSON). Where its merges make the ids in their order, the ids are ranks and a faster library merges by them, the pattern splitting texts; else the vocabulary's own library does.

    No match of the pattern may go on from a character that is no white space to a blank, as none of those that such vocabularies use does.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary, merges, letters = whole["model"]["vocab"], whole["model"]["merges"], _byte_letters()
    special = {t["content"] for t in whole["added_tokens"]}
    ids = {w: i for w, i in vocabulary.items() if w not in special}
    pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for word, i in ids.items():
        pieces[i] = bytes(letters[c] for c in word)
    for word in special & vocabulary.keys():
        pieces[vocabulary[word]] = word.encode()
    by_word = whole["normalizer"] is None  # the pattern parts words
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    ordered = sorted(ids, key=ids.get)
    if [len(pieces[ids[w]]) for w in ordered[:256]] == [1] * 256 and ordered[256:] == made and by_word:
        import tiktoken

        ranks = {pieces[i]: i for i in ids.values()}
        fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [fast.encode_ordinary(t) for t in texts], pieces, by_word)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Side(lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts], pieces, by_word)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A SentencePiece model; U+2581 stands for a space, <0xHH> for a byte."""
    import sentencepiece
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    held = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    kinds = ModelProto.FromString(model.serialized_model_proto()).normalizer_spec
    plain = kinds.name == "identity" and kinds.add_dummy_prefix and not kinds.remove_extra_whitespaces
    crossing = any(p[k] != "▁" and p[k + 1] == "▁" for p in map(model.id_to_piece, range(len(held))) for k in range(len(p) - 1))
    return Side(lambda texts: model.encode(texts, num_threads=1), held, plain and not crossing)


def merged(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """How many of the ascending ends a, and of b, are passed at each end that both have."""
    i = j = 0
    n, m = len(a), len(b)
    cut_a, cut_b = [], []
    while i < n and j < m:
        x, y = a[i], b[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            i += 1
            j += 1
            cut_a.append(i)
            cut_b.append(j)
    return cut_a, cut_b


def grouped(a: list[str], b: list[str], cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
    """Groups as text: ids of the first, a bar, ids of the second. Most have one token on either side."""
    out = [f"{a[i]}|{b[j]}" for i, j in zip((cut_a - 1).tolist(), (cut_b - 1).tolist(), strict=True)]
    n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    for k in np.flatnonzero((n > 1) | (m > 1)).tolist():
        p, q = cut_a[k], cut_b[k]
        out[k] = ",".join(a[p - n[k] : p]) + "|" + ",".join(b[q - m[k] : q])
    return out


def words(text: str) -> list[str]:
    """A text's words without the blank before them: it is cut at blanks that a character follows and no white space precedes."""
    parts = text.split(" ")
    if "" not in parts and not re.search(r"[\s\x1c-\x1f]", "".join([p[-1] for p in parts])):
        return parts
    out: list[str] = []
    for part in parts:
        if out and (not part or not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Aligned(NamedTuple):
    """Parts of texts, aligned: for each part its tokens by both sides, its groups, and whether a side doesn't give it back (then it has none of them);
    of all groups, one part's behind the other's, their text and the ids linked at their end (that of the first in the upper half)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    lost: np.ndarray
    groups: list[str]
    links: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        return Aligned(*(x + y if isinstance(x, list) else np.concatenate((x, y)) for x, y in zip(self, other, strict=True)))


def _nothing(parts: int) -> Aligned:
    none = np.zeros(parts, np.int64)
    return Aligned(none, none, none, np.ones(parts, bool), [], np.empty(0, np.int64))


@dataclass(frozen=True)
class Pair:
    """Two tokenizers by their files; opened in each worker once. The second adds the space itself that the first one's text gets."""

    first: str
    pattern: str
    second: str

    def parts(self, text: str) -> list[str]:
        """What can be aligned by itself: words, or the whole text where a side may have tokens over their ends."""
        if not text:
            return []
        return words(text) if byte_level(self.first, self.pattern).by_word and pieces(self.second).by_word else [text]

    def aligned(self, parts: list[str]) -> Aligned:
        """Each part by itself, though they are encoded one behind the other if all of them can be: none may end in white space, and the bytes must come back."""
        together = len(parts) < 2 or not any(p[-1].isspace() for p in parts)
        if parts and together and (out := self._joined(parts)) is not None:
            return out
        if len(parts) < 2:
            return _nothing(len(parts))
        half = len(parts) // 2
        return self.aligned(parts[:half]) + self.aligned(parts[half:])

    def _joined(self, parts: list[str]) -> Aligned | None:
        one, two = byte_level(self.first, self.pattern), pieces(self.second)
        text = " " + " ".join(parts)
        a, b, whole = one.encode([text])[0], two.encode([text[1:]])[0], text.encode()
        if any(b"".join(map(side.pieces.__getitem__, ids)) != whole for side, ids in ((one, a), (two, b))):
            return None
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum(one.sizes[x])
        cut_a, cut_b = merged(ends.tolist(), np.cumsum(two.sizes[y]).tolist())
        at_a, at_b = np.array(cut_a), np.array(cut_b)
        groups = grouped(list(map(one.names.__getitem__, a)), list(map(two.names.__getitem__, b)), at_a, at_b)
        # the groups up to each part's end
        last = np.searchsorted(ends[at_a - 1], np.cumsum([len(p.encode()) + 1 for p in parts]), "right")
        per = (np.diff(n, prepend=0) for n in (at_a[last - 1], at_b[last - 1], last))
        return Aligned(*per, np.zeros(len(parts), bool), groups, (x[at_a - 1] << 32) | y[at_b - 1])


class _Parts:
    """Aligned parts of texts, numbered as they are met: those of the rows that a worker is at, and of those before as far as they are remembered."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.numbers = pair, {}
        self.found: list[Aligned] = []

    def begin(self) -> None:
        """Before the texts of a row: forget the parts if they are many."""
        if len(self.numbers) > REMEMBERED:
            self.numbers, self.found = {}, []

    def add(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's parts."""
        split = [self.pair.parts(t) for t in texts]
        numbers = self.numbers
        fresh = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in numbers]
        if fresh:
            self.found.append(self.pair.aligned(fresh))
            numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh)), strict=True))
        return [list(map(numbers.__getitem__, parts)) for parts in split]

    def all(self) -> Aligned:
        """All parts by number."""
        if len(self.found) > 1:
            groups = list(chain.from_iterable(x.groups for x in self.found))
            self.found = [Aligned(*(groups if isinstance(x[0], list) else np.concatenate(x) for x in zip(*self.found, strict=True)))]
        return self.found[0] if self.found else _nothing(0)


#: The parts that a worker has met, by pair of tokenizers, for its later tasks too.
_KNOWN: dict[Pair, _Parts] = {}
_DOCS = ["n_a", "n_b", "n_groups"]


def _row(number: int, ids: list[pa.Array], docs: list[list[int]], found: Aligned, digest: bool) -> pa.RecordBatch:
    """Documents (the numbers of their parts) as one row: n_a to n_groups and the groups of each, the pairs linked in the row, and by place among these what each document has."""
    n, none = len(docs), [not parts or found.lost[parts].any() for parts in docs]
    docs = [[] if gone else parts for parts, gone in zip(docs, none, strict=True)]
    parts = np.fromiter(chain.from_iterable(docs), np.int64)
    of = np.repeat(np.arange(n), [len(d) for d in docs])
    # the groups of the parts, in order of documents: each part's stretch of groups, one after the other
    sizes, length = found.n_groups, found.n_groups[parts]
    at = np.repeat((np.cumsum(sizes) - sizes)[parts] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    ends = np.cumsum(np.bincount(of, length, n).astype(np.int64)).tolist()
    texts = list(map(found.groups.__getitem__, at.tolist()))
    shown = [";".join(texts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
    groups = [hashlib.sha256(g.encode()).hexdigest() if digest and g else g for g in shown]
    used = np.zeros(len(found.links), bool)
    used[at] = True
    place = np.zeros(len(found.links), np.int64)
    pairs, place[used] = np.unique(found.links[used], return_inverse=True)
    held, times = np.unique(np.repeat(of, length) * max(1, len(pairs)) + place[at], return_counts=True)
    doc, which = np.divmod(held, max(1, len(pairs)))
    columns = {
        "batch": pa.array([number], pa.int64()),
        "ids": _one(pa.concat_arrays(ids)),
        **{c: _one(pa.array(np.bincount(of, getattr(found, c)[parts], n).astype(np.int64))) for c in _DOCS},
        "groups": _one(pa.array(groups, pa.string())),
        "ends": _one(pa.array(np.cumsum(np.bincount(doc, minlength=n)), pa.int32())),
        "place": _one(pa.array(which, pa.int32())),
        "times": _one(pa.array(times, pa.int32())),
        "pairs": _one(pa.array(pairs, pa.int64())),
        "total": _one(pa.array(np.bincount(which, times, len(pairs)).astype(np.int64))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _batches(pair: Pair, digest: bool, most: int):
    """Rows of documents to rows of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = TaskContext.get().partitionId() << 32, _KNOWN.setdefault(pair, _Parts(pair))
        ids: list[pa.Array] = []
        docs: list[list[int]] = []
        size = 0
        parts.begin()
        for batch in batches:
            for k in range(0, len(batch), FEW):
                some = batch.slice(k, FEW)
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids.append(some.column(0))
                docs += parts.add(texts)
                size += sum(map(len, texts))
                if size >= most:
                    yield _row(number, ids, docs, parts.all(), digest)
                    number, size, ids, docs = number + 1, 0, [], []
                    parts.begin()
        if docs:
            yield _row(number, ids, docs, parts.all(), digest)

    return run


def _one(values: pa.Array) -> pa.Array:
    """values as the only row of a list column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def align(df: DataFrame, pair: Pair, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for every row, repeated ones and those with a null id too.

    A link is two tokens that end together; a pair's count is how many links of the whole table hold it. n_best are the
    links whose count no other partner of their second id exceeds, count_sum the sum of counts over links. groups are texts
    like ``a1,a2|b1;a3|b2,b3`` or, with digest, their SHA-256. Null and empty texts, and those that either tokenizer
    doesn't give back byte by byte, have no tokens: zeros and ''.
    """
    small_batches(df.sparkSession)
    rows = inputs(df, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    arrays = f"ids array<{kind}>, {', '.join(f'{c} array<bigint>' for c in _DOCS)}, groups array<string>, ends array<int>, place array<int>, times array<int>, pairs array<bigint>, total array<bigint>"
    made = stored(rows.mapInArrow(_batches(pair, digest, batch_bytes), f"batch bigint, {arrays}"), "aligned", keep=True)
    links = made.select("batch", F.posexplode(F.arrays_zip("pairs", "total")).alias("at", "x")).select("batch", "at", F.col("x.pairs").alias("pair"), F.col("x.total").alias("n"))
    counts = links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = links.join(known, "pair").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("known"))  # a batch's own pairs
    both = made.drop("pairs", "total").join(back, "batch", "left")
    place, times, ends, known = (F.col(c) for c in ("place", "times", "ends", "known"))

    def document(d: Column, k: Column) -> Column:
        start = F.coalesce(F.get(ends, k - 1), F.lit(0))
        mine = [F.slice(x, start + 1, d["ends"] - start) for x in (place, times)]

        def over(value: Callable[[Column], Column]) -> Column:
            """The sum of value(what is known of the pair) over the document's links."""
            return F.aggregate(F.zip_with(*mine, lambda p, n: n * value(F.get(known, p))), F.lit(0).cast("bigint"), lambda x, y: x + y)

        n_best = over(lambda x: x["best"].cast("bigint")).alias("n_best")
        return F.struct(d["ids"].alias("doc_id"), *(d[c].alias(c) for c in _DOCS), over(lambda x: F.lit(1).cast("bigint")).alias("n_links"), n_best, over(lambda x: x["count"]).alias("count_sum"), d["groups"].alias("groups"))

    return both.select(F.inline(F.transform(F.arrays_zip("ids", *_DOCS, "groups", "ends"), document)))
