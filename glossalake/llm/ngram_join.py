"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its word shingles. Sets are ordered by how common a shingle is
(rare ones first, by a table of common shingles of bounded size, then by hash). Of two
sets that reach the threshold, the first ``n - ceil(t n) + l`` elements of each share l
at least; a document whose prefix looks costly (common shingles) takes a longer prefix
and a larger l. Documents are gathered in blocks; a task compares two blocks that share enough elements, counts those
of each pair and verifies exactly what is left. It returns a spanning forest of the links, never the pairs.
A family of near copies that fills several blocks is first compared with a few of its documents; only what
they don't link to the rest then meets all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import dropped, inputs, small_batches, stored, unused
from glossalake.llm.components import components

WORDS, PERCENT = 5, 80
#: Bound on the table of common shingles, which is broadcast.
COMMON = 400_000
#: Shingles counted together when common ones are looked for, and copies from which one counts there.
CHUNK, OFTEN = 4_000_000, 4
#: Elements of a set for each further element to share, and how many more a costly prefix may ask for.
STEP, COSTLY = 16, 8
BLOCK = 256
#: Documents of a family of several blocks that are compared with all of it first.
GUESTS = 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Word -> 64-bit number, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_KNOWN = _Numbers()


def _numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes: A-Z in lower case, words between blanks of ASCII; fewer words than size make one shingle, none make an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    numbers = _numbers(words)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * _BASE + numbers[k : len(numbers) - size + 1 + k]
    out = out * _BASE
    return np.unique(out ^ (out >> np.uint64(32)))


class Order:
    """Common shingles and how many texts hold them, roughly; what is not listed counts as rare."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.ones(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.counts[at], 1)

    def prefix(self, s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
        """The indexed elements of a set, and how many of them a partner must share."""
        n = len(s)
        if not n:
            return s, 1
        least = -(-percent * n // 100)
        seen = self.frequency(s)
        level = np.log2(seen).astype(np.int64)
        order = np.argsort(level, kind="stable")
        base = n - least + 1
        cost = seen[order[:base]].sum() / base  # partners that an element of the prefix brings, on average
        match = 1 + min(n // STEP + min(int(math.log2(cost)), COSTLY), least - 1)
        return s[order[: base + match - 1]], match


def needed(n: int, percent: int = PERCENT) -> int:
    """What a set of n must share with any partner: partners have percent of n elements at least."""
    return 1 + min(-(-percent * n // 100) // STEP, -(-percent * (-(-percent * n // 100)) // 100) - 1)


def survey(docs: DataFrame, size: int) -> DataFrame:
    """One pass over the texts (doc_id, hash, text): rows of documents (doc_id, hash, n, a, b: size and signature of the set),
    and of shingles (token, count) that occur OFTEN or more in a chunk of texts; ``count`` is null for the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(**columns) -> pa.RecordBatch:
            k = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * k), pa.int64()) for c in names], names)

        def often(held: list) -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return rows(token=tokens[n >= OFTEN].view(np.int64), count=n[n >= OFTEN])

        names = ["doc_id", "hash", "n", "a", "b", "token", "count"]
        held, total = [], 0
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column("text")):
                s = shingles(text.as_py(), size)
                if len(s):
                    out[:, k] = (len(s), *np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                held.append(s)
                total += len(s)
                if total > CHUNK:
                    yield often(held)
                    held, total = [], 0
            yield rows(doc_id=batch.column("doc_id"), hash=batch.column("hash"), n=out[0], a=out[1], b=out[2])
        if held:
            yield often(held)

    return docs.mapInArrow(run, "doc_id bigint, hash bigint, n bigint, a bigint, b bigint, token bigint, count bigint")


def _threshold(counts: DataFrame, column: str, most: int) -> float:
    """The least count, in steps of an eighth of a doubling, from which at most ``most`` rows are left."""
    level = F.floor(F.log2(column) * 8).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    total, least = 0, math.inf
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return 2 ** (least / 8) * (1 - 1e-9)


def common_shingles(surveyed: DataFrame) -> Order:
    """The most common shingles, up to COMMON, by their counts over all chunks."""
    counts = stored(surveyed.where("count is not null").groupBy("token").agg(F.sum("count").alias("n")), "common")
    kept = counts.where(F.col("n") >= F.lit(float(_threshold(counts, "n", COMMON)))).toArrow()
    out = Order(kept.column("token").to_numpy().view(np.uint64), kept.column("n").to_numpy())
    dropped(surveyed.sparkSession, counts)
    return out


def _postings(docs: DataFrame, order, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owners, needs = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py(), size)
                if doc is None or not len(s):
                    continue
                tokens.append(order.value.prefix(s, percent)[0])
                owners.append(np.full(len(tokens[-1]), doc, np.int64))
                needs.append(np.full(len(tokens[-1]), needed(len(s), percent), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(needs))], ["token", "doc", "need"])

    return docs.mapInArrow(run, "token bigint, doc bigint, need int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and doc -> those of tokens with two documents or more, with the first document; one row is held at a time beside a batch."""
    token = pivot = need = None
    emitted = False
    for batch in batches:
        t, d, n = (batch.column(c).to_numpy() for c in ("token", "doc", "need"))
        start = np.concatenate(([token is None or t[0] != token], t[1:] != t[:-1])) if len(t) else np.empty(0, bool)
        if not len(t):
            continue
        group = np.cumsum(start) - 1 + (not start[0])
        firsts = np.concatenate(([] if start[0] else [pivot], d[start])).astype(np.int64)
        size = np.bincount(group, minlength=len(firsts))
        if not start[0]:
            size[0] += 2  # goes on from the batch before
        keep = size[group] > 1
        rows = [t[keep], d[keep], firsts[group][keep], n[keep]]
        if not start[0] and not emitted:
            rows = [np.concatenate(([a], x)) for a, x in zip((token, pivot, pivot, need), rows, strict=True)]
        last = group[-1]
        if start.any():
            need = n[np.flatnonzero(start)[-1]]
        emitted = bool(size[last] > 1)
        token, pivot = t[-1], firsts[last]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in rows], ["token", "doc", "pivot", "need"])


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left x right, by products of 0/1 matrices over the elements that occur twice, some columns at a time."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, column = np.unique(np.concatenate(sets), return_inverse=True)
    twice = np.bincount(column) > 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = twice[column]
    row, column = row[keep], (np.cumsum(twice) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(twice.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m[left] @ m[right].T
    return np.rint(out).astype(np.int64)


def _compare(docs: np.ndarray, sides: np.ndarray, texts: list, order: Order, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (document, smallest document reached) between the two sides of a group, or within its only one."""
    sets = [shingles(t, size) for t in texts]
    prefixes, match = zip(*(order.prefix(s, percent) for s in sets), strict=True)
    match, n = np.array(match), np.fromiter(map(len, sets), np.int64, len(sets))
    one = not sides.any()
    left, right = (np.arange(len(docs)),) * 2 if one else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    near = _intersections(list(prefixes), left, right) >= np.minimum(match[left][:, None], match[right][None, :])
    if one:
        near &= np.tri(len(docs), k=-1, dtype=bool)
    x, y = np.nonzero(near)
    if not len(x):
        return docs[:0], docs[:0]
    a, b = left[x], right[y]
    some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(x) > 400:
        place = np.searchsorted(some, np.arange(len(docs)))
        l, r = np.unique(a), np.unique(b)
        both = _intersections([sets[k] for k in some], place[l], place[r])
        shared = both[np.searchsorted(l, a), np.searchsorted(r, b)]
    else:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
    good = 100 * shared >= percent * (n[a] + n[b] - shared)
    a, b = a[good], b[good]
    root = np.argsort(np.argsort(docs, kind="stable"), kind="stable")
    while True:
        before, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == before).all():
            break
    linked = np.unique(np.concatenate([a, b]))
    return docs[linked], np.sort(docs)[root[linked]]


def _verify(order, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                docs, sides, texts = zip(*rows, strict=True)
                if key[0] != key[1] and len(set(sides)) < 2:
                    return  # nobody came from the other block
                a, b = _compare(np.array(docs), np.array(sides), texts, order.value, size, percent)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            for x, y, doc, side, text in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "doc", "side", "text")), strict=True):
                if (x, y) != key:
                    yield from ended(held)
                    key, held = (x, y), []
                held.append((doc, side, text))
        yield from ended(held)

    return run


def _blocks_of(home: str = "home", parts: str = "parts") -> Column:
    """The blocks of a family, by the rule that deals its documents."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda k: F.xxhash64(home, k.cast("bigint")))


def _guests(family: DataFrame) -> DataFrame:
    """A few documents of a family of several blocks, as further members of all its other blocks."""
    picked = [F.min_by(F.struct("doc", "block"), F.xxhash64("doc", F.lit(k))) for k in range(GUESTS)]
    guests = family.groupBy("home", "parts").agg(F.array_distinct(F.array(*picked)).alias("g"))
    each = guests.select("home", "parts", F.explode("g").alias("g")).select("g.doc", "g.block", F.explode(_blocks_of()).alias("x"))
    return each.where("block <> x").select("doc", "x", F.col("x").alias("y"), F.lit(0).alias("side"))


def _unsettled(family: DataFrame, found: DataFrame) -> DataFrame:
    """What is left to compare in families of several blocks.

    The links found so far, within blocks and with the guests, make components. Two documents of the largest one of their
    family need no comparison; every other document meets all blocks of the family, in groups of two blocks' size.
    """
    joined = components(found.join(family.select(F.col("doc").alias("a")), "a", "left_semi"))
    placed = family.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    counts = placed.groupBy("home", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("home").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    rest = placed.join(main, "home").where("component <> main")
    chunks = rest.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    dealt = rest.join(chunks, "home").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("chunks")).cast("int"))
    group = F.xxhash64("x", "chunk").alias("y")
    visitors = dealt.select("doc", "block", "chunk", F.explode(_blocks_of()).alias("x")).where("block <> x").select("doc", "x", group, F.lit(1).alias("side"))
    residents = family.join(chunks, "home").select("doc", F.col("block").alias("x"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return visitors.unionByName(residents.select("doc", "x", group, F.lit(0).alias("side")))


def join(df: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) for every row of df.

    Two documents link when percent or more of the union of their sets is shared. Null, empty and
    wordless texts have an empty set and link with nothing; so do rows with a null id. Ids are whole numbers;
    rows that repeat an id with other texts all take part, and share one component.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = inputs(df, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    surveyed = stored(survey(docs, size), "survey")
    signed = surveyed.where("count is null").select("doc_id", "hash", "n", "a", "b")
    full = signed.where("n > 0 and doc_id is not null")
    sets = stored(full.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "sets")
    copies = stored(full.join(sets, ["a", "b"]).where("doc_id <> first").select(F.col("doc_id").alias("copy"), F.col("hash").alias("copy_hash"), "first"), "copies")
    # of the documents with one set, only the first is compared with others
    lone = docs.join(copies, (docs["doc_id"] == copies["copy"]) & (docs["hash"] == copies["copy_hash"]), "left_anti")
    order = spark.sparkContext.broadcast(common_shingles(surveyed))

    tokens = _postings(lone, order, size, percent).repartition("token").sortWithinPartitions("token", "doc")
    shared = stored(tokens.mapInArrow(_shared, "token bigint, doc bigint, pivot bigint, need bigint"), "shared")
    enough = shared.groupBy("doc").agg(F.min("pivot").alias("home"), F.min("need").alias("need"), F.count("*").alias("k")).where("k >= need")
    near = stored(enough.select("doc", "home", "need"), "near")
    # the home spreads once more through shared elements, so that a family of near copies has one in common
    ours = stored(shared.join(near, "doc").select("token", "doc", "home", near["need"]), "ours")
    spread = ours.groupBy("token").agg(F.min("home").alias("least"))
    homes = stored(ours.join(spread, "token").groupBy("doc").agg(F.min("least").alias("home"), F.min("need").alias("need")), "homes")
    parts = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    blocks = stored(homes.join(parts, "home").select("doc", "need", "home", "parts", F.xxhash64("home", part.cast("bigint")).alias("block")), "blocks")
    # a document goes to another family only if it shares enough elements with a block there
    held = stored(ours.select("token", "doc").join(blocks.drop("parts"), "doc"), "held")
    places = held.select("token", F.col("home").alias("other_home"), F.col("block").alias("other")).distinct()
    several = held.groupBy("token").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a < b").select("token")
    far = held.join(several, "token").join(places, "token").where("home <> other_home").groupBy("doc", "block", "other", "need").agg(F.count("*").alias("k")).where("k >= need")
    far = far.select("doc", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    within = blocks.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block")
    stays = blocks.join(within, "block").select("doc", F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text")

    def compared(groups: DataFrame) -> DataFrame:
        together = groups.join(texts, "doc").select("x", "y", "doc", "side", "text").repartition("x", "y").sortWithinPartitions("x", "y")
        return together.mapInArrow(_verify(order, size, percent), "a bigint, b bigint")

    family = stored(blocks.where("parts > 1").select("doc", "home", "parts", "block"), "family")
    found = stored(compared(far.unionByName(stays).unionByName(_guests(family))), "found")
    if not family.isEmpty():
        later = stored(_unsettled(family, found), "later")
        found = found.unionByName(compared(later))
    comp = components(found.unionByName(copies.select(F.col("copy").alias("a"), F.col("first").alias("b"))))
    for table in (sets, copies, shared, near, ours, homes, blocks, held, family):
        dropped(spark, table)
    return signed.join(comp, signed["doc_id"] == comp["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """df's rows, columns unchanged, without the documents that link, directly or not, with one of a smaller id.

    Null, empty and wordless texts link with nothing and stay, as do rows with a null id; all rows of an id stay or go together.
    """
    later = join(df, id_col=id_col, **options).where("doc_id <> component_id").select("doc_id").distinct().withColumnRenamed("doc_id", (name := unused(df, "later")))
    return df.join(later, df[id_col] == F.col(name), "left_anti")
