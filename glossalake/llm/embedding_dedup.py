"""Embedding near-dedup: Euclidean p-stable hashing in several tables, then exact cosines.

Equal vectors of one label form a class and only its representative is hashed. What meets in
a bucket at first is a sketch of each vector (the signs of further projections), not the vector:
a representative goes on only if another sketch of its bucket is near. The vectors of those meet in
the same buckets, in tasks of two blocks, which return how many links each vector has and a spanning
forest of them, never the pairs. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import dropped, small_batches, stored
from glossalake.llm.components import components

COSINE = 0.93
#: Width of a quantisation step for vectors of length 1, and the share of the closest allowed pairs that may be missed.
WIDTH, MISS = 2.0, 0.004
#: Unrelated vectors that a bucket may hold, about; representatives of a block, of which two make a task's group; rows that are compared at a time.
BUCKET, BLOCK, TILE = 2048, 512, 256
#: Bits of a sketch, and standard deviations above the closest allowed pairs' mean from which sketches are apart.
BITS, SIGMAS = 128, 5


def collide(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection puts two points of a distance into one step."""
    c = width / distance
    below = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections a table and tables: buckets of unrelated vectors stay near BUCKET as n grows, and MISS holds."""
    near, far = collide(math.sqrt(2 - 2 * cosine)), collide(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(1, n / BUCKET)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(MISS) / math.log(1 - near**k)))


def apart(cosine: float = COSINE, bits: int = BITS) -> int:
    """Bits in which the sketches of two vectors of that cosine differ at most (one pair in a million has more)."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p)))


def hasher(k: int, count: int, seed: int = 11):
    """A column function: vector -> one key a table, and the two halves of its sketch."""

    @F.pandas_udf("struct<keys:array<bigint>,s0:bigint,s1:bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple] = {}
        for rows in batches:
            out = []
            for v in rows:
                d = len(v)
                if d not in made:
                    rng = np.random.default_rng((seed, d))
                    made[d] = rng.standard_normal((d, k * count)), rng.random(k * count) * WIDTH, rng.integers(1, 1 << 62, k * count) | 1, rng.standard_normal((d, BITS))
                a, b, mix, signs = made[d]
                v = np.asarray(v, np.float64)
                v = v / np.sqrt(v @ v)
                steps = np.floor((v @ a + b) / WIDTH).astype(np.int64)
                with np.errstate(over="ignore"):
                    out.append(((steps * mix).reshape(count, k).sum(axis=1) + d, *np.packbits(v @ signs > 0).view(np.int64)))
            yield pd.DataFrame(out, columns=["keys", "s0", "s1"])

    return keys


def _near(most: int):
    """The members of a group whose sketch is near that of another one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        s = group[["s0", "s1"]].to_numpy().view(np.uint64)
        block, n = group["block"].to_numpy(), len(group)
        i, j = group["i"].iat[0], group["j"].iat[0]
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = np.zeros(n, bool)
        for at in range(0, len(rows), TILE):
            some = rows[at : at + TILE]
            differ = sum(np.bitwise_count(s[some, c][:, None] ^ s[cols, c][None]).astype(np.int16) for c in (0, 1))
            close = (differ <= most) & (some[:, None] != cols[None])
            found[some] |= close.any(axis=1)
            found[cols] |= close.any(axis=0)
        return group.loc[found, ["cls", *_GROUP, "block"]]

    return run


def _compare(cosine: float):
    """Representatives of a group that have links, how many, and roots of a spanning forest."""

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        v = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        v /= np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]
        ids, copies, block = (group[c].to_numpy() for c in ("rep", "copies", "block"))
        i, j, t = (group[c].iat[0] for c in ("i", "j", "t"))
        rows, cols = np.flatnonzero(block == i), np.flatnonzero(block == j)
        held = np.stack(group["keys"].to_numpy())[:, :t] if t else None
        n = len(ids)
        links, root = np.zeros(n), np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # places in order of id
        for at in range(0, len(rows), TILE):
            x, y = np.nonzero(v[rows[at : at + TILE]] @ v[cols].T >= cosine)
            x, y = rows[x + at], cols[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            if t and len(x):
                new = ~(held[x] == held[y]).any(axis=1)  # else an earlier table has the pair
                x, y = x[new], y[new]
            links += np.bincount(x, copies[y], n) + np.bincount(y, copies[x], n)
            _merge(root, x, y)
        linked = links > 0
        return pd.DataFrame({"cls": group["cls"].to_numpy()[linked], "rep": ids[linked], "links": links[linked].astype(np.int64), "root": np.sort(ids)[root[linked]]}) if linked.any() else None

    return run


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Let linked places, and those that had their roots, share the least root."""
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        to = np.arange(len(root))
        np.minimum.at(to, high, low)
        while (to != to[to]).any():
            to = to[to]
        root[:] = to[root]


_GROUP = ["g", "label_hash", "t", "key", "i", "j"]


def _by_group(each: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """each over the groups of rows sorted by group: one group, of two blocks at most, is held at a time beside a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ended(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            at = rows[_GROUP].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(axis=1))))
            bounds = zip(starts, np.append(starts[1:], len(rows)), strict=True)
            out = [got for a, b in bounds if b - a > 1 and (got := each(rows.iloc[a:b].reset_index(drop=True))) is not None and len(got)]
            if out:
                yield pd.concat(out, ignore_index=True)

        held: list[pd.DataFrame] = []
        for batch in (b for b in batches if len(b)):
            at = batch[_GROUP].to_numpy()
            new = (at[1:] != at[:-1]).any(axis=1)
            if held and (held[-1][_GROUP].to_numpy()[-1] != at[0]).any():
                yield from ended(pd.concat(held, ignore_index=True))
                held = []
            if not new.any():
                held.append(batch)
                continue
            cut = int(np.flatnonzero(new).max()) + 1  # the last group may go on
            yield from ended(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
            held = [batch.iloc[cut:]]
        if held:
            yield from ended(pd.concat(held, ignore_index=True))

    return run


def link(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) for every row of df.

    Vectors are compared within a label and a length. Null, empty and zero vectors, those with
    null or non-finite components, and rows with a null label or id link with nothing.
    A repeated row counts as another vector of its id.
    """
    spark = df.sparkSession
    small_batches(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some, F.lit(False))
    sound = rows.where(valid)
    grouped = sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(grouped.select("*", F.xxhash64("label", "embedding").alias("cls")), "vectors")
    most = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    k, count = tables(most, cosine)
    hashed = stored(classes.select("cls", "label", hasher(k, count)("embedding").alias("h")).select("cls", "label", "h.*"), "keys")
    bucket = ["label", "t", "key"]
    spread = hashed.select("cls", "label", "s0", "s1", F.posexplode("keys").alias("t", "key"))
    large = spread.groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    held = spread.join(large, bucket, "left").withColumn("blocks", blocks).withColumn("block", F.pmod("cls", "blocks").cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    group = F.xxhash64("label", "t", "key", "pair.i", "pair.j").alias("g")
    dealt = held.select("*", F.explode(pair).alias("pair")).select("cls", "s0", "s1", "block", group, F.hash("label").alias("label_hash"), "t", "key", "pair.i", "pair.j")
    kind = classes.schema["rep"].dataType.simpleString()
    sketches = dealt.repartition("g").sortWithinPartitions(*_GROUP)
    near = stored(sketches.mapInPandas(_by_group(_near(apart(cosine))), "cls bigint, g bigint, label_hash int, t int, key bigint, i int, j int, block int"), "near")
    vectors = classes.select("cls", "rep", "embedding", "copies").join(hashed.select("cls", "keys"), "cls")
    together = near.join(vectors, "cls").repartition("g").sortWithinPartitions(*_GROUP)
    found = stored(together.mapInPandas(_by_group(_compare(cosine)), f"cls bigint, rep {kind}, links bigint, root {kind}"), "links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    for table in (hashed, near):
        dropped(spark, table)
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = classes.join(links, "cls", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = sound.join(info, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
