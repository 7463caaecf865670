"""Similarity by longest matching blocks (Ratcliff-Obershelp), and one-to-one matching on it.

``difflib`` gives the ratio. Pairs meet only within a group (a page or a slide), and an
upper bound of the ratio from the lengths spares most comparisons in a search.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossalake.functions.text import is_translatable_paragraph, strip
from glossalake.shared import small_batches


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def bound(a: str, b: str) -> float:
    """The highest ratio that the lengths allow."""
    return 2 * min(len(a), len(b)) / max(1, len(a) + len(b))


def _plain(t: str) -> str:
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t.lower())).strip()


def _bare(t: str) -> str:
    return re.sub(r"[^\w]", "", t.lower())


def normalized(a: str | None, b: str | None) -> float:
    """Ratio of the normalised texts; 0 if one is blank."""
    a, b = _plain(a or ""), _plain(b or "")
    return ratio(a, b) if a and b else 0.0


def penalised(a: str | None, b: str | None) -> float:
    """Ratio without white space, less for unequal lengths; two blank texts are equal."""
    a, b = ("".join((x or "").split()) for x in (a, b))
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    longest = max(len(a), len(b))
    return ratio(a, b) * max(0.7, 1 - 0.3 * abs(len(a) - len(b)) / longest)


def weighted(a: str | None, b: str | None) -> float:
    """0.3 of the likeness of lengths and 0.7 of the ratio in lower case."""
    a, b = a or "", b or ""
    alike = 1 - abs(len(a) - len(b)) / max(len(a), len(b), 1)
    return 0.3 * alike + 0.7 * ratio(a.lower(), b.lower())


def characters_and_words(a: str | None, b: str | None) -> float:
    """0.6 of the ratio by characters and 0.4 of that by words."""
    a, b = (re.sub(r"""[.,!?;:()\[\]{}"'`~]""", "", " ".join((x or "").lower().split())).strip() for x in (a, b))
    return 0.6 * ratio(a, b) + 0.4 * SequenceMatcher(None, a.split(), b.split()).ratio() if a and b else 0.0


def skips_insertion(a: str | None, b: str | None, threshold: float = 0.9) -> bool:
    """Whether a translation adds nothing: blank, equal or too much alike."""
    return not a or not b or a.strip() == b.strip() or characters_and_words(a, b) >= threshold


def _udf(f: Callable, kind: str):
    small_batches(SparkSession.active())

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])

    return run


def similarity(measure: str = "ratio"):
    """A column function of two texts."""
    plain = {"ratio": lambda a, b: ratio(a or "", b or ""), "normalized": normalized, "penalised": penalised, "weighted": weighted, "characters_and_words": characters_and_words}
    return _udf(plain[measure], "double")


def skip_insertion(threshold: float = 0.9):
    return _udf(lambda a, b: skips_insertion(a, b, threshold), "boolean")


def most_similar(target: str, candidates: list[str], floor: float | None = 0.6) -> str | None:
    """The best candidate above the floor, the first on a tie, else the target; without a floor the best of all, null without candidates."""
    best, high = (target if floor is not None else None), (0.0 if floor is not None else -1.0)
    for c in candidates or ():
        if floor is not None and (not c or bound(target, c) <= high):
            continue
        r = ratio(target.lower(), c.lower()) if floor is not None else ratio(target, c)
        if r > high and (floor is None or r >= floor):
            best, high = c, r
    return best


def find_most_similar(floor: float | None = 0.6):
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def run(target: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else most_similar(t, list(c) if c is not None else [], floor) for t, c in zip(target, candidates, strict=True)], dtype=object)

    return run


def best_of_all(df: DataFrame, key: str, text: str, floor: float | None = 0.6, block: int = 64) -> DataFrame:
    """key and best: for each text the most similar among those of all other keys, as ``most_similar`` finds it with candidates by key (a block of them at a time).

    Without a floor the case of letters counts, every text has a best one if there is another, and null texts have none.
    """
    small_batches(df.sparkSession)
    blocks = df.where(F.col(text).isNotNull()).groupBy(F.floor(F.col(key) / block).alias("__b")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("t")))).alias("__c")).drop("__b")

    @F.pandas_udf("score double, k bigint, t string")
    def best(keys: pd.Series, targets: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        out = []
        for key, target, candidates in zip(keys, targets, blocks, strict=True):
            found, high = (None, None), 0.0 if floor is not None else -1.0
            for c in candidates if target is not None else ():
                if c["k"] == key or (floor is not None and not c["t"]) or (bound(target, c["t"]) <= high and high > 0):
                    continue
                r = ratio(target.lower(), c["t"].lower()) if floor is not None else ratio(target, c["t"])
                if r > high and (floor is None or r >= floor):
                    found, high = (c["k"], c["t"]), r
            out.append((high, *found))
        return pd.DataFrame({"score": [h for h, *_ in out], "k": pd.array([k for _, k, _ in out], "Int64"), "t": pd.Series([t for *_, t in out], dtype=object)})

    met = df.select(F.col(key), F.col(text).alias("__t")).repartition(key).crossJoin(blocks).select(key, "__t", best(key, "__t", "__c").alias("b"))
    first = F.max_by("b.t", F.struct(F.col("b.score"), -F.col("b.k")))  # without a find: the lowest score and a null key, which sorts first
    return met.groupBy(key).agg((first if floor is None else F.coalesce(first, F.first("__t"))).alias("best"))


def assign_paragraphs(paragraphs: list[str], pairs: list[tuple[str, str]], floor: float = 0.3) -> dict[int, tuple[str, str]]:
    """place -> (translation, stage): equal texts first, then equal when normalised, then the most alike left, each translation once. Equal paragraphs count as the first of them."""
    given = dict(pairs)
    place = {p: k for k, p in reversed(list(enumerate(paragraphs)))}
    out: dict[int, tuple[str, str]] = {}
    used: set[str] = set()

    def take(p: str, source: str, stage: str) -> None:
        out[place[p]] = (given[source], stage)
        used.add(source)

    for p in paragraphs:
        if p.strip() in given and p.strip() not in used:
            take(p, p.strip(), "exact")
    by_bare: dict[str, str] = {}
    for source in given:
        if _bare(source):
            by_bare.setdefault(_bare(source), source)
    for p in paragraphs:
        source = by_bare.get(_bare(p.strip()))
        if place[p] not in out and source is not None and source not in used:
            take(p, source, "normalized")
    for p in [p for p in paragraphs if place[p] not in out]:
        best, high = None, floor
        for source in given:
            if source not in used and (s := weighted(p.strip(), source)) > high:
                best, high = source, s
        if best is not None and given[best]:
            take(p, best, "similar")
    return out


def assign_boxes(data: list[str], shapes: list[str], floor: float = 0.7) -> dict[int, tuple[int, str]]:
    """box -> (shape, stage): the first equal one that is free, then the most alike from the floor, then what is left in order."""
    data, shapes = [d.strip() for d in data], [s.strip() for s in shapes]
    out: dict[int, tuple[int, str]] = {}
    free = dict.fromkeys(range(len(shapes)))
    for k, d in enumerate(data):
        if (same := next((j for j in free if shapes[j] == d), None)) is not None:
            out[k] = (same, "exact")
            del free[same]
    for k, d in enumerate(data):
        if k in out:
            continue
        scored = [(penalised(d, shapes[j]), -j) for j in free]
        score, j = max(scored, default=(0.0, 0))
        if score >= floor and score > 0:
            out[k] = (-j, "similar")
            del free[-j]
    for k, j in zip([k for k in range(len(data)) if k not in out], list(free), strict=False):
        out[k] = (j, "order")
    return out


def match_paragraphs(paragraphs: DataFrame, translations: DataFrame, group: str) -> DataFrame:
    """group, place, translation, stage. Paragraphs (group, place, text) and translations (group, place, source, target) meet group by group; a group is a slide, so it is small.

    Paragraphs that aren't worth translating take no part.
    """
    paragraphs = paragraphs.where(is_translatable_paragraph(F.col("text")))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("place"), right.sort_values("place")
        got = assign_paragraphs(left["text"].tolist(), list(zip(right["source"], right["target"], strict=True)))
        places, key = left["place"].tolist(), left[group].tolist()[:1]
        return pd.DataFrame([(key[0], places[k], t, s) for k, (t, s) in got.items()], columns=[group, "place", "translation", "stage"])

    kind = paragraphs.schema[group].dataType.simpleString()
    return paragraphs.groupBy(group).cogroup(translations.groupBy(group)).applyInPandas(run, f"{group} {kind}, place int, translation string, stage string")


def match_boxes(boxes: DataFrame, shapes: DataFrame, group: str) -> DataFrame:
    """group, box, shape, stage for boxes and shapes (group, place, text) of a page."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("place"), right.sort_values("place")
        got = assign_boxes(left["text"].tolist(), right["text"].tolist())
        a, b, key = left["place"].tolist(), right["place"].tolist(), left[group].tolist()[:1]
        return pd.DataFrame([(key[0], a[k], b[j], s) for k, (j, s) in got.items()], columns=[group, "box", "shape", "stage"])

    kind = boxes.schema[group].dataType.simpleString()
    return boxes.groupBy(group).cogroup(shapes.groupBy(group)).applyInPandas(run, f"{group} {kind}, box int, shape int, stage string")


def match_shape(texts: DataFrame, shapes: DataFrame, group: str, floor: float = 0.7) -> DataFrame:
    """For each text (group, place, text) the equal shape, else the most alike above the floor; shapes may serve twice.

    Texts of shapes are stripped and have line feeds alone as line ends; a blank one is only equal to a blank text. Equal ones
    meet by their text; what is left meets the shapes of its group whose lengths allow the floor, and those alone are compared.
    """
    bare = strip(F.regexp_replace("text", r"\r\n?", "\n"))
    s = shapes.select(F.col(group).alias("__group"), F.col("place").alias("shape"), bare.alias("__text"))
    first = s.groupBy("__group", "__text").agg(F.min("shape").alias("shape"))
    same = F.col(group) == F.col("__group")
    equal = texts.join(first, same & (F.col("text") == F.col("__text"))).groupBy(group, "place").agg(F.min("shape").alias("shape"))
    rest = texts.join(equal.select(group, "place"), [group, "place"], "left_anti")
    a, b, low_a, low_b = F.length("text"), F.length("__text"), F.length(F.lower("text")), F.length(F.lower("__text"))
    highest = 0.3 * F.least(a, b) / F.greatest(a, b, F.lit(1)) + 0.7 * 2 * F.least(low_a, low_b) / F.greatest(low_a + low_b, F.lit(1))
    met = rest.join(first, same & (F.col("__text") != "") & (highest > floor - 1e-9))
    scored = met.withColumn("score", similarity("weighted")("text", "__text")).where(F.col("score") > floor)
    return equal.unionByName(scored.groupBy(group, "place").agg(F.max_by("shape", F.struct("score", -F.col("shape"))).alias("shape")).select(group, "place", "shape"))
