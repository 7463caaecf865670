"""Translation by a pluggable translator, batch by batch; no network calls are made here."""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Translator(Protocol):
    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]: ...


class DictionaryTranslator:
    """Whole texts by a dictionary; null for an unknown one."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.entries = entries

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        return [self.entries.get(t) for t in texts]


#: Calls that run side by side, calls in all for a text that fails, and the seconds before the second one, which double.
CONCURRENCY, ATTEMPTS, DELAY = 3, 3, 2.0


def answered(translator: Translator, texts: list[str], source: str, target: str, concurrency: int = CONCURRENCY, attempts: int = ATTEMPTS, delay: float = DELAY) -> list[tuple[str | None, str | None]]:
    """(translation, error) for each text: every one is a call of its own, at most ``concurrency`` at a time, and a failing one is tried again by itself."""

    def one(text: str) -> tuple[str | None, str | None]:
        for k in range(attempts):
            try:
                return translator.translate([text], source, target)[0], None
            except Exception as e:  # noqa: BLE001  whatever fails is told in the row
                error = str(e)[:255] or type(e).__name__
                if k + 1 < attempts and delay:
                    time.sleep(delay * 2**k)
        return None, error

    with ThreadPoolExecutor(concurrency) as pool:
        return list(pool.map(one, texts))


def translate(df: DataFrame, translator: Translator, source: str, target: str, column: str = "text", concurrency: int = CONCURRENCY, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """df with translation and error; where the translator gives null or fails on a text, the original stays. A null text counts as empty.

    A task asks for each distinct text of an Arrow batch once. The bound on concurrency is a task's: the cores of the cluster times it is what a service must bear.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[column].fillna("")
            distinct = texts.unique().tolist()
            got = dict(zip(distinct, answered(translator, distinct, source, target, concurrency, attempts, delay), strict=True))
            pairs = [got[t] for t in texts]
            yield batch.assign(translation=[t if g is None else g for t, (g, _) in zip(texts, pairs, strict=True)], error=[e for _, e in pairs])

    return df.mapInPandas(run, StructType([*df.schema, StructField("translation", StringType()), StructField("error", StringType())]))


# The domains of documents.
DOMAINS = ("医学", "工程技术", "商业管理", "教育培训", "科学研究", "法律", "金融", "艺术设计", "信息技术", "其他")


FALLBACK = "其他"
#: Characters of a text that its domain is judged by.
JUDGED = 1000


class Dispatcher:
    """Translators by model; stop words stay as they are, custom translations come before the translator's own.

    The application asks a model to keep to both; here a whole text that is a stop word or has a custom translation is settled without the model.
    """

    def __init__(self, models: dict[str, Translator], stop_words: tuple[str, ...] = (), custom: dict[str, str] | None = None) -> None:
        self.models, self.stop_words, self.custom = models, frozenset(stop_words), custom or {}

    def by(self, model: str) -> Translator:
        """The translator of a model; ValueError for one that there isn't."""
        if model not in self.models:
            raise ValueError(f"unknown model: {model}")
        return _Settled(self.models[model], self.stop_words, self.custom)


class _Settled:
    def __init__(self, inner: Translator, stop_words: frozenset[str], custom: dict[str, str]) -> None:
        self.inner, self.stop_words, self.custom = inner, stop_words, custom

    def translate(self, texts: list[str], source: str, target: str) -> list[str | None]:
        settled = {t: t if t in self.stop_words else self.custom[t] for t in texts if t in self.stop_words or t in self.custom}
        rest = [t for t in texts if t not in settled]
        got = dict(zip(rest, self.inner.translate(rest, source, target), strict=True)) if rest else {}
        return [settled[t] if t in settled else got[t] for t in texts]


def with_domain(df: DataFrame, keywords: dict[str, list[str]], column: str = "text", fallback: str = FALLBACK) -> DataFrame:
    """df with ``domain``: the one with the most occurrences of its keywords in the first 1000 characters, the first listed on a tie, the fallback without any.

    A stand-in for the application's question to a model, which sees as many characters.
    """
    head = F.substring(F.coalesce(F.col(column), F.lit("")), 1, JUDGED)
    count = lambda k: F.floor((F.length(head) - F.length(F.replace(head, F.lit(k)))) / len(k))
    scored = [F.struct(sum((count(k) for k in words), F.lit(0)).alias("n"), F.lit(-place).alias("p"), F.lit(d).alias("d")) for place, (d, words) in enumerate(keywords.items())]
    if not scored:
        return df.withColumn("domain", F.lit(fallback))
    best = F.array_max(F.array(*scored))
    return df.withColumn("domain", F.when(best["n"] > 0, best["d"]).otherwise(fallback))
