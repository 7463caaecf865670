"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (per-coordinate, with an L1 and an L2
penalty), followed by temperature calibration on documents the training left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import inputs, sampled, small_batches

ORDERS = (1, 2, 3, 4)
BITS = 16
#: TF is a share of the document's n-grams; this brings a typical feature to the order of 1.
GAIN = 40.0
#: Bound on the labelled documents that the classifier is fitted on.
MAX_DOCS = 4000
#: Codes below this are looked up in the letter table, the distinct ones above it tested one by one.
_TABLE = 0x10000
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def _letter_table() -> np.ndarray:
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(_TABLE)), np.uint32, _TABLE)


LETTERS = _letter_table()


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text, each other character than a letter read as one blank; empty without a letter."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= _TABLE
    codes = np.where(high, codes, LETTERS[np.minimum(codes, _TABLE - 1)])
    if high.any():
        distinct = np.unique(codes[high])
        other = [c for c in distinct.tolist() if not chr(c).isalpha()]
        codes[np.isin(codes, np.array(other, np.uint32))] = 32
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]  # runs of blanks count once
    if len(codes) < 3:
        return np.empty(0, np.int64)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n, mul in zip(ORDERS, _MIX, strict=True):
        size = len(codes) - n + 1
        if size < 1:
            break
        h = (h[:size] ^ codes[n - 1 :]) * mul
        h = h ^ (h >> np.uint32(15))
        out.append((h ^ np.uint32(n)) & np.uint32((1 << BITS) - 1))
    return np.concatenate(out).astype(np.int64)


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    ids, n = np.unique(grams(text), return_counts=True)
    return ids.astype(np.uint16), n.astype(np.uint16 if len(n) == 0 or n.max() < 1 << 16 else np.uint32)


@dataclass
class LanguageModel:
    """labels in order; weights (bucket x label) with the IDF multiplied in; a bias and the temperature."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, calibrated probability); ('und', 0.0) for null, empty or letterless texts or without a learned label."""
        ids = grams(text)
        if not len(ids) or not self.labels:
            return "und", 0.0
        counts = np.bincount(ids, minlength=len(self.weights)) if len(ids) > len(self.weights) else None
        total = counts @ self.weights if counts is not None else self.weights[ids].sum(axis=0, dtype=np.float64)
        z = (total * (GAIN / len(ids)) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, over all rows: partial counts per partition, summed by Spark; 2**BITS numbers reach the driver."""

    def count(batches: Iterator) -> Iterator:
        df, docs = np.zeros((1 << BITS) + 1, np.int64), 0
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            for text in batch["text"]:
                ids = grams(text)
                if len(ids):
                    seen[ids] = True
                    found = np.flatnonzero(seen)
                    df[found] += 1
                    seen[found] = False
                    docs += 1
        df[-1] = docs
        if docs:
            at = np.flatnonzero(df)
            yield pd.DataFrame({"bucket": at.astype(np.int32), "n": df[at]})

    rows = texts.select("text").mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def fit(rows: Iterable[tuple[str | None, str]], idf: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> LanguageModel:
    """FTRL-proximal on (text, label) rows; every tenth row is kept for the temperature (all rows, if fewer than 20)."""
    data = [(*sparse(t), y) for t, y in rows]
    data = [(i, n, y) for i, n, y in data if len(i)]
    labels = sorted({y for *_, y in data})
    d, k = len(idf) + 1, len(labels)
    if not k:
        return LanguageModel([], np.zeros((len(idf), 0), np.float32), np.zeros(0), 1.0)
    place = {y: n for n, y in enumerate(labels)}
    z, n = np.zeros((d, k)), np.zeros((d, k))
    hold = data[::10] if len(data) >= 20 else data
    train = [x for j, x in enumerate(data) if j % 10] if len(data) >= 20 else data

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    def features(i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a document's features, the bias last; made anew each time, so that a document is held by its counts alone."""
        return np.append(i, np.int32(d - 1)).astype(np.int64), np.append((n * (GAIN / n.sum()) * idf[i]).astype(np.float32), np.float32(1.0))

    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max())
        return e / e.sum()

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for j in order.permutation(len(train)):
            at, x = features(*train[j][:2])
            w = weights(at)
            g = softmax(x @ w)
            g[place[train[j][2]]] -= 1
            g = np.outer(x, g)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(d))
    scores = np.array([(lambda at, x: x @ w[at])(*features(i, v)) for i, v, _ in hold])
    truth = np.array([place[y] for *_, y in hold])

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        target = 0.98 * s[np.arange(len(s)), truth] + 0.02 * s.mean(axis=1)  # smoothed, so that a faultless sample doesn't ask for certainty
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - target))

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    best = min(grid, key=loss)
    return LanguageModel(labels, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], float(best))


def train(df: DataFrame, label_col: str = "lang", max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """Fit on df's rows with a label: IDF over all of them, weights on a sample of about max_docs.

    Rows with a null label or text are left out; without any row the model knows no language.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    freq, docs = document_frequencies(rows)
    idf = np.log((1 + docs) / (1 + freq)) + 0.1
    return fit(samples(rows, max_docs), idf)


def samples(rows: DataFrame, max_docs: int) -> list[tuple[str, str]]:
    """Text and label of the sampled rows (doc_id, text, label), by id and text."""
    got = sampled(rows, max_docs, "language").collect()
    return [(r["text"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], r["text"]))]


def predictor(df: DataFrame, model: LanguageModel):
    """A column function text -> struct<lang, score>. The broadcast holds 2**BITS weights a label."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return predict


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of df (repeated rows included).

    Null, empty or letterless texts are 'und' with score 0.0; ties go to the label that sorts first.
    """
    rows = inputs(df, id_col, text_col)
    found = rows.select("doc_id", predictor(df, model)("text").alias("p"))
    return found.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_known(df: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """df's rows, columns unchanged, whose language is known with a probability of least or more; repeated rows and null ids are judged like others, null and empty texts go."""
    p: Column = predictor(df, model)(F.col(text_col))
    kept = df.select(F.struct("*").alias("row"), p.alias("p")).where((F.col("p.lang") != "und") & (F.col("p.score") >= least))
    return kept.select("row.*")
