"""Quality rules by repetition: how many characters of a text stand in n-grams and lines that it has had before.

Words are numbered exactly within a batch. One prefix sum of their values gives the rolling hash of every
window of every length; only windows of the shortest length are all sorted, since a longer one repeats only
where its beginning does. Windows of equal hash are compared word by word, and a collision, should there be
one, draws other values, so that results don't depend on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossalake.llm.common import inputs, small_batches

#: Words of a window, and hundredths of a text's characters that may stand in windows equal to an earlier one. The limits published for web corpora
#: are 15 to 10; texts with one heading at both ends reach 12, so each is 5 higher here.
NGRAMS = {5: 20, 6: 19, 7: 18, 8: 17, 9: 16, 10: 15}
#: Hundredths of the characters that lines equal to an earlier one may take. Lines themselves aren't counted against a limit: a short text with one heading at both ends would fail.
LINE_CHARS = 30
#: The base rule: fewest words, and hundredths of the words that windows of REPEAT words found twice or more may cover.
LEAST_WORDS, REPEAT, REPEATED = 10, 5, 20
#: Bytes of text that are measured together; a longer text by itself.
TOGETHER = 4 << 20
_BLANKS = r"[\x20\x09-\x0D]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in NGRAMS)]


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for each text of an array without nulls."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    words, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)  # blanks at an end leave an empty word
    words, of = words.filter(there).dictionary_encode(), of[there.to_numpy(zero_copy_only=False)]
    codes, chars = words.indices.to_numpy(), pc.utf8_length(words.dictionary).to_numpy()
    chars = chars[codes] if len(codes) else np.empty(0, np.int32)

    def total(where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(where, weights, n).astype(np.int64)

    out = {"n_words": total(of), "word_chars": total(of, chars), "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy().astype(np.int64)}
    split = pc.split_pattern(texts, "\n")
    lines, holds = split.flatten(), pc.list_parent_indices(split).to_numpy()
    there = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    lines, holds = lines.filter(there).dictionary_encode(), holds[there.to_numpy(zero_copy_only=False)]
    place = lines.indices.to_numpy().astype(np.int64) + holds.astype(np.int64) * max(1, len(lines.dictionary))  # of a line's text and its document
    again = np.ones(len(place), bool)
    again[np.unique(place, return_index=True)[1]] = False
    size = pc.utf8_length(pc.replace_substring_regex(lines.dictionary, _BLANKS, "")).to_numpy()
    out |= {"n_dup_lines": total(holds[again]), "dup_line_chars": total(holds[again], size[lines.indices.to_numpy()[again]])}
    for k, (any_of, later) in repeats(codes, of, list(NGRAMS)).items():
        if k == REPEAT:
            out["n_repeat_words"] = total(of[covered(any_of, k, len(codes))])
        inside = covered(later, k, len(codes))
        out[f"dup_chars_{k}"] = total(of[inside], chars[inside])
    return out


def repeats(codes: np.ndarray, of: np.ndarray, lengths: list[int], seed: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, ascending, the starts of the windows that are found twice or more in their text, and of those that are found earlier in it."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 1 << 62)) * 2 + 1  # odd, so that it has an inverse modulo 2^64
    values = rng.integers(0, 1 << 63, int(codes.max(initial=-1)) + 1, np.uint64) * 2 + 1
    power = _powers(base, len(codes))
    inverse = _powers(pow(base, -1, 1 << 64), len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[codes] * power, dtype=np.uint64)))
    texts = rng.integers(0, 1 << 63, int(of.max(initial=-1)) + 1, np.uint64)
    out, at = {}, np.arange(len(codes))
    for n in lengths:
        at = at[at + n <= len(codes)]
        at = at[of[at] == of[at + n - 1]]
        key = (sums[at + n] - sums[at]) * inverse[at] ^ texts[of[at]]  # of the words and their text, wherever they stand
        order = np.argsort(key, kind="stable")
        key, sorted_at = key[order], at[order]
        same = key[1:] == key[:-1]
        a, b = sorted_at[:-1][same], sorted_at[1:][same]
        if (of[a] != of[b]).any() or any((codes[a + k] != codes[b + k]).any() for k in range(n)):
            return repeats(codes, of, lengths, seed + 1)
        later = np.zeros(len(at), bool)
        later[1:] = same
        twice = later.copy()
        twice[:-1] |= same
        out[n] = sorted_at[twice], sorted_at[later]
        at = np.sort(sorted_at[twice])  # a longer window repeats only where this one does
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words stand in a window of n words that begins at one of starts."""
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(edges)[:size] > 0


def judged(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails a text, and whether it is kept: it passes that and no n-gram or line limit is exceeded."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEATED * m["n_words"])
    over = 100 * m["dup_line_chars"] > LINE_CHARS * m["word_chars"]
    for n, most in NGRAMS.items():
        over |= 100 * m[f"dup_chars_{n}"] > most * m["word_chars"]
    return failed, ~failed & ~over


def portions(texts: pa.Array, most: int = TOGETHER) -> Iterator[pa.Array]:
    """texts in slices of about ``most`` bytes; a longer text makes a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def rate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept for every row, repeated ones and those with a null id too.

    A null text counts as empty; texts without words have zeros and fail the base rule.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in portions(pc.fill_null(batch.column(1), "")):
                m = measures(texts)
                failed, kept = judged(m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(m[c]) for c in COUNTS), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])
                at += len(texts)

    columns = ", ".join(f"{c} bigint" for c in COUNTS)
    return inputs(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {columns}, base_failed boolean, kept boolean")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with all their columns; equal texts are judged alike."""
    small_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(judged(measures(some))[1]) for some in portions(pc.fill_null(texts, ""))] or [pa.array([], pa.bool_())])

    return df.where(good(F.col(text_col)))
