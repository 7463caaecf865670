"""Words of a text that no blanks part: the most probable path through the graph of dictionary words.

A dictionary is a table of words and counts. From every character of a text the words that begin there are edges, and a single
character always is one. The path with the greatest product of frequencies is found from the end of the text backwards, while
an automaton of the words spelt backwards tells the edges: in time of the text's length and of the edges met.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of words that a dictionary may have in all; it is broadcast.
MOST_CHARACTERS = 16 << 20
#: What is segmented by the dictionary; everything else is taken as it stands: runs of letters and digits of other kinds, single signs.
_HAN = r"[㐀-䶿一-鿿豈-﫿々〇]+"
_PARTS = re.compile(rf"({_HAN})|([^\W_]+(?:['.-][^\W_]+)*)|(\S)")


class Dictionary:
    """An automaton of the words, spelt backwards, with the logarithms of their shares; a word that isn't in it has a count of one.

    Read from a text's end to its start it is, at each character, in the state of the longest stretch from there on that some word ends with:
    each state has the words that stand at the beginning of that stretch, so that no place is looked at twice.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        total = math.log(max(1, sum(counts.values())))
        self.unknown = -total
        # a state: those after one more character, the weight of the character alone, length and weight of longer words by length, the state to fall back to
        self.root: list = [{}, self.unknown, (), None]
        for word, n in counts.items():
            state = self.root
            for c in reversed(word):
                state = state[0].setdefault(c, [{}, self.unknown, (), self.root])
            if len(word) == 1:
                state[1] = math.log(n) - total
            else:
                state[2] = ((len(word), math.log(n) - total),)
        level = list(self.root[0].values())
        while level:  # a state falls back to one that is less deep
            below = []
            for state in level:
                for c, to in state[0].items():
                    back = state[3]
                    while back is not None and c not in back[0]:
                        back = back[3]
                    if back is not None:
                        to[3] = back[0][c]
                        to[1], to[2] = to[3][1], to[3][2] + to[2]
                    below.append(to)
            level = below

    def words(self, text: str) -> list[str]:
        """The likeliest words that the text consists of; of equally likely paths the one whose first word that differs is longer."""
        root = state = self.root
        best, sizes = [0.0], []  # from the end
        for c in reversed(text):
            while (to := state[0].get(c)) is None and state is not root:
                state = state[3]
            state = to or root
            _, high, longer, _ = state
            high += best[-1]
            size = 1
            for length, weight in longer:
                if (score := weight + best[-length]) >= high:
                    high, size = score, length
            best.append(high)
            sizes.append(size)
        out, at = [], 0
        while at < len(text):
            end = at + sizes[-1 - at]
            out.append(text[at:end])
            at = end
        return out


def tokens(text: str, dictionary: Dictionary, everything: bool = False) -> list[str]:
    """Words of a text without white space: runs of Han characters by the dictionary, words of other scripts and signs as they stand; ``everything``: all runs of letters by the dictionary."""
    out: list[str] = []
    for m in _PARTS.finditer(text):
        out += dictionary.words(m[0]) if m[1] or (everything and m[2]) else [m[0]]
    return out


@lru_cache(maxsize=2)
def _opened(packed: tuple[tuple[str, int], ...]) -> Dictionary:
    return Dictionary(dict(packed))


def segmenter(words: DataFrame, word: str = "word", count: str = "n", everything: bool = False):
    """A column function: text -> its words (an empty array for null), by a dictionary table; repeated words add up, null and empty ones and counts below one are left out.

    The dictionary is measured before it is collected: ValueError where it is too large to share.
    """
    known = words.where((F.length(word) > 0) & (F.col(count) >= 1)).groupBy(F.col(word).alias("w")).agg(F.sum(count).cast("bigint").alias("n"))
    size = known.agg(F.sum(F.length("w"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"the dictionary has {size} characters, {MOST_CHARACTERS} at most can be shared")
    shared = words.sparkSession.sparkContext.broadcast(tuple(sorted((r["w"], r["n"]) for r in known.collect())))

    @F.pandas_udf("string")
    def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dictionary = _opened(shared.value)
        for texts in batches:
            yield pd.Series([" ".join(tokens(t, dictionary, everything)) if t is not None else "" for t in texts], dtype=object)

    # no word is empty or holds a blank, so that words travel as one text
    return lambda c: F.array_remove(F.split(segment(F.col(c) if isinstance(c, str) else c), " "), "")


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """word and n of runs of letters: a dictionary from texts that blanks do part."""
    letters: Column = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    return df.select(F.explode(letters).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
