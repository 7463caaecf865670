"""Secret scans by one combined deterministic automaton over the bytes of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossalake.llm.automaton import compile_rules, parse, reverse
from glossalake.llm.common import inputs, small_batches


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """kind, pattern and the least length; that of the value behind : or = when ``assigned``, else of the match."""

    kind: str
    pattern: str
    least: int = 0
    assigned: bool = False


_WORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
#: The three base kinds first, in the order in which ties are listed.
RULES = (
    Rule("assign", rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # a shorter run can't hold a longer match, so the length may stand in the rule
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", 20),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """Finds, for each rule, its leftmost longest non-overlapping matches; those below the rule's length are dropped without a retry.

    One pass over the bytes tells where any rule ends. Only there, the rule's own
    automata walk back to the start and on to the longest end. A rule must not start
    inside its own prefix later than, and end before, an earlier start (no rule here can).
    """

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.automaton = compile_rules(trees, search=True)
        self.classes, self.search = self.automaton.rows()
        self.forward = [compile_rules([t], search=False).rows() for t in trees]
        self.backward = [compile_rules([reverse(t)], search=False).rows() for t in trees]

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """Rule -> places where it accepts, from one pass over the bytes."""
        row, hits = self.search, []
        for at, kind in enumerate(data.translate(self.classes), 1):
            row = row[kind]
            if row[-2]:
                hits.append((at, row[-2]))
        out: dict[int, list[int]] = {}
        for at, mask in hits:
            for k in range(len(self.rules)):
                if mask >> k & 1:
                    out.setdefault(k, []).append(at)
        return out

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order."""
        out = []
        for k, ends in self.ends(data).items():
            free = 0
            for end in ends:
                if end <= free:
                    continue
                (classes, row), start = self.backward[k], -1
                for at in range(end - 1, free - 1, -1):
                    row = row[classes[data[at]]]
                    if row[-1]:
                        break
                    if row[-2]:
                        start = at
                if start < 0:
                    continue
                (classes, row), stop = self.forward[k], end
                for at in range(start, len(data)):
                    row = row[classes[data[at]]]
                    if row[-1]:
                        break
                    if row[-2]:
                        stop = at + 1
                free = stop
                if self.length(k, data[start:stop]) >= self.rules[k].least:
                    out.append((start, k, stop))
        return sorted(out)

    def length(self, k: int, match: bytes) -> int:
        if not self.rules[k].assigned:
            return len(match)
        at = min(x for x in (match.find(b":"), match.find(b"=")) if x >= 0)
        value = match[at + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b'"', b"'"))

    def spans(self, text: str | None) -> list[dict]:
        """Matches as kind, start and end in code points."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = self.matches(data)
        if not found:
            return []
        plain = len(data) == len(text)
        place = (lambda b: b) if plain else (lambda b: len(data[:b].decode("utf-8", "surrogatepass")))
        return [{"kind": self.rules[k].kind, "start": place(a), "end": place(b)} for a, k, b in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SCANNERS: dict[tuple, Scanner] = {}


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, by start and then in the order of the rules, for every row of df, repeated ones and those with a null id too; none for null or empty texts."""
    small_batches(df.sparkSession)
    rows = inputs(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _SCANNERS.get(rules) or _SCANNERS.setdefault(rules, Scanner(rules))
        for batch in batches:
            found = [scanner.spans(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """df with each secret in the text replaced by [kind]; overlapping spans become one. Null texts stay null."""
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _SCANNERS.get(rules) or _SCANNERS.setdefault(rules, Scanner(rules))

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out, at = [], 0
            for s in scanner.spans(text):
                if s["end"] > at:
                    out += [text[at : s["start"]], f"[{s['kind']}]" if s["start"] >= at else ""]
                    at = s["end"]
            return "".join([*out, text[at:]])

        for texts in batches:
            yield texts.map(one, na_action=None)

    return df.withColumn(text_col, clean(F.col(text_col)))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of the spans of some kinds or all."""
    kept = spans if kinds is None else of_kinds(spans, kinds)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
