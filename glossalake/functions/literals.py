"""Model answers that aren't JSON: Python literals, and texts buried in them."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from glossalake.operators.slides import ITEMS, model_items


def parsed(raw: str | None) -> object:
    """JSON or a Python literal, whole or the first bracketed part; None if there is neither."""
    if not raw:
        return None
    inside = re.search(r"\[.*\]|\{.*\}", raw, re.S)
    for text in (raw, inside[0] if inside else None):
        for read in (json.loads, ast.literal_eval):
            try:
                if text is not None:
                    return read(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                continue
    return None


def texts_in(value: object) -> list[str]:
    """All strings in nested lists and under ``text`` keys of dicts, in order, without blank ones."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, dict):
        return texts_in(value["text"]) if "text" in value else [t for v in value.values() for t in texts_in(v)]
    if isinstance(value, list | tuple):
        return [t for v in value for t in texts_in(v)]
    return []


@F.pandas_udf(StringType())
def as_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The parsed value as JSON; null if nothing can be parsed."""
    for rows in batches:
        yield rows.map(lambda t: None if (v := parsed(t)) is None else json.dumps(v, ensure_ascii=False, default=str), na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def recognised_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts of an OCR answer: those of its list or dict, else the stripped text itself."""
    for rows in batches:
        yield rows.map(lambda t: texts_in(parsed(t)) or texts_in(t), na_action=None)


def model_items_any(raw: Column) -> Column:
    """Items of a model's answer; where it is no JSON, of the Python literal in it."""
    plain = model_items(raw)
    listed = as_json(F.when(F.size(plain) == 0, raw))
    listed = F.when(F.ltrim(listed).startswith("{"), F.concat(F.lit("["), listed, F.lit("]"))).otherwise(listed)
    found = F.filter(F.from_json(listed, ITEMS), lambda x: x["source_language"].isNotNull() & x["target_language"].isNotNull())
    return F.when(F.size(plain) > 0, plain).otherwise(F.coalesce(found, F.array().cast(ITEMS)))
