"""Sheets (xlsx) and slides (pptx): Spark reads the files, Arrow workers their zip and XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _find(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in node.iter() if _local(x.tag) == name)


def _column(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", reference)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


#: A cell of a sheet by its kind; at most one field is filled.
CELL = "struct<text:string,number:double,flag:boolean,at:timestamp>"
_EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}


def _cells(z: zipfile.ZipFile) -> Iterator[tuple[int, list[tuple[str, str, int] | None]]]:
    """(row number, cells as (type, value, number of their style)) of the first sheet."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in _find(si, "t")) for si in _find(root, "si")]
    if (first := _first_sheet(z)) is None:
        return
    for k, row in enumerate(_find(ElementTree.fromstring(z.read(first)), "row"), 1):
        cells: list[tuple[str, str, int] | None] = []
        for c in _find(row, "c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, value = c.get("t", "n"), next((v.text for v in _find(c, "v")), None)
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in _find(c, "t"))
            cells[at] = None if value is None else (kind, value, int(c.get("s", "0")))
        yield int(row.get("r", k)), cells


def sheet_rows(raw: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for k, cells in _cells(z):
            yield k, [c and c[1] for c in cells]


def typed_rows(raw: bytes) -> Iterator[tuple[int, list[dict | None]]]:
    """(row number, cells by kind) of the first sheet: numbers whose style shows a date are times."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        dates, late = _date_styles(z)
        for k, cells in _cells(z):
            yield k, [c and _typed(*c, dates, late) for c in cells]


def _typed(kind: str, value: str, style: int, dates: set[int], late: bool) -> dict:
    if kind == "b":
        return {"flag": value.strip() not in ("", "0")}
    if kind == "d":
        return {"at": datetime.fromisoformat(value.removesuffix("Z")).replace(tzinfo=UTC)}
    if kind != "n":
        return {"text": value}
    number = float(value)
    return {"at": (_EPOCHS[late] + timedelta(days=number)).replace(tzinfo=UTC)} if style in dates else {"number": number}


def _date_styles(z: zipfile.ZipFile) -> tuple[set[int], bool]:
    """Numbers of the styles that show dates or times, and whether days count from 1904."""
    late = False
    if "xl/workbook.xml" in z.namelist():
        late = any(p.get("date1904") in ("1", "true") for p in _find(ElementTree.fromstring(z.read("xl/workbook.xml")), "workbookPr"))
    if "xl/styles.xml" not in z.namelist():
        return set(), late
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in _find(root, "numFmt")}
    bare = {k: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", v).lower() for k, v in own.items()}  # without literals, escapes and colours
    # The built-in formats of dates and times.
    built_in = {*range(14, 23), *range(45, 48)}
    shows = lambda k: bool(re.search("[ymdhs]", bare[k])) if k in bare else k in built_in
    formats = [int(x.get("numFmtId", "0")) for xfs in _find(root, "cellXfs") for x in _find(xfs, "xf")]
    return {k for k, f in enumerate(formats) if shows(f)}, late


def _first_sheet(z: zipfile.ZipFile) -> str | None:
    """The part that holds the first sheet in the order of the workbook; without a workbook part, the sheet of the lowest number."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in _find(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            key = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            target = targets.get(key, "").lstrip("/")
            name = target if target.startswith("xl/") else f"xl/{target}"
            if name in names:
                return name
    numbered = {n: int(m[1]) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))}
    return min(numbered, key=numbered.get, default=None)


def slide_texts(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(slide, shape, text) of the shapes with text; paragraphs end in a line feed."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
        for k, name in enumerate(sorted(names, key=lambda n: int(re.search(r"\d+", n)[0]))):
            for j, shape in enumerate(_find(ElementTree.fromstring(z.read(name)), "sp")):
                lines = ["".join(t.text or "" for t in _find(p, "t")) for p in _find(shape, "p")]
                if lines:
                    yield k, j, "\n".join(lines)


def _files(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[tuple]], names: list[str], schema: str) -> DataFrame:
    """Rows of all files of a path or pattern; Spark reads the bytes, from whatever store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = [dict(zip(names, row, strict=True)) for row in rows(raw)]
                if found:
                    yield pa.RecordBatch.from_pylist([{"file": name} | row for row in found], kinds)

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    raw = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return raw.mapInArrow(run, schema)


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, row (1-based) and cells (text; null where there is none) of the first sheet of workbooks; a workbook without a sheet has no rows."""
    return _files(spark, path, sheet_rows, ["row", "cells"], "file string, row int, cells array<string>")


def typed_sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, row (1-based) and cells (CELL; null where there is none) of the first sheet of workbooks: texts, numbers, flags and times (UTC) are kept apart."""
    return _files(spark, path, typed_rows, ["row", "cells"], f"file string, row int, cells array<{CELL}>")


def slides(spark: SparkSession, path: str) -> DataFrame:
    """file, slide, shape (both 0-based) and text of the shapes with text of presentations."""
    return _files(spark, path, slide_texts, ["slide", "shape", "text"], "file string, slide int, shape int, text string")


def with_header(rows: DataFrame, header: tuple[str, ...]) -> DataFrame:
    """Rows below the header as columns of its names, texts or typed cells as rows has them; files whose first row isn't the header (in any case, blanks apart) have none."""
    typed = isinstance(rows.schema["cells"].dataType.elementType, StructType)
    head = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c["text"] if typed else c, F.lit("")))))
    good = rows.where((F.col("row") == 1) & (F.slice(head, 1, len(header)) == F.array(*map(F.lit, header)))).select(F.col("file").alias("__file"))
    body = rows.where("row > 1").join(good, F.col("file") == F.col("__file"), "left_semi")
    return body.select("file", "row", *(F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(header)))
