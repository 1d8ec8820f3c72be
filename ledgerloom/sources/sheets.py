"""Delimited files and workbooks as all-text tables with stable row numbers.

Exports have title rows, blank lines, ragged rows and quoted line breaks, so each file is parsed as a whole by one
task; files are bounded by ``Limits`` and many files are read in parallel. The header is looked for
among the first rows.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.guards import Limits, RejectedFile, check_content

HEADER_ROWS = 15
_ROWS = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def delimiter(sample: str) -> str:
    """The candidate that occurs most evenly in the sample's lines; a comma if none does."""
    lines = [x for x in sample.splitlines()[:50] if x.strip()]
    best, most = ",", (0, 0)
    for d in ",;\t|":
        counts = sorted(x.count(d) for x in lines)
        middle = counts[len(counts) // 2] if counts else 0
        if (middle, sum(counts)) > most and counts and counts[-1]:
            best, most = d, (middle, sum(counts))
    return best


def delimited_rows(content: bytes) -> list[list[str | None]]:
    """Rows of a delimited file, padded to the widest; blank cells are null and blank lines are kept."""
    text = content.decode("utf-8-sig", errors="replace")
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text[:16384])))
    width = max([0, *map(len, rows)])
    return [[(c if c.strip() else None) for c in r] + [None] * (width - len(r)) for r in rows]


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_rows(content: bytes) -> list[list[str | None]]:
    """Rows of a workbook's first sheet as text; rows that the sheet leaves out are null rows."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
    sheet = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else sorted(n for n in names if n.startswith("xl/worksheets/"))[0]
    rows: dict[int, dict[int, str]] = {}
    for i, r in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row")):
        cells: dict[int, str] = {}
        for k, c in enumerate(r.iter(f"{_NS}c")):
            v, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
            text = "".join(t.text or "" for t in inline.iter(f"{_NS}t")) if inline is not None else (v.text or "") if v is not None else ""
            if c.get("t") == "s" and text:
                text = shared[int(text)]
            elif c.get("t") == "b":
                text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
            if text.strip():
                cells[_column(c.get("r")) if c.get("r") else k] = text
        rows[int(r.get("r", i + 1)) - 1] = cells
    width = 1 + max([-1, *(k for c in rows.values() for k in c)])
    return [[rows.get(i, {}).get(k) for k in range(width)] for i in range(1 + max([-1, *rows]))]


def header_index(rows: list[list[str | None]]) -> int:
    """The first row that fills at least three cells and three fifths of the widest of the leading rows; else 0."""
    filled = [sum(c is not None and c.strip() != "" for c in r) for r in rows[:HEADER_ROWS]]
    widest = max([0, *filled])
    if widest <= 1:
        return 0
    return next((i for i, n in enumerate(filled) if n >= max(3, int(0.6 * widest))), 0)


def _parse(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                check_content(path, content, limits)
                if path.lower().endswith(".xls"):
                    raise RejectedFile(f"{path}: this kind of workbook needs a reader that is not installed")
                rows = workbook_rows(content) if path.lower().endswith(".xlsx") else delimited_rows(content)
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pd.DataFrame({"path": path, "row_id": range(at, at + len(part)), "cells": part})

    return run


def raw_rows(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(path, row_id, cells) of all rows of the files at ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_parse(limits), _ROWS)


def read_sheet(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """The table of one file: its header's columns as text, and ``row_id`` from 0 below the header.

    Unnamed columns are called 'Unnamed: i', repeated names get a number. A file without data rows gives an
    empty table; a file without rows is rejected.
    """
    rows = raw_rows(spark, path, limits)
    head = [r["cells"] for r in rows.where(F.col("row_id") < HEADER_ROWS).orderBy("row_id").limit(HEADER_ROWS).collect()]
    if not head:
        raise RejectedFile(f"{path}: no data rows")
    h = header_index(head)
    names: list[str] = []
    for i, c in enumerate(head[h]):
        name = (c or "").strip() or f"Unnamed: {i}"
        names.append(name if name not in names else f"{name}.{i}")
    cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.where(F.col("row_id") > h).select((F.col("row_id") - h - 1).alias("row_id"), *cells)
