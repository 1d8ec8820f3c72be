"""Result tables to Parquet, delimited text, SQLite and workbooks."""

from __future__ import annotations

import os
import re
import sqlite3
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.rules import mask, spreadsheet_safe


def flat(df: DataFrame) -> DataFrame:
    """Every column as a plain value: lists joined by '; ', structs and maps as JSON, flags as 0/1, times as dates."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            return F.array_join(c, "; ")
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(c)
        if kind == "boolean":
            return c.cast("int")
        if kind.startswith("timestamp") or kind == "date":
            return F.date_format(c, "yyyy-MM-dd")
        return c

    return df.select(*[one(n, k).alias(n) for n, k in df.dtypes])


def masked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: mask(F.col(c)) for c in columns if c in df.columns})


def safe(df: DataFrame) -> DataFrame:
    return df.withColumns({n: spreadsheet_safe(F.col(f"`{n}`")) for n, k in df.dtypes if k == "string"})


def write_run(df: DataFrame, path: str, run_id: int, keep_history: bool) -> None:
    """A result table, partitioned by run: appended, or in place of earlier runs."""
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append" if keep_history else "overwrite").parquet(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """One folder of delimited text with a header; an existing one is never overwritten."""
    safe(flat(df)).write.option("header", True).mode("errorifexists").csv(path)


def write_sqlite(df: DataFrame, path: str, table: str, keep_history: bool = False, batch: int = 5_000) -> int:
    """Stream a result into a SQLite table partition by partition; columns that the table lacks are added."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError("table name")
    out = flat(df)
    names = ", ".join(f'"{c}"' for c in out.columns)
    with sqlite3.connect(path) as con:
        if not keep_history:
            con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({names})')
        have = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
        for c in out.columns:
            if c not in have:
                con.execute(f'ALTER TABLE "{table}" ADD COLUMN "{c}"')
        n, rows = 0, []
        put = f'INSERT INTO "{table}" ({names}) VALUES ({", ".join("?" * len(out.columns))})'
        for r in out.toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(r))
            if len(rows) == batch:
                con.executemany(put, rows)
                n, rows = n + len(rows), []
        con.executemany(put, rows)
    return n + len(rows)


def sheet_name(name: str, taken: set[str]) -> str:
    """A valid, unused sheet name of at most 31 characters."""
    base = re.sub(r"[\[\]:*?/\\]", " ", name).strip()[:31] or "Sheet"
    out, i = base, 2
    while out.lower() in taken:
        out = f"{base[: 31 - len(str(i)) - 1]} {i}"
        i += 1
    taken.add(out.lower())
    return out


def _letters(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
        return f'<c r="{ref}"><v>{v}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str, tabs: dict[str, DataFrame], max_rows: int = 1_048_575) -> None:
    """A workbook with a tab per result, rows streamed from Spark; more rows than a sheet holds are an error."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    taken: set[str] = set()
    names = [sheet_name(n, taken) for n in tabs]
    if os.path.exists(path):
        raise FileExistsError(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, df in enumerate(tabs.values(), 1):
            out = safe(flat(df))
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                f.write(("<row r=\"1\">" + "".join(_cell(f"{_letters(k)}1", c) for k, c in enumerate(out.columns)) + "</row>").encode())
                for n, r in enumerate(out.toLocalIterator(prefetchPartitions=True), 2):
                    if n > max_rows + 1:
                        raise ValueError(f"{names[i - 1]}: more rows than a sheet holds")
                    f.write((f'<row r="{n}">' + "".join(_cell(f"{_letters(k)}{n}", v) for k, v in enumerate(r)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
