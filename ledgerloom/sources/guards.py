"""Checks of an uploaded file before it is read."""

from __future__ import annotations

import hashlib
import io
import zipfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bytes per file, inflated bytes and ratio of a workbook, rows and columns of a table."""

    file_bytes: int = 50 * 2**20
    inflated_bytes: int = 500 * 2**20
    ratio: int = 200
    ratio_from: int = 10 * 2**20
    rows: int = 1_000_000
    columns: int = 1_000


class RejectedFile(ValueError):
    """The file must not be read; the message says why."""


def check_content(name: str, content: bytes, limits: Limits = Limits()) -> None:
    """Raise ``RejectedFile`` unless size, leading bytes and inflated size fit the file's kind."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in ("csv", "tsv", "txt", "xlsx", "xls"):
        raise RejectedFile(f"{name}: unknown kind")
    if not content:
        raise RejectedFile(f"{name}: empty")
    if len(content) > limits.file_bytes:
        raise RejectedFile(f"{name}: {len(content)} bytes are over the limit")
    if kind == "xlsx":
        if content[:4] != b"PK\x03\x04":
            raise RejectedFile(f"{name}: no workbook")
        try:
            inflated = sum(i.file_size for i in zipfile.ZipFile(io.BytesIO(content)).infolist())
        except zipfile.BadZipFile as e:
            raise RejectedFile(f"{name}: damaged workbook") from e
        if inflated > limits.inflated_bytes or inflated > limits.ratio_from and inflated > limits.ratio * len(content):
            raise RejectedFile(f"{name}: inflates to {inflated} bytes")
    elif kind == "xls":
        if content[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise RejectedFile(f"{name}: no workbook")
    elif b"\x00" in content[:8192]:
        raise RejectedFile(f"{name}: binary content")


def check_table(df: DataFrame, limits: Limits = Limits()) -> None:
    """Raise ``RejectedFile`` if the table has too many columns or rows; counts one row past the limit at most."""
    if len(df.columns) > limits.columns:
        raise RejectedFile(f"{len(df.columns)} columns")
    if df.limit(limits.rows + 1).count() > limits.rows:
        raise RejectedFile(f"more than {limits.rows} rows")


def checked(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``df``, once it has passed ``check_table``."""
    check_table(df, limits)
    return df


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def blank(c: Column) -> Column:
    return c.isNull() | (F.btrim(c) == "")
