"""Several values packed in one field, one per row with their place (p3).

A finite-state tokenizer walks each cell once and parts it at separators outside quotes. Whether a separator
belongs to a value is a question to the names already known: runs of adjacent pieces are looked up by an
equi-join on their key, so the known names are never gathered or broadcast by us. Both Python steps are
narrow and Arrow-batched; only candidate runs (cells with unquoted neighbours) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ledgerloom.functions import packed as _packed
from ledgerloom.functions.names import NULL_TOKENS, name_key, squeeze
from ledgerloom.operators.lookup import looked_up


_RUNS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("v", T.StringType())]))


def _spans(most: dict[int | None, int]) -> Callable[[Column], Column]:
    @pandas_udf(_RUNS)
    def run(cell: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b, "v": v} for a, b, v in _packed.spans(c, most)] if c is not None else [] for c in cell.tolist()])

    return run


@pandas_udf(T.ArrayType(T.StringType()))
def _merged(cell: pd.Series, joins: pd.Series) -> pd.Series:
    return pd.Series([_packed.merged(c, [(x["a"], x["b"]) for x in (() if j is None else j)]) if c is not None else [] for c, j in zip(cell, joins)])


def packed_values(df: DataFrame, cell: str, known: DataFrame, known_name: str, key: Callable[[Column], Column] = name_key) -> DataFrame:
    """One row per value of ``df[cell]``: all columns of ``df`` plus ``value_pos`` (from 1) and ``value``.

    ``known[known_name]`` holds names whose inner separators must not part them; names are equal by ``key``.
    Null cells, null tokens and cells of separators alone give no row; repeated values are kept, each with
    its own place. Repeated cells and rows give the same values each. Clashing extra columns of ``known``
    don't matter: only the one column is read.
    """
    inner = F.size(F.split(F.btrim(F.col(known_name)), r"[,;|\n\t•·]"))
    names = known.select(F.col(known_name).alias("n"), inner.alias("parts")).where("n is not null and parts > 1").select(key(F.col("n")).alias("k"), "parts").where("k <> ''")
    # how many pieces a name has at most, by its first word: at most one entry per bucket, and one for other scripts
    first = F.regexp_extract("k", "^[^ ,;|•·]*", 0)
    ascii_first = first.rlike(r"^[\x00-\x7f]*$")
    where = F.when(ascii_first, F.pmod(F.crc32(F.encode(first, "UTF-8")), F.lit(_packed.BUCKETS))).otherwise(F.lit(-1)).cast("int")
    # (a key of the caller's need not begin with the name's first word)
    bucket = where if key is name_key else F.lit(None).cast("int")
    most = {r["b"]: r["m"] for r in names.groupBy(bucket.alias("b")).agg(F.max("parts").alias("m")).collect()}
    usable = F.when(~F.lower(squeeze(F.col(cell))).isin(NULL_TOKENS), F.col(cell))
    cells = df.withColumn("_cell", usable)
    if most:
        keys = names.select("k").distinct()
        texts = cells.where("_cell is not null").groupBy("_cell").agg(F.count("*").alias("_n"))
        runs = texts.select(F.md5("_cell").alias("_id"), "_n", F.explode(_spans(most)("_cell")).alias("s"))
        hits = runs.select("_id", "_n", "s.a", "s.b", key(F.col("s.v")).alias("k")).join(keys, "k", "left_semi")
        joins = hits.groupBy("_id").agg(F.collect_list(F.struct("a", "b")).alias("_joins"), F.max("_n").alias("_n"))
        # a cell text may be repeated by a third of all rows; those rows are told apart by any other column
        cells = looked_up(cells.withColumn("_id", F.md5("_cell")), joins, "_id", ["_cell", *(c for c, t in df.dtypes if "map<" not in t and "variant" not in t)], "_n").drop("_id")
    else:
        cells = cells.withColumn("_joins", F.lit(None).cast("array<struct<a:int,b:int>>"))
    out = cells.where("_cell is not null").select(*[df[c] for c in df.columns], F.posexplode(_merged("_cell", "_joins")).alias("_pos", "value"))
    return out.withColumn("value_pos", F.col("_pos") + 1).drop("_pos")
