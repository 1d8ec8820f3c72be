"""What a name directory and a list of titles say about single words, in tables of fixed size (p10).

Every name of the directory and every title counts, however many there are: their words and letter groups are
counted by hash bucket in one distributed aggregation, so at most ``KINDS`` times ``BUCKETS`` counts reach the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
KINDS = ["given", "family", "ending", "name_gram", "title", "title_gram"]


def bucket(text: str) -> int:
    """The same as crc32 of Spark, modulo the table's size."""
    return zlib.crc32(text.encode("utf-8", "replace")) % BUCKETS


def grams(word: str) -> list[str]:
    x = f"^{word}$"
    return [x[i : i + 3] for i in range(len(x) - 2)]


@dataclass
class NameStatistics:
    """Counts by kind and bucket. ``lift`` says how many times as often a bucket is met as the average one, in bits."""

    counts: dict[str, dict[int, int]] = field(default_factory=lambda: {k: {} for k in KINDS})
    totals: dict[str, int] = field(default_factory=lambda: {k: 0 for k in KINDS})

    def add(self, kind: str, text: str, n: int = 1) -> None:
        b = bucket(text)
        self.counts[kind][b] = self.counts[kind].get(b, 0) + n
        self.totals[kind] += n

    def lift(self, kind: str, text: str) -> float:
        n = self.counts[kind].get(bucket(text), 0)
        return math.log2(1 + n * BUCKETS / self.totals[kind]) if n else 0.0

    def likeness(self, word: str) -> float:
        """Mean log-odds of the word's letter groups in names against titles."""
        a, b = self.totals["name_gram"] + BUCKETS / 8, self.totals["title_gram"] + BUCKETS / 8
        gs = grams(word)
        odds = [math.log2((self.counts["name_gram"].get(k, 0) + 0.125) / a) - math.log2((self.counts["title_gram"].get(k, 0) + 0.125) / b) for k in map(bucket, gs)]
        return sum(odds) / max(1, len(odds))

    def learn_name(self, name: str) -> None:
        """Count one 'Given Family' name, as the aggregation does."""
        parts = [p for p in name.lower().replace(",", " ").split() if p]
        if len(parts) < 2:
            return
        self.add("given", parts[0])
        for f in parts[-1].split("-"):
            self.add("family", f)
            self.add("ending", f[-4:])
        for g in grams(parts[0]) + [g for f in parts[-1].split("-") for g in grams(f)]:
            self.add("name_gram", g)

    def learn_title(self, title: str) -> None:
        for w in title.lower().split():
            self.add("title", w)
            for g in grams(w):
                self.add("title_gram", g)


def _grams(word: Column) -> Column:
    x = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))


def _counted(keyed: DataFrame) -> DataFrame:
    return keyed.select("kind", F.pmod(F.crc32(F.encode("w", "UTF-8")), F.lit(BUCKETS)).cast("int").alias("b")).groupBy("kind", "b").agg(F.count("*").alias("n"))


def name_statistics(names: DataFrame | None, name: str, titles: DataFrame | None = None, title: str = "") -> NameStatistics:
    """Statistics of all distinct names ('Given Family', or 'Family, Given') and of all titles; nulls and single words count nothing."""
    parts: list[DataFrame] = []
    if names is not None:
        n = F.lower(F.btrim(F.col(name)))
        plain = F.split(F.btrim(F.regexp_replace(F.when(F.instr(n, ",") > 0, F.regexp_replace(n, r"^([^,]+),\s*(.+)$", "$2 $1")).otherwise(n), r"[^\p{L}'\-]+", " ")), " ")
        words = names.select(F.col(name)).where(F.col(name).isNotNull()).distinct().select(plain.alias("p")).where("size(p) >= 2")
        both = words.select(F.element_at("p", 1).alias("g"), F.filter(F.split(F.element_at("p", -1), "-"), lambda x: x != "").alias("fs"))
        rows = F.concat(
            F.array(F.struct(F.lit("given").alias("kind"), F.col("g").alias("w"))),
            F.transform("fs", lambda f: F.struct(F.lit("family").alias("kind"), f.alias("w"))),
            F.transform("fs", lambda f: F.struct(F.lit("ending").alias("kind"), F.substring(f, F.greatest(F.lit(1), F.length(f) - 3), F.lit(4)).alias("w"))),
            F.transform(F.flatten(F.transform(F.concat(F.array("g"), "fs"), _grams)), lambda x: F.struct(F.lit("name_gram").alias("kind"), x.alias("w"))),
        )
        parts.append(_counted(both.select(F.explode(rows).alias("r")).select("r.*")))
    if titles is not None:
        distinct = titles.select(F.lower(F.col(title)).alias("t")).where("t is not null").distinct()
        words = distinct.select(F.explode(F.split("t", r"[^\p{L}]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
        rows = F.concat(F.array(F.struct(F.lit("title").alias("kind"), F.col("w").alias("w"))), F.transform(_grams(F.col("w")), lambda x: F.struct(F.lit("title_gram").alias("kind"), x.alias("w"))))
        spread = words.select("n", F.explode(rows).alias("r")).select("n", "r.kind", F.pmod(F.crc32(F.encode("r.w", "UTF-8")), F.lit(BUCKETS)).cast("int").alias("b"))
        parts.append(spread.groupBy("kind", "b").agg(F.sum("n").alias("n")))
    out = NameStatistics()
    totals: Counter[str] = Counter()
    for p in parts:
        for r in p.collect():
            out.counts[r["kind"]][r["b"]] = r["n"]
            totals[r["kind"]] += r["n"]
    out.totals.update(totals)
    return out
