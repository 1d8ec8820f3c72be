"""Queries of packing (p8) and leaks (p9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.leaks import leaked_passages, near_passages
from ledgerloom.llm.packing import pack, token_counts
from ledgerloom.plans.tables import table

CAPACITY = 2048


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pack(token_counts(docs, "text").select("doc_id", "n_tokens"), "doc_id", "n_tokens", CAPACITY)


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: every text placed once, none over the capacity, places without gaps, texts cut only if longer."""
    placed = p8_containers(spark, d)
    bins = placed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"), F.max("place").alias("last"), F.countDistinct("place").alias("places"))
    texts = placed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"))
    of_bins = bins.agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"), F.count_if((F.col("last") + 1 != F.col("k")) | (F.col("places") != F.col("k"))).alias("gaps"))
    of_texts = texts.agg(F.count("*").alias("texts"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("needless_cuts"), F.count_if(F.col("end") != F.col("n")).alias("lost_tokens"))
    rows = lambda one: one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("n")) for c in one.columns])).alias("r")).select("r.*")
    return rows(of_texts).unionByName(rows(of_bins))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").select("item_id", "item_text")
    return leaked_passages(docs, "doc_id", "text", items, "item_id", "item_text").select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    items = table(spark, d, "eval_items").select("item_id", "item_text")
    return near_passages(docs, "doc_id", "text", items, "item_id", "item_text")


QUERIES = {"p8_containers": p8_containers, "p8_checks": p8_checks, "p9_found": p9_found, "p9_near": p9_near}

_WORDS = r"regexp_extract_all(lower(regexp_replace({}, '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"
_GRAMS = "SELECT DISTINCT {0}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 12"

#: By shared runs of twelve words; compatibility forms are folded by the query only, so texts with them may differ.
_LEAKS = f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format('doc_id', _WORDS.format('text'), 'documents')}) JOIN ({_GRAMS.format('item_id', _WORDS.format('item_text'), 'eval_items')}) USING (g) WHERE doc_id IS NOT NULL"

ORACLES = {"p9_found": _LEAKS, "p8_checks": "SELECT 'texts' AS figure, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'needless_cuts', 0 UNION ALL SELECT 'lost_tokens', 0 UNION ALL SELECT 'overfull', 0 UNION ALL SELECT 'gaps', 0"}
