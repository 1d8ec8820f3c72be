"""Ranking metrics of a scored, labelled table, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.storage import Workspace


def score_counts(df: DataFrame, score: str, label: str, also: float | None = None) -> DataFrame:
    """Per distinct score: rows, positives, and both summed over all higher scores (descending prefix sums).

    Scores are range-partitioned; each partition sums alone and is shifted by the totals of the partitions
    before it, of which there is one row each. ``also`` adds a score that no row may have.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    if also is not None:
        extra = df.sparkSession.createDataFrame([(float(also), 0, 0)], "s double, n long, pos long")
        per = per.select(F.col("s").cast("double").alias("s"), "n", "pos").unionByName(extra).groupBy("s").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    parts = per.repartitionByRange(F.col("s").desc()).withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"cn": F.sum("n").over(inner), "cp": F.sum("pos").over(inner)})
    # written once: a second evaluation could draw other range bounds
    local = Workspace(df.sparkSession, "score-counts").write(local, "counts")
    totals = local.groupBy("part").agg(F.max("cn").alias("tn"), F.max("cp").alias("tp"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("part", F.coalesce(F.sum("tn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("tp").over(before), F.lit(0)).alias("bp"))
    return local.join(F.broadcast(shift), "part").select("s", "n", "pos", (F.col("cn") + F.col("bn")).alias("cum_n"), (F.col("cp") + F.col("bp")).alias("cum_pos"))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: rows, positives, roc_auc (ties averaged) and average_precision; null where undefined."""
    c = score_counts(df, score, label)
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    # a positive beats the negatives below it and ties with those at its score: sum over scores from the negatives' side
    won = F.sum(neg * (F.col("cum_pos") - F.col("pos")) + 0.5 * neg * F.col("pos"))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n"))
    out = c.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), won.alias("w"), ap.alias("ap"), F.max(cum_neg).alias("neg"))
    return out.select(F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("p", F.lit(0)).alias("n_pos"), F.when((F.col("p") > 0) & (F.col("neg") > 0), F.round(F.col("w") / (F.col("p") * F.col("neg")), 6)).alias("roc_auc"), F.when(F.col("p") > 0, F.round(F.col("ap") / F.col("p"), 6)).alias("average_precision"))


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn and precision, recall, F1 (0 where undefined) at ``score >= threshold``."""
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


def best_threshold(df: DataFrame, score: str, label: str, floor: float) -> DataFrame:
    """The threshold of highest F1 among those that reach a precision; ties go to the higher threshold, none gives no row."""
    c = score_counts(df, score, label)
    total = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.sum(label)).first()[0] or 0
    scored = c.select("s", (F.col("cum_pos") / F.col("cum_n")).alias("precision"), (2 * F.col("cum_pos") / (F.col("cum_n") + F.lit(total))).alias("f1"))
    best = scored.agg(F.max(F.when(F.col("precision") >= floor, F.struct("f1", "s", "precision"))).alias("b"))
    return best.where("b is not null").select(F.col("b.s").alias("threshold"), F.round("b.f1", 6).alias("f1"), F.round("b.precision", 6).alias("precision"))


def choose_threshold(df: DataFrame, score: str, label: str, floor: float, usual: float = 0.5) -> DataFrame:
    """One row (threshold, criterion): the highest F1 among thresholds that reach a precision, ties to the stricter one.

    Every score and ``usual`` are tried. If none reaches the precision, the highest F1 alone decides ('no floor');
    without a positive row the threshold is 1 ('no positives'), without rows ``usual`` ('no rows').
    """
    if not 0 <= floor <= 1:
        raise ValueError("a precision lies between 0 and 1")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(label), F.lit(0))).first()
    if not n or not total:
        got = (float(usual), "no rows") if not n else (1.0, "no positives")
        return df.sparkSession.createDataFrame([got], "threshold double, criterion string")
    c = score_counts(df, score, label, usual)
    precision = F.when(F.col("cum_n") > 0, F.col("cum_pos") / F.col("cum_n")).otherwise(F.lit(0.0))
    scored = c.select("s", precision.alias("precision"), (2 * F.col("cum_pos") / (F.col("cum_n") + F.lit(total))).alias("f1"))
    best = scored.agg(F.max(F.when(F.col("precision") >= floor, F.struct("f1", "s"))).alias("b"), F.max(F.struct("f1", "s")).alias("w"))
    return best.select(F.coalesce("b.s", "w.s").alias("threshold"), F.when(F.col("b").isNotNull(), "floor").otherwise("no floor").alias("criterion"))
