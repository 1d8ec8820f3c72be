"""Similarity of report pairs over nine signals: gate, overall value, model features, matches of both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import evidence
from ledgerloom.operators import ordering

# Signals in the order of the model's features, with their weights in the overall value.
WEIGHTS = {"field_jaccard": 0.40, "smaller_containment": 0.20, "business_object": 0.10, "name": 0.10, "built_in_prompts": 0.07, "related_business_object": 0.05, "data_source": 0.04, "authorized_usage": 0.02, "report_type": 0.02}
# Points of the metadata score, and the bounds of the gate.
CANDIDATE_POINTS = {"name": 50, "data_source": 20, "category": 10, "report_tag": 10, "report_type": 5, "worklet": 5}
NAME_STRONG, NAME_MODERATE, CANDIDATE_LEAST = 75.0, 60.0, 70.0
# Bounds of the overall value and of the containment, and the relations they stand for.
STRONG, LIKELY, POSSIBLE, CONTAINED, CONTAINED_OVERALL, NAME_MATCH = 90.0, 80.0, 70.0, 95.0, 80.0, 90.0
RELATIONS = {STRONG: "Nearly Identical", LIKELY: "High Field Overlap", POSSIBLE: "Possible Duplicate"}
CONTAINED_RELATION, NAME_RELATION, NO_RELATION = "Smaller Report Contained in Larger Report", "Likely Duplicate (Name Match)", "Not Flagged"

#: Sets of a profile, by signal.
SETS = {"business_object": "objects", "built_in_prompts": "prompts", "related_business_object": "related", "authorized_usage": "usage"}
TEXTS = ["data_source", "report_type", "category", "report_tag", "worklet"]


def with_profiles(pairs: DataFrame, profiles: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs with both reports' profiles as ``x_`` and ``y_`` columns.

    ``profiles``: uid, fields, objects, prompts, related, usage (arrays), name (de-noised) and ``TEXTS``; pairs with an
    end that has no profile drop out.
    """
    rest = [c for c in profiles.columns if c != "uid"]
    x = profiles.select(F.col("uid").alias(a), *[F.col(c).alias(f"x_{c}") for c in rest])
    y = profiles.select(F.col("uid").alias(b), *[F.col(c).alias(f"y_{c}") for c in rest])
    return pairs.join(x, a).join(y, b)


def raw_signals(name_ratio: Column) -> dict[str, Column]:
    """The nine signals in percent of a pair with profiles; null where a side knows nothing.

    ``name_ratio`` is the similarity of the de-noised names; it counts only if both are there.
    """
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    named = F.when((x("name") != "") & (y("name") != ""), name_ratio)
    out = {"field_jaccard": evidence.set_jaccard(x("fields"), y("fields")), "smaller_containment": evidence.set_containment(x("fields"), y("fields")), "name": named}
    out |= {signal: evidence.set_jaccard(x(c), y(c)) for signal, c in SETS.items()}
    out |= {c: evidence.same_value(x(c), y(c)) for c in ("data_source", "report_type")}
    return {k: out[k] for k in WEIGHTS}


def feature_vector(signals: dict[str, Column]) -> Column:
    """Two numbers per signal: its value in 0..1 (0 if missing) and whether it is missing."""
    parts = [p for c in signals.values() for p in (F.coalesce(F.least(F.greatest(c / 100, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.when(c.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))]
    return F.array(*parts)


def judged(signals: dict[str, Column], name_match: Column, whole: bool = False) -> dict[str, Column]:
    """overall, relationship and potential (duplicate) of a pair.

    A pair whose field and name signals alone rule out the lowest band is given 0 without the other signals, unless
    ``whole``. A match of names makes a pair a duplicate that the overall value leaves out, with the name's value
    if that is higher.
    """
    weighted = F.bround(evidence.weighted(signals, WEIGHTS), 1)
    known = F.coalesce(weighted, F.lit(0.0))
    if not whole:
        hopeless = signals["field_jaccard"].isNotNull() & ~name_match & (evidence.ceiling(signals, WEIGHTS, ["field_jaccard", "smaller_containment", "name"]) < POSSIBLE)
        known = F.when(hopeless, F.lit(0.0)).otherwise(known)
    label = evidence.relation(known, signals["smaller_containment"], RELATIONS, CONTAINED_RELATION, CONTAINED, CONTAINED_OVERALL, NO_RELATION)
    by_name = (label == NO_RELATION) & name_match
    return {
        "overall": F.when(by_name, F.greatest(known, F.bround(signals["name"], 1))).otherwise(known),
        "relationship": F.when(by_name, F.lit(NAME_RELATION)).otherwise(label),
        "potential": (label != NO_RELATION) | by_name,
    }


def candidate_score(name_ratio: Column) -> Column:
    """Points of metadata similarity of a pair with profiles, 0..100, one decimal."""
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    same = [F.when(F.coalesce(evidence.same_value(x(c), y(c)), F.lit(0.0)) == 100.0, F.lit(float(p))).otherwise(F.lit(0.0)) for c, p in CANDIDATE_POINTS.items() if c != "name"]
    return F.bround(reduce(lambda p, q: p + q, same, F.coalesce(name_ratio, F.lit(0.0)) * CANDIDATE_POINTS["name"] / 100), 1)


def gate(name_ratio: Column) -> Column:
    """Whether a pair is worth comparing: a shared field or object, similar names, or enough metadata points."""
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    shared = lambda c: F.coalesce(F.arrays_overlap(x(c), y(c)), F.lit(False))
    alike = lambda c: F.coalesce(evidence.same_value(x(c), y(c)), F.lit(0.0)) == 100.0
    r = F.coalesce(name_ratio, F.lit(0.0))
    return shared("fields") | shared("objects") | (r >= NAME_STRONG) | ((r >= NAME_MODERATE) & alike("category") & alike("report_tag")) | (candidate_score(r) >= CANDIDATE_LEAST)


def metadata_only(pairs: DataFrame, passed: Column, linked: Column, grouped: DataFrame) -> DataFrame:
    """(uid): reports of pairs that passed the gate, lack fields on a side and are not linked, unless in a group (``grouped``: uid)."""
    bare = (F.size("x_fields") <= 0) | (F.size("y_fields") <= 0) | F.col("x_fields").isNull() | F.col("y_fields").isNull()
    ends = pairs.where(passed & bare & ~linked).select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    return ends.join(grouped.select("uid"), "uid", "left_anti")


def matches(judged_pairs: DataFrame, k: int = 50) -> DataFrame:
    """Up to ``k`` best qualified partners of each report: uid, partner, overall, relationship, place (from 1)."""
    directed = ordering.both_directions(judged_pairs.where("potential"), "a", "b", ["overall", "relationship"])
    return ordering.top_partners(directed, "overall", k)


def best_probability(pairs: DataFrame, a: str, b: str, probability: str) -> DataFrame:
    """(uid, probability, first, second): the most likely pair of each report, qualified or not; ties to the first pair."""
    directed = ordering.both_directions(pairs.withColumns({"_i": F.least(a, b), "_j": F.greatest(a, b)}).where(F.col(probability).isNotNull()), a, b, [probability, "_i", "_j"])
    best = F.max(F.struct(F.col(probability).alias("p"), (-F.col("_i")).alias("i"), (-F.col("_j")).alias("j"))).alias("b")
    return directed.groupBy("uid").agg(best).select("uid", F.col("b.p").alias("probability"), (-F.col("b.i")).alias("first"), (-F.col("b.j")).alias("second"))
