"""The relationship judge, its reasons, class counts, and confidences after judging."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.text import has_any, let, short
from quillfact.operators.pairs import _text, comparability, filled, pair_count, ready_facts, ready_pairs
from quillfact.sources.scratch import settle


def percent_delta(a: Column, b: Column) -> Column:
    """The difference in percent of the mean of the absolute values, to two places."""
    mean = (F.abs(a) + F.abs(b)) / F.lit(2.0)
    return F.round(F.abs(a - b) / F.when(mean > 0, mean).otherwise(1.0) * 100.0, 2)


def computable(a: str = "a", b: str = "b") -> Column:
    """Whether a difference in percent means anything: both values are there, of one class, and not just one is a share."""
    na, nb = (_text(s, "normalized_unit") for s in (a, b))
    return F.col(f"{a}.normalized_value").isNotNull() & F.col(f"{b}.normalized_value").isNotNull() & ~((na != nb) & ((na == "%") | (nb == "%")))


def verdict(a: str = "a", b: str = "b") -> Column:
    """struct<relationship, taxonomy, reconciliation, confidence> of a comparable pair."""
    va, vb = F.col(f"{a}.normalized_value"), F.col(f"{b}.normalized_value")
    return let(lambda x: verdict_at(x["delta"], a, b), delta=percent_delta(va, vb))


#: A difference in percent of each band: verdicts depend on the band alone.
BANDS = [0.0, 1.0, 3.0, 9.0]


def band(delta: Column) -> Column:
    """The number of the band of a difference in percent, from 0."""
    return F.when(delta < 0.1, 0).when(delta < 1.5, 1).when(delta <= 5.0, 2).otherwise(3)


def verdict_at(delta: Column, a: str = "a", b: str = "b") -> Column:
    """The verdict on a pair whose values differ by delta percent."""
    pa, pb = _text(a, "period"), _text(b, "period")
    sa, sb = (_text(s, "period_scope", True) for s in (a, b))
    na, nb = (_text(s, "estimate_vintage", True) for s in (a, b))
    ua, ub = (F.lower(F.coalesce(F.col(f"{s}.unit"), F.lit(""))) for s in (a, b))
    same, other, none = (pa != "") & (pa == pb), (pa != "") & (pb != "") & (pa != pb), (pa == "") & (pb == "")
    scope = ((sa != "") & (sb != "") & (sa != sb)) | ((sa == "APR_DEC") != (sb == "APR_DEC"))
    scale = (F.contains(ua, F.lit("crore")) != F.contains(ub, F.lit("crore"))) | (F.contains(ua, F.lit("million")) != F.contains(ub, F.lit("million"))) | (F.contains(ua, F.lit("lakh")) != F.contains(ub, F.lit("lakh")))
    said = lambda r, t, c, x: F.struct(F.lit(r).alias("relationship"), F.lit(t).alias("taxonomy"), F.lit(c).alias("reconciliation"), F.lit(x).alias("confidence"))
    unsure = said("UNCERTAIN", "UNCERTAIN", "NONE", 0.0)
    return (
        F.when(~computable(a, b), unsure)
        .when(same & scope, said("TEMPORAL_COMPARISON", "TEMPORAL_COMPARISON", "SCOPE_PERIOD_DIFFERENCE", 0.88))
        .when(same & (na != "") & (nb != "") & (na != nb), said("RECONCILED", "RECONCILED_SCOPE", "ESTIMATE_REVISION", 0.92))
        .when(other, said("TEMPORAL_COMPARISON", "TEMPORAL_COMPARISON", "HISTORICAL_TREND", 0.85))
        .when((delta < 0.1) & scale, said("RECONCILED", "RECONCILED_UNIT", "UNIT_CONVERSION", 0.90))
        .when((delta < 0.1) & (same | none), said("CORROBORATES", "CORROBORATES", "NONE", 0.95))
        .when((delta >= 0.1) & (delta < 1.5) & (same | none), said("CORROBORATES", "RECONCILED_ROUNDING", "ROUNDING", 0.90))
        .when((delta >= 1.5) & (delta <= 5.0) & same, said("LIKELY_CONTRADICTION", "LIKELY_CONTRADICTION", "NONE", 0.80))
        .when((delta > 5.0) & same, said("CONTRADICTS", "CONTRADICTS", "NONE", 0.85))
        .otherwise(unsure)
    )


def floored(edges: DataFrame) -> DataFrame:
    """edges; those below the confidence floor are unrelated."""
    weak = F.col("confidence") < L.MIN_CONFIDENCE
    return edges.withColumn("relationship", F.when(weak, "UNRELATED").otherwise(F.col("relationship"))).withColumn("taxonomy", F.when(weak, "UNRELATED").otherwise(F.col("taxonomy")))


def judged(pairs: DataFrame) -> DataFrame:
    """pairs with relationship, taxonomy, reconciliation, confidence, delta; below the confidence floor they are unrelated."""
    out = pairs.select("*", F.inline(F.array(verdict()))).withColumn("delta", percent_delta(F.col("a.normalized_value"), F.col("b.normalized_value")))
    return floored(out)


def explained(edges: DataFrame) -> DataFrame:
    """edges with comparison_delta (0 where none can be computed), can_compute_delta, reasoning and match_checklist. The texts are our
    own; the checklist is the gates that the pair passed and what the verdict rests on."""
    t = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("?"))
    num = lambda side: F.concat(short(F.col(f"{side}.normalized_value")), F.lit(" "), t(side, "normalized_unit"))
    at, both = F.coalesce(F.concat(F.lit(" for "), F.col("a.period")), F.lit("")), F.concat(num("a"), F.lit(" and "), num("b"))
    share = F.concat(F.col("delta").cast("string"), F.lit(" % apart"))
    full = lambda side: F.coalesce(F.nullif(_text(side, "period_scope", True), F.lit("")), F.lit("FULL_YEAR"))
    kind = F.when(F.col("reconciliation") != "NONE", F.col("reconciliation")).otherwise(F.col("taxonomy"))
    reason = (
        F.when(kind == "SCOPE_PERIOD_DIFFERENCE", F.concat(F.lit("One period in two scopes, "), full("a"), F.lit(" and "), full("b"), at, F.lit(": a part of the year is no contradiction of another.")))
        .when(kind == "ESTIMATE_REVISION", F.concat(F.lit("Estimates of two vintages, "), t("a", "estimate_vintage"), F.lit(" and "), t("b", "estimate_vintage"), at, F.lit(".")))
        .when(kind == "HISTORICAL_TREND", F.concat(t("a", "metric"), F.lit(" in "), t("a", "period"), F.lit(" and "), t("b", "period"), F.lit(": "), t("a", "value"), F.lit(" and "), t("b", "value"), F.lit(".")))
        .when(kind == "UNIT_CONVERSION", F.concat(F.lit("Equal in one unit: "), t("a", "value"), F.lit(" "), t("a", "unit"), F.lit(" and "), t("b", "value"), F.lit(" "), t("b", "unit"), F.lit(" are "), num("a"), F.lit(".")))
        .when(kind == "CORROBORATES", F.concat(F.lit("Both say "), num("a"), at, F.lit(".")))
        .when(kind == "ROUNDING", F.concat(both, F.lit(" differ by rounding ("), share, F.lit(")"), at, F.lit(".")))
        .when(kind.isin("LIKELY_CONTRADICTION", "CONTRADICTS"), F.concat(both, F.lit(" are "), share, at, F.lit(" and nothing explains it.")))
        .otherwise(F.lit("Nothing to compare: no number, or no period."))
    )
    out = edges.withColumn("can_compute_delta", computable() & (F.col("confidence") > 0)).withColumn("comparison_delta", F.when(F.col("can_compute_delta"), F.col("delta")).otherwise(0.0)).withColumn("reasoning", reason)
    gates = comparability("x", "y")["passed"]
    whole = lambda side: F.col(side).withField("eligible", F.lit(True))
    out = out.withColumn("x", whole("a")).withColumn("y", whole("b"))
    return out.withColumn("match_checklist", F.concat(gates, F.array(F.concat(F.lit("verdict: "), kind)))).drop("x", "y")


def class_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("taxonomy", "reconciliation").agg(F.count("*").alias("n"))


COUNTERS = ["corroborations", "contradictions", "likely_contradictions", "reconciled", "temporal_comparisons", "contextual_differences", "unrelated", "uncertain"]


def counters(edges: DataFrame, **more: Column) -> DataFrame:
    """One row of the eight counters, and of more counts; an edge counts for the first that fits."""
    r, t = F.col("relationship"), F.col("taxonomy")
    kind = (
        F.when(r == "CORROBORATES", "corroborations").when(r == "CONTRADICTS", "contradictions").when(r == "LIKELY_CONTRADICTION", "likely_contradictions")
        .when((r == "RECONCILED") | t.isin("RECONCILED_UNIT", "RECONCILED_ROUNDING"), "reconciled").when((t == "TEMPORAL_COMPARISON") | (r == "TEMPORAL_COMPARISON"), "temporal_comparisons")
        .when(t == "CONTEXTUAL_DIFFERENCE", "contextual_differences").when(r == "UNRELATED", "unrelated").otherwise("uncertain")
    )
    return edges.withColumn("kind", kind).agg(F.count("*").alias("relationships_found"), *[F.count_if(F.col("kind") == c).alias(c) for c in COUNTERS], *[c.alias(name) for name, c in more.items()])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Of edges between the same two facts with the same relationship the first by priority and position; copies: how many."""
    a, b = F.col("a.fact_id"), F.col("b.fact_id")
    same = Window.partitionBy(F.least(a, b), F.greatest(a, b), "relationship")
    again = F.row_number().over(same.orderBy(F.desc("priority"), "a.pos", "b.pos"))
    return edges.withColumn("again", again).withColumn("copies", F.count("*").over(same)).where("again = 1").drop("again")


def base_confidence() -> Column:
    """The product of the stage confidences."""
    return F.coalesce("extraction_confidence", F.lit(1.0)) * F.coalesce("grounding_confidence", F.lit(1.0)) * F.coalesce("value_binding_confidence", F.lit(1.0))


def rescored(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """fact_id, confidence: the product of the stage confidences plus those of all its relationships, within 0 and 1. Edges
    are unpivoted and summed (whole hundredths, so that order does not matter) before they meet the facts."""
    cents = F.round(F.col("confidence") * 100).cast("long")
    sums = edges.select(F.col("a.fact_id").alias("fact_id"), cents.alias("c")).unionAll(edges.select(F.col("b.fact_id"), cents)).groupBy("fact_id").agg(F.sum("c").alias("c"))
    base = base_confidence()
    return filled(facts).join(sums, "fact_id", "left").select("fact_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.coalesce("c", F.lit(0)) / F.lit(100.0))), 3).alias("confidence"))


def dashboard(edges: DataFrame) -> DataFrame:
    """One row of counters by parts of the taxonomy's names."""
    count = lambda *w: F.count_if(has_any(F.col("taxonomy"), list(w)))
    return edges.agg(count("CORROBORATES").alias("corroborated"), count("CONTRADICT").alias("contradictions"), count("RECONCILED").alias("reconciled"), count("TEMPORAL").alias("temporal"), F.count("*").alias("total"))


class Analysis(NamedTuple):
    """relationships: rows of the table fact_relationships, without numbers; summary: one row; confidences: fact_id, final_confidence."""

    relationships: DataFrame
    summary: DataFrame
    confidences: DataFrame


def relationship_rows(edges: DataFrame) -> DataFrame:
    """Explained edges as rows of the table of relationships; the checklist is JSON."""
    return edges.select(
        F.col("a.fact_id").alias("fact_id_a"), F.col("b.fact_id").alias("fact_id_b"), F.col("relationship").alias("relationship_type"), F.col("taxonomy").alias("taxonomy_category"), "reasoning",
        "confidence", F.col("confidence").alias("confidence_delta"), "comparison_delta", "can_compute_delta", F.col("reconciliation").alias("reconciliation_type"), F.to_json("match_checklist").alias("match_checklist"), F.lit(L.PIPELINE_VERSION).alias("pipeline_version"),
    )


def analyse(facts: DataFrame, judge=judged) -> Analysis:
    """The whole step over a table of facts: pairs, judge, floor, distinct relationships, counters, confidences. Pairs are made
    once, when the edges are written to the shared folder; all that is returned reads the edges. judge: of pairs, edges (see
    sources.connectors for one that asks a model about uncertain pairs)."""
    edges = judge(ready_pairs(settle(ready_facts(facts))))
    known, ids = facts.agg(F.count("*"), F.count_distinct("fact_id")).first()
    edges = edges.withColumn("copies", F.lit(1).cast("long")) if known == ids else distinct_edges(edges)  # only facts that share a number can repeat a relationship
    edges = settle(edges.select("a", "b", "relationship", "taxonomy", "reconciliation", "confidence", "delta", "copies"))
    summary = counters(edges, candidate_pairs_evaluated=F.coalesce(F.sum("copies"), F.lit(0)), total_accepted_facts=F.lit(known).cast("long"))
    return Analysis(relationship_rows(explained(edges)), summary, rescored(facts, edges).withColumnRenamed("confidence", "final_confidence"))


def pipeline_counts(facts: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: accepted facts, rejected candidates, pairs across documents. Facts are read once, for their documents' sizes."""
    counts = pair_count(facts).crossJoin(rejected.agg(F.count("*").alias("rejected_candidates_count")))
    return counts.select(F.col("facts").alias("accepted_facts_count"), "rejected_candidates_count", F.col("pairs").alias("candidate_pairs_evaluated"))
