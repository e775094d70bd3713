"""Comparable pairs of facts: eligibility, gates, the keyed self-join, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions.roles import canonical_metric, section_prefix
from quillfact.functions.text import either, has_any, let

#: What the pair join carries of a fact; quotes and texts are attached afterwards.
JUDGED = [
    "pos", "fact_id", "document_id", "entity", "subject_entity", "metric", "canonical_metric", "value", "unit", "period", "period_scope", "estimate_vintage", "normalized_value", "normalized_unit", "value_type",
    "extraction_confidence", "grounding_confidence", "value_binding_confidence", "validation_status",
]
#: Columns that a table of facts may lack, with what stands for them.
ABSENT = {"subject_entity": None, "extraction_confidence": 1.0, "grounding_confidence": 1.0, "value_binding_confidence": 1.0, "validation_status": "valid"}


def eligible(f: str = "") -> Column:
    """Whether a fact (columns under the prefix f) may take part in relationships."""
    c = lambda name: F.coalesce(F.col(f"{f}{name}").cast("string"), F.lit(""))
    metric, quote, value = c("canonical_metric"), F.lower(F.trim(c("raw_quote"))), F.trim(c("value"))
    bps = has_any(quote, ["bps", "basis point"]) & has_any(metric, ["repo", "rate"]) & ~has_any(metric, ["change", "spread", "delta"])
    above = F.contains(quote, F.lit("above")) & F.contains(metric, F.lit("repo")) & ~F.contains(metric, F.lit("spread"))
    tick = value.isin(L.AXIS_TICKS) & (has_any(quote, ["chart", "\n-2"]) | (F.length(quote) < 30))
    return (
        ~metric.isin(L.INELIGIBLE_METRICS) & F.col(f"{f}normalized_value").isNotNull() & (F.trim(either(c("normalized_unit"), c("unit"))) != "")
        & ~section_prefix(quote, value, F.col(f"{f}numeric_value").cast("string")) & ~bps & ~above & ~tick
    )


def filled(facts: DataFrame) -> DataFrame:
    """Facts with all columns that pairing reads."""
    return facts.withColumns({c: F.lit(v).cast("string") if v is None else F.lit(v) for c, v in ABSENT.items() if c not in facts.columns})


#: Bits of a position that hold the fact's number, below those of its page.
NUMBER_BITS = 43


def with_canonical(facts: DataFrame) -> DataFrame:
    """Facts with their canonical metric and all columns that pairing reads: absent ones are filled, and an empty vintage or
    scope of the period is taken from the columns vintage and scope where there are such. Facts without a position follow each
    other by page, then number."""
    if "pos" not in facts.columns:
        facts = facts.withColumn("pos", F.shiftleft(F.coalesce("page", F.lit(0)).cast("long"), NUMBER_BITS) + F.col("fact_id"))
    out = filled(facts).withColumn("canonical_metric", canonical_metric(F.col("metric")))
    return out.withColumns({c: either(F.col(c), F.col(other)) for c, other in (("estimate_vintage", "vintage"), ("period_scope", "scope")) if other in facts.columns})


def value_class(c: Column) -> Column:
    """Counts and share counts compare with each other, other types with themselves."""
    return F.when(c == "SHARE_COUNT", "COUNT").otherwise(F.coalesce(c, F.lit("UNKNOWN")))


def entity_key(f: str = "") -> Column:
    """The name by which entities are compared: of the subject, else of the entity, or the stem that it holds; empty without one."""
    c = lambda name: F.coalesce(F.col(f"{f}{name}"), F.lit(""))
    name = F.lower(F.trim(either(c("subject_entity"), c("entity"))))
    return F.coalesce(*[F.when(F.contains(name, F.lit(stem)), F.lit(stem)) for stem in L.ENTITY_STEMS], name)


def unit_key(f: str = "") -> Column:
    c = lambda name: F.coalesce(F.col(f"{f}{name}"), F.lit(""))
    return F.lower(F.trim(either(c("normalized_unit"), c("unit"))))


def units_fit(a: str, b: str) -> Column:
    """A share of a hundred does not compare with amounts or counts."""
    ua, ub, plain = unit_key(f"{a}."), unit_key(f"{b}."), ["inr", "usd", "parcels", "employees", "shares"]
    return ~(((ua == "%") & ub.isin(plain)) | ((ub == "%") & ua.isin(plain)))


def named_metric(f: str = "") -> Column:
    m = F.lower(F.trim(F.coalesce(F.col(f"{f}metric"), F.lit(""))))
    return (m != "") & ~m.isin([*L.GENERIC_METRICS, *L.UNIT_WORDS])


def comparability(a: str = "a", b: str = "b") -> Column:
    """struct<score, passed, failed> of any two facts (structs with the columns JUDGED and eligible): the gates in their order,
    up to the first that fails. The texts of the lists are our own; score is 1 or 0."""
    of = lambda f: lambda t: f(f"{t}.")
    (ea, eb), (ua, ub) = (map(of(f), (a, b)) for f in (entity_key, unit_key))
    ca, cb = (value_class(F.col(f"{t}.value_type")) for t in (a, b))
    ma, mb = (F.col(f"{t}.canonical_metric") for t in (a, b))
    both = lambda x, y: F.concat(x, F.lit(" and "), y)
    gates = [  # what holds, what it is called, what is said of it
        (F.coalesce(F.col(f"{a}.eligible") & F.col(f"{b}.eligible"), F.lit(False)), "eligible", F.lit("both facts")),
        ((ea == "") | (eb == "") | (ea == eb), "entity", F.when((ea == "") | (eb == ""), F.lit("implicit")).when(ea == eb, ea).otherwise(both(ea, eb))),
        (named_metric(f"{a}.") & named_metric(f"{b}."), "metric name", both(F.coalesce(F.col(f"{a}.metric"), F.lit("")), F.coalesce(F.col(f"{b}.metric"), F.lit("")))),
        (ca == cb, "value type", F.when(ca == cb, ca).otherwise(both(ca, cb))),
        (ma == mb, "canonical metric", F.when(ma == mb, ma).otherwise(both(ma, mb))),
        (units_fit(a, b), "unit", F.when((ua == "") & (ub == ""), F.lit("unspecified")).when(ua == ub, ua).otherwise(both(ua, ub))),
    ]
    rows = F.array(*[F.struct(holds.alias("holds"), F.concat(F.lit(f"{name}: "), said).alias("said")) for holds, name, said in gates])
    return let(_gate_lists, rows=rows)


def _gate_lists(x: Column) -> Column:
    first = F.coalesce(F.try_element_at(F.filter(F.transform(x["rows"], lambda r, i: F.when(~r["holds"], i)), lambda i: i.isNotNull()), F.lit(1)), F.lit(99))
    said = lambda c: F.transform(c, lambda r: r["said"])
    return F.struct(F.when(first == 99, 1.0).otherwise(0.0).alias("score"), said(F.slice(x["rows"], 1, F.least(first, F.size(x["rows"])))).alias("passed"), said(F.slice(x["rows"], F.least(first, F.size(x["rows"])) + 1, 1)).alias("failed"))


def ready_facts(facts: DataFrame) -> DataFrame:
    """The facts that may be in a pair, with what pairing and judging read: the columns JUDGED, value_class, entity_key."""
    ready = with_canonical(facts).where(eligible()).where(named_metric())
    return ready.select(*JUDGED, value_class(F.col("value_type")).alias("value_class"), entity_key().alias("entity_key"))


def candidate_pairs(facts: DataFrame) -> DataFrame:
    """a, b (structs), priority: the pairs of ready_facts. Facts are read four times, so settle ready ones where they cost."""
    return ready_pairs(ready_facts(facts))


def ready_pairs(keyed: DataFrame) -> DataFrame:
    """a, b (structs), priority: an equi-join on canonical metric, value class and entity; units and, within one document,
    different values are its residue. Facts without an entity fit all entities and are joined on their own without that key:
    a pair of those holds one of them, so it grows with their number. AQE splits the facts of a frequent key."""
    a, b = keyed.alias("a"), keyed.alias("b")
    same = (F.col("a.canonical_metric") == F.col("b.canonical_metric")) & (F.col("a.value_class") == F.col("b.value_class"))
    fit = units_fit("a", "b") & ((F.col("a.document_id") != F.col("b.document_id")) | (F.col("a.normalized_value") != F.col("b.normalized_value")))
    sides = [F.struct(*[F.col(f"{t}.{c}").alias(c) for c in JUDGED]).alias(t) for t in "ab"]
    named = a.where("a.entity_key <> ''").join(b, same & (F.col("a.entity_key") == F.col("b.entity_key")) & (F.col("a.pos") < F.col("b.pos")) & fit).select(*sides)
    free = a.where("a.entity_key = ''").join(b, same & F.expr("a.pos <> b.pos and (b.entity_key <> '' or a.pos < b.pos)") & fit).select(*sides)
    turned = F.col("a.pos") > F.col("b.pos")
    free = free.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    return named.unionByName(free).withColumn("priority", priority())


def _text(side: str, name: str, up: bool = False) -> Column:
    c = F.trim(F.coalesce(F.col(f"{side}.{name}"), F.lit("")))
    return F.upper(c) if up else F.lower(c)


def priority() -> Column:
    """40 for the metric; 50 for one period, and then 30 for other vintages or 25 for a part of the year; 20 for two."""
    pa, pb = _text("a", "period"), _text("b", "period")
    va, vb = (_text(s, "estimate_vintage", True) for s in "ab")
    sa, sb = (_text(s, "period_scope", True) for s in "ab")
    more = F.when((va != "") & (vb != "") & (va != vb), 30.0).when((sa == "APR_DEC") != (sb == "APR_DEC"), 25.0).otherwise(0.0)
    return F.lit(40.0) + F.when((pa != "") & (pa == pb), 50.0 + more).when((pa != "") & (pb != ""), 20.0).otherwise(0.0)


def ranked(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs by priority, ties by position; limit is for a report. (Candidate pairs themselves have no limit: one for pairs
    whose metrics are merely alike would never apply, for the gates leave none of those.)"""
    order = [F.desc("priority"), "a.pos", "b.pos"]
    top = pairs.orderBy(*order)
    return top.limit(limit) if limit else top


def all_pairs(facts: DataFrame, limit: int = L.PREVIEW) -> DataFrame:
    """The diagnostic listing: the first pairs across documents by position, with score and gates, comparable or not.

    The limit first pairs begin with the first facts: every one of these is followed by at least as many partners as facts
    of other documents come after it, so facts are taken until that many pairs are sure, and only they meet the others."""
    f = with_canonical(facts).withColumn("eligible", eligible()).select(*JUDGED, "eligible")
    firsts = [r["pos"] for r in f.select("pos").orderBy("pos").limit(limit).collect()]
    heads, found = [], 0
    for pos in firsts:
        heads.append(pos)
        one = f.where(F.col("pos") == pos).select("document_id").first()[0]
        found += f.where((F.col("pos") > pos) & (F.col("document_id") != F.lit(one))).limit(limit).count()
        if found >= limit:
            break
    a, b = f.where(F.col("pos").isin(heads)).alias("a"), f.alias("b")
    pairs = a.join(b, (F.col("a.pos") < F.col("b.pos")) & (F.col("a.document_id") != F.col("b.document_id")))
    pairs = pairs.select(*[F.struct(*[F.col(f"{t}.{c}").alias(c) for c in [*JUDGED, "eligible"]]).alias(t) for t in "ab"]).orderBy("a.pos", "b.pos").limit(limit)
    return pairs.select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), comparability().alias("g")).select("pos_a", "pos_b", "g.score", "g.passed", "g.failed")


def pair_count(facts: DataFrame) -> DataFrame:
    """One row: the numbers of facts and of pairs across documents, from the documents' sizes."""
    sizes = facts.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return sizes.select("facts", F.coalesce(((F.col("facts") * F.col("facts") - F.col("squares")) / 2).cast("long"), F.lit(0)).alias("pairs"))


def first_pairs(pairs: DataFrame, by: str, k: int) -> DataFrame:
    """The first k pairs of each value of a column, by priority and position."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("priority"), "a.pos", "b.pos"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def similar_metrics(metrics: DataFrame, threshold: float) -> DataFrame:
    """metric_a, metric_b, score of different canonical metrics (one column canonical_metric) that share at least threshold of the
    words that either has. Metrics meet by the words that they share; only counts of common words are compared."""
    words = metrics.distinct().select("canonical_metric", F.array_distinct(F.split("canonical_metric", "_")).alias("w"))
    each = words.select("canonical_metric", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.canonical_metric") < F.col("b.canonical_metric"))).groupBy(F.col("a.canonical_metric").alias("metric_a"), F.col("b.canonical_metric").alias("metric_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).agg(F.count("*").alias("common"))
    return met.select("metric_a", "metric_b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("score")).where(F.col("score") >= threshold)


def similar_pairs(keyed: DataFrame, threshold: float = L.SIMILARITY, gates: bool = True) -> DataFrame:
    """a, b, score of ready facts of different documents whose metrics are merely alike. With the gates on there are none, for
    those ask for one canonical metric; without them entities and units may differ too."""
    if gates:
        return keyed.select(F.struct(*JUDGED).alias("a"), F.struct(*JUDGED).alias("b"), F.lit(1.0).alias("score")).limit(0)
    alike = similar_metrics(keyed.select("canonical_metric"), threshold)
    one, two = (keyed.select(F.col("canonical_metric").alias(f"metric_{x}"), F.struct(*JUDGED).alias(x)) for x in "xy")
    both = alike.join(one.withColumnRenamed("metric_x", "metric_a"), "metric_a").join(two.withColumnRenamed("metric_y", "metric_b"), "metric_b").where(F.col("x.document_id") != F.col("y.document_id"))
    turned = F.col("x.pos") > F.col("y.pos")
    return both.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b"), "score")


def with_similar(pairs: DataFrame, similar: DataFrame, limit: int = L.PREVIEW) -> DataFrame:
    """All pairs (of ready_pairs, their score is 1), and of the similar ones the best, as many as are left of limit; ties go by position."""
    room = max(limit - pairs.limit(limit).count(), 0)
    best = similar.orderBy(F.desc("score"), "a.pos", "b.pos").limit(room)
    return pairs.select("a", "b", "priority", F.lit(1.0).alias("score")).unionByName(best.select("a", "b", F.lit(0.0).alias("priority"), "score"))
