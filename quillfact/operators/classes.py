"""Counts and confidences of all relationships without pairs of facts.

What the judge reads of a fact is its cell (period, scope, vintage, unit) and its value, and it reads of two values only
the band of their difference. So facts are counted by cell and value, cells of one metric and entity meet, and each pair of cells
is judged once for each band. Where all bands agree, the pair of cells counts with the product of its facts. Elsewhere
values meet values that lie in the same narrow range of sizes or the next, and all others are in the last band. Facts of
one document with equal values are no pair; those are counted by document and value and taken off. Facts without an
entity meet the cells of all entities put together.

Counts are whole numbers and confidences whole hundredths, so the results are those of all pairs, one by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.operators.judge import BANDS, band, base_confidence, floored, percent_delta, verdict_at
from quillfact.operators.pairs import _text, filled, ready_facts, units_fit
from quillfact.sources.scratch import settle

CELL = ["period", "period_scope", "estimate_vintage", "unit", "normalized_unit"]
GROUP = ["canonical_metric", "value_class", "entity_key"]
#: The entity under which the facts of all entities are put together.
ANY = "\u0000"
#: Two values whose difference is not in the last band have logarithms that differ by less than this.
WIDTH = 0.0502
OUTCOME = ["relationship", "taxonomy", "reconciliation", "confidence"]


def cells(facts: DataFrame) -> DataFrame:
    """fact_id, document_id, the columns GROUP, cell (a struct), value of the facts that may be in a pair."""
    one = ready_facts(facts).select(F.struct("*").alias("f"))
    unit = F.lower(F.coalesce("f.unit", F.lit("")))
    cell = F.struct(_text("f", "period").alias("period"), _text("f", "period_scope", True).alias("period_scope"), _text("f", "estimate_vintage", True).alias("estimate_vintage"), unit.alias("unit"), _text("f", "normalized_unit").alias("normalized_unit"))
    return one.select("f.fact_id", "f.document_id", *[f"f.{c}" for c in GROUP], cell.alias("cell"), F.col("f.normalized_value").alias("value"))


def _sides(table: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """table as the left and the right side of a pairing by the columns GROUP: under each entity both sides hold its rows; facts
    without an entity are also the left side under ANY, and all others, without their entity, its right one."""
    named = table.where("entity_key <> ''").withColumn("entity_key", F.lit(ANY))
    named = named.groupBy(*GROUP, "cell", *more).agg(F.sum("n").alias("n"))
    free = table.where("entity_key = ''").withColumn("entity_key", F.lit(ANY))
    return table.unionByName(free), table.unionByName(named)


def _met(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Pairs of cells, each once: the columns GROUP and more, cell_a, n_a, cell_b, n_b, itself."""
    a = left.withColumnsRenamed({"cell": "cell_a", "n": "n_a"})
    b = right.withColumnsRenamed({"cell": "cell_b", "n": "n_b"})
    once = (F.col("entity_key") == ANY) | (F.col("cell_a") <= F.col("cell_b"))
    both = a.join(b, [*GROUP, *more]).where(once).withColumn("itself", (F.col("entity_key") != ANY) & (F.col("cell_a") == F.col("cell_b")))
    side = lambda x: F.struct(*[F.col(x)[c].alias(c) for c in CELL], F.lit(1.0).alias("normalized_value"))
    return both.withColumn("a", side("cell_a")).withColumn("b", side("cell_b")).where(units_fit("a", "b"))


def _cents() -> Column:
    return F.round(F.col("said.confidence") * 100).cast("long")


def tallies(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, shares, cells of facts): the columns OUTCOME and n, all counts of pairs by outcome; the columns GROUP, cell, value, document_id
    and cents: what each fact of the group and cell has of its relationships, of all values and documents where those are null."""
    known = settle(cells(facts))
    values = settle(known.groupBy(*GROUP, "cell", "value").agg(F.count("*").alias("n")))
    by_cell = values.groupBy(*GROUP, "cell").agg(F.sum("n").alias("n"))
    pairs = _met(*_sides(by_cell))
    said = F.array(*[verdict_at(F.lit(x), "a", "b") for x in BANDS])
    pairs = settle(pairs.select(*GROUP, "cell_a", "n_a", "cell_b", "n_b", "itself", said.alias("by_band")).withColumn("open", F.exists("by_band", lambda v: v != F.element_at("by_band", len(BANDS)))))

    last = pairs.withColumn("said", F.element_at("by_band", len(BANDS)))
    n = F.when(F.col("itself"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    outcomes = [last.select("said.*", n.alias("n"))]
    own = lambda x: F.when(F.col("itself"), F.col("n_a") - 1).otherwise(F.col(x))
    place = lambda x, value, doc: [*GROUP[:2], entity(x).alias("entity_key"), F.col(f"cell_{x}").alias("cell"), value.alias("value"), doc.alias("document_id")]
    entity = lambda x: F.when((F.col("entity_key") == ANY) & F.lit(x == "a"), F.lit("")).otherwise(F.col("entity_key"))
    nothing = (F.lit(None).cast("double"), F.lit(None).cast("string"))
    both = lambda df, value_a, value_b, doc, each_a, each_b: [
        df.select(*place("a", value_a, doc), (each_a * F.col("gain")).alias("cents")), df.where("not itself").select(*place("b", value_b, doc), (each_b * F.col("gain")).alias("cents")),
    ]
    shares = both(last.withColumn("gain", _cents()), nothing[0], nothing[0], nothing[1], own("n_b"), F.col("n_a"))

    sized = values.withColumn("size", F.when(F.col("value") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("value")) / WIDTH))).withColumn("sign", F.signum("value").cast("int"))
    left, right = _sides(sized, "value", "size", "sign")
    left = left.withColumnsRenamed({"cell": "cell_a", "value": "value_a", "n": "of_a"})
    right = right.select(*GROUP, F.col("cell").alias("cell_b"), F.col("value").alias("value_b"), F.col("n").alias("of_b"), "sign", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    near = pairs.where("open").join(left, [*GROUP, "cell_a"]).join(right, [*GROUP, "cell_b", "sign", "size"])
    near = near.where(~F.col("itself") | (F.col("value_a") <= F.col("value_b"))).withColumn("band", band(percent_delta(F.col("value_a"), F.col("value_b")))).where(F.col("band") < len(BANDS) - 1)
    near = near.withColumn("equal", F.col("itself") & (F.col("value_a") == F.col("value_b"))).withColumn("said", F.element_at("by_band", F.col("band") + 1)).withColumn("rest", F.element_at("by_band", len(BANDS)))
    near = settle(near.select(*GROUP, "cell_a", "cell_b", "value_a", "value_b", "of_a", "of_b", "equal", "said", "rest"))
    m = F.when(F.col("equal"), F.col("of_a") * (F.col("of_a") - 1) / 2).otherwise(F.col("of_a") * F.col("of_b")).cast("long")
    outcomes += [near.select("said.*", m.alias("n")), near.select("rest.*", (-m).alias("n"))]
    more = near.withColumn("gain", _cents() - F.round(F.col("rest.confidence") * 100).cast("long")).withColumn("itself", F.col("equal"))
    shares += both(more, F.col("value_a"), F.col("value_b"), nothing[1], F.when(F.col("equal"), F.col("of_a") - 1).otherwise(F.col("of_b")), F.col("of_a"))

    again = known.groupBy(*GROUP[:2], "document_id", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    copies = known.join(again, [*GROUP[:2], "document_id", "value"]).groupBy(*GROUP, "cell", "document_id", "value").agg(F.count("*").alias("n"))
    off = _met(*_sides(settle(copies), "document_id", "value"), "document_id", "value").withColumn("said", verdict_at(F.lit(BANDS[0]), "a", "b"))
    off = settle(off.select(*GROUP, "cell_a", "n_a", "cell_b", "n_b", "itself", "document_id", "value", "said"))
    outcomes.append(off.select("said.*", (-n).alias("n")))
    shares += both(off.withColumn("gain", -_cents()), F.col("value"), F.col("value"), F.col("document_id"), own("n_b"), F.col("n_a"))

    total = outcomes[0]
    for x in outcomes[1:]:
        total = total.unionByName(x)
    total = floored(total).groupBy(*OUTCOME).agg(F.sum("n").alias("n")).where("n > 0")
    share = shares[0]
    for x in shares[1:]:
        share = share.unionByName(x)
    return total, share.groupBy(*GROUP, "cell", "value", "document_id").agg(F.sum("cents").alias("cents")), known


def class_counts(facts: DataFrame) -> DataFrame:
    """taxonomy, reconciliation, n of all pairs of facts, as judge.class_counts counts them."""
    return tallies(facts)[0].groupBy("taxonomy", "reconciliation").agg(F.sum("n").alias("n"))


def _one_by_one(a: DataFrame, b: DataFrame, same: Column) -> DataFrame:
    """The columns OUTCOME and n of the pairs of two sides, judged one by one. The difference is a column of its own, and the
    verdict reads cells in normal form, so a pair is a few comparisons."""
    fit = units_fit("a", "b") & ((F.col("a.document_id") != F.col("b.document_id")) | (F.col("a.normalized_value") != F.col("b.normalized_value")))
    pairs = a.alias("a").join(b.alias("b"), same & fit).select("a.*", *[F.col(f"b.{c}").alias(f"{c}_b") for c in [*CELL, "normalized_value"]])
    pairs = pairs.select(*[F.col(c).alias(f"{c}_a") for c in CELL], *[f"{c}_b" for c in CELL], band(percent_delta(F.col("normalized_value"), F.col("normalized_value_b"))).alias("band"))
    # what the judge reads is counted first: there are as many kinds of pairs as cells and bands, whatever the pairs
    state = F.when((F.col("period_a") == "") & (F.col("period_b") == ""), 0).when(F.col("period_a") == F.col("period_b"), 1).when((F.col("period_a") != "") & (F.col("period_b") != ""), 2).otherwise(3)
    kinds = pairs.groupBy(state.alias("state"), *[f"{c}_{x}" for x in "ab" for c in CELL[1:]], "band").agg(F.count("*").alias("n"))
    stands = {"a": F.when(F.col("state") == 0, "").otherwise("a"), "b": F.when(F.col("state") == 1, "a").when(F.col("state") == 2, "b").otherwise("")}
    side = lambda x: F.struct(stands[x].alias("period"), *[F.col(f"{c}_{x}").alias(c) for c in CELL[1:]], F.lit(1.0).alias("normalized_value")).alias(x)
    said = F.element_at(F.array(*[verdict_at(F.lit(x), "a", "b") for x in BANDS]), F.col("band") + 1)
    return kinds.select(side("a"), side("b"), "band", "n").select(said.alias("said"), "n").select("said.*", "n")


def class_counts_by_period(facts: DataFrame) -> DataFrame:
    """taxonomy, reconciliation, n as class_counts gives them, for many entities of few facts each, whose cells are hardly
    fewer than their facts. Of two facts of different periods the judge reads nothing but the units, so these pairs are
    products of counts, less the equal values of one document; facts of one period meet one by one, and so do facts without
    a period or an entity with all that fit them."""
    known = ready_facts(facts).select(F.struct("*").alias("f"))
    cell = [_text("f", "period").alias("period"), _text("f", "period_scope", True).alias("period_scope"), _text("f", "estimate_vintage", True).alias("estimate_vintage"), F.lower(F.coalesce("f.unit", F.lit(""))).alias("unit"), _text("f", "normalized_unit").alias("normalized_unit")]
    known = settle(known.select("f.pos", "f.document_id", *[f"f.{c}" for c in GROUP], *cell, "f.normalized_value"))
    named, free = known.where("entity_key <> ''"), known.where("entity_key = ''")
    dated, undated = named.where("period <> ''"), named.where("period = ''")
    on = lambda *keys: reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    outcomes = [_one_by_one(dated, dated, on(*GROUP, "period") & F.expr("a.pos < b.pos"))]
    # these would shuffle all facts to meet nothing
    if not undated.isEmpty():
        outcomes.append(_one_by_one(undated, named, on(*GROUP) & F.expr("a.pos <> b.pos and (b.period <> '' or a.pos < b.pos)")))
    if not free.isEmpty():
        outcomes.append(_one_by_one(free, known, on(*GROUP[:2]) & F.expr("a.pos <> b.pos and (b.entity_key <> '' or a.pos < b.pos)")))
    again = Window.partitionBy(*GROUP, "document_id", "normalized_value")
    equal = dated.select(*GROUP, "document_id", "normalized_value", "period", "unit", "normalized_unit").withColumns({"first": F.min("period").over(again), "last": F.max("period").over(again)}).where("first < last")
    outcomes += [_across(dated, 1), _across(settle(equal.drop("first", "last")), -1, "document_id", "normalized_value")]
    total = outcomes[0]
    for x in outcomes[1:]:
        total = total.unionByName(x)
    return floored(total).groupBy("taxonomy", "reconciliation").agg(F.sum("n").alias("n")).where("n > 0")


def _across(dated: DataFrame, sign: int, *more: str) -> DataFrame:
    """The columns OUTCOME and n (times sign) of the pairs of different periods of a group, which are also equal in the columns more:
    all pairs of two units less those of one period."""
    unit, keys = F.struct("unit", "normalized_unit"), [*GROUP, *more]
    each = dated.groupBy(*keys, unit.alias("of"), "period").agg(F.count("*").alias("n"))
    # the counts of a group's units, with those of its periods; a group has few units
    units = each.groupBy(*keys, "of").agg(F.sum("n").alias("n"), F.count("*").alias("periods"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    alone = units.where("periods > 1").select(F.col("of").alias("of_a"), F.col("of").alias("of_b"), ((F.col("n") * F.col("n") - F.col("squares")) / 2).cast("long").alias("n"))
    meet = lambda t, *by: t.alias("a").join(t.alias("b"), [*keys, *by]).where("a.of < b.of")
    several = units.select(*keys, "of", "n")
    both = meet(several).select(F.col("a.of").alias("of_a"), F.col("b.of").alias("of_b"), (F.col("a.n") * F.col("b.n")).alias("n"))
    near = meet(each, "period").select(F.col("a.of").alias("of_a"), F.col("b.of").alias("of_b"), (-F.col("a.n") * F.col("b.n")).alias("n"))
    counts = alone.unionByName(both).unionByName(near).groupBy("of_a", "of_b").agg(F.sum("n").alias("n"))
    side = lambda x: F.struct(F.lit(x).alias("period"), F.lit("").alias("period_scope"), F.lit("").alias("estimate_vintage"), F.col(f"of_{x}.unit").alias("unit"), F.col(f"of_{x}.normalized_unit").alias("normalized_unit"), F.lit(1.0).alias("normalized_value")).alias(x)
    met = counts.select(side("a"), side("b"), "n").where(units_fit("a", "b"))
    return met.select(verdict_at(F.lit(BANDS[0]), "a", "b").alias("said"), (F.lit(sign) * F.col("n")).alias("n")).select("said.*", "n")


def confidences(facts: DataFrame) -> DataFrame:
    """fact_id, final_confidence, as judge.rescored gives them from all pairs (of facts whose numbers do not repeat)."""
    _, shares, known = tallies(facts)
    shares = settle(shares)
    keys = F.array(F.col("entity_key"), F.when(F.col("entity_key") != "", F.lit(ANY)))
    each = known.withColumn("entity_key", F.explode(F.array_compact(keys)))
    part = lambda by, where: each.join(shares.where(where).select(*GROUP, "cell", *by, "cents"), [*GROUP, "cell", *by]).select("fact_id", "cents")
    parts = part([], "value is null").unionAll(part(["value"], "value is not null and document_id is null")).unionAll(part(["value", "document_id"], "document_id is not null"))
    sums = parts.groupBy("fact_id").agg(F.sum("cents").alias("cents"))
    final = base_confidence() + F.coalesce("cents", F.lit(0)) / F.lit(100.0)
    return filled(facts).join(sums, "fact_id", "left").select("fact_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), final)), 3).alias("final_confidence"))
