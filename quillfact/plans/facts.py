"""A fact table over the order tables: revenue of nations by fiscal year, as eight documents report it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC, CANONICAL = "Total Order Revenue", "total_order_revenue"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows of df in four tasks a core, whatever the files: a row of a narrow table is few bytes but may be much work, and
    Spark cuts a file by bytes, a row group not at all."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def order_facts(spark: SparkSession, sf_dir: str, entity: str = "n_name") -> DataFrame:
    """One row per document, entity (nations, or customers with c_name) and fiscal year (from April), in whole cents. Orders
    meet their customers in a sorted join: customers grow with the orders, and Spark's size check goes by their compressed
    file, so that it would send millions of them to the driver. Nations are few and are broadcast by that check. Positions
    come from the entity's key, the year and the report's number, so no window numbers all rows."""
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = read(spark, sf_dir, "orders").select("o_custkey", (year + (month >= 4).cast("int")).alias("fy"), cents.alias("cents"), F.when(F.col("o_orderstatus").isin("F", "P"), cents).alias("early"), F.when(month >= 4, cents).alias("part"))
    if entity == "c_name":  # a customer's orders end in one task: they are summed where they are read
        orders = orders.groupBy("o_custkey", "fy").agg(*[F.sum(c).alias(c) for c in ("cents", "early", "part")])
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    per = orders.join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    if entity == "n_name":
        per = per.join(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("n_nationkey" if entity == "n_name" else "c_custkey").cast("long")
    per = per.groupBy(F.col(entity).alias("entity"), key.alias("key"), "fy").agg(*[(F.sum(c).cast("double") / 100.0).alias(c) for c in ("cents", "early", "part")])
    total, even = F.col("cents"), F.col("key") % 2 == 0

    def row(name, value, unit, binding, scope=None, vintage=None):
        text = lambda v: F.lit(v).cast("string")
        return F.struct(F.lit(name).alias("document_id"), value.alias("normalized_value"), text(unit).alias("unit"), F.lit(binding).alias("value_binding_confidence"), text(scope).alias("period_scope"), (F.when(even, vintage) if vintage else text(None)).alias("estimate_vintage"))

    reports = F.array(
        row("ledger", total, "INR million", 0.95, vintage="SECOND_ADVANCE_ESTIMATE"), row("copy", total, "INR million", 0.9), row("summary", F.round(total / 1e7, 4) * 1e7, "INR crore", 0.85), row("rounded", F.round(total / 1e6) * 1e6, "INR million", 0.8),
        row("provisional", F.col("early"), "INR million", 0.75, vintage="FIRST_ADVANCE_ESTIMATE"), row("partial", F.col("part"), "INR million", 0.8, scope="APR_DEC"), row("restated", total * 1.03, "INR million", 0.7), row("nounit", total, None, 0.9),
    )
    facts = per.select("entity", "key", "fy", F.posexplode(reports).alias("report", "r")).select("entity", "key", "fy", "report", "r.*")
    pos, doc = F.col("key") * 1000 + (F.col("fy") - 1980) * 10 + F.col("report"), F.col("document_id")
    return facts.select(
        pos.alias("pos"), pos.alias("fact_id"), "document_id", "entity", F.when(doc != "copy", F.col("entity")).alias("subject_entity"), F.lit(METRIC).alias("metric"), F.lit(CANONICAL).alias("canonical_metric"), F.round("normalized_value").cast("decimal(30,0)").cast("string").alias("value"),
        "unit", F.concat(F.lit("FY "), F.col("fy").cast("string")).alias("period"), "period_scope", "estimate_vintage", "normalized_value", F.col("normalized_value").alias("numeric_value"), F.when(F.col("unit").isNotNull(), "INR").alias("normalized_unit"), F.lit("MONEY").alias("value_type"), F.lit("").alias("raw_quote"),
        F.when(doc == "copy", 0.8).otherwise(0.9).alias("extraction_confidence"), F.when(doc == "copy", 0.85).when(doc == "rounded", 0.7).otherwise(1.0).alias("grounding_confidence"), "value_binding_confidence",
        F.when((doc == "summary") & (F.col("key") % 5 == 0), "rejected").otherwise("valid").alias("validation_status"),
    )


def facts_sql(entity: str = "n_name") -> str:
    """WITH tables: f facts, e eligible ones, p comparable pairs, q with priority and verdict, j judged edges."""
    key = "n_nationkey" if entity == "n_name" else "c_custkey"
    return FACTS.replace("{entity}", entity).replace("{key}", key)


FACTS = """WITH per AS (SELECT {entity} AS entity, {key} AS key, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS fy,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS total,
  CAST(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / CAST(100 AS DOUBLE) AS early,
  CAST(sum(CASE WHEN month(o_orderdate) >= 4 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS DOUBLE) / CAST(100 AS DOUBLE) AS part
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
docs AS (
  SELECT *, 0 AS report, 'ledger' AS document_id, total AS v, 'INR million' AS unit, 0.95 AS bind, NULL AS scope, CASE WHEN key % 2 = 0 THEN 'SECOND_ADVANCE_ESTIMATE' END AS vintage FROM per
  UNION ALL SELECT *, 1, 'copy', total, 'INR million', 0.9, NULL, NULL FROM per
  UNION ALL SELECT *, 2, 'summary', round(total / CAST(1e7 AS DOUBLE), 4) * CAST(1e7 AS DOUBLE), 'INR crore', 0.85, NULL, NULL FROM per
  UNION ALL SELECT *, 3, 'rounded', round(total / CAST(1e6 AS DOUBLE)) * CAST(1e6 AS DOUBLE), 'INR million', 0.8, NULL, NULL FROM per
  UNION ALL SELECT *, 4, 'provisional', early, 'INR million', 0.75, NULL, CASE WHEN key % 2 = 0 THEN 'FIRST_ADVANCE_ESTIMATE' END FROM per
  UNION ALL SELECT *, 5, 'partial', part, 'INR million', 0.8, 'APR_DEC', NULL FROM per
  UNION ALL SELECT *, 6, 'restated', total * CAST(1.03 AS DOUBLE), 'INR million', 0.7, NULL, NULL FROM per
  UNION ALL SELECT *, 7, 'nounit', total, NULL, 0.9, NULL, NULL FROM per),
f AS (SELECT CAST(key * 1000 + (fy - 1980) * 10 + report AS BIGINT) AS pos, entity, 'FY ' || fy AS period, document_id, v, unit, scope, vintage, bind::DOUBLE AS bind, document_id <> 'copy' AS subject,
  (CASE WHEN document_id = 'copy' THEN 0.8 ELSE 0.9 END)::DOUBLE AS ext, (CASE document_id WHEN 'copy' THEN 0.85 WHEN 'rounded' THEN 0.7 ELSE 1.0 END)::DOUBLE AS ground, NOT (document_id = 'summary' AND key % 5 = 0) AS valid FROM docs),
e AS (SELECT * FROM f WHERE v IS NOT NULL AND unit IS NOT NULL),
p AS (SELECT a.pos AS pos_a, b.pos AS pos_b, a.document_id AS doc_a, b.document_id AS doc_b, a.v AS va, b.v AS vb, a.unit AS ua, b.unit AS ub, a.period AS pa, b.period AS pb, a.vintage AS na, b.vintage AS nb,
  a.scope AS sa, b.scope AS sb, a.bind AS ba, b.bind AS bb, a.ground AS ga, b.ground AS gb, a.valid AND b.valid AS valid, a.subject AND b.subject AS subjects,
  (coalesce(a.scope, '') = 'APR_DEC') <> (coalesce(b.scope, '') = 'APR_DEC') AS scoped, a.period = b.period AS same,
  round(abs(a.v - b.v) / CASE WHEN abs(a.v) + abs(b.v) > 0 THEN (abs(a.v) + abs(b.v)) / CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CAST(100 AS DOUBLE), 2) AS delta
  FROM e a JOIN e b ON a.entity = b.entity AND a.pos < b.pos AND (a.document_id <> b.document_id OR a.v <> b.v)),
q AS (SELECT *, CAST(40 + CASE WHEN same THEN 50 + CASE WHEN na IS NOT NULL AND nb IS NOT NULL AND na <> nb THEN 30 WHEN scoped THEN 25 ELSE 0 END ELSE 20 END AS DOUBLE) AS priority,
  CASE WHEN same AND scoped THEN 'SCOPE_PERIOD_DIFFERENCE' WHEN same AND na <> nb THEN 'ESTIMATE_REVISION' WHEN NOT same THEN 'HISTORICAL_TREND' WHEN delta < 0.1 AND contains(ua, 'crore') <> contains(ub, 'crore') THEN 'UNIT_CONVERSION'
    WHEN delta < 0.1 THEN 'NONE' WHEN delta < 1.5 THEN 'ROUNDING' ELSE 'NONE' END AS reconciliation,
  CASE WHEN same AND scoped THEN 'TEMPORAL_COMPARISON' WHEN same AND na <> nb THEN 'RECONCILED_SCOPE' WHEN NOT same THEN 'TEMPORAL_COMPARISON' WHEN delta < 0.1 AND contains(ua, 'crore') <> contains(ub, 'crore') THEN 'RECONCILED_UNIT'
    WHEN delta < 0.1 THEN 'CORROBORATES' WHEN delta < 1.5 THEN 'RECONCILED_ROUNDING' WHEN delta <= 5.0 THEN 'LIKELY_CONTRADICTION' ELSE 'CONTRADICTS' END AS taxonomy FROM p),
j AS (SELECT *, CASE taxonomy WHEN 'RECONCILED_SCOPE' THEN 'RECONCILED' WHEN 'RECONCILED_UNIT' THEN 'RECONCILED' WHEN 'RECONCILED_ROUNDING' THEN 'CORROBORATES' ELSE taxonomy END AS relationship,
  CASE WHEN reconciliation = 'SCOPE_PERIOD_DIFFERENCE' THEN 0.88 WHEN reconciliation = 'ESTIMATE_REVISION' THEN 0.92 WHEN reconciliation = 'HISTORICAL_TREND' THEN 0.85 WHEN reconciliation IN ('UNIT_CONVERSION', 'ROUNDING') THEN 0.90
    WHEN taxonomy = 'CORROBORATES' THEN 0.95 WHEN taxonomy = 'LIKELY_CONTRADICTION' THEN 0.80 ELSE 0.85 END::DOUBLE AS confidence, pos_a * 1000000000 + pos_b AS edge_id FROM q)
"""

FACTS_SQL = facts_sql()
