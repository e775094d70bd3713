"""How often a query works out what costs most of a row, and how many tasks share it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_store_analysis import random_facts

from quillfact.functions import roles as R
from quillfact.functions import validate as V
from quillfact.operators import classes as K
from quillfact.operators import judge as J
from quillfact.operators import pairs as P
from quillfact.plans import catalog
from quillfact.plans.facts import order_facts


def ladders(df) -> int:
    """How often the plan of df holds the ladder of roles, which all of a candidate's expensive expressions hold once."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("CHART_AXIS_TICK")


def tasks(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_reasons_go_through_the_ladder_once(spark, sf_dir):
    df = catalog.QUERIES["rejection_reasons"](spark, sf_dir)
    assert ladders(df) == 1
    assert tasks(df) > 4  # of a table that is one file of one row group


@pytest.mark.parametrize("kept", ["true", "entity is not null and period is not null", "entity is null or period is null"])
def test_counts_by_period_equal_those_of_pairs(spark, kept):
    facts = random_facts(spark, 3, 240).where(kept).cache()
    want = {(r.taxonomy, r.reconciliation): r.n for r in J.class_counts(J.judged(P.candidate_pairs(facts))).collect()}
    assert {(r.taxonomy, r.reconciliation): r.n for r in K.class_counts_by_period(facts).collect()} == want and len(want) > 4
    assert K.class_counts_by_period(facts.limit(0)).count() == 0


def test_lines_are_shared_before_they_are_read(spark, sf_dir):
    df = catalog.QUERIES["line_ladders"](spark, sf_dir)
    below = df._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")[1:]
    assert below and not any("RLIKE" in x.split("Relation ")[0] for x in below)


@pytest.mark.parametrize("name", ["normalize_magnitudes", "normalize_values"])
def test_normal_forms_are_worked_out_once(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert ladders(df) == 1
    assert tasks(df) > 4


LEDGER = ["reject_preview", "failure_case", "ledger_groups", "pipeline_counts", "validate_verdict"]


@pytest.mark.parametrize("name", LEDGER)
def test_ledgers_go_through_the_ladder_once_in_shared_tasks(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert ladders(df) == 1
    assert "Repartition " in df._jdf.queryExecution().optimizedPlan().toString().split("CHART_AXIS_TICK")[1]


def test_a_pattern_with_the_number_is_tried_only_where_it_can_match(spark, monkeypatch):
    """Such a pattern is compiled anew for each row; one for a line without the number, or without its word, is not."""
    monkeypatch.setattr(R, "like", lambda c, p: c.rlike(p) if isinstance(p, str) else F.raise_error(F.lit("compiled")).cast("boolean"))
    rows = [("105", "", "revenue of the year"), ("105", "", "months ended in march of the year by shares")]
    df = spark.createDataFrame(rows, "num string, raw string, line string").select(R.number_role(F.col("num"), F.col("raw"), F.lit(""), F.col("line"))["role"].alias("role"))
    assert [r.role for r in df.collect()] == ["METRIC_VALUE", "METRIC_VALUE"]
    with pytest.raises(Exception, match="compiled"):  # the stand-in is met where the number is
        spark.createDataFrame([("105", "", "see p. 105")], "num string, raw string, line string").select(R.number_role(F.col("num"), F.col("raw"), F.lit(""), F.col("line"))["role"]).collect()


def test_a_role_is_worked_out_only_for_numbers_that_pass_the_rules_before(spark, monkeypatch):
    monkeypatch.setattr(V, "number_role", lambda *a: F.struct(F.raise_error(F.lit("role")).cast("string").alias("role")))
    rows = [("5", "Revenue", "Contents .... 12", 5.0, "NAVIGATION_REFERENCE"), ("5", "Revenue", "abc", 5.0, "INSUFFICIENT_CONTEXT"), ("n/a", "Policy", "see the notes", None, "INSUFFICIENT_CONTEXT")]
    df = spark.createDataFrame(rows, "value string, metric string, quote string, number double, want string")
    got = df.select(V.failure_type(F.col("value"), F.col("metric"), F.lit(""), F.col("quote"), F.col("number"), F.lit(0.9), F.lit(0.9)).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_buckets_of_the_ledger_start_no_python_workers(spark, sf_dir):
    df = catalog.QUERIES["ledger_groups"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "Range" in plan
    assert df.count() == 7


def test_a_text_is_stripped_once_to_tell_a_header(spark):
    df = spark.createDataFrame([(" (₹ in million) ", True), ("Revenue 5", False), (None, False), ("  ", False)], "text string, want boolean")
    df = df.select(V.header_label(F.col("text")).alias("got"), "want")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert all(r.got == r.want for r in df.collect())


@pytest.mark.parametrize("entity", ["n_name", "c_name"])
def test_customers_of_orders_are_not_sent_to_the_driver(spark, sf_dir, entity):
    """The table is far below the size check here; a broadcast of it grows with the orders."""
    plan = order_facts(spark, sf_dir, entity)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [o_custkey" in plan and "BroadcastHashJoin [o_custkey" not in plan


def test_counts_read_the_orders_once(spark, sf_dir):
    df = catalog.QUERIES["pipeline_counts"](spark, sf_dir)
    assert df._jdf.queryExecution().executedPlan().toString().count("/orders.parquet]") == 1


def test_counts_of_nothing_are_zeros(spark):
    nothing = spark.createDataFrame([], "document_id string")
    assert tuple(J.pipeline_counts(nothing, nothing).first()) == (0, 0, 0)
