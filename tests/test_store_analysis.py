"""Counts without pairs, and the way from pages to stored relationships."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_facts import FACT

from quillfact.operators import classes as K
from quillfact.operators import judge as J
from quillfact.operators import pairs as P
from quillfact.sources import store as S
from quillfact.sources import tables as T
from quillfact.streaming.analysis import analyse_store
from quillfact.streaming.landing import PAGES, land


def random_facts(spark, seed, n=160):
    rnd = random.Random(seed)
    names = [c.split()[0] for c in FACT.split(", ")]
    rows = []
    for i in range(n):
        unit, normal, kind = rnd.choice([("INR", "INR", "MONEY"), ("INR million", "INR", "MONEY"), ("crore", "INR", "MONEY"), ("%", "%", "MONEY"), ("shares", "shares", "SHARE_COUNT"), ("orders", "orders", "COUNT")])
        value = rnd.choice([0.0, 100.0, 100.0, 100.05, 101.0, 103.0, 104.9, 110.0, 1e-9, -100.0, -101.0, rnd.uniform(90, 120)])
        row = {
            "pos": i, "fact_id": i, "document_id": f"d{rnd.randrange(4)}", "entity": rnd.choice(["Mill", "mill ", "Shop", None]), "metric": rnd.choice(["Sales", "Total Sales of mills"]), "value": str(value), "unit": unit, "normalized_unit": normal,
            "value_type": kind, "period": rnd.choice(["FY 2023", "FY 2024", "FY 2024", None]), "period_scope": rnd.choice([None, None, "APR_DEC", "FULL_YEAR"]), "estimate_vintage": rnd.choice([None, None, "FIRST_ADVANCE_ESTIMATE", "SECOND_ADVANCE_ESTIMATE"]),
            "normalized_value": value, "numeric_value": value, "raw_quote": "a quote of some length, to be sure",
        }
        rows.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(rows, FACT)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_without_pairs_equal_those_of_pairs(spark, seed):
    facts = random_facts(spark, seed).cache()
    edges = J.judged(P.candidate_pairs(facts)).cache()
    want = {(r.taxonomy, r.reconciliation): r.n for r in J.class_counts(edges).collect()}
    assert {(r.taxonomy, r.reconciliation): r.n for r in K.class_counts(facts).collect()} == want and len(want) > 6
    sums = dict.fromkeys(range(160), 0.0)
    for r in edges.select("a.fact_id", F.col("b.fact_id").alias("other"), "confidence").collect():
        sums[r.fact_id] += r.confidence
        sums[r.other] += r.confidence
    base = F.create_map(*[F.lit(x) for i, x in sums.items() for x in (i, 0.2 + i / 300 - x)])  # so that no result is cut off at 0 or 1
    facts = facts.withColumn("extraction_confidence", base[F.col("fact_id")])
    want = {r.fact_id: r.confidence for r in J.rescored(facts, edges).collect()}
    got = {r.fact_id: r.final_confidence for r in K.confidences(facts).collect()}
    assert got == want and len(set(want.values())) > 100
    assert K.class_counts(facts.limit(0)).count() == 0


def test_values_of_neighbouring_bands_are_near(spark):
    rows = [(10.0**k * (1 + s * x / 1e6), 10.0**k) for k in (-7, 0, 9) for s in (1, -1) for x in range(48000, 53000, 37)]
    df = spark.createDataFrame(rows, "a double, b double").select("*", J.band(J.percent_delta(F.col("a"), F.col("b"))).alias("band"))
    size = lambda c: F.floor(F.log(F.abs(F.col(c))) / K.WIDTH)
    assert df.where((F.col("band") < 3) & (F.abs(size("a") - size("b")) > 1)).count() == 0 and df.where("band = 3").count() > 0


REPORT = {
    "a": ["Net profit was ₹500 million in FY2021 against a plan.\nContents ...... 12", "Express parcel shipment volume (million)\nFY2020 FY2021\n3100 3200"],
    "b": ["Net profit was ₹502 million in FY2021 against a plan.\n(₹ in million)", "Express parcel shipment volume (million)\nFY2020 FY2021\n3100 3600"],
}


def pages(spark, report):
    return spark.createDataFrame([(d, "delhivery-fy24.pdf", i, text) for d, texts in report.items() for i, text in enumerate(texts, 1)], PAGES)


def test_from_pages_to_relationships(spark, tmp_path):
    root = f"{tmp_path}/store"
    land(pages(spark, REPORT), root, ("landing", 0))
    facts = S.rows_of(spark, root, "facts")
    assert facts.schema.simpleString() == T.schema_of("facts").simpleString() and len(facts.columns) == 39
    rows = facts.collect()
    assert sorted(r.fact_id for r in rows) == list(range(1, 7))
    for d in "ab":  # numbers follow pages, then the order in which facts were found
        mine = sorted((r for r in rows if r.document_id == d), key=lambda r: r.fact_id)
        assert [(r.page, r.metric) for r in mine] == [(1, "Net Profit"), (2, "Express Parcel Shipment Volume"), (2, "Express Parcel Shipment Volume")]
        assert [r.fact_id for r in mine] == list(range(mine[0].fact_id, mine[0].fact_id + 3))
    profit = next(r for r in rows if r.metric == "Net Profit")
    assert (profit.subject, profit.predicate, profit.extraction_method, profit.pipeline_version) == ("Delhivery Limited", "reached", "fallback", 4)
    chunks = {(r.document_id, r.chunk_index): r.chunk_id for r in S.rows_of(spark, root, "chunks").collect()}
    assert sorted(chunks.values()) == [1, 2, 3, 4] and all(chunks[r.document_id, r.chunk_index] == r.chunk_id for r in rows)
    rejects = S.rows_of(spark, root, "rejected_extractions").collect()
    assert {(r.document_id, r.failure_type) for r in rejects} == {("a", "NAVIGATION_REFERENCE"), ("b", "TABLE_HEADER_WITHOUT_VALUE")} and all(r.created_at and r.rejected_id for r in rejects)

    summary = analyse_store(spark, root).first()
    edges = S.rows_of(spark, root, "fact_relationships").collect()
    page = {r.fact_id: (r.page, r.fact_id) for r in rows}
    assert all(page[e.fact_id_a] < page[e.fact_id_b] for e in edges) and sorted(e.relationship_id for e in edges) == list(range(1, len(edges) + 1))
    assert summary.relationships_found == summary.candidate_pairs_evaluated == len(edges) == 7 and summary.total_accepted_facts == 6
    kinds = sorted(e.taxonomy_category for e in edges)
    assert kinds == ["CONTRADICTS", "CORROBORATES", "RECONCILED_ROUNDING", "TEMPORAL_COMPARISON", "TEMPORAL_COMPARISON", "TEMPORAL_COMPARISON", "TEMPORAL_COMPARISON"]
    assert all(r.final_confidence == 1.0 for r in S.rows_of(spark, root, "facts").collect())

    land(pages(spark, {"a": ["nothing"], "b": ["nothing"]}), root, ("landing", 0))  # that batch is in the store
    assert S.rows_of(spark, root, "facts").count() == 6
    again = {"b": REPORT["b"][:1]}
    land(pages(spark, again), root, ("landing", 1))  # relationships are there already
    held = {r.fact_id: r.document_id for r in S.rows_of(spark, root, "facts").collect()}
    assert sorted(held.values()) == ["a", "a", "a", "b"] and next(i for i, d in held.items() if d == "b") == 7
    left = S.rows_of(spark, root, "fact_relationships").collect()
    assert len(left) == 1 and {held[left[0].fact_id_a], held[left[0].fact_id_b]} == {"a"}
    analyse_store(spark, root)
    assert S.rows_of(spark, root, "fact_relationships").count() == 2
    S.delete_documents(spark, root, spark.createDataFrame([("a",)], "document_id string"))
    assert {r.document_id for t in S.BY_DOCUMENT for r in S.rows_of(spark, root, t).collect()} == {"b"} and S.rows_of(spark, root, "fact_relationships").count() == 0
    with pytest.raises(KeyError):
        S.document(spark, root, "chunks", "a")
    assert S.document(spark, root, "chunks", "b").count() == 1


def test_stream_with_an_analysis_in_between(spark, tmp_path):
    from quillfact.streaming.landing import watch

    run = lambda: watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    pages(spark, REPORT).write.parquet(f"{tmp_path}/in")
    run()
    analyse_store(spark, f"{tmp_path}/out")
    pages(spark, {"c": REPORT["a"]}).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert S.rows_of(spark, f"{tmp_path}/out", "facts").count() == 9 and S.rows_of(spark, f"{tmp_path}/out", "fact_relationships").count() == 7
    assert analyse_store(spark, f"{tmp_path}/out").first().relationships_found == 18


def test_a_failed_commit_leaves_the_store_and_a_repeated_one_the_numbers(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    land(pages(spark, {"a": REPORT["a"]}), root, ("landing", 0))
    before = sorted(map(str, S.rows_of(spark, root, "facts").collect()))
    put = S._put
    monkeypatch.setattr(S, "_put", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        land(pages(spark, {"a": ["gone"], "b": REPORT["b"]}), root, ("landing", 1))
    monkeypatch.setattr(S, "_put", put)
    assert sorted(map(str, S.rows_of(spark, root, "facts").collect())) == before and S.last_batch(spark, root, "landing") == 0
    land(pages(spark, {"b": REPORT["b"]}), root, ("landing", 1))
    assert sorted(r.fact_id for r in S.rows_of(spark, root, "facts").collect()) == list(range(1, 7))


def test_facts_of_two_versions_read_as_one_and_old_ones_go(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([(1, "a", "Sales", 3), (2, "a", None, 4), (3, "b", "Sales", 3)], "fact_id int, document_id string, metric string, pipeline_version int")
    S.append(old, root, "facts")
    S.append(old.withColumn("fact_id", F.col("fact_id").cast("long") + 10).withColumn("page", F.lit(2)).withColumn("normalized_value", F.lit(1.5)).withColumn("pipeline_version", F.lit(4)), root, "facts")
    rows = {r.fact_id: r for r in S.rows_of(spark, root, "facts").collect()}
    assert sorted(rows) == [1, 2, 3, 11, 12, 13]
    assert (rows[2].metric, rows[2].page, rows[2].predicate, rows[11].page, rows[11].normalized_value) == ("General Assertion", None, "was reported as", 2, 1.5)
    edges = spark.createDataFrame([(1, 11, 4), (11, 12, 4), (12, 13, 3)], "fact_id_a long, fact_id_b long, pipeline_version int")
    S.commit(spark, root, {"fact_relationships": edges})
    S.purge(spark, root)
    assert sorted(r.fact_id for r in S.rows_of(spark, root, "facts").collect()) == [2, 11, 12, 13]
    assert [(r.fact_id_a, r.fact_id_b) for r in S.rows_of(spark, root, "fact_relationships").collect()] == [(11, 12)]
    with pytest.raises(TypeError):
        T.typed(spark.createDataFrame([(1, ["a"])], "fact_id long, metric array<string>"), "facts")


def test_buckets_bound_the_folders(spark, tmp_path):
    root = str(tmp_path)
    ids = spark.range(3000).select(F.col("id").alias("fact_id"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("document_id"))
    S.append(ids, root, "facts")
    assert len(list((tmp_path / "facts").glob("*/*="))) + len(list((tmp_path / "facts").glob("*/__bucket=*"))) <= S.BUCKETS
    S.replace_documents(ids.where("fact_id = 7").withColumn("fact_id", F.lit(-7).cast("long")), root, "facts")
    S.drop_documents(spark, root, "facts", ids.where("fact_id = 8"))
    held = {r.document_id: r.fact_id for r in S.read(spark, root, "facts").collect()}
    assert len(held) == 2999 and held["d7"] == -7 and "d8" not in held


def test_numbers_do_not_depend_on_the_order_of_rows(spark):
    rows = [(f"d{i % 7}", i // 7, "x") for i in range(100)]
    number = lambda some, parts: {(r.document_id, r.at): r.n for r in T.numbered(spark.createDataFrame(some, "document_id string, at int, more string").repartition(parts), "n", ["document_id"], ["at"], 5).collect()}
    one = number(rows, 3)
    assert sorted(one.values()) == list(range(5, 105)) and one == number(rows[::-1], 8)
    assert all(one[d, i + 1] == one[d, i] + 1 for d, i in one if (d, i + 1) in one)


def test_similar_metrics_equal_all_pairs(spark):
    metrics = ["net_profit", "net_profit_margin", "profit_after_tax", "net_net_debt", "cash_flow", "flow", "margin", "net_profit_margin_change"]
    words = {m: set(m.split("_")) for m in metrics}
    for t in (0.35, 0.5):
        want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in metrics for b in metrics if a < b and len(words[a] & words[b]) >= t * len(words[a] | words[b])}
        got = P.similar_metrics(spark.createDataFrame([(m,) for m in metrics * 2], "canonical_metric string"), t).collect()
        assert {(r.metric_a, r.metric_b): r.score for r in got} == pytest.approx(want)


def test_similar_pairs_fill_what_is_left(spark):
    facts = random_facts(spark, 3, 30).withColumn("metric", F.when(F.col("pos") % 5 == 0, "Sales of cloth").otherwise(F.col("metric")))
    ready = P.ready_facts(facts).cache()
    assert P.similar_pairs(ready).count() == 0
    rows = [r.asDict() for r in ready.collect()]
    words = lambda r: set(r["canonical_metric"].split("_"))
    score = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    want = sorted((-score(a, b), a["pos"], b["pos"]) for a in rows for b in rows if a["pos"] < b["pos"] and a["document_id"] != b["document_id"] and a["canonical_metric"] != b["canonical_metric"] and score(a, b) >= 0.35)
    exact = P.ready_pairs(ready).limit(5)
    got = P.with_similar(exact, P.similar_pairs(ready, gates=False), 25).where("score < 1").collect()
    assert sorted((-r.score, r.a.pos, r.b.pos) for r in got) == want[:20] and len(want) > 20
    assert P.with_similar(exact, P.similar_pairs(ready, gates=False), 3).count() == 5
