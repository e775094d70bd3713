"""Roles, normal forms, extraction, pairs, judge and store on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillfact.functions import normalize as N
from quillfact.functions import roles as R
from quillfact.functions import text as T
from quillfact.operators import extract as X
from quillfact.operators import judge as J
from quillfact.operators import pairs as P
from quillfact.operators import rank as K
from quillfact.sources import connectors as A
from quillfact.sources import store as S

ROLES = [
    ("30", "the books closed on June 30, 2021 as before", "DATE_COMPONENT"),
    ("212", "a map is on page 212 of the annex", "PAGE_REFERENCE"),
    ("9", "as Note 9 explains at length", "NOTE_REFERENCE"),
    ("4.7", "4.7 Wages and hours of the crew", "PARAGRAPH_IDENTIFIER"),
    ("50", "The bank lowered its key rate by 50 bps last week", "BASIS_POINT_CHANGE"),
    ("12", "Overnight money stood 12 bps below the key rate.", "SPREAD"),
    ("5", "output of the mills (tonnes)5 fell again", "FOOTNOTE_REFERENCE"),
    ("88", "88 Lending to farmers without a pledge", "FOOTNOTE_REFERENCE"),
    ("3", "3. Prices of the basket [1999=100]", "ROW_IDENTIFIER"),
    ("100", "Prices of the basket [1999=100]", "INDEX_BASE_VALUE"),
]


def test_number_roles(spark):
    rows = spark.createDataFrame(ROLES, "num string, line string, want string")
    got = rows.select("num", "want", R.number_role(F.col("num"), F.col("num"), F.lit(""), F.col("line"))["role"].alias("role")).collect()
    assert {r.num: r.role for r in got} == {r.num: r.want for r in got}


VALUES = [
    ("₹1,234.5 million", "INR", 1234.5, 1234500000.0, "INR"),
    ("123.45 crore", "crore", 123.45, 1234500000.0, "INR"),
    ("7.25%", "%", 7.25, 7.25, "%"),
    ("2,500,000", "Equity Shares", 2500000.0, 2500000.0, "shares"),
    ("640", "₹ million", 640.0, 640000000.0, "INR"),
    (None, None, None, None, None),
]


def test_normalized_values(spark):
    rows = spark.createDataFrame(VALUES, "value string, unit string, number double, normal double, normal_unit string")
    got = rows.select("*", N.normalized(F.col("value"), F.col("unit"), F.lit(""), F.lit("")).alias("n")).collect()
    assert [(r.n.numeric_value, r.n.normalized_value, r.n.normalized_unit) for r in got] == [(r.number, r.normal, r.normal_unit) for r in got]
    signs = spark.createDataFrame([("(3.5%)",), ("(1,250.75)",), ("₹(40)",), ("none",)], "v string").select(N.parse_numeric(F.col("v"))).collect()
    assert [r[0] for r in signs] == [-3.5, -1250.75, -40.0, None]


def test_token_estimate_and_grounding(spark):
    rows = spark.createDataFrame([("a b\nc", "A  B"), ("", "x")], "t string, q string").select(T.token_estimate(F.col("t")).alias("n"), T.grounding(F.lit("a b"), F.col("t")).alias("whole"), T.grounding(F.lit("A B"), F.col("t")).alias("low")).collect()
    assert [tuple(r) for r in rows] == [(3, 1.0, 0.85), (0, 0.0, 0.0)]


CHUNKS = [
    ("series", "Express parcel shipment volume (million)\nFY18 FY19 FY20 FY21\n110 152 201 260"),
    ("stack", "\n".join(["Headcount", *(str(100 + i) for i in range(45)), " ".join(f"FY{1950 + i}" for i in range(45))])),
    ("seller", "Harbour Light Holdings 1,250,000 Equity Shares aggregating to ₹625 million"),
    ("columns", "1 2 3 4 5 6 7 8 9 10"),
    ("period", "FY22 brought the first EBITDA above zero."),
    ("empty", ""),
]


def test_extraction(spark):
    chunks = spark.createDataFrame([(name, "delhivery.pdf", 1, 0, text) for name, text in CHUNKS], "document_id string, filename string, page_number int, chunk_index int, text string")
    facts, _ = X.extract_facts(chunks)
    got = {}
    for r in facts.collect():
        got.setdefault(r.document_id, []).append(r)
    assert {r.period: r.value for r in got["series"] if r.binding_method == "table_series_alignment"}["FY 2019"] == "152"
    assert {(r.period, r.value) for r in got["stack"]} >= {("FY 1950", "100"), ("FY 1994", "144")}  # more periods than any fixed look-back
    assert len([r for r in got["seller"] if r.binding_method == "table_cell"]) == 2
    assert "columns" not in got and "empty" not in got
    assert all(r.numeric_value != 22 for r in got.get("period", []))


FACT = "pos long, fact_id long, document_id string, entity string, metric string, value string, unit string, period string, period_scope string, estimate_vintage string, normalized_value double, numeric_value double, normalized_unit string, value_type string, raw_quote string"


def pair(spark, a, b):
    """Verdicts on two facts, each given as what differs from a plain one."""
    base = {"entity": "Delhivery", "metric": "Express Parcel Volume", "value": "1", "unit": "INR", "period": "FY 2024", "period_scope": None, "estimate_vintage": None, "normalized_value": 1.0, "normalized_unit": "INR", "value_type": "MONEY", "raw_quote": "a quote of some length, to be sure"}
    names = [c.split()[0] for c in FACT.split(", ")]
    rows = []
    for i, change in enumerate((a, b)):
        one = base | {"pos": i, "fact_id": i, "document_id": f"d{i}"} | change
        rows.append(tuple((one | {"numeric_value": one["normalized_value"]})[c] for c in names))
    return [(r.relationship, r.reconciliation) for r in J.judged(P.candidate_pairs(spark.createDataFrame(rows, FACT))).collect()]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ({"normalized_value": 289.2e6}, {"normalized_value": 289e6}, [("CORROBORATES", "NONE")]),
        ({"normalized_value": 60.0, "unit": "%", "normalized_unit": "%", "value_type": "PERCENT"}, {"normalized_value": 59.0, "unit": "%", "normalized_unit": "%", "value_type": "PERCENT"}, [("LIKELY_CONTRADICTION", "NONE")]),
        ({"normalized_value": 81415.38e6, "unit": "INR million"}, {"normalized_value": 81415.38e6, "unit": "crore"}, [("RECONCILED", "UNIT_CONVERSION")]),
        ({"period": "FY 2023"}, {"period": "FY 2024"}, [("TEMPORAL_COMPARISON", "HISTORICAL_TREND")]),
        ({"estimate_vintage": "FIRST_ADVANCE_ESTIMATE", "normalized_value": 6.4}, {"estimate_vintage": "SECOND_ADVANCE_ESTIMATE", "normalized_value": 6.5}, [("RECONCILED", "ESTIMATE_REVISION")]),
        ({"period_scope": "APR_DEC", "normalized_value": 4.9}, {"period_scope": "FULL_YEAR", "normalized_value": 5.0}, [("TEMPORAL_COMPARISON", "SCOPE_PERIOD_DIFFERENCE")]),
        ({"metric": "Revenue"}, {"metric": "Core Inflation"}, []),
        ({"unit": None, "normalized_unit": None}, {}, []),
        ({"value_type": "SHARE_COUNT", "unit": "shares", "normalized_unit": "shares"}, {}, []),
        ({"document_id": "d1"}, {}, []),
    ],
)
def test_verdicts(spark, a, b, want):
    assert pair(spark, a, b) == want


def test_no_pair_is_lost_to_a_limit(spark):
    names = [c.split()[0] for c in FACT.split(", ")]
    one = {"entity": "E", "metric": "Revenue", "value": "1", "unit": "INR", "period": "FY 2024", "normalized_value": 1.0, "numeric_value": 1.0, "normalized_unit": "INR", "value_type": "MONEY", "raw_quote": "a quote of some length, to be sure"}
    rows = [tuple((one | {"pos": i, "fact_id": i, "document_id": f"d{i}"}).get(c) for c in names) for i in range(61)]
    assert P.candidate_pairs(spark.createDataFrame(rows, FACT)).count() == 61 * 60 // 2


def test_store(spark, tmp_path):
    root = str(tmp_path)
    facts = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "fact_id long, document_id string, version int")
    S.append(facts, root, "facts")
    S.replace_documents(spark.createDataFrame([(3, "b", 2)], "fact_id long, document_id string, version int"), root, "facts")
    held = S.read(spark, root, "facts")
    assert sorted((r.fact_id, r.document_id, r.version) for r in held.collect()) == [(1, "a", 1), (3, "b", 2)]
    edges = spark.createDataFrame([(1, 3), (1, 1)], "fact_id_a long, fact_id_b long")
    left = S.without_document({"facts": held, "fact_relationships": edges}, spark.createDataFrame([("b",)], "document_id string"))
    assert [r.fact_id for r in left["facts"].collect()] == [1] and [tuple(r) for r in left["fact_relationships"].collect()] == [(1, 1)]


def test_landing_stream(spark, tmp_path):
    from quillfact.streaming.landing import PAGES, watch

    pages = spark.createDataFrame([("seller", "delhivery.pdf", 1, dict(CHUNKS)["seller"])], PAGES)
    pages.write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert S.read(spark, f"{tmp_path}/out", "facts").count() == 2
    held = {t: S.read(spark, f"{tmp_path}/out", t) for t in ("documents", "chunks")}
    assert [(r.filename, r.page_count, r.chunk_count) for r in held["documents"].collect()] == [("delhivery.pdf", 1, 1)] and held["chunks"].count() == 1
    pages.limit(1).withColumn("text", F.lit("nothing to tell")).write.mode("append").parquet(f"{tmp_path}/in")
    watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert S.exists(spark, f"{tmp_path}/out", "facts") is False  # what was found before is stale


def test_commit_is_all_or_nothing(spark, tmp_path):
    root, one = str(tmp_path), spark.createDataFrame([(1,)], "fact_id long")
    S.commit(spark, root, {"documents": one, "fact_relationships": one})
    broken = one.select(F.raise_error(F.lit("no")).cast("long").alias("fact_id"))
    with pytest.raises(Exception, match="no"):
        S.commit(spark, root, {"documents": one.withColumn("fact_id", F.lit(2)), "fact_relationships": broken})
    assert [r.fact_id for t in ("documents", "fact_relationships") for r in S.read(spark, root, t).collect()] == [1, 1]
    S.commit(spark, root, {"documents": S.read(spark, root, "documents").withColumn("fact_id", F.col("fact_id") + 1)})
    assert S.read(spark, root, "documents").first()[0] == 2
    S.clear(spark, root)
    assert not any(S.exists(spark, root, t) for t in S.TABLES)


def facts_table(spark, rows):
    names = [c.split()[0] for c in FACT.split(", ")]
    base = {"entity": "Mill", "metric": "Sales", "value": "1", "unit": "INR", "period": "FY 2024", "normalized_value": 1.0, "numeric_value": 1.0, "normalized_unit": "INR", "value_type": "MONEY", "raw_quote": "a quote of some length, to be sure"}
    return spark.createDataFrame([tuple((base | {"pos": i, "fact_id": i, "document_id": f"d{i}"} | r).get(c) for c in names) for i, r in enumerate(rows)], FACT)


def test_analysis(spark):
    rows = [{}, {}, {"entity": None}, {"entity": "Other"}, {"period": None}, {"value": "7", "unit": None}, {"normalized_value": 3.0}]
    facts = facts_table(spark, rows)
    done = J.analyse(facts)
    pairs = {(r.fact_id_a, r.fact_id_b): r for r in done.relationships.collect()}
    # the fact without an entity fits all, also the other entity's; the others of two entities do not meet
    assert {p for p in pairs if 3 in p} == {(2, 3)} and (0, 1) in pairs and len(pairs) == 16
    assert pairs[0, 1].relationship_type == "CORROBORATES" and pairs[0, 6].relationship_type == "CONTRADICTS" and pairs[0, 4].relationship_type == "UNRELATED"
    assert json.loads(pairs[0, 1].match_checklist)[-1] == "verdict: CORROBORATES" and len(json.loads(pairs[0, 1].match_checklist)) == 7
    assert pairs[0, 6].can_compute_delta and pairs[0, 6].comparison_delta == 100.0 and not pairs[0, 4].can_compute_delta and pairs[0, 4].comparison_delta == 0.0
    s = done.summary.first()
    assert s.candidate_pairs_evaluated == s.relationships_found == len(pairs) and s.total_accepted_facts == len(rows)
    assert s.corroborations + s.contradictions + s.unrelated == len(pairs)
    assert {r.fact_id: r.final_confidence for r in done.confidences.collect()}[3] == 1.0
    counts = P.pair_count(facts).first()
    assert counts.pairs == len(rows) * (len(rows) - 1) // 2
    first = P.all_pairs(facts, 5).collect()
    assert [(r.pos_a, r.pos_b, r.score) for r in first] == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.0), (0, 4, 1.0), (0, 5, 1.0)]
    assert first[2].failed == ["entity: mill and other"] and len(first[2].passed) == 1 and len(first[0].passed) == 6


def test_vintage_and_scope_fall_back(spark):
    facts = facts_table(spark, [{}, {"normalized_value": 2.0}]).withColumn("vintage", F.when(F.col("pos") == 0, "FIRST_ADVANCE_ESTIMATE").otherwise("SECOND_ADVANCE_ESTIMATE"))
    assert [r.reconciliation for r in J.judged(P.candidate_pairs(facts)).collect()] == ["ESTIMATE_REVISION"]


def test_a_case_needs_firm_valid_facts(spark):
    facts = facts_table(spark, [{"value": "5", "unit": None}, {}, {}, {}]).withColumn("value_binding_confidence", F.when(F.col("pos") == 3, 0.7).otherwise(0.9)).withColumn("validation_status", F.when(F.col("pos") == 2, "rejected").otherwise("valid"))
    e = J.judged(P.candidate_pairs(facts)).withColumn("edge_id", F.col("a.pos") * 10 + F.col("b.pos"))
    # 0 and 1 are left: no subject, metric 20, unit 15, period 15, less 10 for a bare 5, binding 18, grounding 20, confidence 0.95 * 15
    assert [tuple(r) for r in K.cases(e).collect()] == [("CORROBORATES", 1, 92.25)]


def test_model_extraction_falls_back(spark, tmp_path):
    def answer(text, filename, page):
        if "dead" in text:
            raise TimeoutError("line is dead")
        return json.dumps({"facts": [{"metric": "Sales", "value": 12.5, "unit": "INR crore", "raw_quote": text}]}) if "odd" not in text else "[1]"

    texts = {"good": ["Sales came to 12.5 crore"], "late": ["Sales of the mill: 3 crore", "the line is dead, net profit was ₹5 million", "Sales again 9 crore"], "odd": ["odd answer"]}
    chunks = spark.createDataFrame([(d, "x.pdf", 1, i, t) for d, some in texts.items() for i, t in enumerate(some)], "document_id string, filename string, page_number int, chunk_index int, text string")
    facts, rejected, modes = A.extract_with_model(chunks, answer, f"{tmp_path}/answers")
    got = sorted((r.document_id, r.chunk_index, r.metric, r.extraction_method, r.normalized_value) for r in facts.collect())
    assert got == [("good", 0, "Sales", "llm", 125000000.0), ("late", 0, "Sales", "llm", 125000000.0), ("late", 1, "Net Profit", "fallback", 5000000.0)]
    assert {r.document_id: (r["mode"], r.warnings) for r in modes.collect()} == {"good": ("normal", []), "late": ("degraded", ["model failed: line is dead", "model failed on an earlier chunk"]), "odd": ("degraded", ["model failed: no JSON object"])}
    assert all(r.rejection_reason for r in rejected.collect())


def test_a_model_that_hangs_is_left_behind(spark, tmp_path):
    def answer(text, filename, page):
        import time

        if "slow" in text:
            time.sleep(60)
        return json.dumps({"facts": [{"metric": "Sales", "value": "12", "unit": "INR crore", "raw_quote": text}]})

    texts = {"a": ["Sales came to 12 crore", "the slow part of 12 crore", "Sales of 12 crore"], "b": ["Sales were 12 crore"] * 3, "c": ["slow 12 crore"]}
    chunks = spark.createDataFrame([(d, "x.pdf", 1, i, t) for d, some in texts.items() for i, t in enumerate(some)], "document_id string, filename string, page_number int, chunk_index int, text string")
    answers = A.ask(chunks.coalesce(1), answer, f"{tmp_path}/answers", seconds=1.0).collect()
    got = {(r.document_id, r.chunk_index): (r.method, r.warning) for r in answers}
    late, after = ("fallback", "model failed: no answer in 1 s"), ("fallback", "model failed on an earlier chunk")
    assert got == {("a", 0): ("llm", None), ("a", 1): late, ("a", 2): after, **{("b", i): ("llm", None) for i in range(3)}, ("c", 0): late}
    assert all(r.answer is None or json.loads(r.answer)["facts"][0]["raw_quote"] == r.text for r in answers)  # order is kept

    def opinion(question):
        import time

        time.sleep(60 if json.loads(question)["a"]["pos"] == 0 else 0)
        return json.dumps({"taxonomy_category": "contextual_difference", "confidence_delta": 0.9})

    facts = facts_table(spark, [{}, {}, {"period": None}])
    judged = A.judge_with_model(opinion, f"{tmp_path}/said", seconds=1.0)(P.candidate_pairs(facts)).collect()
    assert {(r.a.pos, r.b.pos): r.taxonomy for r in judged} == {(0, 1): "CORROBORATES", (0, 2): "UNRELATED", (1, 2): "CONTEXTUAL_DIFFERENCE"}


def test_model_judges_what_rules_leave_open(spark, tmp_path):
    def opinion(question):
        pair = json.loads(question)
        if pair["a"]["pos"] == 1:
            raise TimeoutError
        return json.dumps({"taxonomy_category": "contextual_difference", "confidence_delta": 0.9})

    facts = facts_table(spark, [{}, {}, {"period": None}])
    got = {(r.a.pos, r.b.pos): (r.relationship, r.taxonomy, r.confidence) for r in A.judge_with_model(opinion, f"{tmp_path}/said")(P.candidate_pairs(facts)).collect()}
    assert got == {(0, 1): ("CORROBORATES", "CORROBORATES", 0.95), (0, 2): ("RECONCILED", "CONTEXTUAL_DIFFERENCE", 0.9), (1, 2): ("UNRELATED", "UNRELATED", 0.0)}


def test_pages_of_files(spark, tmp_path):
    for name, content in (("a.PDF", b"one|two"), ("b.pdf", b"bad"), ("c.txt", b"no"), ("d.pdf", b"")):
        (tmp_path / name).write_bytes(content)

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|")

    rows = A.pages_of(S.binary_documents(spark, str(tmp_path)), parse).collect()
    assert sorted((r.filename, r.page_number or 0, r.text or r.error) for r in rows) == [("a.PDF", 1, "one"), ("a.PDF", 2, "two"), ("b.pdf", 0, "broken")]


def test_six_digits(spark):
    values = [0.0, 1.0, -2.5, 123456.0, 604304.5, 604305.5, 1234567.0, 0.0001234567, 0.00001234567, 1e15, 123456.7, -0.5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(T.short(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:g}" for v in values]


def test_grounded_passages_equal_all_pairs(spark):
    texts = ["The quick brown fox jumps over the lazy dog again", "the QUICK brown  fox jumps\nover the lazy dogs", "nothing", None, "", "a b"]
    quotes = ["quick brown fox jumps over the lazy", "QUICK brown fox jumps over", "b", "lazy dog", "ick brown fox jumps over the la", ""]
    t, q = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    want = {(r.doc_id, r.item_id): r.g for r in t.crossJoin(q).select("doc_id", "item_id", T.grounding(F.col("quote"), F.col("text")).alias("g")).where("g > 0").collect()}
    assert {(r.doc_id, r.item_id): r.grounding for r in X.grounded(t, q).collect()} == want and len(want) >= 8
