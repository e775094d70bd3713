"""Registered queries of the fact engine, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillfact.functions import lexicon as L
from quillfact.functions import normalize as N
from quillfact.functions import roles as R
from quillfact.functions import text as T
from quillfact.functions import validate as V
from quillfact.operators import chunks as C
from quillfact.operators import classes as Q
from quillfact.operators import extract as X
from quillfact.operators import judge as J
from quillfact.operators import pairs as P
from quillfact.operators import rank as K
from quillfact.plans.facts import FACTS_SQL, facts_sql, order_facts, read, spread
from quillfact.plans.lines import LINES_SQL as LADDER_SQL
from quillfact.plans.lines import made_lines
from quillfact.sources import connectors as A
from quillfact.sources import store as S
from quillfact.sources.scratch import settle
from quillfact.streaming.analysis import analyse_store
from quillfact.streaming.landing import land

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return note


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs of the facts over the orders; facts are written once, for pairing reads them four times."""
    return J.judged(P.ready_pairs(settle(P.ready_facts(order_facts(spark, sf_dir))))).withColumn("edge_id", F.col("a.pos") * 1_000_000_000 + F.col("b.pos"))


# Facts and their relationships


@query(FACTS_SQL + "SELECT taxonomy, reconciliation, count(*) AS n FROM j GROUP BY ALL")
def class_counts(spark, sf_dir):
    """Counted by classes of facts: no pair of facts is made."""
    return Q.class_counts(settle(order_facts(spark, sf_dir)))


@query(FACTS_SQL + "SELECT pos_a, pos_b, relationship, taxonomy, reconciliation, confidence, delta FROM j")
def judge_verdict(spark, sf_dir):
    return edges(spark, sf_dir).select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "relationship", "taxonomy", "reconciliation", "confidence", "delta")


@query(FACTS_SQL + "SELECT pos, document_id, entity, period FROM e")
def eligible_facts(spark, sf_dir):
    return P.with_canonical(order_facts(spark, sf_dir)).where(P.eligible()).select("pos", "document_id", "entity", "period")


@query(FACTS_SQL + "SELECT pos_a, pos_b, doc_a, doc_b FROM p")
def comparable_pairs(spark, sf_dir):
    return P.candidate_pairs(order_facts(spark, sf_dir)).select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.col("a.document_id").alias("doc_a"), F.col("b.document_id").alias("doc_b"))


@query(FACTS_SQL + "SELECT pos_a, pos_b, priority FROM q")
def pair_priority(spark, sf_dir):
    return P.candidate_pairs(order_facts(spark, sf_dir)).select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "priority")


@query(FACTS_SQL + "SELECT pos_a, pos_b, priority FROM q ORDER BY priority DESC, pos_a, pos_b LIMIT 50")
def pair_topk(spark, sf_dir):
    return P.ranked(P.candidate_pairs(order_facts(spark, sf_dir)), L.PREVIEW).select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "priority")


@query(FACTS_SQL + """, d AS (SELECT a.pos AS pos_a, b.pos AS pos_b, a.v IS NOT NULL AND b.v IS NOT NULL AND a.unit IS NOT NULL AND b.unit IS NOT NULL AS eligible, lower(a.entity) AS ea, lower(b.entity) AS eb FROM f a JOIN f b ON a.pos < b.pos AND a.document_id <> b.document_id ORDER BY 1, 2 LIMIT 50)
SELECT pos_a, pos_b, CAST(CASE WHEN eligible AND ea = eb THEN 1 ELSE 0 END AS DOUBLE) AS score, CAST(CASE WHEN NOT eligible THEN 0 WHEN ea <> eb THEN 1 ELSE 6 END AS INT) AS n_passed, CASE WHEN NOT eligible THEN 'eligible: both facts' WHEN ea <> eb THEN 'entity: ' || ea || ' and ' || eb ELSE '' END AS failed FROM d""")
def debug_all_pairs(spark, sf_dir):
    return P.all_pairs(order_facts(spark, sf_dir)).select("pos_a", "pos_b", "score", F.size("passed").alias("n_passed"), F.array_join("failed", "; ").alias("failed"))


@query(FACTS_SQL + "SELECT edge_id, a.entity AS entity_a, b.entity AS entity_b, a.period AS period_a, b.period AS period_b, taxonomy FROM j LEFT JOIN f a ON a.pos = pos_a LEFT JOIN f b ON b.pos = pos_b")
def relationship_hydrate(spark, sf_dir):
    facts = order_facts(spark, sf_dir).select("fact_id", F.struct("entity", "period", "value").alias("fact"))
    e = edges(spark, sf_dir).select("edge_id", "taxonomy", F.col("a.fact_id").alias("fa"), F.col("b.fact_id").alias("fb"))
    e = e.join(facts.select(F.col("fact_id").alias("fa"), F.col("fact").alias("a")), "fa", "left").join(facts.select(F.col("fact_id").alias("fb"), F.col("fact").alias("b")), "fb", "left")
    return e.select("edge_id", F.col("a.entity").alias("entity_a"), F.col("b.entity").alias("entity_b"), F.col("a.period").alias("period_a"), F.col("b.period").alias("period_b"), "taxonomy")


@query(FACTS_SQL + "SELECT pos AS fact_id, document_id || '.pdf' AS source_document, entity, period FROM f")
def facts_with_source(spark, sf_dir):
    docs = spark.createDataFrame([(d, f"{d}.pdf") for d in ("ledger", "copy", "summary", "rounded", "provisional", "partial", "restated", "nounit")], "document_id string, source_document string")
    return order_facts(spark, sf_dir).join(F.broadcast(docs), "document_id").select("fact_id", "source_document", "entity", "period")


@query(FACTS_SQL + ", s AS (SELECT pos, sum(c) AS c FROM (SELECT pos_a AS pos, CAST(round(confidence * 100) AS BIGINT) AS c FROM j UNION ALL SELECT pos_b, CAST(round(confidence * 100) AS BIGINT) FROM j) GROUP BY pos) SELECT f.pos AS fact_id, round(greatest(0, least(1, ext * ground * bind + coalesce(c, 0) / CAST(100 AS DOUBLE))), 3) AS final_confidence FROM f LEFT JOIN s USING (pos)")
def rescored_confidence(spark, sf_dir):
    return Q.confidences(settle(order_facts(spark, sf_dir)))


COUNTERS_SQL = """ SELECT count(*) AS relationships_found, count(*) FILTER (relationship = 'CORROBORATES') AS corroborations, count(*) FILTER (relationship = 'CONTRADICTS') AS contradictions, count(*) FILTER (relationship = 'LIKELY_CONTRADICTION') AS likely_contradictions,
count(*) FILTER (relationship = 'RECONCILED') AS reconciled, count(*) FILTER (relationship = 'TEMPORAL_COMPARISON') AS temporal_comparisons, CAST(0 AS BIGINT) AS contextual_differences, CAST(0 AS BIGINT) AS unrelated, CAST(0 AS BIGINT) AS uncertain"""


@query(FACTS_SQL + COUNTERS_SQL + ", count(*) AS candidate_pairs_evaluated, (SELECT count(*) FROM f) AS total_accepted_facts FROM j")
def analysis_summary(spark, sf_dir):
    return J.analyse(settle(order_facts(spark, sf_dir))).summary


@query(facts_sql("c_name") + "SELECT taxonomy, reconciliation, count(*) AS n FROM j GROUP BY ALL")
def customer_class_counts(spark, sf_dir):
    """Counted by periods: a customer has few facts of one period, and only those make pairs."""
    return Q.class_counts_by_period(order_facts(spark, sf_dir, "c_name"))


@query(FACTS_SQL + """, x AS (SELECT *, CASE WHEN reconciliation <> 'NONE' THEN reconciliation ELSE taxonomy END AS kind, format('{:g}', va) || ' INR' AS na_, format('{:g}', vb) || ' INR' AS nb_, CAST(delta AS VARCHAR) || ' % apart' AS apart,
  CAST(CAST(round(va) AS DECIMAL(30, 0)) AS VARCHAR) AS ta, CAST(CAST(round(vb) AS DECIMAL(30, 0)) AS VARCHAR) AS tb, ' for ' || pa AS at_ FROM j)
SELECT edge_id, CAST(TRUE AS BOOLEAN) AS can_compute_delta, delta AS comparison_delta, CAST(7 AS INT) AS n_checks, CASE kind
  WHEN 'SCOPE_PERIOD_DIFFERENCE' THEN 'One period in two scopes, ' || coalesce(sa, 'FULL_YEAR') || ' and ' || coalesce(sb, 'FULL_YEAR') || at_ || ': a part of the year is no contradiction of another.'
  WHEN 'ESTIMATE_REVISION' THEN 'Estimates of two vintages, ' || na || ' and ' || nb || at_ || '.' WHEN 'HISTORICAL_TREND' THEN 'Total Order Revenue in ' || pa || ' and ' || pb || ': ' || ta || ' and ' || tb || '.'
  WHEN 'UNIT_CONVERSION' THEN 'Equal in one unit: ' || ta || ' ' || ua || ' and ' || tb || ' ' || ub || ' are ' || na_ || '.' WHEN 'CORROBORATES' THEN 'Both say ' || na_ || at_ || '.'
  WHEN 'ROUNDING' THEN na_ || ' and ' || nb_ || ' differ by rounding (' || apart || ')' || at_ || '.' ELSE na_ || ' and ' || nb_ || ' are ' || apart || at_ || ' and nothing explains it.' END AS reasoning FROM x""")
def relationship_explain(spark, sf_dir):
    out = J.explained(edges(spark, sf_dir))
    return out.select("edge_id", "can_compute_delta", "comparison_delta", F.size("match_checklist").alias("n_checks"), "reasoning")


@query(FACTS_SQL + "SELECT edge_id, taxonomy, confidence FROM (SELECT *, row_number() OVER (PARTITION BY taxonomy = 'TEMPORAL_COMPARISON' ORDER BY confidence DESC, edge_id) AS k FROM j WHERE confidence >= 0.7) WHERE taxonomy <> 'TEMPORAL_COMPARISON' OR k <= 20 ORDER BY taxonomy = 'TEMPORAL_COMPARISON', CASE WHEN taxonomy = 'TEMPORAL_COMPARISON' THEN -confidence END, edge_id")
def relationship_listing(spark, sf_dir):
    return K.listing(edges(spark, sf_dir)).select("edge_id", "taxonomy", "confidence")


@query(FACTS_SQL + "SELECT pos AS fact_id, document_id, entity, period FROM f ORDER BY pos")
def fact_listing(spark, sf_dir):
    return order_facts(spark, sf_dir).select("fact_id", "document_id", "entity", "period").orderBy("fact_id")


@query(FACTS_SQL + "SELECT edge_id, taxonomy, confidence FROM (SELECT *, row_number() OVER (PARTITION BY taxonomy = 'TEMPORAL_COMPARISON' ORDER BY confidence DESC, edge_id) AS k FROM j) WHERE taxonomy <> 'TEMPORAL_COMPARISON' OR k <= 20")
def temporal_cap(spark, sf_dir):
    return K.temporal_cap(edges(spark, sf_dir)).select("edge_id", "taxonomy", "confidence")


@query(FACTS_SQL + """, s AS (SELECT *, CASE WHEN relationship = 'LIKELY_CONTRADICTION' THEN 'CONTRADICTS' ELSE relationship END AS slot, row_number() OVER (PARTITION BY taxonomy = 'TEMPORAL_COMPARISON' ORDER BY confidence DESC, edge_id) AS shown FROM j WHERE confidence >= 0.7),
g AS (SELECT * FROM s WHERE (taxonomy <> 'TEMPORAL_COMPARISON' OR shown <= 20) AND valid AND ba >= 0.75 AND bb >= 0.75),
t AS (SELECT *, round(CAST(50 + CASE WHEN subjects THEN 15 ELSE 0 END + CASE WHEN slot = 'RECONCILED' AND (reconciliation = 'ESTIMATE_REVISION' OR (na IS NOT NULL AND nb IS NOT NULL)) THEN 50 WHEN slot = 'RECONCILED' AND reconciliation IN ('UNIT_CONVERSION', 'ROUNDING') THEN 35 WHEN slot = 'TEMPORAL_COMPARISON' AND reconciliation = 'SCOPE_PERIOD_DIFFERENCE' THEN 40 ELSE 0 END AS DOUBLE)
  + ((ba + bb) * CAST(10 AS DOUBLE) + (ga + gb) * CAST(10 AS DOUBLE)) + confidence * CAST(15 AS DOUBLE), 6) AS score FROM g)
SELECT slot, edge_id, score FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, CASE WHEN slot = 'TEMPORAL_COMPARISON' THEN -confidence ELSE 0 END, edge_id) AS k FROM t) WHERE k = 1""")
def case_top1(spark, sf_dir):
    return K.cases(edges(spark, sf_dir))


@query(FACTS_SQL + "SELECT count(*) FILTER (contains(taxonomy, 'CORROBORATES')) AS corroborated, count(*) FILTER (contains(taxonomy, 'CONTRADICT')) AS contradictions, count(*) FILTER (contains(taxonomy, 'RECONCILED')) AS reconciled, count(*) FILTER (contains(taxonomy, 'TEMPORAL')) AS temporal, count(*) AS total FROM j")
def dashboard(spark, sf_dir):
    return J.dashboard(edges(spark, sf_dir))


def _turns(spark, sf_dir):
    """Conversations as documents, their turns as pages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.concat(F.col("conv_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("turn").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


@query(r"SELECT CAST(conv_id AS VARCHAR) AS document_id, conv_id || '.txt' AS filename, CAST(count(DISTINCT turn) AS INT) AS page_count, CAST(count(*) FILTER (regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', '', 'g') <> '') AS INT) AS chunk_count FROM conversations GROUP BY conv_id")
def document_counts(spark, sf_dir):
    """Pages and chunks of documents (every turn is a page within the limit of a chunk)."""
    pages = _turns(spark, sf_dir)
    return S.documents_of(pages, C.chunk_pages(pages))


@query(FACTS_SQL + "SELECT (SELECT count(*) FROM f) AS accepted_facts_count, (SELECT count(*) FROM part WHERE p_partkey % 13 <> 2) AS rejected_candidates_count, (SELECT count(*) FROM f a JOIN f b ON a.pos < b.pos AND a.document_id <> b.document_id) AS candidate_pairs_evaluated")
def pipeline_counts(spark, sf_dir):
    return J.pipeline_counts(order_facts(spark, sf_dir), _candidates(spark, sf_dir).where("failure_type is not null"))


# Store


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    e = edges(spark, sf_dir).select("edge_id", F.col("a.fact_id").alias("fact_id_a"), F.col("b.fact_id").alias("fact_id_b"))
    return {"facts": order_facts(spark, sf_dir), "fact_relationships": e}


@query(FACTS_SQL + "SELECT edge_id, pos_a AS fact_id_a, pos_b AS fact_id_b FROM j WHERE doc_a <> 'copy' AND doc_b <> 'copy'")
def delete_cascade(spark, sf_dir):
    return S.without_document(_tables(spark, sf_dir), spark.createDataFrame([("copy",)], "document_id string"))["fact_relationships"]


def _names(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "document_id string")


@query(FACTS_SQL + "SELECT entity, period, document_id, CAST(CASE WHEN document_id = 'restated' THEN 2 ELSE 1 END AS BIGINT) AS version FROM f WHERE document_id <> 'provisional'")
def replace_document(spark, sf_dir):
    """Two documents are extracted again; one of them has no facts any more."""
    root = S.scratch(spark)
    facts = order_facts(spark, sf_dir).select("entity", "period", "document_id", F.lit(1).cast("long").alias("version"))
    S.append(facts, root, "facts")
    S.replace_documents(facts.where("document_id = 'restated'").withColumn("version", F.lit(2).cast("long")), root, "facts", _names(spark, "restated", "provisional"))
    return S.read(spark, root, "facts").select("entity", "period", "document_id", "version")


@query(FACTS_SQL + "SELECT 'fact' AS kind, pos AS id FROM f WHERE document_id <> 'copy' UNION ALL SELECT 'relationship', edge_id FROM j WHERE doc_a <> 'copy' AND doc_b <> 'copy'")
def delete_stored_document(spark, sf_dir):
    """A document is removed from the stored tables, with its relationships."""
    root = S.scratch(spark)
    S.commit(spark, root, _tables(spark, sf_dir))
    S.delete_documents(spark, root, _names(spark, "copy"))
    facts, edges_ = S.read(spark, root, "facts"), S.read(spark, root, "fact_relationships")
    return facts.select(F.lit("fact").alias("kind"), F.col("fact_id").alias("id")).unionByName(edges_.select(F.lit("relationship").alias("kind"), F.col("edge_id").alias("id")))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def upsert_documents(spark, sf_dir):
    root, docs = S.scratch(spark), read(spark, sf_dir, "documents").select("doc_id")
    S.commit(spark, root, {"documents": docs.withColumn("version", F.lit("old"))})
    S.upsert(docs.where("doc_id % 7 = 0").withColumn("version", F.lit("new")), root, "documents", "doc_id")
    return S.read(spark, root, "documents")


@query(FACTS_SQL + "SELECT pos_a AS fact_id_a, pos_b AS fact_id_b, relationship AS relationship_type, confidence, CAST(4 AS INT) AS pipeline_version FROM j")
def replace_relationships(spark, sf_dir):
    """An analysis takes the place of all stored relationships."""
    root, facts = S.scratch(spark), settle(order_facts(spark, sf_dir))
    S.commit(spark, root, {"fact_relationships": _tables(spark, sf_dir)["fact_relationships"]})
    S.commit(spark, root, {"fact_relationships": J.analyse(facts).relationships})
    return S.read(spark, root, "fact_relationships").select("fact_id_a", "fact_id_b", "relationship_type", "confidence", "pipeline_version")


@query(FACTS_SQL + "SELECT pos AS fact_id FROM f WHERE document_id IN ('ledger', 'copy')")
def facts_with_chunks(spark, sf_dir):
    facts = order_facts(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    return S.with_chunks(facts, _names(spark, "ledger", "copy", "gone").withColumn("chunk_index", F.lit(0))).select("fact_id")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_dump(spark, sf_dir):
    """A dump as JSON, read back."""
    root = S.scratch(spark)
    S.write_json(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{root}/dump")
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(f"{root}/dump")


@query(FACTS_SQL + "SELECT pos AS fact_id, CAST(3 + pos % 3 AS INT) AS pipeline_version FROM f WHERE 3 + pos % 3 >= 4")
def version_purge(spark, sf_dir):
    return S.purged(order_facts(spark, sf_dir).select("fact_id", (3 + F.col("fact_id") % 3).cast("int").alias("pipeline_version")))


@query(FACTS_SQL + "SELECT pos AS fact_id, entity AS subject, 'General Assertion' AS metric, 'was reported as' AS predicate, 'valid' AS validation_status, CAST(4 AS INT) AS pipeline_version, CAST(1 AS DOUBLE) AS extraction_confidence, CAST(1 AS DOUBLE) AS grounding_confidence, CAST(1 AS DOUBLE) AS value_binding_confidence, CAST(1 AS DOUBLE) AS final_confidence, 'UNKNOWN' AS value_type, TRUE AS is_numeric, 'llm' AS extraction_method, 'sentence_direct' AS binding_method FROM f")
def schema_evolution(spark, sf_dir):
    return S.evolved(order_facts(spark, sf_dir).select("fact_id", F.col("entity").alias("subject"), F.lit(None).cast("string").alias("metric")))


# From pages to stored relationships


def _reports(spark, sf_dir):
    """A document for each nation, with a page for each year of its orders: a series, a line on profit, and lines that are no facts."""
    n, y = read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.year("o_orderdate")
    orders = read(spark, sf_dir, "orders").select("o_custkey", y.alias("y"), F.col("o_orderpriority").startswith("1").alias("urgent"))
    sums = orders.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "y").agg(F.count("*").alias("n"), F.count_if("urgent").alias("u"))
    num = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("Net profit was ₹"), (F.col("n") + 200).cast("string"), F.lit(" million in FY"), num("y"), F.lit(" against a plan.\nContents ...... 12\n(₹ in million)\nExpress parcel shipment volume (million)\nFY"), num("y"), F.lit(" FY"), (F.col("y") + 1).cast("string"),
        F.lit("\n"), (F.col("n") + 3000).cast("string"), F.lit(" "), (F.col("u") + 3000).cast("string"), F.lit("\nCPI [2001=100]\n"),
    )
    return sums.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("document_id"), F.lit("delhivery-fy24.pdf").alias("filename"), (F.col("y") - 1991).cast("int").alias("page_number"), text.alias("text"))


REPORTS_SQL = """WITH s AS (SELECT n_name AS doc, year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (starts_with(o_orderpriority, '1')) AS u FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
d AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY y) - 1 AS INT) AS chunk FROM s),
w AS (SELECT doc, y - 1991 AS page, chunk, r, m, p, v, x, nu, t, pred, b, e, c FROM d, LATERAL (VALUES
  (1, 'Express Parcel Shipment Volume', 'FY ' || y, CAST(n + 3000 AS VARCHAR), n + 3000, 'million_parcels', 'COUNT', 'was reported as', 'table_series_alignment', 0.92, 0.98),
  (2, 'Express Parcel Shipment Volume', 'FY ' || (y + 1), CAST(u + 3000 AS VARCHAR), u + 3000, 'million_parcels', 'COUNT', 'was reported as', 'table_series_alignment', 0.92, 0.98),
  (3, 'Net Profit', 'FY ' || y, '₹' || (n + 200) || ' million', (n + 200) * 1000000, 'INR', 'MONEY', 'reached', 'sentence_direct', 0.85, 0.85)) f(r, m, p, v, x, nu, t, pred, b, e, c)),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY page, r) AS INT) AS place, CAST(x AS DOUBLE) AS value FROM w),
g AS (SELECT a.doc AS doc_a, a.place AS place_a, b.doc AS doc_b, b.place AS place_b, a.p = b.p AS same, round(abs(a.value - b.value) / ((abs(a.value) + abs(b.value)) / CAST(2 AS DOUBLE)) * CAST(100 AS DOUBLE), 2) AS delta
  FROM f a JOIN f b ON a.m = b.m AND (a.doc, a.place) < (b.doc, b.place) AND (a.doc <> b.doc OR a.value <> b.value)),
h AS (SELECT *, CASE WHEN NOT same THEN 'TEMPORAL_COMPARISON' WHEN delta < 0.1 THEN 'CORROBORATES' WHEN delta < 1.5 THEN 'RECONCILED_ROUNDING' WHEN delta <= 5.0 THEN 'LIKELY_CONTRADICTION' ELSE 'CONTRADICTS' END AS taxonomy_category,
  (CASE WHEN NOT same THEN 0.85 WHEN delta < 0.1 THEN 0.95 WHEN delta < 1.5 THEN 0.90 WHEN delta <= 5.0 THEN 0.80 ELSE 0.85 END)::DOUBLE AS confidence FROM g)
"""


def _placed(facts):
    """Stored facts with their place in the document: the numbers themselves follow the hashes of the documents."""
    return facts.withColumn("place", (F.col("fact_id") - F.min("fact_id").over(Window.partitionBy("document_id")) + 1).cast("int"))


_STORES: dict = {}


def _landed(spark, sf_dir, analysed: bool = False) -> str:
    """A store of the reports, landed once a session (and one of its tables, analysed), for as long as its folder is there."""
    key = (spark.sparkContext.applicationId, sf_dir, analysed)
    if key in _STORES and S.exists(spark, _STORES[key], "facts"):
        return _STORES[key]
    root = S.scratch(spark)
    if analysed:
        S.commit(spark, root, {t: S.read(spark, _landed(spark, sf_dir), t) for t in S.BY_DOCUMENT})
        analyse_store(spark, root)
    else:
        land(_reports(spark, sf_dir), root, ("queries", 0))
    _STORES[key] = root
    return root


@query(REPORTS_SQL + """SELECT doc AS document_id, place, CAST(page AS INT) AS page, chunk AS chunk_index, CAST(TRUE AS BOOLEAN) AS chunk_is_there, 'Delhivery Limited' AS subject, m AS metric, pred AS predicate, v AS value, value AS normalized_value, nu AS normalized_unit, p AS period, t AS value_type, b AS binding_method, 'fallback' AS extraction_method,
CAST(4 AS INT) AS pipeline_version, round(CAST(e AS DOUBLE) * CAST(c AS DOUBLE), 3) AS final_confidence, (SELECT count(*) FROM f) AS numbers FROM f""")
def stored_facts(spark, sf_dir):
    """Facts as they are stored: numbered without gaps, with their chunks, predicates and versions."""
    root = _landed(spark, sf_dir)
    facts, chunks = S.rows_of(spark, root, "facts"), S.rows_of(spark, root, "chunks").select("chunk_id", "document_id", "chunk_index", F.lit(True).alias("chunk_is_there"))
    numbers = facts.agg(F.max("fact_id").alias("numbers"))
    out = _placed(facts).join(chunks, ["chunk_id", "document_id", "chunk_index"]).join(numbers, F.col("numbers") > 0)
    return out.select("document_id", "place", "page", "chunk_index", "chunk_is_there", "subject", "metric", "predicate", "value", "normalized_value", "normalized_unit", "period", "value_type", "binding_method", "extraction_method", "pipeline_version", "final_confidence", "numbers")


@query(REPORTS_SQL + "SELECT doc AS document_id, CAST(page AS INT) AS page, unnest(['Contents ...... 12', '(₹ in million)', 'CPI [2001=100]']) AS candidate_text, unnest(['NAVIGATION_REFERENCE', 'TABLE_HEADER_WITHOUT_VALUE', 'STRUCTURAL_INDEX_METADATA']) AS failure_type, CAST(unnest([0, 1, 2]) + 3 * chunk AS INT) AS place FROM (SELECT DISTINCT doc, page, chunk FROM w)")
def stored_rejects(spark, sf_dir):
    """The ledger as it is stored, in the order in which lines were met."""
    rows = S.rows_of(spark, _landed(spark, sf_dir), "rejected_extractions")
    place = (F.col("rejected_id") - F.min("rejected_id").over(Window.partitionBy("document_id"))).cast("int")
    return rows.where("created_at is not null").select("document_id", "page", "candidate_text", "failure_type", place.alias("place"))


@query(REPORTS_SQL + "SELECT doc_a, place_a, doc_b, place_b, taxonomy_category, confidence, delta AS comparison_delta, (SELECT count(*) FROM h) AS numbers FROM h")
def stored_relationships(spark, sf_dir):
    """From pages to stored relationships: landed, extracted, numbered, analysed, committed, and read back."""
    root = _landed(spark, sf_dir, analysed=True)
    facts = _placed(S.rows_of(spark, root, "facts")).select("fact_id", F.struct("document_id", "place").alias("at"))
    e = S.rows_of(spark, root, "fact_relationships")
    e = e.join(facts.select(F.col("fact_id").alias("fact_id_a"), F.col("at").alias("x")), "fact_id_a").join(facts.select(F.col("fact_id").alias("fact_id_b"), F.col("at").alias("y")), "fact_id_b")
    e = e.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(e.agg(F.max("relationship_id").alias("numbers")), F.col("numbers") > 0)
    return e.select(F.col("a.document_id").alias("doc_a"), F.col("a.place").alias("place_a"), F.col("b.document_id").alias("doc_b"), F.col("b.place").alias("place_b"), "taxonomy_category", "confidence", "comparison_delta", "numbers")


@query(REPORTS_SQL + """, k AS (SELECT doc, place, sum(c) AS c FROM (SELECT doc_a AS doc, place_a AS place, CAST(round(confidence * 100) AS BIGINT) AS c FROM h UNION ALL SELECT doc_b, place_b, CAST(round(confidence * 100) AS BIGINT) FROM h) GROUP BY ALL)
SELECT doc AS document_id, place, round(greatest(0, least(1, CAST(e AS DOUBLE) * 1.0::DOUBLE * CAST(f.c AS DOUBLE) + coalesce(k.c, 0) / CAST(100 AS DOUBLE))), 3) AS final_confidence FROM f LEFT JOIN k USING (doc, place)""")
def stored_confidences(spark, sf_dir):
    """Confidences after an analysis, as they are written back to the stored facts."""
    root = _landed(spark, sf_dir, analysed=True)
    return _placed(S.rows_of(spark, root, "facts")).select("document_id", "place", "final_confidence")


@query(REPORTS_SQL + "SELECT doc AS document_id, 'delhivery-fy24.pdf' AS filename, CAST(count(*) AS INT) AS page_count, CAST(count(*) AS INT) AS chunk_count FROM s GROUP BY doc")
def document_listing(spark, sf_dir):
    """Stored documents, the latest first."""
    rows = S.rows_of(spark, _landed(spark, sf_dir), "documents").where("upload_timestamp is not null and file_hash is not null")
    return rows.orderBy(F.desc("upload_timestamp"), "document_id").select("document_id", "filename", "page_count", "chunk_count")


@query(REPORTS_SQL + r"""SELECT doc AS document_id, chunk AS chunk_index, CAST(page AS INT) AS page_number, 0 AS start_char, CAST(length(text) AS INT) AS end_char, CAST(floor(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) * CAST(1.33 AS DOUBLE)) AS INT) AS token_count FROM (SELECT doc, chunk, y - 1991 AS page,
  'Net profit was ₹' || (n + 200) || ' million in FY' || y || ' against a plan.' || chr(10) || 'Contents ...... 12' || chr(10) || '(₹ in million)' || chr(10) || 'Express parcel shipment volume (million)' || chr(10) || 'FY' || y || ' FY' || (y + 1) || chr(10) || (n + 3000) || ' ' || (u + 3000) || chr(10) || 'CPI [2001=100]' || chr(10) AS text FROM d)""")
def chunk_listing(spark, sf_dir):
    """Stored chunks, document by document in their order."""
    rows = S.rows_of(spark, _landed(spark, sf_dir), "chunks")
    return rows.orderBy("document_id", "chunk_index").select("document_id", "chunk_index", "page_number", "start_char", "end_char", "token_count")


@query("""SELECT p_partkey, CASE WHEN v >= 1e9 THEN printf('%.2f', v / 1e9::DOUBLE) || 'B' WHEN v >= 1e6 THEN printf('%.2f', v / 1e6::DOUBLE) || 'M' WHEN v >= 1000 AND v <> floor(v) THEN printf('%.2f', v) ELSE regexp_replace(format('{:,.3f}', v), '\.?0+$', '') END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' INR' END AS shown
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size * 1e9 WHEN 1 THEN p_size * 1e6 WHEN 2 THEN p_retailprice WHEN 3 THEN p_size * 101 WHEN 4 THEN -p_size * 1000 ELSE p_size / CAST(8 AS DOUBLE) END::DOUBLE AS v FROM part)""")
def human_values(spark, sf_dir):
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("double")
    v = F.when(k == 0, size * 1e9).when(k == 1, size * 1e6).when(k == 2, F.col("p_retailprice").cast("double")).when(k == 3, size * 101).when(k == 4, -size * 1000).otherwise(size / 8)
    return read(spark, sf_dir, "part").select("p_partkey", N.human(v, F.when(F.col("p_partkey") % 3 != 0, "INR")).alias("shown"))


@query(FACTS_SQL + """, r AS (SELECT a.pos, b.pos AS other, a.document_id AS doc_a, b.document_id AS doc_b FROM e a JOIN e b ON a.pos < b.pos AND a.document_id <> b.document_id WHERE (a.document_id = 'copy') <> (b.document_id = 'copy'))
SELECT pos AS pos_a, other AS pos_b, CAST(CAST(2 AS DOUBLE) / 4 AS DOUBLE) AS score FROM r ORDER BY pos, other LIMIT 40""")
def similar_pairs(spark, sf_dir):
    """The first pairs of facts whose metrics are alike and no more (the facts of one report have another name here), gates off."""
    facts = order_facts(spark, sf_dir).withColumn("metric", F.when(F.col("document_id") == "copy", "Total Revenue of Shops").otherwise(F.col("metric")))
    ready = settle(P.ready_facts(facts))
    out = P.with_similar(P.ready_pairs(ready).limit(0), P.similar_pairs(ready, gates=False), 40)
    return out.select(F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), "score")


# Text


@query(r"SELECT doc_id, CAST(floor(len(regexp_extract_all(coalesce(text, ''), '[^\t\n\x0B\f\r ]+')) * CAST(1.33 AS DOUBLE)) AS INT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def _pages(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


@query(r"WITH l AS (SELECT doc_id, regexp_replace(x, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS line_no, line FROM l WHERE line <> ''")
def nonblank_line_pos(spark, sf_dir):
    return C.nonblank_lines(_pages(spark, sf_dir), "document_id")


@query(r"SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS chunks, CAST(len(text) AS INT) AS last_char FROM documents WHERE regexp_replace(text, '[\t\n\x0B\f\r ]+', '', 'g') <> ''")
def chunk_count_per_doc(spark, sf_dir):
    """Chunks of the whole texts (they have no blank lines, so each is one paragraph; chunk_pack has several)."""
    return C.chunk_pages(_pages(spark, sf_dir)).groupBy("document_id").agg(F.count("*").cast("int").alias("chunks"), F.max("end_char").cast("int").alias("last_char"))


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, text, len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) AS w FROM conversations),
p AS (SELECT *, CAST(sum(len(text) + 2) OVER (PARTITION BY conv_id ORDER BY i) - len(text) - 2 AS INT) AS s, count(*) OVER (PARTITION BY conv_id) AS n, sum(w) OVER (PARTITION BY conv_id) AS words, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM t),
q AS (SELECT *, CAST(CASE WHEN i = n THEN len(whole) ELSE s + len(text) + 1 END AS INT) AS e FROM p),
r AS (SELECT conv_id, i, s AS c, e, w, 0 AS k FROM q WHERE i = 1
  UNION ALL SELECT q.conv_id, q.i, CASE WHEN floor((r.w + q.w) * CAST(1.33 AS DOUBLE)) <= 750 THEN r.c ELSE q.s END, q.e, CASE WHEN floor((r.w + q.w) * CAST(1.33 AS DOUBLE)) <= 750 THEN r.w + q.w ELSE q.w END, CASE WHEN floor((r.w + q.w) * CAST(1.33 AS DOUBLE)) <= 750 THEN r.k ELSE r.k + 1 END FROM r JOIN q ON q.conv_id = r.conv_id AND q.i = r.i + 1),
u AS (SELECT conv_id, k, c, max(e) AS e, max(w) AS w FROM r GROUP BY conv_id, k, c),
f AS (SELECT DISTINCT conv_id, whole, words FROM q)
SELECT CAST(u.conv_id AS VARCHAR) AS document_id, 1 AS page_number, CAST(k AS INT) AS chunk_index, c AS start_char, e AS end_char, substr(whole, c + 1, e - c) AS text, CAST(floor(w * CAST(1.33 AS DOUBLE)) AS INT) AS token_count FROM u JOIN f USING (conv_id)""")
def chunk_pack(spark, sf_dir):
    """Pages of several paragraphs: the turns of a conversation, set apart by blank lines."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return C.chunk_pages(turns.select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text")))


@query("SELECT sha256(coalesce(text, '')) AS document_id, doc_id FROM documents")
def content_hash_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(S.content_id(F.coalesce("text", F.lit(""))).alias("document_id"), "doc_id")


@query("SELECT sha256(coalesce(text, '')) AS document_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_documents(spark, sf_dir):
    return content_hash_ids(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


LINES_SQL = r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line_no FROM (SELECT doc_id, i, regexp_replace(x, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> '')"""
NAVIGATION_SQL = r"(regexp_matches({0}, '(?:\.\s*|…\s*){{2,}}[0-9]+\s*$|\.{{2,}}\s*[0-9]+') OR regexp_matches({0}, '(?i)\b(?:page|p\.?)\s*[0-9]+\b'))"
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
HEADER_SQL = f"(lower({{0}}) IN ({_quoted([*L.UNIT_WORDS, *L.GENERIC_METRICS])}) OR starts_with({{0}}, '#') OR regexp_matches(lower({{0}}), '{'|'.join(L.HEADERS).replace('{', '{{').replace('}', '}}')}'))"


@query(LINES_SQL + f""", m AS (SELECT *, {NAVIGATION_SQL.format('line')} OR {HEADER_SQL.format('line')} AS gone, regexp_matches(line, '[.:]$') AS ends FROM l),
s AS (SELECT *, gone OR regexp_matches(line, '^(?:[A-Z0-9\\.\\s]{{4,}}|Table\\s+|Chart\\s+|Appendix\\s+|Note:|\\d+\\.\\s+|[IVXLCDM]+\\.\\d+)') OR coalesce(lag(gone OR ends) OVER (PARTITION BY document_id ORDER BY line_no), true) AS starts, coalesce(lead(gone) OVER (PARTITION BY document_id ORDER BY line_no), false) AND NOT ends AS lost FROM m),
g AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY document_id ORDER BY line_no) AS sentence_no FROM s)
SELECT document_id, CAST(sentence_no AS BIGINT) AS sentence_no, CAST(min(line_no) AS INT) AS first_line, CAST(count(*) AS INT) AS n_lines, string_agg(line, ' ' ORDER BY line_no) AS sentence FROM g WHERE NOT gone GROUP BY ALL HAVING NOT bool_or(lost) AND count(*) > 1 AND len(string_agg(line, ' ' ORDER BY line_no)) > 25""")
def sentence_reflow(spark, sf_dir):
    return C.sentences(C.nonblank_lines(_pages(spark, sf_dir), "document_id"), "document_id")


@query(f"SELECT doc_id, i - 1 AS pos, trim(t) AS token FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{L.NUMBER}', 1) AS w FROM documents))")
def number_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(L.NUMBER), F.lit(1))).alias("pos", "token")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.trim("token").alias("token"))


@query(r"SELECT page_id, regexp_matches(html, '(?:\.\s*|…\s*){2,}[0-9]+\s*$|\.{2,}\s*[0-9]+') OR regexp_matches(html, '(?i)\b(?:page|p\.?)\s*[0-9]+\b') AS navigation FROM pages")
def navigation_lines(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", R.navigation(F.col("html")).alias("navigation"))


@query("SELECT o_orderkey, CAST(1900 + o_orderkey % 200 AS INT) AS base_year, CAST(o_orderkey % 1000 AS INT) AS base_value FROM orders WHERE 1900 + o_orderkey % 200 >= 1000")
def index_base(spark, sf_dir):
    key = F.col("o_orderkey")
    line = F.concat(F.lit("Index of orders ["), (1900 + key % 200).cast("string"), F.lit(" = "), (key % 1000).cast("string"), F.lit("] x"))
    year, value = R.index_base(line)
    return read(spark, sf_dir, "orders").select("o_orderkey", year.alias("base_year"), value.alias("base_value"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS prefixed FROM part")
def section_prefix(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("2."), key, F.lit(" Growth of parts"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("2."), key, F.lit(" percent growth"))).otherwise(F.concat(F.lit("Growth of "), key, F.lit(" parts")))
    return read(spark, sf_dir, "part").select("p_partkey", R.section_prefix(line, F.concat(F.lit("2."), key)).alias("prefixed"))


BLANKS = r"[\t\n\x0B\f\r ]"
BPS_SQL = r"regexp_matches(low, '\b(?:bps?|basis\s+points?)\b')"
OUTLINE_SQL = r"(?:(?:[a-z0-9]+\.)+[a-z0-9]+|[0-9]+[a-z]\.[0-9]+|[ivxlcdm]+(?:\.[0-9]+)+)"
# Fixed patterns in their fixed order: the ladder of number_role in SQL, for a number without a unit: num and its pattern n, the line txt, all of it in small letters
ROLE_RULES_SQL = [
    (r"in_title OR (found <> '' AND NOT is_unit AND ((lead <> '' AND num = lead) OR num = stem))", "PARAGRAPH_IDENTIFIER", 0.99),
    (r"regexp_matches(num, '^[-+]?\d{1,3}$') AND regexp_matches(txt, '^[-+]?\d{1,3}$')", "CHART_AXIS_TICK", 0.99),
    (BPS_SQL + r" AND regexp_matches(low, '\b(?:above|below)\b')", "SPREAD", 0.99),
    (BPS_SQL + r" AND (regexp_matches(low, '\b(?:reduced|decreased|cut|lowered|increased|raised|hiked|change(?:d)?|movement)\s+(?:by\s+)?\b') OR regexp_matches(low, '\bby\s+' || n || '\s*(?:bps?|basis\s+points?)\b'))", "BASIS_POINT_CHANGE", 0.99),
    (r"regexp_matches(low, '\b(?:percentage\s+points?|pp)\b')", "PERCENTAGE_POINT_CHANGE", 0.99),
    (r"regexp_matches(txt, '(?:[A-Za-z]|\))' || n || '(?:\s|$|[,\.;\)])')", "FOOTNOTE_REFERENCE", 0.98),
    (r"regexp_matches(num, '^\d{1,3}$') AND regexp_matches(txt, '^' || n || '\s+[A-Za-z]')", "FOOTNOTE_REFERENCE", 0.98),
    (r"regexp_matches(num, '^\d{1,2}$') AND regexp_matches(txt, '^\(?\d{1,2}[\.\)]\s+[A-Za-z]') AND regexp_matches(txt, '^\(?' || n)", "ROW_IDENTIFIER", 0.98),
    (r"whole = base_year", "INDEX_BASE_YEAR", 0.99),
    (r"whole = base_value", "INDEX_BASE_VALUE", 0.99),
    (r"regexp_matches(num, '^\d{1,2}$') AND regexp_matches(txt, '^(?:\d{1,2}\s+){3,}\d{1,2}$')", "COLUMN_IDENTIFIER", 0.98),
    (NAVIGATION_SQL.format("txt") + r" OR regexp_matches(low, '\b(?:page|p\.?)\s*' || n || '\b')", "PAGE_REFERENCE", 0.95),
    (r"regexp_matches(low, '\b(?:note|footnote)\s*' || n || '\b')", "NOTE_REFERENCE", 0.95),
    (r"regexp_matches(num, '^(?:19|20)\d{2}$') AND regexp_matches(low, '\b(?:fy|fiscal|quarter|q[1-4]|year|ended|as at|march|december|june|september)\b')", "YEAR", 0.95),
    (r"regexp_matches(num, '^(?:19|20)\d{2}$')", "YEAR", 0.90),
    (r"regexp_matches(num, '^\d{2}$') AND regexp_matches(low, '\b(?:fy|fiscal|q[1-4]\s*fy|20)\s*' || n || '\b')", "YEAR", 0.95),
    (rf"regexp_matches(low, '\b(?:{L.MONTHS})\s+' || n || '\b') OR regexp_matches(low, '\b' || n || '\s+(?:months?|days?)\s+ended\b')", "DATE_COMPONENT", 0.95),
    (r"regexp_matches(low, '\b' || n || '\s+(?:equity|preference)?\s*shares?\b')", "SHARE_COUNT", 0.90),
    (r"regexp_matches(low, '(?:₹|\$|inr|usd|rs\.?)\s*(?:\w+\s+){0,2}' || n)", "MONEY", 0.90),
    (r"regexp_matches(low, '\b' || n || '\s*(?:\%|percent|percentage)\b')", "PERCENT", 0.90),
    (r"regexp_matches(low, '\b(?:parcels?|orders?|shipments?|employees?|headcount|workers?|facilities|hubs|vehicles|centres|tonnes|metric tonnes)\b')", "COUNT", 0.90),
]


@query(LINES_SQL + rf""", t AS (SELECT document_id, line_no, line, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(line, '[-+]?[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?') AS w FROM l)),
u AS (SELECT *, line AS txt, lower(' ' || token || '   ' || line) AS low, format('{{:g}}', CAST(replace(token, ',', '') AS DOUBLE)) AS num, lower(line) AS c FROM t),
v AS (SELECT *, replace(replace(num, '.', '\.'), '+', '\+') AS n, regexp_extract(c, '^\s*(?:appendix\s+table|table|chart|figure|box)\s+([a-z0-9\.\-]+)', 1) AS title, regexp_extract(c, '^\s*\(?({OUTLINE_SQL})\)?\s+([a-z%])', 1) AS found,
  trim(regexp_replace(c, '^\s*\(?{OUTLINE_SQL}', '')) AS rest, TRY_CAST(nullif(regexp_extract(num, '^[-+]?(\d+)(?:\.\d+)?$', 1), '') AS BIGINT) AS whole, TRY_CAST(nullif(regexp_extract(txt, '{{0}}', 1), '') AS BIGINT) AS base_year, TRY_CAST(nullif(regexp_extract(txt, '{{0}}', 2), '') AS BIGINT) AS base_value FROM u),
x AS (SELECT *, trim(regexp_replace(found, '^[a-z.]+', '')) AS stem, regexp_extract(trim(regexp_replace(found, '^[a-z.]+', '')), '^\d+') AS lead, title <> '' AND (num = title OR list_contains(string_split(title, '.'), num)) AS in_title, regexp_matches(rest, '^(?:per cent|percent|%|bps|basis\s+points|crore|million|billion|lakh|shares)') AS is_unit FROM v)
SELECT document_id, CAST(line_no AS INT) AS line_no, CAST(pos AS INT) AS pos, token, CASE """.replace("{0}", r"(?i)(?:[\[\(]|\b)(?:FY\s*)?(\d{4})(?:-\d{2,4})?\s*=\s*(\d+)(?:[\]\)]|\b)")
    + " ".join(f"WHEN {rule} THEN '{role}'" for rule, role, _ in ROLE_RULES_SQL) + " ELSE 'METRIC_VALUE' END AS role, CAST(CASE " + " ".join(f"WHEN {rule} THEN {confidence}" for rule, _, confidence in ROLE_RULES_SQL) + " ELSE 0.7 END AS DOUBLE) AS confidence FROM x")
def number_roles(spark, sf_dir):
    """Roles of all numbers of the fixture's texts, by line."""
    lines = C.nonblank_lines(_pages(spark, sf_dir), "document_id")
    tokens = lines.select("document_id", "line_no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(r"[-+]?\d+(?:,\d+)*(?:\.\d+)?"), F.lit(0))).alias("pos", "token"))
    return tokens.withColumn("r", R.number_role(T.short(N.parse_numeric(F.col("token"))), F.col("token"), F.lit(""), F.col("line"))).select("document_id", "line_no", "pos", "token", "r.role", "r.confidence")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'headline_cpi_inflation' WHEN 1 THEN 'total_sale' WHEN 2 THEN 'profit_after_tax_' || p_partkey WHEN 3 THEN 'unspecified_metric' END AS canonical FROM part")
def canonical_metric(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, " Consumer Price Index").when(k % 4 == 1, "The total number of sales").when(k % 4 == 2, F.concat(F.lit("PAT ("), k.cast("string"), F.lit(")"))).otherwise("the data of our company")
    return read(spark, sf_dir, "part").select("p_partkey", R.canonical_metric(name).alias("canonical"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -p_retailprice ELSE p_retailprice END AS number FROM part")
def parse_numeric(spark, sf_dir):
    price = F.format_number("p_retailprice", 2)
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("₹("), F.regexp_replace(price, "^", ""), F.lit(")"))).otherwise(F.concat(F.lit("Rs "), price))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), price, F.lit(")"))).otherwise(text)
    return read(spark, sf_dir, "part").select("p_partkey", N.parse_numeric(text).alias("number"))


def _normalized(spark, sf_dir, value, unit, quote, metric):
    """Parts with n, the normal form of a value that is made of each: worked out once, however many of its fields are read."""
    made = T.fence(spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")), value=value, unit=unit, quote=quote)
    return T.fence(made, n=N.normalized(F.col("value"), F.col("unit"), F.col("quote"), metric))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN round(p_size * 1e7, 4) WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE round(p_size * 1e6, 4) END::DOUBLE AS normalized_value,
CASE p_partkey % 4 WHEN 0 THEN 'INR' WHEN 1 THEN '%' WHEN 2 THEN 'shares' ELSE 'USD' END AS normalized_unit, CASE p_partkey % 4 WHEN 0 THEN 'MONEY' WHEN 1 THEN 'PERCENT' WHEN 2 THEN 'SHARE_COUNT' ELSE 'MONEY' END AS value_type FROM part""")
def normalize_values(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    unit = F.when(k == 0, "crore").when(k == 1, "%").when(k == 2, "Equity Shares").otherwise("USD million")
    return _normalized(spark, sf_dir, size, unit, F.lit(""), F.lit("revenue")).select("p_partkey", "n.normalized_value", "n.normalized_unit", "n.value_type")


_MAGNITUDES_SQL = "(VALUES " + ", ".join(f"({i}, '{m}', CAST({f} AS DOUBLE))" for i, (m, f) in enumerate(L.MAGNITUDES)) + ") m(i, word, factor)"


@query(f"""SELECT p_partkey, v AS normalized_value, 'INR' AS normalized_unit, factor AS scale, 'INR' AS currency, p_size || ' ' || unit || ' is ' || format('{{:g}}', v) || ' INR (times ' || format('{{:g}}', factor) || ')' AS explanation
FROM (SELECT *, round(p_size * factor, 4) AS v, CASE WHEN p_partkey % 2 = 0 THEN 'INR ' || word ELSE 'INR' END AS unit FROM part JOIN {_MAGNITUDES_SQL} ON i = p_partkey % {len(L.MAGNITUDES)})""")
def normalize_magnitudes(spark, sf_dir):
    """All magnitudes, in the unit or only near the value in the quote."""
    words = F.element_at(F.array(*[F.lit(m) for m, _ in L.MAGNITUDES]), (F.col("p_partkey") % len(L.MAGNITUDES) + 1).cast("int"))
    even, size = F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")
    unit, quote = F.when(even, F.concat(F.lit("INR "), words)).otherwise("INR"), F.when(even, "").otherwise(F.concat(F.lit("it sold for "), size, F.lit(" or so "), words))
    return _normalized(spark, sf_dir, size, unit, quote, F.lit("sales")).select("p_partkey", "n.normalized_value", "n.normalized_unit", "n.scale", "n.currency", "n.explanation")


@query("SELECT p_partkey, ([" + _quoted(L.METRIC_ALIASES.values()) + f"])[CAST(p_partkey % {len(L.METRIC_ALIASES)} AS INT) + 1] AS canonical FROM part")
def metric_aliases(spark, sf_dir):
    """All names that are known for a metric, in other letters and with blanks around them."""
    name = F.element_at(F.array(*[F.lit(f" {a.title()} ") for a in L.METRIC_ALIASES]), (F.col("p_partkey") % len(L.METRIC_ALIASES) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", R.canonical_metric(name).alias("canonical"))


@query("SELECT o_orderkey, 'FY ' || year(o_orderdate) AS period, CASE WHEN o_orderkey % 3 = 0 THEN 'APR_DEC' WHEN o_orderkey % 3 = 1 THEN 'FULL_YEAR' END AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'FIRST_ADVANCE_ESTIMATE' ELSE 'SECOND_ADVANCE_ESTIMATE' END AS vintage FROM orders")
def period_scope_vintage(spark, sf_dir):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    said = F.when(k % 2 == 0, F.concat(F.lit("Fiscal "), y)).otherwise(F.concat(F.lit("fy"), y))
    about = F.when(k % 3 == 0, "in April to December").when(k % 3 == 1, "annual report").otherwise("so far")
    estimate = F.when(k % 2 == 0, "by the First Advance Estimates").otherwise("by the second advance estimate")
    return read(spark, sf_dir, "orders").select("o_orderkey", N.period(said).alias("period"), N.period_scope(about).alias("scope"), N.vintage(estimate).alias("vintage"))


@query(r"""WITH b AS (SELECT item_id, 'plain' AS variant, text AS q FROM benchmark UNION ALL SELECT item_id, 'upper', translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM benchmark UNION ALL SELECT item_id, 'spaced', replace(text, ' ', '   ') FROM benchmark),
c AS (SELECT *, regexp_replace(lower(trim(q)), '[\t\n\x0B\f\r ]+', ' ', 'g') AS flat FROM b), d AS (SELECT *, regexp_replace(lower(text), '[\t\n\x0B\f\r ]+', ' ', 'g') AS flat FROM documents)
SELECT doc_id, item_id, variant, CAST(CASE WHEN contains(d.text, q) THEN 1.0 WHEN contains(lower(d.text), lower(trim(q))) THEN 0.85 ELSE 0.7 END AS DOUBLE) AS grounding FROM d JOIN c ON contains(d.flat, c.flat)""")
def grounding_score(spark, sf_dir):
    """Benchmark passages in documents, as they are, in capitals (a-z alone: engines differ on others), and with other white space."""
    b = read(spark, sf_dir, "benchmark")
    variants = [b.select("item_id", F.lit(name).alias("variant"), q.alias("quote")) for name, q in (("plain", F.col("text")), ("upper", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), ("spaced", F.replace("text", F.lit(" "), F.lit("   "))))]
    return X.grounded(read(spark, sf_dir, "documents"), variants[0].unionByName(variants[1]).unionByName(variants[2])).select("doc_id", "item_id", "variant", "grounding")


@query("SELECT p_partkey, p_partkey % 4 < 2 AS header FROM part")
def header_label(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, " (₹ in million) ").when(k % 4 == 1, "Statement of parts").when(k % 4 == 2, F.concat(F.lit("Parts "), k.cast("string"))).otherwise("Revenue 5 million")
    return read(spark, sf_dir, "part").select("p_partkey", V.header_label(text).alias("header"))


def _candidates(spark, sf_dir):
    """Candidates of thirteen kinds: one breaks no rule of the validator (2), each of the others another rule."""
    k, kinds = F.col("p_partkey"), 13
    size = (F.col("p_size") + 100).cast("string")
    said = lambda before, after="": F.concat(F.lit(before), size, F.lit(after))
    rows = [  # quote, metric, unit, value, number
        ("Contents .... 12", "Revenue", ""), ("abc", "Revenue", ""), (said("Revenue was INR ", " million"), "Revenue", "INR million"), ("inflation was seven of", "Core Inflation", ""), (said("Revenue of "), "Revenue", ""),
        (said("Sales: ₹"), "Total", "INR"), (said("Volume was INR ", " crore"), "Volume", "INR crore"), ("see the notes", "Policy", ""), (said("as Note ", " says of the books"), "Revenue", "INR million"),
        (said("", ".10 Growth of output"), "Growth", ""), (said("The rate was cut by ", " bps today"), "Policy Repo Rate", "bps"), (said("Sales came to ₹", " then"), "", "INR"), (said("Volume was INR ", " crore"), "Volume", "INR crore"),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) if isinstance(r[i], str) else r[i] for r in rows]), (k % kinds + 1).cast("int"))
    value = F.when(k % kinds == 7, "n/a").when(k % kinds == 9, said("", ".10")).otherwise(size)
    number = F.when(k % kinds == 9, F.col("p_size") + 100.1).when(k % kinds != 7, (F.col("p_size") + 100).cast("double"))
    made = T.fence(
        spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")), value=value, metric=pick(1), unit=pick(2), quote=pick(0), numeric_value=number,
        value_binding_confidence=F.when(k % kinds == 6, 0.5).otherwise(0.9), extraction_confidence=F.when(k % kinds == 12, 0.3).otherwise(0.9),
    )
    c = V.with_failures(made, F.col("quote"))
    return c.select(k.alias("reject_id"), F.col("value").alias("candidate_text"), "failure_type", V.reason(F.col("failure_type"), F.col("value"), F.col("metric"), F.col("unit")).alias("rejection_reason"))


FAILURES = "CASE p_partkey % 13 WHEN 0 THEN 'NAVIGATION_REFERENCE' WHEN 1 THEN 'INSUFFICIENT_CONTEXT' WHEN 3 THEN 'MISSING_PERCENT_UNIT' WHEN 4 THEN 'MISSING_CURRENCY_UNIT' WHEN 5 THEN 'TABLE_HEADER_WITHOUT_VALUE' WHEN 6 THEN 'LOW_BINDING_CONFIDENCE' WHEN 7 THEN 'INSUFFICIENT_CONTEXT' WHEN 8 THEN 'INVALID_NUMBER_ROLE' WHEN 9 THEN 'SECTION_IDENTIFIER_AS_VALUE' WHEN 10 THEN 'DELTA_SPREAD_AS_LEVEL' WHEN 11 THEN 'VALUE_WITHOUT_METRIC' WHEN 12 THEN 'LOW_CONFIDENCE' END"


@query(f"SELECT reject_id, count(*) FILTER (failure_type IS NOT NULL) OVER (PARTITION BY failure_type) > 0 AS has_reason FROM (SELECT p_partkey AS reject_id, {FAILURES} AS failure_type FROM part)")
def rejection_reasons(spark, sf_dir):
    """Every rejected candidate, and no other, has a reason."""
    return _candidates(spark, sf_dir).select("reject_id", (F.col("rejection_reason").isNotNull() & ~F.contains("rejection_reason", F.lit("{"))).alias("has_reason"))


@query(f"SELECT p_partkey AS reject_id, {FAILURES} AS failure_type FROM part")
def validate_verdict(spark, sf_dir):
    return _candidates(spark, sf_dir).select("reject_id", "failure_type")


@query("SELECT b.bucket, count(x.p_partkey) AS n FROM (SELECT unnest(['TABLE_HEADERS', 'BARE_UNITS', 'VALUES_WITHOUT_METRIC', 'NAVIGATION_REFERENCES', 'INVALID_NUMBER_ROLE', 'LOW_BINDING_CONFIDENCE', 'AMBIGUOUS_CLAIMS']) AS bucket) b LEFT JOIN (SELECT p_partkey, CASE p_partkey % 13 WHEN 6 THEN 'LOW_BINDING_CONFIDENCE' WHEN 8 THEN 'INVALID_NUMBER_ROLE' ELSE 'AMBIGUOUS_CLAIMS' END AS bucket FROM part WHERE p_partkey % 13 <> 2) x ON x.bucket = b.bucket GROUP BY b.bucket")
def ledger_groups(spark, sf_dir):
    return K.ledger_groups(spark, _candidates(spark, sf_dir).where("failure_type is not null"))


@query(f"SELECT p_partkey AS reject_id, {FAILURES} AS failure_type FROM part WHERE p_partkey % 13 IN (5, 9) ORDER BY p_partkey LIMIT 1")
def failure_case(spark, sf_dir):
    return K.failure_case(_candidates(spark, sf_dir).where("failure_type is not null")).select("reject_id", "failure_type")


@query(f"SELECT reject_id, failure_type, k AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY failure_type ORDER BY reject_id) AS INT) AS k FROM (SELECT p_partkey AS reject_id, {FAILURES} AS failure_type FROM part) WHERE failure_type IS NOT NULL) WHERE k <= 50")
def reject_preview(spark, sf_dir):
    return K.preview(_candidates(spark, sf_dir).where("failure_type is not null")).select("reject_id", "failure_type", "place")


@query("SELECT p_type AS metric, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, metric LIMIT 20")
def metric_frequency(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("metric")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "metric").limit(20)


@query(FACTS_SQL + "SELECT round(count(*) FILTER (unit IS NULL) / CAST(count(*) AS DOUBLE), 6) AS bare_share FROM f")
def quality_ratio(spark, sf_dir):
    return order_facts(spark, sf_dir).agg(F.round(F.count_if(F.col("unit").isNull()) / F.count("*"), 6).alias("bare_share"))


def _report(spark, sf_dir):
    """A page of prose and a series table for each fiscal year's orders."""
    y = F.year("o_orderdate")
    sums = read(spark, sf_dir, "orders").groupBy(y.alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"))
    lines = F.concat(
        F.lit("Summary of the year\nExpress parcel shipment volume (million)\nFY"), F.col("y").cast("string"), F.lit(" FY"), (F.col("y") + 1).cast("string"), F.lit("\n"), (F.col("n") + 3000).cast("string"), F.lit(" "), (F.col("u") + 3000).cast("string"),
        F.lit("\nContents ...... 12\n(₹ in million)\nCPI [2001=100]\nNet profit was ₹"), F.col("n").cast("string"), F.lit(" million in FY"), F.col("y").cast("string"), F.lit(" against a plan.\n"),
    )
    return sums.select(F.col("y").cast("string").alias("document_id"), F.lit("delhivery-fy24.pdf").alias("filename"), F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), lines.alias("text"))


YEARS_SQL = "WITH s AS (SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (starts_with(o_orderpriority, '1')) AS u FROM orders GROUP BY ALL) "


@query(YEARS_SQL + "SELECT CAST(y AS VARCHAR) AS document_id, 'FY ' || y AS period, CAST(n + 3000 AS VARCHAR) AS value, 'million parcels' AS unit FROM s UNION ALL SELECT CAST(y AS VARCHAR), 'FY ' || (y + 1), CAST(u + 3000 AS VARCHAR), 'million parcels' FROM s")
def series_align(spark, sf_dir):
    return X.series_candidates(C.nonblank_lines(_report(spark, sf_dir), *X.KEYS), *X.KEYS).select("document_id", "period", "value", "unit")


@query(YEARS_SQL + """SELECT CAST(y AS VARCHAR) AS document_id, m AS metric, v AS value, u AS unit, p AS period, CAST(x AS DOUBLE) AS normalized_value, nu AS normalized_unit, t AS value_type, b AS binding_method, round(CAST(e AS DOUBLE) * CAST(c AS DOUBLE), 3) AS final_confidence FROM (
  SELECT y, 'Net Profit' AS m, '₹' || n || ' million' AS v, '₹' AS u, 'FY ' || y AS p, n * 1000000 AS x, 'INR' AS nu, 'MONEY' AS t, 'sentence_direct' AS b, 0.85 AS e, 0.85 AS c FROM s
  UNION ALL SELECT y, 'Express Parcel Shipment Volume', CAST(n + 3000 AS VARCHAR), 'million parcels', 'FY ' || y, n + 3000, 'million_parcels', 'COUNT', 'table_series_alignment', 0.92, 0.98 FROM s
  UNION ALL SELECT y, 'Express Parcel Shipment Volume', CAST(u + 3000 AS VARCHAR), 'million parcels', 'FY ' || (y + 1), u + 3000, 'million_parcels', 'COUNT', 'table_series_alignment', 0.92, 0.98 FROM s)""")
def extract_facts(spark, sf_dir):
    facts, _ = X.extract_facts(_report(spark, sf_dir))
    return facts.select("document_id", "metric", "value", "unit", "period", "normalized_value", "normalized_unit", "value_type", "binding_method", "final_confidence")


@query(YEARS_SQL + "SELECT CAST(y AS VARCHAR) AS document_id, unnest(['NAVIGATION_REFERENCE', 'TABLE_HEADER_WITHOUT_VALUE', 'STRUCTURAL_INDEX_METADATA']) AS failure_type FROM s")
def line_routing(spark, sf_dir):
    return C.nonblank_lines(_report(spark, sf_dir), *X.KEYS).select("document_id", C.route(F.col("line")).alias("failure_type")).where("failure_type is not null")


@query(LADDER_SQL)
def line_ladders(spark, sf_dir):
    """What the extractor makes of many lines: phrases, forms of numbers and contexts that hit or miss each of its rules."""
    rows = X.line_candidates(made_lines(spark, sf_dir), "k")
    return rows.select("k", "rank", "number", "entity", "metric", "value", "unit", "period", F.col("period_scope").alias("scope"), "predicate")


PHRASES = ["Revenue from Operations", "express parcel orders", "Express Parcel Revenue", "EBITDA margin", "EBITDA", "net profit", "Profit after Tax", "women employees", "headcount", "employee attrition", "real GDP growth", "headline inflation", "policy repo rate", "share capital", "offer of", "total income", "operating income", "cash flow", "net debt", "litigation"]


@query("SELECT p_partkey, CAST(rank AS INT) AS rank, metric, role FROM (SELECT p_partkey, lower(p_name || ' ' || [" + _quoted(PHRASES) + f"][CAST(p_partkey % {len(PHRASES)} AS INT) + 1]) AS line FROM part) JOIN (VALUES " + ", ".join(f"({i}, '{p}', '{m}', '{r}')" for i, (p, m, r) in enumerate(L.METRICS)) + ") m(rank, pattern, metric, role) ON regexp_matches(line, pattern)")
def metric_dictionary_join(spark, sf_dir):
    """The dictionary's entries that a line matches, as tests in one pass instead of a join of lines and patterns."""
    line = F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("p_partkey") % len(PHRASES)).cast("int") + 1))
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(X.metric_rows(F.lower(line))))


@query(FACTS_SQL + "SELECT entity, period, v AS normalized_value, min(pos) AS first FROM f WHERE v IS NOT NULL GROUP BY entity, period, v, scope, vintage")
def candidate_dedup(spark, sf_dir):
    f = order_facts(spark, sf_dir).where("normalized_value is not null").withColumn("ordinal", F.col("pos")).withColumn("stage", F.lit(0)).withColumn("rank", F.lit(0)).withColumn("number", F.lit(0))
    return X.first_candidates(f, "entity").select("entity", "period", "normalized_value", F.col("pos").alias("first"))


def _said(text: str, filename: str, page: int) -> str:
    """Stands for a model in the queries below: it repeats the page's sentence on profit, and fails for even years."""
    import json
    import re

    found = re.search(r"Net profit was ₹(\d+) million in (FY\d{4})", text)
    if int(found[2][2:]) % 2 == 0:
        raise TimeoutError("no answer")
    return json.dumps({"facts": [{"entity": "Shop", "metric": "Net Profit", "value": found[1], "unit": "INR million", "time_scope": found[2], "raw_quote": found[0], "extraction_confidence": 0.8}, {"metric": "Net Profit", "value": "1", "unit": "INR", "raw_quote": "abc"}]})


@query(YEARS_SQL + "SELECT CAST(y AS VARCHAR) AS document_id, 'Shop' AS entity, CAST(n AS VARCHAR) AS value, 'FY ' || y AS period, CAST(n * 1000000 AS DOUBLE) AS normalized_value, 'INR' AS normalized_unit, round(CAST(0.8 AS DOUBLE) * CAST(0.9 AS DOUBLE), 3) AS final_confidence, 'llm' AS extraction_method FROM s WHERE y % 2 = 1")
def model_facts(spark, sf_dir):
    """What a model says is mapped, normalised and checked like what the rules find."""
    facts, _ = A.said_facts(A.ask(_report(spark, sf_dir), _said, f"{S.scratch(spark)}/answers"))
    return facts.select("document_id", "entity", "value", "period", "normalized_value", "normalized_unit", "final_confidence", "extraction_method")


@query(YEARS_SQL + "SELECT CAST(y AS VARCHAR) AS document_id, CASE WHEN y % 2 = 0 THEN 'degraded' ELSE 'normal' END AS mode, CASE WHEN y % 2 = 0 THEN 'model failed: no answer' ELSE '' END AS warnings FROM s")
def model_modes(spark, sf_dir):
    modes = A.run_modes(A.ask(_report(spark, sf_dir), _said, f"{S.scratch(spark)}/answers"))
    return modes.select("document_id", "mode", F.array_join("warnings", "; ").alias("warnings"))


def _opinion(question: str) -> str:
    """Stands for a model that judges pairs: it fails on every third."""
    import json

    a = json.loads(question)["a"]["pos"]
    if a % 3 == 0:
        raise TimeoutError("no answer")
    return json.dumps({"taxonomy_category": "contextual_difference", "confidence_delta": 0.9})


@query(FACTS_SQL + """, x AS (SELECT taxonomy, relationship, confidence, pos_a, doc_a = 'restated' AS ra, doc_b = 'restated' AS rb, delta, contains(ua, 'crore') <> contains(ub, 'crore') AS scaled FROM j),
y AS (SELECT CASE WHEN NOT ra AND NOT rb THEN taxonomy WHEN ra <> rb THEN CASE WHEN delta < 0.1 AND scaled THEN 'RECONCILED_UNIT' WHEN pos_a % 3 = 0 THEN 'UNRELATED' ELSE 'CONTEXTUAL_DIFFERENCE' END WHEN delta < 0.1 THEN 'CORROBORATES' WHEN delta < 1.5 THEN 'RECONCILED_ROUNDING' WHEN pos_a % 3 = 0 THEN 'UNRELATED' ELSE 'CONTEXTUAL_DIFFERENCE' END AS taxonomy FROM x)
SELECT taxonomy, count(*) AS n FROM y GROUP BY taxonomy""")
def model_judged(spark, sf_dir):
    """A model is asked about what the rules leave open (the facts of one report have no period here); where it fails, pairs stay as they are."""
    facts = order_facts(spark, sf_dir).withColumn("period", F.when(F.col("document_id") != "restated", F.col("period")))
    judge = A.judge_with_model(_opinion, f"{S.scratch(spark)}/opinions")
    return judge(P.ready_pairs(settle(P.ready_facts(facts)))).groupBy("taxonomy").agg(F.count("*").alias("n"))


@query(REPORTS_SQL + "SELECT 'stored' AS state, 'chunks' AS name, count(*) AS n FROM s UNION ALL SELECT 'stored', 'documents', count(DISTINCT doc) FROM s UNION ALL SELECT 'stored', 'facts', count(*) FROM f UNION ALL SELECT 'cleared', unnest(['chunks', 'documents', 'facts']), 0")
def cleared_store(spark, sf_dir):
    """Rows of the tables before and after all are removed."""
    root, kept = S.scratch(spark), _landed(spark, sf_dir)
    tables = ("chunks", "documents", "facts")
    S.commit(spark, root, {t: S.read(spark, kept, t) for t in tables})
    count = lambda state: [S.rows_of(spark, root, t).agg(F.lit(state).alias("state"), F.lit(t).alias("name"), F.count("*").alias("n")) for t in tables]
    before = [settle(x) for x in count("stored")]
    S.clear(spark, root)
    rows = [*before, *count("cleared")]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
