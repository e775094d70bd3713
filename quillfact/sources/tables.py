"""The five tables of the store: columns and their types, what stands for absent ones, running numbers of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillfact.functions.lexicon import PIPELINE_VERSION
from quillfact.functions.text import either

SCHEMAS = {
    "documents": "document_id string, filename string, file_hash string, upload_timestamp timestamp, page_count int, chunk_count int",
    "chunks": "chunk_id long, document_id string, filename string, page_number int, chunk_index int, text string, start_char int, end_char int, token_count int",
    "facts": """fact_id long, document_id string, chunk_id long, chunk_index int, subject string, entity string, subject_entity string, source_organization string, metric string, predicate string, value string, numeric_value double,
        unit string, normalized_value double, normalized_unit string, period string, period_scope string, estimate_vintage string, index_base_year int, index_base_value int, as_of_date string, scope string, qualifiers string,
        raw_quote string, page int, extraction_confidence double, grounding_confidence double, value_binding_confidence double, final_confidence double, value_type string, is_numeric boolean, value_source_span string,
        metric_source_span string, temporal_source_span string, extraction_method string, binding_method string, pipeline_version int, validation_status string, validation_notes string""",
    "rejected_extractions": "rejected_id long, document_id string, page int, candidate_text string, attempted_extraction string, failure_type string, rejection_reason string, created_at timestamp",
    "fact_relationships": "relationship_id long, fact_id_a long, fact_id_b long, relationship_type string, taxonomy_category string, reasoning string, confidence double, confidence_delta double, comparison_delta double, can_compute_delta boolean, reconciliation_type string, match_checklist string, pipeline_version int",
}
#: What stands for absent or null values.
DEFAULTS = {
    "facts": {
        "subject": "Unknown Entity", "entity": "Unknown Entity", "metric": "General Assertion", "predicate": "was reported as", "extraction_confidence": 1.0, "grounding_confidence": 1.0, "value_binding_confidence": 1.0,
        "final_confidence": 1.0, "value_type": "UNKNOWN", "is_numeric": True, "extraction_method": "llm", "validation_status": "valid", "binding_method": "sentence_direct", "pipeline_version": PIPELINE_VERSION,
    },
    "fact_relationships": {"taxonomy_category": "UNCERTAIN", "confidence": 1.0, "confidence_delta": 0.0, "comparison_delta": 0.0, "can_compute_delta": False, "reconciliation_type": "NONE", "pipeline_version": PIPELINE_VERSION},
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def typed(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in their order and types: narrower types are widened, absent columns and null values take the
    table's defaults. A column that cannot hold the table's type is an error, and so is a value that does not fit."""
    have, defaults = {f.name: f.dataType for f in df.schema.fields}, DEFAULTS.get(table, {})
    out = []
    for f in schema_of(table).fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in have and have[f.name].typeName() in ("struct", "array", "map", "binary") and have[f.name] != f.dataType:
            raise TypeError(f"{table}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
        out.append((F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*out)


#: Groups of the keys by which rows are numbered; only counts of groups pass through one task.
GROUPS = 4096


def numbered(rows: DataFrame, name: str, by: list[str], order: list, start: int = 1) -> DataFrame:
    """rows with running numbers from start, without gaps: by the hash group of the columns by, within it by these, within
    equal ones by order. Rows are counted by key, counts summed up over GROUPS groups and inside each, so that no task sees
    more than the rows of one key, the keys of one group, or GROUPS numbers. Where order leaves no ties, equal rows get equal numbers at each
    run, in whatever order they come."""
    group = F.pmod(F.xxhash64(*by), F.lit(GROUPS)).alias("__group")
    counts = rows.groupBy(group, *by).agg(F.count("*").alias("__n"))
    sofar = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.select("*", sofar(Window.partitionBy("__group").orderBy(*by)).alias("__inside"))
    groups = counts.groupBy("__group").agg(F.sum("__n").alias("__n"))
    groups = groups.select("__group", sofar(Window.orderBy("__group")).alias("__first"))  # GROUPS rows at most
    starts = inside.join(groups, "__group").select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(by)], (F.col("__first") + F.col("__inside")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(by)]
    joined = rows.withColumn("__place", place).join(starts, same)
    return joined.select((F.col("__before") + F.col("__place") + F.lit(start - 1)).cast("long").alias(name), *rows.columns)


#: Columns by which facts and rejects of a document follow each other.
FACT_ORDER = ["page_number", "chunk_index", "stage", "ordinal", "rank", "number"]


def fact_rows(valid: DataFrame, chunks: DataFrame, start: int = 1) -> DataFrame:
    """Valid candidates of chunks(chunk_id, document_id, chunk_index) as rows of facts, numbered in the order in which they
    were found; those whose chunk is gone are left out."""
    absent = {c: F.lit(None).cast("string") for c in ("predicate", "scope", "subject") if c not in valid.columns}
    ready = valid.withColumns(absent).join(chunks.select("document_id", "chunk_index", "chunk_id"), ["document_id", "chunk_index"])
    order = [c for c in FACT_ORDER if c in ready.columns]
    ready = numbered(ready, "fact_id", ["document_id"], order, start)
    subject = either(F.col("subject"), either(F.col("subject_entity") if "subject_entity" in ready.columns else F.col("entity"), F.col("entity")))
    ready = ready.withColumn("subject", subject).withColumn("entity", either(F.col("entity"), F.col("subject"))).withColumn("page", F.col("page_number"))
    return typed(ready.withColumn("pipeline_version", F.lit(PIPELINE_VERSION)), "facts")


def rejected_rows(rejected: DataFrame, start: int = 1) -> DataFrame:
    """Rejected candidates and lines as rows of the ledger, numbered by document."""
    order = [F.col(c) for c in ("page_number", "chunk_index", "stage", "ordinal", "rank", "number") if c in rejected.columns]
    ready = numbered(rejected, "rejected_id", ["document_id"], [*order, "failure_type", "candidate_text", "rejection_reason"], start)
    return typed(ready.withColumn("page", F.col("page_number")).withColumn("created_at", F.current_timestamp()), "rejected_extractions")
