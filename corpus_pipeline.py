"""The corpus pipeline: each stage reads all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.llm.common import settle, without
from quillfact.llm.decontaminate import contamination
from quillfact.llm.line_dedup import line_dedup
from quillfact.llm.ngram_join import ngram_components
from quillfact.llm.packing import pack
from quillfact.llm.quality import quality_scores


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Defined results: a row without doc_id stays; rows that repeat a doc_id go together, if any of them is rejected; a null
    text is scored as an empty one; without labels of both kinds none go unless all labels are 0; other columns pass."""
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, settle(scores.where("predicted = 0 and doc_id is not null").select("doc_id").distinct()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text of rows that lose some.

    Defined results: a null text stays null; a row without doc_id loses nothing; columns __n_lines and __n_removed, if
    there are such, hold the operator's counts."""
    out = line_dedup(docs)
    return out.select(*[F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Defined results: empty texts are no duplicates of each other; rows that repeat a doc_id stay or go together; a row
    without doc_id stays."""
    groups = ngram_components(docs)
    return without(docs, settle(groups.where("doc_id <> component_id").select("doc_id").distinct()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go.

    Defined results: a text without words stays, and so does a row without doc_id; rows that repeat a doc_id go together,
    if any of them has a window; without items all stay."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, settle(found.where("contaminated and doc_id is not null").select("doc_id").distinct()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences; see pack for its defined results."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("packing", packing)]
#: The classifier and the packing have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
