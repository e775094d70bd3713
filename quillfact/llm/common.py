"""Shared pieces: tables in the shared folder, size-checked joins, components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.sources.scratch import release, settle, shared_dir  # noqa: F401

#: Rows of a single-column id table that may be broadcast (about 64 MB in executors); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes in one Arrow batch: whole texts are long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1000, "4m"


def free_name(name: str, taken: list[str]) -> str:
    """name, lengthened until no column (upper and lower case are equal) has it."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def arrow_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of text columns by rows and bytes, so that a Python worker holds a few MB at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow and settled) with a broadcast hint if its counted rows are within the limit, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def tidy(spark: SparkSession) -> None:
    """Let the driver collect what finished queries left (plans, broadcasts) and give freed memory back, so that the steps of a
    long session do not add up."""
    spark.sparkContext._jvm.System.gc()
    B.release()


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the doc_ids of ids (one column doc_id, settled); a row whose doc_id is null stays."""
    return docs.join(sized(ids), "doc_id", "left_anti").select(docs.columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a long, b long) -> (id, component), component the smallest id.

    Alternating large-star and small-star steps, each a grouped minimum with map-side combining and an
    equi-join; edges stay in tables, never on the driver. Ids without a link are not in the result.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = settle(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
