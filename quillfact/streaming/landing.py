"""Landing folder of page texts as a stream: documents, chunks, facts and rejects, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.operators.chunks import chunk_pages
from quillfact.operators.extract import accepted, checked_candidates, refused
from quillfact.sources import store as S
from quillfact.sources import tables as T
from quillfact.sources.scratch import settle

PAGES = "document_id string, filename string, page_number int, text string"


def land(pages: DataFrame, root: str, batch: tuple[str, int] | None = None) -> None:
    """Store what the pages of documents hold, in one commit. A repeated document replaces all that was stored of it, its
    relationships go (they are found again by the next analysis); a batch that is in the store already changes nothing, and one
    that runs again after a failure gives the same numbers."""
    spark = pages.sparkSession
    if batch and S.last_batch(spark, root, batch[0]) >= batch[1]:
        return
    pages = settle(pages)
    ids = pages.select("document_id").distinct()
    cut = chunk_pages(pages).join(pages.groupBy("document_id").agg(F.min("filename").alias("filename")), "document_id")
    chunks = settle(T.typed(T.numbered(cut, "chunk_id", ["document_id"], ["chunk_index"], S.next_number(spark, root, "chunks")), "chunks"))
    found = settle(checked_candidates(chunks))
    facts = settle(T.fact_rows(accepted(found), chunks, S.next_number(spark, root, "facts")))
    rejected = settle(T.rejected_rows(refused(found, chunks), S.next_number(spark, root, "rejected_extractions")))
    documents = S.documents_of(pages, chunks).withColumn("file_hash", F.col("document_id")).withColumn("upload_timestamp", F.current_timestamp())
    rows = {"documents": T.typed(documents, "documents"), "chunks": chunks, "facts": facts, "rejected_extractions": rejected}
    numbers = {name: rows[name].count() for name in ("chunks", "facts", "rejected_extractions")}
    S.change(spark, root, replaced={name: (df, ids) for name, df in rows.items()}, whole=S.relationships_without(spark, root, ids), batch=batch, numbers=numbers)


def watch(spark: SparkSession, landing: str, root: str, checkpoint: str, name: str = "landing"):
    """Start the stream; all pages of a document come in one batch. The store knows the stream by its name."""
    store = lambda pages, batch: land(pages, root, (name, batch))
    return spark.readStream.schema(PAGES).parquet(landing).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
