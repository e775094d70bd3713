"""Exact deduplication through sharded cuckoo-filter indexes.

Every text gives the SHA-256 of its normalised bytes (A-Z lower-cased) and its length. A cuckoo index keeps one
live row for each text: a miss in the filter proves that a text is new; a hit is verified against the stored
keys of its bucket (digest and length); a row that supersedes the live one deletes that entry and is inserted; a
failed insertion doubles the filter from the stored keys. Indexes run twice: over each input partition (so that a
text which fills a third of the table sends one row a partition), then over shards by digest.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays (a null doc_id
is the smallest; of wholly repeated rows just one stays); an empty table gives an empty result; other columns are
not read; a very long text is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm.common import arrow_batches, settle

SLOTS, KICKS, LEAST = 4, 200, -(2**63)
#: Keys after which a map-side index hands on its rows and starts afresh, and keys of a shard on average; both bound a
#: task's memory, to about 60 MB.
MAP_KEYS, SHARD_KEYS = 200_000, 100_000


class CuckooIndex:
    """Filter of 16-bit fingerprints in buckets of four, beside the stored records [key, length, live, count]."""

    def __init__(self, buckets: int = 64):
        self.keys = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.filter: list[list[int]] = [[] for _ in range(buckets)]
        self.store: list[list[list]] = [[] for _ in range(buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, key: bytes, length: int) -> list | None:
        mark, one, two = self._places(key)
        if mark in self.filter[one] or mark in self.filter[two]:
            for record in self.store[one]:
                if record[0] == key and record[1] == length:
                    return record
        return None

    def insert(self, record: list) -> None:
        self.store[self._places(record[0])[1]].append(record)
        self.keys += 1
        if not self._place(record[0]):
            self._resize()

    def _place(self, key: bytes) -> bool:
        mark, at, other = self._places(key)
        if len(self.filter[at]) >= SLOTS:
            at = other
        for kick in range(KICKS):
            bucket = self.filter[at]
            if len(bucket) < SLOTS:
                bucket.append(mark)
                return True
            mark, bucket[kick % SLOTS] = bucket[kick % SLOTS], mark
            at ^= mark * 0x5BD1E995 & self.mask
        return False

    def _resize(self) -> None:
        records, buckets = list(self), self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            for record in records:
                self.store[self._places(record[0])[1]].append(record)
            if all(self._place(record[0]) for record in records):
                return

    def delete(self, key: bytes, length: int) -> bool:
        record = self.find(key, length)
        if record is None:
            return False
        mark, one, two = self._places(key)
        self.store[one] = [r for r in self.store[one] if r is not record]
        self.filter[one if mark in self.filter[one] else two].remove(mark)
        self.keys -= 1
        return True

    def __iter__(self) -> Iterator[list]:
        return (record for bucket in self.store for record in bucket)


def _digests(batches):
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        bodies = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(row, row + len(bodies)), pa.int64()), pa.array([hashlib.sha256(b.lower()).digest() for b in bodies], pa.binary()), pa.array([len(b) for b in bodies], pa.int64())], ["doc_id", "row_id", "digest", "n_bytes"])
        row += len(bodies)


def _live(most: int | None):
    def run(batches):
        index = CuckooIndex()

        def rows():
            held = list(index)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in ((([r[0] for r in held]), pa.binary()), ([r[1] for r in held], pa.int64()), ([r[2][0] for r in held], pa.int64()), ([r[2][1] for r in held], pa.int64()), ([r[3] for r in held], pa.int64()))], ["digest", "n_bytes", "keep_id", "keep_row", "group_size"])

        for batch in batches:
            for key, length, doc, row, count in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                live = (LEAST if doc is None else doc, row)
                found = index.find(key, length)
                if found is None:
                    index.insert([key, length, live, count])
                elif live > found[2]:
                    index.delete(key, length)
                    index.insert([key, length, live, found[3] + count])
                else:
                    found[3] += count
            if most and index.keys >= most:
                yield rows()
                index = CuckooIndex()
        if index.keys:
            yield rows()

    return run


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, row_id, digest (binary), keep_id, group_size, kept."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    digests = settle(source.mapInArrow(_digests, "doc_id long, row_id long, digest binary, n_bytes long"))
    shape = "digest binary, n_bytes long, keep_id long, keep_row long, group_size long"
    local = digests.select("digest", "n_bytes", "doc_id", "row_id", F.lit(1).cast("long").alias("n")).mapInArrow(_live(MAP_KEYS), shape)
    # so many shards that one fits a task; their number is set, so they are not put together again
    shards = max(-(-digests.count() // SHARD_KEYS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = local.repartition(shards, F.col("digest")).mapInArrow(_live(None), shape)
    groups = groups.where("group_size > 1").select("digest", F.nullif("keep_id", F.lit(LEAST)).alias("keep_id"), "keep_row", "group_size")
    return digests.join(groups, "digest", "left").select(
        "doc_id", "row_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row_id"))).alias("kept")
    )
