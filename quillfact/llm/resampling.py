"""Target-distribution importance resampling over a dictionary of the distinct n-gram strings of the corpus.

1. Texts are taken in chunks. A chunk numbers its words and word pairs as they first occur, so each distinct string is
   held once; its documents keep the numbers of their distinct features, with counts. The strings go to shards of the
   dictionary, in blobs by shard; the documents' counts pass through the same shuffle beside them.
2. A shard counts each string over all chunks, of documents and of target texts, and hashes each distinct string once.
   It sends every chunk the buckets of the chunk's strings, in the order in which they came, and the sums of its strings
   by bucket.
3. The sums of all shards give each bucket's gain: a table of BUCKETS numbers, whatever the input's size.
4. Chunks meet the buckets of their strings, and the gains are joined to the feature counts of their documents.
5. Documents of enough words are ranked by weight plus a Gumbel number made from the doc_id (exponential races: the
   highest scores are a sample without replacement). Counts by score and slice of doc_ids place a document; no
   window covers all rows.

Defined results: a null text has no words; a text without features has weight 0; A-Z are lower-cased, nothing else; a row
without doc_id has no score and is never drawn, nor is it one of the documents to draw from; rows that repeat a doc_id are
rows of their own, and ties go to the smaller doc_id, then to fewer features, then the smaller weight; without target texts
all gains follow from empty counts; very long texts are a chunk of their own; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, settle

BUCKETS = 10_000
#: Bytes of texts whose strings are numbered together.
CHUNK_BYTES = 4_000_000
#: Bytes of texts that a shard of the dictionary stands for, on average.
SHARD_BYTES = 8_000_000
MIN_WORDS, SHARE, SEED = 20, 25, 7
#: Slices of doc_ids within a score, when documents are ranked.
SLICES = 256

#: route: the shard of strings; of a chunk's documents a number below 0.
SENT = "route long, chunk long, target boolean, strings binary, counts binary, shards binary, doc_ids array<long>, words array<int>, sizes array<long>"
CODEC = pa.Codec("zstd", 3)


def packed(x: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane, after their length."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def slots(texts: list[bytes]):
    """The words of the texts by number: texts' first words (and the end), number of each word, its strings and their hashes."""
    buf, begins = B.joined(texts)
    starts, ends, first = B.words(buf, begins, B.ALNUM)
    hashed = B.hashes(B.running(buf), starts, ends)
    keys, at, number = np.unique(hashed, return_index=True, return_inverse=True)
    size = ends[at] - starts[at]
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    inner = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1].astype(np.int64), size)
    data = buf[np.repeat(starts[at], size) + inner]
    strings = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return first, number, strings, keys


def chunk_features(texts: list[bytes]):
    """Distinct features of a chunk (their strings, hashes and counts) and of its documents: sizes, numbers and counts of the
    distinct features of each, and its number of words and features."""
    first, number, strings, keys = slots(texts)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(texts)), n_words)
    v = len(keys)
    together = text[1:] == text[:-1]
    pairs, pair = np.unique((number[:-1].astype(np.int64) * v + number[1:])[together], return_inverse=True)
    one, two = pairs // max(v, 1), pairs % max(v, 1)
    both = pc.binary_join_element_wise(strings.take(pa.array(one)), strings.take(pa.array(two)), pa.scalar(b" ", pa.binary()))
    hashed = np.concatenate([keys, B.mixed(keys[one] * B.SHINGLE_KEYS[0] + keys[two] * B.SHINGLE_KEYS[1])])
    feature, owner = np.concatenate([number, v + pair]), np.concatenate([text, text[1:][together]])
    f = len(hashed)
    counts = np.bincount(feature, minlength=f)
    held = np.unique(owner * np.int64(max(f, 1)) + feature) % max(f, 1)
    first = np.empty(f, np.int64)
    first[held[::-1]] = np.arange(len(held))[::-1]  # the document's place in which a feature is held first
    order = np.argsort(first, kind="stable")
    number = np.empty(f, np.int64)
    number[order] = np.arange(f)
    held, times = np.unique(owner * np.int64(max(f, 1)) + number[feature], return_counts=True)
    sizes = np.bincount(held // max(f, 1), minlength=len(texts))
    return pa.concat_arrays([strings, both.cast(pa.binary())]).take(pa.array(order)), hashed[order], counts[order], sizes, held % max(f, 1), times, n_words


def _send(shards: int, target: bool):
    """A chunk's strings by shard, with counts, and a row of its documents: the numbers of their distinct features (ascending
    in each, as differences) and counts in place of strings and counts, and the shard of each of the chunk's strings."""
    names = [x.split()[0] for x in SENT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    narrow = np.min_scalar_type(shards)

    def run(batches):
        for ids, texts in B.chunks(batches, 2, CHUNK_BYTES):
            chunk = uuid.uuid4().int >> 65
            strings, hashed, counts, sizes, held, times, n_words = chunk_features(texts)
            shard = (hashed % np.uint64(shards)).astype(np.int64)
            if not target:
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                step = np.diff(held, prepend=0)
                step[first] = held[first]
                yield batch_of([(-1 - chunk, chunk, None, packed(step.astype(np.uint32)), packed(times.astype(np.uint32)), packed(shard.astype(narrow)), ids, n_words.tolist(), sizes.tolist())])
            if not len(shard):
                continue
            order = np.argsort(shard, kind="stable")
            strings, counts, shard = strings.take(pa.array(order)), counts[order].astype(np.uint32), shard[order]
            offsets, data = (np.frombuffer(x, t) for x, t in zip(strings.buffers()[1:], (np.int32, np.uint8), strict=True))
            edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)).tolist()
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                blob = packed(np.diff(offsets[a : b + 1]).astype(np.uint32))
                rows.append((int(shard[a]), chunk, target, len(blob).to_bytes(8, "little") + blob + packed(data[offsets[a] : offsets[b]]), packed(counts[a:b]), None, None, None, None))
                if len(rows) == 64:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return run


ROUTED = "chunk long, shard long, buckets binary, sums array<struct<bucket: int, s: long, t: long>>, strings binary, counts binary, shards binary, doc_ids array<long>, words array<int>, sizes array<long>"


def _count(table: pa.Table) -> pa.Table:
    """One shard: each distinct string's counts and bucket; rows with the buckets of each chunk's strings, one row of sums. The
    documents of a chunk pass as they are."""
    names = ["chunk", "shard", "buckets", "sums", "strings", "counts", "shards", "doc_ids", "words", "sizes"]
    sums_type = pa.list_(pa.struct([("bucket", pa.int32()), ("s", pa.int64()), ("t", pa.int64())]))
    shard = table.column("route")[0].as_py()
    if shard < 0:
        k = table.num_rows
        none = [pa.nulls(k, t) for t in (pa.int64(), pa.binary(), sums_type)]
        return pa.table([table.column("chunk"), *none, *(table.column(c) for c in names[4:])], names)
    chunks, targets = table.column("chunk").to_pylist(), table.column("target").to_pylist()
    parts, sizes, counts = [], [], []
    for blob, count in zip(table.column("strings").to_pylist(), table.column("counts").to_pylist(), strict=True):
        head = int.from_bytes(blob[:8], "little")
        lengths = unpacked(blob[8 : 8 + head], np.uint32)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        parts.append(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(unpacked(blob[8 + head :], np.uint8))]))
        sizes.append(len(lengths))
        counts.append(unpacked(count, np.uint32))
    coded = pa.concat_arrays(parts).dictionary_encode()
    code, strings = coded.indices.to_numpy(), coded.dictionary
    bucket = np.fromiter((zlib.crc32(x) for x in strings.to_pylist()), np.int64, len(strings)) % BUCKETS
    side = np.repeat(np.array(targets), sizes)
    count, of = np.concatenate(counts).astype(np.float64), bucket[code]
    sums = [np.bincount(of[x], count[x], BUCKETS).astype(np.int64) for x in (~side, side)]  # exact below 2**53
    some = np.flatnonzero(sums[0] + sums[1])
    total = [{"bucket": b, "s": s, "t": t} for b, s, t in zip(some.tolist(), sums[0][some].tolist(), sums[1][some].tolist(), strict=True)]
    edges = np.append(0, np.cumsum(sizes)).tolist()
    rows = [(c, shard, packed(of[a:b].astype(np.uint16)), None) for c, a, b, t in zip(chunks, edges[:-1], edges[1:], targets, strict=True) if not t]
    rows.append((None, shard, None, total))
    k = len(rows)
    routed = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), sums_type), strict=True)]
    return pa.table([*routed, *(pa.nulls(k, table.schema.field(c).type) for c in names[4:])], names)


def _weigh(gains: np.ndarray, shards: int):
    narrow = np.min_scalar_type(shards)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        for batch in batches:
            for ids, words, sizes, step, times, shard, routed in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                back = np.concatenate([np.zeros(0, np.uint16), *(unpacked(r["buckets"], np.uint16) for r in routed or [])])
                bucket = np.empty_like(back)
                bucket[np.argsort(unpacked(shard, narrow), kind="stable")] = back
                step, times = (unpacked(x, np.uint32).astype(np.int64) for x in (step, times))
                sizes = np.array(sizes, np.int64)
                row, run_ = np.repeat(np.arange(len(sizes)), sizes), np.append(0, np.cumsum(step))
                held = run_[1:] - np.repeat(run_[np.cumsum(sizes) - sizes], sizes)
                total, n = (np.bincount(row, x, len(sizes)).astype(np.int64) for x in (gains[bucket[held]] * times, times))  # whole numbers below 2**53
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], names)
        B.release()

    return run


def bucket_gains(sums: DataFrame) -> DataFrame:
    """bucket, gain of the buckets in sums(bucket, s, t): BUCKETS rows at most."""
    both = sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = both.crossJoin(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))  # one row of totals
    plus = lambda c, n: (F.col(c) + n).cast("double")
    return every.select("bucket", F.floor(1000 * F.log(plus("t", 1) * plus("all_s", BUCKETS) / (plus("s", 1) * plus("all_t", BUCKETS)))).alias("gain"))


def weights(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight of docs(doc_id, text); targets(text): what the sample is to be like."""
    spark = docs.sparkSession
    arrow_batches(spark)
    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")
    source, goal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body), targets.select(F.lit(0).cast("long").alias("doc_id"), body)
    size = source.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(-(-size // SHARD_BYTES), 1)
    sent = source.mapInArrow(_send(shards, False), SENT).unionByName(goal.mapInArrow(_send(shards, True), SENT))
    routed = settle(sent.groupBy("route").applyInArrow(_count, ROUTED))
    gains = np.zeros(BUCKETS, np.int64)
    for bucket, gain in bucket_gains(routed.where("sums is not null").select(F.inline("sums"))).collect():  # BUCKETS rows at most
        gains[bucket] = gain
    back = routed.where("buckets is not null").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "buckets"))).alias("routed"))
    held = routed.where("sizes is not null").select("chunk", "doc_ids", "words", "sizes", "strings", "counts", "shards")
    return held.join(back, "chunk", "left").select("doc_ids", "words", "sizes", "strings", "counts", "shards", "routed").mapInArrow(_weigh(gains, shards), "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """scored(doc_id, n_words, n_features, weight, score) with rank: the share (in percent) of the highest scores of documents of
    min_words. Scores are whole numbers of a bounded range, so counts by score are a small table; below the score at which
    the sample is full nothing is ranked, and each score's documents are ranked in slices of the doc_ids."""
    scored = settle(scored)
    fits = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    able = scored.where(fits)
    low, high, n = able.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    wanted = share * (n or 0) // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = max((high - low) // SLICES + 1, 1)
    piece = F.expr(f"(cast(doc_id as decimal(20,0)) - {low}) div {width}")
    placed = able.withColumn("slice", piece)
    counts = settle(placed.groupBy("score", "slice").agg(F.count("*").alias("n")))
    by_score = counts.groupBy("score").agg(F.sum("n").alias("all"))
    above = F.sum("all").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))  # a row per score
    by_score = by_score.select("score", F.coalesce(above, F.lit(0)).alias("above")).where(F.col("above") < wanted)
    inside = F.sum("n").over(Window.partitionBy("score").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.join(by_score, "score").select("score", "slice", (F.col("above") + F.coalesce(inside, F.lit(0))).alias("before")).where(F.col("before") < wanted)
    placed = placed.join(starts, ["score", "slice"], "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score", "slice").orderBy("doc_id", "n_features", "weight"))
    without = lambda df: df.select(*scored.columns, F.lit(None).cast("long").alias("rank"))
    drawn = placed.where("before is not null").withColumn("place", place).select(*scored.columns, F.when(F.col("place") <= wanted, F.col("place")).alias("rank"))
    return drawn.unionByName(without(placed.where("before is null"))).unionByName(without(scored.where(~F.coalesce(fits, F.lit(False)))))


def resample(docs: DataFrame, targets: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of docs(doc_id, text), like targets(text); rank is null for what is not drawn."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), F.lit(8)), 16, 10).cast("double")
    return ranked(weights(docs, targets).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))), share, min_words)
