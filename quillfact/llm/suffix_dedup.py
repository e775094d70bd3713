"""Removal of long repeated passages, by run-length suffix indexes over the repetitive part of the corpus.

1. Anchors. In every 100-byte string the 24-gram of smallest hash (the rightmost of equal ones) is its anchor: equal
   strings have equal anchors, so repeats meet under the anchor's hash. Each task sends each distinct pair (anchor,
   context) once, where the context is the text that all strings with this anchor can cover.
2. Contexts of an anchor that are equal (by their hashes): all but the earliest are covered whole. Different contexts of
   an anchor that agree on one side of it may share a string; the earliest of each goes to an index.
3. Index. The contexts of a bucket of anchors are suffix-sorted; of the Burrows-Wheeler transform only the runs and the
   suffix samples at the run ends are kept. The match length with the lexicographic neighbour is computed at run heads
   only; lengths and neighbours are streamed over the text from the samples (inside a run a length falls by one from byte
   to byte, and the neighbour moves along). Strings with matching statistics of at least 100 are linked with their
   neighbours into classes, of which all but the earliest are marked.
4. Contexts of an anchor that has more than HOT_BYTES of them do not meet in one index: each of their strings goes to
   the bucket of its own hash, once a chunk of a task, and all but the earliest place of a string are marked.
5. The marked stretches of a document are merged and cut out.

Hashes are 64 bits (anchors together with contexts or strings 128); index matches compare bytes.

Defined results: a null text is empty; matches never cross documents; a null doc_id comes before all others; rows that
repeat a doc_id (or have none) are documents of their own, in the order of their texts' SHA-256, so a string of one is
removed only where an earlier one has it; an empty table gives no rows; a very long text is treated whole, block by block;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import BROADCAST_ROWS, arrow_batches, settle, sized

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams in a string
#: A string of LENGTH reaches at least this far to one side of its anchor.
HALF = (LENGTH - GRAM) // 2
#: Window starts that are looked at together; the low bits of a key hold the place in such a block.
BLOCK, PLACE_BITS = 1 << 16, np.uint64(20)
RECORD = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("left", "u1"), ("right", "u1"), ("before", "<u4"), ("after", "<u4")])
#: Bytes of texts whose records meet in one bucket, on average.
BUCKET_BYTES = 8_000_000
#: Bytes of contexts in an index, on average.
INDEX_BYTES = 250_000
#: Bytes of an anchor's contexts beyond which its strings are dealt by their own hashes instead of to one index.
HOT_BYTES = 1_000_000
#: A string of a hot anchor: its two hashes and its place.
STRING = np.dtype([("anchor", "<u8"), ("string", "<u8"), ("doc", "<i8"), ("at", "<i4")])


def _gram_sums(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial sum of each stretch of size values (24: sixteen and the eight after them), by doubling."""
    done, width, out, reach = {1: values}, 1, None, 0
    while width <= size:
        if size & width:
            part = done[width]
            out = part if out is None else part[: len(part) - reach] + np.uint64(pow(int(B.BASE), width, 2**64)) * out[width:][: len(part) - reach]
            reach += width
        part = done.pop(width)
        done[2 * width] = part[:-width] + np.uint64(pow(int(B.BASE), width, 2**64)) * part[width:]
        width *= 2
    return out


def find_anchors(buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, gram hash, context start and end, and context hash of every anchor, and hashes of the gram with HALF bytes
    before and after it (0 where the text ends sooner); begins: of the texts, and the end."""
    n = len(buf)
    some = np.zeros(n + 1, np.int32)
    long = np.diff(begins) >= LENGTH
    np.add.at(some, begins[:-1][long], 1)
    np.add.at(some, begins[1:][long] - LENGTH + 1, -1)
    starts_ok = np.cumsum(some[:n]) > 0
    mask = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    for block in range(0, max(n - LENGTH + 1, 0), BLOCK):  # a block's arrays stay in the processor's cache
        end = min(block + BLOCK, n - LENGTH + 1)
        base, top = max(block - SPAN, 0), min(end + SPAN + LENGTH, n)
        values = B.BYTE_KEYS[buf[base:top]]
        hashed = _gram_sums(values[block - base : end - 1 + SPAN + GRAM - 1 - base], GRAM)
        key = (hashed & ~mask) | (mask - np.arange(len(hashed), dtype=np.uint64))
        size = 1
        while size * 2 <= SPAN:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < SPAN:
            key = np.minimum(key[: end - block], key[SPAN - size : SPAN - size + end - block])
        key = key[: end - block][starts_ok[block:end]]
        at = (mask - (key & mask)).astype(np.int64)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * B.powers(len(values))[0], out=run[1:])
        doc = np.searchsorted(begins, at + block, side="right") - 1
        lo, hi = np.maximum(begins[doc], at + block - SPAN + 1), np.minimum(begins[doc + 1], at + block + LENGTH)
        context = B.mixed(B.hashes(run, lo - base, hi - base) + (at + block - lo).astype(np.uint64))
        sides = []
        for start, stop in ((at + block - HALF, at + block + GRAM), (at + block, at + block + GRAM + HALF)):
            inside = (start >= lo) & (stop <= hi)
            sides.append(np.where(inside, B.hashes(run, np.where(inside, start, lo) - base, np.where(inside, stop, lo) - base) | np.uint64(1), np.uint64(0)))
        for held, x in zip(out, (at + block, hashed[at], lo, hi, context, *sides), strict=True):
            held.append(x)
    if not out[0]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    at, first = np.unique(np.concatenate(out[0]), return_index=True)
    return at, *(np.concatenate(x)[first] for x in out[1:])


def _earliest(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by anchor, context, document and place, and which of them are the first of their context."""
    records = records[np.lexsort((records["at"], records["doc"], records["context"], records["anchor"]))]
    new = np.ones(len(records), bool)
    new[1:] = (records["anchor"][1:] != records["anchor"][:-1]) | (records["context"][1:] != records["context"][:-1])
    return records, new


def _spans(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return records["doc"], records["at"] - records["left"], records["at"] + records["right"].astype(np.int32)


SENT = "bucket int, records binary, doc long, lo int, hi int"


def _send(buckets: int):
    def run(batches):
        for ids, bodies in B.chunks(batches, 2):
            begins = np.zeros(len(bodies) + 1, np.int64)
            np.cumsum([len(b) for b in bodies], out=begins[1:])
            at, grams, lo, hi, contexts, before, after = find_anchors(np.frombuffer(b"".join(bodies), np.uint8), begins)
            doc = np.searchsorted(begins, at, side="right") - 1
            records = np.empty(len(at), RECORD)
            records["anchor"], records["context"] = grams, contexts
            records["doc"], records["at"] = np.array(ids, np.int64)[doc], at - begins[doc]
            records["left"], records["right"] = at - lo, hi - at
            records["before"], records["after"] = before & np.uint64(0xFFFFFFFF), after & np.uint64(0xFFFFFFFF)
            # of a context that repeats within the chunk only the earliest is sent, the others are covered
            order = np.argsort(grams, kind="stable")
            same = grams[order][1:] == grams[order][:-1]
            many = np.zeros(len(at), bool)
            many[order[1:]] |= same
            many[order[:-1]] |= same
            repeated, new = _earliest(records[many])
            doc_, lo_, hi_ = _spans(repeated[~new])
            records = np.concatenate([records[~many], repeated[new]])
            bucket = (records["anchor"] >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            blobs = [x.tobytes() for x in np.split(records, edges[1:])] if len(edges) else []
            k, m = len(blobs), len(doc_)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bucket[edges], np.full(m, -1)]), pa.int32()), pa.array(blobs + [None] * m, pa.binary()), pa.array(np.concatenate([np.zeros(k, np.int64), doc_])), pa.array(np.concatenate([np.zeros(k, np.int32), lo_]), pa.int32()), pa.array(np.concatenate([np.zeros(k, np.int32), hi_]), pa.int32())],
                [x.split()[0] for x in SENT.split(", ")],
            )

    return run


MET = "doc long, lo int, hi int, at int, anchor long, open boolean"


def _meet(table: pa.Table) -> pa.Table:
    """Covered stretches (open false) and the contexts that need an index (open true) of one bucket."""
    records = np.concatenate([np.frombuffer(x, RECORD) for x in table.column("records").to_pylist()])
    order = np.argsort(records["anchor"], kind="stable")
    same = records["anchor"][order][1:] == records["anchor"][order][:-1]
    many = np.zeros(len(records), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    records, new = _earliest(records[many])
    first = records[new]
    # contexts can share a string only where they agree on one side of the anchor
    agree = np.zeros(len(first), bool)
    for side in ("before", "after"):
        order = np.lexsort((first[side], first["anchor"]))
        x, anchor = first[side][order], first["anchor"][order]
        same = (x[1:] == x[:-1]) & (anchor[1:] == anchor[:-1]) & (x[1:] > 0)
        agree[order[1:][same]] = True
        agree[order[:-1][same]] = True
    first = first[agree]
    both = np.concatenate([records[~new], first])
    doc, lo, hi = _spans(both)
    return pa.table({"doc": doc, "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "at": pa.array(both["at"], pa.int32()), "anchor": both["anchor"].view(np.int64), "open": np.arange(len(both)) >= len(both) - len(first)})


def _contexts(buckets: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, body, stretches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in stretches:
                    if x["hot"]:
                        continue
                    out[0].append((x["anchor"] & 0xFFFFFFFFFF) % buckets)
                    out[1].append(doc)
                    out[2].append(x["lo"])
                    out[3].append(body[x["lo"] : x["hi"]])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "doc", "lo", "body"])

    return run


def _first_strings(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest place of every string, and the other places."""
    records = records[np.lexsort((records["at"], records["doc"], records["string"], records["anchor"]))]
    new = np.ones(len(records), bool)
    new[1:] = (records["anchor"][1:] != records["anchor"][:-1]) | (records["string"][1:] != records["string"][:-1])
    first = records[new]
    of = first[np.cumsum(new) - 1]
    return first, records[(records["doc"] != of["doc"]) | (records["at"] != of["at"])]


def _string_spans(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the bytes in strings; neighbouring starts make one stretch."""
    records = records[np.lexsort((records["at"], records["doc"]))]
    doc, at = records["doc"], records["at"]
    new = np.ones(len(records), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 1)
    last = np.append(new[1:], True)[: len(new)]
    return doc[new], at[new], at[last] + np.int32(LENGTH)


def _strings(buckets: int):
    """Each string of the hot anchors' contexts, once a chunk, to the bucket of its hash; the others are covered."""

    def chunk(held: list[tuple[int, bytes, list[dict]]]) -> pa.RecordBatch:
        found = []
        for doc, body, stretches in held:
            run = B.running(np.frombuffer(body, np.uint8))
            for x in stretches:
                at = np.arange(x["lo"], x["hi"] - LENGTH + 1)
                if not len(at):
                    continue
                records = np.empty(len(at), STRING)
                records["anchor"], records["string"] = np.uint64(x["anchor"] & 0xFFFFFFFFFFFFFFFF), B.hashes(run, at, at + LENGTH)
                records["doc"], records["at"] = doc, at
                found.append(records)
        first, covered = _first_strings(np.concatenate([*found, np.empty(0, STRING)]))
        bucket = (first["string"] >> np.uint64(16)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        first, bucket = first[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        blobs = [x.tobytes() for x in np.split(first, edges[1:])] if len(edges) else []
        doc, lo, hi = _string_spans(covered)
        k, m = len(blobs), len(doc)
        cols = [np.concatenate([bucket[edges], np.full(m, -1)]), blobs + [None] * m, *(np.concatenate([np.zeros(k, np.int64), v]) for v in (doc, lo, hi))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], [x.split()[0] for x in SENT.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, body, stretches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = [x for x in stretches if x["hot"]]
                if not some:
                    continue
                held.append((doc, body, some))
                size += sum(x["hi"] - x["lo"] for x in some)
                if size >= HOT_BYTES:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Covered stretches of one bucket of strings."""
    doc, lo, hi = _string_spans(_first_strings(np.concatenate([np.frombuffer(x, STRING) for x in table.column("records").to_pylist()]))[1])
    return pa.table({"doc": doc, "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of texts, each ended by an end mark of its own, with samples at run ends.

    heads: the transform's symbol in each run; run_starts: where the runs begin; first_samples, last_samples: the
    suffix at the first and last place of each run; matches: the match length of each first sample with the suffix
    before it in the order.
    """

    def __init__(self, texts: list[bytes]):
        body = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes) - 1
        used = np.zeros(257, np.int64)
        used[body + np.int64(1)] = 1
        text = np.cumsum(used)[body + np.int64(1)]  # dense symbols from 1
        text[ends] = 0
        self.n, n = len(text), len(text)
        to_end = np.repeat(ends, sizes) - np.arange(n)
        place = max((n - 1).bit_length(), 1)
        low = (1 << place) - 1
        bits = int(text.max()).bit_length()
        depth = max((63 - place) // max(bits, 1), 1)
        depth = min(depth, 8)
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        key = np.zeros(n, np.int64)
        for j in range(depth):
            key = (key << bits) | np.where(to_end >= j, padded[j : j + n], 0)
        key = np.sort((key << place) | np.arange(n))
        order = key & low
        new = np.ones(n, bool)
        new[1:] = ((key[1:] ^ key[:-1]) > low) | (to_end[order[1:]] < depth)  # an end mark differs from all others
        ranks = []
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            ranks.append((depth, rank))
            if new.all():
                break
            ahead = np.zeros(n, np.int64)
            ahead[: n - depth] = rank[depth:]
            if 3 * place <= 63:
                key = np.sort((((rank << place) | ahead) << place) | np.arange(n))
                order = key & low
                new[1:] |= (key[1:] ^ key[:-1]) > low
            else:
                order = np.lexsort((ahead, rank))
                new[1:] |= ahead[order][1:] != ahead[order][:-1]
            depth *= 2
        before = np.where(order > 0, text[order - 1], 0)
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_starts = np.flatnonzero(head)
        self.heads = before[self.run_starts]
        run_ends = np.append(self.run_starts[1:], self.n) - 1
        self.first_samples, self.last_samples = order[self.run_starts], order[run_ends]
        # at a run's head the suffix before it in the order is the last sample of the run before
        one, two = self.first_samples[1:].copy(), self.last_samples[:-1].copy()
        same = np.zeros(len(one), np.int64)
        for depth, rank in reversed(ranks[:-1]):
            hit = (np.maximum(one, two) + depth < self.n) & (rank[np.minimum(one, self.n - 1)] == rank[np.minimum(two, self.n - 1)])
            for x in (one, two, same):
                x[hit] += depth
        for _ in range(ranks[0][0]):
            hit = (text[one] == text[two]) & (text[one] > 0)
            for x in (one, two, same):
                x[hit] += 1
        self.matches = np.append(0, same)

    def _sample(self) -> np.ndarray:
        """For every place the last place up to it that begins a run."""
        sampled = np.zeros(self.n, np.int64)
        sampled[self.first_samples] = self.first_samples
        return np.maximum.accumulate(sampled)

    def matching_statistics(self) -> np.ndarray:
        """For every place of the text, the length of its match with the suffix before it, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)  # where a sample's match ends
        reach[self.first_samples] = self.first_samples + self.matches
        return np.maximum(reach[self._sample()] - np.arange(self.n), 0)

    def neighbours(self) -> np.ndarray:
        """For every place of the text, the suffix before it in the order (-1 for the first), streamed from the samples."""
        before = np.full(self.n, -1, np.int64)
        before[self.first_samples[1:]] = self.last_samples[:-1]
        sample = self._sample()
        base = before[sample]
        return np.where(base < 0, -1, base + np.arange(self.n) - sample)


def repeats(docs: np.ndarray, lo: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the bytes of contexts that lie in a string of LENGTH with an earlier start elsewhere."""
    index = RunLengthIndex(bodies)
    long = index.matching_statistics() >= LENGTH
    sizes = np.array([len(b) + 1 for b in bodies])
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(bodies)), sizes)
    number = np.unique(docs, return_inverse=True)[1]
    place = (number[owner].astype(np.int64) << 32) + lo[owner] + np.arange(index.n) - begins[owner]
    root = np.where(long, index.neighbours(), np.arange(index.n))
    while not np.array_equal(root, further := root[root]):  # the head of each class, in doubling steps
        root = further
    first = np.full(index.n, np.iinfo(np.int64).max)
    np.minimum.at(first, root, place)
    marked = place > first[root]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).view(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    at = lo[owner[starts]] + starts - begins[owner[starts]]
    return docs[owner[starts]], at, at + (stops - starts) + LENGTH - 1


def _index(table: pa.Table) -> pa.Table:
    doc, lo, hi = repeats(table.column("doc").to_numpy(), table.column("lo").to_numpy().astype(np.int64), table.column("body").to_pylist())
    return pa.table({"doc": doc, "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32())})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, body, stretches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keep, end, spans, removed = [], 0, 0, 0
            for x in sorted((x["lo"], min(x["hi"], len(body))) for x in stretches or ()):
                if x[1] <= x[0]:
                    continue
                if x[0] > end or not spans:
                    keep.append(body[end : x[0]])
                    spans += 1
                    end = x[0]
                removed += max(x[1] - end, 0)
                end = max(end, x[1])
            keep.append(body[end:])
            for c, v in zip(out, (doc, len(body), removed, spans, b"".join(keep)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.binary()), strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def _joined_texts(source: DataFrame, stretches: DataFrame, rest: bool) -> DataFrame:
    """source rows with the stretches of their document (one row a document, settled); rest: also those without any.

    Only texts of documents that have some are shuffled, if those documents are few enough to be known everywhere."""
    ids = stretches.select("doc")
    few = ids.count() <= BROADCAST_ROWS
    ids = F.broadcast(ids) if few else ids
    got = source.join(ids, "doc", "left_semi").join(stretches, "doc")
    if not rest:
        return got.select("doc", "body", "stretches")
    return got.select("doc_id", "body", "stretches").unionByName(source.join(ids, "doc", "left_anti").select("doc_id", "body", F.lit(None).cast(stretches.schema["stretches"].dataType).alias("stretches"))) if few else source.join(stretches, "doc", "left").select("doc_id", "body", "stretches")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, body: doc is the place in the order of documents, the doc_id itself where each has its own. Otherwise rows are
    sorted by doc_id and the hash of the text over all tasks; that order is in the rows' running numbers, of which the high
    bits are the task's."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    rows, ids = source.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return source.select("doc_id", F.col("doc_id").alias("doc"), "body")
    order = [F.col("doc_id"), F.sha2("body", 256)]
    return settle(source.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.monotonically_increasing_id().alias("doc"), "body"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    source = numbered(docs)
    size = source.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = settle(source.select("doc", "body").mapInArrow(_send(buckets), SENT))
    met = settle(sent.where("records is not null").select("bucket", "records").groupBy("bucket").applyInArrow(_meet, MET))
    spans = sent.where("records is null").select("doc", "lo", "hi").unionByName(met.where("not open").select("doc", "lo", "hi"))
    open_ = met.where("open")
    per_anchor = settle(open_.groupBy("anchor").agg(F.sum(F.col("hi") - F.col("lo")).alias("size")))
    total, heat = per_anchor.agg(F.sum("size"), F.sum(F.when(F.col("size") > HOT_BYTES, F.col("size")))).first()
    if total:
        hot = sized(per_anchor.where(F.col("size") > HOT_BYTES).select("anchor", F.lit(True).alias("hot")))
        marked = open_.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        per_doc = settle(marked.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "anchor", "hot")).alias("stretches")))
        texts = _joined_texts(source, per_doc, rest=False)
        contexts = texts.mapInArrow(_contexts(max(-(-(total - (heat or 0)) // INDEX_BYTES), 1)), "bucket int, doc long, lo int, body binary")
        spans = spans.unionByName(contexts.groupBy("bucket").applyInArrow(_index, "doc long, lo int, hi int"))
        if heat:
            dealt = settle(_joined_texts(source, per_doc.where("exists(stretches, x -> x.hot)"), rest=False).mapInArrow(_strings(max(-(-heat // INDEX_BYTES), buckets)), SENT))
            spans = spans.unionByName(dealt.where("records is null").select("doc", "lo", "hi")).unionByName(dealt.where("records is not null").select("bucket", "records").groupBy("bucket").applyInArrow(_merge, "doc long, lo int, hi int"))
    per_doc = settle(spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("stretches")))
    return _joined_texts(source, per_doc, rest=True).mapInArrow(_cut, RESULT)

