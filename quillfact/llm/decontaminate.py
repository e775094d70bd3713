"""Benchmark decontamination by a document-partitioned positional inverted index.

Index: each chunk of training documents becomes a segment, that is for every term of its texts the sorted word positions at
which it occurs (documents are set apart by a gap). The index is stored once and serves any test set. Search: the windows of
the test set are matched against each segment by intersecting offset-adjusted position lists, from the term that is rarest
over the whole corpus; what is left are exact phrase matches. Proximity matches are items of which the other two of the
three rarest terms (of equally rare ones the first in spelling) occur within NEAR words of a place of the rarest, in one
document. No posting is shuffled: segments stay
where their documents were read, the test set travels to them in blocks of bounded size.

Defined results: a null text has no words; an item without words has no window; a test set of no items leaves all
documents clean; repeated item rows count by item_id, a null item_id is no item; repeated documents get a row each, an empty
table of documents gives none; a very long text is a segment of its own, and a very long item a block of its own; other
columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, settle

WINDOW, NEAR, GAP = 10, 20, 64
#: Bytes of texts in a segment.
SEGMENT_BYTES = 750_000
#: Items, and bytes of their texts, that are sent to the tasks at a time; a larger test set is searched block by block.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 5_000_000
SEGMENT = "row_id long, doc_ids binary, null_ids binary, bases binary, n_words binary, terms binary, counts binary, postings binary"
SEGMENT_TYPES = (np.int64, bool, np.int32, np.int32, np.uint64, np.int32, np.int32)
HITS = "row_id long, doc_id long, n_words long, hits array<int>, items array<string>, near array<string>"


class Queries:
    """Windows of a block of items as matrices of term numbers, and its sorted term hashes."""

    def __init__(self, items: list[tuple[str, bytes]]):
        buf, begins = B.joined([text for _, text in items])
        starts, ends, first = B.words(buf, begins, B.ALNUM)
        hashed = B.hashes(B.running(buf), starts, ends)
        keys, at, numbers = np.unique(hashed, return_index=True, return_inverse=True)
        spelt = [buf[starts[i] : ends[i]].tobytes() for i in at.tolist()]
        order = np.array(sorted(range(len(spelt)), key=spelt.__getitem__), np.int64)  # terms are numbered as they are spelt, which decides ties
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.terms, numbers = keys[order], place[numbers]
        self.items = [name for name, _ in items]
        self.words = [numbers[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        of: dict[tuple, list[int]] = {}
        for item, w in enumerate(self.words):
            for i in range(max(len(w) - WINDOW + 1, min(len(w), 1))):
                of.setdefault(tuple(w[i : i + WINDOW].tolist()), []).append(item)
        self.windows = [(np.array(w), np.array(sorted(set(owners)))) for w, owners in of.items()]
        self.near: list[np.ndarray] = []
        self.near_matrix = np.zeros((0, 3), np.int64)
        #: The windows' terms as a matrix; short windows repeat their last one.
        self.matrix = np.array([w + w[-1:] * (WINDOW - len(w)) for w in of], np.int64).reshape(-1, WINDOW)

    def rank(self, df: np.ndarray) -> None:
        """Order the terms of each window, and choose those of the proximity match, by corpus frequency."""
        self.windows = [(w, np.argsort(df[w], kind="stable"), owners) for w, owners in self.windows]
        self.near = [np.unique(w)[np.argsort(df[np.unique(w)], kind="stable")][:3] for w in self.words]
        filled = [i for i, n in enumerate(self.near) if len(n)]
        self.near_items = [self.items[i] for i in filled]
        self.near = [self.near[i] for i in filled]
        self.near_matrix = np.array([[*n, *[n[-1]] * (3 - len(n))] for n in self.near], np.int64).reshape(-1, 3)


def _build(batches):
    """A segment for each chunk of documents."""
    row = TaskContext.get().partitionId() << 33
    for ids, bodies in B.chunks(batches, 2, SEGMENT_BYTES):
        buf, begins = B.joined(bodies)
        starts, ends, first = B.words(buf, begins, B.ALNUM)
        hashed, per_doc = B.hashes(B.running(buf), starts, ends), np.diff(first)
        places = (np.arange(len(starts)) + np.repeat(np.arange(len(bodies)) * GAP, per_doc)).astype(np.int32)
        order = np.argsort(hashed, kind="stable")
        hashed = hashed[order]
        edge = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]])) if len(hashed) else np.zeros(0, np.int64)
        bases = (first[:-1] + np.arange(len(bodies)) * GAP).astype(np.int32)
        one = (np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids]), bases, per_doc.astype(np.int32), hashed[edge], np.diff(np.append(edge, len(hashed))).astype(np.int32), places[order])
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in one]], [x.split()[0] for x in SEGMENT.split(", ")])
        row += len(bodies)


def _of_terms(terms: np.ndarray, held: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the terms its count in a segment, and where its positions begin."""
    if not len(held):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
    begins = np.cumsum(counts, dtype=np.int64) - counts
    return np.where(held[at] == terms, counts[at], 0).astype(np.int64), begins[at]


def _counts(terms: np.ndarray):
    """How often each of the test set's terms occurs in the segments of a task."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for held, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += _of_terms(terms, np.frombuffer(held, np.uint64), np.frombuffer(counts, np.int32))[0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    return run


def _within(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(values, wanted)
    return values[np.minimum(at, len(values) - 1)] == wanted


def _search(queries: Queries):
    def run(batches):
        for batch in batches:
            for row, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, nulls, bases, n_words, held, counts, postings = (np.frombuffer(b, t) for b, t in zip(blobs, SEGMENT_TYPES, strict=True))
                counts, begins = _of_terms(queries.terms, held, counts)
                lists = lambda t: postings[begins[t] : begins[t] + counts[t]]  # noqa: E731, B023
                marks = np.zeros(int(bases[-1]) + int(n_words[-1]) + WINDOW + 2, np.int32)
                found: dict[int, set[str]] = {}
                for number in np.flatnonzero((counts[queries.matrix] > 0).all(axis=1)).tolist() if len(counts) else ():  # windows of which all terms occur here
                    window, order, owners = queries.windows[number]
                    at = lists(window[order[0]]) - order[0]
                    for k in order[1:]:
                        if not len(at):
                            break
                        at = at[_within(lists(window[k]), at + k)]
                    if len(at):
                        marks[at] += 1
                        marks[at + len(window)] -= 1
                        for doc in np.unique(np.searchsorted(bases, at, side="right") - 1).tolist():
                            found.setdefault(doc, set()).update(queries.items[o] for o in owners)
                near: dict[int, set[str]] = {}
                for number in np.flatnonzero((counts[queries.near_matrix] > 0).all(axis=1)).tolist() if len(counts) else ():  # items of which the rarest terms occur here
                    some = queries.near[number]
                    at = lists(some[0])
                    for k in some[1:]:
                        places = lists(k)
                        right = np.searchsorted(places, at)
                        gap = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(places[np.maximum(right - 1, 0)] - at))
                        at = at[gap <= NEAR]
                    for doc in np.unique(np.searchsorted(bases, at, side="right") - 1).tolist():
                        near.setdefault(doc, set()).add(queries.near_items[number])
                hit = np.flatnonzero(np.cumsum(marks) > 0)
                owner = np.searchsorted(bases, hit, side="right") - 1
                per = np.split(hit - bases[owner], np.searchsorted(owner, np.arange(1, len(ids))))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(n), pa.int64()), pa.array(ids, mask=nulls), pa.array(n_words, pa.int64()), pa.array([p.tolist() for p in per], pa.list_(pa.int32())), pa.array([sorted(found.get(i, ())) for i in range(n)], pa.list_(pa.string())), pa.array([sorted(near.get(i, ())) for i in range(n)], pa.list_(pa.string()))],
                    [x.split()[0] for x in HITS.split(", ")],
                )

    return run


def _blocks(benchmark: DataFrame):
    """Lists of at most BLOCK_ITEMS items and BLOCK_BYTES bytes or so each, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).orderBy("item_id", "text").collect()
        if rows:
            yield [(r["item_id"], r["text"].encode()) for r in rows]


def phrase_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row_id, doc_id, n_words, hits (word numbers), items (ids with an exact match), near (ids with a proximity match), for each row of docs."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    segments = settle(source.mapInArrow(_build, SEGMENT))
    parts = []
    for items in chain(_blocks(benchmark), [[]]):
        if not items and parts:
            break
        queries = Queries(items)  # of no items if there are none
        df = np.zeros(len(queries.terms), np.int64)
        for term, n in segments.select("terms", "counts").mapInArrow(_counts(queries.terms), "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # terms of the block
            df[term] = n
        queries.rank(df)
        parts.append(segments.mapInArrow(_search(queries), HITS))
    if len(parts) == 1:
        return parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    once = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return whole.groupBy("row_id", "doc_id", "n_words").agg(once("hits").alias("hits"), once("items").alias("items"), once("near").alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, near_items."""
    return phrase_matches(docs, benchmark).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"),
    )
