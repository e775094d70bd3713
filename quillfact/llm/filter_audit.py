"""Filter interaction audit: what each filter of a corpus removes under every order of the filters.

The bytes of a batch of texts are scanned in their Arrow buffer: look-up tables mark the byte classes (white space,
capitals, symbols, continuation bytes), prefix sums count them for each text, and edges of the white space mark give the
words. Each word is hashed; a document's hashes are sorted, equal neighbours are compared byte by byte, and those that
are verified count as repeats, so distinct words are exact. Filters over the counts give each document a mask of the
filters that it fails; copies of a text are found by digest. Documents are reduced to counts by mask, and all orders of
the filters are replayed over the masks, never over documents.

Defined results: a null text is empty, and an empty text has no words (it fails a least number of words, but no share);
a null lang is the part of the empty string; a row without doc_id is no copy of another and no other is a copy of it;
rows that repeat a doc_id are rows of their own, and share its labels (a document is good or toxic if one of its labels
says so); a very long text is scanned in pieces; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, settle

#: Bytes that are scanned at a time.
PIECE = 1 << 20
#: The filters that are computed from a document's counts: the condition of failing, as SQL.
FILTERS = {"A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 3 * n_chars", "D": "n_symbols > 0"}
#: The filter that fails all copies of a text but those of the smallest doc_id.
COPIES = "E"

CAPITAL = np.zeros(256, np.uint8)
CAPITAL[0x41:0x5B] = 1
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#$%&*|")] = 1
#: Bytes that begin a code point.
POINT = np.ones(256, np.uint8)
POINT[0x80:0xC0] = 0

COUNTS = "doc_id long, part string, n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long, digest binary"


def pieces(buf: np.ndarray, begins: np.ndarray, size: int = PIECE):
    """Ranges of the buffer of about size bytes that cut no word; begins: where the texts begin (and the end)."""
    a, end = int(begins[0]), int(begins[-1])
    while a < end:
        b = min(a + size, end)
        if b < end:
            space = np.flatnonzero(~B.SPACED[buf[a:b]])
            text = int(begins[np.searchsorted(begins, b, "right") - 1])
            b = max(a + int(space[-1]) + 1 if len(space) else a, text)
            if b <= a:  # one word is longer than a piece
                at, text = a + size, int(begins[np.searchsorted(begins, a, "right")])
                while at < text and B.SPACED[buf[at]]:
                    space = np.flatnonzero(~B.SPACED[buf[at : min(at + size, text)]])
                    at = at + int(space[0]) if len(space) else min(at + size, text)
                b = min(at, text)
        yield a, b
        a = b


def class_counts(table: np.ndarray, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many bytes of each text the table marks, by prefix sums over pieces."""
    at, total = np.zeros(len(begins), np.int64), 0
    for a in range(int(begins[0]), int(begins[-1]), PIECE):
        sums = np.cumsum(table[buf[a : min(a + PIECE, int(begins[-1]))]], dtype=np.int64)
        inside = (begins > a) & (begins <= a + len(sums))
        at[inside] = total + sums[begins[inside] - a - 1]
        total += int(sums[-1])
    return np.diff(at)


def word_edges(buf: np.ndarray, begins: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in buffer[a:b]; words of neighbouring texts do not run together."""
    mark = B.SPACED[buf[a:b]]
    edge = np.zeros(b - a + 1, bool)
    edge[begins[(begins >= a) & (begins <= b)] - a] = True
    edge[0] = edge[-1] = True
    edge[1:-1] |= mark[1:] != mark[:-1]
    at = np.flatnonzero(edge)
    inside = mark[at[:-1]]
    return at[:-1][inside] + a, at[1:][inside] + a


def repeats(buf: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """How many words of each text repeat an earlier one, for texts numbered from 0 in ascending order. Hashes are sorted in
    each text and equal neighbours compared by their bytes; texts where those differ are counted word by word."""
    order = np.lexsort((hashed, text))
    one, two = order[:-1], order[1:]
    same = (hashed[one] == hashed[two]) & (text[one] == text[two])
    one, two = one[same], two[same]
    found = np.bincount(text[one], minlength=int(text[-1]) + 1 if len(text) else 0)
    wrong = (ends - starts)[one] != (ends - starts)[two]
    size = np.where(wrong, 0, (ends - starts)[one])
    stop = np.cumsum(size)
    low = 0
    while low < len(one):  # about a piece of bytes at a time
        high = max(int(np.searchsorted(stop, stop[low] - size[low] + PIECE, "right")), low + 1)
        n = size[low:high]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = buf[np.repeat(starts[one[low:high]], n) + inner] != buf[np.repeat(starts[two[low:high]], n) + inner]
        wrong[low:high] |= np.bincount(np.repeat(np.arange(high - low), n)[differ], minlength=high - low) > 0
        low = high
    for t in np.unique(text[one[wrong]]).tolist():
        mine = slice(*np.searchsorted(text, [t, t + 1]))
        words = [buf[s:e].tobytes() for s, e in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)]
        found[t] = len(words) - len(set(words))
    return found


def _counts(batches):
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in batches:
        texts, k = batch.column(2), batch.num_rows
        _, offsets, data = texts.buffers()
        begins = np.frombuffer(offsets, np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + k + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        found = []
        for a, b in pieces(buf, begins):
            starts, ends = word_edges(buf, begins, a, b)
            found.append((starts, ends, B.hashes(B.running(buf[a:b]), starts - a, ends - a)))
        starts, ends, hashed = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        text = np.searchsorted(begins, starts, "right") - 1
        n = np.bincount(text, minlength=k)
        again = repeats(buf, text, starts, ends, hashed)
        distinct = n - np.pad(again, (0, k - len(again)))
        digests = [hashlib.sha256(buf[a:b]).digest() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        longs = [n, distinct, *(class_counts(t, buf, begins) for t in (CAPITAL, SYMBOL, POINT))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in longs), pa.array(digests, pa.binary())], names)
    B.release()


def text_counts(docs: DataFrame) -> DataFrame:
    """A row per row of docs(doc_id, lang, text): doc_id, part, the counts that filters read, the text's digest."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return source.mapInArrow(_counts, COUNTS)


def fail_masks(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters that they fail (bit i: the i-th filter, the last bit: copies
    of a text), and how many of them are labelled good or toxic. Copies meet as counts: equal rows are counted before and
    after the shuffle, so a text that a third of all documents have is a few rows."""
    bits = sum((F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = text_counts(docs).select("doc_id", "part", "digest", bits.cast("int").alias("mask"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(flags, "doc_id", "left")
    kinds = ["digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    rows = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    same = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))  # rows of one text: one for each part and label
    stay = F.col("unnamed") + F.coalesce(F.when(F.col("low.doc_id") == first, F.col("low.n")), F.lit(0))
    copy = 1 << len(filters)
    both = F.array(F.struct("mask", F.col("stay").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    split = same.withColumn("stay", stay).select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters = [*filters, COPIES]
    masks = settle(fail_masks(docs, labels, filters))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bit = lambda c: F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(letters) for x in (name, 1 << i)]), c)
    steps = masks.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    before = F.aggregate(F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("at")), ""), F.lit(0), lambda acc, c: acc.bitwiseOR(F.coalesce(bit(c), F.lit(0))))
    steps = steps.select("*", bit(F.col("letter")).alias("bit"), before.alias("before"))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    each: Column = F.col("n") * F.expr(f"cast({math.factorial(len(letters))} div bit_count(mask) as bigint)")  # orders in which a failed filter comes first
    return steps.groupBy("part", "filter_order", (F.col("at") + 1).alias("step")).agg(
        count(~gone & ~fails).alias("kept"), count(~gone & fails).alias("removed"), count(gone & fails).alias("redundant"), count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(~gone & fails, "good").alias("good_lost"), count(~gone & fails, "toxic").alias("toxic_lost"), F.sum(F.when(fails, each).otherwise(0)).alias("shapley"),
    )
