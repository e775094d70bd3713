"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios and counts of the whole text. Cyclic boosting visits one feature after the other and fits a shallow
tree (three leaves) on its bins to the logistic residuals; the trees add up to one lookup table a feature. The pairs with
the largest gain on the remaining residuals get tables of their own in the same way. Scoring is a sum of table entries,
vectorised over bins. Only labelled rows outside the held-out fold are learnt from, at most TRAIN_ROWS of them (those
with the smallest hashes of doc_id); features are made, and scores given, for all rows.

Defined results: a null or empty text has zero features and is scored like any other; repeated rows get equal scores;
labels of a document that disagree are averaged; null labels are not used; without labels of both kinds every score is the
mean label (1 without any); a null doc_id is not held out; features are of the whole of a very long text; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, settle

TRAIN_ROWS, BINS, ROUNDS, PAIRS, PAIR_BINS, PAIR_ROUNDS, RATE, LEAST_LEAF = 20_000, 32, 120, 6, 8, 60, 0.15, 5
BYTE_CLASSES = ("upper", "lower", "digit", "space", "break", "bang", "bar", "mark", "point", "high", "rest")
FEATURES = ("log_bytes", "log_words", "word_size", "word_spread", *(f"{c}_share" for c in BYTE_CLASSES), "distinct_words", "distinct_pairs", "repeats", "line_words", "distinct_lines")


def _byte_class() -> np.ndarray:
    out = np.full(256, BYTE_CLASSES.index("rest"), np.int64)
    for name, some in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", [9, 11, 12, 13, 32]), ("break", [10]), ("bang", b"!?"), ("bar", b"|"), ("mark", b"#$%&*@^~<>{}[]\\=+_"), ("point", b".,;:'\"-()/"), ("high", range(128, 256))):
        out[list(some)] = BYTE_CLASSES.index(name)
    return out


BYTE_CLASS = _byte_class()


def features(bodies: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    buf, begins = B.joined(bodies)
    sizes = np.diff(begins) - 1
    n, k = len(bodies), len(BYTE_CLASSES)
    doc = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(doc * k + BYTE_CLASS[raw], minlength=n * k).reshape(n, k).astype(float)
    counts[:, BYTE_CLASSES.index("break")] -= 1
    starts, ends, first = B.words(buf, begins, B.SPACED)
    hashed, words = B.hashes(B.running(buf), starts, ends), np.diff(first)
    some = np.maximum(words, 1)
    lengths = np.append(0, np.cumsum(ends - starts))
    squares = np.append(0, np.cumsum((ends - starts) ** 2))
    mean = (lengths[first[1:]] - lengths[first[:-1]]) / some
    spread = np.sqrt(np.maximum((squares[first[1:]] - squares[first[:-1]]) / some - mean**2, 0))
    pairs = hashed[:-1] * B.SHINGLE_KEYS[0] + hashed[1:] if len(hashed) else hashed
    again = np.append(0, np.cumsum(hashed[:-1] == hashed[1:])) if len(hashed) else np.zeros(1, np.int64)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log1p(sizes), np.log1p(words), mean, spread
    out[:, 4 : 4 + k] = counts / np.maximum(sizes, 1)[:, None]
    at = 4 + k
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            out[i, at] = len(np.unique(hashed[a:b])) / (b - a)
            out[i, at + 1] = len(np.unique(pairs[a : b - 1])) / (b - 1 - a) if b - a > 1 else 1
            out[i, at + 2] = (again[b - 1] - again[a]) / (b - a)
        lines = bodies[i].split(b"\n")
        out[i, at + 3], out[i, at + 4] = (b - a) / len(lines), len(set(lines)) / len(lines)
    return out


def _featured(batches):
    for ids, bodies in B.chunks(batches, 2, 750_000):
        x = features(bodies).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])


def _tree(gain: np.ndarray, weight: np.ndarray, count: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree of up to so many leaves over ordered bins, from each bin's sums."""
    cuts = [0, len(gain)]
    g, w, c = (np.append(0, np.cumsum(x)) for x in (gain, weight, count))
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = np.arange(a + 1, b)
            m = m[(c[m] - c[a] >= LEAST_LEAF) & (c[b] - c[m] >= LEAST_LEAF)]
            if len(m):
                won = value(a, m) + value(m, b) - value(a, b)
                if won.max() > best:
                    best, where = won.max(), int(m[won.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(gain))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


class AdditiveModel:
    """edges and tables of the features, pair tables on coarser bins, and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.bias = 20.0 if not len(y) else float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        if not len(y) or y.min() == y.max():
            self.edges = [np.zeros(0)] * len(FEATURES)
            self.tables = [np.zeros(1)] * len(FEATURES)
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = self._bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        f = np.full(len(y), self.bias)
        sums = lambda at, size, p: (np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size), np.bincount(at, minlength=size))
        p = 1 / (1 + np.exp(-f))
        for _ in range(ROUNDS):
            for j, table in enumerate(self.tables):
                step = RATE * _tree(*sums(bins[j], len(table), p), 3)
                table += step
                f += step[bins[j]]
                p = 1 / (1 + np.exp(-f))
        coarse = self._coarse(bins)
        ranked = []
        for a in range(len(FEATURES)):
            for b in range(a):
                g, w, _ = sums(coarse[a] * PAIR_BINS + coarse[b], PAIR_BINS**2, p)
                ranked.append((-float((g**2 / (w + 1)).sum()), a, b))
        self.pairs = [(a, b, np.zeros(PAIR_BINS**2)) for _, a, b in sorted(ranked)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, b, table in self.pairs:
                at = coarse[a] * PAIR_BINS + coarse[b]
                g, w, c = (s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(at, PAIR_BINS**2, p))
                upper = np.arange(PAIR_BINS) > np.argmax(np.abs(_tree(g.sum(1), w.sum(1), c.sum(1), 2)[1:] - _tree(g.sum(1), w.sum(1), c.sum(1), 2)[:-1]))
                step = np.zeros((PAIR_BINS, PAIR_BINS))
                for side in (upper, ~upper):
                    step[side] = RATE * _tree(g[side].sum(0), w[side].sum(0), c[side].sum(0), 2)
                table += step.ravel()
                f += step.ravel()[at]
                p = 1 / (1 + np.exp(-f))

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def _coarse(self, bins: list[np.ndarray]) -> list[np.ndarray]:
        return [b * PAIR_BINS // (len(e) + 1) for b, e in zip(bins, self.edges, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        f = self.bias + sum(t[b] for t, b in zip(self.tables, bins, strict=True))
        coarse = self._coarse(bins)
        for a, b, table in self.pairs:
            f = f + table[coarse[a] * PAIR_BINS + coarse[b]]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    arrow_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    featured = settle(source.mapInArrow(_featured, "doc_id long, x array<float>"))
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    train = settle(featured.join(marks.where(~held_out(F.col("doc_id"))), "doc_id"))
    rows = train.count()
    if rows > train_rows:  # hashes are even: about 1.2 times as many rows lie below this one, so tasks send no more to be sorted
        train = train.where(F.xxhash64("doc_id") <= int(-(2**63) + min(1.2 * train_rows / rows, 0.999) * 2**64))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    model = AdditiveModel(np.array([r["x"] for r in train], np.float64).reshape(len(train), len(FEATURES)), np.array([r["y"] for r in train], np.float64))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = featured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
