"""Lexical retrieval packing into training sequences.

1. Tokens. Each task tokenises its documents and counts the documents of every term; the counts of all tasks are summed, so
   that document frequencies and the mean length are those of the whole corpus. (A vector of the vocabulary's size is all
   that is brought together.) A document's ids fill whole windows first; its tail is what is packed with others.
2. Shards. A tail goes to the shard of its rarest term that another document has too, wherever in the corpus it was read:
   documents that share rare terms meet. Terms are dealt to shards of about SHARD_IDS ids by the ids that they bring; a term
   that brings more has several shards.
3. Retrieval. In a shard's BM25 inverted index (with the corpus's frequencies) tails seed sequences in order: the index
   returns the unused tails that score best for the seed's rarest terms, and they fill the window greedily; the last one is
   cut to fit and its rest stays in the index, so only the last sequence of a shard is padded.

Tokenising is vectorised: the pattern of the byte-level vocabulary is applied to a buffer of code points by character
class, and every distinct piece is encoded once by the tokenizer.

Defined results: a null or empty text is the single id 0; equal documents are packed each; a repeated or null doc_id
is kept as it is; bytes that are no UTF-8 count as replacement characters; a very long text fills windows of its own but
for its tail; a shard's tails are taken in the order of doc_id and content, so the pieces do not depend on the order of
rows (the numbers of whole windows' sequences do, and so does which of several rows without doc_id meet); an empty table
gives no pieces; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, settle

WINDOW = 1024
#: Ids of a shard, about; they bound a task's memory to some 100 MB.
SHARD_IDS = 500_000
#: Rarest terms of a seed that query the index.
QUERY_TERMS = 24
K1, LENGTH_B = 1.2, 0.75
#: Distinct pieces that a worker remembers (a power of two), before it starts afresh.
CACHE_SLOTS = 1 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Fixed value: the vocabulary's special token.
SPECIAL = "<|endoftext|>"


def _classes() -> np.ndarray:
    """Character class of every code point: \\p{L}, \\p{N}, white space, other."""
    spaces = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    out[list(spaces)] = SPACE
    return out


class Encoder:
    """Ids of whole texts; equal to encoding each text with add_special_tokens=False."""

    _at: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary as bytes, for single pieces: the tokenizer's own call costs ten times as much for each
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token != SPECIAL}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _classes()
        self.keys = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 0x110000, dtype=np.uint64)
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._at:
            cls._at[path] = cls(path)
        return cls._at[path]

    def _forget(self, need: int = 0) -> None:
        """Start afresh, with room for as many pieces (those of a very long text may be more than CACHE_SLOTS)."""
        slots = max(CACHE_SLOTS, 1 << need.bit_length())
        self.known = 0
        self.table, self.numbers = np.zeros(4 * slots, np.uint64), np.zeros(4 * slots, np.int32)
        self.offsets, self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint32)
        self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 where unknown: linear probing of all keys at once."""
        mask = np.uint64(len(self.table) - 1)
        out, at, open_ = np.full(len(keys), -1, np.int64), (keys & mask).astype(np.int64), np.arange(len(keys))
        while len(open_):
            held = self.table[at]
            hit = held == keys[open_]
            out[open_[hit]] = self.numbers[at[hit]]
            more = ~hit & (held != 0)
            open_, at = open_[more], (at[more] + 1) & int(mask)
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = [self.piece(x.encode("utf-8", "surrogatepass")) for x in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        first, need = self.known, self.known + len(ids)
        if need > len(self.sizes):
            self.offsets, self.sizes = (np.resize(x, 2 * need) for x in (self.offsets, self.sizes))
        if self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(new)))
        self.sizes[first:need] = sizes
        self.offsets[first:need] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(new)] = new
        self.used, self.known = self.used + len(new), need
        mask = len(self.table) - 1
        at, numbers = (keys & np.uint64(mask)).astype(np.int64), np.arange(first, need)
        while len(keys):
            free = self.table[at] == 0
            self.table[at[free]] = keys[free]
            mine = self.table[at] == keys  # of those that wrote to one slot, the last
            self.numbers[at[mine]] = numbers[mine]
            keys, numbers, at = keys[~mine], numbers[~mine], (at[~mine] + 1) & mask

    def pieces(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pattern's matches; begins: where each text begins, and the end."""
        kind = self.classes[codes]
        first = np.zeros(len(codes) + 1, bool)
        first[begins] = True
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | first[:-1])
        ends = np.append(starts[1:], len(codes))
        space = kind[starts] == SPACE
        followed = np.append(~first[starts[1:]], False)  # by a run of the same text
        blank_end = codes[ends - 1] == 0x20
        leads = space & followed & blank_end  # its last blank belongs to the next run
        last = space & followed & ~blank_end  # its last character is a piece of its own
        head = np.where(leads | last, ends - 1, ends)
        from_ = starts.copy()
        from_[1:][leads[:-1]] -= 1
        short = np.flatnonzero((ends - starts == 1) & (codes[starts] == 0x27) & followed & (from_ == starts))
        short = short[kind[starts[np.minimum(short + 1, len(starts) - 1)]] == LETTER]
        if len(short):
            after = np.append(codes, [0, 0])
            one, two = after[ends[short]], after[ends[short] + 1]
            pair = (ends[short + 1] - starts[short + 1] >= 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0))
            head[short] += size
            from_[short + 1] += size
        all_from = np.concatenate([from_, (ends - 1)[last]])
        all_to = np.concatenate([head, ends[last]])
        some = all_to > all_from
        order = np.argsort(all_from[some], kind="stable")
        return all_from[some][order], all_to[some][order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if SPECIAL in t}
        plain = ["" if i in special else t for i, t in enumerate(texts)]
        whole = "".join(plain)
        begins = np.zeros(len(plain) + 1, np.int64)
        np.cumsum([len(t) for t in plain], out=begins[1:])
        if not whole:
            return [special.get(i, np.zeros(0, np.uint32)) for i in range(len(texts))]
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = self.pieces(codes, begins)
        up, down = B.powers(len(codes) + 1)
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self.keys[codes] * up[:-1], out=run[1:])
        numbers, distinct = pd.factorize(B.mixed((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        if self.known + len(distinct) > CACHE_SLOTS:
            self._forget(len(distinct))
        slots = self._find(distinct)
        new = np.flatnonzero(slots < 0)
        if len(new):
            at = np.flatnonzero(np.diff(np.maximum.accumulate(numbers), prepend=-1) > 0)[new]
            slots[new] = np.arange(self.known, self.known + len(new))
            self._learn(distinct[new], [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slots = slots[numbers]
        sizes = self.sizes[slots]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.offsets[slots] - after + sizes, sizes) + np.arange(after[-1])]
        cuts = np.append(0, after)[np.searchsorted(starts, begins)]
        return [special.get(i, ids[cuts[i] : cuts[i + 1]]) for i in range(len(texts))]


class Statistics(NamedTuple):
    """Of the whole corpus: documents of each term, documents, mean length of a tail."""

    df: np.ndarray
    docs: int
    mean: float


def statistics_of(tails: list[np.ndarray], vocabulary: int) -> Statistics:
    """The statistics of a corpus of just these tails."""
    df = np.zeros(vocabulary, np.int64)
    for t in tails:
        df[np.unique(t)] += 1
    return Statistics(df, len(tails), sum(map(len, tails)) / max(len(tails), 1))


class Bm25:
    """Inverted index of a shard's tails with BM25 weights in its postings."""

    def __init__(self, tails: list[np.ndarray], corpus: Statistics):
        sizes = np.array([len(t) for t in tails], np.int64)
        key = np.repeat(np.arange(len(tails), dtype=np.int64), sizes) + (np.concatenate([*tails, np.zeros(0, np.uint32)]).astype(np.int64) << 32)
        key, tf = np.unique(key, return_counts=True)
        term, self.docs = key >> 32, key & 0xFFFFFFFF
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        self.begins, here = edges[:-1], np.diff(edges)
        number = np.repeat(np.arange(len(here)), here)
        df = corpus.df[term]
        norm = K1 * (1 - LENGTH_B + LENGTH_B * sizes / max(corpus.mean, 1))
        self.weights = np.log(1 + (corpus.docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm[self.docs])
        # the query of each tail: its rarest terms among those that another tail has too
        shared = np.flatnonzero(here[number] > 1)
        order = shared[np.lexsort((number[shared], df[shared], self.docs[shared]))]
        owner = self.docs[order]
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)
        chosen = order[rank < QUERY_TERMS]
        self.queries = np.split(number[chosen], np.searchsorted(self.docs[chosen], np.arange(1, max(len(tails), 1))))
        self.ends, self.n = self.begins + here, len(tails)

    def neighbours(self, seed: int, unused: np.ndarray):
        """Unused tails that share a query term, best first (ties: the earlier one); they are sorted as far as asked for."""
        spans = [slice(self.begins[t], self.ends[t]) for t in self.queries[seed].tolist()]
        if not spans:
            return
        scores = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        scores *= unused
        scores[seed] = 0
        found = np.flatnonzero(scores)
        ranks = -scores[found]
        while len(found):
            some = ranks <= (np.partition(ranks, 15)[15] if len(ranks) > 16 else np.inf)
            yield from found[some][np.argsort(ranks[some], kind="stable")].tolist()
            found, ranks = found[~some], ranks[~some]


def pack_tails(tails: list[np.ndarray], corpus: Statistics, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(tail, start, length, sequence, offset) of every piece."""
    out, sequence, index = [], 0, Bm25(tails, corpus)
    begun, left, unused = [0] * len(tails), [len(t) for t in tails], np.ones(len(tails))
    spare = 0  # tails before it are used up

    def put(tail: int, offset: int) -> int:
        size = min(left[tail], window - offset)
        out.append((tail, begun[tail], size, sequence, offset))
        begun[tail] += size
        left[tail] -= size
        if not left[tail]:
            unused[tail] = 0
        return offset + size

    while True:
        while spare < len(tails) and not left[spare]:
            spare += 1
        if spare == len(tails):
            return out
        offset = put(spare, 0)
        for tail in index.neighbours(spare, unused):
            if offset == window:
                break
            if left[tail]:
                offset = put(tail, offset)
        fill = spare
        while offset < window and fill < len(tails):
            if left[fill]:
                offset = put(fill, offset)
            else:
                fill += 1
        sequence += 1


TOKENS = "doc_id long, n long, ids binary, counts binary"
TAILS = "doc_id long, n long, key int, ids binary"
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of whole windows have numbers from here on.
WHOLE = 1 << 62


def _tokens(path: str, kind: str):
    """Per document its number of ids and the ids; per task one row with the documents of each term."""

    def run(batches):
        encoder = Encoder.of(path)
        df = np.zeros(encoder.tokenizer.get_vocab_size(), np.int64)
        names = [x.split()[0] for x in TOKENS.split(", ")]
        for docs, bodies in B.chunks(batches, 2, 750_000):
            ids = [np.append(x, np.uint32(0)) for x in encoder.encode([b.decode(errors="replace") for b in bodies])]
            for x in ids:
                df[np.unique(x)] += 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()), pa.nulls(n, pa.binary())], names)
        encoder._forget()  # the worker serves other stages next
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.tobytes()], pa.binary())], names)

    return run


def _summed(batches):
    total = sum(np.frombuffer(x, np.int64) for batch in batches for x in batch.column(0).to_pylist())
    if not isinstance(total, int):
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])


def _keys(corpus, kind: str):
    """Tails with their key: the rarest term that another document has too, -1 without one."""

    def run(batches):
        df = corpus.value.df
        for batch in batches:
            keys = []
            for x in batch.column(2).to_pylist():
                terms = np.unique(np.frombuffer(x, kind))
                terms = terms[df[terms] > 1]
                keys.append(int(terms[df[terms].argmin()]) if len(terms) else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int32()), batch.column(2)], [x.split()[0] for x in TAILS.split(", ")])

    return run


def _whole(window: int, kind: str, with_ids: bool):
    """The pieces of whole windows."""

    def run(batches):
        sequence = WHOLE + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            rows, parts = [], []
            for doc, n, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(ids, kind).astype("<u4")
                for start in range(0, n - window + 1, window):
                    part = ids[start : start + window]
                    rows.append((doc, start, window, zlib.crc32(part.tobytes()), n, sequence, 0))
                    parts.append(part)
                    sequence += 1
            yield _pieces(rows, parts, with_ids)

    return run


def _shard(corpus, window: int, kind: str, with_ids: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[2]), r[1], r[2]))
        docs, sizes = [r[0] for r in found], [r[1] for r in found]
        tails = [np.frombuffer(r[2], kind).astype("<u4") for r in found]
        base, rows, parts = key[0].as_py() << 32, [], []
        for tail, start, length, sequence, offset in pack_tails(tails, corpus.value, window):
            part = tails[tail][start : start + length]
            rows.append((docs[tail], sizes[tail] // window * window + start, length, zlib.crc32(part.tobytes()), sizes[tail], base + sequence, offset))
            parts.append(part)
        return pa.Table.from_batches([_pieces(rows, parts, with_ids)])

    return run


def _pieces(rows: list[tuple], parts: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
    if with_ids:
        arrays.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)


def _dealt(sizes: dict[int, int], shard_ids: int) -> list[tuple[int, int, int]]:
    """(key, first shard, shards) from the ids that each key brings: keys share a shard until it is full, a larger one has its own."""
    out, shard, filled = [], 0, 0
    for key, size in sorted(sizes.items()):
        if filled and filled + size > shard_ids:
            shard, filled = shard + 1, 0
        n = max(-(-size // shard_ids), 1)
        out.append((key, shard, n))
        shard, filled = (shard, filled + size) if n == 1 else (shard + n, 0)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    tokens = settle(source.mapInArrow(_tokens(tokenizer, kind), TOKENS))
    df = np.zeros(vocabulary, np.int64)
    for term, n in tokens.where("ids is null").select("counts").mapInArrow(_summed, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # the vocabulary at most
        df[term] = n
    tail, has = (F.col("n") % window).cast("int"), tokens.where("ids is not null")
    count, mean = has.agg(F.count("*"), F.avg(F.when(tail > 0, tail))).first()
    corpus = spark.sparkContext.broadcast(Statistics(df, count, float(mean or 0)))
    tails = has.where(tail > 0).select("doc_id", "n", F.substring("ids", ((F.col("n") - tail) * width + 1).cast("int"), tail * width).alias("ids")).mapInArrow(_keys(corpus, kind), TAILS)
    tails = settle(tails)
    sizes = tails.groupBy("key").agg(F.sum(tail).alias("size")).collect()  # the vocabulary at most
    shards = F.broadcast(spark.createDataFrame(_dealt({r["key"]: r["size"] for r in sizes}, shard_ids), "key int, first long, shards long"))
    dealt = tails.join(shards, "key").select((F.col("first") + F.pmod(F.xxhash64("doc_id", F.crc32("ids"), "n", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.col("shards"))).alias("shard"), "doc_id", "n", "ids")
    schema = COLUMNS + (", ids array<int>" if with_ids else "")
    whole = has.where(F.col("n") >= window).select("doc_id", "n", "ids").mapInArrow(_whole(window, kind, with_ids), schema)
    return whole.unionByName(dealt.groupBy("shard").applyInArrow(_shard(corpus, window, kind, with_ids), schema))
