"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets are the distinct 5-word shingles of a document (64-bit hashes); two documents link at a similarity of 0.75.

1. Shingles that many documents share are counted in each chunk of texts and summed; the order of all shingles is by
   this frequency class, then by hash, so that prefixes hold rare shingles. (The counts shape the order only.)
2. A document's prefix are its n - ceil(0.75 n) + l first shingles; a pair must share l of them. Each document takes the
   l from 1 to 4 of least estimated candidate cost: the frequencies in its prefix, divided by what l matches prune,
   plus the postings that are sent. A pair uses the smaller l of its two documents.
3. Prefix postings meet in buckets; of shingles that two documents share the postings stay. Frequent shingles are salted
   over the buckets, for they need no meeting.
4. Each shingle's smallest document is linked to the others first (those that lengths and positions allow), the pairs
   are verified, and components found. Links inside a component would add nothing to it: of a shingle's documents the
   largest component is its host, and only the others (guests) meet all documents of other components, so large groups of
   near copies are never expanded into all pairs, and no link between components is lost. Before that, guests meet a few
   documents of the host, chosen by hash; those that link with one are guests no more.
5. Guests and the documents that they meet carry parity bitmaps of their sets, at most BRIEF bits each. A bitmap bounds
   the difference of two sets from below, so a pair that cannot be similar leaves no row behind. Pairs that share l prefix
   shingles are verified: by whole bitmaps, then by whole sets.

Equal sets are one class from the start, represented by the smallest doc_id.

Defined results: a text without words (or null) has no shingles and links with nothing; with fewer than five words the
whole sequence is one shingle; rows that repeat a doc_id are one document (linked through any of their texts); a row
without doc_id gets its n_shingles and no component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, components, settle, sized, tidy

SHINGLE, MOST_MATCHES = 5, 4
#: A shingle is frequent if this many different sets of one chunk of texts have it.
FREQUENT = 2
#: Frequent shingles that shape the order, at most (at 9 bytes each in every task): whole frequency classes from the top.
ORDERED = 1 << 20
CLASS_BITS = np.uint64(6)
#: Bytes of texts that a task hashes at a time, and within which shingles are counted.
CHUNK_BYTES, COUNT_BYTES = 750_000, 4_000_000
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4"), ("need", "<i4")])
FINISH = np.uint64(0xD6E8FEB86659FD93)
#: Sets that a task remembers to have sent, at some 80 bytes each; beyond them equal sets are sent again.
REMEMBERED = 250_000
#: Bytes of postings that meet in one bucket, on average.
BUCKET_BYTES = 2_000_000
#: Bits of a document's bitmap in the join of guests (a power of two); whole bitmaps follow for the pairs that are left.
BRIEF = 1024
#: Documents of a shingle's largest group that its guests meet before they meet all.
ENVOYS = 4


def shingles(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, and where each text's shingles begin (and the end)."""
    buf, begins = B.joined(bodies)
    starts, ends, first = B.words(buf, begins, B.SPACED)
    hashed = B.hashes(B.running(buf), starts, ends)
    count = np.diff(first)
    whole = np.zeros(max(len(hashed) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        whole += hashed[j : j + len(whole)] * B.SHINGLE_KEYS[j]
    sizes = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    out_begins = np.append(0, np.cumsum(sizes))
    at = np.repeat(first[:-1] - out_begins[:-1], sizes) + np.arange(out_begins[-1])
    out = whole[np.minimum(at, len(whole) - 1)] if len(whole) else np.zeros(len(at), np.uint64)
    for doc in np.flatnonzero((count > 0) & (count < SHINGLE)).tolist():
        words = hashed[first[doc] : first[doc + 1]]
        out[out_begins[doc]] = np.uint64((sum(int(w) * int(k) for w, k in zip(words, B.SHINGLE_KEYS[SHINGLE:], strict=False)) + len(words)) % 2**64)
    return B.mixed(out), out_begins


def ordered(hashed: np.ndarray, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens whose numeric order is the global one: frequency class in the high bits, then the hash."""
    out = hashed >> CLASS_BITS
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashed), len(frequent) - 1)
        out |= np.where(frequent[at] == hashed, classes[at].astype(np.uint64), np.uint64(0)) << (np.uint64(64) - CLASS_BITS)
    return out


SETS = "doc_id long, n long, s1 long, s2 long, tokens binary, counts binary"


def _sets(batches):
    """A row per document (size and 128-bit hash of its set), and per COUNT_BYTES of texts one row with their frequent shingles."""
    names = [x.split()[0] for x in SETS.split(", ")]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0

    def counted() -> pa.RecordBatch:
        one = np.sort(np.concatenate([*held.values(), np.zeros(0, np.uint64)]))
        edge = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(one)))
        tokens, count = one[edge][count >= FREQUENT], count[count >= FREQUENT].astype(np.int32)
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([tokens.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names)

    for ids, bodies in B.chunks(batches, 2, CHUNK_BYTES):
        hashed, begins = shingles(bodies)
        parts = [np.unique(hashed[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        sums = [(int(p.sum()), int((p ^ (p >> np.uint64(7)) * FINISH).sum())) for p in parts]
        k = len(ids)
        cols = [pa.array(ids, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), *(pa.array([signed(x[i] % 2**64) for x in sums], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
        held |= zip(sums, parts, strict=True)
        size += sum(map(len, bodies))
        if size >= COUNT_BYTES:
            yield counted()
            held, size = {}, 0
    if held:
        yield counted()


def _frequent(batches):
    for batch in batches:
        for tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, np.int64)), pa.array(np.frombuffer(counts, np.int32).astype(np.int64))], ["token", "n"])


def prefix(tokens: np.ndarray, cost: np.ndarray) -> tuple[int, int]:
    """Prefix length and number of matches of one document; cost: estimated candidates of each of its tokens."""
    n = len(tokens)
    base = n - (3 * n + 3) // 4
    total = np.cumsum(cost[: base + MOST_MATCHES])
    best = min(range(1, min(MOST_MATCHES, n - base) + 1), key=lambda m: (total[base + m - 1] / m**2 + m - 1, m))
    return base + best, best


SENT = "bucket int, postings binary"


def _postings(frequent, buckets: int):
    def run(batches):
        tokens, classes = frequent.value
        seen: set[bytes] = set()
        for salt, (ids, bodies) in enumerate(B.chunks(batches, 2, CHUNK_BYTES)):
            hashed, begins = shingles(bodies)
            hashed = ordered(hashed, tokens, classes)
            some = []
            for doc, a, b in zip(ids, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                if doc is None or a == b:
                    continue
                one = np.unique(hashed[a:b])
                key = np.array([one.sum(), (one * FINISH ^ one >> np.uint64(9)).sum()], np.uint64).tobytes()
                if key in seen:  # an equal set of this task was sent
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                short = one[: len(one) - (3 * len(one) + 3) // 4 + MOST_MATCHES]
                size, need = prefix(one, np.left_shift(1, (short >> (np.uint64(64) - CLASS_BITS)).astype(np.int64)) - 1)
                rows = np.empty(size, POSTING)
                rows["token"], rows["doc"], rows["n"], rows["at"], rows["need"] = one[:size], doc, len(one), np.arange(size), need
                some.append(rows)
            if not some:
                continue
            rows = np.concatenate(some)
            bucket = B.mixed(rows["token"] + np.where(rows["token"] >> (np.uint64(64) - CLASS_BITS) > 0, np.uint64(salt), np.uint64(0)))
            bucket = (bucket % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), pa.array([x.tobytes() for x in np.split(rows, edges[1:])], pa.binary())], ["bucket", "postings"])

    return run


MET = "token long, doc long, n int, at int, need int"


def _meet(table: pa.Table) -> pa.Table:
    """The postings of one bucket whose token another document has too, or is frequent."""
    rows = np.concatenate([np.frombuffer(x, POSTING) for x in table.column("postings").to_pylist()])
    rows = rows[np.argsort(rows["token"], kind="stable")]
    same = rows["token"][1:] == rows["token"][:-1]
    many = rows["token"] >> (np.uint64(64) - CLASS_BITS) > 0
    many[1:] |= same
    many[:-1] |= same
    rows = rows[many]
    return pa.table({"token": rows["token"].view(np.int64) if rows["token"].flags.c_contiguous else np.ascontiguousarray(rows["token"]).view(np.int64), **{c: np.ascontiguousarray(rows[c]) for c in ("doc", "n", "at", "need")}})


def _token_lists(batches):
    for ids, bodies in B.chunks(batches, 2, CHUNK_BYTES):
        hashed, begins = shingles(bodies)
        parts = [np.unique(hashed[a:b]).view(np.int64) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32), np.concatenate(parts))], ["doc", "tokens"])


def fits(a: str, b: str, need: Column):
    """Whether lengths and positions allow that a token is one of the first need shared ones of a similar pair: columns n
    and at of the tables a and b. Before such a token they share need - 1 others at most, whatever its positions are, so
    all of a pair's first need matches pass, and texts that only have a frequent passage in common do not meet."""
    n1, n2, at1, at2 = (F.col(f"{t}.{c}") for c in ("n", "at") for t in (a, b))
    reach = F.least(at1, at2, need - 1) + F.least(n1 - at1, n2 - at2)
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * reach >= 3 * (n1 + n2))


BITS = "doc long, n int, bits array<long>, brief array<long>"


def _bits(batches):
    """Per document the size of its set and a bitmap: which of some buckets (a power of two, at least four times the size) hold an odd
    number of its shingles; brief is the same, folded to BRIEF bits at most."""
    for ids, bodies in B.chunks(batches, 2, CHUNK_BYTES):
        hashed, begins = shingles(bodies)
        sizes, maps, briefs = [], [], []
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            one = np.unique(hashed[a:b])
            width = max(256, 4 << max(len(one) - 1, 0).bit_length())
            odd = np.bincount((one & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
            sizes.append(len(one))
            for out, some in ((maps, odd), (briefs, np.bitwise_xor.reduce(odd.reshape(-1, min(width, BRIEF))))):
                out.append(np.packbits(some.astype(np.uint8), bitorder="little").view(np.int64))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(maps, kind), pa.array(briefs, kind)], ["doc", "n", "bits", "brief"])


def _differ_at_most(one: str, two: str) -> Column:
    """A lower bound of the number of shingles that just one of two sets has, from their bitmaps (the wider one folded)."""
    x, y = F.col(one), F.col(two)
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda c: F.zip_with(F.slice(c, 1, (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2).cast("int") + 1, (F.size(c) / 2).cast("int")), xor)
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda acc, w: acc + F.bit_count(w))


def _of_documents(source: DataFrame, ids: DataFrame) -> DataFrame:
    return source.join(sized(settle(ids.distinct())), "doc", "left_semi").select("doc", "body")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).union(pairs.select("b"))


def verified(source: DataFrame, pairs: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of documents whose sets are similar enough. Bitmaps of half a byte a shingle or more rule out
    almost all others (they bound the difference of two sets, so no link is lost); whole sets are compared of the rest."""
    maps = maps or settle(_of_documents(source, _ends(pairs)).mapInArrow(_bits, BITS))
    one, two = (maps.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"m{x}")) for x in "ab")
    close = settle(pairs.join(one, "a").join(two, "b").where(7 * _differ_at_most("ma", "mb") <= F.col("na") + F.col("nb")).select("a", "b").distinct())
    sets = settle(_of_documents(source, _ends(close)).mapInArrow(_token_lists, "doc long, tokens array<long>"))
    one, two = (sets.select(F.col("doc").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    common = F.size(F.array_intersect("ta", "tb"))
    return close.join(one, "a").join(two, "b").where(7 * common >= 3 * (F.size("ta") + F.size("tb"))).select("a", "b").distinct()


def _order(spark: SparkSession, sets: DataFrame):
    """Sorted frequent shingles and their frequency classes (the logarithm of the count), broadcast: ORDERED at most."""
    rows = sets.where("tokens is not null").select("tokens", "counts").mapInArrow(_frequent, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = settle(rows.select("token", F.least(F.floor(F.log2("n")), F.lit(63)).cast("byte").alias("class")))
    least, held = 64, 0
    for r in sorted(rows.groupBy("class").count().collect(), reverse=True):
        held += r["count"]
        if held > ORDERED:
            break
        least = r["class"]
    top = rows.where(F.col("class") >= least).toPandas().sort_values("token", key=lambda t: t.to_numpy(np.int64).view(np.uint64))
    return spark.sparkContext.broadcast((top["token"].to_numpy(np.int64).view(np.uint64), top["class"].to_numpy(np.uint8)))


def _open(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """token, doc, n, at, need, group of the postings whose shingle documents of more than one group have; groups: id, component."""
    wide = settle(posts.join(groups, posts["doc"] == groups["id"], "left").select("token", "doc", "n", "at", "need", F.coalesce("component", "doc").alias("group")))
    mixed = wide.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token")
    return settle(wide.join(mixed, "token", "left_semi"))


def _hosts(posts: DataFrame) -> DataFrame:
    """token, host: the largest group of each shingle."""
    sizes = posts.groupBy("token", "group").agg(F.count("*").alias("size"))
    return settle(sizes.groupBy("token").agg(F.max_by("group", F.struct("size", "group")).alias("host")))


def _with_envoys(posts: DataFrame) -> DataFrame:
    """Pairs (a, b) of guests with ENVOYS documents of their shingle's host. A guest that is linked with many of a group's documents,
    only not with its hub, is almost sure to join the group here, so that it need not meet them all."""
    marked = posts.join(_hosts(posts), "token")
    envoy = lambda i: F.min(F.struct(F.xxhash64(F.lit(i), "doc").alias("h"), "doc", "n", "at"))
    envoys = marked.where("group = host").groupBy("token").agg(F.array_distinct(F.array(*[envoy(i) for i in range(ENVOYS)])).alias("envoys"))
    met = marked.where("group <> host").alias("p").join(envoys.select("token", F.explode("envoys").alias("h")).select("token", "h.doc", "h.n", "h.at").alias("h"), "token")
    return met.where(fits("p", "h", F.col("p.need"))).select(F.least("p.doc", "h.doc").alias("a"), F.greatest("p.doc", "h.doc").alias("b")).distinct()


def _between(posts: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different groups that share enough of their prefixes; posts: token, doc, n, at, need,
    group of the shingles that more than one group has; maps: the documents' bitmaps.

    All pairs of different groups hold a guest, that is a document outside the largest group of the shingle. Guests meet
    the others, so what is compared grows with guests times documents, not with the square of the largest group; only
    pairs that lengths, positions and bitmaps leave open make rows."""
    marked = posts.join(_hosts(posts), "token").select("token", "doc", "n", "at", "need", "group", (F.col("group") != F.col("host")).alias("guest"))
    marked = settle(marked.join(maps.select("doc", "brief"), "doc"))
    need = F.least("p.need", "q.need")
    met = marked.where("guest").alias("p").join(marked.alias("q"), "token")
    met = met.where("p.`group` <> q.`group` and (not q.guest or p.doc < q.doc)").where(fits("p", "q", need))
    base = lambda t: F.col(f"{t}.n") - F.floor((3 * F.col(f"{t}.n") + 3) / 4)
    met = met.where((F.col("p.at") < base("p") + need) & (F.col("q.at") < base("q") + need))
    met = met.where(7 * _differ_at_most("p.brief", "q.brief") <= F.col("p.n") + F.col("q.n"))
    pairs = met.groupBy(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).agg(F.count("*").alias("matches"), F.min(need).alias("need"))
    return pairs.where("matches >= need").select("a", "b")


def ngram_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    arrow_batches(spark)
    tidy(spark)  # this operator runs many jobs
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    sets = settle(source.mapInArrow(_sets, SETS))
    rows = sets.where("tokens is null").select("doc_id", "n", "s1", "s2")
    sent = rows.agg(F.sum(F.col("n") / 4 + MOST_MATCHES)).first()[0] or 0
    buckets = max(int(sent * POSTING.itemsize / BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = source.mapInArrow(_postings(_order(spark, sets), buckets), SENT)
    posts = settle(sent.groupBy("bucket").applyInArrow(_meet, MET))

    classes = settle(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    # documents under which a set was sent, and the representative of the set
    known = settle(posts.select(F.col("doc").alias("doc_id")).distinct().join(rows, "doc_id").join(classes, ["s1", "s2", "n"]).select(F.col("doc_id").alias("doc"), "rep").distinct())
    posts = settle(posts.join(known, "doc").select("token", F.col("rep").alias("doc"), "n", "at", "need").distinct())

    hubs = posts.groupBy("token").agg(F.min(F.struct("doc", "n", "at")).alias("h"), F.count("*").alias("m")).where("m > 1").select("token", "h.doc", "h.n", "h.at", "m")
    hubs = settle(hubs)
    pair = lambda on: posts.alias("p").join(on.alias("h"), "token").where(F.col("p.doc") != F.col("h.doc")).where(fits("p", "h", F.col("p.need")))
    stars = settle(pair(hubs).select(F.least("p.doc", "h.doc").alias("a"), F.greatest("p.doc", "h.doc").alias("b")).distinct())
    links = settle(verified(source, stars))
    groups = components(links)

    tidy(spark)
    open_ = _open(posts.join(hubs.where("m > 2").select("token"), "token", "left_semi"), groups)
    maps = settle(_of_documents(source, open_.select("doc")).mapInArrow(_bits, BITS))
    some = settle(_with_envoys(open_).join(stars, ["a", "b"], "left_anti"))
    joined = lambda groups, pairs: components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(verified(source, pairs, maps)))
    groups = joined(groups, some)
    tidy(spark)
    open_ = _open(open_.drop("group"), groups)
    pairs = settle(_between(open_, maps).join(stars.union(some), ["a", "b"], "left_anti"))
    groups = settle(joined(groups, pairs))

    labelled = settle(classes.join(groups, classes["rep"] == groups["id"], "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id")))
    return rows.join(labelled, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
