"""Filter audit and resampling against brute-force versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import SCHEMA, corpus, table


@pytest.fixture(scope="module")
def docs():
    rows = [(d, t, lang if d is None or d % 3 else None, s) for d, t, lang, s in corpus(11, 60)]
    words = " ".join(f"w{i % 150}" for i in range(400))
    return [*rows, (600, words, "en", "x"), (601, words + " # 5", "de", "x"), (602, "ABC DEF " * 150, "de", "x"), (603, words, "", "x"), (603, words, "", "x"), (604, " ".join(f"v{i}" for i in range(300)), "de", "x"), (605, "é" * 9000, "en", "y")]


LABELS = "doc_id long, quality int, toxic int, text string"


def labels_of(docs):
    ids = sorted({d for d, *_ in docs if d is not None})
    return [(d, d % 2, (d // 2) % 2, "x") for d in ids[::2]] + [(603, 1, 0, "x"), (603, 0, 1, "x"), (None, 1, 1, "x"), (9999, 1, 1, "x"), (600, None, None, "x")]


def brute_audit(docs, labels):
    good, toxic = {d for d, q, _, _ in labels if q == 1 and d is not None}, {d for d, _, t, _ in labels if t == 1 and d is not None}
    least = defaultdict(lambda: 10**12)
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(least[text or ""], d)
    rows = []
    for d, text, lang, *_ in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and least[text] < d}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [r for r in mine if not r[1] & before and f in r[1]]
                total[f] += len(gone)
                out[part, order, step] = [sum(not r[1] & {*before, f} for r in mine), len(gone), sum(bool(r[1] & before) and f in r[1] for r in mine), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = total[out[key][6]]
    return out


def test_filter_audit(spark, docs):
    from quillfact.llm.filter_audit import audit

    labels = labels_of(docs)
    got = audit(table(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({x[2] or "" for x in docs})
    assert audit(table(spark, docs).limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    none = audit(table(spark, docs), spark.createDataFrame([], LABELS))
    assert none.where("good_lost + toxic_lost > 0").count() == 0 and none.count() == len(got)


def test_filter_audit_pieces(monkeypatch):
    from quillfact.llm import bytetext as B
    from quillfact.llm import filter_audit as A

    monkeypatch.setattr(A, "PIECE", 7)
    texts = [b"", b"one two one", b"a-word-longer-than-a-piece another", b"x", b"", b" \t", "é é éé".encode(), b"one"]
    buf, begins = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    cut = list(A.pieces(buf, begins, 7))
    assert cut[0][0] == 0 and cut[-1][1] == len(buf) and all(a[1] == b[0] for a, b in itertools.pairwise(cut))
    starts, ends = (np.concatenate(x) for x in zip(*(A.word_edges(buf, begins, a, b) for a, b in cut), strict=True))
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0d]+", t)]
    assert [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == words
    assert A.class_counts(A.POINT, buf, begins).tolist() == [len(t.decode()) for t in texts]
    text = np.searchsorted(begins, starts, "right") - 1
    for hashed in (B.hashes(B.running(buf), starts, ends), np.zeros(len(starts), np.uint64), (ends - starts).astype(np.uint64)):  # equal hashes of other words are found out
        again = A.repeats(buf, text, starts, ends, hashed)
        assert np.pad(again, (0, len(texts) - len(again))).tolist() == [len(w) - len(set(w)) for w in (re.findall(rb"[^\x20\x09-\x0d]+", t) for t in texts)]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_resample(docs, targets, share=25):
    features = [(w := words_of(t)) + [f"{a} {b}" for a, b in itertools.pairwise(w)] for _, t, *_ in docs]
    s, t = Counter(), Counter()
    for out, some in ((s, features), (t, [(w := words_of(x)) + [f"{a} {b}" for a, b in itertools.pairwise(w)] for x in targets])):
        for f in itertools.chain(*some):
            out[zlib.crc32(f.encode()) % 10000] += 1
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for (d, text, *_), f in zip(docs, features, strict=True):
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        h = None if d is None else int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for i, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [4_000_000, 3000])
def test_resampling(spark, docs, chunk, monkeypatch):
    from quillfact.llm import resampling as R

    targets = [docs[0][1], "w1 w2 w3 " * 40, None, "", "Ünï Ab-ab ab"]
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(targets)], "item_id int, text string")
    if chunk < 10_000:
        monkeypatch.setattr(R, "SHARD_BYTES", chunk)
        monkeypatch.setattr(R, "SLICES", 2)
    out = R.resample(table(spark, docs), bench)
    got = sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == brute_resample(docs, targets)


def test_resampling_edges(spark, docs):
    from quillfact.llm.resampling import resample

    bench = spark.createDataFrame([(1, "w1 w2")], "item_id int, text string")
    assert resample(table(spark, docs).limit(0), bench).count() == 0
    out = resample(table(spark, docs), bench.limit(0), share=100)
    assert sorted(out.where("rank is not null").toPandas()["rank"]) == list(range(1, 1 + sum(len(words_of(t)) >= 20 and d is not None for d, t, *_ in docs)))
    assert resample(table(spark, docs), bench, share=0).where("rank is not null").count() == 0


def test_chunk_features_are_the_texts_features():
    from quillfact.llm.resampling import chunk_features

    texts = [b"A b a B a", b"", b"x", b"b a-b", "é é".encode(), b"c " * 5000]
    strings, _, counts, sizes, held, times, n_words = chunk_features(texts)
    each = [Counter((w := words_of(t.decode())) + [f"{a} {b}" for a, b in itertools.pairwise(w)]) for t in texts]
    names = [x.decode() for x in strings.to_pylist()]
    assert dict(zip(names, counts.tolist(), strict=True)) == sum(each, Counter()) and len(set(names)) == len(names)
    begins = np.append(0, np.cumsum(sizes))
    assert [{names[k]: n for k, n in zip(held[a:b], times[a:b].tolist(), strict=True)} for a, b in itertools.pairwise(begins)] == each
    assert n_words.tolist() == [len(words_of(t.decode())) for t in texts]


def test_schema_has_clashing_names():
    assert {"count", "pos", "doc"} <= {c.split()[0] for c in SCHEMA.split(", ")}
