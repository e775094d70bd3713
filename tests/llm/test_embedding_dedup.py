"""The near-duplicates of embeddings against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<float>, label int, cid long, shard int, node string"


def brute(rows):
    good = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in good}
    links = {i: set() for i in range(len(rows))}
    for dims in {len(unit[i]) for i in good}:
        same = [i for i in good if len(unit[i]) == dims]
        x = np.stack([unit[i] for i in same])
        for a, b in np.argwhere(x @ x.T >= 0.95).tolist():
            if a != b:
                links[same[a]].add(same[b])
    group, out = {}, []
    for i in range(len(rows)):
        if i not in group:
            held, todo = {i}, [i]
            while todo:
                more = links[todo.pop()] - held
                held |= more
                todo += more
            group |= dict.fromkeys(held, min((rows[j][0] for j in held if rows[j][0] is not None), default=None))
        vec, least = rows[i][0], group[i]
        out.append((vec, len(links[i]), least, least is None if vec is None or least is None else vec == least))
    return sorted(out, key=str)


def planted(seed=3, dims=24, plain=500):
    rnd = np.random.default_rng(seed)
    f32 = lambda x: [float(v) for v in np.asarray(x, np.float32)]
    rows = [f32(rnd.standard_normal(dims)) for _ in range(plain)]
    centre = rnd.standard_normal(dims)
    rows += [f32(centre + rnd.standard_normal(dims) * 0.09) for _ in range(150)]  # a dense group: all are linked
    centre = rnd.standard_normal(dims)
    rows += [f32(centre + rnd.standard_normal(dims) * s) for s in np.linspace(0.05, 0.5, 120)]  # a loose one: some are
    one, two = np.linalg.qr(rnd.standard_normal((dims, 2)))[0].T
    rows += [f32(np.cos(t) * one + np.sin(t) * two) for t in np.arange(0, 3.0, 0.15)]  # a chain
    base = rnd.standard_normal(dims)
    rows += [f32(base)] * 40 + [f32(base * 3)] * 2 + [f32(-base)]
    rows += [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [-0.0] * dims]
    rows += [[1.0], [2.0], [-1.0], f32(rnd.standard_normal(3000)), [1.0, 0.0], [1.0, -0.0]]
    ids = rnd.permutation(len(rows) + 40)[: len(rows)].tolist()
    ids[-1] = None
    out = [(i, v, 0, 5, 6, "x") for i, v in zip(ids, rows, strict=True)]
    return [*out, out[0], (out[1][0], rows[-2], 1, 5, 6, "x"), (None, None, None, None, None, None), (None, rows[20], None, None, None, None)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_links_are_those_of_all_pairs(spark):
    from quillfact.llm.embedding_dedup import near_duplicates

    rows = planted()
    got = sorted((tuple(r) for r in near_duplicates(table(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    assert [g for g in got if g[1]] == [w for w in want if w[1]] and got == want


def test_empty_and_without_links(spark):
    from quillfact.llm.embedding_dedup import near_duplicates

    rows = planted()
    assert near_duplicates(table(spark, rows).limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicates(table(spark, [(4, None, 1, 1, 1, "")])).collect()] == [(4, 0, 4, True)]


def test_index_tables_too_large_to_broadcast(spark, monkeypatch):
    from quillfact.llm import embedding_dedup as E

    rows = planted(8, 16, 200)
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(E, "SHARD_ROWS", 60)
    got = sorted((tuple(r) for r in E.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [0, 700])
def test_graph_recall(hot):
    from quillfact.llm import embedding_dedup as E

    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((3000, 32))
    x[:hot] = x[0] + 0.1 * rnd.standard_normal((hot, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, node_row, row_node = E.build(x, 4)
    cosine = np.einsum("ij,ij->i", x, x[node_row[row_node]])
    assert (cosine >= E.THRESHOLD).all() and (row_node[node_row] == np.arange(len(node_row))).all()
    assert not hot or np.bincount(row_node).max() > hot / 2
    near = x[node_row] + 0.05 * rnd.standard_normal((len(node_row), 32))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    radius, theta = np.zeros(len(node_row)), np.arccos(0.95)
    q, c = E.within(graph, radius, near, np.full(len(near), theta), E.audited(graph, radius, theta, 1))
    truth = near @ x[node_row].T >= 0.95
    assert truth[q, c].sum() >= 0.99 * truth.sum()


def test_audit_widens_the_beam(monkeypatch):
    from quillfact.llm import embedding_dedup as E

    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, node_row, _ = E.build(x, 4)
    graph.layers[-1][:, 3:] = -1  # a poor graph
    assert E.audited(graph, np.zeros(len(node_row)), np.arccos(0.95), 1) > E.BEAM
