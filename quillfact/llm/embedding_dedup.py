"""Embedding near-dedup: hierarchical navigable small-world graphs per shard, every shard queried, links verified.

1. Equal vectors are one class. Classes are dealt to shards of bounded size by hash.
2. A shard inserts its classes into a layered graph, in batches that search what is there already. A class that is linked
   with a node joins it as a member; other classes become nodes. So near copies never crowd each other's neighbours
   out, and a node with its members is connected by verified links.
3. The graph audits its beam: nodes are turned away by the widest angle at which a link can hang on them, and such
   queries, and a brute-force search of real ones, must find what there is; until RECALL of it is found, the beam is doubled.
4. The nodes of each shard query every later shard and their own, in blocks. A query whose whole beam is in reach asks
   again with a wider one. Reach is the threshold's angle and the radii of both nodes, so members need no queries.
5. A pair of nodes is decided by the centres of their members: where centres and radii leave no doubt, all member pairs
   are linked or none is (the triangle inequality on the sphere), and counts are added without making pairs; all other
   pairs are compared member by member in double precision, and leave counts, not rows.
6. Components are found over nodes.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths do not link; rows that repeat a vec_id are vectors of their own; a row without vec_id takes part, is never
the name of a component, and is kept if nothing that has a vec_id is reachable; label and other columns are not read; an empty
table gives no rows. Very long vectors are as good as others; BLOCK_BYTES bounds what a query block holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm import bytetext as B
from quillfact.llm.common import arrow_batches, components, settle, sized

THRESHOLD = 0.95
#: Classes of a shard at most, on average, and shards at least.
SHARD_ROWS, LEAST_SHARDS = 50_000, 4
#: Neighbours of a node in a layer, at insertion and at most; the beam of an insertion and the first of a query.
LINKS, MOST_LINKS, BUILD_BEAM, BEAM = 16, 32, 48, 32
#: Candidates among which neighbours are chosen.
CANDIDATES = 64
#: One of so many nodes is in the next layer; a layer of fewer nodes is searched whole.
LAYER, WHOLE = 16, 256
#: Audited queries of a shard, and the share of what there is that must be found.
AUDITED, RECALL = 200, 0.99
BATCH, BLOCK_BYTES = 1024, 2_000_000
#: Angles nearer than this to a bound are decided by the pairs themselves.
DOUBT = 1e-6
#: Entries of the map of seen nodes in a search.
SEEN = 1 << 24
#: Index tables of so many bytes are broadcast; larger ones are joined by shard.
BROADCAST_BYTES = 64 << 20


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The beam (numbers, cosines) of each query in one layer, from its entry nodes; numbers of -1 are empty places."""
    beam = min(beam, len(links))
    out = [np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -2, np.float32)]
    size = max(SEEN // (len(links) + 1), 1)
    for low in range(0, len(queries), size):
        part = slice(low, low + size)
        out[0][part], out[1][part] = _beam(vectors, links, queries[part], entries[part], beam, step)
    return out[0], out[1]


def _beam(vectors, links, queries, entries, beam, step):
    n, k = len(links), len(queries)
    seen = np.zeros((k, n + 1), bool)  # the last column takes what is not to be marked
    entries = entries[:, :beam]
    ids = np.full((k, beam), -1, np.int32)
    sims = np.full((k, beam), -2, np.float32)
    ids[:, : entries.shape[1]] = entries
    sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("qed,qd->qe", vectors[entries], queries), -2)
    seen[np.arange(k)[:, None], np.where(entries >= 0, entries, n)] = True
    done = sims < -1.5
    step = min(step, beam)
    active = np.arange(k)
    while len(active):
        open_ = np.where(done[active], np.float32(-3), sims[active])
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), open_.shape)
        good = np.take_along_axis(open_, pick, 1) > -2.5
        some = good.any(1)
        active, pick, good = active[some], pick[some], good[some]
        if not len(active):
            break
        at = active[:, None]
        done[at, pick] = True
        found = np.where(good[:, :, None], links[ids[at, pick]], -1).reshape(len(active), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        fresh = found >= 0
        fresh &= ~seen[at, found]
        seen[at, np.where(fresh, found, n)] = True
        row, col = np.nonzero(fresh)
        new = np.full(found.shape, -2, np.float32)
        new[row, col] = np.einsum("ij,ij->i", vectors[found[row, col]], queries[active[row]])
        all_sims, all_ids = np.concatenate([sims[active], new], 1), np.concatenate([ids[active], found], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, all_done))
    ids[sims < -1.5] = -1
    return ids, sims


def diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (numbers, cosines to the row's own vector) most neighbours: first those that are nearer to the
    row than to any chosen one, then the nearest of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    near = vectors[ids]
    each = np.matmul(near, near.transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    real = ids >= 0
    worst = np.full(ids.shape, -2, np.float32)  # the greatest cosine to a chosen candidate
    for c in range(ids.shape[1]):
        take = real[:, c] & (sims[:, c] > worst[:, c]) & (chosen.sum(1) < most)
        chosen[:, c] = take
        worst = np.where(take[:, None], np.maximum(worst, each[:, c, :]), worst)
    rank = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(real, rank, 1), np.take_along_axis(ids, rank, 1), -1)


class Graph:
    """Nodes 0, 1, ... with unit vectors; layer 0 (the last of layers) holds all nodes, each earlier one a first part of them."""

    def __init__(self, dims: int):
        self.vectors, self.layers = np.zeros((0, dims), np.float32), []

    def entries(self, queries: np.ndarray, layers: int, count: int = 4) -> np.ndarray:
        """Nodes near the queries, from the first so many layers."""
        if not layers:
            return np.zeros((len(queries), 1), np.int32)
        first = self.layers[0]
        near = np.argsort(-(queries @ self.vectors[: len(first)].T), axis=1)[:, :count].astype(np.int32)
        for links in self.layers[1:layers]:
            near = beam_search(self.vectors, links, queries, near, 2 * count)[0]
        return near

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        if len(self.vectors) <= WHOLE or beam >= len(self.vectors):
            sims = queries @ self.vectors.T
            return np.broadcast_to(np.arange(len(self.vectors), dtype=np.int32), sims.shape), sims
        return beam_search(self.vectors, self.layers[-1], queries, self.entries(queries, len(self.layers) - 1), beam)

    def link(self, links: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Connect new nodes with diverse ones of their candidates, and these with the new nodes."""
        chosen = diverse(self.vectors, ids, sims, LINKS)
        links[nodes, : chosen.shape[1]] = chosen
        back, new = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        back, new = back[back >= 0], new[back >= 0]
        order = np.argsort(back, kind="stable")
        back, new = back[order], new[order]
        target, at, count = np.unique(back, return_index=True, return_counts=True)
        wide = np.full((len(target), MOST_LINKS + int(count.max(initial=0))), -1, np.int32)
        wide[:, :MOST_LINKS] = links[target]
        wide[np.repeat(np.arange(len(target)), count), MOST_LINKS + np.arange(len(back)) - np.repeat(at, count)] = new
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        wide[wide == target[:, None]] = -1
        full = (wide >= 0).sum(1) > MOST_LINKS
        links[target[~full]] = -np.sort(-wide[~full], axis=1)[:, :MOST_LINKS]
        for low in range(0, int(full.sum()), BATCH):
            some = np.flatnonzero(full)[low : low + BATCH]
            most = wide[some]
            near = np.full(most.shape, -2, np.float32)
            row, col = np.nonzero(most >= 0)
            near[row, col] = np.einsum("ij,ij->i", self.vectors[most[row, col]], self.vectors[target[some][row]])
            top = np.argsort(-near, axis=1)[:, :CANDIDATES]
            links[target[some]] = diverse(self.vectors, np.take_along_axis(most, top, 1), np.take_along_axis(near, top, 1), MOST_LINKS)


def build(exact: np.ndarray, seed: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    """The graph of unit vectors (doubles); the row of each node, and the node of each row."""
    rnd = np.random.default_rng(seed)
    n = len(exact)
    order = rnd.permutation(n)
    graph = Graph(exact.shape[1])
    node_row, row_node = np.zeros(n, np.int64), np.zeros(n, np.int64)
    graph.vectors = np.zeros((n, exact.shape[1]), np.float32)
    store, made, put = graph.vectors, 0, 0
    sizes = [n]
    while sizes[0] > WHOLE:
        sizes.insert(0, sizes[0] // LAYER)
    for depth, size in enumerate(sizes):
        links = np.full((n, MOST_LINKS), -1, np.int32)
        for low in range(0, made, BATCH):  # the nodes of the layer before, few enough to meet each other
            new = np.arange(low, min(low + BATCH, made))
            sims = store[new] @ store[:made].T
            sims[new - low, new] = -2
            ids = np.argpartition(-sims, min(CANDIDATES, made - 1), axis=1)[:, :CANDIDATES].astype(np.int32)
            sims = np.take_along_axis(sims, ids, 1)
            graph.link(links, new, np.where(sims > -1.5, ids, -1), sims)
        while put < size:
            rows = order[put : min(put + min(BATCH, max(made, WHOLE)), size)]
            put += len(rows)
            some = exact[rows]
            owner = np.full(len(rows), -1, np.int64)
            if made:
                ids, sims = _near(graph, store, links, depth, some.astype(np.float32), made)
                best = np.take_along_axis(ids, np.argmax(sims, 1)[:, None], 1)[:, 0]
                owner = np.where((best >= 0) & (np.einsum("ij,ij->i", exact[node_row[best]], some) >= THRESHOLD), best, -1)
            free = np.flatnonzero(owner == -1)
            for i, j in free[np.argwhere(np.triu(some[free] @ some[free].T >= THRESHOLD, 1))].tolist():  # in order: the first of a group leads
                if owner[i] == -1 and owner[j] == -1:
                    owner[j] = -2 - i
            lead = owner == -1
            new = made + np.arange(int(lead.sum()))
            store[new], node_row[new] = some[lead], rows[lead]
            number = np.zeros(len(rows), np.int64)
            number[lead] = new
            row_node[rows] = np.where(lead, number, np.where(owner >= 0, owner, number[np.where(owner < -1, -2 - owner, 0)]))
            if len(new):
                _insert(graph, store, links, depth, new, made)
            made += len(new)
        graph.layers.append(links[:made].copy())
    graph.vectors = store[:made].copy()
    return graph, node_row[:made], row_node


def _near(graph, store, links, depth, queries, made, beam=BUILD_BEAM):
    if made <= WHOLE:
        sims = queries @ store[:made].T
        return np.broadcast_to(np.arange(made, dtype=np.int32), sims.shape), sims
    return beam_search(store, links[:made], queries, graph.entries(queries, depth), beam)


def _insert(graph, store, links, depth, new, before):
    queries = store[new]
    ids, sims = _near(graph, store, links, depth, queries, before) if before else (np.zeros((len(new), 0), np.int32), np.zeros((len(new), 0), np.float32))
    each = queries @ queries.T
    np.fill_diagonal(each, -2)
    top = np.argsort(-each, axis=1)[:, : min(LINKS, len(new))]
    inner = np.where(np.take_along_axis(each, top, 1) > -1.5, new[top], -1).astype(np.int32)
    ids, sims = np.concatenate([ids, inner], 1), np.concatenate([sims, np.where(inner >= 0, np.take_along_axis(each, top, 1), -2)], 1)
    keep = np.argsort(-sims, axis=1)[:, :CANDIDATES]
    graph.link(links, new, np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1))


def within(graph: Graph, radius: np.ndarray, queries: np.ndarray, reach: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) whose angle is at most the query's reach and the node's radius. Queries whose whole beam is in
    reach ask again with a beam twice as wide."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = max(SEEN // max(len(graph.vectors), 1), 1)
    waiting = [(np.arange(low, min(low + size, len(queries))), beam) for low in range(0, len(queries), size)]
    while waiting:
        at, beam = waiting.pop()
        ids, sims = graph.search(queries[at], beam)
        whole = ids.shape[1] >= len(graph.vectors)
        inside = (ids >= 0) & (sims >= np.cos(np.minimum(reach[at, None] + radius[ids] + 1e-3, np.pi)))
        again = np.zeros(len(at), bool) if whole else inside.all(1)
        q, c = np.nonzero(inside & ~again[:, None])
        found.append((at[q], ids[q, c].astype(np.int64)))
        if again.any():
            waiting.append((at[again], 2 * beam))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def audited(graph: Graph, radius: np.ndarray, theta: float, seed: int) -> int:
    """The beam that finds RECALL of what there is, for queries planted at the widest angle and for real ones."""
    rnd = np.random.default_rng(seed)
    n = len(graph.vectors)
    chosen = rnd.choice(n, min(AUDITED, n), replace=False)
    base = graph.vectors[chosen].astype(np.float64)
    aside = rnd.standard_normal(base.shape)
    aside -= np.einsum("ij,ij->i", aside, base)[:, None] * base
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    angle = theta + radius[chosen][:, None]
    planted = np.cos(angle) * base + np.sin(angle) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 0)
    queries = np.concatenate([planted, base])
    reach = np.concatenate([np.full(len(chosen), theta), theta + radius[chosen]])
    truth = queries.astype(np.float32) @ graph.vectors.T >= np.cos(np.minimum(reach[:, None] + radius + 1e-3, np.pi))
    beam = BEAM
    while beam < n:
        q, c = within(graph, radius, queries, reach, beam)
        if truth[q, c].sum() >= RECALL * truth.sum():
            break
        beam *= 2
    return beam


INDEX = "shard int, dims int, part int, first int, beam int, leads binary, nodes binary, links array<binary>, radius binary, centre binary, spread binary, size binary, cids binary, counts binary, begins binary, members binary"


def _index(seed: int, theta: float):
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int32()] * 5 + [pa.binary()] * 2 + [pa.list_(pa.binary())] + [pa.binary()] * 8

    def run(key, table):
        """One shard: part 0 is the index; parts 1, 2, ... are its nodes in blocks, with their members."""
        shard, dims = key[0].as_py(), key[1].as_py()
        cid, count = (table.column(c).combine_chunks().to_numpy() for c in ("cid", "n"))
        order = np.argsort(cid)  # a shard's graph does not depend on the order of arrival
        raw = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dims)[order]
        exact = raw / np.abs(raw).max(1, keepdims=True)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        cid, count = cid[order], count[order]
        graph, node_row, row_node = build(exact, seed + shard)
        n = len(node_row)
        by_node = np.argsort(row_node, kind="stable")
        begins = np.append(0, np.cumsum(np.bincount(row_node, minlength=n)))
        angle = lambda a, b: np.arccos(np.clip(np.einsum("ij,ij->i", a, b), -1, 1))
        radius = np.zeros(n)
        np.maximum.at(radius, row_node, np.where(node_row[row_node] == np.arange(len(cid)), 0, angle(exact, exact[node_row[row_node]])))
        centre = np.add.reduceat(exact[by_node], begins[:-1])
        alone = np.diff(begins) == 1
        centre[alone] = exact[node_row[alone]]
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
        spread = np.zeros(n)
        np.maximum.at(spread, row_node, np.where(alone[row_node], 0, angle(exact, centre[row_node])))
        size = np.bincount(row_node, count, n).astype(np.int64)
        beam = audited(graph, radius, theta, seed + shard)
        lead = cid[node_row]  # a node goes by the class that leads it
        rows = [(shard, dims, 0, 0, beam, lead.tobytes(), graph.vectors.tobytes(), [x.tobytes() for x in graph.layers], radius.tobytes(), centre.tobytes(), spread.tobytes(), size.tobytes(), None, None, None, None)]
        width = max(BLOCK_BYTES // (8 * dims), 1)
        cuts = [0]
        while cuts[-1] < n:  # blocks of about BLOCK_BYTES of members
            cuts.append(max(min(int(np.searchsorted(begins, begins[cuts[-1]] + width, "right")) - 1, n), cuts[-1] + 1))
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            mine = by_node[begins[a] : begins[b]]
            rows.append((shard, dims, part, a, beam, lead[a:b].tobytes(), graph.vectors[a:b].tobytes(), None, radius[a:b].tobytes(), centre[a:b].tobytes(), spread[a:b].tobytes(), size[a:b].tobytes(), cid[mine].tobytes(), count[mine].tobytes(), (begins[a : b + 1] - begins[a]).tobytes(), exact[mine].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


PAIRS = "a long, b long, n_a long, n_b long, sure boolean"


def _query(theta: float, columns: list[str]):
    """Blocks of nodes against indexes: pairs of nodes that are linked for sure, and those that are to be compared."""
    doubles = lambda x, dims: np.frombuffer(x, np.float64).reshape(-1, dims)
    names = [x.split()[0] for x in PAIRS.split(", ")]

    def run(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = dict(zip(columns, (batch.column(c)[i] for c in range(len(columns))), strict=True))
                shard, other, dims, first = (r[c].as_py() for c in ("shard", "other", "dims", "first"))
                if held is None or held[0] != (other, dims):
                    graph = Graph(dims)
                    graph.vectors = np.frombuffer(r["index_nodes"].as_py(), np.float32).reshape(-1, dims)
                    graph.layers = [np.frombuffer(x, np.int32).reshape(-1, MOST_LINKS) for x in r["index_links"].as_py()]
                    held = (other, dims), graph, *(np.frombuffer(r[f"index_{c}"].as_py(), t) for c, t in (("radius", np.float64), ("spread", np.float64), ("size", np.int64), ("leads", np.int64))), doubles(r["index_centre"].as_py(), dims)
                _, graph, radius, spread, size, leads, centre = held
                queries = np.frombuffer(r["nodes"].as_py(), np.float32).reshape(-1, dims)
                my_radius, my_spread, my_size, my_leads = (np.frombuffer(r[c].as_py(), t) for c, t in (("radius", np.float64), ("spread", np.float64), ("size", np.int64), ("leads", np.int64)))
                mine = doubles(r["centre"].as_py(), dims)
                q, node = within(graph, radius, queries, theta + my_radius, r["beam"].as_py())
                if shard == other:  # a node meets itself if it holds more than one vector
                    others, own = q + first != node, np.flatnonzero(my_size > 1)
                    q, node = np.append(q[others], own), np.append(node[others], own + first)
                cosine = np.einsum("ij,ij->i", mine[q], centre[node])
                apart = np.arccos(np.clip(cosine, -1, 1))
                both, plain = my_spread[q] + spread[node], (my_spread[q] == 0) & (spread[node] == 0)
                itself = (shard == other) & (q + first == node)
                sure = np.where(plain, (cosine >= THRESHOLD) | itself, np.where(itself, both, apart + both) <= theta - DOUBT)
                near = np.where(plain, sure, itself | (apart - both <= theta + DOUBT))
                one, two, n_one, n_two = my_leads[q[near]], leads[node[near]], my_size[q[near]], size[node[near]]
                turned = one > two
                cols = [np.where(turned, two, one), np.where(turned, one, two), np.where(turned, n_two, n_one), np.where(turned, n_one, n_two), sure[near]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
        B.release()

    return run


SUMS = "cid long, a long, b long, links long"


def _compare(batches):
    """Pairs of nodes with their members: per member how many vectors of the other node it is linked with, and the pairs of nodes
    that have a link."""
    names = [x.split()[0] for x in SUMS.split(", ")]
    for batch in batches:
        for a, b, dims, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            (ca, na, xa), (cb, nb, xb) = ((np.frombuffer(blobs[i], np.int64), np.frombuffer(blobs[i + 1], np.int64), np.frombuffer(blobs[i + 2], np.float64).reshape(-1, dims)) for i in (0, 3))
            to_a, to_b = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
            size = max(4_000_000 // len(cb), 1)
            for low in range(0, len(ca), size):
                close = (xa[low : low + size] @ xb.T >= THRESHOLD).astype(np.float64)
                if a == b:
                    k = np.arange(low, min(low + size, len(ca)))
                    close[k - low, k] = 1
                to_a[low : low + size] = close @ nb
                to_b += (na[low : low + size] @ close).astype(np.int64)
            any_ = int(to_a.sum()) > 0
            found = [(ca, to_a - 1)] if a == b else [(ca, to_a), (cb, to_b)]
            cid, links = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            k = len(cid)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(links)], names)
            if any_ and a != b:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([a]), pa.array([b]), pa.array([0])], names)
    B.release()


MEMBERS = "node long, dims int, cids binary, counts binary, members binary"


def _members(batches):
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    for batch in batches:
        for dims, leads, cids, counts, begins, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            begins = np.frombuffer(begins, np.int64).tolist()
            cut = lambda x, w, begins=begins: [x[w * i : w * j] for i, j in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(leads, np.int64)), pa.array([dims] * (len(begins) - 1), pa.int32()), *(pa.array(cut(x, w), pa.binary()) for x, w in ((cids, 8), (counts, 8), (members, 8 * dims)))], names)


def _owners(batches):
    for batch in batches:
        for node, cids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cids = np.frombuffer(cids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(np.full(len(cids), node))], ["cid", "node"])


def near_duplicates(vectors: DataFrame, seed: int = 11) -> DataFrame:
    """One row per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    theta = float(np.arccos(THRESHOLD))
    fine = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("vector", F.when(F.col("fine"), F.transform("embedding", lambda x: x + F.lit(0.0))))  # one zero
    rows = rows.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), "vector").alias("h2"))
    classes = rows.where("vector is not null").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()))  # the numbers hold once the table is written
    shards = max(-(-classes.count() // SHARD_ROWS), LEAST_SHARDS)
    dealt = classes.select("cid", "n", "vector", F.size("vector").alias("dims"), F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).cast("int").alias("shard"))
    index = settle(dealt.groupBy("shard", "dims").applyInArrow(_index(seed, theta), INDEX))

    whole = index.where("part = 0").select(F.col("shard").alias("other"), "dims", "beam", *[F.col(c).alias(f"index_{c}") for c in ("leads", "nodes", "links", "radius", "centre", "spread", "size")])
    total = whole.agg(F.sum(F.length("index_nodes") + F.length("index_centre") + F.aggregate("index_links", F.lit(0), lambda acc, x: acc + F.length(x)))).first()[0] or 0
    blocks = index.where("part > 0").select("shard", "dims", "part", "first", "leads", "nodes", "radius", "centre", "spread", "size", F.explode(F.sequence("shard", F.lit(shards - 1))).alias("other"))
    asked = blocks.repartition(4 * shards, "shard", "part", "other").join(F.broadcast(whole) if total <= BROADCAST_BYTES else whole, ["other", "dims"])
    pairs = settle(asked.mapInArrow(_query(theta, asked.columns), PAIRS).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("n_a", "n_b", "sure")]))
    members = index.where("part > 0").select("dims", "leads", "cids", "counts", "begins", "members").mapInArrow(_members, MEMBERS)
    owners = settle(members.select("node", "cids").mapInArrow(_owners, "cid long, node long"))

    sure = pairs.where("sure")
    node_sums = sure.where("a <> b").select(F.col("a").alias("node"), F.col("n_b").alias("links")).unionAll(sure.where("a <> b").select("b", "n_a")).unionAll(sure.where("a = b").select("a", F.col("n_a") - 1))
    node_sums = node_sums.groupBy("node").agg(F.sum("links").alias("node_links"))
    unsure = settle(pairs.where("not sure").select("a", "b"))
    named = settle(members.join(sized(settle(unsure.select(F.col("a").alias("node")).union(unsure.select("b")).distinct())), "node", "left_semi"))
    side = lambda x: named.select(F.col("node").alias(x), *([F.col("dims")] if x == "a" else []), *[F.col(c).alias(f"{c}_{x}") for c in ("cids", "counts", "members")])
    compared = unsure.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dims", "cids_a", "counts_a", "members_a", "cids_b", "counts_b", "members_b")
    compared = settle(compared.mapInArrow(_compare, SUMS))
    links = sure.where("a <> b").select("a", "b").unionAll(compared.where("cid is null").select("a", "b"))
    member_sums = compared.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("member_links"))

    groups = components(links)
    placed = classes.select("cid", "h1", "h2", "least").join(owners, "cid").join(groups, owners["node"] == groups["id"], "left").withColumn("group", F.coalesce("component", "node"))
    placed = settle(placed.select("cid", "h1", "h2", "least", "node", "group"))
    names = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    known = placed.join(names, "group").join(node_sums, "node", "left").join(member_sums, "cid", "left")
    known = known.select("h1", "h2", (F.coalesce("node_links", F.lit(0)) + F.coalesce("member_links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("vector is not null").select("vec_id", "h1", "h2").join(known, ["h1", "h2"])
    out = out.select("vec_id", "n_links", "component_id").unionByName(rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
