"""Embedding near-dedup with a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors form one node first, with their number, so that copies cost a hash.
2. Nodes go to the OVERLAP shards with the nearest centroids; centroids come from k-means on a bounded, hashed sample.
   A shard of more than BLOCK nodes is cut into blocks, each pair of which meets in a task: no bound is put on shards.
3. Per block a graph is built: candidates are near nodes and some far ones, thinned by robust pruning.
4. The adjacency lists of a node are united over its blocks.
5. Per pair of blocks, each query walks greedily from the block's medoid and from its own neighbours, and wherever it
   meets a node in range it expands that node's neighbours too, until nothing new is in range.
6. Pairs found are verified in double precision. A pair that meets in several shards counts in the first one only, so
   counts add up without pairs being emitted; components grow from each task's forest.
7. Recall is audited: the links of a bounded sample of vectors are counted by brute force over all rows. Below
   LEAST_RECALL the search is repeated with twice the overlap.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
another length link only among themselves; rows that repeat an id are each a vector and share its component; a null id
links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ready, stored

#: Nearest shards of a node, nodes of a block, shards at most, vectors that k-means sees, and that the audit checks.
OVERLAP, BLOCK, SHARDS, SAMPLE, AUDITED = 4, 1500, 4096, 16_384, 256
#: Candidates of a node, far ones among them, edges kept, slack of pruning, width of the greedy walk, least recall.
NEAR, FAR, EDGES, ALPHA, BEAM, LEAST_RECALL = 40, 12, 20, 1.2, 20, 0.97


def unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, seed: int = 5, steps: int = 8) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def build(x: np.ndarray) -> np.ndarray:
    """Robust-pruned adjacency (rows padded by -1) of unit vectors."""
    n = len(x)
    x = x.astype(np.float32)
    r = np.random.default_rng(n)
    near = min(NEAR, n - 1)
    if near <= 0:
        return np.full((n, 1), -1, np.int32)
    cand = np.empty((n, near + FAR), np.int64)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    cand[:, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    cand[:, near:] = r.integers(0, n, (n, FAR))
    own = np.arange(n)[:, None]
    sims = np.take_along_axis(s, cand, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    alive = cand != own
    dist = np.sqrt(np.maximum(2 - 2 * sims, 0))
    out = np.full((n, EDGES), -1, np.int32)
    for e in range(EDGES):
        any_left = alive.any(1)
        if not any_left.any():
            break
        first = alive.argmax(1)
        pick = np.take_along_axis(cand, first[:, None], 1)
        out[any_left, e] = pick[any_left, 0]
        apart = np.sqrt(np.maximum(2 - 2 * s[pick, cand], 0))
        alive &= (ALPHA * apart > dist) & (cand != pick)
    return out


def undirected(adj: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    """node, nbrs of a block's graph, with each edge in both directions."""
    a = np.repeat(np.arange(len(adj)), adj.shape[1])
    b = adj.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    both = pd.DataFrame({"node": ids[np.concatenate([a, b])], "n": ids[np.concatenate([b, a])]}).drop_duplicates()
    return both.groupby("node")["n"].agg(list).reset_index().rename(columns={"n": "nbrs"})


def walk(x: np.ndarray, adj: np.ndarray, y: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Similarity of each query y to each node x that its walk visited, else -2. adj: neighbours; own: a query's first nodes."""
    q, n = len(y), len(x)
    sims = np.full((q, n), -2, np.float32)
    medoid = int((x @ x.mean(0)).argmax())

    def look(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Visits pairs not seen yet; gives them."""
        key = np.unique(rows * n + nodes)
        rows, nodes = key // n, key % n
        new = sims[rows, nodes] == -2
        rows, nodes = rows[new], nodes[new]
        for at in range(0, len(rows), 1 << 16):
            a, b = rows[at : at + (1 << 16)], nodes[at : at + (1 << 16)]
            sims[a, b] = np.einsum("pd,pd->p", y[a], x[b])
        return rows, nodes

    every = np.arange(q)
    look(every, np.full(q, medoid))
    rows, nodes = np.repeat(every, own.shape[1]), own.reshape(-1)
    look(rows[nodes >= 0], nodes[nodes >= 0])
    expanded = np.zeros((q, n), bool)
    active = every
    beam = min(BEAM, n)
    while len(active):
        # the best visited nodes of each query; those not expanded yet are
        top = np.argpartition(-sims[active], beam - 1, axis=1)[:, :beam]
        open_ = (np.take_along_axis(sims[active], top, 1) > -2) & ~np.take_along_axis(expanded[active], top, 1)
        r, c = np.nonzero(open_)
        if not len(r):
            break
        rows, nodes = active[r], top[r, c]
        expanded[rows, nodes] = True
        nb = adj[nodes]
        rows2 = np.repeat(rows, nb.shape[1])
        nb = nb.reshape(-1)
        look(rows2[nb >= 0], nb[nb >= 0])
        active = np.unique(rows)
    while True:  # range expansion
        rows, nodes = np.nonzero((sims >= least - 0.02) & ~expanded)
        if not len(rows):
            return sims
        expanded[rows, nodes] = True
        for at in range(0, len(rows), 1 << 14):
            nb = adj[nodes[at : at + (1 << 14)]]
            rows2 = np.repeat(rows[at : at + (1 << 14)], nb.shape[1])
            nb = nb.reshape(-1)
            look(rows2[nb >= 0], nb[nb >= 0])


def _local(lists: list, ids: np.ndarray) -> np.ndarray:
    """Neighbour lists as row numbers in the sorted ids, padded by -1."""
    size = max([1, *(len(x) for x in lists)])
    out = np.full((len(lists), size), -1, np.int64)
    for k, x in enumerate(lists):
        x = np.asarray(x, np.int64)
        at = np.searchsorted(ids, x)
        at[at == len(ids)] = 0
        good = at[ids[at] == x] if len(ids) else at[:0]
        out[k, : len(good)] = good
    return out


def linked(left: pd.DataFrame, right: pd.DataFrame, same: bool, shard: int, least: float) -> pd.DataFrame:
    """node, n (links counted here), lo (smallest node of its group here) for the links between two blocks."""
    left, right = left.sort_values("node"), right.sort_values("node")
    li, ri = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
    lx, rx = unit(left["v"]), unit(right["v"])
    found: set[tuple[int, int]] | None = None
    pairs = []
    for a_ids, a_x, a, b_ids, b_x, b in ((li, lx, left, ri, rx, right), (ri, rx, right, li, lx, left))[: 1 if same else 2]:
        adj = _local(b["nbrs"].to_list(), b_ids)
        own = _local(a["nbrs"].to_list(), b_ids)
        sims = walk(b_x.astype(np.float32), adj, a_x.astype(np.float32), own, least)
        r, c = np.nonzero(sims >= least - 1e-4)
        keep = np.ones(len(r), bool)
        for at in range(0, len(r), 1 << 16):
            p = slice(at, at + (1 << 16))
            keep[p] = np.einsum("pd,pd->p", a_x[r[p]], b_x[c[p]]) >= least
        r, c = r[keep], c[keep]
        pairs.append((r, c) if a is left else (c, r))
    r, c = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    if same:
        r, c = np.minimum(r, c), np.maximum(r, c)
    key = np.unique(r * len(ri) + c)
    r, c = key // len(ri), key % len(ri)
    apart = li[r] != ri[c]
    r, c = r[apart], c[apart]
    # a pair belongs to the smallest shard that both are in
    ls, rs = left["shards"].to_list(), right["shards"].to_list()
    ls, rs = [np.asarray(x, np.int64) for x in ls], [np.asarray(x, np.int64) for x in rs]
    width = max(len(x) for x in [*ls, *rs])
    pad = lambda lists, fill: np.stack([np.concatenate([x, np.full(width - len(x), fill, np.int64)]) for x in lists])
    la, ra = pad(ls, -1), pad(rs, -2)
    owner = np.full(len(r), np.iinfo(np.int64).max)
    for at in range(0, len(r), 1 << 16):
        p = slice(at, at + (1 << 16))
        x, y = la[r[p]], ra[c[p]]
        owner[p] = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1)
    r, c = r[owner == shard], c[owner == shard]
    if not len(r):
        return pd.DataFrame({"node": [], "n": [], "lo": []}).astype("int64")
    lm, rm = left["m"].to_numpy(np.int64), right["m"].to_numpy(np.int64)
    ids = np.unique(np.concatenate([li, ri]))
    n = np.zeros(len(ids), np.int64)
    at_l, at_r = np.searchsorted(ids, li[r]), np.searchsorted(ids, ri[c])
    np.add.at(n, at_l, rm[c])
    np.add.at(n, at_r, lm[r])
    root = np.arange(len(ids))
    while True:  # smallest label over links, with shortcuts
        was = root.copy()
        low = np.minimum(root[at_l], root[at_r])
        np.minimum.at(root, at_l, low)
        np.minimum.at(root, at_r, low)
        root = root[root]
        if (root == was).all():
            break
    has = n > 0
    return pd.DataFrame({"node": ids[has], "n": n[has], "lo": ids[root[has]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors."""
    ready(vectors.sparkSession)
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0 is 0
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v")), "vectors")
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(3), "v").alias("k2")]
    good = rows.where("v is not null")
    nodes = stored(good.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("m"), F.min("v").alias("v")), "nodes")
    count = nodes.count()
    known = {}
    for attempt in (overlap, 2 * overlap, 4 * overlap):
        known = _links(nodes, count, least, attempt)
        if _recall(nodes, known, least) >= LEAST_RECALL:
            break
    links = known.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(known.where("node <> lo").select(F.col("node").alias("hi"), "lo"), "vector-components")
    each = nodes.join(links, "node", "left").join(comp, "node", "left").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    some = good.select("id", *key).join(each, ["k1", "k2"]).select("id", "n_links", "component_id")
    out = some.unionByName(rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(nodes: DataFrame, count: int, least: float, overlap: int) -> DataFrame:
    """node, n, lo of every task; nodes: node, m, v."""
    sample = nodes.orderBy(F.xxhash64("node")).select("v").limit(SAMPLE).toPandas()["v"]  # bounded
    dims = sample.map(len)
    dim = int(dims.mode().iloc[0]) if len(dims) else 0
    shards = int(min(SHARDS, max(1, -(-count * overlap // BLOCK)), max(1, len(dims) // 4)))
    c = centroids(unit(sample[dims == dim]), shards) if len(dims) else np.zeros((1, 1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["v"].map(len)):
                if size == dim:
                    near = unit(part["v"]) @ c.T
                    k = min(overlap, near.shape[1])
                    own = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
                else:  # another length: a shard of its own
                    own = np.full((len(part), 1), -int(size))
                yield part.assign(shards=own.tolist())

    placed = stored(nodes.select("node", "m", "v").mapInPandas(assign, "node long, m long, v array<double>, shards array<long>").withColumn("shard", F.explode("shards")), "placed")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = placed.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = stored(placed, "blocks")

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").drop_duplicates("node")
        return undirected(build(unit(pdf["v"])), pdf["node"].to_numpy(np.int64))

    built = placed.select("shard", "block", "node", "v").groupBy("shard", "block").applyInPandas(graph, "node long, nbrs array<long>")
    united = stored(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs")), "graph")
    full = placed.join(united, "node", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<long>")))
    # block b meets every block of its shard once: tasks (i, j) with i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    full = full.withColumn("with", other).withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, i, j = key
        pdf = pdf.drop_duplicates(["node", "block"])
        return linked(pdf[pdf["block"] == i], pdf[pdf["block"] == j], i == j, shard, least) if (pdf["block"] == i).any() and (pdf["block"] == j).any() else pd.DataFrame({"node": [], "n": [], "lo": []}).astype("int64")

    return stored(full.select("shard", "i", "j", "block", "node", "m", "v", "nbrs", "shards").groupBy("shard", "i", "j").applyInPandas(search, "node long, n long, lo long"), "vector-links")


def _recall(nodes: DataFrame, known: DataFrame, least: float) -> float:
    """Share of the links of at most AUDITED nodes, counted by brute force over all nodes, that were found."""
    some = nodes.orderBy(F.xxhash64(F.lit(9), "node")).select("node", "v").limit(AUDITED).toPandas()  # bounded
    if not len(some):
        return 1.0
    by_size = {size: (part["node"].to_numpy(np.int64), unit(part["v"])) for size, part in some.groupby(some["v"].map(len))}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, part in pdf.groupby(pdf["v"].map(len)):
                if size in by_size:
                    ids, x = by_size[size]
                    near = (x @ unit(part["v"]).T >= least) & (ids[:, None] != part["node"].to_numpy(np.int64)[None, :])
                    yield pd.DataFrame({"node": ids, "n": (near * part["m"].to_numpy(np.int64)[None, :]).sum(1)})

    truth = nodes.select("node", "m", "v").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("truth"))
    got = truth.join(known.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").agg(F.sum("truth"), F.sum(F.coalesce("n", F.lit(0)))).first()
    return (got[1] or 0) / got[0] if got[0] else 1.0
