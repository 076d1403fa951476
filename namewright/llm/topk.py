"""Exact top-k search by integer inner product, with bounds from segment statistics, coarse to fine.

A vector is cut into equal segments; for a segment of n components with means m, m' and deviations s, s' the inner
product is at most n * (m * m' + s * s'), since the centred parts obey the Cauchy-Schwarz inequality. The sum over
segments bounds a score from above, and a finer cut gives a tighter bound. (|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so this
is the lower bound of the distance with segment means and deviations.) Per level, candidates whose bound lies below a query's k-th
best exact score so far are dropped; the survivors of the finest level are scored exactly.

Queries and rows meet in blocks: each row block meets each query block once, in a task of bounded size; a task returns
its k best per query, and those are merged by a partial top-k. No query set is broadcast or gathered.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length
than the query count as no candidates of it; a query's own row (same id) is no candidate; repeated rows of an id are
each a candidate; k best, ties to the smaller id; fewer candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

SCALE = 256
#: Rows and queries of a block, segments per level from coarse to fine, and how far a bound may round down.
ROW_BLOCK, QUERY_BLOCK, LEVELS, SLACK = 4096, 512, (4, 16), 1e-6


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(v) > 0)
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def digest(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment: sqrt(n) * mean, sqrt(n) * deviation. The inner product of two digests bounds that of the rows."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    mean = np.stack([x[:, p].mean(1) * np.sqrt(len(p)) for p in parts], 1)
    dev = np.stack([x[:, p].std(1) * np.sqrt(len(p)) for p in parts], 1)
    return np.concatenate([mean, dev], 1)


def search(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> list[tuple[int, int, int]]:
    """(query, row id, score) of the k best of x for each q; integer components as float64 (exact below 2^53)."""
    order = np.argsort(xid, kind="stable")
    xid, x = xid[order], x[order]
    dx, dq = [digest(x, s) for s in levels], [digest(q, s) for s in levels]
    coarse = dq[0] @ dx[0].T
    out: list[tuple[int, int, int]] = []
    for a in range(len(q)):
        other = np.flatnonzero(xid != qid[a])
        if not len(other):
            continue
        # a first threshold: exact scores of the most promising rows
        bound = coarse[a, other]
        most = min(len(other), 4 * k)
        lead = other[np.argpartition(-bound, most - 1)[:most]]
        exact = x[lead] @ q[a]
        least = np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf
        slack = SLACK * (1 + abs(least))
        left = other[bound >= least - slack]
        for fine_x, fine_q in zip(dx[1:], dq[1:], strict=True):
            left = left[fine_x[left] @ fine_q[a] >= least - slack]
        score = x[left] @ q[a]
        best = np.lexsort((xid[left], -score))[:k]
        out += [(int(qid[a]), int(xid[left[b]]), int(score[b])) for b in best]
    return out


def _run(k: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            for size, q in queries.groupby(queries["v"].map(len)):
                x = rows[rows["v"].map(len) == size]
                if len(x):
                    whole = lambda s: np.floor(SCALE * np.stack(s.to_list()).astype(np.float64))
                    out += search(q["id"].to_numpy(np.int64), whole(q["v"]), x["id"].to_numpy(np.int64), whole(x["v"]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose id is divisible by every."""
    ready(vectors.sparkSession)
    all_rows = stored(usable(vectors, id_col, vec_col), "vectors")
    n, nq = all_rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    h = F.xxhash64("id", "v")  # repeated ids spread too
    rows = all_rows.withColumn("r", F.pmod(h, F.lit(row_blocks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = all_rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    queries = queries.withColumn("b", F.pmod(h, F.lit(query_blocks)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    met = rows.groupBy("r", "b").cogroup(queries.groupBy("r", "b")).applyInPandas(_run(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
