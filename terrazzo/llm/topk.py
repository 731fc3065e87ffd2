"""Exact top-k search by inner product: a KD-tree per shard, searched best first under box bounds.

A query first meets its home shard.  The kth score found travels with it: it then goes only to shards whose box can
still reach that score, first to the most promising ones, whose results raise it again, then to the rest.  In a shard
the open nodes are a queue ordered by bound; nodes under the kth score are never opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrazzo.plans.durable import broadcast_if_small, discard, materialize

LEAF = 256
#: Queries searched at once in a shard.
TOGETHER = 1024
_LEAST = np.iinfo(np.int64).min


class KDTree:
    """Median splits on the widest side, with the tight bounding box of every leaf and inner node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right (-1: leaf)
        lows, highs = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            s, e, parent, side = todo.pop()
            me, own = len(self.nodes), points[self.order[s:e]]
            lo, hi = own.min(0), own.max(0)
            lows.append(lo)
            highs.append(hi)
            self.nodes.append((s, e, -1, -1))
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (p[0], p[1], me if side == 0 else p[2], me if side == 1 else p[3])
            axis = int(np.argmax(hi - lo))
            if e - s > leaf and hi[axis] > lo[axis]:
                half = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, axis], half, kind="introselect")]
                todo += [(s + half, e, me, 1), (s, s + half, me, 0)]
        self.low, self.high = np.array(lows), np.array(highs)
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def _exact(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether double arithmetic holds all inner products of these integers exactly."""
    if not len(queries) or not len(points):
        return True
    return float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1] < 2.0**52


def search(tree: KDTree, ids: np.ndarray, qids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple]:
    """Yields ``(query row, ids, scores)``: each query's best ``k`` in this shard that reach ``floor``.

    Each query opens its best node again and again: an inner node's children join its queue, a leaf is scored.  Queries
    at the same leaf are scored together.  Where doubles could round, scores are 64-bit integers and bounds are widened
    by what rounding could hide.
    """
    ids, n = ids[tree.order], len(queries)
    bound = tree.bounds(queries)
    exact = _exact(queries, tree.points)
    points, asked = (tree.points, queries) if exact else (tree.points.astype(np.int64), queries.astype(np.int64))
    if not exact:
        reach = np.abs(queries) @ np.maximum(np.abs(tree.low), np.abs(tree.high)).T
        bound = bound + reach * 1e-12
    best_s = np.full((n, k), _LEAST)
    best_i = np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    queue = np.full(bound.shape, -np.inf)
    queue[:, 0] = bound[:, 0]
    left, right = (np.array([x[c] for x in tree.nodes]) for c in (2, 3))
    alive = np.arange(n)
    while len(alive):
        node = queue[alive].argmax(1)
        top = queue[alive, node]
        open_ = (top > -np.inf) & (top >= kth[alive].astype(np.float64))
        alive, node = alive[open_], node[open_]
        queue[alive, node] = -np.inf
        inner = left[node] >= 0
        for side in (left, right):
            queue[alive[inner], side[node[inner]]] = bound[alive[inner], side[node[inner]]]
        at, leaf = alive[~inner], node[~inner]
        by = np.argsort(leaf, kind="stable")
        at, leaf = at[by], leaf[by]
        for q in np.split(at, np.flatnonzero(np.diff(leaf)) + 1) if len(at) else []:
            s, e, _, _ = tree.nodes[leaf[np.flatnonzero(at == q[0])[0]]]
            score = (asked[q] @ points[s:e].T).astype(np.int64)
            score[ids[None, s:e] == qids[q][:, None]] = _LEAST
            # only what reaches a query's kth score is merged with its best so far
            new_q, new_p = np.nonzero((score >= kth[q][:, None]) & (score > _LEAST))
            if not len(new_q):
                continue
            hit = np.unique(new_q)
            width = np.bincount(new_q, minlength=len(q))[hit]
            own_q = np.concatenate([np.repeat(np.arange(len(hit)), k), np.repeat(np.arange(len(hit)), width)])
            own_s = np.concatenate([best_s[q[hit]].ravel(), score[new_q, new_p]])
            own_i = np.concatenate([best_i[q[hit]].ravel(), ids[s:e][new_p]])
            order = np.lexsort((own_i, ~own_s, own_q))
            first = np.cumsum(width + k) - width - k
            pick = order[(first[:, None] + np.arange(k)).ravel()]
            best_s[q[hit]] = own_s[pick].reshape(-1, k)
            best_i[q[hit]] = own_i[pick].reshape(-1, k)
            kth[q[hit]] = np.maximum(kth[q[hit]], best_s[q[hit]][:, -1])
    for q in range(n):
        ok = (best_s[q] > _LEAST) & (best_s[q] >= floor[q])
        yield q, best_i[q][ok], best_s[q][ok]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _searcher(k: int):
    """Over rows sorted by shard, points before queries: a tree of each shard's points, then its queries as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids = None, [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            dim, shard, ask = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard", "ask"))
            new = np.ones(len(dim) + 1, bool)
            new[1:-1] = (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (ask[1:] != ask[:-1])
            cut = np.flatnonzero(new)
            out = [[], [], []]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                part, key = b.slice(lo, hi - lo), (int(dim[lo]), int(shard[lo]))
                if key != at:
                    at, held, tree = key, [], None
                v, i = _vectors(part.column("v"), key[0]), part.column("vec_id").to_numpy(zero_copy_only=False)
                if not ask[lo]:
                    held.append((v, i))
                    continue
                if tree is None and held:
                    tree, ids = KDTree(np.concatenate([x[0] for x in held])), np.concatenate([x[1] for x in held])
                    held = []
                if tree is None:
                    continue
                floor = part.column("floor").to_numpy(zero_copy_only=False)
                for p in range(0, hi - lo, TOGETHER):
                    q = slice(p, p + TOGETHER)
                    for r, found, score in search(tree, ids, i[q], v[q], floor[q], k):
                        for o, x in zip(out, (np.full(len(found), i[q][r]), found, score), strict=True):
                            o.append(x)
            cols = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "score"])

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounding box of each shard's rows in a task."""
    low: dict[tuple[int, int], np.ndarray] = {}
    high: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        dim, shard = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "shard"))
        for d in np.unique(dim):
            mine = np.flatnonzero(dim == d)
            v, s = _vectors(b.column("v").take(pa.array(mine)), int(d)), shard[mine]
            order = np.argsort(s, kind="stable")
            names, first = np.unique(s[order], return_index=True)
            for name, lo, hi in zip(names.tolist(), np.minimum.reduceat(v[order], first), np.maximum.reduceat(v[order], first), strict=True):
                key = (int(d), name)
                low[key], high[key] = np.minimum(low.get(key, lo), lo), np.maximum(high.get(key, hi), hi)
    cols = [pa.array([k[0] for k in low], pa.int32()), pa.array([k[1] for k in low], pa.int32())]
    yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[k].astype("<f8").tobytes() for k in low], pa.binary()) for x in (low, high))], ["dim", "shard", "low", "high"])


def _join_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One box a shard from the tasks' boxes; single precision, rounded outwards."""
    low: dict[tuple[int, int], np.ndarray] = {}
    high: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for d, s, lo, hi in zip(*(b.column(c).to_pylist() for c in ("dim", "shard", "low", "high")), strict=True):
            lo, hi = np.frombuffer(lo, "<f8"), np.frombuffer(hi, "<f8")
            low[d, s], high[d, s] = np.minimum(low.get((d, s), lo), lo), np.maximum(high.get((d, s), hi), hi)
    cols = [pa.array([k[0] for k in low], pa.int32()), pa.array([k[1] for k in low], pa.int32())]
    small = [pa.array([np.nextafter(x[k].astype(np.float32), np.float32(end)).tobytes() for k in low], pa.binary()) for x, end in ((low, -np.inf), (high, np.inf))]
    yield pa.RecordBatch.from_arrays([*cols, *small], ["dim", "shard", "low", "high"])


def _router(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], best: int, rest: bool):
    """A row for each query and shard whose box reaches the query's kth score: its ``best`` shards, or the ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                shards, low, high = boxes[row.column("dim")[0].as_py()]
                q = row.column("v")[0].values.to_numpy(zero_copy_only=False)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                bound += np.abs(bound) * 1e-12 + (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12
                bound[shards == row.column("home")[0].as_py()] = -np.inf
                order = np.argsort(-bound, kind="stable")
                order = order[best:] if rest else order[:best]
                to = shards[order[(bound[order] > -np.inf) & (bound[order] >= float(row.column("floor")[0].as_py()))]]
                if len(to):
                    same = row.take(pa.array(np.zeros(len(to), np.int64)))
                    yield pa.RecordBatch.from_arrays([same.column("vec_id"), same.column("v"), same.column("dim"), pa.array(to, pa.int32()), same.column("floor")], ["vec_id", "v", "dim", "shard", "floor"])

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    shard_rows: int = 16384,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: every query row's ``k`` best other rows by integer inner product.

    Components become ``floor(scale * x)``.  Vectors that are null or hold a null or non-finite component take no part,
    nor do rows without an id.  A query never meets rows of its own id; rows that repeat an id are candidates each.
    Only vectors of equal length meet.  Ties go to the smaller id.  With fewer than ``k`` candidates all are returned;
    an empty table gives no rows.  Extra columns are ignored.

    Vectors that share a query's id are one query, whose score is the best of them.  Scores must fit 64 bits.

    Rows are dealt to shards of about ``shard_rows`` by hash of id, so that no shard grows with the input; a row for
    each shard with its box is sent to the tasks that route queries.  A shard's queries pass through it in blocks.
    """
    x = F.col(embedding)
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    clean = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, odd)).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double")).alias("v"),
        is_query.alias("q"),
    )
    clean = materialize(clean.withColumn("dim", F.size("v")), "vectors")
    shards = max(1, -(-clean.count() // shard_rows))
    home = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    points = clean.select("vec_id", "v", "dim", home.alias("shard"), F.lit(0).alias("ask"), F.lit(_LEAST).alias("floor"))
    ask = materialize(clean.where("q").select("vec_id", "v", "dim", home.alias("home")).dropDuplicates(["vec_id", "v"]), "queries")
    parts = max(clean.sparkSession.sparkContext.defaultParallelism, int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found_type = "query_id long, vec_id long, score long"

    def meet(queries: DataFrame) -> DataFrame:
        rows = points.union(queries.select("vec_id", "v", "dim", "shard", F.lit(1).alias("ask"), "floor"))
        return rows.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "ask").mapInArrow(_searcher(k), found_type)

    def with_floor(found: DataFrame) -> DataFrame:
        """Queries with their kth score so far."""
        best = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k)
        best = best.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        cuts.append(materialize(best, "kth"))
        return ask.join(broadcast_if_small(cuts[-1]), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(_LEAST)))

    found = materialize(meet(ask.select("vec_id", "v", "dim", F.col("home").alias("shard"), F.lit(_LEAST).alias("floor"))), "found")
    cuts = [clean, ask, found]
    if shards > 1:
        box_type = "dim int, shard int, low binary, high binary"
        rows = points.select("v", "dim", "shard").mapInArrow(_boxes, box_type).repartition(parts, "dim", "shard").mapInArrow(_join_boxes, box_type).toArrow()  # a row a shard
        boxes: dict = {}
        for d in set(rows.column("dim").to_pylist()):
            mine = rows.filter(pc.equal(rows.column("dim"), d))
            boxes[d] = (mine.column("shard").to_numpy(), *(np.stack([np.frombuffer(v.as_py(), np.float32) for v in mine.column(c)]).astype(np.float64) for c in ("low", "high")))
        best = max(1, math.isqrt(shards))
        for rest in (False, True):
            routed = with_floor(found).mapInArrow(_router(boxes, best, rest), "vec_id long, v array<double>, dim int, shard int, floor long")
            found = materialize(found.union(meet(routed)), "found")
            cuts.append(found)
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = materialize(out, "ranks")
    for cut in cuts:
        discard(cut)
    return out
