"""Multicriteria decisions: Promethee II net flows within groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


INF = float("inf")


def _pieces(f: Callable[[Column], Column], *pieces: tuple[float, float, float]) -> Callable[[Column], Column]:
    """``f`` with its values by rising advantage: up to each bound ``slope * d + value``."""
    f.pieces = pieces
    return f


def usual() -> Callable[[Column], Column]:
    """Type 1: any advantage is full preference."""
    return _pieces(lambda d: F.when(d > 0, 1.0).otherwise(0.0), (0.0, 0.0, 0.0), (INF, 0.0, 1.0))


def u_shape(q: float) -> Callable[[Column], Column]:
    """Type 2: advantages over ``q``."""
    return _pieces(lambda d: F.when(d > q, 1.0).otherwise(0.0), (q, 0.0, 0.0), (INF, 0.0, 1.0))


def v_shape(p: float) -> Callable[[Column], Column]:
    """Type 3: linear up to ``p``."""
    return _pieces(lambda d: F.when(d <= 0, 0.0).when(d <= p, d / p).otherwise(1.0), (0.0, 0.0, 0.0), (p, 1 / p if p else 0.0, 0.0), (INF, 0.0, 1.0))


def level(p: float, q: float) -> Callable[[Column], Column]:
    """Type 4: half between ``q`` and ``p``."""
    return _pieces(lambda d: F.when(d <= q, 0.0).when(d <= p, 0.5).otherwise(1.0), (q, 0.0, 0.0), (p, 0.0, 0.5), (INF, 0.0, 1.0))


def linear(p: float, q: float) -> Callable[[Column], Column]:
    """Type 5: linear from ``q`` to ``p``."""
    return _pieces(lambda d: F.when(d <= q, 0.0).when(d <= p, (d - q) / (p - q) if p != q else F.lit(0.0)).otherwise(1.0), (q, 0.0, 0.0), (p, 1 / (p - q), -q / (p - q)) if p != q else (p, 0.0, 0.0), (INF, 0.0, 1.0))


def gaussian(s: float) -> Callable[[Column], Column]:
    """Type 6."""
    return lambda d: F.when(d <= 0, 0.0).otherwise(1 - F.exp(-d * d / (2 * s * s)))


def promethee(candidates: DataFrame, group: str, rid: str, criteria: list[tuple[str, Callable, float]]) -> DataFrame:
    """``(group, rid, phi, rank)``: net flows of each group's candidates, ranked ascending (ties to smaller ids).

    ``criteria`` are ``(column, preference function, weight)``.  A lone candidate has flow 0.  A group's columns are held
    in one task, and with functions of straight pieces its flows come from sorted sums: work near its size.  With others
    (``gaussian``) each candidate is compared with its group's array, so groups should be of some hundreds at most.
    """
    if all(hasattr(f, "pieces") for _, f, _ in criteria):
        out = _flows(candidates, group, rid, criteria)
    else:
        out = _flows_by_pairs(candidates, group, rid, criteria)
    return out.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.round("phi", 9), rid)))


def net_flow(x: np.ndarray, pieces: tuple) -> np.ndarray:
    """For each of ``x`` the sum over all y of ``f(x - y) - f(y - x)``; NaN counts nothing, on either side."""
    out, known = np.zeros(len(x)), np.flatnonzero(~np.isnan(x))
    v, of, many = np.unique(x[known], return_inverse=True, return_counts=True)
    n = len(v)
    if not n:
        return out
    if np.isinf(v).any():  # no sums over these: value by value
        part = lambda d: np.select([d <= b for b, _, _ in pieces], [np.where(a == 0, 0.0, a * np.where(np.isinf(d), 0.0, d)) + c for _, a, c in pieces], 1.0)
        with np.errstate(invalid="ignore"):
            out[known] = np.array([((part(u - v) - part(v - u)) * many).sum() for u in v])[of]
        return out
    count, total = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0.0], np.cumsum(many * v)])
    flow = np.zeros(n)
    before_up, before_down, last = np.full(n, n), np.zeros(n, np.int64), -INF
    for bound, slope, value in pieces:
        last = max(last, bound)
        # differences fall with y one way and rise the other; a first guess, then by the differences as they round
        up = np.searchsorted(v, v - last, "left")
        down = np.searchsorted(v, v + last, "right")
        for move in (True, False):
            while True:
                go = (up > 0) & (v - v[up - 1] <= last) if move else (up < n) & ~(v - v[np.minimum(up, n - 1)] <= last)
                if not go.any():
                    break
                up = up - go if move else up + go
            while True:
                go = (down < n) & (v[np.minimum(down, n - 1)] - v <= last) if move else (down > 0) & ~(v[down - 1] - v <= last)
                if not go.any():
                    break
                down = down + go if move else down - go
        flow += (count[before_up] - count[up]) * (slope * v + value) - slope * (total[before_up] - total[up])
        flow -= slope * (total[down] - total[before_down]) + (count[down] - count[before_down]) * (value - slope * v)
        before_up, before_down = up, down
    out[known] = flow[of]
    return out


def _flows(candidates: DataFrame, group: str, rid: str, criteria: list) -> DataFrame:
    cols = list(dict.fromkeys(c for c, _, _ in criteria))
    rows = candidates.select(group, rid, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    terms = [(f"c{cols.index(c)}", f.pieces, w) for c, f, w in criteria]

    def run(t: pa.Table) -> pa.Table:
        column = lambda c: t[c].to_numpy().astype(float)
        sums = lambda t: sum(w * net_flow(x, f) for x, f, w in t)
        phi = sums([(column(c), f, w) for c, f, w in terms])
        ids = t.column(1).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, same, copies = np.unique(ids, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(copies > 1):  # rows of one id aren't compared
            w = np.flatnonzero(same == k)
            phi[w] -= sums([(column(c)[w], f, x) for c, f, x in terms])
        return pa.table([t.column(0), t.column(1), pa.array(phi / max(t.num_rows - 1, 1))], names=[group, rid, "phi"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInArrow(run, f"`{group}` {kinds[group]}, `{rid}` {kinds[rid]}, phi double")


def _flows_by_pairs(candidates: DataFrame, group: str, rid: str, criteria: list) -> DataFrame:
    cols = [c for c, _, _ in criteria]
    peers = candidates.groupBy(group).agg(F.collect_list(F.struct(F.col(rid).alias("rid"), *cols)).alias("peers"))
    j = candidates.join(peers, group)

    def one(b: Column) -> Column:
        out = F.lit(0.0)
        for c, f, w in criteria:
            d = F.col(c) - b[c]
            out = out + w * (f(d) - f(-d))
        return F.when(b["rid"] == F.col(rid), 0.0).otherwise(out)

    n = F.size("peers") - 1
    phi = F.when(n > 0, F.aggregate(F.transform("peers", one), F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    return j.select(group, rid, phi.alias("phi"))


def best(candidates: DataFrame, group: str, rid: str, criteria: list) -> DataFrame:
    """``(group, rid)`` with the largest net flow; ties to the smaller id."""
    r = promethee(candidates, group, rid, criteria)
    return r.groupBy(group).agg(F.min_by(rid, F.struct(-F.round("phi", 9), F.col(rid))).alias(rid))
