"""Kernels on many lines at once, ``(m, n, 2)`` arrays of lines with as many vertices, with the results of ``kernels``.

A function returns an array of lines, or flat vertices and each line's number of them.  Functions in ``RING`` also take
whether the lines are closed.  Long lines and few alike go through the kernels one by one: there vertices fill the arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import building_kernels as BK
from . import kernels as K

#: Lines of more vertices, and groups of fewer lines, are left to the kernels.
LONGEST, LEAST = 48, 3
#: Numbers in a temporary array of functions that compare all vertices of a line.
ROOM = 1 << 22

Ragged = tuple[np.ndarray, np.ndarray]


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets of parts of these sizes, one more than parts."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``counts[i]`` of them, for all i."""
    at = starts(counts)
    return np.repeat(first - at[:-1], counts) + np.arange(at[-1])


def ragged(p: np.ndarray) -> Ragged:
    return p.reshape(-1, 2), np.full(len(p), p.shape[1])


def masked(p: np.ndarray, keep: np.ndarray) -> Ragged:
    return p[keep], keep.sum(1)


def merged(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Ragged:
    """Parts ``(which of n lines, flat, counts)`` as one, by line."""
    counts = np.zeros(n, np.int64)
    for which, _, c in parts:
        counts[which] = c
    at = starts(counts)
    flat = np.empty((at[-1], 2))
    for which, f, c in parts:
        flat[places(at[:-1][which], c)] = f
    return flat, counts


def grouped(flat: np.ndarray, counts: np.ndarray, run: Callable[[np.ndarray], np.ndarray | Ragged]) -> Ragged:
    """``run`` over the lines of each number of vertices."""
    at, parts = starts(counts)[:-1], []
    for n in np.unique(counts):
        which = np.flatnonzero(counts == n)
        out = run(flat[at[which][:, None] + np.arange(n)])
        parts.append((which, *(out if isinstance(out, tuple) else ragged(out))))
    return merged(len(counts), parts)


def one_by_one(p, kernel: Callable, **how) -> Ragged:
    out = [kernel(x, **how) for x in p]
    return (np.concatenate(out) if out else np.zeros((0, 2))), np.array([len(x) for x in out], np.int64)


def apply(flat: np.ndarray, counts: np.ndarray, kernel: Callable, **how) -> Ragged:
    """A line function over ragged lines; lines under two vertices are unchanged."""
    many = BATCHES.get(kernel)

    def run(p: np.ndarray) -> np.ndarray | Ragged:
        if p.shape[1] < 2:
            return p
        if many is None or p.shape[1] > LONGEST or len(p) < LEAST:
            return one_by_one(p, kernel, **how)
        if kernel not in RING:
            return many(p, **how)
        ring = (p[:, 0] == p[:, -1]).all(1) & (p.shape[1] > 2)
        parts = []
        for closed in (False, True):
            which = np.flatnonzero(ring == closed)
            if len(which):
                out = many(p[which], ring=closed, **how)
                parts.append((which, *(out if isinstance(out, tuple) else ragged(out))))
        return merged(len(p), parts)

    return grouped(flat, counts, run)


def numbers(flat: np.ndarray, counts: np.ndarray, kernel: Callable, **how) -> np.ndarray:
    """A measure of ragged rings; NaN under four vertices."""
    many, at, out = BATCHES.get(kernel), starts(counts)[:-1], np.full(len(counts), np.nan)
    for n in np.unique(counts[counts > 3]):
        which = np.flatnonzero(counts == n)
        p = flat[at[which][:, None] + np.arange(n)]
        out[which] = [kernel(x, **how) for x in p] if many is None or n > LONGEST or len(p) < LEAST else many(p, **how)
    return out


def _steps(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(p, axis=1)
    return d, np.hypot(d[..., 0], d[..., 1])


def _along(length: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(length), 1)), np.cumsum(length, axis=1)], axis=1)


def _interpolated(want: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``np.interp`` of each row: ``values`` (m, n, c) at ``at`` (m, n), for ``want`` (m, k) within their reach."""
    n = at.shape[1]
    j = np.zeros(want.shape, np.int64)
    for i in range(1, n):
        j += at[:, i : i + 1] <= want
    k = np.minimum(j, n - 2)
    rise = np.take_along_axis(at, k + 1, 1) - np.take_along_axis(at, k, 1)
    a, b = np.take_along_axis(values, k[..., None], 1), np.take_along_axis(values, k[..., None] + 1, 1)
    inner = (b - a) / np.where(rise == 0, 1.0, rise)[..., None] * (want - np.take_along_axis(at, k, 1))[..., None] + a
    return np.where((j > n - 2)[..., None], values[:, -1:], inner)


def _convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Windows of ``x`` (m, n, ...) weighted with symmetric ``w`` (k) or (m, k)."""
    k = w.shape[-1]
    n = x.shape[1] - k + 1
    by = lambda i: w[..., i] if w.ndim == 1 else w[:, i].reshape(-1, *[1] * (x.ndim - 1))
    out = by(0) * x[:, :n]
    for i in range(1, k):
        out += by(i) * x[:, i : i + n]
    return out


# --- smoothing ---------------------------------------------------------------------------------------------------


def catmull_rom(p: np.ndarray, ring: bool, subdivisions: int = 10, alpha: float = 0.5) -> Ragged:
    keep = np.ones(p.shape[:2], bool)
    keep[:, 1:] = _steps(p)[1] > 0

    def run(p: np.ndarray) -> np.ndarray:
        if p.shape[1] < 3:
            return p
        first, last = (p[:, -2], p[:, 1]) if ring else (2 * p[:, 0] - p[:, 1], 2 * p[:, -1] - p[:, -2])
        q = np.concatenate([first[:, None], p, last[:, None]], axis=1)
        n = q.shape[1] - 3
        d = _steps(q)[1] ** alpha
        t1 = d[:, :n]
        t2 = t1 + d[:, 1 : n + 1]
        t3 = t2 + d[:, 2 : n + 2]
        t = [x[..., None, None] for x in (np.zeros_like(t1), t1, t2, t3)]
        x = np.linspace(t1, t2, subdivisions, endpoint=False, axis=-1)[..., None]
        at = [q[:, k : k + n, None] for k in range(4)]
        f = lambda a, b, u, v: (v - x) / (v - u) * a + (x - u) / (v - u) * b
        a = [f(at[k], at[k + 1], t[k], t[k + 1]) for k in range(3)]
        b = [f(a[k], a[k + 1], t[k], t[k + 2]) for k in range(2)]
        return np.concatenate([f(b[0], b[1], t[1], t[2]).reshape(len(p), -1, 2), p[:, -1:]], axis=1)

    return grouped(*masked(p, keep), run)


def snake(p: np.ndarray, ring: bool, **how) -> np.ndarray:
    return K.snake(p.transpose(1, 0, 2), ring=ring, **how).transpose(1, 0, 2)


def platre(p: np.ndarray, sigma: float = 2, max_curvature: float = 0.05) -> np.ndarray:
    m, n, _ = p.shape
    if n < 4:
        return p
    d, size = _steps(p)
    a = np.unwrap(np.arctan2(d[..., 1], d[..., 0]), axis=1)
    turn = np.abs(np.diff(a, axis=1)) / np.maximum((size[:, :-1] + size[:, 1:]) / 2, 1e-12)
    k = int(6 * sigma + 1) // 2
    w = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma**2))
    a = _convolved(np.pad(a, ((0, 0), (k, k)), mode="edge"), w / w.sum())
    new = np.concatenate([p[:, :1], p[:, :1] + np.cumsum(np.stack([size * np.cos(a), size * np.sin(a)], -1), axis=1)], axis=1)
    pin = np.ones((m, n), bool)
    pin[:, 1:-1] = turn > max_curvature
    at, shift = _along(size), p - new
    # the pins before and after a vertex; vertices of one place take the last of them
    index = np.arange(n)[None]
    ahead = np.concatenate([np.diff(at, axis=1) > 0, np.ones((m, 1), bool)], axis=1)
    end = np.minimum.accumulate(np.where(ahead, index, n)[:, ::-1], axis=1)[:, ::-1]
    before = np.take_along_axis(np.maximum.accumulate(np.where(pin, index, -1), axis=1), end, 1)
    after = np.concatenate([np.minimum.accumulate(np.where(pin, index, n)[:, ::-1], axis=1)[:, ::-1], np.full((m, 1), n)], axis=1)
    after = np.take_along_axis(after, end + 1, 1)
    last = after == n
    after = np.where(last, n - 1, after)
    rise = np.take_along_axis(at, after, 1) - np.take_along_axis(at, before, 1)
    low, high = (np.take_along_axis(shift, x[..., None], 1) for x in (before, after))
    inner = (high - low) / np.where(rise == 0, 1.0, rise)[..., None] * (at - np.take_along_axis(at, before, 1))[..., None] + low
    return new + np.where(last[..., None], low, inner)


def resample(p: np.ndarray, step: float | np.ndarray, keep_vertices: bool = False) -> Ragged:
    if keep_vertices:
        return one_by_one(p, K.resample, step=step, keep_vertices=True)
    at = _along(_steps(p)[1])
    step = np.broadcast_to(np.asarray(step, float), len(p))
    inner = np.maximum(np.ceil((at[:, -1].astype(np.int64) - step) / step), 0).astype(np.int64)
    few = inner <= 16 * LONGEST
    parts = []
    for which in np.array_split(np.flatnonzero(few), 1 + int(few.sum() * (inner[few].max(initial=0) + 2) * 4 // ROOM)):
        if len(which):
            k = inner[which]
            i = np.arange(k.max() + 2)[None]
            want = np.where(i > k[:, None], at[which, -1:], i * step[which, None])
            out = _interpolated(want, at[which], p[which])
            parts.append((which, out[i <= k[:, None] + 1], k + 2))
    for i in np.flatnonzero(~few):
        out = K.resample(p[i], step[i])
        parts.append((np.array([i]), out, np.array([len(out)])))
    return merged(len(p), parts)


def gaussian(p: np.ndarray, ring: bool, sigma: float = 30, sample: float | None = None) -> Ragged:
    lengths = _steps(p)[1]
    still = lengths.sum(1) == 0
    todo = np.flatnonzero(~still)
    parts = [(np.flatnonzero(still), *ragged(p[still]))]
    every = lengths[todo].mean(1) if sample is None else np.full(len(todo), float(sample))
    flat, counts = resample(p[todo], every)
    reach = np.round(4 * sigma / every).astype(np.int64)
    cut = reach >= counts
    reach = np.where(cut, counts - 1, reach)
    sigmas = np.where(cut, reach * every / 4, sigma)
    at = starts(counts)[:-1]
    kinds, of = np.unique(np.stack([counts, reach], 1), axis=0, return_inverse=True)
    for kind, (n, k) in enumerate(kinds):
        which = np.flatnonzero(of.ravel() == kind)
        q = flat[at[which][:, None] + np.arange(n)]
        if k and n > 16 * LONGEST:
            out, counts_out = one_by_one(p[todo[which]], K.gaussian, sigma=sigma, sample=sample)
            parts.append((todo[which], out, counts_out))
            continue
        if k:
            w = np.exp(-(np.arange(-k, k + 1) ** 2)[None] / (2 * sigmas[which, None] ** 2))
            first, last = (q[:, -k:], q[:, :k]) if ring else (2 * q[:, :1] - q[:, 1 : k + 1][:, ::-1], 2 * q[:, -1:] - q[:, -1 - k : -1][:, ::-1])
            q = _convolved(np.concatenate([first, q, last], axis=1), w / w.sum(1, keepdims=True))
            if ring:
                q = np.concatenate([q, q[:, :1]], axis=1)
            else:
                q[:, 0], q[:, -1] = p[todo[which], 0], p[todo[which], -1]
        parts.append((todo[which], *ragged(q)))
    return merged(len(p), parts)


def moving_average(p: np.ndarray, ring: bool, weights=(1.0, 2.0, 1.0), iterations: int = 1) -> np.ndarray:
    w = np.asarray(weights, float) / np.sum(weights)
    h = len(w) // 2
    for _ in range(iterations):
        q = np.concatenate([p[:, -1 - h : -1], p, p[:, 1 : 1 + h]], axis=1) if ring else np.pad(p, ((0, 0), (h, h), (0, 0)), mode="edge")
        new = _convolved(q, w)
        if not ring:
            new[:, 0], new[:, -1] = p[:, 0], p[:, -1]
        p = new
    return p


def _turning(p: np.ndarray) -> np.ndarray:
    d = np.diff(p, axis=1)
    a = np.arctan2(d[..., 1], d[..., 0])
    return np.degrees(np.abs((np.diff(a, axis=1) + np.pi) % (2 * np.pi) - np.pi))


def angular(p: np.ndarray, ring: bool, angle: float = 10.0) -> Ragged:
    who, parts = np.arange(len(p)), []
    while len(who):
        n = p.shape[1]
        if n <= (4 if ring else 2):
            parts.append((who, *ragged(p)))
            break
        t = _turning(np.concatenate([p[:, -2:-1], p], axis=1) if ring else p)
        k = t.argmin(1)
        done = t[np.arange(len(p)), k] >= angle
        parts.append((who[done], *ragged(p[done])))
        p, k, who = p[~done], k[~done], who[~done]
        keep = np.ones(p.shape[:2], bool)
        keep[np.arange(len(p)), k if ring else k + 1] = False
        p = p[keep].reshape(len(p), n - 1, 2)
        if ring:  # without its first vertex, a ring closes at the second
            p[k == 0, -1] = p[k == 0, 0]
    return merged(sum(len(x[0]) for x in parts), parts)


def topographic(p: np.ndarray, ring: bool, iterations: int = 2, angle: float = 10.0, weights=(1.0, 2.0, 1.0)) -> Ragged:
    p = moving_average(p, ring, weights, iterations)
    closed = (p[:, 0] == p[:, -1]).all(1) & (p.shape[1] > 2)
    parts = [(w, *angular(p[w], bool(c), angle)) for c in (False, True) if len(w := np.flatnonzero(closed == c))]
    return merged(len(p), parts)


# --- simplification ----------------------------------------------------------------------------------------------


def _offline(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of ``p`` (m, n, 2) to the lines through ``a`` and ``b`` (m, 2)."""
    d = b - a
    n = np.hypot(d[:, 0], d[:, 1])[:, None]
    e = p - a[:, None]
    return np.where(n == 0, np.hypot(e[..., 0], e[..., 1]), np.abs(d[:, :1] * e[..., 1] - d[:, 1:] * e[..., 0]) / np.where(n == 0, 1.0, n))


def douglas_peucker(p: np.ndarray, threshold: float) -> Ragged:
    m, n, _ = p.shape
    keep = np.zeros((m, n), bool)
    keep[:, [0, -1]] = True
    who, lo, hi = np.arange(m), np.zeros(m, np.int64), np.full(m, n - 1)
    while len(who):
        found = []
        for size in np.unique(hi - lo):
            if size < 2:
                continue
            w = np.flatnonzero(hi - lo == size)
            line, i, j = who[w], lo[w], hi[w]
            d = _offline(p[line[:, None], i[:, None] + 1 + np.arange(size - 1)], p[line, i], p[line, j])
            k = d.argmax(1)
            cut = d[np.arange(len(w)), k] > threshold
            line, i, j, k = line[cut], i[cut], j[cut], (i + 1 + k)[cut]
            keep[line, k] = True
            found += [(line, i, k), (line, k, j)]
        who, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return masked(p, keep)


def raposo(p: np.ndarray, initial_scale: float, final_scale: float, use_centroid: bool = True, tobler: bool = False) -> Ragged:
    m, n, _ = p.shape
    if n < 3:
        return ragged(p)
    if not use_centroid:
        return one_by_one(p, K.raposo, initial_scale=initial_scale, final_scale=final_scale, use_centroid=False, tobler=tobler)
    size = np.full(m, final_scale * 5 / 4000) if tobler else _steps(p)[1].sum(1) / (n - 1) * final_scale / initial_scale
    r = (size / np.sqrt(3))[:, None]
    x0, y0 = p[:, :1, 0], p[:, :1, 1]
    with np.errstate(all="ignore"):
        x = (np.sqrt(3) / 3 * (p[..., 0] - x0) - (p[..., 1] - y0) / 3) / r
        z = 2 / 3 * (p[..., 1] - y0) / r
        y = -x - z
        rx, ry, rz = np.round(x), np.round(y), np.round(z)
        dx, dy, dz = abs(rx - x), abs(ry - y), abs(rz - z)
    rx = np.where((dx > dy) & (dx > dz), -ry - rz, rx)
    rz = np.where((dz >= dx) & (dz >= dy), -rx - ry, rz)
    new = np.ones((m, n - 1), bool)
    new[:, 1:] = (rx[:, 2:] != rx[:, 1:-1]) | (rz[:, 2:] != rz[:, 1:-1])
    label = np.cumsum(new) - 1
    many = np.bincount(label)
    mean = np.stack([np.bincount(label, weights=p[:, 1:, k].ravel()) / many for k in (0, 1)], 1)
    clusters = new.sum(1)
    last = mean[starts(clusters)[1:] - 1]
    ends = (last != p[:, -1]).any(1)
    counts = 1 + clusters + ends
    at = starts(counts)
    flat = np.empty((at[-1], 2))
    flat[at[:-1]] = p[:, 0]
    flat[places(at[:-1] + 1, clusters)] = mean
    flat[at[1:][ends] - 1] = p[ends, -1]
    return flat, counts


def wang_muller(p: np.ndarray, tolerance: float) -> Ragged:
    least = 0.75 * np.pi * (tolerance / 2) ** 2
    who, flat, counts = np.arange(len(p)), *ragged(p)
    parts, total = [], len(p)
    while len(who):
        at, left = starts(counts)[:-1], []
        for n in np.unique(counts):
            w = np.flatnonzero(counts == n)
            q, ids = flat[at[w][:, None] + np.arange(n)], who[w]
            keep, done = _without_small_bends(q, least)
            parts.append((ids[done], *ragged(q[done])))
            if not done.all():
                left.append((ids[~done], *masked(q[~done], keep[~done])))
        if not left:
            break
        who, flat, counts = (np.concatenate(x) for x in zip(*left, strict=True))
    return merged(total, parts)


def _without_small_bends(p: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Vertices that stay in the next step of ``wang_muller`` (flat ones go alone, as a step), and lines that are done."""
    m, n, _ = p.shape
    keep = np.ones((m, n), bool)
    if n < 3:
        return keep, np.ones(m, bool)
    d, size = _steps(p)
    cross = d[:, :-1, 0] * d[:, 1:, 1] - d[:, :-1, 1] * d[:, 1:, 0]
    bent = np.abs(np.arctan2(cross, -(d[:, :-1] * d[:, 1:]).sum(2))) % np.pi
    keep[:, 1:-1] = ~(np.minimum(bent, np.pi - bent) <= 1e-6)
    flat = ~keep.all(1)
    # runs of turns to one side, numbered within their line
    run = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(np.sign(cross[:, 1:]) != np.sign(cross[:, :-1]), axis=1)], axis=1)
    most = int(run.max()) + 1
    cell = run + np.arange(m)[:, None] * most
    inner = np.arange(1, n - 1)[None]
    first, last = np.full(m * most, n), np.zeros(m * most, np.int64)
    np.minimum.at(first, cell.ravel(), np.broadcast_to(inner, cell.shape).ravel())
    np.maximum.at(last, cell.ravel(), np.broadcast_to(inner, cell.shape).ravel())
    is_run = last > 0
    line, before, after = np.repeat(np.arange(m), most), np.where(is_run, first - 1, 0), np.where(is_run, last + 1, 0)
    o = p[line, before].reshape(m, most, 2)
    own = np.take_along_axis(o, run[..., None], 1)
    a, b = p[:, 1:-1] - own, p[:, 2:] - own
    swept = np.bincount(cell.ravel(), weights=(a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]).ravel(), minlength=m * most)
    area = np.abs(swept / 2)
    # the way round: the edge before the run, its own, and the chord, added in this order
    opening = np.where(is_run, size[line, before], 0.0)
    edges = np.concatenate([opening, size[:, 1:].ravel()])
    chord = p[line, before] - p[line, after]
    around = np.bincount(np.concatenate([np.arange(m * most), cell.ravel()]), weights=edges, minlength=m * most) + np.hypot(chord[:, 0], chord[:, 1])
    quotient = np.where(around > 0, 0.75 * 4 * np.pi * area / np.where(around > 0, around, 1.0) ** 2, 0.0)
    small = (is_run & (area < least) & (quotient <= least)).reshape(m, most)
    open_, going = np.where(small & ~flat[:, None], quotient.reshape(m, most), np.inf), np.zeros((m, most), bool)
    while True:
        k = open_.argmin(1)
        rows = np.flatnonzero(np.isfinite(open_[np.arange(m), k]))
        if not len(rows):
            break
        k = k[rows]
        going[rows, k] = True
        for near in (k - 1, k, k + 1):
            ok = (near >= 0) & (near < most)
            open_[rows[ok], near[ok]] = np.inf
    bends = np.ones((m, n), bool)
    bends[:, 1:-1] = ~np.take_along_axis(going, run, 1)
    closed = (p[:, 0] == p[:, -1]).all(1)
    done = ~flat & (~going.any(1) | (closed & (bends.sum(1) < 4)))
    return np.where(flat[:, None], keep, bends), done


# --- bends -------------------------------------------------------------------------------------------------------


def bends(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(line, first, last)`` of the bends of ragged lines of two vertices or more, in order."""
    at, found = starts(counts)[:-1], []
    for n in np.unique(counts):
        w = np.flatnonzero(counts == n)
        p = flat[at[w][:, None] + np.arange(n)]
        d = np.diff(p, axis=1)
        s = np.sign(d[:, :-1, 0] * d[:, 1:, 1] - d[:, :-1, 1] * d[:, 1:, 0])
        cut = np.zeros((len(w), n), bool)
        cut[:, 0] = True
        if n > 2:
            seen = np.maximum.accumulate(np.where(s != 0, np.arange(n - 2)[None], -1), axis=1)
            side = np.where(seen >= 0, np.take_along_axis(s, np.maximum(seen, 0), 1), 0.0)
            cut[:, 2:-1] = (s[:, 1:] != 0) & (side[:, :-1] != 0) & (s[:, 1:] != side[:, :-1])
        row, first = np.nonzero(cut)
        ends = np.concatenate([row[1:] != row[:-1], [True]])
        last = np.where(ends, n - 1, np.concatenate([first[1:], [0]]))
        found.append((w[row], first, last))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    line, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((first, line))
    return line[order], first[order], last[order]


def bend_measures(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bends a line, and their seven measures as columns."""
    ok = np.flatnonzero(counts > 1)
    line, first, last = bends(flat[places(starts(counts)[:-1][ok], counts[ok])], counts[ok])
    line = ok[line]
    begin = starts(counts)[:-1][line] + first
    out = np.zeros((len(line), 6))
    for size in np.unique(last - first):
        w = np.flatnonzero(last - first == size)
        b = flat[begin[w][:, None] + np.arange(size + 1)]
        off = _offline(b, b[:, 0], b[:, -1])
        top = off.argmax(1)
        step = _steps(b)[1]
        early = np.arange(size)[None] < top[:, None]
        ways = np.sort(np.stack([np.where(early, step, 0.0).sum(1), np.where(early, 0.0, step).sum(1)], 1), axis=1)
        chord = b[:, -1] - b[:, 0]
        width, height = np.hypot(chord[:, 0], chord[:, 1]), off[np.arange(len(w)), top]
        e = b - b[:, :1]
        swept = (e[:, :-1, 0] * e[:, 1:, 1] - e[:, 1:, 0] * e[:, :-1, 1]).sum(1)
        share = np.where(ways[:, 1] > 0, ways[:, 0] / np.where(ways[:, 1] > 0, ways[:, 1], 1.0), 0.0)
        out[w] = np.stack([width, height, step.sum(1), share, (4 * height + width) / 5, np.abs(swept / 2)], 1)
    return np.bincount(line, minlength=len(counts)), [first, *out.T]


def accordion(p: np.ndarray, width: float, exaggeration: float = 1.0, sigma: float | None = None) -> np.ndarray | Ragged:
    if sigma is not None:
        return one_by_one(p, K.accordion, width=width, exaggeration=exaggeration, sigma=sigma)
    m, n, _ = p.shape
    line, first, last = bends(*ragged(p))
    push, share = np.zeros((len(line), 2)), np.zeros((m, n))
    for size in np.unique(last - first):
        w = np.flatnonzero(last - first == size)
        at = first[w][:, None] + np.arange(size + 1)
        b = p[line[w][:, None], at]
        chord = b[:, -1] - b[:, 0]
        long = np.hypot(chord[:, 0], chord[:, 1])
        way = _along(_steps(b)[1])
        moves = (long > 0) & (way[:, -1] > 0)
        top = np.take_along_axis(b, _offline(b, b[:, 0], b[:, -1]).argmax(1)[:, None, None], 1)[:, 0] - b[:, 0]
        side = np.sign(chord[:, 0] * top[:, 1] - chord[:, 1] * top[:, 0])
        across = side[:, None] * np.stack([-chord[:, 1], chord[:, 0]], 1) / np.where(long > 0, long, 1.0)[:, None] * width * exaggeration
        push[w] = np.where(moves[:, None], across, 0.0)
        share[line[w][:, None], at[:, 1:]] = (way / np.where(way[:, -1:] > 0, way[:, -1:], 1.0))[:, 1:]
    # the bend of each vertex but the first, and what the bends before it have pushed
    rank = np.arange(len(line)) - starts(np.bincount(line, minlength=m))[:-1][line]
    pushes = np.zeros((m, int(rank.max(initial=0)) + 2, 2))
    pushes[line, rank + 1] = push
    base = np.cumsum(pushes, axis=1)
    begins = np.zeros((m, n), np.int64)
    begins[line, first] = 1
    bend = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(begins, axis=1)[:, :-1] - 1], axis=1)[..., None]
    moved = p + np.take_along_axis(base, bend, 1) + share[..., None] * np.take_along_axis(pushes, bend + 1, 1)
    moved[:, 0] = p[:, 0]
    return moved + _middle(p) - _middle(moved)


def _middle(p: np.ndarray) -> np.ndarray:
    far = _along(_steps(p)[1])
    return _interpolated(far[:, -1:] / 2, far, p)


#: Batch functions by kernel.
BATCHES: dict[Callable, Callable] = {
    K.catmull_rom: catmull_rom,
    K.snake: snake,
    K.platre: platre,
    K.gaussian: gaussian,
    K.resample: resample,
    K.topographic: topographic,
    K.angular: angular,
    K.douglas_peucker: douglas_peucker,
    K.raposo: raposo,
    K.wang_muller: wang_muller,
    K.accordion: accordion,
}
RING = {K.catmull_rom, K.snake, K.gaussian, K.topographic, K.angular, BK.square_corners}
