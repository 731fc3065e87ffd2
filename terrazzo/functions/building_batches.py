"""Kernels on many rings at once, ``(m, n, 2)`` arrays, with the results of ``kernels`` and ``building_kernels``; see ``batches``."""

from __future__ import annotations

import numpy as np

from . import building_kernels as BK
from . import kernels as K
from .batches import BATCHES, LEAST, LONGEST, ROOM, Ragged, _steps, grouped, masked, merged, places, ragged, starts


def shoelace(p: np.ndarray) -> np.ndarray:
    x, y = p[..., 0] - p[:, :1, 0], p[..., 1] - p[:, :1, 1]
    return (x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(1) / 2


def _chain(q: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone chain over sorted points, those not ``fresh`` left out: stacks, and how many on each but the last."""
    m, n, _ = q.shape
    stack, top, rows = np.zeros_like(q), np.zeros(m, np.int64), np.arange(m)
    for k in range(n):
        c, on = q[:, k], fresh[:, k]
        while True:
            a, b = stack[rows, np.maximum(top - 2, 0)], stack[rows, np.maximum(top - 1, 0)]
            pop = on & (top > 1) & ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]) <= 0)
            if not pop.any():
                break
            top[pop] -= 1
        stack[rows[on], top[on]] = c[on]
        top[on] += 1
    return stack, top - 1


def convex_hull(p: np.ndarray) -> Ragged:
    m, n, _ = p.shape
    q = np.take_along_axis(p, np.lexsort((p[..., 1], p[..., 0]), axis=-1)[..., None], 1)
    new = (q[:, 1:] != q[:, :-1]).any(2)
    one = np.ones((m, 1), bool)
    low, a = _chain(q, np.concatenate([one, new], axis=1))
    high, b = _chain(q[:, ::-1], np.concatenate([one, new[:, ::-1]], axis=1))
    a = np.maximum(a, 1)
    counts = a + b + 1
    at = starts(counts)
    flat = np.empty((at[-1], 2))
    flat[places(at[:-1], a)] = low[np.arange(n)[None] < a[:, None]]
    flat[places(at[:-1] + a, b)] = high[np.arange(n)[None] < b[:, None]]
    flat[at[1:] - 1] = low[:, 0]
    return flat, counts


def concavity(p: np.ndarray) -> np.ndarray:
    flat, counts = convex_hull(p)
    at, out = starts(counts)[:-1], np.empty(len(p))
    for n in np.unique(counts):
        w = np.flatnonzero(counts == n)
        out[w] = np.abs(shoelace(flat[at[w][:, None] + np.arange(n)]))
    with np.errstate(all="ignore"):
        return np.abs(shoelace(p)) / out


def enclosing_rectangle(p: np.ndarray, minimise: str = "area") -> np.ndarray:
    flat, _ = grouped(*convex_hull(p), lambda hull: _rectangle(hull, minimise))
    return flat.reshape(-1, 5, 2)


def _rectangle(hull: np.ndarray, minimise: str) -> np.ndarray:
    m, n, _ = hull.shape
    best, box, turns, rows = np.full(m, np.nan), np.zeros((m, 4, 2)), np.zeros((m, 2, 2)), np.arange(m)
    for k in range(n - 1):
        d = hull[:, k + 1] - hull[:, k]
        a = np.arctan2(d[:, 1], d[:, 0])
        c, s = np.cos(a), np.sin(a)
        r = np.stack([c, -s, s, c], 1).reshape(m, 2, 2)
        q = hull @ r  # as the kernel multiplies: last digits settle rectangles alike
        lo, hi = q.min(1), q.max(1)
        v = (hi - lo).prod(1) if minimise == "area" else (hi - lo).min(1)
        w = np.flatnonzero((v < best - 1e-12) | (k == 0))
        best[w], turns[w] = v[w], r[w]
        box[w] = np.stack([lo[w], np.stack([hi[w, 0], lo[w, 1]], 1), hi[w], np.stack([lo[w, 0], hi[w, 1]], 1)], 1)
    ring = (box @ turns.transpose(0, 2, 1))[:, ::-1]
    total = ring.sum(2).round(7)
    first = np.where(total == total.min(1, keepdims=True), ring[..., 0], np.inf).argmin(1)
    return ring[rows[:, None], (first[:, None] + np.array([0, 1, 2, 3, 0])) % 4]


def elongation(p: np.ndarray) -> np.ndarray:
    s = np.sort(_steps(enclosing_rectangle(p)[:, :3])[1], axis=1)
    return np.where(s[:, 0] > 0, s[:, 1] / np.where(s[:, 0] > 0, s[:, 0], 1.0), np.inf)


def regularize_rectangle(p: np.ndarray, factor: float = 1.0) -> np.ndarray:
    r = enclosing_rectangle(p)
    c = r[:, :4].mean(1, keepdims=True)
    return c + (r - c) * factor


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1]


def _norm(a: np.ndarray) -> np.ndarray:
    return np.hypot(a[..., 0], a[..., 1])


def _by_kept(p: np.ndarray, keep: np.ndarray, least: int, run) -> Ragged:
    """``run(kept vertices, whole rings)`` for rings with as many kept vertices; those with under ``least`` are unchanged."""
    counts, parts = keep.sum(1), []
    for n in np.unique(counts):
        w = np.flatnonzero(counts == n)
        q = p[w]
        parts.append((w, *(ragged(q) if n < least else run(q[keep[w]].reshape(len(w), n, 2), q))))
    return merged(len(p), parts)


def _closing(kept: np.ndarray, rings: np.ndarray, x: np.ndarray) -> Ragged:
    """Vertices of ``x`` that are kept, closed; the whole ring where they are under three."""
    few = kept.sum(1) < 3
    flat, counts = masked(x[~few], kept[~few])
    at, parts = starts(counts), [(np.flatnonzero(few), *ragged(rings[few]))]
    if len(counts):
        out = np.empty((len(flat) + len(counts), 2))
        to = starts(counts + 1)
        out[places(to[:-1], counts)] = flat
        out[to[1:] - 1] = flat[at[:-1]]
        parts.append((np.flatnonzero(~few), out, counts + 1))
    return merged(len(x), parts)


def square_corners(p: np.ndarray, ring: bool, tolerance: float = 8.0, correct: float = 0.6, remove_flat: bool = True) -> Ragged:
    if not ring:
        return ragged(p)
    tolerance, correct = np.radians(tolerance), np.radians(correct)
    keep = np.zeros(p.shape[:2], bool)
    keep[:, :-1] = (np.diff(p, axis=1) != 0).any(2)
    return _by_kept(p, keep, 3, lambda x, rings: _square_corners(x, rings, tolerance, correct, remove_flat))


def _square_corners(x: np.ndarray, rings: np.ndarray, tolerance: float, correct: float, remove_flat: bool) -> Ragged:
    m, n, _ = x.shape
    x, rows = x.copy(), np.arange(m)

    def edges() -> tuple[np.ndarray, np.ndarray]:
        e = np.roll(x, -1, axis=1) - x
        b = np.roll(e, 1, axis=1)
        return e, np.pi - np.abs(np.arctan2(_cross(b, e), _dot(b, e)))

    e, at = edges()
    main = e[rows, _norm(e).argmax(1)]
    for i in range(n):
        off = np.pi - at[:, i]
        w = np.flatnonzero((correct < off) & (off <= tolerance))
        if len(w):
            chord = e[w, i - 1] + e[w, i]
            x[w, i] = x[w, i - 1] + chord * _dot(e[w, i - 1], chord)[:, None] / _dot(chord, chord)[:, None]
            e, at = edges()
    for i in range(n):
        before, after = (i - 1) % n, (i + 1) % n
        quarter, eighth = np.abs(at[:, i] - np.pi / 2), np.abs(at[:, i] - np.pi / 4)
        right = np.abs(at - np.pi / 2) < correct
        across = np.abs(_cross(e, main[:, None]))
        onward = across[:, before] < across[:, i] * (1 - 1e-9)
        to_90 = (correct < quarter) & (quarter <= tolerance)
        to_45 = ~to_90 & (0.01 < eighth) & (eighth <= tolerance) & ~(right[:, before] & right[:, after])
        to_90 &= ~(right[:, before] & ~onward)
        w = np.flatnonzero(to_90 | to_45)
        if not len(w):
            continue
        o = onward[w]
        stays, turns = np.where(o[:, None], -e[w, before], e[w, i]), np.where(o[:, None], e[w, i], -e[w, before])
        v = np.stack([-stays[:, 1], stays[:, 0]], 1) * _norm(turns)[:, None] / _norm(stays)[:, None]
        v = np.where((_dot(v, turns) < 0)[:, None], -v, v)
        side = np.sign(_cross(stays, turns))[:, None]
        u = np.concatenate([stays[:, :1] - side * stays[:, 1:], side * stays[:, :1] + stays[:, 1:]], axis=1) * np.sqrt(0.5)
        x[w, np.where(o, after, before)] = x[w, i] + np.where(to_90[w, None], v, u)
        e, at = edges()
    kept = ~(np.pi - at <= correct) if remove_flat else np.ones((m, n), bool)
    return _closing(kept, rings, x)


def square_orthogonal(p: np.ndarray) -> Ragged:
    sides = np.diff(enclosing_rectangle(p), axis=1)[:, :2]
    long = sides[np.arange(len(p)), _norm(sides).argmax(1)]
    with np.errstate(all="ignore"):
        axis = long / _norm(long)[:, None]
    c, s = axis[:, :1], axis[:, 1:]
    q = np.stack([p[..., 0] * c + p[..., 1] * s, p[..., 1] * c - p[..., 0] * s], -1)
    keep = np.zeros(p.shape[:2], bool)
    keep[:, :-1] = _steps(q)[1] > 0
    counts, parts = keep.sum(1), []
    for n in np.unique(counts):
        w = np.flatnonzero(counts == n)
        if n < 4:
            parts.append((w, *ragged(p[w])))
            continue
        e = np.diff(q[w], axis=1)[keep[w][:, :-1]].reshape(len(w), n, 2)
        parts.append((w, *_facades(q[w][keep[w]].reshape(len(w), n, 2), e, p[w], axis[w])))
    return merged(len(p), parts)


def _facades(q: np.ndarray, e: np.ndarray, rings: np.ndarray, axis: np.ndarray) -> Ragged:
    m, n, _ = q.shape
    flat = np.abs(e[..., 0]) >= np.abs(e[..., 1])
    turn = flat != np.roll(flat, 1, axis=1)
    many = turn.sum(1)
    few = many < 4
    # each ring from its first turn on
    order = ((turn.argmax(1)[:, None] + np.arange(n)) % n)[~few]
    pick = lambda a: np.take_along_axis(a[~few], order if a.ndim == 2 else order[..., None], 1)
    flat, turn, middle, size = pick(flat), pick(turn), pick(q + e / 2), _norm(pick(e))
    label = np.cumsum(turn) - 1
    value = np.where(flat, middle[..., 1], middle[..., 0])
    at = np.bincount(label, weights=(value * size).ravel()) / np.bincount(label, weights=size.ravel())
    level, many = flat[turn], many[~few]
    first = starts(many)
    after = np.arange(len(at)) + 1
    after[first[1:] - 1] = first[:-1]
    xy = np.where(level[:, None], np.stack([at[after], at], 1), np.stack([at, at[after]], 1))
    turned = np.repeat(axis[~few], many, axis=0)
    c, s = turned[:, 0], turned[:, 1]
    xy = np.stack([xy[:, 0] * c - xy[:, 1] * s, xy[:, 0] * s + xy[:, 1] * c], 1)
    out, to = np.empty((len(xy) + len(many), 2)), starts(many + 1)
    out[places(to[:-1], many)] = xy
    out[to[1:] - 1] = xy[first[:-1]]
    return merged(m, [(np.flatnonzero(few), *ragged(rings[few])), (np.flatnonzero(~few), out, many + 1)])


def square_least_squares(
    p: np.ndarray, iterations: int = 1000, stop: float = 0.05, right: float = 10.0, flat: float = 10.0,
    fixed_weight: float = 5, right_weight: float = 100, flat_weight: float = 50,
) -> np.ndarray:
    """As the kernel, with a row for each angle of a ring either way; those that aren't to change have no weight."""
    n, out = p.shape[1] - 1, p.copy()
    if n < 3:
        return out
    home = p[:, :-1]
    u, v = home - np.roll(home, 1, axis=1), np.roll(home, -1, axis=1) - home
    lu, lv = _norm(u), _norm(v)
    turn = np.degrees(np.abs(np.arctan2(_cross(u, v), _dot(u, v))))
    weight = np.concatenate([np.where(np.abs(turn - 90) <= right, right_weight, 0.0), np.where(turn <= flat, flat_weight, 0.0)], axis=1)
    todo = np.flatnonzero((lu > 0).all(1) & (weight > 0).any(1))
    for w in np.array_split(todo, 1 + len(todo) * 8 * n * n // ROOM):
        if len(w):
            out[w, :-1] = _adjusted(home[w], (lu * lv)[w], np.concatenate([np.full((len(w), 2 * n), float(fixed_weight)), weight[w]], axis=1), iterations, stop)
    out[todo, -1] = out[todo, 0]
    return out


def _adjusted(home: np.ndarray, scale: np.ndarray, weight: np.ndarray, iterations: int, stop: float) -> np.ndarray:
    m, n, _ = home.shape
    out, who, x = home.copy(), np.arange(m), home.copy()
    k = np.arange(n)
    before, after = np.roll(k, 1), np.roll(k, -1)
    for _ in range(iterations):
        u, v = x - x[:, before], x[:, after] - x
        jac, res = np.zeros((len(x), 4 * n, 2 * n)), [(x - home[who]).reshape(len(x), -1)]
        jac[:, : 2 * n] = np.eye(2 * n)
        perp = lambda a, sign: sign * np.stack([a[..., 1], -a[..., 0]], -1)
        for at, (g_u, g_v, value) in ((2 * n, (v, u, _dot(u, v))), (3 * n, (perp(v, 1), perp(u, -1), _cross(u, v)))):
            for axis in (0, 1):
                jac[:, at + k, 2 * k + axis] += (g_u[..., axis] - g_v[..., axis]) / scale[who]
                jac[:, at + k, 2 * before + axis] -= g_u[..., axis] / scale[who]
                jac[:, at + k, 2 * after + axis] += g_v[..., axis] / scale[who]
            res.append(value / scale[who])
        wj = (jac * weight[who][..., None]).transpose(0, 2, 1)
        step = np.linalg.solve(wj @ jac, -wj @ np.concatenate(res, axis=1)[..., None]).reshape(len(x), n, 2)
        x = x + step
        out[who] = x
        left = ~(np.abs(step).max((1, 2)) < stop)
        who, x = who[left], x[left]
        if not len(who):
            break
    return out


def _inside(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b = p[:, :-1], p[:, 1:]
    up = (a[..., 1] > at[:, 1:]) != (b[..., 1] > at[:, 1:])
    rise = np.where(b[..., 1] == a[..., 1], 1.0, b[..., 1] - a[..., 1])
    return (up & (at[:, :1] < a[..., 0] + (at[:, 1:] - a[..., 1]) * (b[..., 0] - a[..., 0]) / rise)).sum(1) % 2 == 1


def min_width(p: np.ndarray) -> np.ndarray:
    a, b = p[:, :-1], p[:, 1:]
    n, mid = a.shape[1], (a + b) / 2
    best = _norm(b - a).sum(1)
    side = lambda o, e, z: (e[..., 0] - o[..., 0]) * (z[..., 1] - o[..., 1]) - (e[..., 1] - o[..., 1]) * (z[..., 0] - o[..., 0])
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            d = _norm(mid[:, i] - mid[:, j])
            w = np.flatnonzero(d < best)
            w = w[_inside(p[w], (mid[w, i] + mid[w, j]) / 2)]
            if len(w):
                x, y = mid[w, i, None], mid[w, j, None]
                crossed = (side(x, y, a[w]) * side(x, y, b[w]) < -1e-12) & (side(a[w], b[w], x) * side(a[w], b[w], y) < -1e-12)
                w = w[~crossed.any(1)]
                best[w] = d[w]
    return best


def _crossings(ring: np.ndarray, y: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """Sorted abscissae (m, heights, edges) at which rings cross heights; for edges that don't, ``beyond``."""
    a, b, y = ring[:, None, :-1], ring[:, None, 1:], y[..., None]
    up = (a[..., 1] > y) != (b[..., 1] > y)
    rise = np.where(b[..., 1] == a[..., 1], 1.0, b[..., 1] - a[..., 1])
    x = np.where(up, a[..., 0] + (y - a[..., 1]) * (b[..., 0] - a[..., 0]) / rise, beyond[:, None, None])
    x = np.sort(x, axis=2)
    return x if x.shape[2] % 2 == 0 else np.concatenate([x, np.broadcast_to(beyond[:, None, None], (*x.shape[:2], 1))], axis=2)


def intersection_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b, c, d = p[:, :-1, None], p[:, 1:, None], q[:, None, :-1], q[:, None, 1:]
    r, s, w = b - a, d - c, c - a
    den = _cross(r, s)
    safe = np.where(den == 0, 1.0, den)
    t, u = _cross(w, s) / safe, _cross(w, r) / safe
    met = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    low, high = np.maximum(p[..., 1].min(1), q[..., 1].min(1))[:, None], np.minimum(p[..., 1].max(1), q[..., 1].max(1))[:, None]
    cuts = np.where(met, a[..., 1] + t * r[..., 1], low[..., None]).reshape(len(p), -1)
    # heights out of reach fall on its ends, where slabs have no height
    y = np.sort(np.clip(np.concatenate([p[..., 1], q[..., 1], cuts], axis=1), low, np.maximum(low, high)), axis=1)
    y = np.where(high > low, y, low)
    mid, tall = (y[:, 1:] + y[:, :-1]) / 2, np.diff(y, axis=1)
    beyond = np.maximum(np.abs(p[..., 0]).max(1), np.abs(q[..., 0]).max(1)) * 2 + 1
    f, g = _crossings(p, mid, beyond), _crossings(q, mid, beyond)
    over = np.minimum(f[..., 1::2, None], g[..., None, 1::2]) - np.maximum(f[..., 0::2, None], g[..., None, 0::2])
    return (np.clip(over, 0, None).sum((2, 3)) * tall).sum(1)


def surfacic_distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """1 - intersection / union of ragged rings; NaN where either has under four vertices."""
    at_a, at_b, out = starts(n_a)[:-1], starts(n_b)[:-1], np.full(len(n_a), np.nan)
    ok = (n_a > 3) & (n_b > 3)
    for n, k in np.unique(np.stack([n_a, n_b], 1)[ok], axis=0):
        w = np.flatnonzero((n_a == n) & (n_b == k))
        p, q = a[at_a[w][:, None] + np.arange(n)], b[at_b[w][:, None] + np.arange(k)]
        if max(n, k) > LONGEST // 3 or len(w) < LEAST:
            out[w] = [BK.surfacic_distance(x, y) for x, y in zip(p, q, strict=True)]
            continue
        for part in np.array_split(np.arange(len(w)), 1 + len(w) * int(n * k * (n * k // 4 + n + k)) // ROOM):
            if len(part):
                common = intersection_area(p[part], q[part])
                union = np.abs(shoelace(p[part])) + np.abs(shoelace(q[part])) - common
                out[w[part]] = np.where(union > 0, 1 - common / np.where(union > 0, union, 1.0), 0.0)
    return out


BATCHES |= {
    K.convex_hull: convex_hull,
    K.concavity: concavity,
    K.enclosing_rectangle: enclosing_rectangle,
    K.elongation: elongation,
    K.regularize_rectangle: regularize_rectangle,
    BK.square_corners: square_corners,
    BK.square_orthogonal: square_orthogonal,
    BK.square_least_squares: square_least_squares,
    BK.min_width: min_width,
}
