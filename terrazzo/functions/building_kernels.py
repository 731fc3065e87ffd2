"""Numpy kernels on rings (vertex arrays whose first vertex is repeated): overlay areas, widths and squaring."""

from __future__ import annotations

import numpy as np

from .kernels import enclosing_rectangle, shoelace


def _crossings(ring: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sorted abscissae at which the ring crosses each height of ``y`` (none of which is a vertex's)."""
    a, b = ring[:-1], ring[1:]
    up = (a[None, :, 1] > y[:, None]) != (b[None, :, 1] > y[:, None])
    rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    x = a[None, :, 0] + (y[:, None] - a[None, :, 1]) * (b[:, 0] - a[:, 0])[None] / rise[None]
    return [np.sort(x[k][up[k]]) for k in range(len(y))]


def _shared(u: np.ndarray, v: np.ndarray) -> float:
    """Length common to two sets of disjoint intervals, given as sorted ends."""
    lo = np.maximum(u[0::2, None], v[None, 0::2])
    hi = np.minimum(u[1::2, None], v[None, 1::2])
    return float(np.clip(hi - lo, 0, None).sum())


def intersection_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area common to two simple rings.

    Between successive heights of vertices and edge crossings all borders are straight and don't cross, so the common
    width is linear there and its value at mid-height times the slab's height is exact.
    """
    a, b, c, d = p[:-1, None], p[1:, None], q[None, :-1], q[None, 1:]
    r, s = b - a, d - c
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    w = c - a
    safe = np.where(den == 0, 1.0, den)
    t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / safe
    u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / safe
    met = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    cuts = (a[..., 1] + t * r[..., 1])[met]
    y = np.unique(np.concatenate([p[:, 1], q[:, 1], cuts]))
    y = y[(y >= max(p[:, 1].min(), q[:, 1].min())) & (y <= min(p[:, 1].max(), q[:, 1].max()))]
    if len(y) < 2:
        return 0.0
    mid, high = (y[1:] + y[:-1]) / 2, np.diff(y)
    return float(sum(_shared(x1, x2) * h for x1, x2, h in zip(_crossings(p, mid), _crossings(q, mid), high, strict=True)))


def surfacic_distance(p: np.ndarray, q: np.ndarray) -> float:
    """1 - intersection / union of the areas; 0 when the union has no area."""
    common = intersection_area(p, q)
    union = abs(shoelace(p)) + abs(shoelace(q)) - common
    return 1 - common / union if union > 0 else 0.0


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring[:-1], ring[1:]
    up = (a[:, 1] > y) != (b[:, 1] > y)
    rise = np.where(b[:, 1] == a[:, 1], 1.0, b[:, 1] - a[:, 1])
    return bool((up & (x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / rise)).sum() % 2)


def min_width(p: np.ndarray) -> float:
    """Least distance between middles of edges that share no vertex and see each other inside; else the perimeter."""
    a, b = p[:-1], p[1:]
    n, mid = len(a), (p[:-1] + p[1:]) / 2
    best = float(np.hypot(*(b - a).T).sum())
    side = lambda o, e, z: (e[..., 0] - o[..., 0]) * (z[..., 1] - o[..., 1]) - (e[..., 1] - o[..., 1]) * (z[..., 0] - o[..., 0])
    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            d = float(np.hypot(*(mid[i] - mid[j])))
            if d >= best or not _inside(p, *((mid[i] + mid[j]) / 2)):
                continue
            crossed = (side(mid[i], mid[j], a) * side(mid[i], mid[j], b) < -1e-12) & (side(a, b, mid[i]) * side(a, b, mid[j]) < -1e-12)
            if not crossed.any():
                best = d
    return best


def square_orthogonal(p: np.ndarray) -> np.ndarray:
    """All edges along or across the smallest enclosing rectangle; unchanged with fewer than four facades.

    Successive edges of one direction form a facade, at the mean of their middles weighted by length.
    """
    box = enclosing_rectangle(p)
    sides = np.diff(box, axis=0)[:2]
    long = sides[np.argmax(np.hypot(*sides.T))]
    c, s = long / np.hypot(*long)
    q = p @ np.array([[c, -s], [s, c]])
    e = np.diff(q, axis=0)
    size = np.hypot(*e.T)
    q, e, size = q[:-1][size > 0], e[size > 0], size[size > 0]
    if len(e) < 4:
        return p
    flat = np.abs(e[:, 0]) >= np.abs(e[:, 1])
    turn = np.flatnonzero(flat != np.roll(flat, 1))
    if len(turn) < 4:
        return p
    middle, at = q + e / 2, []
    for k, lo in enumerate(turn):
        hi = turn[(k + 1) % len(turn)]
        run = np.arange(lo, hi if hi > lo else hi + len(e)) % len(e)
        at.append((flat[lo], float(np.average(middle[run, 1 if flat[lo] else 0], weights=size[run]))))
    ring = [(v2, v1) if f1 else (v1, v2) for (f1, v1), (_, v2) in zip(at, at[1:] + at[:1], strict=True)]
    return np.array([*ring, ring[0]]) @ np.array([[c, s], [-s, c]])


def square_corners(p: np.ndarray, tolerance: float = 8.0, correct: float = 0.6, remove_flat: bool = True) -> np.ndarray:
    """Corners within ``tolerance`` degrees of 180, 90 or 45 are made so, one after another; nearer than ``correct`` (45: 0.01 radians) they stay.

    Flat vertices go onto the line of their neighbours first, and are removed in the end.  Of a corner's edges the one less
    along the longest edge of the ring turns about the corner (of two alike the first), at 45 degrees with the length of the
    other.  Repeated vertices count once; a ring that would be left with less than three vertices is unchanged.
    """
    x = p[:-1][(np.diff(p, axis=0) != 0).any(1)].astype(float)
    n, tolerance, correct = len(x), np.radians(tolerance), np.radians(correct)
    if n < 3 or (p[0] != p[-1]).any():
        return p

    def edges() -> tuple[np.ndarray, np.ndarray]:
        """Edges from each vertex, and the angle at each vertex, under 180 degrees on either side."""
        e = np.roll(x, -1, axis=0) - x
        b = np.roll(e, 1, axis=0)
        return e, np.pi - np.abs(np.arctan2(b[:, 0] * e[:, 1] - b[:, 1] * e[:, 0], (b * e).sum(1)))

    e, at = edges()
    main = e[int(np.argmax(np.hypot(*e.T)))]
    for i in range(n):
        if correct < np.pi - at[i] <= tolerance:
            chord = e[i - 1] + e[i]
            x[i] = x[i - 1] + chord * (e[i - 1] @ chord) / (chord @ chord)
            e, at = edges()
    for i in range(n):
        before, after = (i - 1) % n, (i + 1) % n
        off, right = np.abs(at[i] - np.pi / np.array([2, 4])), np.abs(at - np.pi / 2) < correct
        across = np.abs(e[:, 0] * main[1] - e[:, 1] * main[0])
        onward = across[before] < across[i] * (1 - 1e-9)
        stays, turns = (-e[before], e[i]) if onward else (e[i], -e[before])
        if correct < off[0] <= tolerance:
            if right[before] and not onward:
                continue
            v = np.array([-stays[1], stays[0]]) * np.hypot(*turns) / np.hypot(*stays)
            v = -v if v @ turns < 0 else v
        elif 0.01 < off[1] <= tolerance:
            if right[before] and right[after]:
                continue
            side = np.sign(stays[0] * turns[1] - stays[1] * turns[0])
            v = np.array([stays[0] - side * stays[1], side * stays[0] + stays[1]]) * np.sqrt(0.5)
        else:
            continue
        x[after if onward else before] = x[i] + v
        e, at = edges()
    out = x[~(np.pi - at <= correct)] if remove_flat else x
    return np.vstack([out, out[:1]]) if len(out) > 2 else p


def square_least_squares(
    p: np.ndarray, iterations: int = 1000, stop: float = 0.05, right: float = 10.0, flat: float = 10.0,
    fixed_weight: float = 5, right_weight: float = 100, flat_weight: float = 50,
) -> np.ndarray:
    """Gauss-Newton: vertices stay near, angles within ``right`` of 90 and ``flat`` of 180 degrees become so.

    Angles enter as cosine and sine of the edges before and after a vertex; steps end when none exceeds ``stop``.
    """
    home = p[:-1].astype(float)
    n, x = len(home), home.copy()
    before, after = np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)
    u, v = home - home[before], home[after] - home
    lu, lv = np.hypot(*u.T), np.hypot(*v.T)
    if n < 3 or (lu == 0).any():
        return p
    turn = np.degrees(np.abs(np.arctan2(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], (u * v).sum(1))))
    square, straight = np.flatnonzero(np.abs(turn - 90) <= right), np.flatnonzero(turn <= flat)
    if not len(square) + len(straight):
        return p
    weight = np.concatenate([np.full(2 * n, fixed_weight), np.full(len(square), right_weight), np.full(len(straight), flat_weight)])
    for _ in range(iterations):
        u, v = x - x[before], x[after] - x
        jac = np.zeros((len(weight), 2 * n))
        jac[: 2 * n] = np.eye(2 * n)
        res = [(x - home).ravel()]
        at = 2 * n
        for rows, g_u, g_v, value in ((square, v, u, (u * v).sum(1)), (straight, np.column_stack([v[:, 1], -v[:, 0]]), np.column_stack([-u[:, 1], u[:, 0]]), u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])):
            for k in rows:
                scale = lu[k] * lv[k]
                for axis in (0, 1):
                    jac[at, 2 * k + axis] += (g_u[k, axis] - g_v[k, axis]) / scale
                    jac[at, 2 * before[k] + axis] -= g_u[k, axis] / scale
                    jac[at, 2 * after[k] + axis] += g_v[k, axis] / scale
                at += 1
            res.append(value[rows] / (lu[rows] * lv[rows]))
        wj = jac * weight[:, None]
        step = np.linalg.solve(jac.T @ wj, -wj.T @ np.concatenate(res)).reshape(n, 2)
        x += step
        if np.abs(step).max() < stop:
            break
    return np.vstack([x, x[:1]])
