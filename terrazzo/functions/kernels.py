"""Numpy kernels on ``(n, 2)`` vertex arrays.  A ring repeats its first vertex at the end."""

from __future__ import annotations

import heapq

import numpy as np


def _closed(p: np.ndarray) -> bool:
    return len(p) > 2 and bool((p[0] == p[-1]).all())


def _offline(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to the line through ``a`` and ``b`` (to ``a`` where they coincide)."""
    d = b - a
    n = float(np.hypot(*d))
    if n == 0:
        return np.hypot(*(p - a).T)
    return np.abs(d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])) / n


# --- simplification ----------------------------------------------------------------------------------------------


def douglas_peucker(p: np.ndarray, threshold: float) -> np.ndarray:
    """Splits at the vertex farthest from the chord while it is farther than ``threshold``."""
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d = _offline(p[i + 1 : j], p[i], p[j])
        k = int(np.argmax(d))
        if d[k] > threshold:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[keep]


def effective_areas(p: np.ndarray) -> np.ndarray:
    """Visvalingam-Whyatt effective areas, made monotone; infinite at the ends."""
    n = len(p)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    out, gone = np.full(n, np.inf), np.zeros(n, bool)

    def tri(i: int) -> float:
        a, b, c = p[before[i]], p[i], p[after[i]]
        return abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2

    heap = [(tri(i), i) for i in range(1, n - 1)]
    for a, i in heap:
        out[i] = a
    heapq.heapify(heap)
    floor = 0.0
    while heap:
        a, i = heapq.heappop(heap)
        if gone[i] or a != out[i]:
            continue
        gone[i] = True
        floor = out[i] = max(a, floor)
        x, y = before[i], after[i]
        after[x], before[y] = y, x
        for k in (x, y):
            if 0 < k < n - 1:
                out[k] = max(tri(k), floor)
                heapq.heappush(heap, (out[k], k))
    return out


def visvalingam_whyatt(p: np.ndarray, threshold: float | None = None, number: int | None = None, ratio: float | None = None) -> np.ndarray:
    """By area (kept from ``threshold`` on), or the ``number`` (or share) of inner vertices with the largest areas."""
    if sum(x is not None for x in (threshold, number, ratio)) != 1:
        raise ValueError("give exactly one of threshold, number and ratio")
    a = effective_areas(p)
    if threshold is not None:
        return p[a >= threshold]
    k = number if number is not None else int(len(p) * ratio)
    order = np.argsort(-a, kind="stable")[: max(2, k)]
    return p[np.sort(order)]


def li_openshaw(p: np.ndarray, cell: float, ends: bool = True) -> np.ndarray:
    """Runs of vertices in one raster cell (origin 0) become their mean; a line that would vanish stays."""
    c = np.floor(p / cell)
    new = np.ones(len(p), bool)
    new[1:] = (c[1:] != c[:-1]).any(1)
    g = np.cumsum(new) - 1
    n = np.bincount(g)
    out = np.column_stack([np.bincount(g, weights=p[:, k]) / n for k in (0, 1)])
    if ends:
        out = np.vstack([p[:1], out[1 if n[0] == 1 else 0 :]])
        out = np.vstack([out[: -1 if n[-1] == 1 and len(out) > 1 else None], p[-1:]])
    return out if len(out) > 1 else p


def lang(p: np.ndarray, tolerance: float, look_ahead: int = 5) -> np.ndarray:
    """Jumps to the farthest of the next ``look_ahead`` vertices whose chord is within ``tolerance`` of those between."""
    out, i = [0], 0
    while i < len(p) - 1:
        j = min(i + look_ahead, len(p) - 1)
        while j > i + 1 and (_offline(p[i + 1 : j], p[i], p[j]) > tolerance).any():
            j -= 1
        out.append(j)
        i = j
    return p[out]


def reumann_witkam(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Drops vertices inside a corridor along the segment that follows each kept vertex."""
    if len(p) < 3:
        return p
    out, key = [0], 0
    for i in range(2, len(p)):
        if _offline(p[i : i + 1], p[key], p[key + 1])[0] > tolerance:
            key = i - 1
            out.append(key)
    return p[[*out, len(p) - 1]]


def whirlpool(p: np.ndarray, threshold: float) -> np.ndarray:
    out = [0]
    for i in range(1, len(p)):
        if np.hypot(*(p[i] - p[out[-1]])) >= threshold:
            out.append(i)
    return p[out if out[-1] == len(p) - 1 else [*out, len(p) - 1]]


def turning(p: np.ndarray) -> np.ndarray:
    """Absolute change of direction at inner vertices, in degrees."""
    d = np.diff(p, axis=0)
    a = np.arctan2(d[:, 1], d[:, 0])
    return np.degrees(np.abs((np.diff(a) + np.pi) % (2 * np.pi) - np.pi))


def angular(p: np.ndarray, angle: float = 10.0) -> np.ndarray:
    """Repeatedly drops inner vertices that turn by less than ``angle`` degrees, the flattest first."""
    ring = _closed(p)
    while len(p) > (4 if ring else 2):
        t = turning(np.vstack([p[-2:-1], p]) if ring else p)
        k = int(np.argmin(t))
        if t[k] >= angle:
            break
        if ring:
            p = np.delete(p, k, 0) if k else p[1:-1]
            p = p if k else np.vstack([p, p[:1]])
        else:
            p = np.delete(p, k + 1, 0)
    return p


def raposo(p: np.ndarray, initial_scale: float, final_scale: float, use_centroid: bool = True, tobler: bool = False) -> np.ndarray:
    """Vertices after the first clustered by hexagon along the line; each visit gives its mean or the vertex nearest to that.

    The first and last vertex stay; a ring closes.
    """
    if len(p) < 3:
        return p
    size = final_scale * 5 / 4000 if tobler else np.hypot(*np.diff(p, axis=0).T).sum() / (len(p) - 1) * final_scale / initial_scale
    r = size / np.sqrt(3)
    q = (np.sqrt(3) / 3 * (p[:, 0] - p[0, 0]) - (p[:, 1] - p[0, 1]) / 3) / r
    s = 2 / 3 * (p[:, 1] - p[0, 1]) / r
    x, z, y = q, s, -q - s
    rx, ry, rz = np.round(x), np.round(y), np.round(z)
    dx, dy, dz = abs(rx - x), abs(ry - y), abs(rz - z)
    rx = np.where((dx > dy) & (dx > dz), -ry - rz, rx)
    rz = np.where((dz >= dx) & (dz >= dy), -rx - ry, rz)
    moves = (rx[2:] != rx[1:-1]) | (rz[2:] != rz[1:-1])
    out = [p[0]]
    for cluster in np.split(p[1:], np.flatnonzero(moves) + 1):
        m = cluster.mean(0)
        out.append(m if use_centroid else cluster[np.argmin(np.hypot(*(cluster - m).T))])
    if (out[-1] != p[-1]).any():
        out.append(p[-1])
    return np.vstack(out)


def bends(p: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges between changes of turning side."""
    d = np.diff(p, axis=0)
    s = np.sign(d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0])
    cuts, side = [0], 0
    for i, v in enumerate(s):
        if v and side and v != side:
            cuts.append(i + 1)
        side = v or side
    cuts.append(len(p) - 1)
    return list(zip(cuts, cuts[1:], strict=False))


def _turn_runs(p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """``p`` without flat vertices, and the first and last vertex of each run of turns to one side."""
    while len(p) > 2:
        d = np.diff(p, axis=0)
        cross = d[:-1, 0] * d[1:, 1] - d[:-1, 1] * d[1:, 0]
        flat = np.abs(np.arctan2(cross, -(d[:-1] * d[1:]).sum(1))) % np.pi
        flat = np.minimum(flat, np.pi - flat) <= 1e-6
        if not flat.any():
            break
        p = p[np.concatenate([[True], ~flat, [True]])]
    if len(p) < 3:
        return p, []
    cut = np.flatnonzero(np.sign(cross[1:]) != np.sign(cross[:-1]))
    return p, list(zip([1, *(cut + 2).tolist()], [*(cut + 1).tolist(), len(p) - 2], strict=True))


def wang_muller(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Bends of less than three quarters of the area of a disc of diameter ``tolerance`` become chords, until none is left.

    A bend is a run of turns to one side with the vertices before and after it.  In a round bends go in order of their
    isoperimetric quotient (four pi times area by squared perimeter, times 0.75), the smallest first, and none beside
    one that goes.  Flat vertices go too.  Rings are taken from their first vertex.
    """
    least = 0.75 * np.pi * (tolerance / 2) ** 2
    while True:
        p, runs = _turn_runs(p)
        found = []
        for k, (i, j) in enumerate(runs):
            b = np.vstack([p[i - 1 : j + 2], p[i - 1 : i]])
            area, around = abs(shoelace(b)), np.hypot(*np.diff(b, axis=0).T).sum()
            quotient = 0.75 * 4 * np.pi * area / around**2 if around else 0.0
            if area < least and quotient <= least:
                found.append((quotient, k))
        going: set[int] = set()
        for _, k in sorted(found):
            if not going & {k - 1, k + 1}:
                going.add(k)
        keep = np.ones(len(p), bool)
        for k in going:
            keep[runs[k][0] : runs[k][1] + 1] = False
        if not going or (_closed(p) and keep.sum() < 4):
            return p
        p = p[keep]


def remove_flat_vertices(p: np.ndarray, tolerance: float = 5.0) -> np.ndarray:
    """Drops inner vertices whose angle is within ``tolerance`` degrees of flat, judged on the input."""
    if len(p) < 3:
        return p
    keep = np.ones(len(p), bool)
    keep[1:-1] = turning(p) > tolerance
    out = p[keep]
    if _closed(p) and len(out) > 4 and turning(np.vstack([p[-2:-1], p[:2]]))[0] <= tolerance:
        out = np.vstack([out[1:-1], out[1:2]])
    return out


# --- smoothing ---------------------------------------------------------------------------------------------------


def resample(p: np.ndarray, step: float, keep_vertices: bool = False) -> np.ndarray:
    """Points every ``step`` along the line, and its ends (and vertices)."""
    at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    want = np.concatenate([[0.0], np.arange(step, int(at[-1]), step), [at[-1]]])
    if keep_vertices:
        want = np.unique(np.concatenate([want, at]))
    return np.column_stack([np.interp(want, at, p[:, k]) for k in (0, 1)])


def moving_average(p: np.ndarray, weights=(1.0, 2.0, 1.0), iterations: int = 1) -> np.ndarray:
    """Weighted moving average; ends of open lines stay, rings wrap."""
    w = np.asarray(weights, float) / np.sum(weights)
    h, ring = len(w) // 2, _closed(p)
    for _ in range(iterations):
        q = np.vstack([p[-1 - h : -1], p, p[1 : 1 + h]]) if ring else np.pad(p, ((h, h), (0, 0)), mode="edge")
        new = np.column_stack([np.convolve(q[:, k], w[::-1], "valid") for k in (0, 1)])
        if not ring:
            new[0], new[-1] = p[0], p[-1]
        p = new
    return p


def gaussian(p: np.ndarray, sigma: float = 30, sample: float | None = None) -> np.ndarray:
    """Resampled, then averaged with Gaussian weights of the distance in vertices; lines extended by inversion at their ends.

    The window reaches ``round(4 * sigma / sample)`` vertices; where the line has fewer, window and sigma shrink to it.
    """
    lengths = np.hypot(*np.diff(p, axis=0).T)
    if lengths.sum() == 0:
        return p
    sample = float(lengths.mean()) if sample is None else sample
    q, ring = resample(p, sample), _closed(p)
    k = round(4 * sigma / sample)
    if k >= len(q):
        k = len(q) - 1
        sigma = k * sample / 4
    if k == 0:
        return q
    w = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma**2))
    ext = np.vstack([q[-k:], q, q[:k]]) if ring else np.vstack([2 * q[0] - q[1 : k + 1][::-1], q, 2 * q[-1] - q[-1 - k : -1][::-1]])
    out = np.column_stack([np.convolve(ext[:, c], w / w.sum(), "valid") for c in (0, 1)])
    if ring:
        return np.vstack([out, out[:1]])
    out[0], out[-1] = p[0], p[-1]
    return out


def taubin(p: np.ndarray, iterations: int = 10, smoothing: float = 0.5, inflation: float = -0.53) -> np.ndarray:
    """Alternate shrinking and inflating passes towards the mean of the neighbours."""
    ring = _closed(p)
    for f in [smoothing, inflation] * iterations:
        new = p.copy()
        new[1:-1] = (1 - f) * p[1:-1] + f * (p[:-2] + p[2:]) / 2
        if ring:
            new[0] = new[-1] = (1 - f) * p[0] + f * (p[1] + p[-2]) / 2
        p = new
    return p


def chaikin(p: np.ndarray, iterations: int = 3, keep_ends: bool = True) -> np.ndarray:
    """Corner cutting; ends of open lines kept on demand."""
    ring, ends = _closed(p), (p[:1], p[-1:])
    if len(p) < 3:
        return p
    for _ in range(iterations):
        a, b = p[:-1], p[1:]
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
        p = np.vstack([cut, cut[:1]]) if ring else cut if not keep_ends else np.vstack([ends[0], cut[1:-1], ends[1]])
    return p


def catmull_rom(p: np.ndarray, subdivisions: int = 10, alpha: float = 0.5) -> np.ndarray:
    """Interpolating spline through the vertices (0.5: centripetal)."""
    keep = np.ones(len(p), bool)
    keep[1:] = np.hypot(*np.diff(p, axis=0).T) > 0
    ring, p = _closed(p), p[keep]
    if len(p) < 3:
        return p
    q = np.vstack([p[-2:-1], p, p[1:2]]) if ring else np.vstack([2 * p[0] - p[1], p, 2 * p[-1] - p[-2]])
    out = []
    for i in range(1, len(q) - 2):
        t = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(q[i - 1 : i + 3], axis=0).T) ** alpha)])
        x = np.linspace(t[1], t[2], subdivisions, endpoint=False)[:, None]
        f = lambda a, b, u, v, x=x: (v - x) / (v - u) * a + (x - u) / (v - u) * b
        a = [f(q[i - 1 + k], q[i + k], t[k], t[k + 1]) for k in range(3)]
        b = [f(a[k], a[k + 1], t[k], t[k + 2]) for k in range(2)]
        out.append(f(b[0], b[1], t[1], t[2]))
    return np.vstack([*out, p[-1:]])


def platre(p: np.ndarray, sigma: float = 2, max_curvature: float = 0.05) -> np.ndarray:
    """Smooths segment directions, rebuilds the line, and pins its ends and sharp vertices by interpolated shifts."""
    if len(p) < 4:
        return p
    d = np.diff(p, axis=0)
    n, a = np.hypot(*d.T), np.unwrap(np.arctan2(d[:, 1], d[:, 0]))
    turn = np.abs(np.diff(a)) / np.maximum((n[:-1] + n[1:]) / 2, 1e-12)
    k = int(6 * sigma + 1) // 2
    w = np.exp(-(np.arange(-k, k + 1) ** 2) / (2 * sigma**2))
    a = np.convolve(np.pad(a, k, mode="edge"), w / w.sum(), "valid")
    new = np.vstack([p[:1], p[0] + np.cumsum(np.column_stack([n * np.cos(a), n * np.sin(a)]), 0)])
    pins = np.unique(np.concatenate([[0], 1 + np.flatnonzero(turn > max_curvature), [len(p) - 1]]))
    at = np.concatenate([[0], np.cumsum(n)])
    return new + np.column_stack([np.interp(at, at[pins], (p - new)[pins, c]) for c in (0, 1)])


def snake(p: np.ndarray, iterations: int = 10, alpha: float = 0.1, beta: float = 0.1, gamma: float = 1.0, kappa: float = 0.1, ring: bool | None = None) -> np.ndarray:
    """Active contour with tension ``alpha``, stiffness ``beta`` and a pull ``kappa`` to the input; ends of open lines stay.

    Many lines ``(vertices, lines, 2)`` go together if they are all closed, or all open, as ``ring`` says.
    """
    ring = _closed(p) if ring is None else ring
    x0 = p[:-1] if ring else p
    n = len(x0)
    if n < 3:
        return p
    bands = {-2: beta, -1: -alpha - 4 * beta, 0: 2 * alpha + 6 * beta + gamma + kappa, 1: -alpha - 4 * beta, 2: beta}
    x = x0.copy()
    if ring:  # a circulant system: one transform each way
        row = np.zeros(n)
        for k, v in bands.items():
            row[k % n] += v
        factor = np.fft.fft(row).conj().reshape(-1, *[1] * (x.ndim - 1))
        for _ in range(iterations):
            x = np.fft.ifft(np.fft.fft(gamma * x + kappa * x0, axis=0) / factor, axis=0).real
        return np.concatenate([x, x[:1]])
    m = np.zeros((n, 5))  # a row's five bands
    for k, v in bands.items():
        m[:, k + 2] = v
    if n > 3:  # beyond the ends, stiffness falls on the end itself
        m[1, 1], m[1, 0] = m[1, 1] + m[1, 0], 0
        m[-2, 3], m[-2, 4] = m[-2, 3] + m[-2, 4], 0
    else:
        m[1] = [0, m[1, 1] + m[1, 0], m[1, 2], m[1, 3] + m[1, 4], 0]
    m[[0, -1]] = [0, 0, 1, 0, 0]
    steps = _banded(m)
    for _ in range(iterations):
        right = gamma * x + kappa * x0
        right[0], right[-1] = x0[0], x0[-1]
        x = steps(right)
    return x


def _banded(m: np.ndarray):
    """Solver of a system of five bands, factored once without pivots; rows are ``m[i, k + 2]`` for column ``i + k``."""
    n, m = len(m), m.copy()
    factors = np.zeros((n, 2))
    for i in range(n):
        for j in (1, 2):
            if i + j < n and m[i + j, 2 - j]:
                f = factors[i, j - 1] = m[i + j, 2 - j] / m[i, 2]
                m[i + j, 2 - j : 5 - j] -= f * m[i, 2:5]

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for i in range(n):
            for j in (1, 2):
                if i + j < n and factors[i, j - 1]:
                    x[i + j] -= factors[i, j - 1] * x[i]
        for i in range(n - 1, -1, -1):
            for j in (1, 2):
                if i + j < n and m[i, 2 + j]:
                    x[i] -= m[i, 2 + j] * x[i + j]
            x[i] /= m[i, 2]
        return x

    return solve


def topographic(p: np.ndarray, iterations: int = 2, angle: float = 10.0, weights=(1.0, 2.0, 1.0)) -> np.ndarray:
    return angular(moving_average(p, weights, iterations), angle)


def inflexions(p: np.ndarray) -> np.ndarray:
    """Indices where the turning side changes."""
    return np.array([i for i, _ in bends(p)][1:], int)


# --- polygons ----------------------------------------------------------------------------------------------------


def shoelace(p: np.ndarray) -> float:
    x, y = p[:, 0] - p[0, 0], p[:, 1] - p[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def perimeter(p: np.ndarray) -> float:
    return float(np.hypot(*np.diff(p, axis=0).T).sum())


def compactness(p: np.ndarray) -> float:
    return 4 * np.pi * abs(shoelace(p)) / perimeter(p) ** 2


def convex_hull(p: np.ndarray) -> np.ndarray:
    """Anticlockwise hull ring (monotone chain)."""
    q = np.unique(p, axis=0)
    if len(q) < 3:
        return np.vstack([q, q[:1]])

    def chain(points) -> list:
        out: list = []
        for c in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    ring = chain(q) + chain(q[::-1])
    return np.array([*ring, ring[0]])


def concavity(p: np.ndarray) -> float:
    return abs(shoelace(p)) / abs(shoelace(convex_hull(p)))


def enclosing_rectangle(p: np.ndarray, minimise: str = "area") -> np.ndarray:
    """Rotated rectangle of least ``area`` or ``width`` around the points; one side lies on the hull.

    Its corners are clockwise from the one of least ``x + y``.
    """
    hull = convex_hull(p)
    best = None
    for d in np.diff(hull, axis=0):
        a = np.arctan2(d[1], d[0])
        r = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        q = hull @ r
        lo, hi = q.min(0), q.max(0)
        v = float(np.prod(hi - lo)) if minimise == "area" else float((hi - lo).min())
        if best is None or v < best[0] - 1e-12:
            box = np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]], [lo[0], lo[1]]])
            best = (v, box @ r.T)
    ring = best[1][3::-1]
    first = np.lexsort((ring[:, 0], ring.sum(1).round(7)))[0]
    return np.roll(ring, -first, axis=0)[[0, 1, 2, 3, 0]]


def elongation(p: np.ndarray) -> float:
    """Long side over short side of the least-area rectangle."""
    s = np.sort(np.hypot(*np.diff(enclosing_rectangle(p)[:3], axis=0).T))
    return float(s[1] / s[0]) if s[0] > 0 else float("inf")


def orientation(p: np.ndarray, method: str = "primary") -> float:
    """Direction in [0, pi) of the longest edge of the polygon (``primary``) or of its rectangle (``mbr``)."""
    e = np.diff(p if method == "primary" else enclosing_rectangle(p), axis=0)
    d = e[int(np.argmax(np.hypot(*e.T)))]
    return float(np.arctan2(d[1], d[0]) % np.pi)


def regularize_rectangle(p: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """The least-area rectangle, scaled about its centre."""
    r = enclosing_rectangle(p)
    c = r[:4].mean(0)
    return c + (r - c) * factor


def square_naive(p: np.ndarray, tolerance: float = 8.0) -> np.ndarray:
    """Rotates edges within ``tolerance`` degrees of the main direction or its normal onto it; other edges keep theirs.

    Vertices are the crossings of neighbouring edge lines through the edges' midpoints.
    """
    if not _closed(p) or len(p) < 5:
        return p
    a, b = p[:-1], p[1:]
    d = b - a
    th = np.arctan2(d[:, 1], d[:, 0])
    off = (th - orientation(p) + np.pi / 4) % (np.pi / 2) - np.pi / 4
    th = np.where(np.abs(np.degrees(off)) <= tolerance, th - off, th)
    u, m = np.column_stack([np.cos(th), np.sin(th)]), (a + b) / 2
    out = []
    for i in range(len(m)):
        j = (i + 1) % len(m)
        det = u[i][0] * u[j][1] - u[i][1] * u[j][0]
        if abs(det) < 1e-6:
            out.append(b[i])
            continue
        t = ((m[j] - m[i])[0] * u[j][1] - (m[j] - m[i])[1] * u[j][0]) / det
        out.append(m[i] + t * u[i])
    return np.array([out[-1], *out])


def enlarge(p: np.ndarray, goal: float) -> np.ndarray:
    """Scaled about the vertices' mean to the area ``goal``, alike on both axes."""
    a = abs(shoelace(p))
    c = p[:-1].mean(0)
    return p if a == 0 else c + (p - c) * np.sqrt(goal / a)


def squareness(p: np.ndarray, tolerance: float = 15.0, exact: float = 5.0) -> int:
    """Corners between ``exact`` and ``tolerance`` degrees off a right angle."""
    t = np.abs(turning(np.vstack([p[-2:-1], p])) - 90)
    return int(((t > exact) & (t < tolerance)).sum())


def bend_measures(p: np.ndarray) -> list[tuple[int, float, float, float, float, float, float]]:
    """``(first vertex, width, height, length, symmetry, shape, size)`` of each bend of the line.

    Width is the chord, height the greatest distance from it, whose vertex is the summit; symmetry the shorter over the
    longer way from the summit to an end, shape ``(4 height + width) / 5`` and size the area closed by the chord.
    """
    out = []
    for i, j in bends(p):
        b = p[i : j + 1]
        off = _offline(b, b[0], b[-1])
        top = int(np.argmax(off))
        step = np.hypot(*np.diff(b, axis=0).T)
        ways = sorted((step[:top].sum(), step[top:].sum()))
        width, height = float(np.hypot(*(b[-1] - b[0]))), float(off[top])
        out.append((i, width, height, float(step.sum()), float(ways[0] / ways[1]) if ways[1] else 0.0, (4 * height + width) / 5, abs(shoelace(np.vstack([b, b[:1]])))))
    return out


def _middle(p: np.ndarray) -> np.ndarray:
    far = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    return np.array([np.interp(far[-1] / 2, far, p[:, k]) for k in (0, 1)])


def accordion(p: np.ndarray, width: float, exaggeration: float = 1.0, sigma: float | None = None) -> np.ndarray:
    """Bends stretched one after another across their chords, by up to ``width * exaggeration`` at their ends.

    A bend's vertices move towards its summit's side in proportion to the way from its start; bends stay chained and
    the line's middle stays.  Bends are those of the line, or of its Gaussian smoothing by ``sigma`` where that keeps
    the number of vertices.  A line without a change of side is one bend.
    """
    guide = p
    if sigma is not None:
        smooth = gaussian(p, sigma)
        guide = smooth if len(smooth) == len(p) else p
    out, base = [p[0]], np.zeros(2)
    for i, j in bends(guide):
        b = p[i : j + 1]
        chord = b[-1] - b[0]
        size = np.hypot(*chord)
        way = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(b, axis=0).T))])
        push = np.zeros(2)
        if size > 0 and way[-1] > 0:
            top = b[np.argmax(_offline(b, b[0], b[-1]))] - b[0]
            side = np.sign(chord[0] * top[1] - chord[1] * top[0])
            push = side * np.array([-chord[1], chord[0]]) / size * width * exaggeration
        share = way / way[-1] if way[-1] > 0 else way
        out.extend(b[1:] + base + share[1:, None] * push)
        base = base + push
    moved = np.array(out)
    return moved + _middle(p) - _middle(moved)
