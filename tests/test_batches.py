"""Batch functions give what the kernels give line by line."""

import numpy as np
import pytest

from terrazzo.functions import batches, building_batches
from terrazzo.functions import building_kernels as BK
from terrazzo.functions import kernels as K

LINES = [
    (K.catmull_rom, {"subdivisions": 4}),
    (K.snake, {}),
    (K.platre, {}), (K.platre, {"max_curvature": 1.0}),
    (K.gaussian, {"sigma": 15}), (K.gaussian, {"sigma": 2, "sample": 3.0}),
    (K.resample, {"step": 7.0}), (K.resample, {"step": 2.5, "keep_vertices": True}),
    (K.topographic, {}),
    (K.angular, {"angle": 40.0}),
    (K.douglas_peucker, {"threshold": 10.0}),
    (K.raposo, {"initial_scale": 25000, "final_scale": 50000}), (K.raposo, {"initial_scale": 1, "final_scale": 2, "use_centroid": False}),
    (K.wang_muller, {"tolerance": 15.0}),
    (K.accordion, {"width": 5.0}), (K.accordion, {"width": 5.0, "sigma": 2.0}),
]
RINGS = [
    (K.convex_hull, {}),
    (K.enclosing_rectangle, {}), (K.enclosing_rectangle, {"minimise": "width"}),
    (K.regularize_rectangle, {"factor": 1.1}),
    (BK.square_corners, {}), (BK.square_corners, {"remove_flat": False}),
    (BK.square_orthogonal, {}),
    (BK.square_least_squares, {}),
]
MEASURES = [K.concavity, K.elongation, BK.min_width]


def many_lines(seed: int) -> list[np.ndarray]:
    """Lines and rings of 2 to 60 vertices: level, straight, with repeated vertices, of one place."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(600):
        n = int(r.integers(50, 60)) if k % 40 == 0 else int(r.integers(2, 12))
        p = np.column_stack([np.arange(1, n + 1) * 10.0, r.integers(1, 50, n)]) if k % 2 else r.normal(size=(n, 2)) * 20
        if k % 5 == 0 and n > 3:
            p[-1] = p[0]
        if k % 7 == 0 and n > 2:
            p[n // 2] = p[n // 2 - 1]
        if k % 31 == 0:
            p[:, 1] = 3.0
        if k % 101 == 0:
            p[:] = 7.0
        out.append(p)
    return out


def many_rings(seed: int) -> list[np.ndarray]:
    """Rectangles, L-shapes and stars, turned and shaken a little, some with repeated or flat vertices."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(400):
        w, h, a = r.uniform(5, 30), r.uniform(5, 30), r.uniform(0, 6)
        p = [(0, 0), (w, 0), (w, h), (0, h)] if k % 3 else [(0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h)]
        if k % 4 == 0:
            t = np.sort(r.uniform(0, 2 * np.pi, 7))
            p = np.column_stack([np.cos(t), np.sin(t)]) * r.uniform(5, 20, (7, 1))
        p = np.array(p, float)
        if k % 5 == 0:
            p = np.insert(p, 1, p[:2].mean(0), 0)
        if k % 7 == 0:
            p = np.insert(p, 2, p[1], 0)
        p = (p + r.normal(size=p.shape) * (k % 2) * 0.3) @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) + r.uniform(0, 500, 2)
        out.append(np.vstack([p, p[:1]]) if k % 29 else p)
    return out


def flat(lines):
    return np.concatenate(lines), np.array([len(x) for x in lines])


def held(lines, kernel, how):
    got, counts = batches.apply(*flat(lines), kernel, **how)
    with np.errstate(all="ignore"):
        want = [x if len(x) < 2 else kernel(x, **how) for x in lines]
    assert counts.tolist() == [len(x) for x in want]
    assert np.allclose(got, np.concatenate(want), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize(("kernel", "how"), LINES, ids=lambda x: getattr(x, "__name__", str(x)))
def test_lines(kernel, how):
    held(many_lines(1), kernel, how)


@pytest.mark.parametrize(("kernel", "how"), RINGS, ids=lambda x: getattr(x, "__name__", str(x)))
def test_rings(kernel, how):
    held(many_rings(1), kernel, how)


@pytest.mark.parametrize("kernel", MEASURES, ids=lambda x: x.__name__)
def test_measures(kernel):
    rings = many_rings(2)
    assert np.allclose(batches.numbers(*flat(rings), kernel), [kernel(x) for x in rings], atol=1e-9)


def test_bend_measures():
    lines = [*many_lines(3), np.zeros((1, 2)), np.zeros((0, 2))]
    counts, columns = batches.bend_measures(*flat(lines))
    want = [K.bend_measures(x) if len(x) > 1 else [] for x in lines]
    assert counts.tolist() == [len(x) for x in want]
    assert np.allclose(np.column_stack(columns), np.array([b for x in want for b in x]), atol=1e-9)


def test_surfacic_distances():
    rings = [x for x in many_rings(4) if (x[0] == x[-1]).all()]
    others = [x + (k % 5) * 2.0 for k, x in enumerate(rings)]
    others = [x if k % 6 else rings[k - 1] for k, x in enumerate(others)]
    got = building_batches.surfacic_distances(*flat(rings), *flat(others))
    assert np.allclose(got, [BK.surfacic_distance(a, b) for a, b in zip(rings, others, strict=True)], atol=1e-9)


@pytest.mark.parametrize("kernel", [k for k in batches.BATCHES if k is not K.raposo], ids=lambda x: x.__name__)
def test_lines_alike_are_not_taken_one_by_one(kernel, monkeypatch):
    """A batch function's own work doesn't grow with the lines: the kernel isn't called for any."""
    def no(*a, **b):
        raise AssertionError("taken alone")

    how = {"resample": {"step": 7.0}, "douglas_peucker": {"threshold": 1.0}, "wang_muller": {"tolerance": 15.0}, "accordion": {"width": 5.0}}.get(kernel.__name__, {})
    monkeypatch.setitem(batches.BATCHES, no, batches.BATCHES[kernel])
    monkeypatch.setattr(batches, "RING", batches.RING | ({no} if kernel in batches.RING else set()))
    lines = [x for x in many_rings(5) if len(x) in (5, 7) and (x[0] == x[-1]).all()]
    measure = kernel in MEASURES
    (batches.numbers if measure else batches.apply)(*flat(lines), no, **how)


def test_no_lines():
    none = np.zeros((0, 2)), np.zeros(0, np.int64)
    for kernel, how in LINES + RINGS:
        got, counts = batches.apply(*none, kernel, **how)
        assert len(got) == len(counts) == 0
