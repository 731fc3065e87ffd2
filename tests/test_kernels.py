import numpy as np
import pytest

from terrazzo.functions import kernels as K

LINE = np.array([(0, 0), (1, 1), (2, 0), (5, 3)], float)


def same(got, want):
    assert np.allclose(got, np.array(want, float)), got


def test_polygon_measures():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    assert K.compactness(square) == pytest.approx(0.7853981633974483)
    assert K.elongation(square * [2, 1]) == pytest.approx(2.0)
    assert K.concavity(np.array([(0, 0), (0, 2), (1, 1), (2, 2), (2, 0), (0, 0)], float)) == pytest.approx(0.75)


def test_simplification():
    same(K.lang(np.array([(0, 0), (1, 0.1), (2, 0.2), (3, 5), (4, 0)]), 0.5, 4), [(0, 0), (2, 0.2), (3, 5), (4, 0)])
    same(K.reumann_witkam(np.array([(0, 0), (10, 0.1), (20, -0.1), (25, 10)]), 0.5), [(0, 0), (20, -0.1), (25, 10)])
    same(K.douglas_peucker(LINE, 1.0), [(0, 0), (2, 0), (5, 3)])
    same(K.whirlpool(LINE, 2.0), [(0, 0), (2, 0), (5, 3)])
    same(K.visvalingam_whyatt(LINE, 5.0), [(0, 0), (5, 3)])
    same(K.li_openshaw(LINE, 1), LINE)
    flat = np.array([(0, 0), (1, 0.1), (2, 0), (2, 5)])
    same(K.angular(flat, 10), flat)


def test_smoothing_keeps_ends_and_averages():
    zig = np.array([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], float)
    same(K.moving_average(zig), [(0, 0), (1, 0.5), (2, 0.5), (3, 0.5), (4, 0)])
    for f in (K.taubin, K.chaikin, K.catmull_rom, K.platre, K.snake, K.topographic):
        out = f(zig)
        same(out[[0, -1]], zig[[0, -1]])
    same(K.gaussian(zig, 1.0)[[0, -1]], zig[[0, -1]])


def test_squaring_and_rectangles():
    skew = np.array([(0, 0), (10, 0.5), (9.7, 6), (0.2, 5.8), (0, 0)])
    assert np.abs(K.turning(np.vstack([K.square_naive(skew)[-2:-1], K.square_naive(skew)])) - 90).max() < 1e-6
    assert abs(K.shoelace(K.enlarge(skew, 100))) == pytest.approx(100)


def test_enclosing_rectangle_runs_clockwise_from_its_lower_left_corner():
    same(K.enclosing_rectangle(np.array([(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 0), (0, 0)], float)), [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)])
    turn = np.array([(0.8, 0.6), (-0.6, 0.8)])
    box = np.array([(0, 0), (0, 3), (7, 3), (7, 0), (0, 0)], float) @ turn
    for k in range(4):
        for ring in (np.roll(box[:4], k, axis=0), np.roll(box[3::-1], k, axis=0)):
            same(K.enclosing_rectangle(np.vstack([ring, ring[:1]]) + 500), box + 500)


def test_regularized_rectangle_is_scaled_about_its_centre():
    ell = np.array([(0, 0), (0, 2), (1, 2), (1, 1), (2, 1), (2, 0), (0, 0)], float)
    same(K.regularize_rectangle(ell), [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)])
    same(K.regularize_rectangle(ell, 1.5), [(-0.5, -0.5), (-0.5, 2.5), (2.5, 2.5), (2.5, -0.5), (-0.5, -0.5)])


ZIG = np.array([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)], float)


def test_documented_results():
    """Results that the methods are documented with."""
    assert np.allclose(K.gaussian(LINE, 1), [(0, 0), (5 / 3, 0.6051115971), (10 / 3, 1.6051115971), (5, 3)])
    ring = K.gaussian(np.array([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], float), 1)
    assert np.allclose(ring[[0, -1]], [(0.1168459781, 0.3005282653)] * 2)
    assert np.allclose(K.snake(ZIG).round(3), [(0, 0), (0.875, 0.256), (2, 0.298), (3.125, 0.256), (4, 0)])
    same(K.wang_muller(np.array([(0, 0), (1, 0.5), (2, 0), (3, 0.2), (10, 0)], float), 2.0), [(0, 0), (10, 0)])
    # the ends come once; the documented result takes the first vertex into its cluster as well, the method doesn't
    same(K.raposo(LINE, 5000, 10000), [(0, 0), (1.5, 0.5), (5, 3)])
    straight = np.column_stack([np.arange(0, 31, 10.0), np.zeros(4)])
    same(K.raposo(straight, 1, 0.1), straight)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 40])
@pytest.mark.parametrize("ring", [False, True])
def test_snake_against_a_dense_system(n, ring):
    x0 = np.random.default_rng(n).normal(size=(n, 2))
    a = np.zeros((n, n))
    for i in range(n) if ring else range(1, n - 1):
        for k, v in ((-2, 0.1), (-1, -0.5), (0, 0.8), (1, -0.5), (2, 0.1)):
            a[i, (i + k) % n if ring else min(n - 1, max(0, i + k))] += v
    m = a + 1.1 * np.eye(n)
    if not ring:
        m[0], m[-1] = np.eye(n)[0], np.eye(n)[-1]
    x = x0
    for _ in range(10):
        b = x + 0.1 * x0
        if not ring:
            b[0], b[-1] = x0[0], x0[-1]
        x = np.linalg.solve(m, b)
    got = K.snake(np.vstack([x0, x0[:1]]) if ring else x0)
    assert np.allclose(got, np.vstack([x, x[:1]]) if ring else x)


def test_platre_reach():
    """The kernel reaches three sigmas: an edge in the direction moves no vertex further away."""
    line = np.vstack([np.column_stack([np.arange(20.0), np.zeros(20)]), np.column_stack([np.arange(20.0, 40), np.arange(20) * 0.01])])
    turn = K.turning(K.platre(line, 2, 10.0))
    assert turn[:11].max() < 1e-3 < turn[14:25].max()


def test_nearest_centre():
    from terrazzo.operators.points import nearest_centre

    r = np.random.default_rng(1)
    for k in (1, 2, 7, 300):
        c = r.integers(0, 40, (k, 2)).astype(float)
        x, y = r.integers(-20, 60, (2, 2000)).astype(float)
        assert (nearest_centre(c)(x, y) == ((x[:, None] - c[:, 0]) ** 2 + (y[:, None] - c[:, 1]) ** 2).argmin(1)).all()
