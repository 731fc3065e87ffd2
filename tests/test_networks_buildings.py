import numpy as np
import pytest

from terrazzo.functions import building_kernels as BK
from terrazzo.functions import kernels as K
from terrazzo.operators import networks, propagation

DDL = "rid long, geom array<struct<x:double,y:double>>"
SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
ELL = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)], float)


def lines(spark, *each):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in e]) for i, e in enumerate(each)], DDL)


def got(df):
    return {r.rid: [(round(p.x, 6), round(p.y, 6)) for p in r.geom] for r in df.collect()}


def test_overlay_areas():
    assert BK.intersection_area(SQUARE, SQUARE) == pytest.approx(16)
    assert BK.intersection_area(SQUARE, SQUARE + [2, 1]) == pytest.approx(6)
    assert BK.intersection_area(ELL, SQUARE + [1, 1]) == pytest.approx(5)
    assert BK.intersection_area(SQUARE, SQUARE + [9, 0]) == 0
    diamond = np.array([(2, -1), (5, 2), (2, 5), (-1, 2), (2, -1)], float)
    assert BK.intersection_area(SQUARE, diamond) == pytest.approx(14)
    assert BK.surfacic_distance(SQUARE, SQUARE + [2, 1]) == pytest.approx(1 - 6 / 26)


def test_squaring_corner_by_corner(spark):
    from terrazzo.functions.udfs import line_function

    documented = [(0, 0), (0, 1), (1.1, 1), (1, 0), (0, 0)]
    bulge = [(0, 0), (5, 0.2), (10, 0), (10, 10), (0, 10), (0, 0)]
    out = got(lines(spark, documented, bulge).select("rid", line_function("square_polygon_naive")("geom").alias("geom")))
    assert out[0] == [(0, 0), (0, 1), (1.1, 1), (1.1, -0.004988), (0, 0)]
    assert out[1] == [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    # the corner at the origin is 43.5 degrees; the edge that turns takes the longer one's length
    sharp = np.array([(0, 0), (10, 0), (10, 9.5), (0, 0)])
    want = np.array([(0, 0), (13.7885822, -0.3535534), (10, 9.5), (0, 0)])
    for a in np.arange(0, 2 * np.pi, 0.3):
        turn = np.array([(np.cos(a), np.sin(a)), (-np.sin(a), np.cos(a))])
        assert np.allclose(BK.square_corners(sharp @ turn + 70), want @ turn + 70)
    twice = np.array([(0, 0), (0, 0), (0, 1), (1.1, 1), (1.1, 1), (1, 0), (0, 0)])
    assert np.allclose(BK.square_corners(twice), BK.square_corners(np.array(documented)))
    for same in ([(0, 0), (1, 0), (2, 0), (0, 0)], [(3, 3)] * 5, ELL):
        assert np.allclose(BK.square_corners(np.array(same, float)), same)


def test_widths_and_squaring():
    assert BK.min_width(SQUARE * [1, 0.5]) == pytest.approx(2)
    # middles (2, 0) and (3, 2) of the bottom and the inner level edge
    assert BK.min_width(ELL) == pytest.approx(5**0.5)
    skew = np.array([(0, 0), (10, 0.4), (10.2, 6), (0.1, 5.7), (0, 0)])
    for f in (BK.square_orthogonal, BK.square_least_squares):
        out = f(skew)
        assert np.allclose(out[0], out[-1])
        u = np.diff(out, axis=0)
        v = np.roll(u, -1, axis=0)
        cos = (u * v).sum(1) / np.hypot(*u.T) / np.hypot(*v.T)
        assert np.abs(cos).max() < (1e-9 if f is BK.square_orthogonal else 0.02)
    assert np.abs(BK.square_least_squares(skew) - skew).max() < 1
    assert abs(K.shoelace(BK.square_orthogonal(ELL))) == pytest.approx(12)


def test_bends_and_accordion():
    zig = np.array([(0, 0), (1, 2), (2, 0), (3, -2), (4, 0), (5, 2), (6, 0)], float)
    assert [b[0] for b in K.bend_measures(zig)] == [i for i, _ in K.bends(zig)]
    assert len(K.accordion(zig, 1.0)) == len(zig)
    assert K.bend_measures(np.array([(0, 0), (1, 1), (2, 0)], float))[0] == pytest.approx((0, 2, 1, 8**0.5, 1, 1.2, 1))
    flat = np.array([(0, 0), (5, 0)], float)
    assert np.allclose(K.accordion(flat, 3.0), flat)
    arch = np.array([(0, 0), (1, 1), (2, 0)], float)
    out = K.accordion(arch, 2.0)
    assert np.allclose(out[-1] - out[0], [2, 2])


def test_planar(spark):
    net = lines(spark, [(0, 0), (10, 0)], [(5, -5), (5, 5)], [(10, 0), (10, 5)], [(4, 0), (8, 0)], [(0, 0), (0, 3)], [(0, 1), (3, 1), (3, -1)])
    pieces = [tuple((p.x, p.y) for p in r.geom) for r in networks.make_planar(net, 4.0).collect()]
    want = [
        ((0, 0), (3, 0)), ((3, 0), (4, 0)), ((4, 0), (5, 0)), ((5, 0), (8, 0)), ((8, 0), (10, 0)), ((5, -5), (5, 0)), ((5, 0), (5, 5)), ((10, 0), (10, 5)),
        ((0, 0), (0, 1)), ((0, 1), (0, 3)), ((0, 1), (3, 1), (3, 0)), ((3, 0), (3, -1)),
    ]
    assert sorted(pieces) == sorted(want)
    assert networks.make_planar(net.limit(0), 4.0).count() == 0


def test_typification_keeps_the_geometry_out_of_filters(spark):
    """Null checks of joins on cells were pushed down with the ring spelt out in each lambda: 17 seconds of a core for 10,000 buildings."""
    from terrazzo.operators import buildings
    from terrazzo.sources import fixtures

    square = lambda x, y, a: [(x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y)]
    b = lines(spark, square(0, 0, 1), square(2, 0, 3), square(0, 3, 2), square(12, 0, 1), [(0, 0), (1, 1), (0, 0)])
    out = sorted(tuple(r) for r in buildings.typification_grid(b, 0.6, 10.0).collect())
    assert out == [(0, 0, 0, False), (1, 0, 0, True), (2, 0, 0, True), (3, 1, 0, True)]
    kept = buildings.typification_grid(fixtures.buildings_from_parts(spark, "/root/testdata/sf0.001"), 0.6, 200.0)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "zip_with" in x]
    grown = buildings.generalize_buildings(fixtures.buildings_from_parts(spark, "/root/testdata/sf0.001"), 200, 60)
    plan = grown._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "p_size" in x]


def test_planar_of_many_copies(spark):
    """Copies of a line add no pairs beyond a few, and give the pieces of one."""
    cross, there_and_back = [[(0, 0), (10, 0)], [(5, -5), (5, 5)]], [(0, 3), (4, 3), (0, 3), (4, 3)]
    net = lambda n: lines(spark, *(cross * n), there_and_back)
    pieces = lambda df: sorted((r.rid, r.planar_id, *((p.x, p.y) for p in r.geom)) for r in df.collect())
    few, many = networks.make_planar(net(2), 4.0), networks.make_planar(net(60), 4.0)
    once = lambda df: [r for r in pieces(df) if r[0] < 4]
    assert once(few) == once(many)
    assert {r[2:] for r in pieces(few)} == {r[2:] for r in pieces(many)} >= {((0, 0), (5, 0)), ((5, 0), (10, 0)), ((5, -5), (5, 0)), ((5, 0), (5, 5))}
    assert networks.make_planar(lines(spark, there_and_back), 4.0).count() == 1
    seg = spark.createDataFrame([(i, 0, 0.0, 0.0, 3.0, 0.0) for i in range(100)], "rid long, seg int, x1 double, y1 double, x2 double, y2 double")
    assert networks.segment_pairs(seg, 4.0).count() <= 400


def test_collapsed_roundabout(spark):
    ring = [(2, 0), (0, 2), (-2, 0), (0, -2)]
    edges = [[ring[i], ring[(i + 1) % 4]] for i in range(4)]
    net = lines(spark, *edges, [(2, 0), (9, 0)], [(0, 9), (0, 2)], [(2, 0), (9, 9)])
    face = spark.createDataFrame([(0, [{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]])], "face long, geom array<struct<x:double,y:double>>")
    assert got(networks.collapse_roundabouts(net, face)) == {4: [(0, 0), (2, 0), (9, 0)], 5: [(0, 9), (0, 2), (0, 0)], 6: [(2, 0), (9, 9)]}
    assert networks.collapse_roundabouts(net, face, max_radius=1.0).count() == 7


def test_propagation_along_a_network(spark):
    net = lines(spark, [(0, 0), (10, 0)], [(10, 0), (20, 0)], [(20, 0), (30, 0)], [(20, 0), (20, 9)])
    move = lines(spark, [(0, 0), (10, 4)])
    out = got(propagation.propagation_network(net, move, damping=0.5))
    assert out[0] == [(0, 0), (10, 4)] and out[1] == [(10, 4), (20, 2)] and out[2] == [(20, 2), (30, 0)] and out[3] == [(20, 2), (20, 9)]
    near = got(propagation.propagation_network(net, move, reach=5.0, damping=0.5))
    assert near[1] == [(10, 4), (20, 0)] and near[2] == [(20, 0), (30, 0)]


def test_crow_flies_without_vectors(spark):
    net = lines(spark, [(0, 0), (10, 0)], [(100, 100), (110, 0)])
    move = net.limit(0).select("rid", "geom").selectExpr("rid", "geom as before", "geom as after")
    assert got(propagation.propagation_crow_flies(net, move, 50.0)) == got(net)
    one = lines(spark, [(0, 0), (10, 0)]).selectExpr("rid", "geom as before", "transform(geom, p -> named_struct('x', p.x, 'y', p.y + 5)) as after")
    out = got(propagation.propagation_crow_flies(net, one, 50.0, 5.0, frozen=lines(spark, [(110, 0), (10, 0)])))
    assert out[0] == [(0, pytest.approx(5, abs=1e-4)), (10, 0)] and out[1] == [(100, 100), (110, 0)]
