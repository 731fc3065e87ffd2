"""Angles at shared ends, places on lines, spanning trees and partitions by faces, against hand values and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrazzo.functions import geometry as G
from terrazzo.functions import vectors as V
from terrazzo.operators import buildings, networks
from terrazzo.sources import vector

LINE = "array<struct<x:double,y:double>>"


def line(*xy):
    return [(float(x), float(y)) for x, y in xy]


def test_angles_at_shared_ends(spark):
    a3, b3 = line((0, 0), (1, 0), (2, 1)), line((2, 1), (3, 1), (3, 4))
    rows = [
        (1, line((0, 0), (1, 0)), line((1, 0), (1, 1))), (2, line((1, 0), (0, 0)), line((1, 0), (1, 1))), (3, line((1, 0), (0, 0)), line((1, 1), (1, 0))),
        (4, line((0, 0), (1, 0)), line((1, 1), (1, 0))), (5, line((0, 0), (1, 0)), line((5, 5), (6, 6))), (6, a3, b3), (7, line((0, 0)), line((0, 0))), (8, None, b3), (9, [], b3),
    ]
    got = {r.i: r.v for r in spark.createDataFrame(rows, f"i int, a {LINE}, b {LINE}").select("i", G.angle_between_lines(F.col("a"), F.col("b")).alias("v")).collect()}
    square = math.atan2(1, 0) - math.atan2(0, -1)
    assert [got[i] for i in (1, 2, 3, 4)] == pytest.approx([square] * 4)
    assert got[6] == pytest.approx(math.atan2(3, 1) - math.atan2(-1, -2))
    assert [got[i] for i in (5, 7, 8, 9)] == [None] * 4


def test_odd_lines(spark):
    rows = [(1, []), (2, line((3, 4))), (3, line((1, 1), (1, 1))), (4, None), (5, line((0, 0), (4, 0), (4, 2), (0, 0)))]
    g = F.col("g")
    got = {
        r.i: r
        for r in spark.createDataFrame(rows, f"i int, g {LINE}")
        .select("i", G.middle_point(g).alias("m"), G.signed_area(g).alias("a"), G.centroid(g).alias("c"), G.is_closed(g).alias("o"), G.hausdorff(g, g).alias("h"), buildings.granularity_monitor(g, 1.0, 0.1).alias("l"))
        .collect()
    }
    assert got[1].m is None and got[1].a == 0 and got[1].c is None and got[1].o is False
    assert tuple(got[2].m) == (3, 4) and tuple(got[3].m) == (1, 1) and got[3].c is None
    assert got[4].m is None and got[4].a is None and got[4].l == 7
    assert got[5].a == 4 and tuple(got[5].c) == pytest.approx((8 / 3, 2 / 3)) and got[5].o and got[5].h == 0


def test_rotation_keeps_length_and_turns_left(spark):
    u = spark.range(1).select(V.rotate(G.point(F.lit(3.0), F.lit(4.0)), F.lit(math.pi / 2)).alias("u"), V.with_norm(G.point(F.lit(0.0), F.lit(0.0)), F.lit(1.0)).alias("none")).first()
    assert tuple(u.u) == pytest.approx((-4, 3)) and u.none is None


def test_spanning_forest(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(14) + 20 * (i % 2), rng.randrange(14) + 20 * (i % 2), float(rng.randrange(6))) for i in range(60)]
    edges += [(100, 3, 3, 0.0)]
    root, want = {}, set()

    def top(n):
        while root.get(n, n) != n:
            n = root[n]
        return n

    for rid, a, b, _ in sorted(edges, key=lambda e: (e[3], e[0])):
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.add(rid)
    schema = "rid long, src long, dst long, length double"
    assert {r.rid for r in networks.minimum_spanning_tree(spark.createDataFrame(edges, schema)).collect()} == want
    assert networks.minimum_spanning_tree(spark.createDataFrame([], schema)).count() == 0


def test_points_by_faces_of_a_lattice(spark):
    edges = [line((x, y), (x + dx, y + dy)) for x in range(3) for y in range(3) for dx, dy in ((1, 0), (0, 1)) if x + dx < 3 and y + dy < 3]
    lines = spark.createDataFrame(list(enumerate(edges)), f"rid long, geom {LINE}")
    points = [(1, 0.5, 0.5), (2, 1.5, 0.25), (3, 1.0, 0.5), (4, 1.0, 1.0), (5, 2.5, 0.5), (6, 0.5, 0.75)]
    got = networks.partition_networks(spark.createDataFrame(points, "rid long, x double, y double"), lines, 0.7).collect()
    faces = {}
    for r in got:
        faces.setdefault(r.face, set()).add(r.rid)
    assert sorted(map(sorted, faces.values())) == [[1, 3, 4, 6], [2, 3, 4], [4], [4]]


def test_sample_is_alike_in_every_partitioning(spark):
    rows = spark.range(5000).withColumnRenamed("id", "rid")
    one, two = (sorted(r.rid for r in vector.seeded_sample(d, "rid", 0.2, 5).collect()) for d in (rows, rows.repartition(7)))
    assert one == two and 800 < len(one) < 1200


def test_spatial_joins_broadcast_no_side(spark):
    """What a small table is made into may be large: a broadcast would go through the driver."""
    import __spark_entry__ as entry
    from terrazzo.plans import spatial
    from terrazzo.sources import fixtures

    sf = "/root/testdata/sf0.001"
    box = spark.range(9).selectExpr("id as rid", "id * 1.0 as xmin", "0.0 as ymin", "id + 1.5 as xmax", "1.0 as ymax")
    points = fixtures.points_from_events(spark, sf)
    queries = [spatial.self_pairs(points, 5.0), spatial.boxes_intersect(box, box, 2.0), *(entry.queries()[q](spark, sf) for q in ("points_in_rings", "building_congestion"))]
    for df in queries:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_flows_of_sorted_sums_are_those_of_pairs(spark):
    """Thresholds are met as differences round; a group of 100,000 takes no pairs."""
    import time

    import numpy as np
    from terrazzo.operators import mcda

    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 30, 200) / 10, r.normal(size=50), [np.nan]])
    for f in (mcda.usual(), mcda.u_shape(0.3), mcda.v_shape(0.7), mcda.level(0.7, 0.1), mcda.level(0.2, 0.4), mcda.linear(0.7, 0.1), mcda.linear(0.1, 0.7), mcda.linear(0.4, 0.4)):
        def value(d, f=f):
            return next(a * d + c if a else c for b, a, c in f.pieces if d <= b)

        want = [sum(value(a - b) - value(b - a) for b in x if b == b) if a == a else 0.0 for a in x]
        assert np.allclose(mcda.net_flow(x, f.pieces), want, atol=1e-9)
    rows = spark.createDataFrame([(1, i, float(i * 37 % 101) / 100, float(i % 3)) for i in range(120)], "g int, rid long, a double, b double")
    terms = [("a", mcda.linear(0.7, 0.1), 0.6), ("b", mcda.usual(), 0.4)]
    got = {r.rid: r.phi for r in mcda._flows(rows, "g", "rid", terms).collect()}
    want = {r.rid: r.phi for r in mcda._flows_by_pairs(rows, "g", "rid", terms).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=1e-12)
    t = time.time()
    mcda.net_flow(r.normal(size=100_000), mcda.linear(0.7, 0.1).pieces)
    assert time.time() - t < 20


def test_nearest_of_crowded_points(spark):
    """Against brute force; crowded cells are made smaller, and copies of a place are left out beyond those asked for."""
    import numpy as np
    from terrazzo.plans import spatial

    r = np.random.default_rng(2)
    xy = np.concatenate([r.normal(size=(300, 2)), r.integers(0, 3, (100, 2)) * 50.0, [[900.0, 900.0]]])
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "rid long, x double, y double")
    got = sorted((r.l_rid, r.rank, r.r_rid) for r in spatial.nearest(p, p, 3, 40.0, exclude_self=True).collect())
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    want = [(i, k + 1, j) for i in range(len(xy)) for k, j in enumerate(sorted((j for j in range(len(xy)) if j != i), key=lambda j: (d[i, j], j))[:3])]
    assert got == want
    even = spark.range(40_000).selectExpr("id as rid", "(id % 200) * 0.2 as x", "(id div 200) * 0.2 as y")
    assert spatial.dense_reach(even, 40.0) < 1
