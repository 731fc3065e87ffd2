"""The queries that do the whole job, where the query named by SQL is a part of it."""

import heapq
import math
import os

import duckdb
import pytest

TESTDATA = "/root/testdata"


def against_sql(spark, name: str, sf: str) -> list:
    """Rows of query and SQL, alike; gives the query's."""
    import __spark_entry__ as entry

    c = duckdb.connect()
    for f in os.listdir(f"{TESTDATA}/{sf}"):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{TESTDATA}/{sf}/{f}'")
    got, want = entry.queries()[name](spark, f"{TESTDATA}/{sf}"), c.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    one = sorted(tuple(r) for r in got.select(*names).collect())
    two = sorted(want.select(*names).fetchall())
    assert len(one) == len(two)
    for a, b in zip(one, two, strict=True):
        assert a == pytest.approx(b, abs=2e-6)
    return one


def test_heatmap_of_all_events(spark):
    from terrazzo.sources import fixtures as X

    got = against_sql(spark, "heatmap_column_radius_weighted", "sf0.01")
    e = X.points_from_events(spark, f"{TESTDATA}/sf0.01").selectExpr("max(x)", "min(x)", "max(y)", "min(y)").first()
    assert len(got) == -(-(e[0] - e[1]) // 25) * -(-(e[2] - e[3]) // 25)


def lloyd(xy: list, k: int, tolerance: float) -> tuple[list, int]:
    """Clusters of the last round, and the rounds."""
    centres, rounds = xy[:k], 0
    while True:
        rounds += 1
        near = [min(range(k), key=lambda c: ((p[0] - centres[c][0]) * (p[0] - centres[c][0]) + (p[1] - centres[c][1]) * (p[1] - centres[c][1]), c)) for p in xy]
        moved = [tuple(sum(v) / len(v) for v in zip(*(p for p, c in zip(xy, near, strict=True) if c == i), strict=True)) if i in near else centres[i] for i in range(k)]
        far, centres = max(map(math.dist, centres, moved)), moved
        if far <= tolerance:
            return near, rounds


def test_kmeans_until_no_centre_moves(spark):
    from terrazzo.operators import points

    # seeds at one end of a line: borders walk along it for more than a hundred rounds
    xy = [(i * 100.0, 0.0) for i in range(1000)]
    near, rounds = lloyd(xy, 8, 2.0)
    assert rounds > 100
    table = spark.createDataFrame([(i, *p, i % 7) for i, p in enumerate(xy)], "rid long, x double, y double, value long").repartition(4)
    got = {r.rid: r.cluster for r in points.kmeans_clusters(table, 8 / 1000).collect()}
    assert got == dict(enumerate(near))


def test_kmeans_query_is_converged(spark):
    import __spark_entry__ as entry
    from terrazzo.sources import fixtures as X

    p = X.points_from_embeddings(spark, f"{TESTDATA}/sf0.001").orderBy("rid").collect()
    near, rounds = lloyd([(r.x, r.y) for r in p], 25, 2.0)
    assert rounds > 4
    want = sorted((near.count(c), sum(r.value for r, n in zip(p, near, strict=True) if n == c)) for c in set(near))
    got = entry.queries()["kmeans_aggregation"](spark, f"{TESTDATA}/sf0.001").collect()
    assert sorted((r.cluster_count, r.value_total) for r in got) == want


def dijkstra(arcs: dict, source) -> dict:
    best, heap = {}, [(0.0, source)]
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for to, length in arcs.get(node, ()):
                heapq.heappush(heap, (cost + length, to))
    return best


def test_paths_raise_instead_of_ending_early(spark):
    from terrazzo.operators import networks

    # a chain with a dear short cut: the cheap way to its end has the most edges
    edges = [(i, i + 1, 1.0) for i in range(8)] + [(0, 8, 50.0), (2, 7, 4.5)]
    e, nodes = spark.createDataFrame(edges, "src long, dst long, length double"), spark.createDataFrame([(0,), (5,), (5,)], "node long")
    arcs: dict = {}
    for a, b, n in edges:
        arcs.setdefault(a, []).append((b, n))
        arcs.setdefault(b, []).append((a, n))
    got = {(r.source, r.node): r.cost for r in networks.shortest_paths(e, nodes).collect()}
    assert got == {(s, n): c for s in (0, 5) for n, c in dijkstra(arcs, s).items()}
    with pytest.raises(RuntimeError):
        networks.shortest_paths(e, nodes, max_rounds=3)


def test_paths_between_all_nodes(spark):
    import __spark_entry__ as entry
    from terrazzo.sources import fixtures as X

    arcs: dict = {}
    for r in X.roads_from_orders(spark, f"{TESTDATA}/sf0.001").collect():
        a, b = ((p.x, p.y) for p in r.geom)
        arcs.setdefault(a, []).append((b, 100.0))
        arcs.setdefault(b, []).append((a, 100.0))
    want = {(*s, *n): c for s in arcs for n, c in dijkstra(arcs, s).items()}
    assert max(want.values()) > 600
    got = entry.queries()["shortest_paths"](spark, f"{TESTDATA}/sf0.001").collect()
    assert len(got) == len(want) and {tuple(r)[:4]: r.cost for r in got} == want


def leaves(points: list, x0: float, y0: float, side: float, most: int, level: int = 0, qi: int = 0, qj: int = 0) -> dict:
    """The leaf of each ``(rid, x, y)``, by halving."""
    if len(points) <= most or len({p[1:] for p in points}) == 1:
        return {p[0]: (level, qi, qj) for p in points}
    half, out = side / 2, {}
    for a in (0, 1):
        for b in (0, 1):
            inside = [p for p in points if (p[1] >= x0 + half) == a and (p[2] >= y0 + half) == b]
            out |= leaves(inside, x0 + a * half, y0 + b * half, half, most, level + 1, 2 * qi + a, 2 * qj + b)
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_quadtree_without_a_depth(spark, most):
    from terrazzo.operators import partition

    # a square of side 1024, with pairs at 2 ** -30 of it, equal points, and points on dividing lines
    xy = [(0, 0), (1024, 1024), (512, 512), (512, 3), (256, 512), (2**-20, 0), (700, 700), (700, 700), (700, 700), (700, 700), (701, 700), (1024, 1023.5), (5, 1024)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    got = {r.rid: (r.level, r.qi, r.qj) for r in partition.partition_quadtree(spark.createDataFrame(points, "rid long, x double, y double"), max_points=most).collect()}
    assert got == leaves(points, 0.0, 0.0, 1024.0, most)
    assert max(v[0] for v in got.values()) > 8 or most > 1


def test_quadtree_ends(spark):
    from terrazzo.operators import partition

    table = lambda *xy: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "rid long, x double, y double")
    assert [r.level for r in partition.partition_quadtree(table((3, 4))).collect()] == [0]
    assert [r.level for r in partition.partition_quadtree(table((3, 4), (3, 4))).collect()] == [0, 0]
    assert partition.partition_quadtree(table((3, 4)).limit(0)).count() == 0
    with pytest.raises(ValueError):
        partition.partition_quadtree(table((0, 0), (2**-70, 0), (1, 1)))
    capped = partition.partition_quadtree(table((0, 0), (1, 0), (2, 0), (64, 64)), 3, max_points=2)
    assert sorted(r.level for r in capped.collect()) == [1, 3, 3, 3]


def test_quadtree_query(spark):
    import __spark_entry__ as entry

    got = entry.queries()["partition_quadtree"](spark, f"{TESTDATA}/sf0.01").collect()
    assert len({(r.level, r.qi, r.qj) for r in got}) == len(got) == 500


@pytest.mark.parametrize("name", ["polygon_elongation", "building_granularity_constraint"])
def test_buildings_of_both_shapes(spark, name):
    got = against_sql(spark, name, "sf0.01")
    assert len(got) == 2000 and sum(r[0] % 3 == 0 for r in got) == 667
