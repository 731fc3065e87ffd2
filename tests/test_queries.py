import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
NAMES = [
    "labelgrid_aggregation_square", "labelgrid_selection_square", "labelgrid_aggregation_hexagonal", "heatmap_quartic", "quadtree_aggregation", "partition_grid", "line_length",
    "smooth_wma", "simplify_whirlpool", "simplify_li_openshaw", "polygon_compactness", "building_granularity_constraint", "dwithin_self_join", "graph_nodes_degree",
    "attributes_from_longest", "promethee_ranking", "dtm_hillshade", "surfacic_distance_shifted", "building_congestion", "circle_interpolation",
    "interpolate_displacement_vectors", "propagation_crow_flies", "vector_operations", "line_middle_point", "angle_between_lines", "angles_and_curvature", "hausdorff_to_chord",
    "merge_linestrings", "split_line_at_vertex", "extend_line", "multi_to_simple", "convert_3d_to_2d", "polygon_centroid", "polygon_envelope", "points_in_rings", "building_position_monitor",
    "object_granularity_monitor", "block_density", "building_elimination_ranking", "building_elimination_best", "minimum_spanning_tree",
    "convex_hull", "enclosing_rectangle", "regularize_building_rectangle", "square_polygon_naive",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NA or v != v else v + 0.0 if isinstance(v, float) else v
    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    import __spark_entry__ as entry

    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_faces_of_a_lattice(spark):
    from terrazzo.operators import networks

    edges = [(x, y, x + dx, y + dy) for x in range(4) for y in range(4) for dx, dy in ((1, 0), (0, 1)) if x + dx < 4 and y + dy < 4]
    lines = spark.createDataFrame([(i, [{"x": float(a), "y": float(b)}, {"x": float(c), "y": float(d)}]) for i, (a, b, c, d) in enumerate(edges)], "rid long, geom array<struct<x:double,y:double>>")
    assert [r.area for r in networks.faces(lines).collect()] == pytest.approx([1.0] * 9)


def test_empty_points(spark):
    from terrazzo.operators import points

    none = spark.createDataFrame([], "rid long, x double, y double, value long")
    assert points.labelgrid_aggregation(none, 1.0, column="value").count() == 0
    assert points.heatmap(none, 1.0, 2.0).count() == 0
    assert points.quadtree_aggregation(none, 3).count() == 0


def test_entry_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
