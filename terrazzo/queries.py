"""Registered queries of the spatial operators, over fixtures derived from the plain tables, and their DuckDB SQL.

Computed doubles are rounded to six decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.functions import geometry as G
from terrazzo.functions import vectors as V
from terrazzo.functions.udfs import bend_measures, line_function, measure, surfacic_distance
from terrazzo.operators import buildings as B
from terrazzo.operators import mcda, networks, partition, points, propagation, terrain
from terrazzo.plans import components, spatial
from terrazzo.sources import fixtures as X
from terrazzo.sources import vector

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _r(df: DataFrame) -> DataFrame:
    """Rounds every double column."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: _r(query(spark, d))
    if sql:
        ORACLES[name] = sql


def _vertices(df: DataFrame) -> DataFrame:
    return df.select("rid", F.posexplode("geom").alias("pos", "p")).select("rid", "pos", "p.x", "p.y")


# --- SQL of the fixtures ---------------------------------------------------------------------------------------------

EMB = "select vec_id as rid, embedding[1]::double * 1000 as x, embedding[2]::double * 1000 as y, label::bigint as value from embeddings"
EVT = "select event_id as rid, user_id * 50.0::double + event_id % 50 as x, value as y, (1 + event_id % 9)::double as w, (10 + event_id % 15)::double as r from events"
ORD = """select rid, pos, x, y, count(*) over (partition by rid) as n from (
  select l_orderkey as rid, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos,
    10.0::double * row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as x, l_quantity::double as y from lineitem) qualify n >= 3"""
BLD = "select p_partkey as rid, 8 + p_size * 0.3::double as w, 6 + (p_partkey % 7) * 2 as h, p_partkey % 3 = 0 as ell from part"
ROADS = """select s * 2 + dir as rid, (s % 20) * 100.0::double as x1, (s // 20) * 100.0::double as y1,
  (s % 20) * 100.0::double + (1 - dir) * 100 as x2, (s // 20) * 100.0::double + dir * 100 as y2
  from (select distinct o_custkey % 400 as s, o_orderkey % 2 as dir from orders) where (s * 7 + dir * 3) % 5 <> 0"""
DTM = "select r.i as row, c.i as col, 100.0::double + (r.i * r.i) % 37 + (c.i * 3) % 29 + 0.5 * r.i as z from range(64) r(i), range(64) c(i)"
GRID = """with p as (%s), e as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from p),
u as (select p.*, x0, y0, x - x0 as dx, y - y0 as dy, greatest(0, ceil((x1 - x0) / {w}) - 1) as li, greatest(0, ceil((y1 - y0) / {h}) - 1) as lj from p, e),
ii as (select *, unnest(case when floor(dx / {w}) * {w} = dx then [floor(dx / {w}) - 1, floor(dx / {w})] else [floor(dx / {w})] end) as ci from u),
jj as (select *, unnest(case when floor(dy / {h}) * {h} = dy then [floor(dy / {h}) - 1, floor(dy / {h})] else [floor(dy / {h})] end) as cj from ii),
g as (select rid, x, y, value, ci::bigint as ci, cj::bigint as cj, (ci + 0.5) * {w} + x0 as cx, (cj + 0.5) * {h} + y0 as cy from jj where ci between 0 and li and cj between 0 and lj)
""" % EMB  # noqa: UP031
GRID = GRID.format(w="100.0", h="80.0")

# --- points ------------------------------------------------------------------------------------------------------------

_add(
    "labelgrid_aggregation_square",
    lambda s, d: points.labelgrid_aggregation(X.points_from_embeddings(s, d), 100, 80, "value"),
    GRID + "select ci, cj, count(*) as cell_count, round(first(cx), 6) as x, round(first(cy), 6) as y, sum(value)::bigint as value_total, round(avg(value), 6) as value_mean from g group by ci, cj",
)
_add(
    "labelgrid_selection_square",
    lambda s, d: points.labelgrid_selection(X.points_from_embeddings(s, d), 100, 80, "value").fillna({"cell_count": 0}),
    GRID + """select ci, cj, rid, round(x, 6) as x, round(y, 6) as y, value, value > 0 and k = 1 as selected_labelgrid, case when value > 0 and k = 1 then n else 0 end as cell_count
    from (select *, row_number() over (partition by ci, cj order by value desc, rid) as k, count(*) over (partition by ci, cj) as n from g)""",
)
_add(
    "labelgrid_simplification_square",
    lambda s, d: points.labelgrid_simplification(X.points_from_embeddings(s, d), 100, 80),
    GRID + """select ci, cj, rid, round(x, 6) as x, round(y, 6) as y, value, row_number() over (partition by ci, cj order by (x - cx) * (x - cx) + (y - cy) * (y - cy), rid) = 1 as selected_labelgrid from g""",
)
_HEX = """with p as (%s), e as (select min(x) as x0, min(y) as y0 from p), u as (select p.*, x0, y0, x - x0 as dx, y - y0 as dy from p, e),
c as (select *, floor(dx / {a}) + i.i as ci, floor(dy / {b}) + j.j as cj from u, range(-1, 3) i(i), range(-1, 2) j(j)),
g as (select rid, value, ci, cj, {cx} as cx, {cy} as cy from c where {inside})
select ci::bigint as ci, cj::bigint as cj, count(*) as cell_count, round(first(cx + x0), 6) as x, round(first(cy + y0), 6) as y from (select g.*, x0, y0 from g, e) group by ci, cj""" % EMB  # noqa: UP031
_add(
    "labelgrid_aggregation_hexagonal",
    lambda s, d: points.labelgrid_aggregation(X.points_from_embeddings(s, d), 60, shape="hexagonal"),
    _HEX.format(a="90.0", b="120.0", cx="ci * 90.0", cy="(cj + case when ci % 2 <> 0 then 0.5 else 0 end) * 120.0",
                inside="abs(dy - (cj + case when ci % 2 <> 0 then 0.5 else 0 end) * 120.0) <= 60 and abs(dx - ci * 90.0) <= 60 - abs(dy - (cj + case when ci % 2 <> 0 then 0.5 else 0 end) * 120.0) / 2"),
)
_add(
    "labelgrid_aggregation_diamond",
    lambda s, d: points.labelgrid_aggregation(X.points_from_embeddings(s, d), 90, shape="diamond"),
    _HEX.replace("range(-1, 3) i", "range(-1, 2) i").format(a="90.0", b="90.0", cx="ci * 90.0", cy="(cj + 0.5) * 90.0", inside="abs(dx - ci * 90.0) + abs(dy - (cj + 0.5) * 90.0) <= 45"),
)
for _m, _k in {
    "quartic": "15.0 / 16 * (1 - u * u) * (1 - u * u)", "epanechnikov": "0.75 * (1 - u * u)", "gaussian": "1 / sqrt(2 * pi()) * exp(-u * u / 2)",
    "uniform": "0.5", "triangular": "1 - abs(u)",
}.items():
    _add(
        f"heatmap_{_m}",
        lambda s, d, m=_m: points.heatmap(X.points_from_embeddings(s, d), 40, 100.0, method=m),
        f"""with p as ({EMB}), e as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from p),
        c as (select i.i as ci, j.i as cj, x0 + (i.i + 0.5) * 40 as x, y0 + (j.i + 0.5) * 40 as y from e, unnest(range(ceil((x1 - x0) / 40)::bigint)) i(i), unnest(range(ceil((y1 - y0) / 40)::bigint)) j(i)),
        h as (select c.*, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / 100 as u from c left join p on (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 10000)
        select ci, cj, round(x, 6) as x, round(y, 6) as y, round(coalesce(sum(case when u is not null then {_k} end), 0), 6) as density from h group by ci, cj, x, y""",
    )
# all events: the SQL meets a point (r is under 25) only with the nine cells about its own
_add(
    "heatmap_column_radius_weighted",
    lambda s, d: points.heatmap(X.points_from_events(s, d), 25, "r", "w", "epanechnikov"),
    f"""with p as ({EVT}), e as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from p),
    c as (select i.i as ci, j.i as cj, x0 + (i.i + 0.5) * 25 as x, y0 + (j.i + 0.5) * 25 as y from e, unnest(range(ceil((x1 - x0) / 25)::bigint)) i(i), unnest(range(ceil((y1 - y0) / 25)::bigint)) j(i)),
    n as (select p.*, floor((p.x - x0) / 25)::bigint + i.i as ci, floor((p.y - y0) / 25)::bigint + j.j as cj from p, e, range(-1, 2) i(i), range(-1, 2) j(j)),
    h as (select ci, cj, n.w, sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)) / n.r as u from n join c using (ci, cj)),
    g as (select ci, cj, sum(0.75 * (1 - u * u) * w) as density from h where u <= 1 group by ci, cj)
    select ci, cj, round(x, 6) as x, round(y, 6) as y, round(coalesce(density, 0), 6) as density from c left join g using (ci, cj)""",
)
_QT = f"""with recursive p as ({EMB}), e as (select greatest(max(x) - min(x), max(y) - min(y)) as side, (min(x) + max(x)) / 2 as mx, (min(y) + max(y)) / 2 as my from p),
u as (select p.*, side, mx - side / 2 as x0, my - side / 2 as y0, least(15, floor((x - (mx - side / 2)) / side * 16))::bigint as i, least(15, floor((y - (my - side / 2)) / side * 16))::bigint as j from p, e),
n as (select *, count(*) over (partition by i // 8, j // 8) as n1, count(*) over (partition by i // 4, j // 4) as n2, count(*) over (partition by i // 2, j // 2) as n3 from u),
q as (select *, case when n1 = 1 then 1 when n2 = 1 then 2 when n3 = 1 then 3 else 4 end as level from n),
g as (select *, i // (1 << (4 - level)) as qi, j // (1 << (4 - level)) as qj from q),
c as (select *, x0 + (qi + 0.5) * side / (1 << level) as cx, y0 + (qj + 0.5) * side / (1 << level) as cy from g) """
_add(
    "quadtree_aggregation",
    lambda s, d: points.quadtree_aggregation(X.points_from_embeddings(s, d), 4, "value"),
    _QT + "select level, qi, qj, count(*) as cell_count, round(first(cx), 6) as x, round(first(cy), 6) as y, sum(value)::bigint as value_total, round(avg(value), 6) as value_mean from c group by level, qi, qj",
)
_add(
    "quadtree_selection",
    lambda s, d: points.quadtree_selection(X.points_from_embeddings(s, d), 4, "value").fillna({"cell_count": 0}),
    _QT + """select rid, round(x, 6) as x, round(y, 6) as y, value, value > 0 and k = 1 as selected_quadtree, case when value > 0 and k = 1 then n else 0 end as cell_count
    from (select *, row_number() over (partition by level, qi, qj order by value * level desc, rid) as k, count(*) over (partition by level, qi, qj) as n from c)""",
)
_add(
    "quadtree_simplification",
    lambda s, d: points.quadtree_simplification(X.points_from_embeddings(s, d), 4),
    _QT + "select rid, round(x, 6) as x, round(y, 6) as y, value, row_number() over (partition by level, qi, qj order by (x - cx) * (x - cx) + (y - cy) * (y - cy), rid) = 1 as selected_quadtree from c",
)


def _lloyd(rounds: int) -> str:
    sql = f"with p as ({EMB}), k0 as (select row_number() over (order by rid) - 1 as c, x, y from p qualify c < 20)"
    for i in range(rounds + 1):
        sql += f", a{i} as (select p.*, (select min_by(c, struct_pack(d := (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y), c := c)) from k{i} k) as c from p)"
        sql += f", k{i + 1} as (select k.c, coalesce(avg(a.x), first(k.x)) as x, coalesce(avg(a.y), first(k.y)) as y from k{i} k left join a{i} a on a.c = k.c group by k.c)"
    return sql


  # fmt: skip
_add("kmeans_aggregation", lambda s, d: points.kmeans_aggregation(X.points_from_embeddings(s, d), 0.05, "value"))
_add("kmeans_selection", lambda s, d: points.kmeans_selection(X.points_from_embeddings(s, d), 0.05, "value"))
_add("kmeans_simplification", lambda s, d: points.kmeans_simplification(X.points_from_embeddings(s, d), 0.05))

# --- partitions --------------------------------------------------------------------------------------------------------

_add(
    "tessellate_square",
    lambda s, d: partition.tessellate(s, (0, 0, 1000, 500), 50, 25).select("cell", G.area(F.col("geom")).alias("area"), F.col("geom")[0]["x"].alias("x"), F.col("geom")[0]["y"].alias("y")),
    "select i.i * 20 + j.i as cell, 1250.0::double as area, i.i * 50.0::double as x, j.i * 25.0::double as y from range(20) i(i), range(20) j(i)",
)
_add("tessellate_hexagonal", lambda s, d: partition.tessellate(s, (0, 0, 1000, 500), 50, shape="hexagonal").select("cell", G.area(F.col("geom")).alias("area")))
_add("tessellate_diamond", lambda s, d: partition.tessellate(s, (0, 0, 1000, 500), 50, shape="diamond").select("cell", G.area(F.col("geom")).alias("area")))
_add(
    "partition_grid",
    lambda s, d: partition.partition_grid(X.points_from_events(s, d), 500, 50),
    f"""with p as ({EVT}), e as (select min(x) as x0, min(y) as y0, max(y) as y1 from p)
    select rid, (greatest(0, ceil((x - x0) / 500.0) - 1) * greatest(1, ceil((y1 - y0) / 50.0)) + greatest(0, ceil((y - y0) / 50.0) - 1))::bigint as part_id from p, e""",
)
_add("partition_quadtree", lambda s, d: partition.partition_quadtree(X.points_from_embeddings(s, d)))

# --- lines -------------------------------------------------------------------------------------------------------------

_add(
    "line_length",
    lambda s, d: X.lines_from_orders(s, d).select("rid", G.length(F.col("geom")).alias("length"), G.vertex_count(F.col("geom")).alias("n")),
    f"with v as ({ORD}), s as (select *, sqrt(power(lead(x) over w - x, 2) + power(lead(y) over w - y, 2)) as l from v window w as (partition by rid order by pos)) select rid, round(sum(l), 6) as length, count(*)::int as n from s group by rid",
)
_add(
    "line_bend_side",
    lambda s, d: X.lines_from_orders(s, d).select("rid", G.bend_side(F.col("geom")).alias("side")),
    f"with v as ({ORD}), f as (select *, first(x) over w as x0, first(y) over w as y0, lead(x) over w as xn, lead(y) over w as yn from v window w as (partition by rid order by pos)) select rid, case when sum((x - x0) * (yn - y0) - (xn - x0) * (y - y0)) < 0 then 'right' else 'left' end as side from f group by rid",
)
_add(
    "smooth_wma",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", G.moving_average(F.col("geom")).alias("geom"))),
    f"with v as ({ORD}) select rid, (pos - 1)::int as pos, round(case when lag(x) over w is null or lead(x) over w is null then x else (lag(x) over w + 2 * x + lead(x) over w) / 4 end, 6) as x, round(case when lag(y) over w is null or lead(y) over w is null then y else (lag(y) over w + 2 * y + lead(y) over w) / 4 end, 6) as y from v window w as (partition by rid order by pos)",
)
_add(
    "smooth_taubin",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", line_function("smooth_taubin", iterations=1)("geom").alias("geom"))),
    f"""with v as ({ORD}), a as (select rid, pos, coalesce(0.5 * x + 0.25 * (lag(x) over w + lead(x) over w), x) as x, coalesce(0.5 * y + 0.25 * (lag(y) over w + lead(y) over w), y) as y from v window w as (partition by rid order by pos))
    select rid, (pos - 1)::int as pos, round(coalesce(1.53 * x - 0.265 * (lag(x) over w + lead(x) over w), x), 6) as x, round(coalesce(1.53 * y - 0.265 * (lag(y) over w + lead(y) over w), y), 6) as y from a window w as (partition by rid order by pos)""",
)
_add(
    "smooth_chaikin",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", G.chaikin(F.col("geom")).alias("geom"))),
    f"""with v as ({ORD}), s as (select *, lead(x) over w as xn, lead(y) over w as yn from v window w as (partition by rid order by pos)),
    c as (select rid, 2 * pos as k, case when pos = 1 then x else 0.75 * x + 0.25 * xn end as x, case when pos = 1 then y else 0.75 * y + 0.25 * yn end as y from s where xn is not null
      union all select rid, 2 * pos + 1, case when pos = n - 1 then xn else 0.25 * x + 0.75 * xn end, case when pos = n - 1 then yn else 0.25 * y + 0.75 * yn end from s where xn is not null)
    select rid, (row_number() over (partition by rid order by k) - 1)::int as pos, round(x, 6) as x, round(y, 6) as y from c""",
)
_add(
    "simplify_li_openshaw",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", line_function("simplify_li_openshaw", cell=15.0, ends=False)("geom").alias("geom"))),
    f"""with v as ({ORD}), c as (select *, floor(x / 15) as ci, floor(y / 15) as cj from v),
    f as (select *, case when ci = lag(ci) over w and cj = lag(cj) over w then 0 else 1 end as new from c window w as (partition by rid order by pos)),
    g as (select *, sum(new) over (partition by rid order by pos) as k from f), a as (select rid, k, avg(x) as x, avg(y) as y, count(*) over (partition by rid) as m from g group by rid, k),
    o as (select rid, k - 1 as pos, x, y from a where m > 1 union all select v.rid, v.pos - 1, v.x, v.y from v where rid in (select rid from a where m = 1))
    select rid, pos::int as pos, round(x, 6) as x, round(y, 6) as y from o""",
)
_FOLD = f"""with recursive v as ({ORD}), f(rid, pos, kx, ky, keep) as (
  select rid, pos, x, y, true from v where pos = 1
  union all select v.rid, v.pos, case when far then v.x else kx end, case when far then v.y else ky end, far
  from f join (select *, null as z from v) v on v.rid = f.rid and v.pos = f.pos + 1, lateral (select sqrt(power(v.x - kx, 2) + power(v.y - ky, 2)) >= 20 as far))
select f.rid, (row_number() over (partition by f.rid order by f.pos) - 1)::int as pos, round(v.x, 6) as x, round(v.y, 6) as y from f join v using (rid, pos) where keep or pos = n"""
_add("simplify_whirlpool", lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", G.whirlpool(F.col("geom"), 20.0).alias("geom"))), _FOLD)
_add(
    "remove_flat_vertices",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", line_function("remove_flat_vertices", tolerance=20.0)("geom").alias("geom"))),
    f"""with v as ({ORD}), a as (select *, atan2(y - lag(y) over w, x - lag(x) over w) as p, atan2(lead(y) over w - y, lead(x) over w - x) as q from v window w as (partition by rid order by pos))
    select rid, (row_number() over (partition by rid order by pos) - 1)::int as pos, round(x, 6) as x, round(y, 6) as y from a where p is null or q is null or degrees(abs(q - p)) > 20""",
)
for _name, _how in {
    "simplify_douglas_peucker": {"threshold": 10.0}, "simplify_visvalingam_whyatt": {"threshold": 60.0}, "simplify_lang": {"tolerance": 10.0}, "simplify_reumann_witkam": {"tolerance": 8.0},
    "simplify_angular": {"angle": 30.0}, "simplify_raposo": {"initial_scale": 25000, "final_scale": 50000}, "simplify_wang_muller": {"tolerance": 15.0}, "smooth_gaussian": {"sigma": 15},
    "smooth_catmull_rom": {"subdivisions": 4}, "smooth_platre": {}, "smooth_snake": {}, "smooth_topographic": {}, "resample_line": {"step": 7.0},
}.items():
    _add(_name, lambda s, d, n=_name, h=_how: _vertices(X.lines_from_orders(s, d).select("rid", line_function(n, **h)("geom").alias("geom"))))

# --- polygons and buildings ----------------------------------------------------------------------------------------------

_A = "w * h * case when ell then 0.75 else 1 end"
_add("polygon_area", lambda s, d: X.buildings_from_parts(s, d).select("rid", G.area(F.col("geom")).alias("area")), f"select rid, round({_A}, 6) as area from ({BLD})")
_add("polygon_perimeter", lambda s, d: X.buildings_from_parts(s, d).select("rid", G.length(F.col("geom")).alias("perimeter")), f"select rid, round(2 * (w + h), 6) as perimeter from ({BLD})")
_add("polygon_compactness", lambda s, d: X.buildings_from_parts(s, d).select("rid", G.compactness(F.col("geom")).alias("v")), f"select rid, round(4 * pi() * {_A} / power(2 * (w + h), 2), 6) as v from ({BLD})")
_add("polygon_concavity", lambda s, d: X.buildings_from_parts(s, d).select("rid", measure("polygon_concavity")("geom").alias("v")), f"select rid, round(case when ell then 0.75 / 0.875 else 1 end, 6) as v from ({BLD})")
# the L's smallest rectangle is that of its sides: one along its cut has 1.5 times the area
_add("polygon_elongation", lambda s, d: X.buildings_from_parts(s, d).select("rid", measure("polygon_elongation")("geom").alias("v")), f"select rid, round(greatest(w, h) / least(w, h), 6) as v from ({BLD})")
_add("polygon_orientation", lambda s, d: X.buildings_from_parts(s, d).select("rid", measure("polygon_orientation")("geom").alias("v")))


def _new_area(name: str, **how):
    """Area of the buildings' rings after a line function.  It gets a projection of its own: Spark takes no Python UDF in a lambda."""
    return lambda s, d: X.buildings_from_parts(s, d).select("rid", line_function(name, **how)("geom").alias("geom")).select("rid", G.area(F.col("geom")).alias("area"))


# the L's hull gains half of its cut
_add("convex_hull", _new_area("convex_hull"), f"select rid, round(w * h * case when ell then 0.875 else 1 end, 6) as area from ({BLD})")
_add("enclosing_rectangle", _new_area("enclosing_rectangle"), f"select rid, round(w * h, 6) as area from ({BLD})")
_add("regularize_building_rectangle", _new_area("regularize_building_rectangle", factor=1.1), f"select rid, round(1.21 * w * h, 6) as area from ({BLD})")
# all corners are right already
_add("square_polygon_naive", _new_area("square_polygon_naive"), f"select rid, round({_A}, 6) as area from ({BLD})")
_SAT = f"with a as (select rid, {_A} as a from ({BLD})), g as (select *, case when a < 60 then 0 when a > 200 then a else 200 end as g from a) "
_add(
    "building_size_constraint",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", G.area(F.col("geom")).alias("a")).select("rid", B.size_satisfaction(F.col("a"), 200, 60).alias("satisfaction")),
    _SAT + "select rid, round(case when g = 0 then 0 when a > g then 100 else 100 - 100 * abs((a - g) / g) end, 6)::double as satisfaction from g",
)
_add(
    "building_granularity_constraint",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", B.granularity(F.col("geom"), 12.0).alias("v")),
    f"""with e as (select rid, unnest(case when ell then [w, h / 2, w / 2, h / 2, w / 2, h] else [w, h, w, h] end) as l, case when ell then 6.0 else 4.0 end as n from ({BLD}))
    select rid, round(coalesce(sqrt(count(*) filter (l < 12) / first(n) * avg(12 - l) filter (l < 12) / 12), 0), 6) as v from e group by rid""",
)
_add(
    "building_size_monitor",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", G.area(F.col("geom")).alias("a")).select("rid", B.size_monitor(F.col("a"), F.col("a"), 150.0).alias("level")),
    f"""with a as (select rid, {_A} as a from ({BLD})), g as (select *, case when a < 150 then 150 when a < 300 then (1 - 2 * 0.001::double) / 150 * a + 150 - 1 + 3 * 0.001::double else a end as g from a)
    select rid, case when abs(g - a) < 0.001 then 8 when a > g then 7 when a > 5 * g / 6 then 6 when a > 3 * g / 4 then 5 when a > g / 2 then 4 when a > g / 3 then 3 when a > g / 4 then 2 else 1 end::int as level from g""",
)
_add("generalize_buildings", lambda s, d: B.generalize_buildings(X.buildings_from_parts(s, d), 200, 60).select("rid", G.area(F.col("geom")).alias("area")))
_add("typification_grid", lambda s, d: B.typification_grid(X.buildings_from_parts(s, d), 0.6, 200.0))

# --- joins and networks --------------------------------------------------------------------------------------------------

_add(
    "dwithin_self_join",
    lambda s, d: spatial.self_pairs(X.points_from_events(s, d), 5.0),
    f"with p as ({EVT}) select a.rid as l_rid, b.rid as r_rid, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as d from p a join p b on a.rid < b.rid and abs(a.x - b.x) <= 5 and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5",
)
_add(
    "knn_3",
    lambda s, d: spatial.nearest(X.points_from_embeddings(s, d), X.points_from_embeddings(s, d), 3, 40.0, exclude_self=True),
    f"with p as ({EMB}) select l_rid, rank::int as rank, r_rid, round(d, 6) as d from (select *, row_number() over (partition by l_rid order by d, r_rid) as rank from (select a.rid as l_rid, b.rid as r_rid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from p a join p b on a.rid <> b.rid)) where rank <= 3",
)
_add(
    "group_intersecting",
    lambda s, d: spatial.group_intersecting(X.buildings_from_parts(s, d).select("rid", G.bbox(F.col("geom")).alias("b")).select("rid", *[(F.col(f"b.{c}") + k).alias(c) for c, k in (("xmin", -9), ("ymin", -14), ("xmax", 9), ("ymax", 14))]), 60.0),
)
_NODES = f"with e as ({ROADS}), n as (select x1 as x, y1 as y from e union all select x2, y2 from e) "
_add(
    "graph_nodes_degree",
    lambda s, d: networks.create_graph(X.roads_from_orders(s, d))[0].select("x", "y", "degree"),
    _NODES + "select x, y, count(*) as degree from n group by x, y",
)
_add(
    "connected_components",
    lambda s, d: components.connected_components(X.roads_from_orders(s, d).select((F.col("geom")[0]["x"] * 100 + F.col("geom")[0]["y"] / 100).cast("long").alias("a"), (F.col("geom")[1]["x"] * 100 + F.col("geom")[1]["y"] / 100).cast("long").alias("b"))),
    f"""with recursive e as (select (x1 * 100 + y1 / 100)::bigint as a, (x2 * 100 + y2 / 100)::bigint as b from ({ROADS})), u as (select a, b from e union select b, a from e),
    r(node, other) as (select a, a from u union select r.node, u.b from r join u on r.other = u.a) select node, min(other) as component from r group by node""",
)


def _squeezed(s, d) -> DataFrame:
    """Roads whose columns come in pairs 40 apart: junctions joined by such an edge are drawn together."""
    squeeze = lambda p: G.point(F.floor(p.x / 200) * 200 + (p.x % 200) * 0.4, p.y)
    return X.roads_from_orders(s, d).withColumn("geom", F.transform("geom", squeeze))


_add(
    "collapse_junctions",
    lambda s, d: networks.collapse_junctions(_squeezed(s, d), 50.0).select(
        "rid", *(F.round(F.col("geom")[i][c], 6).alias(f"{c}{i + 1}") for i in (0, 1) for c in "xy")
    ),
    f"""with r as (select *, x1 % 200 = 0 and y1 = y2 as inner_ from ({ROADS})), g as (select x1, y1 from r where inner_),
    e as (select rid, x1, y1, x2, y2, exists (from g where g.x1 = floor(r.x1 / 200) * 200 and g.y1 = r.y1) as g1, exists (from g where g.x1 = floor(r.x2 / 200) * 200 and g.y1 = r.y2) as g2 from r where not inner_)
    select rid, floor(x1 / 200) * 200 + case when g1 then 20.0 else (x1 % 200) * 0.4 end as x1, y1, floor(x2 / 200) * 200 + case when g2 then 20.0 else (x2 % 200) * 0.4 end as x2, y2 from e""",
)
_add(
    "dead_ends",
    lambda s, d: networks.dead_ends(X.roads_from_orders(s, d)).select("rid", "deadend"),
)
_add("eliminate_dead_ends", lambda s, d: networks.eliminate_dead_ends(X.roads_from_orders(s, d), 250.0).select("rid"))
_add("dissolve_network", lambda s, d: networks.dissolve_network(X.roads_from_orders(s, d)))
_add("strokes_roads", lambda s, d: networks.strokes_roads(X.roads_from_orders(s, d)))
_add("network_faces", lambda s, d: networks.faces(X.roads_from_orders(s, d)).select("face", "area"))
_add("detect_roundabouts", lambda s, d: networks.detect_roundabouts(X.roads_from_orders(s, d), 20000, 0.7).select("face", "area", "index"))
_add("detect_dual_carriageways", lambda s, d: networks.detect_dual_carriageways(X.roads_from_orders(s, d), elongation=1.5, compactness=0.75, width=250.0).select("face", "area", "elongation", "width"))
def _all_paths(s, d) -> DataFrame:
    """From every node to every node; nodes by their position, as ids are hashes."""
    nodes, edges = networks.create_graph(X.roads_from_orders(s, d))
    paths = networks.shortest_paths(edges, nodes.select("node"))
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    return paths.join(at("source"), "source").join(at("node"), "node").select("source_x", "source_y", "node_x", "node_y", "cost")


_add("shortest_paths", _all_paths)
_add(
    "strahler_order",
    lambda s, d: networks.strahler(X.rivers_from_customers(s, d)),
    """with recursive t as (select c_custkey as k, 1 as s from customer where c_custkey >= 2 and c_custkey * 2 > (select max(c_custkey) from customer)), mx as (select max(c_custkey) as m from customer),
    b as (select c_custkey as k, floor(log2(m::double / c_custkey))::int as down from customer, mx where c_custkey >= 2),
    r as (select k, (select 1 + max(case when k * power(2, j) + power(2, j) - 1 <= m then j else 0 end) from range(0, 20) x(j), mx) as s from b) select k as rid, s::int as strahler from r""",
)
_add(
    "attributes_from_longest",
    lambda s, d: networks.attributes_from_longest(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("length")), "l_orderkey", "l_returnflag"),
    "select l_orderkey, l_returnflag from (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by sum(l_quantity) desc, l_returnflag) as k from lineitem group by l_orderkey, l_returnflag) where k = 1",
)

# --- decisions and terrain -----------------------------------------------------------------------------------------------


def _mcda(s, d) -> DataFrame:
    c = s.read.parquet(f"{d}/supplier.parquet").select("s_nationkey", "s_suppkey", (F.col("s_acctbal").cast("double") / 10000).alias("a"), (F.col("s_suppkey") % 5).cast("double").alias("b"), (F.col("s_suppkey") % 2).cast("double").alias("c"))
    return mcda.promethee(c, "s_nationkey", "s_suppkey", [("a", mcda.linear(0.7, 0.1), 0.5), ("b", mcda.v_shape(3.0), 0.3), ("c", mcda.usual(), 0.2)]).withColumn("phi", F.col("phi") + 1e-9)


_F5 = "case when {d} <= 0.1 then 0 when {d} <= 0.7 then ({d} - 0.1::double) / (0.7::double - 0.1::double) else 1 end"
_F3 = "case when {d} <= 0 then 0 when {d} <= 3 then {d} / 3.0 else 1 end"
_F1 = "case when {d} > 0 then 1 else 0 end"
_PHI = " + ".join(f"{w}::double * ({f.format(d=f'(p.{c} - q.{c})')} - ({f.format(d=f'(q.{c} - p.{c})')}))" for f, c, w in ((_F5, "a", "0.5"), (_F3, "b", "0.3"), (_F1, "c", "0.2")))
_add(
    "promethee_ranking", _mcda,
    f"""with s as (select s_nationkey, s_suppkey, s_acctbal::double / 10000 as a, (s_suppkey % 5)::double as b, (s_suppkey % 2)::double as c from supplier),
    f as (select p.s_nationkey, p.s_suppkey, coalesce(sum(case when p.s_suppkey <> q.s_suppkey then {_PHI} end) / nullif(count(*) - 1, 0), 0) as phi from s p join s q on p.s_nationkey = q.s_nationkey group by p.s_nationkey, p.s_suppkey)
    select s_nationkey, s_suppkey, round(phi + 1e-9, 6) as phi, row_number() over (partition by s_nationkey order by round(phi, 9), s_suppkey)::int as rank from f""",
)
_add(
    "dtm_slope_laplacian",
    lambda s, d: terrain.slope_and_laplacian(X.dtm(s), 5.0),
    f"""with g as ({DTM}), n as (select *, lag(z) over c as w1, lead(z) over c as e1, lag(z, 2) over c as w2, lead(z, 2) over c as e2, lag(z) over r as n1, lead(z) over r as s1, lag(z, 2) over r as n2, lead(z, 2) over r as s2 from g window c as (partition by row order by col), r as (partition by col order by row))
    select row, col, round(sqrt(power((e1 - w1) / 10, 2) + power((s1 - n1) / 10, 2)), 6) as slope, round((e2 - 2 * z + w2) / 100 + (s2 - 2 * z + n2) / 100, 6) as laplacian from n where e2 is not null and w2 is not null and s2 is not null and n2 is not null""",
)
_add(
    "dtm_hillshade",
    lambda s, d: terrain.hillshade(X.dtm(s), 315.0, 45.0, 5.0),
    f"""with g as ({DTM}), c as (select *, lag(z) over w as l, lead(z) over w as r from g window w as (partition by row order by col)),
    n as (select *, lag(z) over w as u, lead(z) over w as b, lag(l) over w as ul, lag(r) over w as ur, lead(l) over w as bl, lead(r) over w as br from c window w as (partition by col order by row)),
    x as (select row, col, -((ur + 2 * r + br) - (ul + 2 * l + bl)) / 40 as gx, -((ul + 2 * u + ur) - (bl + 2 * b + br)) / 40 as gy from n where l is not null and r is not null and u is not null and b is not null)
    select row, col, round(least(1.0::double, greatest(0.0::double, cos(pi() / 4) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(pi() / 4) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(gy, -gx)))), 6) as shade from x""",
)
_add(
    "dtm_mean_filter",
    lambda s, d: terrain.mean_filter(X.dtm(s), 3),
    f"with g as ({DTM}), a as (select row, col, avg(z) over (partition by col order by row rows between 1 preceding and 1 following) as z from g) select row, col, round(avg(z) over (partition by row order by col rows between 1 preceding and 1 following), 6) as z from a",
)
_add("dtm_sculpt", lambda s, d: terrain.sculpt(X.dtm(s), 5, 3))

# --- squaring, widths and overlays ---------------------------------------------------------------------------------------

for _n in ("square_polygon_orthogonal", "square_polygon_ls"):
    _add(_n, lambda s, d, n=_n: _vertices(X.buildings_from_parts(s, d).withColumn("geom", line_function(n)("geom"))))
_add("building_min_width", lambda s, d: X.buildings_from_parts(s, d).select("rid", measure("building_min_width")("geom").alias("min_width")))
_add(
    "surfacic_distance_shifted",
    lambda s, d: X.buildings_from_parts(s, d).select(
        "rid", surfacic_distance()("geom", F.transform("geom", lambda p: G.point(p.x + 2, p.y + 1))).alias("distance")
    ),
    f"""with b as ({BLD}), part_of as (
      select rid, w, h, ell, 0.0::double as x1, w as x2, 0.0::double as y1, case when ell then h / 2.0 else h end::double as y2 from b
      union all select rid, w, h, ell, 0, w / 2, h / 2.0, h from b where ell
    ), i as (
      select p.rid, first(p.w * p.h * case when p.ell then 0.75 else 1 end) as a,
        sum(greatest(0, least(p.x2, q.x2 + 2) - greatest(p.x1, q.x1 + 2)) * greatest(0, least(p.y2, q.y2 + 1) - greatest(p.y1, q.y1 + 1))) as common
      from part_of p join part_of q on p.rid = q.rid group by p.rid)
    select rid, round(1 - common / (2 * a - common), 6) as distance from i""",
)


def _proximity(s, d) -> DataFrame:
    b = X.buildings_from_parts(s, d).select("rid", F.element_at("geom", 1).alias("p")).select("rid", "p.x", "p.y")
    e = spatial.self_pairs(b, 45.0)
    e = e.select(F.col("l_rid").alias("rid"), F.col("r_rid").alias("other")).union(e.select("r_rid", "l_rid"))
    e = e.join(b.withColumnsRenamed({"x": "x1", "y": "y1"}).hint("merge"), "rid").join(b.select(F.col("rid").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2")).hint("merge"), "other")
    return e.withColumn("to_building", F.lit(True))


_add(
    "building_congestion",
    lambda s, d: B.building_congestion(_proximity(s, d), 45.0).select("rid", "n_building_edges", F.posexplode("congestion").alias("direction", "congestion")),
    f"""with b as (select rid, (rid % 50) * 40.0::double - w / 2 as x, (rid // 50) * 40.0::double - h / 2.0::double as y from ({BLD})),
    e as (select p.rid, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as size, atan2(q.y - p.y, q.x - p.x) as a0 from b p join b q on p.rid <> q.rid),
    f as (select rid, 1 - size / 45 as c, case when a0 < 0 then a0 + pi() when a0 >= pi() then a0 - pi() else a0 end as a from e where size <= 45)
    select rid, i.i::int as direction, round(max(greatest(0, c * (1 - 4 * abs(a - i.i * pi() / 8) / pi()))), 6) as congestion, count(*) as n_building_edges from f, range(16) i(i) group by rid, i.i""",
)

# --- bends and arcs --------------------------------------------------------------------------------------------------------

_add("accordion", lambda s, d: _vertices(X.lines_from_orders(s, d).withColumn("geom", line_function("accordion", width=5.0)("geom"))))
_add("bend_measures", lambda s, d: X.lines_from_orders(s, d).select("rid", F.inline(bend_measures()("geom"))))


def _arcs(s, d) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("rid"), F.radians(F.col("p_partkey") % 360).alias("t"), (F.col("p_size") + 1.0).alias("r"))
    at = lambda t: G.point(F.col("r") * F.cos(t), F.col("r") * F.sin(t))
    zero = G.point(F.lit(0.0), F.lit(0.0))
    return p.select("rid", G.circle_arc(zero, at(F.col("t")), at(F.col("t") + 2), "ccw", 8).alias("geom"))


_add(
    "circle_interpolation",
    lambda s, d: _vertices(_arcs(s, d)),
    """with p as (select p_partkey as rid, radians(p_partkey % 360) as t, p_size + 1.0::double as r from part)
    select rid, k.k::int as pos, round(r * cos(t + 2 * k.k / 11.0::double), 6) as x, round(r * sin(t + 2 * k.k / 11.0::double), 6) as y from p, range(12) k(k)""",
)

# --- propagation -------------------------------------------------------------------------------------------------------------


def _moves(s, d) -> DataFrame:
    return X.roads_from_orders(s, d).select("rid", F.col("geom").alias("before"), F.transform("geom", lambda p, i: G.point(p.x + 10, p.y + 20 * (i + 1))).alias("after"))


_add(
    "interpolate_displacement_vectors",
    lambda s, d: propagation.interpolate_displacement_vectors(_moves(s, d), 30.0),
    f"""select rid, k.k::int as k, round(x1 + (x2 - x1) * k.k / 3, 6) as x, round(y1 + (y2 - y1) * k.k / 3, 6) as y, 10.0::double as dx, round(20 + 20 * k.k / 3.0::double, 6) as dy
    from ({ROADS}), range(4) k(k)""",
)


def _crow_flies(s, d) -> DataFrame:
    line = lambda *xy: F.array(*[G.point(F.lit(float(a)), F.lit(float(b))) for a, b in xy])
    move = s.range(1).select(F.col("id").alias("rid"), line((510, 505), (910, 505)).alias("before"), line((510, 535), (910, 545)).alias("after"))
    return _vertices(propagation.propagation_crow_flies(X.roads_from_orders(s, d), move, 250.0, 20.0))


_add(
    "propagation_crow_flies", _crow_flies,
    f"""with l as ({ROADS}), len as (select sqrt(400.0 * 400 + 10 * 10)::double as n), v as (select 510 + 20.0::double * k.k as vx, 505.0::double as vy, 30 + 10 * k.k / 20.0::double as dy from range(21) k(k)),
    p as (select rid, 0 as pos, x1 as x, y1 as y from l union all select rid, 1, x2, y2 from l),
    m as (select rid, pos, sum(dy * (1 - q / 44100) / q) / sum(1 / q) as my from (select p.*, dy, (x - vx) * (x - vx) + (y - vy) * (y - vy) as q from p, v) where q <= 44100 group by rid, pos)
    select p.rid, p.pos, round(p.x, 6) as x, round(p.y + coalesce(my, 0), 6) as y from p left join m using (rid, pos)""",
)


def _network_move(s, d) -> DataFrame:
    roads = X.roads_from_orders(s, d)
    first = roads.agg(F.min("rid").alias("rid"))
    move = roads.join(F.broadcast(first), "rid").withColumn("geom", F.transform("geom", lambda p: G.point(p.x + 8, p.y + 6)))
    return _vertices(propagation.propagation_network(roads, move, reach=350.0, damping=0.5))


_add("propagation_network", _network_move)

# --- planar networks and roundabouts -----------------------------------------------------------------------------------------

_add("make_planar", lambda s, d: networks.make_planar(X.crossing_streets(s, d), 100.0).select("rid", "planar_id", F.posexplode("geom").alias("pos", "p")).select("rid", "planar_id", "pos", "p.x", "p.y"))


def _collapsed(s, d) -> DataFrame:
    roads = X.ring_roads(s, d)
    return _vertices(networks.collapse_roundabouts(roads, networks.detect_roundabouts(roads)))


_add("collapse_roundabouts", _collapsed)


# --- vectors, places on lines, parts of lines --------------------------------------------------------------------------


def _vectors(s, d) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    e = e.select(F.col("vec_id").alias("rid"), G.point(at(0), at(1)).alias("u"), G.point(at(2), at(3)).alias("v"))
    u, v, a = F.col("u"), F.col("v"), F.lit(0.7)
    pairs = {"project": V.project(u, a), "rotate": V.rotate(u, a), "double": V.with_norm(u, F.lit(2.0)), "total": V.add(u, V.opposite(v)), "by": V.between(u, V.scale(v, F.lit(3.0)))}
    single = {"dot": V.dot(u, v), "cross": V.cross(u, v), "norm": V.norm(u), "direction": V.direction(u), "angle": V.angle(u, v)}
    return e.select("rid", *(c.alias(k) for k, c in single.items()), *(c[k].alias(f"{n}_{k}") for n, c in pairs.items() for k in "xy"))


_add(
    "vector_operations", _vectors,
    """with e as (select vec_id as rid, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c, embedding[4]::double as d from embeddings),
    n as (select *, sqrt(a * a + b * b) as nu, sqrt(c * c + d * d) as nv, a * cos(0.7::double) + b * sin(0.7::double) as p from e)
    select rid, round(a * c + b * d, 6) as dot, round(a * d - b * c, 6) as cross, round(nu, 6) as norm, round(atan2(b, a), 6) as direction,
      round(acos(greatest(-1, least(1, (a * c + b * d) / (nu * nv)))), 6) as angle, round(p * cos(0.7::double), 6) as project_x, round(p * sin(0.7::double), 6) as project_y,
      round(a * cos(0.7::double) - b * sin(0.7::double), 6) as rotate_x, round(a * sin(0.7::double) + b * cos(0.7::double), 6) as rotate_y,
      round(2 * a / nu, 6) as double_x, round(2 * b / nu, 6) as double_y, round(a - c, 6) as total_x, round(b - d, 6) as total_y, round(3 * c - a, 6) as by_x, round(3 * d - b, 6) as by_y from n""",
)
_SEG = f"o as ({ORD}), s as (select rid, pos, x, y, lead(x) over w as x2, lead(y) over w as y2 from o window w as (partition by rid order by pos))"
_add(
    "line_middle_point",
    lambda s, d: X.lines_from_orders(s, d).select("rid", G.middle_point(F.col("geom")).alias("p")).select("rid", "p.x", "p.y"),
    f"""with {_SEG}, l as (select *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) as len from s where x2 is not null),
    c as (select *, sum(len) over (partition by rid order by pos) as cum, sum(len) over (partition by rid) as tot from l),
    f as (select *, (tot / 2 - cum + len) / len as t from c where cum >= tot / 2 qualify row_number() over (partition by rid order by pos) = 1)
    select rid, round(x + (x2 - x) * t, 6) as x, round(y + (y2 - y) * t, 6) as y from f""",
)
_V = "v as (select rid, first(n) as n, " + ", ".join(f"max(case when pos = {i} then {c} end) as {c}{i}" for i in range(1, 6) for c in "xy") + " from o group by rid)"
_add(
    "angle_between_lines",
    lambda s, d: X.lines_from_orders(s, d).where(F.size("geom") > 3).select("rid", G.angle_between_lines(F.slice("geom", 1, 3), F.slice("geom", F.lit(3), F.size("geom") - 2)).alias("angle")),
    f"""with o as ({ORD}), {_V} select rid, round(atan2(coalesce(y5, y4) - y3, coalesce(x5, x4) - x3) - atan2(y1 - y3, x1 - x3), 6) as angle from v where n > 3""",
)
_add(
    "angles_and_curvature",
    lambda s, d: X.lines_from_orders(s, d).select("rid", *(F.col("geom")[i].alias(f"p{i + 1}") for i in range(3))).select(
        "rid", G.angle_2_points(F.col("p1"), F.col("p2")).alias("angle2"), G.angle_3_points(F.col("p1"), F.col("p2"), F.col("p3")).alias("angle3"),
        G.angle_to_zero_pi(F.round(G.angle_3_points(F.col("p1"), F.col("p2"), F.col("p3")), 9)).alias("folded"), G.curvature(F.col("p1"), F.col("p2"), F.col("p3")).alias("curvature"),
    ),
    f"""with o as ({ORD}), {_V}, a as (select *, atan2(y3 - y2, x3 - x2) - atan2(y1 - y2, x1 - x2) as a3 from v)
    select rid, round(atan2(y2 - y1, x2 - x1), 6) as angle2, round(a3, 6) as angle3, round(case when round(a3, 9) > pi() then round(a3, 9) - pi() when a3 < 0 then -a3 else a3 end, 6) as folded,
      round(2 * abs((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)) / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) * sqrt((x3 - x1) ** 2 + (y3 - y1) ** 2)), 6) as curvature from a""",
)
_add(
    "hausdorff_to_chord",
    lambda s, d: X.lines_from_orders(s, d).select("rid", G.hausdorff(F.col("geom"), F.array(F.col("geom")[0], F.element_at("geom", -1))).alias("distance")),
    f"""with o as ({ORD}), e as (select rid, arg_min(x, pos) as ax, arg_min(y, pos) as ay, arg_max(x, pos) as bx, arg_max(y, pos) as by_ from o group by rid),
    t as (select o.*, ax, ay, bx - ax as dx, by_ - ay as dy, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) as t from o join e using (rid))
    select rid, round(max(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)), 6) as distance from t group by rid""",
)
_add(
    "merge_linestrings",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", G.split_at_vertex(F.col("geom"), F.get("geom", F.lit(1))).alias("p")).select("rid", G.merge_lines(F.reverse(F.get("p", F.lit(0))), F.get("p", F.lit(1))).alias("geom"))),
    f"select rid, (pos - 1)::int as pos, x, y from ({ORD})",
)
_add(
    "split_line_at_vertex",
    lambda s, d: X.lines_from_orders(s, d).select("rid", F.posexplode(G.split_at_vertex(F.col("geom"), F.col("geom")[1])).alias("part", "g")).select("rid", "part", F.size("g").alias("n"), F.col("g")[0]["y"].alias("y")),
    f"with o as ({ORD}) select rid, part::int as part, (case when part = 0 then 2 else first(n) - 1 end)::int as n, max(case when pos = part + 1 then y end) as y from o, range(2) r(part) group by rid, part",
)
_add(
    "extend_line",
    lambda s, d: X.lines_from_orders(s, d).select("rid", G.extend_by_length(G.extend_with_point(F.col("geom"), G.point(F.lit(0.0), F.lit(0.0))), 5.0).alias("g")).select("rid", F.size("g").alias("n"), F.col("g")[0]["x"].alias("x1"), F.col("g")[0]["y"].alias("y1"), F.element_at("g", -1)["x"].alias("x2"), F.element_at("g", -1)["y"].alias("y2")),
    f"""with o as ({ORD}), e as (select rid, first(n) as n, arg_min(x, pos) as fx, arg_min(y, pos) as fy, max(case when pos = n then x end) as lx, max(case when pos = n then y end) as ly, max(case when pos = n - 1 then x end) as kx, max(case when pos = n - 1 then y end) as ky from o group by rid)
    select rid, (n + 3)::int as n, round(-5 * fx / sqrt(fx ** 2 + fy ** 2), 6) as x1, round(-5 * fy / sqrt(fx ** 2 + fy ** 2), 6) as y1,
      round(lx + 5 * (lx - kx) / sqrt((lx - kx) ** 2 + (ly - ky) ** 2), 6) as x2, round(ly + 5 * (ly - ky) / sqrt((lx - kx) ** 2 + (ly - ky) ** 2), 6) as y2 from e""",
)
_add(
    "multi_to_simple",
    lambda s, d: vector.explode_multi(X.lines_from_orders(s, d).select("rid", F.transform(G.segments(F.col("geom")), lambda e: F.array(G.point(e.x1, e.y1), G.point(e.x2, e.y2))).alias("geom"))).select("rid", F.col("geom")[0]["x"].alias("x1"), F.col("geom")[0]["y"].alias("y1"), F.col("geom")[1]["x"].alias("x2"), F.col("geom")[1]["y"].alias("y2")),
    f"with {_SEG} select rid, x as x1, y as y1, x2, y2 from s where x2 is not null",
)
_add(
    "convert_3d_to_2d",
    lambda s, d: _vertices(X.lines_from_orders(s, d).select("rid", G.to_2d(F.transform("geom", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), (p.x + p.y).alias("z")))).alias("geom"))),
    f"select rid, (pos - 1)::int as pos, x, y from ({ORD})",
)
_add("seeded_sample", lambda s, d: vector.seeded_sample(X.points_from_events(s, d), "rid", 0.1, 7))

# --- rings, monitors, removal from blocks --------------------------------------------------------------------------------

_BLC = "select p_partkey as rid, (p_partkey % 50) * 40.0::double as cx, (p_partkey // 50) * 40.0::double as cy, 8 + p_size * 0.3::double as w, (6 + (p_partkey % 7) * 2)::double as h, p_partkey % 3 = 0 as ell from part"
_add(
    "polygon_centroid",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", G.centroid(F.col("geom")).alias("c")).select("rid", "c.x", "c.y"),
    f"select rid, round(case when ell then cx - w / 12 else cx end, 6) as x, round(case when ell then cy - h / 12 else cy end, 6) as y from ({_BLC})",
)
_add(
    "polygon_envelope",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", G.bbox(F.col("geom")).alias("b"), G.is_ccw(F.col("geom")).alias("ccw"), G.is_closed(F.col("geom")).alias("closed")).select("rid", "b.*", "ccw", "closed"),
    f"select rid, round(cx - w / 2, 6) as xmin, round(cy - h / 2, 6) as ymin, round(cx + w / 2, 6) as xmax, round(cy + h / 2, 6) as ymax, true as ccw, true as closed from ({_BLC})",
)
_add(
    "points_in_rings",
    lambda s, d: spatial.points_in_rings(
        s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * 37 % 2000 + 0.2512345).alias("x"), (F.col("c_custkey") * 53 % 1600 + 0.2512345).alias("y")),
        X.buildings_from_parts(s, d).select(F.col("rid").alias("ring_id"), F.col("geom").alias("ring")), 40.0,
    ),
    f"""with p as (select c_custkey as rid, c_custkey * 37 % 2000 + 0.2512345::double as x, c_custkey * 53 % 1600 + 0.2512345::double as y from customer), b as ({_BLC})
    select p.rid, b.rid as ring_id from p join b on x between cx - w / 2 and cx + w / 2 and y between cy - h / 2 and cy + h / 2 and not (ell and x > cx and y > cy)""",
)
_add(
    "building_position_monitor",
    lambda s, d: X.points_from_events(s, d).select("rid", B.position_monitor(V.norm(G.point(F.col("w"), F.col("r") - 10)), 5.0).alias("level")),
    f"select rid, case when m < 0.001 then 8 when m < 1.25 then 7 when m < 2.5 then 6 when m <= 5 then 5 when m < 7.5 then 4 when m < 10 then 3 when m < 12.5 then 2 else 1 end::int as level from (select rid, sqrt(w * w + (r - 10) * (r - 10)) as m from ({EVT}))",
)
_add(
    "object_granularity_monitor",
    lambda s, d: X.buildings_from_parts(s, d).select("rid", B.granularity_monitor(F.col("geom"), 10.0, 0.103).alias("level")),
    f"""with v as (select rid, case when ell then least(w, h) / 2 else least(w, h) end as m, case when ell then 7 else 5 end / (2 * (w + h)) as k from ({BLD}))
    select rid, case when m >= 10 then 8 when m > 7.5 and k < 0.103 then 7 when k < 0.103 then 6 when m > 7.5 and k < 0.206 then 5 when m > 5 and k < 0.206 then 4 when m > 5 and k > 0.206 then 3 when m > 2.5 and k > 0.206 then 2 else 1 end::int as level from v""",
)


def _block_buildings(s, d) -> DataFrame:
    """Buildings by 25 a block, with made-up congestion and neighbours."""
    r = F.col("rid")
    directions = F.array((r % 5) * 0.13, (r % 3) * 0.21, (r % 7) * 0.07)
    return X.buildings_from_parts(s, d).select(
        F.expr("rid div 25").alias("block"), "rid", G.area(F.col("geom")).alias("area"), (r % 4 == 0).alias("corner"), directions.alias("directions"), (r % 6).alias("n_building_edges"), (r % 6 + r % 3).alias("n_edges")
    )


_add(
    "block_density",
    lambda s, d: B.block_density(_block_buildings(s, d), _block_buildings(s, d).select("block", F.lit(39989.0).alias("area")).distinct())
    .join(B.block_density(_block_buildings(s, d), _block_buildings(s, d).select("block", F.lit(39989.0).alias("area")).distinct(), 200.0).withColumnRenamed("density", "simulated"), "block")
    .select("*", B.block_density_satisfaction(F.col("density"), F.lit(0.1)).alias("satisfaction"), B.block_proximity_satisfaction(F.col("density")).alias("proximity")),
    f"""with b as (select rid // 25 as block, {_A} as a from ({BLD})), d as (select block, sum(a) / 39989 as density, sum(greatest(a, 200)) / 39989 as simulated from b group by block)
    select block, round(density, 6) as density, round(simulated, 6) as simulated, greatest(0, 100 - round_even(abs(density - 0.1) / 0.003::double, 0))::double as satisfaction, greatest(0, 100 - round_even(density / 0.005::double, 0))::double as proximity from d""",
)
_FLOW = f"""with b as (select rid // 25 as block, rid, greatest({_A}, 100) as big, {_A} as a, (rid % 4 = 0)::int as corner, (rid % 5) * 0.13::double as d1, (rid % 3) * 0.21::double as d2, (rid % 7) * 0.07::double as d3, rid % 6 as nb, rid % 6 + rid % 3 as ne from ({BLD})),
s as (select *, case when big - a > 15 then big else a end as v, (d1 > 0)::int + (d2 > 0)::int + (d3 > 0)::int as k from b),
c as (select block, rid, case when v <= 71.3::double then 1 when v <= 142.6::double then 1 - (v + 1) / 142.6::double else 1 - v / 285.2::double end as c1, case when k > 0 then (d1 + d2 + d3) / k else 0 end as c2,
  (d1 > 0.08)::int + (d2 > 0.08)::int + (d3 > 0.08)::int as c3, corner as c4, case when ne > 0 then nb::double / ne else 0 end as c5 from s),
f as (select p.block, p.rid, coalesce(sum(case when p.rid <> q.rid then 0.2::double * ({" + ".join(f"(p.{c} - q.{c} > {k})::int - (q.{c} - p.{c} > {k})::int" for c, k in (("c1", "0.7::double"), ("c2", "0.4::double"), ("c3", "0.4::double"), ("c4", "0.5::double"), ("c5", "0.6::double")))}) end) / nullif(count(*) - 1, 0), 0) as phi
  from c p join c q on p.block = q.block group by p.block, p.rid) """
_add(
    "building_elimination_ranking",
    lambda s, d: B.elimination_ranking(_block_buildings(s, d), 100.0, 71.3).withColumn("phi", F.col("phi") + 1e-9),
    _FLOW + "select block, rid, round(phi + 1e-9, 6) as phi, row_number() over (partition by block order by round(phi, 9), rid)::int as rank from f",
)
_add(
    "building_elimination_best",
    lambda s, d: B.elimination_best(_block_buildings(s, d), 100.0, 71.3),
    _FLOW + "select block, rid from f qualify row_number() over (partition by block order by round(phi, 9) desc, rid) = 1",
)

# --- spanning trees, faces as partitions ---------------------------------------------------------------------------------

_add(
    "minimum_spanning_tree",
    lambda s, d: networks.minimum_spanning_tree(networks.create_graph(X.roads_from_orders(s, d))[1].withColumn("length", F.col("length") + F.col("rid") * 37 % 101)).select("rid", "length"),
    f"""with recursive e as (select rid, (x1 * 100 + y1 / 100)::bigint as a, (x2 * 100 + y2 / 100)::bigint as b, 100.0::double + rid * 37 % 101 as length from ({ROADS})),
    u as (select rid, a, b, length from e union all select rid, b, a, length from e),
    r(rid, l, goal, n) as (select rid, length, b, a from e union select r.rid, r.l, r.goal, u.b from r join u on u.a = r.n where u.length < r.l or (u.length = r.l and u.rid < r.rid))
    select rid, length from e where rid not in (select rid from r where n = goal)""",
)
_add(
    "partition_networks",
    lambda s, d: networks.partition_networks(
        s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") * 37 % 2000).cast("double").alias("x"), (F.col("c_custkey") * 53 % 2000).cast("double").alias("y")),
        X.roads_from_orders(s, d), 200.0,
    ),
)
