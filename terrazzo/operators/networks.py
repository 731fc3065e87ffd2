"""Networks: nodes and edges, junctions, dissolving, dead ends, river orders, strokes, shortest paths."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terrazzo.functions import geometry as G
from terrazzo.plans.components import connected_components
from terrazzo.plans.durable import discard, materialize
from terrazzo.plans.spatial import points_in_rings, self_pairs


def edges_of(lines: DataFrame, digits: int = 6) -> DataFrame:
    """``(rid, x1, y1, x2, y2, length)`` of lines ``(rid, geom)``; ends are rounded to ``digits`` decimals."""
    end = lambda i, k: F.round(F.element_at("geom", i)[k], digits)
    return lines.where("geom is not null and size(geom) > 1").select(
        "rid", end(1, "x").alias("x1"), end(1, "y").alias("y1"), end(-1, "x").alias("x2"), end(-1, "y").alias("y2"), G.length(F.col("geom")).alias("length")
    )


def create_graph(lines: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """``nodes(node, x, y, degree)`` and ``edges(rid, src, dst, length)``; parallel edges stay.

    A node's id is a hash of its position, so that building a graph takes one aggregation and no numbering.
    """
    e = edges_of(lines, digits)
    node = lambda x, y: F.xxhash64(F.col(x), F.col(y))
    edges = e.select("rid", node("x1", "y1").alias("src"), node("x2", "y2").alias("dst"), "length", "x1", "y1", "x2", "y2")
    ends = edges.select(F.col("src").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")).union(edges.select("dst", "x2", "y2"))
    nodes = ends.groupBy("node").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.count("*").alias("degree"))
    return nodes, edges.select("rid", "src", "dst", "length")


def collapse_junctions(lines: DataFrame, threshold: float) -> DataFrame:
    """``lines`` with near junctions drawn together: edges inside a group of nodes go, ends move to its centre.

    Nodes within ``threshold`` cluster by single linkage; a group is what edges connect inside a cluster.
    """
    nodes, edges = create_graph(lines)
    nodes, edges = materialize(nodes, "nodes"), materialize(edges, "edges")
    close = self_pairs(nodes.select(F.col("node").alias("rid"), "x", "y"), threshold)
    cluster = connected_components(close, "l_rid", "r_rid").withColumnRenamed("component", "cluster")
    cluster = materialize(cluster, "clusters")
    inner = (
        edges.join(cluster.select(F.col("node").alias("src"), F.col("cluster").alias("c1")), "src")
        .join(cluster.select(F.col("node").alias("dst"), F.col("cluster").alias("c2")), "dst")
        .where("c1 = c2 and src <> dst")
    )
    group = materialize(connected_components(inner, "src", "dst"), "groups")
    centre = group.join(nodes, "node").groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    moved = group.join(centre, "component").select("node", "component", F.struct("x", "y").alias("p"))
    moved = materialize(moved, "moved")
    e = edges.join(moved.select(F.col("node").alias("src"), F.col("component").alias("c1"), F.col("p").alias("p1")), "src", "left")
    e = e.join(moved.select(F.col("node").alias("dst"), F.col("component").alias("c2"), F.col("p").alias("p2")), "dst", "left")
    e = e.where("c1 is null or c2 is null or c1 <> c2").select("rid", "p1", "p2")
    out = lines.join(e, "rid")
    start = F.when(F.col("p1").isNull(), F.slice("geom", 1, 1)).otherwise(F.array("p1"))
    end = F.when(F.col("p2").isNull(), F.slice("geom", -1, 1)).otherwise(F.array("p2"))
    geom = F.concat(start, F.slice("geom", F.lit(2), F.size("geom") - 2), end)
    return out.withColumn("geom", geom).drop("p1", "p2")


def dead_ends(lines: DataFrame) -> DataFrame:
    """``(rid, deadend, deid)``: edges that repeated removal of degree-one nodes takes away, grouped by connection."""
    nodes, edges = create_graph(lines)
    all_edges = materialize(edges, "edges")
    live = all_edges
    while True:
        degree = live.select(F.col("src").alias("node")).union(live.select("dst")).groupBy("node").agg(F.count("*").alias("n")).where("n = 1")
        cut = live.join(degree.select(F.col("node").alias("src")), "src", "left_anti").join(degree.select(F.col("node").alias("dst")), "dst", "left_anti")
        nxt = materialize(cut.select("rid", "src", "dst", "length"), "live")
        same = nxt.count() == live.count()
        if live is not all_edges:
            discard(live)
        live = nxt
        if same:
            break
    dead = materialize(all_edges.join(live.select("rid"), "rid", "left_anti"), "dead")
    group = connected_components(dead, "src", "dst").select(F.col("node").alias("src"), F.col("component").alias("deid"))
    marked = dead.join(group, "src").select("rid", "deid")
    return all_edges.select("rid").join(marked, "rid", "left").select("rid", F.col("deid").isNotNull().alias("deadend"), "deid")


def eliminate_dead_ends(lines: DataFrame, length: float = 0.0) -> DataFrame:
    """``lines`` without dead-end groups of less than ``length`` in all (0: every group goes)."""
    d = materialize(dead_ends(lines).where("deadend"), "dead")
    total = d.join(lines.select("rid", G.length(F.col("geom")).alias("n")), "rid").groupBy("deid").agg(F.sum("n").alias("n"))
    gone = d.join(total.where(F.lit(length <= 0) | (F.col("n") < length)).select("deid"), "deid", "left_semi").select("rid")
    return lines.join(gone, "rid", "left_anti")


def strahler(edges: DataFrame) -> DataFrame:
    """``(rid, strahler)`` of river edges ``(rid, src, dst)`` drawn downstream; edges on a cycle have null.

    An edge without feeders has order 1; with one feeder of the highest order it keeps it, with more it gains one.
    Rounds follow the longest path, each over edges whose feeders are all known.
    """
    e = materialize(edges.select("rid", "src", "dst"), "rivers")
    done = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select("rid", "dst", F.lit(1).alias("strahler")), "orders")
    todo = materialize(e.join(done, "rid", "left_anti"), "todo")
    feeders = e.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("need"))
    while True:
        into = done.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("have"), F.max("strahler").alias("top"), F.collect_list("strahler").alias("s"))
        ready = todo.join(into, "src").join(feeders, "src").where("have = need")
        up = ready.select("rid", "dst", (F.col("top") + F.when(F.size(F.filter("s", lambda v: v == F.col("top"))) > 1, 1).otherwise(0)).alias("strahler"))
        up = materialize(up, "up")
        if up.limit(1).count() == 0:
            break
        done, todo = materialize(done.union(up), "orders"), materialize(todo.join(up, "rid", "left_anti"), "todo")
    return e.select("rid").join(done.select("rid", "strahler"), "rid", "left")


def minimum_spanning_tree(edges: DataFrame) -> DataFrame:
    """``(rid, src, dst, length)``: the edges of a minimum spanning forest; equal lengths go by ``rid``, loops never.

    Rounds: each tree takes its least edge out, and trees so joined become one.  Their number at least halves a round.
    """
    left = materialize(edges.where("src <> dst").select("rid", "src", "dst", "length", F.col("src").alias("a"), F.col("dst").alias("b")), "left")
    tree = None
    while left.limit(1).count() > 0:
        sides = left.select(F.col("a").alias("t"), "rid", "length").union(left.select("b", "rid", "length"))
        least = sides.groupBy("t").agg(F.min_by("rid", F.struct("length", "rid")).alias("rid")).select("rid").distinct()
        taken = materialize(left.join(least, "rid", "left_semi"), "taken")
        comp = connected_components(taken, "a", "b")
        to = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias("n" + k))
        merged = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select("rid", "src", "dst", "length", F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
        nxt = materialize(merged.where("a <> b"), "left")
        discard(left)
        left, part = nxt, taken.select("rid", "src", "dst", "length")
        tree = part if tree is None else tree.union(part)
    return left.select("rid", "src", "dst", "length") if tree is None else tree


def partition_networks(points: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """``(rid, face)``: points ``(rid, x, y)`` by the bounded faces of a planar network; on an edge they join several.

    Points meet faces in grid cells of ``cell``.  Points in no face are left out.
    """
    f = faces(lines).select(F.col("face").alias("ring_id"), F.col("geom").alias("ring"))
    return points_in_rings(points, f, cell, edges=True).withColumnRenamed("ring_id", "face")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_cost: float = float("inf"), max_rounds: int | None = None) -> DataFrame:
    """``(source, node, cost)``: cheapest costs over undirected ``edges(src, dst, length)`` from ``sources(node)``.

    Rounds go on until no cost falls.  Where that takes more than ``max_rounds`` (as many as there are nodes, which
    lengths of 0 or more never exceed), it raises.
    """
    both = materialize(edges.select("src", "dst", "length").union(edges.select("dst", "src", "length")), "arcs")
    best = front = materialize(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")).distinct(), "front")
    rounds = both.select("src").distinct().count() if max_rounds is None else max_rounds
    for done in itertools.count():
        step = front.join(both, front.node == both.src).select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("length")).alias("cost"))
        step = step.where(F.col("cost") <= max_cost).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        old = best.withColumnRenamed("cost", "old")
        new = materialize(step.join(old, ["source", "node"], "left").where("old is null or cost < old").select("source", "node", "cost"), "front")
        if new.limit(1).count() == 0:
            return best
        if done >= rounds:
            raise RuntimeError(f"shortest paths: costs still fall after {rounds} rounds")
        best = materialize(best.union(new).groupBy("source", "node").agg(F.min("cost").alias("cost")), "best")
        front = new


def attributes_from_longest(lines: DataFrame, group: str, attribute: str, length: str = "length") -> DataFrame:
    """``(group, attribute)``: per group the value with the largest total length; ties to the smaller value."""
    per = lines.groupBy(group, attribute).agg(F.sum(length).alias("n"))
    return per.groupBy(group).agg(F.min_by(attribute, F.struct(-F.col("n"), F.col(attribute))).alias(attribute))


def stroke_pairs(lines: DataFrame, angle: float = 45.0) -> DataFrame:
    """``(l_rid, r_rid, deviation)``: at each node, pairs of line ends that are each other's straightest continuation.

    Deviation is the turn in degrees, under ``angle``.  Ties go to smaller ids.
    """
    end = lambda i, j: F.struct(F.col("rid"), F.element_at("geom", i).alias("p"), F.atan2(F.element_at("geom", j)["y"] - F.element_at("geom", i)["y"], F.element_at("geom", j)["x"] - F.element_at("geom", i)["x"]).alias("a"))
    ends = lines.where("size(geom) > 1").select(F.explode(F.array(end(1, 2), end(-1, -2))).alias("e")).select("e.*")
    ends = ends.withColumn("nx", F.round("p.x", 6)).withColumn("ny", F.round("p.y", 6)).drop("p")
    b = ends.select(F.col("rid").alias("r"), F.col("a").alias("b"), "nx", "ny")
    turn = F.abs(180 - F.degrees(F.abs(F.pmod(F.col("a") - F.col("b") + F.pi(), 2 * F.pi()) - F.pi())))
    pairs = ends.join(b, ["nx", "ny"]).where("rid <> r").withColumn("t", F.round(turn, 9)).where(F.col("t") < angle)
    best = pairs.groupBy("nx", "ny", "rid").agg(F.min(F.struct("t", "r")).alias("m"))
    one = best.select("nx", "ny", F.col("rid").alias("l_rid"), F.col("m.r").alias("r_rid"), F.col("m.t").alias("deviation"))
    other = best.select("nx", "ny", F.col("m.r").alias("l_rid"), F.col("rid").alias("r_rid"))
    return one.join(other, ["nx", "ny", "l_rid", "r_rid"]).where("l_rid < r_rid").select("l_rid", "r_rid", "deviation").distinct()


def strokes_roads(lines: DataFrame, angle: float = 45.0) -> DataFrame:
    """``(rid, stroke)``: lines chained through mutual best continuations; a line without any is its own stroke.

    Unlike a greedy walk this doesn't depend on the order of lines.
    """
    comp = connected_components(stroke_pairs(lines, angle), "l_rid", "r_rid")
    return lines.select("rid").join(comp.select(F.col("node").alias("rid"), F.col("component").alias("stroke")), "rid", "left").select("rid", F.coalesce("stroke", "rid").alias("stroke"))


def dissolve_network(lines: DataFrame) -> DataFrame:
    """``(rid, chain)``: edges joined through nodes of degree two; the chain is the smallest ``rid`` in it."""
    _, edges = create_graph(lines)
    edges = materialize(edges, "edges")
    ends = edges.select("rid", F.explode(F.array("src", "dst")).alias("node"))
    two = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("rid").alias("a"), F.max("rid").alias("b")).where("n = 2 and a <> b")
    comp = connected_components(two, "a", "b")
    return edges.select("rid").join(comp.select(F.col("node").alias("rid"), F.col("component").alias("chain")), "rid", "left").select("rid", F.coalesce("chain", "rid").alias("chain"))


def faces(lines: DataFrame) -> DataFrame:
    """``(face, geom, area)`` of a planar network of straight edges: bounded faces by half-edge tracing.

    Each directed edge's successor is the next one clockwise at its end; cycles of successors are faces, found as
    components, and put in order by pointer doubling.
    """
    e = edges_of(lines)
    half = e.select(F.col("rid").alias("h"), "x1", "y1", "x2", "y2").union(e.select((-F.col("rid") - 1).alias("h"), "x2", "y2", "x1", "y1"))
    half = materialize(half, "half")
    out = half.select("h", "x1", "y1", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("a"))
    node = W.partitionBy("x1", "y1").orderBy("a", "h")
    turn = out.select("h", F.coalesce(F.lag("h").over(node), F.last("h").over(node.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next"))
    # after h comes the edge clockwise from h's twin at h's end
    twin = (-F.col("h") - 1).alias("h")
    succ = materialize(turn.select(twin, "next"), "succ")
    comp = connected_components(succ, "h", "next").select(F.col("node").alias("h"), F.col("component").alias("face"))
    size = comp.groupBy("face").agg(F.count("*").alias("n"))
    rank = comp.join(succ, "h").select("h", "face", "next", F.when(F.col("h") == F.col("face"), 0).otherwise(1).alias("d"))
    # distance to the face's first half edge, by doubling
    rank = rank.select("h", "face", F.when(F.col("d") == 0, F.col("h")).otherwise(F.col("next")).alias("to"), "d")
    top = size.agg(F.max("n")).first()[0] or 1
    step = 1
    rank = materialize(rank, "rank")
    while step < top:
        ahead = rank.select(F.col("h").alias("to"), F.col("to").alias("far"), F.col("d").alias("more"))
        nxt = materialize(rank.join(ahead, "to").select("h", "face", F.col("far").alias("to"), (F.col("d") + F.col("more")).alias("d")), "rank")
        discard(rank)
        rank, step = nxt, step * 2
    ordered = rank.join(half, "h").groupBy("face").agg(F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("v"))
    ring = F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    ring = F.concat(F.slice(ring, -1, 1), ring)
    done = ordered.select("face", ring.alias("geom")).withColumn("area", G.signed_area(F.col("geom")))
    return done.where("area > 1e-9")


def detect_roundabouts(lines: DataFrame, area_threshold: float = 40000, miller_index: float = 0.95) -> DataFrame:
    """Faces under ``area_threshold`` whose compactness is over ``miller_index``: ``(face, geom, area, index)``."""
    return faces(lines).withColumn("index", G.compactness(F.col("geom"))).where((F.col("area") < area_threshold) & (F.col("index") > miller_index))


def detect_dual_carriageways(
    lines: DataFrame, concavity: float = 0.85, elongation: float = 6.0, compactness: float = 0.12, area: float = 60000.0, width: float = 20.0
) -> DataFrame:
    """Long thin faces: ``(face, geom, area, perimeter, concavity, elongation, compactness, width)``."""
    from terrazzo.functions.udfs import measure

    f = faces(lines).withColumn("perimeter", G.length(F.col("geom"))).withColumn("compactness", G.compactness(F.col("geom")))
    f = f.where((F.col("area") < area) & (F.col("compactness") < compactness))
    f = f.withColumn("concavity", measure("polygon_concavity")("geom")).withColumn("elongation", measure("polygon_elongation")("geom"))
    half = F.col("perimeter") / 4
    f = f.withColumn("width", half - F.sqrt(F.greatest(F.lit(0.0), half * half - F.col("area"))))
    return f.where((F.col("concavity") > concavity) & (F.col("elongation") > elongation) & (F.col("width") < width))


def segment_pairs(seg: DataFrame, cell: float) -> DataFrame:
    """Segments ``(rid, seg, x1, y1, x2, y2)`` with others ``(o_rid, ...)`` of a common cell; of others alike the first four.

    Four are enough to show that one is neither the segment nor beside it in its line.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    binned = lambda df: df.select("*", span(F.col("x1"), F.col("x2")).alias("cx")).select("*", span(F.col("y1"), F.col("y2")).alias("cy"))
    copy = F.row_number().over(W.partitionBy("x1", "y1", "x2", "y2").orderBy("rid", "seg"))
    other = binned(seg.withColumn("copy", copy).where("copy <= 4")).select("cx", "cy", *[F.col(c).alias("o_" + c) for c in seg.columns])
    return binned(seg).join(other.hint("merge"), ["cx", "cy"]).where("rid <> o_rid or seg <> o_seg")


def make_planar(lines: DataFrame, cell: float, digits: int = 6) -> DataFrame:
    """``lines`` cut wherever they cross, touch or overlap: a row for each piece, with ``planar_id`` from 0 within a line.

    Other columns are repeated.  Of pieces lying on one another that of the smallest ``rid`` stays.  Segments meet in
    square cells of side ``cell``, so choose it near their usual length.  Positions are rounded to ``digits`` decimals.
    """
    xy = lambda p: F.struct(F.round(p.x, digits).alias("x"), F.round(p.y, digits).alias("y"))
    flat = lines.where("geom is not null and size(geom) > 1").select("rid", F.transform("geom", xy).alias("geom"))
    # of lines alike all but the first lose their pieces to it: two of them cut each other and the rest as all would
    copy = F.row_number().over(W.partitionBy("geom").orderBy("rid"))
    flat = materialize(flat.withColumn("copy", copy).where("copy <= 2").drop("copy"), "lines")
    seg = flat.select("rid", F.posexplode(G.segments(F.col("geom"))).alias("seg", "s")).select(
        "rid", "seg", "s.x1", "s.y1", "s.x2", "s.y2"
    ).where("x1 <> x2 or y1 <> y2")
    seg = materialize(seg, "segments")
    pair = segment_pairs(seg, cell)
    rx, ry = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sx, sy = F.col("o_x2") - F.col("o_x1"), F.col("o_y2") - F.col("o_y1")
    wx, wy = F.col("o_x1") - F.col("x1"), F.col("o_y1") - F.col("y1")
    den, long2 = rx * sy - ry * sx, rx * rx + ry * ry
    slack = 10.0**-digits
    t, u = (wx * sy - wy * sx) / den, (wx * ry - wy * rx) / den
    hit = F.when((F.abs(den) > 1e-12) & t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9), t)
    on = lambda ax, ay: F.when(F.abs(ax * ry - ay * rx) <= slack * F.sqrt(long2), (ax * rx + ay * ry) / long2)
    # where a segment's neighbour in its own line begins is no crossing
    own = (F.col("rid") == F.col("o_rid")) & (F.abs(F.col("seg") - F.col("o_seg")) == 1)
    cuts = pair.where(~own).select("rid", "seg", "x1", "y1", "x2", "y2", F.explode(F.array(hit, on(wx, wy), on(wx + sx, wy + sy))).alias("t"))
    cuts = cuts.where("t >= -1e-9 and t <= 1 + 1e-9").select(
        "rid", "seg", F.round(F.col("x1") + F.col("t") * rx, digits).alias("x"), F.round(F.col("y1") + F.col("t") * ry, digits).alias("y"),
        F.hypot(F.round(F.col("x1") + F.col("t") * rx, digits) - F.col("x1"), F.round(F.col("y1") + F.col("t") * ry, digits) - F.col("y1")).alias("d"),
        ((F.round(F.col("x1") + F.col("t") * rx, digits) == F.col("x2")) & (F.round(F.col("y1") + F.col("t") * ry, digits) == F.col("y2"))).alias("end"),
    )
    cuts = cuts.select("rid", (F.col("seg") + F.col("end").cast("int")).alias("seg"), F.when(F.col("end"), 0.0).otherwise(F.col("d")).alias("d"), "x", "y", F.lit(True).alias("node"))
    own_vertices = flat.select("rid", F.posexplode("geom").alias("seg", "p")).select("rid", "seg", F.lit(0.0).alias("d"), "p.x", "p.y", F.lit(False).alias("node"))
    dots = cuts.union(own_vertices).groupBy("rid", "seg", "x", "y").agg(F.min("d").alias("d"), F.max("node").alias("node"))
    line = W.partitionBy("rid").orderBy("seg", "d")
    before = F.coalesce(F.sum(F.col("node").cast("long")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dots = dots.withColumn("piece", before).withColumn("piece", F.explode(F.when(F.col("node"), F.array("piece", F.col("piece") + 1)).otherwise(F.array("piece"))))
    piece = dots.groupBy("rid", "piece").agg(F.sort_array(F.collect_list(F.struct("seg", "d", "x", "y"))).alias("v")).where("size(v) > 1")
    piece = piece.select("rid", "piece", F.transform("v", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("geom"))
    either = F.least(F.col("geom"), F.reverse("geom"))
    kept = piece.withColumn("k", F.row_number().over(W.partitionBy(either).orderBy("rid", "piece"))).where("k = 1")
    kept = kept.withColumn("planar_id", F.row_number().over(W.partitionBy("rid").orderBy("piece")) - 1)
    return lines.drop("geom").join(kept.select("rid", "planar_id", "geom"), "rid")


def collapse_roundabouts(lines: DataFrame, roundabouts: DataFrame, max_radius: float | None = None, digits: int = 6) -> DataFrame:
    """``lines`` with each roundabout ``(face, geom)`` drawn to its centroid.

    Lines all of whose vertices are the ring's go.  A line with an end on the ring is led on to the centroid; of several
    at one vertex, only that of the smallest ``rid``, since they still meet there.  With ``max_radius``, rings whose
    nearest vertex is that far from the centroid, or farther, are left alone.
    """
    at = lambda p: (F.round(p.x, digits).alias("vx"), F.round(p.y, digits).alias("vy"))
    ring = roundabouts.select("face", G.centroid(F.col("geom")).alias("c"), "geom").where("c is not null")
    if max_radius is not None:
        near = F.array_min(F.transform("geom", lambda p: F.hypot(p.x - F.col("c").x, p.y - F.col("c").y)))
        ring = ring.where(near < max_radius)
    ring = ring.select("face", "c", F.explode("geom").alias("p")).select("face", "c", *at(F.col("p"))).distinct()
    dots = lines.select("rid", (F.size("geom") - 1).alias("last"), F.posexplode("geom").alias("pos", "p")).select("rid", "last", "pos", *at(F.col("p")))
    on = materialize(dots.join(ring, ["vx", "vy"]), "on_ring")
    gone = on.groupBy("rid", "face").agg(F.countDistinct("pos").alias("n"), F.max("last").alias("last")).where("n > last").select("rid").distinct()
    gone = materialize(gone, "gone")
    ends = on.where("pos = 0 or pos = last").join(gone, "rid", "left_anti")
    first = ends.withColumn("k", F.row_number().over(W.partitionBy("face", "vx", "vy").orderBy("rid", "pos"))).where("k = 1")
    led = first.groupBy("rid").agg(F.min(F.when(F.col("pos") == 0, F.struct("face", "c"))).alias("__s"), F.min(F.when(F.col("pos") > 0, F.struct("face", "c"))).alias("__e"))
    out = lines.join(gone, "rid", "left_anti").join(led, "rid", "left")
    none = F.slice("geom", 1, 0)
    head = F.when(F.col("__s").isNotNull(), F.array(F.col("__s.c"))).otherwise(none)
    tail = F.when(F.col("__e").isNotNull(), F.array(F.col("__e.c"))).otherwise(none)
    return out.withColumn("geom", F.concat(head, F.col("geom"), tail)).drop("__s", "__e")
