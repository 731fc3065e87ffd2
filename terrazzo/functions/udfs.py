"""Arrow UDFs of the numpy kernels, and their registration as SQL functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import batches
from . import building_kernels as BK
from . import kernels as K
from .building_batches import surfacic_distances
from .geometry import LINE_DDL

#: Line to line.
LINE_FUNCTIONS: dict[str, Callable] = {
    "simplify_douglas_peucker": K.douglas_peucker, "simplify_visvalingam_whyatt": K.visvalingam_whyatt, "simplify_li_openshaw": K.li_openshaw,
    "simplify_lang": K.lang, "simplify_reumann_witkam": K.reumann_witkam, "simplify_whirlpool": K.whirlpool, "simplify_angular": K.angular,
    "simplify_raposo": K.raposo, "simplify_wang_muller": K.wang_muller, "smooth_gaussian": K.gaussian, "smooth_wma": K.moving_average,
    "smooth_taubin": K.taubin, "smooth_chaikin": K.chaikin, "smooth_catmull_rom": K.catmull_rom, "smooth_platre": K.platre, "smooth_snake": K.snake,
    "smooth_topographic": K.topographic, "resample_line": K.resample, "remove_flat_vertices": K.remove_flat_vertices, "convex_hull": K.convex_hull,
    "enclosing_rectangle": K.enclosing_rectangle, "regularize_building_rectangle": K.regularize_rectangle, "square_polygon_naive": BK.square_corners, "square_polygon_edges": K.square_naive, "enlarge_polygon": K.enlarge,
    "square_polygon_orthogonal": BK.square_orthogonal, "square_polygon_ls": BK.square_least_squares, "accordion": K.accordion,
}
#: Ring to number.
MEASURES: dict[str, Callable] = {
    "polygon_compactness": K.compactness, "polygon_concavity": K.concavity, "polygon_elongation": K.elongation, "polygon_orientation": K.orientation,
    "building_min_width": BK.min_width,
}


POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
#: Vertices at a time: kernels' temporary arrays are some tens of times as large.
AT_ONCE = 1 << 17


def _flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a list array and each line's number of them; null lines have none."""
    x, y = (c.to_numpy(zero_copy_only=False) for c in lines.flatten().flatten())
    return np.column_stack([x, y]).astype(float), pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(counts: np.ndarray) -> list[tuple[slice, slice]]:
    """Slices of lines, and of their vertices, of about ``AT_ONCE`` vertices."""
    at = batches.starts(counts)
    cut = np.unique([0, *np.searchsorted(at, np.arange(AT_ONCE, at[-1], AT_ONCE)), len(counts)])
    return [(slice(a, b), slice(at[a], at[b])) for a, b in zip(cut, cut[1:], strict=False)]


def _lists(counts: np.ndarray, values: pa.Array, like: pa.Array | None = None) -> pa.Array:
    """A list array; null where ``like`` is."""
    mask = None if like is None or not like.null_count else like.is_null()
    return pa.ListArray.from_arrays(pa.array(batches.starts(counts), pa.int32()), values, mask=mask)


def _lines(lines: pa.Array, f: Callable[[np.ndarray, np.ndarray, slice], batches.Ragged]) -> pa.Array:
    flat, counts = _flat(lines)
    out = [f(flat[v], counts[w], w) for w, v in _parts(counts)] or [(flat, counts)]
    xy, n = (np.concatenate(x) for x in zip(*out, strict=True))
    empty = None
    if (counts == 1).any() and lines.flatten().field("x").null_count + lines.flatten().field("y").null_count:
        # lines of one vertex are as they came, nulls too
        empty = np.zeros(xy.shape, bool)
        alone = counts == 1
        empty[batches.starts(n)[:-1][alone]] = np.isnan(flat[batches.starts(counts)[:-1][alone]])
    xs = [pa.array(np.ascontiguousarray(xy[:, k]), mask=None if empty is None else np.ascontiguousarray(empty[:, k])) for k in (0, 1)]
    return _lists(n, pa.StructArray.from_arrays(xs, fields=list(POINT)), lines)


def line_function(name: str, **how) -> Callable[[Column], Column]:
    """``LINE_FUNCTIONS[name]`` as a function of a line column.  Null lines and lines under two vertices are unchanged."""
    f = LINE_FUNCTIONS[name]

    def run(lines: pa.Array) -> pa.Array:
        return _lines(lines, lambda flat, counts, _: batches.apply(flat, counts, f, **how))

    run.__annotations__ = {"lines": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, LINE_DDL)


def measure(name: str, **how) -> Callable[[Column], Column]:
    """``MEASURES[name]`` as a function of a ring column; null for rings under four vertices."""
    f = MEASURES[name]

    def run(rings: pa.Array) -> pa.Array:
        flat, counts = _flat(rings)
        out = [batches.numbers(flat[v], counts[w], f, **how) for w, v in _parts(counts)]
        return pa.array(np.concatenate([*out, np.zeros(0)]), mask=counts < 4)

    run.__annotations__ = {"rings": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def surfacic_distance() -> Callable[[Column, Column], Column]:
    """1 - intersection / union of two ring columns; null where either is null or has under four vertices."""

    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        a, n_a = _flat(p)
        b, n_b = _flat(q)
        return pa.array(surfacic_distances(a, n_a, b, n_b), mask=(n_a < 4) | (n_b < 4))

    run.__annotations__ = {"p": pa.Array, "q": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def bend_measures() -> Callable[[Column], Column]:
    """The bends of a line column, as an array of structs."""
    names = ("first", "width", "height", "length", "symmetry", "shape", "size")

    def run(lines: pa.Array) -> pa.Array:
        flat, counts = _flat(lines)
        n, columns = batches.bend_measures(flat, counts)
        fields = [pa.field(k, pa.float64() if i else pa.int32()) for i, k in enumerate(names)]
        return _lists(n, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields))

    run.__annotations__ = {"lines": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<first:int,width:double,height:double,length:double,symmetry:double,shape:double,size:double>>")


def register_all(spark: SparkSession) -> None:
    """Register every kernel that needs no parameter, and those with one number, as SQL functions."""
    for name in MEASURES:
        spark.udf.register(name, measure(name))
    spark.udf.register("surfacic_distance", surfacic_distance())
    spark.udf.register("bend_measures", bend_measures())
    defaults = {
        "simplify_douglas_peucker": "threshold", "simplify_visvalingam_whyatt": "threshold", "simplify_li_openshaw": "cell", "simplify_lang": "tolerance",
        "simplify_reumann_witkam": "tolerance", "simplify_whirlpool": "threshold", "simplify_wang_muller": "tolerance", "resample_line": "step", "enlarge_polygon": "goal", "accordion": "width",
    }
    for name, f in LINE_FUNCTIONS.items():
        if name in defaults:
            spark.udf.register(name, F.arrow_udf(_bound(f, defaults[name]), LINE_DDL))
        elif name != "simplify_raposo":
            spark.udf.register(name, line_function(name))


def _bound(f: Callable, arg: str) -> Callable:
    def run(lines: pa.Array, value: pa.Array) -> pa.Array:
        values = value.to_numpy(zero_copy_only=False).astype(float)

        def one(flat: np.ndarray, counts: np.ndarray, part: slice) -> batches.Ragged:
            """Lines of one value go together; those that get no vertices from any are short."""
            own, at, done = values[part], batches.starts(counts)[:-1], []
            for v in np.unique(own[counts > 1]):
                w = np.flatnonzero((counts > 1) & ((own == v) | (np.isnan(own) & np.isnan(v))))
                done.append((w, *batches.apply(flat[batches.places(at[w], counts[w])], counts[w], f, **{arg: float(v)})))
            w = np.flatnonzero(counts < 2)
            done.append((w, flat[batches.places(at[w], counts[w])], counts[w]))
            return batches.merged(len(counts), done)

        return _lines(lines, one)

    run.__annotations__ = {"lines": pa.Array, "value": pa.Array, "return": pa.Array}
    return run
