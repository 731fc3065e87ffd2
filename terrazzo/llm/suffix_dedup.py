"""Suffix-array dedup: remove bytes covered by a long string that starts more than once in the corpus.

Suffixes are sampled at anchors.  A window of ``length`` bytes has one anchor, the leftmost of its ``GRAM``-byte grams
with the least hash, so equal windows have equal anchors at equal places, and only suffixes that begin with the same
gram need comparing:

1. Every anchor is a row (hash of its gram, 128-bit hash of all bytes its windows cover).  Grams that occur once go.
2. Anchors whose whole stretch occurs again repeat as a whole: no bytes need to move.
3. Of the others (edges of repeats), one of each different stretch is range-partitioned by its leading bytes with
   sampled splitters; buckets are sorted by multikey quicksort on 8-byte characters, and equal neighbours are repeats.
   Rows with equal leading bytes share a bucket, so no comparison crosses a boundary.
4. Leading bytes of more than ``HOT`` different stretches would make too large a bucket: their windows are dealt out
   and counted one by one, by 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.plans.durable import broadcast_if_small, discard, materialize

from .common import U64, chunks, mix, small_batches, span_hashes, text_bytes, tidy

GRAM = 48
_C = mix(np.arange(11, 17, dtype=np.uint64)) | U64(1)
_INDEX = U64((1 << 24) - 1)
#: Longest stretch of one text handled at once; a longer text is cut into stretches that overlap by a window.
STRETCH = 1 << 22
#: Different stretches of one gram that are compared in one bucket.
HOT = 50_000


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position."""
    u = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    x = u[:-8] * _C[0] + u[8:] * _C[1]
    x ^= x >> U64(29)
    x *= _C[2]
    y = x[:-32] * _C[3] + x[16:-16] * _C[4] + x[32:] * _C[5]
    return mix(y)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` successive keys (van Herk)."""
    n = len(keys)
    pad = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = keys
    blocks = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``(row, gram hash, two stretch hashes, first window, last window, anchor)``, places counted from ``raw``'s start."""
    n = len(raw)
    none = (np.zeros(0, np.int64),) * 7
    if n < length:
        return none
    end = np.repeat(offsets[1:], np.diff(offsets))
    windows = np.flatnonzero(np.arange(n - length + 1) + length <= end[: n - length + 1])
    if not len(windows):
        return none
    grams = _grams(raw)
    keys = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    at = (_window_min(keys, length - GRAM + 1)[windows] & _INDEX).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    s0, a = windows[new], at[new]
    s1 = windows[np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)]
    shape = ((s1 - s0) * 4096 + (a - s0)).astype(np.uint64) * _C[0]
    h1, h2 = (mix(span_hashes(raw, s0, s1 + length, seed) + shape) for seed in (1, 2))
    return np.searchsorted(offsets, s0, "right") - 1, grams[a], h1, h2, s0, s1, a


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, place of the piece in that row's text, bytes, offsets)``."""
    for lo, hi in chunks(offsets):
        if offsets[hi] - offsets[lo] <= STRETCH:
            yield lo, 0, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            continue
        for p in range(int(offsets[lo]), int(offsets[lo + 1]), STRETCH):
            part = raw[p : min(p + STRETCH + length - 1, offsets[lo + 1])]
            yield lo, p - int(offsets[lo]), part, np.array([0, len(part)])


def _sampler(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column(2))
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, moved, part, part_offs in _pieces(raw, offs, length):
                row, gram, whole, whole2, s0, s1, a = anchors(part, part_offs, length)
                place = ((s0 - part_offs[row] + moved) << 24) | ((s1 - s0) << 12) | (a - s0)
                cols = [gram.view(np.int64), whole.view(np.int64), whole2.view(np.int64), d[first + row], t[first + row], place]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["gram", "whole", "whole2", "d", "t", "place"])

    return run


def _cutter(length: int):
    """Cuts the stretches of the listed anchors out of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            rows = {k: [] for k in ("lead", "body", "d", "t", "place", "single")}
            for i, (d, t, marks) in enumerate(zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("edges").to_pylist(), strict=True)):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                for m in marks:
                    s0, span, off = m["place"] >> 24, (m["place"] >> 12) & 4095, m["place"] & 4095
                    for k, v in zip(rows, (text[s0 + off : s0 + off + GRAM], text[s0 : s0 + span + length], d, t, m["place"], m["single"]), strict=True):
                        rows[k].append(v)
            types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(rows.values(), types, strict=True)], list(rows))

    return run


def _windows(length: int):
    """Hashes of the single windows of the listed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            for i, (d, t, marks) in enumerate(zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("edges").to_pylist(), strict=True)):
                place = np.array([m["place"] for m in marks])
                s0, span = place >> 24, (place >> 12) & 4095
                at = np.repeat(s0, span + 1) + np.arange(int((span + 1).sum())) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
                single = np.repeat([m["single"] for m in marks], span + 1)
                part = raw[offs[i] : offs[i + 1]]
                h = [pa.array(span_hashes(part, at, at + length, seed).view(np.int64)) for seed in (3, 4)]
                yield pa.RecordBatch.from_arrays([*h, pa.array([d] * len(at), pa.int64()), pa.array([t] * len(at), pa.int64()), pa.array(at), pa.array(single)], ["h1", "h2", "d", "t", "lo", "single"])

    return run


def multikey_equal(buffer: bytes, places: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings ``buffer[p:p+length]`` equal another of their group: three-way quicksort by 8-byte characters."""
    out = np.zeros(len(places), bool)
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    who, pos, group = np.arange(len(places)), places, groups
    for k in [*range(0, length - 7, 8), length - 8]:
        w = words[pos + k].astype(np.uint64)
        order = np.lexsort((w, group))
        who, pos, group, w = who[order], pos[order], group[order], w[order]
        new = np.ones(len(w), bool)
        new[1:] = (group[1:] != group[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        who, pos, group = who[many], pos[many], group[many]
        if not len(who):
            return out
    out[who] = True
    return out


def _bucket(length: int, most_windows: int = 400_000):
    """Sorts a bucket's windows and yields the repeated ones of single stretches as byte ranges."""

    def solve(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        groups = np.cumsum([0, *(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False))])
        place = np.array([r[4] for r in rows])
        s0, span, off = place >> 24, (place >> 12) & 4095, place & 4095
        sizes = np.array([len(r[1]) for r in rows])
        base = np.cumsum(sizes) - sizes
        buffer = b"".join(r[1] for r in rows) + b"\0" * 8
        owner = np.repeat(np.arange(len(rows)), span + 1)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
        depth = off[owner] - step  # of the anchor in the window: only windows of equal depth can be equal
        hit = np.zeros(len(owner), bool)
        parts = max(1, -(-len(owner) // most_windows))
        for p in range(parts):  # a large group is taken a few depths at a time
            mine = np.flatnonzero(depth % parts == p) if parts > 1 else np.arange(len(owner))
            hit[mine] = multikey_equal(buffer, (base[owner] + step)[mine], groups[owner[mine]] * 4096 + depth[mine], length)
        single = np.array([r[5] for r in rows])
        hit &= single[owner]
        w = np.flatnonzero(hit)
        if not len(w):
            return
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1] + 1) | (owner[w[1:]] != owner[w[:-1]])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(w) - 1)
        for i, j in zip(w[new], w[last], strict=True):
            r = owner[i]
            yield rows[r][2], rows[r][3], int(s0[r] + step[i]), int(s0[r] + step[j] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["d", "t", "lo", "hi"])

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("lead", "body", "d", "t", "place", "single")), strict=True)
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield out(list(solve(held[:cut])))
                held = held[cut:]
        if held:
            yield out(list(solve(held)))

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted, possibly overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _assemble(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            n, removed, spans, digest, kept = [], [], [], [], []
            for i, marks in enumerate(b.column("marks").to_pylist()):
                text = raw[offs[i] : offs[i + 1]].tobytes()
                runs = merge_spans([(m["lo"], m["hi"]) for m in marks or []])
                at, rest = 0, []
                for lo, hi in runs:
                    rest.append(text[at:lo])
                    at = hi
                left = b"".join([*rest, text[at:]])
                n.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(len(runs))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep_text else None)
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup_substrings(docs: DataFrame, length: int = 200, keep_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` for every row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere (same text included, overlaps
    counting) is removed, as judged on the input; matches never cross texts.  ``kept`` is null unless asked for.

    Null text is empty.  Rows that repeat a ``doc_id`` are texts of their own, a null ``doc_id`` stays null.  Texts
    shorter than ``length`` keep all bytes.  Text of one repeated short pattern has an anchor a byte, so it costs some 40 bytes a byte.  Extra columns are ignored; an empty table gives no rows.

    Copies, however many, cost a row an anchor and meet only in counts, pre-aggregated per task.
    """
    if not GRAM + 8 <= length <= 4000:
        raise ValueError(f"length must be {GRAM + 8} to 4000")
    spark = docs.sparkSession
    small_batches(spark)
    # a row is known by its id and a hash of its text
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"),
    )
    every = rows.select("d", "t", "text").mapInArrow(tidy(_sampler(length)), "gram long, whole long, whole2 long, d long, t long, place long")
    one = F.struct("whole", "whole2")
    twice = every.groupBy("gram").agg(F.count("*").alias("n"), F.min(one).alias("w0"), F.max(one).alias("w1")).where("n > 1")
    # written, so that the join below can split the rows of a gram that very many texts share
    twice = materialize(twice.select("gram", (F.col("w0") != F.col("w1")).alias("mixed")), "grams")
    live = materialize(every.join(broadcast_if_small(twice, 300_000), "gram"), "anchors")
    counts = live.groupBy("gram", "whole", "whole2").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "place")).alias("rep"), F.first("mixed").alias("mixed"))
    counts = materialize(counts, "stretches")
    again = live.join(counts.where("n > 1").select("gram", "whole", "whole2"), ["gram", "whole", "whole2"], "left_semi")
    spans = again.select("d", "t", F.shiftright("place", 24).alias("lo"), F.expr(f"shiftright(place, 24) + (shiftright(place, 12) & 4095) + {length}").alias("hi"))
    hot = materialize(counts.where("mixed").groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("gram"), "hot")
    mixed = counts.where("mixed")
    edge = F.collect_list(F.struct("rep.place", (F.col("n") == 1).alias("single"))).alias("edges")
    some = hot.limit(1).count() > 0
    edges = (mixed.join(broadcast_if_small(hot), "gram", "left_anti") if some else mixed).groupBy("rep.d", "rep.t").agg(edge)
    edges = materialize(edges, "edges")
    stretches = rows.join(edges, ["d", "t"]).select("d", "t", "text", "edges").mapInArrow(
        _cutter(length), "lead binary, body binary, d long, t long, place long, single boolean"
    )
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = stretches.repartitionByRange(parts, "lead").sortWithinPartitions("lead").mapInArrow(tidy(_bucket(length)), "d long, t long, lo long, hi long")
    marks = spans.union(found)
    cuts = [twice, live, counts, hot, edges]
    if some:
        listed = mixed.join(broadcast_if_small(hot), "gram", "left_semi").groupBy("rep.d", "rep.t").agg(edge)
        windows = rows.join(listed, ["d", "t"]).select("d", "t", "text", "edges").mapInArrow(_windows(length), "h1 long, h2 long, d long, t long, lo long, single boolean")
        windows = materialize(windows, "windows")
        cuts.append(windows)
        repeated = materialize(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "repeated")
        cuts.append(repeated)
        hit = windows.where("single").join(repeated, ["h1", "h2"], "left_semi")
        marks = marks.union(hit.select("d", "t", "lo", (F.col("lo") + length).alias("hi")))
    marks = materialize(marks.groupBy("d", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")), "marks")
    for cut in cuts:
        discard(cut)
    done = rows.join(marks, ["d", "t"], "left").select("doc_id", "text", "marks")
    return done.mapInArrow(tidy(_assemble(keep_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
