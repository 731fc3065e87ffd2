"""Benchmark decontamination by greedy string tiling over words.

1. Seeds are hashes of ``least`` successive words.  A bitmap of the items' seeds, of bounded size, thins the documents'
   seeds out in one pass; what is left is joined with the items' seeds, which gives candidate pairs.
2. A pair stays if its shared seeds could cover enough of the item.
3. In each pair the longest match of unmarked words, found by running Karp-Rabin hashes of a falling search length and
   compared word by word, is marked again and again.  The share of the item's words under tiles decides, so that a
   passage in another order is caught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.plans.durable import broadcast_if_small, discard, materialize

from .common import U64, chunks, fold, mix, small_batches, text_bytes, word_hashes

#: Items of one document that are tiled in one row.
ITEMS_A_ROW = 64
#: Bits of the seeds' bitmap, at most: 16 MB are sent to each executor.
MOST_BITS = 1 << 27
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15


def running_hash(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of each ``width`` successive numbers."""
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    value, power, done = mix(ids.astype(np.uint64) + U64(1)), _BASE, 0
    # doubling: ``value[i]`` covers ``size`` numbers from i; the binary digits of ``width`` are put together
    size, rest = 1, width
    while rest:
        if rest & 1:
            part = value[done : done + len(out)]
            out = part.copy() if done == 0 else out * U64(power) + part
            done += size
        rest >>= 1
        if rest:
            value = value[:-size] * U64(power) + value[size:]
            power, size = power * power % 2**64, size * 2
    return out


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Places from which ``width`` numbers are unmarked."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(upto[width:] == upto[:-width]) if len(marked) >= width else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place in doc, place in item, length)`` of at least ``least`` numbers.

    Longest first; ties to the smaller place in the document, then in the item.  Marked numbers take part in no later
    tile.  The search length falls to the longest match that is left, found by halving.
    """
    out: list[tuple[int, int, int]] = []
    if least < 1 or len(doc) < least or len(item) < least:
        return out
    # only stretches that share a seed can hold a tile
    near = np.isin(running_hash(doc, least), running_hash(item, least))
    reach = np.zeros(len(doc) + 1, np.int64)
    np.add.at(reach, np.flatnonzero(near), 1)
    np.add.at(reach, np.flatnonzero(near) + least, -1)
    marked_d, marked_i = np.cumsum(reach[:-1]) == 0, np.zeros(len(item), bool)

    def meet(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free places of either side with their hashes, the document's thinned to those the item has."""
        i, d = _free(marked_i, width), _free(marked_d, width)
        hi, hd = running_hash(item, width)[i], running_hash(doc, width)[d]
        both = np.isin(hd, hi)
        return d[both], hd[both], i, hi

    most = min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most
        while low < high:
            half = (low + high + 1) // 2
            if len(meet(half)[0]):
                low = half
            else:
                high = half - 1
        if low < least:
            break
        d, hd, i, hi = meet(low)
        order = np.argsort(hi, kind="stable")
        first = np.searchsorted(hi[order], hd, "left")
        found = False
        for at, k in zip(d.tolist(), first.tolist(), strict=True):
            if marked_d[at : at + low].any():
                continue
            h = hi[order[k]]
            while k < len(order) and hi[order[k]] == h:
                j = int(i[order[k]])
                if not marked_i[j : j + low].any() and np.array_equal(doc[at : at + low], item[j : j + low]):
                    out.append((at, j, low))
                    marked_d[at : at + low] = marked_i[j : j + low] = True
                    found = True
                    break
                k += 1
            if marked_i.all():
                return out
        most = low if found else low - 1
    return out


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_covered", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("coverage", T.DoubleType()),
])


def _seeds(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, seed)`` of each run of ``width`` words of one text."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:m] == row[width - 1 :])
    g = np.full(len(at), width, np.uint64)
    for k in range(width):
        g = mix(g ^ h[at + k])
    return row[at], g


def _item_seeds(least: int):
    """``(i, n_words, width, seed)``: an item of fewer than ``least`` words is one seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            key = b.column("i").to_numpy(zero_copy_only=False)
            h, row, _, _ = word_hashes(raw, offs)
            n = np.bincount(row, minlength=len(key))
            for width in range(1, least + 1):
                mine = n == width if width < least else n >= least
                keep = mine[row]
                r, g = _seeds(h[keep], row[keep], width)
                yield pa.RecordBatch.from_arrays([pa.array(key[r], pa.int64()), pa.array(n[r]), pa.array(np.full(len(r), width)), pa.array(g.view(np.int64))], ["i", "n_words", "width", "seed"])

    return run


def _doc_seeds(widths: list[int], bits: np.ndarray):
    """``(d, seed)`` of the documents' seeds that the bitmap knows, each once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            key = b.column("d").to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offs):
                h, row, _, _ = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for width in widths:
                    r, g = _seeds(h, row, width)
                    at = g & U64(len(bits) * 64 - 1)
                    known = (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
                    pair = np.unique(np.stack([r[known].astype(np.uint64), g[known]], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo + pair[:, 0].astype(np.int64)], pa.int64()), pa.array(pair[:, 1].view(np.int64))], ["d", "seed"])

    return run


def _bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """Bits set at the seeds' low digits; its size follows their number up to ``MOST_BITS``."""
    size = 1 << 16
    while size < min(MOST_BITS, 64 * count):
        size *= 2
    place = F.col("seed").bitwiseAND(size - 1)
    words = seeds.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("b")).toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _tiler(least: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, items in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("items").to_pylist(), strict=True):
                number: dict[str, int] = {}
                code = lambda t: np.array([number.setdefault(w, len(number)) for w in _WORD.findall(fold(t))], np.int64)  # noqa: E731, B023
                doc = code(text.as_py())
                for x in items:
                    item = code(x["text"])
                    covered = sum(t[2] for t in tiles(doc, item, min(least, len(item))))
                    if den * covered >= num * len(item):
                        rows.append((doc_id, x["item_id"], covered, len(item), covered / len(item)))
            cols = list(zip(*rows, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], _OUT.fieldNames())

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 5,
    num: int = 80,
    den: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, n_covered, n_words, coverage)`` of every document and item where tiles of at least ``least``
    words cover ``num/den`` of the item's words.

    Words are runs outside space and 0x09-0x0D with A-Z folded.  An item of fewer than ``least`` words must occur as a
    whole, so an item of one word meets every document with that word.  Items without words match nothing; null texts
    have none.  Repeated documents or items are judged each; null ids stay null.  Extra columns are ignored; either
    table empty gives no rows.

    Documents are read once for their seeds; of their texts only those of candidates move.  The bitmap sent to the
    executors is bounded whatever the benchmark's size: when it fills up, more seeds go to the join.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    narrow = narrow.withColumn("d", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    items = items.withColumn("i", F.xxhash64("item_id", "text"))
    known = materialize(items.select("i", "text").mapInArrow(_item_seeds(least), "i long, n_words long, width long, seed long").distinct(), "seeds")
    widths = [r.width for r in known.select("width").distinct().collect()]  # at most ``least`` rows
    if not widths:
        return spark.createDataFrame([], _OUT)
    bits = _bitmap(known, known.count())
    met = narrow.select("d", "text").mapInArrow(_doc_seeds(sorted(widths), bits), "d long, seed long")
    pairs = met.join(broadcast_if_small(known, 500_000), "seed").groupBy("d", "i").agg(F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("width").alias("width"))
    # equal seeds at several places of an item count once here, so the bound takes them for as many as there could be
    most = known.groupBy("i").agg(F.count("*").alias("n_seeds"))
    pairs = pairs.join(broadcast_if_small(most, 500_000), "i")
    pairs = pairs.where(f"n_seeds < n_words - width + 1 or {den} * least(n_words, n * width) >= {num} * n_words").select("d", "i")
    pairs = materialize(pairs, "pairs")
    rows_of = pairs.groupBy("d").agg(F.ceil(F.count("*") / ITEMS_A_ROW).cast("long").alias("rows"))
    texts = items.groupBy("i", "item_id", "text").agg(F.count("*").alias("copies"))
    listed = pairs.join(broadcast_if_small(rows_of, 500_000), "d").join(texts, "i")
    listed = listed.withColumn("x", F.explode(F.array_repeat(F.struct("item_id", "text"), F.col("copies").cast("int"))))
    listed = listed.groupBy("d", F.pmod("i", "rows").alias("part")).agg(F.collect_list("x").alias("items"))
    listed = materialize(listed.drop("part"), "candidates")
    found = narrow.join(broadcast_if_small(listed, 20_000), "d").select("doc_id", "text", "items").mapInArrow(_tiler(least, num, den), _OUT)
    found = materialize(found, "found")
    for cut in (known, pairs, listed):
        discard(cut)
    return found
