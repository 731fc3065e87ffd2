"""Helpers shared by the corpus operators: reading tables, byte kernels and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Code units per numpy chunk; a longer text gets a chunk of its own.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, narrowed to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows and bytes per Arrow batch, so that a batch of whole texts or token sets fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def release() -> None:
    """Give memory that this worker no longer uses back to the system, where the system can take it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run`` over batches, after which the worker, which Spark keeps for other tasks, holds no unused memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay under ``limit`` bytes, or single longer rows."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Spans beyond this many bytes are hashed one by one.
LONG_SPAN = 1024


def words_of(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a little-endian number; bytes beyond the end are 0."""
    pad = np.zeros(len(raw) + 16, np.uint8)
    pad[: len(raw)] = raw
    return np.ndarray((len(raw) + 8,), "<u8", pad, strides=(1,))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``raw[start:end]``: 8 bytes at a time, each through a non-linear mix of all before it."""
    size = end - start
    out = mix(size.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64))
    words = words_of(raw)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    k = 0
    while len(live):
        w = words[start[live] + k]
        left = size[live] - k
        tail = left < 8
        w[tail] &= (U64(1) << (left[tail] * 8).astype(np.uint64)) - U64(1)
        out[live] = mix(out[live] ^ w)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        digest = hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def same_spans(raw: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether ``raw[a:a_end]`` and ``raw[b:b_end]`` hold the same bytes, 8 at a time."""
    size = a_end - a
    out = size == b_end - b
    words = words_of(raw)
    live = np.flatnonzero(out & (size > 0) & (size <= LONG_SPAN) & (a != b))
    k = 0
    while len(live):
        x = words[a[live] + k] ^ words[b[live] + k]
        left = size[live] - k
        tail = left < 8
        x[tail] &= (U64(1) << (left[tail] * 8).astype(np.uint64)) - U64(1)
        out[live[x != 0]] = False
        k += 8
        live = live[(x == 0) & (left > 8)]
    for i in np.flatnonzero(out & (size > LONG_SPAN) & (a != b)):
        out[i] = bool(np.array_equal(raw[a[i] : a_end[i]], raw[b[i] : b_end[i]]))
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes outside space and 0x09-0x0D, A-Z folded) of a chunk of texts.

    Returns ``(hash, row, start, end)`` of each word; ``row`` counts from the chunk's first text.  ``offsets`` are
    the texts' ends in ``raw``, from 0.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    h = span_hashes(_LOWER[raw], s, e + 1)
    row = np.searchsorted(offsets, s, "right") - 1
    return h, row, s, e + 1


def shingles(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles ``(row, hash)`` sorted by row, then hash; a shorter text is one shingle."""
    counts = np.bincount(row, minlength=rows)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - width + 1
    out_r, out_h = [], []
    if m > 0:
        ok = row[:m] == row[width - 1 :]
        at = np.flatnonzero(ok)
        g = np.full(len(at), width, np.uint64)
        for k in range(width):
            g = mix(g ^ h[at + k])
        out_r.append(row[at])
        out_h.append(g)
    start = np.concatenate([[0], np.cumsum(counts)])
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        w = h[start[r] : start[r + 1]]
        out_r.append(np.array([r]))
        g = np.full(1, len(w), np.uint64)
        for x in w:
            g = mix(g ^ x)
        out_h.append(g)
    r, g = np.concatenate(out_r), np.concatenate(out_h)
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[keep], g[keep]


_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_FOLD)


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
