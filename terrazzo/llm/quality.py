"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Both are logistic regressions, first fitted on a bounded sample of labelled rows.  In each round both views score every
unlabelled document of the corpus; the texts that one view is surest of become labelled rows of the other.  The views
are then calibrated on held-out labels, combined, and every document is scored in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.plans.durable import discard, materialize

from .common import chunks, small_batches, text_bytes, tidy

TRIGRAMS = 2048
#: Of the text view: hashed trigrams, then shares of eight kinds of characters, line and word sizes.
TEXT_DIM = TRIGRAMS + 10
#: Of the metadata view: 64 for source, 16 for language, 24 for length.
META_DIM = 64 + 16 + 24
#: Bytes of a long text that are counted at once.
STRETCH = 1 << 18

_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1  # upper case
_KIND[97:123] = 2  # lower case
_KIND[48:58] = 3  # digits
_KIND[[32, 9]] = 4  # blanks
_KIND[10] = 5  # line ends
_KIND[[33, 35, 36, 37, 38, 42, 64, 94, 124, 126]] = 6  # marks
_KIND[[44, 46, 58, 59, 63]] = 7  # punctuation


def _counts(part: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams and of character kinds of successive texts."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * 8 + _KIND[part], minlength=n * 8).reshape(n, 8)
    if len(part) < 3:
        return np.zeros((n, TRIGRAMS)), kinds
    b = part.astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    same = row[:-2] == row[2:]
    at = row[:-2][same] * TRIGRAMS + (h[same] >> np.uint32(21)).astype(np.int64)
    return np.bincount(at, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS), kinds


def text_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, and the layout: character kinds, line and word sizes.

    A long text is counted a stretch at a time, so memory doesn't follow its length.
    """
    rows = len(offsets) - 1
    out = np.zeros((rows, TEXT_DIM), np.float32)
    for lo, hi in chunks(offsets, STRETCH):
        sizes = np.diff(offsets[lo : hi + 1])
        first, last = int(offsets[lo]), int(offsets[hi])
        if last - first <= STRETCH:
            grams, kinds = _counts(raw[first:last], sizes)
        else:
            grams, kinds = np.zeros((1, TRIGRAMS)), np.zeros((1, 8), np.int64)
            for at in range(first, last, STRETCH):
                end = min(at + STRETCH, last)
                grams += _counts(raw[at : min(end + 2, last)], np.array([min(end + 2, last) - at]))[0]
                kinds += np.bincount(_KIND[raw[at:end]], minlength=8)
        out[lo:hi, :TRIGRAMS] = np.sqrt(grams / np.maximum(1, grams.sum(1, keepdims=True)))
        n = np.maximum(1, sizes)
        out[lo:hi, TRIGRAMS : TRIGRAMS + 8] = np.sqrt(kinds / n[:, None]) * 3
        out[lo:hi, TRIGRAMS + 8] = np.log1p(n / (1 + kinds[:, 5])) / 3
        out[lo:hi, TRIGRAMS + 9] = np.log1p(n / (1 + kinds[:, 4] + kinds[:, 5]))
    return out


def _bucket(values: list, size: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(str(v).encode()) % size if v is not None else 0 for v in values], np.int64)


def meta_view(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    """Source, language and length as indicators: nothing of the text itself."""
    out = np.zeros((len(size), META_DIM), np.float32)
    at = np.arange(len(size))
    out[at, _bucket(source, 64)] = 1
    out[at, 64 + _bucket(lang, 16)] = 1
    out[at, 80 + np.minimum(23, np.log2(np.maximum(1, size))).astype(np.int64)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 150, rate: float = 4.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient descent; deterministic."""
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    v = w.copy()
    for t in range(steps):
        g = _sigmoid(x @ v[:-1].astype(np.float32) + v[-1]) - y
        step = np.append(x.T @ (g / len(y)).astype(np.float32) + ridge * v[:-1], g.mean())
        new = v - rate * step / max(1.0, float((x[:64] ** 2).sum(1).mean()) / 4)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _line(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-regularised logistic fit of ``y`` on the columns of ``z`` by Newton's method."""
    x = np.column_stack([z, np.ones(len(z))])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (p - target) + 1e-2 * w)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class QualityModel:
    """Weights of both views, their calibrations ``(slope, bias)`` and the combination of calibrated log-odds."""

    text: np.ndarray
    meta: np.ndarray
    text_cal: np.ndarray
    meta_cal: np.ndarray
    both: np.ndarray

    def score(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, the metadata view and the combination."""
        t = (xt @ self.text[:-1].astype(np.float32) + self.text[-1]) * self.text_cal[0] + self.text_cal[1]
        m = (xm @ self.meta[:-1].astype(np.float32) + self.meta[-1]) * self.meta_cal[0] + self.meta_cal[1]
        return _sigmoid(t), _sigmoid(m), _sigmoid(np.column_stack([t, m]) @ self.both[:-1] + self.both[-1])


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = text_bytes(batch.column("text"))
    return text_view(raw, offs), meta_view(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), np.diff(offs))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        views = (pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()) for x in _views(b))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *views], ["doc_id", "h", "xt", "xm"])


def _features(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc_ids, text view, metadata view)`` of the chosen ids (a bounded table), in order of id.

    Of rows that repeat an id, the one with the smallest hash of its text counts.
    """
    rows = docs.join(F.broadcast(chosen), "doc_id").mapInArrow(tidy(_featurize), "doc_id long, h long, xt binary, xm binary")
    got = rows.groupBy("doc_id").agg(F.min(F.struct("h", "xt", "xm")).alias("x")).select("doc_id", "x.xt", "x.xm").toArrow().sort_by("doc_id")
    out = []
    for name, dim in (("xt", TEXT_DIM), ("xm", META_DIM)):
        x = np.zeros((len(got), dim), np.float32)
        for i, v in enumerate(got.column(name)):
            x[i] = np.frombuffer(v.as_buffer(), np.float16)
        out.append(x)
    return got.column("doc_id").to_numpy(), *out


def _opinions(docs: DataFrame, wt: np.ndarray, wm: np.ndarray) -> DataFrame:
    """``(h, doc_id, t, m)``: what either view thinks of each different text, under its smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xt, xm = _views(b)
            cols = [pa.array(_sigmoid(_raw(x, w)).astype(np.float64)) for x, w in ((xt, wt), (xm, wm))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("doc_id"), *cols], ["h", "doc_id", "t", "m"])

    seen = docs.mapInArrow(tidy(run), "h long, doc_id long, t double, m double")
    return seen.groupBy("h").agg(F.min(F.struct("doc_id", "t", "m")).alias("x")).select("h", "x.*")


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, rounds: int = 3, grow: int = 200, sure: float = 0.95, label: str = "quality"
) -> QualityModel | None:
    """Co-training on at most ``max_labelled`` labelled documents and all unlabelled ones.

    The labelled sample is the smallest hashes of ``doc_id``, so it doesn't depend on how the tables are laid out; every
    fifth of it, in order of id, is held out to calibrate.  In a round each view gives the other the ``grow`` texts of
    either class that it is surest of, where surer than ``sure``, out of the whole corpus; ties go to the smaller hash.

    Rows with a null id, label or text, and labels without a document, are left out; of repeated labels the larger
    counts, repeated documents count once, and equal texts are one text.  None when the labels aren't of two classes.

    The driver holds features of the labelled sample and of ``4 * grow * rounds`` texts; each round is two passes.
    """
    small_batches(docs.sparkSession)
    clean = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.xxhash64("text").alias("h"))
    marked = labels.where(f"doc_id is not null and {label} is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    marked = materialize(marked, "labels")
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled)
    y_of = {r.doc_id: min(1.0, max(0.0, r.y)) for r in chosen.collect()}  # at most max_labelled rows
    ids, xt, xm = _features(clean, chosen.select("doc_id").coalesce(1))
    y = np.array([y_of[i] for i in ids.tolist()])
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    taught = {"t": [xt[~held], y[~held]], "m": [xm[~held], y[~held]]}
    wt = wm = None
    used: list[int] = []
    for r in range(rounds + 1):
        wt = logistic(*taught["t"], start=wt, steps=150 if r == 0 else 60)
        wm = logistic(*taught["m"], start=wm, steps=300 if r == 0 else 100)
        if r == rounds:
            break
        free = materialize(_opinions(clean, wt, wm).join(marked, "doc_id", "left_anti"), "opinions")
        if used:
            free = free.where(~F.col("h").isin(used))
        picks = None
        for view, label_of, p in (("t", 1.0, F.col("t")), ("t", 0.0, 1 - F.col("t")), ("m", 1.0, F.col("m")), ("m", 0.0, 1 - F.col("m"))):
            best = free.select("doc_id", "h", F.lit(view).alias("view"), F.lit(label_of).alias("label"), p.alias("p")).where(F.col("p") >= sure)
            best = best.orderBy(F.desc("p"), "h").limit(grow)
            picks = best if picks is None else picks.union(best)
        found = picks.collect()  # at most 4 * grow rows
        discard(free)
        if not found:
            continue
        used += sorted({p.h for p in found})
        new, nt, nm = _features(clean, clean.sparkSession.createDataFrame([(i,) for i in sorted({p.doc_id for p in found})], "doc_id long").coalesce(1))
        at = {i: k for k, i in enumerate(new.tolist())}
        for mine, other, x in (("t", "m", nm), ("m", "t", nt)):
            rows = [(at[p.doc_id], p.label) for p in sorted(found, key=lambda p: (-p.label, -p.p, p.h)) if p.view == mine]
            taught[other][0] = np.concatenate([taught[other][0], x[[k for k, _ in rows]]])
            taught[other][1] = np.concatenate([taught[other][1], [v for _, v in rows]])
    discard(marked)
    zt, zm = _raw(xt[held], wt), _raw(xm[held], wm)
    ct, cm = _line(zt[:, None], y[held]), _line(zm[:, None], y[held])
    both = _line(np.column_stack([zt * ct[0] + ct[1], zm * cm[0] + cm[1]]), y[held])
    return QualityModel(wt, wm, ct, cm, both)


_SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("p_text", T.DoubleType()), T.StructField("p_meta", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def _scores(batch: pa.RecordBatch, model: QualityModel | None) -> tuple[np.ndarray, ...]:
    """Probabilities of the text view, the metadata view and both; 0 for blank text, 1 for other text without a model."""
    text = batch.column("text")
    solid = (pc.utf8_length(pc.utf8_trim_whitespace(text)).fill_null(0).to_numpy(zero_copy_only=False)) > 0
    p = model.score(*_views(batch)) if model else (np.ones(len(text)),) * 3
    return tuple(np.where(solid, x, 0.0).astype(np.float64) for x in p)


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """``(doc_id, p_text, p_meta, score)`` of every row; ``score`` is the probability of good quality.

    Null, empty or blank text scores 0.  Null source or language are values of their own.  Repeated rows are scored
    each; extra columns are ignored.  Without a model (labels of one class only) texts score 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, _scores(b, model))], _SCORES.fieldNames())

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").mapInArrow(tidy(run), _SCORES)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """``docs`` (all columns) without the rows whose score is under ``threshold``; one pass."""
    model = fit_quality(docs, labels, **fit)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b, model)[2] >= threshold)).select(names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidy(run), schema)
