"""Token-ID / binary output: static range ANS files of token ids, with checkpoints and checksums.

One record is one block: ids of whole documents, in ascending ``doc_id`` order.  Blocks of a record group share a
frequency table (20-bit, of the group's own ids); a block is cut into segments of interleaved lanes.  A segment's final
lane states are a checkpoint: decoding can begin at any of them, and any block can be decoded alone.

Block layout, little-endian: magic ``RANS2``, then u32 n_docs, n_null, n_ids, n_segments, crc32 of the ids; then per
document i64 doc_id (no id for the first n_null, written as 0) and u32 n_ids; then per segment u32 n_ids, n_words, crc32 of its ids, its lane states (u64 each) and its
words (u32 each).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrazzo.plans.durable import materialize, shared_dir

from .common import U64, chunks, same_spans, small_batches, span_hashes, text_bytes, tidy

MAGIC = b"RANS2"
BITS = 20
LANES = 1024
SEGMENT = 1 << 17
BLOCK = 1 << 19
GROUP = 1 << 21
_LOW = U64(1 << 31)


# --- range ANS -------------------------------------------------------------------------------------------------


def quantize(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies summing to ``2**bits``, at least 1 for every id that occurs."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if total == 0:
        out[0] = 1 << bits
        return out
    used = counts > 0
    if int(used.sum()) > 1 << bits:
        raise ValueError("more ids than the table has slots")
    out[used] = np.maximum(1, counts[used] * (1 << bits) // total)
    gap = (1 << bits) - int(out.sum())
    order = np.argsort(-out, kind="stable")
    if gap > 0:
        out[order[0]] += gap
    while gap < 0:
        room = np.minimum(out[order] - 1, -gap)
        take = np.minimum(room, np.maximum(0, -gap - (np.cumsum(room) - room)))
        out[order] -= take
        gap += int(take.sum())
    return out


def encode_segment(ids: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(states, words)``; words are in the order decoding reads them."""
    x = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    f_all, c_all = freq[ids].astype(np.uint64), start[ids].astype(np.uint64)
    rows = -(-len(ids) // LANES)
    for r in range(rows - 1, -1, -1):
        f, c = f_all[r * LANES : (r + 1) * LANES], c_all[r * LANES : (r + 1) * LANES]
        s = x[: len(f)]
        full = s >= f << U64(63 - BITS)
        if full.any():
            words.append(s[full].astype(np.uint32))
            s[full] >>= U64(32)
        q, rest = np.divmod(s, f)
        s[:] = (q << U64(BITS)) + rest + c
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_segment(n: int, states: np.ndarray, words: np.ndarray, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ids of :func:`encode_segment`."""
    x, out, at = states.copy(), np.empty(n, np.int32), 0
    mask = U64((1 << BITS) - 1)
    for lo in range(0, n, LANES):
        s = x[: min(LANES, n - lo)]
        slot = s & mask
        ids = symbol[slot]
        out[lo : lo + len(s)] = ids
        s[:] = freq[ids] * (s >> U64(BITS)) + slot - start[ids]
        low = s < _LOW
        k = int(np.count_nonzero(low))
        if k:
            s[low] = (s[low] << U64(32)) | words[at : at + k]
            at += k
    return out


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def pack_table(freq: np.ndarray) -> bytes:
    used = np.flatnonzero(freq)
    gaps = np.diff(used, prepend=-1).astype("<u4")
    return zlib.compress(struct.pack("<I", len(used)) + gaps.tobytes() + freq[used].astype("<u4").tobytes(), 6)


def unpack_table(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    (k,) = struct.unpack_from("<I", raw)
    used = np.cumsum(np.frombuffer(raw, "<u4", k, 4).astype(np.int64)) - 1
    out = np.zeros(int(used[-1]) + 1, np.int64)
    out[used] = np.frombuffer(raw, "<u4", k, 4 + 4 * k)
    return out


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, freq: np.ndarray, start: np.ndarray, n_null: int = 0) -> bytes:
    cuts = range(0, len(ids), SEGMENT)
    out = [MAGIC, struct.pack("<5I", len(doc_ids), n_null, len(ids), len(cuts), zlib.crc32(ids.astype("<u4").tobytes()))]
    out += [doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    for lo in cuts:
        part = ids[lo : lo + SEGMENT]
        states, words = encode_segment(part, freq, start)
        out += [struct.pack("<3I", len(part), len(words), zlib.crc32(part.astype("<u4").tobytes()))]
        out += [states.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    return b"".join(out)


def decode_block(data: bytes, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(doc_ids, lengths, ids, n_null)``; raises ValueError when a checksum doesn't hold."""
    if data[:5] != MAGIC:
        raise ValueError("not a block")
    n_docs, n_null, n_ids, n_seg, crc = struct.unpack_from("<5I", data, 5)
    at = 25
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    parts = [np.zeros(0, np.int32)]
    for _ in range(n_seg):
        n, n_words, seg_crc = struct.unpack_from("<3I", data, at)
        states = np.frombuffer(data, "<u8", LANES, at + 12)
        words = np.frombuffer(data, "<u4", n_words, at + 12 + 8 * LANES)
        at += 12 + 8 * LANES + 4 * n_words
        part = decode_segment(n, states, words, *tables)
        if zlib.crc32(part.astype("<u4").tobytes()) != seg_crc:
            raise ValueError("segment checksum")
        parts.append(part)
    ids = np.concatenate(parts)
    if len(ids) != n_ids or zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("block checksum")
    return doc_ids, lengths, ids, n_null


# --- tokenizing ------------------------------------------------------------------------------------------------

#: The byte-level alphabet of this vocabulary (printable bytes stand for themselves, others follow 255).
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in set(_PLAIN)]
_ALPHABET = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(_OTHERS)}
#: White space in Unicode beyond ASCII begins and ends with these bytes in UTF-8.
_BLANK = [*range(9, 14), *range(28, 33)]
_BLANK_START = [*_BLANK, 0xC2, 0xE1, 0xE2, 0xE3]
_BLANK_END = [*_BLANK, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]


def _set(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


_STARTS, _ENDS = _set(_BLANK_START), _set(_BLANK_END)
_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_CODES = np.array([_ALPHABET[b] for b in range(256)], "<u4")


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Which bytes surely belong to a letter (of ASCII or the Latin-1 block), an ASCII digit or an ASCII mark; others are 0."""
    out = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    lead = lead[(after >> 6 == 2) & (after != 0x97) & (after != 0xB7)]  # without the signs for times and divided by
    out[lead] = out[lead + 1] = _LETTER
    return out


class Encoder:
    """Encodes texts with any file of the tokenizers library, without special tokens of its own.

    Byte-level BPE with the library's own pattern cuts before every single space, around a line feed between other
    characters, and between a letter or digit and a mark after it, so there a text is cut into pieces; each new piece
    goes through the library's model, and pieces are remembered by their bytes.  A piece of letters, of digits or of
    marks alone is one word of the pattern, others are split by it.  Texts in which a cut could matter (runs of white space around a space, added tokens), and all texts of
    other kinds of tokenizer, are encoded whole.
    """

    #: Pieces remembered: some 45 bytes each; and words of new pieces, some 240 bytes each.
    REMEMBER, WORDS = 300_000, 40_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = self._cuts_at_spaces(path)
        self.cut = self._pattern()
        self.alphabet = "".join(chr(_ALPHABET[b]) for b in range(256))
        self.words: dict[str, list[int]] = {}
        self._forget()

    def _cuts_at_spaces(self, path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        how = spec.get("pre_tokenizer") or {}
        plain = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space")
        return bool(plain and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer")) and all(t[:1] == b"<" for t in self.added)

    @staticmethod
    def _pattern():
        import public_tokenizers
        import regex

        return regex.compile(public_tokenizers.PATTERN)

    def _forget(self) -> None:
        """Nothing is known: ``h`` (sorted) are hashes, ``a`` to ``b`` a piece's place in ``pool``, ``place`` and ``size`` its ids."""
        self.h, self.a, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.b, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.ids, self.used = np.zeros(0, np.uint8), np.zeros(1 << 16, np.uint32), 0

    def _word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > self.WORDS:
                self.words.clear()
            found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]
            self.words[word] = found
        return found

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        """Encode new pieces, in order of their hashes, and merge them into what is known."""
        body = np.frombuffer(b"".join(pieces), np.uint8)
        b = np.cumsum([len(p) for p in pieces])
        a = np.append(0, b[:-1])
        kind, tokenize, found = _kinds(body), self.model.tokenize, []
        change = np.zeros(len(body), np.int64)
        change[1:] = np.cumsum(kind[1:] != kind[:-1])
        first = np.minimum(a + (body[a] == 32), b - 1)
        one = (kind[first] > 0) & (change[first] == change[b - 1])
        text = _CODES[body].tobytes().decode("utf-32-le")
        for p, i, j, is_one in zip(pieces, a.tolist(), b.tolist(), one.tolist(), strict=True):
            found.append([t.id for t in tokenize(text[i:j])] if is_one else [x for w in self.cut.findall(p.decode()) for x in self._word(w)])
        size = np.fromiter(map(len, found), np.int32, len(found))
        n = int(size.sum())
        while self.used + n > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + n] = np.fromiter(chain.from_iterable(found), np.uint32, n)
        place = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += n
        a, b = a + len(self.pool), b + len(self.pool)
        self.pool = np.concatenate([self.pool, body])
        at = np.searchsorted(self.h, h)
        self.h, self.a, self.b = np.insert(self.h, at, h), np.insert(self.a, at, a), np.insert(self.b, at, b)
        self.place, self.size = np.insert(self.place, at, place), np.insert(self.size, at, size)

    def _look_up(self, raw: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where distinct pieces ``raw[s:e]`` with sorted hashes are known, and which are another piece of that hash."""
        for _ in range(2):
            at = np.searchsorted(self.h, h)
            ok = at < len(self.h)
            ok[ok] = self.h[at[ok]] == h[ok]
            if ok.all():
                break
            if len(self.h) + int((~ok).sum()) > self.REMEMBER and len(self.h):
                self._forget()
                ok[:] = False
            body = raw.tobytes()
            self._learn(h[~ok], [body[i:j] for i, j in zip(s[~ok].tolist(), e[~ok].tolist(), strict=True)])
        both, n = np.concatenate([self.pool, raw]), len(self.pool)
        return at, ~same_spans(both, self.a[at], self.b[at], s + n, e + n)

    def _whole(self, raw: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Texts that must not be cut: those with a place in ``odd`` or a special token's beginning."""
        whole = np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            head = np.frombuffer(token[:2], np.uint8)
            at = raw[: len(raw) - len(head) + 1] == head[0]
            for k in range(1, len(head)):
                at = at & (raw[k : len(raw) - len(head) + 1 + k] == head[k])
            odd[: len(at)] |= at
        if odd.any():
            whole[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        return whole

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of the texts ``raw[offsets[i]:offsets[i+1]]``."""
        n, rows = len(raw), len(offsets) - 1
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        if not self.cuts:
            return self._by_text(raw, offsets, np.ones(rows, bool), np.zeros(0, np.int64), np.zeros(rows, np.int64))
        space = raw == 32
        full = offsets[1:] > offsets[:-1]
        begin, finish = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        begin[offsets[:-1][full]] = True
        finish[offsets[1:][full]] = True
        before = np.zeros(n, bool)
        before[1:] = _ENDS[raw[:-1]]
        after = np.ones(n, bool)
        after[:-1] = _STARTS[raw[1:]]
        whole = self._whole(raw, offsets, space & before & ~begin[:n] & (after | finish[1:]))
        kind = _kinds(raw)
        cut = space | begin[:n]
        cut[1:] |= (kind[1:] == _MARK) & ((kind[:-1] == _LETTER) | (kind[:-1] == _DIGIT))
        feed = np.flatnonzero((raw == 10) & ~before & ~after & ~begin[:n] & ~finish[1:])
        cut[feed] = cut[feed + 1] = True
        s = np.flatnonzero(cut)
        row = np.searchsorted(offsets, s, "right") - 1
        e = np.append(s[1:], n)
        plain = ~whole[row]
        s, e, row = s[plain], e[plain], row[plain]
        while True:
            h, first, back = np.unique(span_hashes(raw, s, e), return_index=True, return_inverse=True)
            at, other = self._look_up(raw, h, s[first], e[first])
            differ = other[back] | ~same_spans(raw, s, e, s[first][back], e[first][back])
            if not differ.any():
                break
            whole[row[differ]] = True  # different pieces with one hash: their texts aren't cut
            plain = ~whole[row]
            s, e, row = s[plain], e[plain], row[plain]
        which = at[back]
        size = self.size[which].astype(np.int64)
        counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        ends = np.cumsum(size)
        pick = np.arange(int(size.sum())) + np.repeat(self.place[which] - (ends - size), size)
        return self._by_text(raw, offsets, whole, self.ids[pick].astype(np.int64), counts)

    def _by_text(self, raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` with the texts marked in ``whole`` put through the library."""
        if not whole.any():
            return ids, counts
        w = np.flatnonzero(whole)
        # one at a time: the library's own result of a text takes some 200 bytes an id
        coded = [np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int64) for i in w]
        split = np.split(ids, np.cumsum(counts)[:-1])
        for i, c in zip(w, coded, strict=True):
            split[i], counts[i] = c, len(c)
        return np.concatenate(split), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, kept between tasks."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- files -----------------------------------------------------------------------------------------------------

_FILE = T.StructType([
    T.StructField("group", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("first_doc", T.LongType()), T.StructField("last_doc", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("freqs", T.BinaryType()), T.StructField("data", T.BinaryType()),
])


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, group = encoder(path), TaskContext.get().partitionId(), 0
        docs, lens, ids, none, held = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, lens, ids, none, held, group
            d, n, x, null = np.concatenate(docs), np.concatenate(lens), np.concatenate(ids), np.concatenate(none)
            freq = quantize(np.bincount(x))
            f, start, _ = _tables(freq)
            table, ends = pack_table(freq), np.cumsum(n)
            lo, at, k = 0, 0, 0
            while lo < len(d):
                hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
                to = int(ends[hi - 1])
                data = encode_block(d[lo:hi], n[lo:hi], x[at:to], f, start, int(null[lo:hi].sum()))
                ends_of = [None if null[j] else int(d[j]) for j in (lo, hi - 1)]
                row = [(part << 32) + group, k, *ends_of, hi - lo, to - at, table, data]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], _FILE.fieldNames())
                lo, at, k = hi, to, k + 1
            docs, lens, ids, none, held, group = [], [], [], [], 0, group + 1

        for b in batches:
            raw, offs = text_bytes(b.column(1))
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offs, 1 << 19):
                got, count = enc.encode(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                with_end = np.insert(got, np.cumsum(count), end_id)
                docs.append(doc[lo:hi].astype(np.int64))
                none.append(null[lo:hi])
                lens.append(count + 1)
                ids.append(with_end.astype(np.int32))
                held += len(with_end)
                if held >= GROUP:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _in_order(docs: DataFrame) -> bool:
    """Whether the scan's partitions hold ascending, disjoint runs of ``doc_id`` (so that no shuffle is needed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, ok = None, None, True
        for b in batches:
            x = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(x):
                ok = ok and not b.column(0).null_count and bool((np.diff(x) > 0).all()) and (hi is None or x[0] > hi)
                lo, hi = (int(x[0]) if lo is None else lo), int(x[-1])
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([hi]), pa.array([ok])], ["lo", "hi", "ok"])

    runs = docs.select("doc_id").mapInArrow(run, "lo long, hi long, ok boolean").orderBy("lo").collect()  # a row a task
    return all(r.ok for r in runs) and all(a.hi < b.lo for a, b in zip(runs, runs[1:], strict=False))


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encode every document and write the blocks, in ascending ``doc_id`` order; returns the folder.

    Null text is empty; an empty document is the end id alone.  Rows without a ``doc_id`` come first, in order of a
    hash of their text; so do rows that repeat a ``doc_id``, side by side.  Extra columns are ignored; an empty table gives a folder without blocks.  A
    very long text is a block of its own, in several segments.

    Where the table's own splits already ascend, blocks are written from them; else documents are range-partitioned.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not _in_order(narrow):
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # the hash deals out rows of one id, and rows without any
        narrow = narrow.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/terrazzo/tokens-{uuid.uuid4().hex}"
    narrow.mapInArrow(tidy(_writer(tokenizer_path, end_id)), _FILE).write.option("compression", "uncompressed").parquet(path)
    return path


_READ = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, tables = None, None
    for b in batches:
        for table, data, base in zip(b.column("freqs"), b.column("data"), b.column("base"), strict=True):
            if (t := table.as_py()) != known:
                known, tables = t, _tables(unpack_table(t))
            doc, n, ids, n_null = decode_block(data.as_py(), tables)
            ends = np.cumsum(n.astype(np.int64))
            body = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(body[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, mask=np.arange(len(doc)) < n_null), pa.array(ends - n + base.as_py()), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], _READ.fieldNames())


def read_ids(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files at ``path``.

    ``start`` comes from the blocks' headers: groups are summed first, then blocks within their group, so that no
    task sees all blocks.
    """
    from pyspark.sql import Window as W

    small_batches(spark, 16)
    files = spark.read.schema(_FILE).parquet(path)
    heads = files.select("group", "block", "first_doc", "n_ids")
    groups = heads.groupBy("group").agg(F.min("first_doc").alias("first"), F.sum("n_ids").alias("n"))
    # a row a group of up to GROUP ids: at 100 TB some twelve million small rows in the one task of this window
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("first", "group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = heads.withColumn("inner", inner).join(groups, "group").select("group", "block", (F.col("inner") + F.col("before")).alias("base"))
    base = materialize(base, "starts")
    joined = files.select("group", "block", "freqs", "data").join(F.broadcast(base) if base.count() <= 100_000 else base, ["group", "block"])
    return joined.select("freqs", "data", "base").mapInArrow(tidy(_reader), _READ)
