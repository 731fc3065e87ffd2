"""N-gram Jaccard join by universe-partition pigeonhole, verified exactly.

Sets of similar size share a *scheme*: tokens are hashed into ``m`` segments.  Two sets that link differ in at most
``H`` tokens, so some segments are equal in both.  Each segment's subset is indexed as one key; a scheme may also give
``q`` segments their one-deletion neighbourhoods, which count double in the pigeonhole and so save segments.  The
split between the two is chosen per scheme by cost.

Allocation then goes on per set, by the keys' frequencies in the corpus (a sketch over all sets): the pigeonhole
promises a linked pair more common keys than one, and each set leaves out that surplus, its most frequent keys.  All
sets rank keys alike, so the rarest common key of a linked pair is left out by neither.  Passages that many texts share
therefore make no common keys, unless texts are made of little else.

Links come from pairs that meet at a key and are compared exactly:

1. Every set is compared with one set it shares the most keys with, of those that lead a key.
2. Where a key's sets are then still in different components, bitmaps tell which components may link: a forest of
   them, so that no key yields more rows than it has sets.  Sets of components so joined are compared exactly, all
   pairs across components that bitmaps leave open, in parts of two blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.plans.components import connected_components
from terrazzo.plans.durable import broadcast_if_small, discard, materialize

from .common import U64, chunks, mix, shingles, small_batches, text_bytes, tidy, word_hashes

#: Sets of one key compared at once; larger groups are split into pairs of blocks.
BLOCK = 1024
#: Sets of one key that a task holds to tell whether another key has the same.
LARGE = 1 << 20
#: Slots of the sketch of key frequencies.
SLOTS = 1 << 20
_K = mix(np.arange(21, 27, dtype=np.uint64)) | U64(1)


@dataclass(frozen=True)
class Scheme:
    """Segments ``m``, of which the first ``q`` have one-deletion neighbourhoods."""

    m: int
    q: int


def size_bands(num: int, den: int, largest: int) -> list[int]:
    """Lower ends of the size bands, growing by at least ``den/num``, so that links join equal or neighbouring bands."""
    ends, ratio = [1], max(1.5, den / num)
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, math.ceil(ends[-1] * ratio)))
    return ends


def matches(m, q, differ):
    """How many segments match at least when ``differ`` tokens do; a segment with deletions needs two to be apart."""
    return np.where(differ <= m - q, m - differ, (m + q - differ + 1) // 2)


def allocate(low: int, high: int, sets: int, num: int, den: int, common: float = 0.05, surplus: float = 0.25) -> Scheme:
    """The cheapest scheme for sets of ``low`` to ``high`` tokens, of which the corpus has ``sets``.

    Cost is index rows plus expected chance matches, where ``common`` is the chance that a token of one set is in an
    unrelated one.  Segments beyond the pigeonhole's need (a share ``surplus`` of it) let sets leave out keys.
    """
    h = high * (den - num) // num
    best = None
    for q in {0, *(round((h + 1) * f / 8) for f in range(1, 5))}:
        more = math.ceil(surplus * (h + 1))
        m = h + 1 + more if q == 0 else max(q, h + 2 + 2 * more - q)
        size = (low + high) / 2 / m
        cost = sets * ((m - q) + q * (1 + size)) + sets * float(sets) * m * common ** max(1.0, size - (1 if q else 0))
        if best is None or cost < best[0]:
            best = (cost, Scheme(m, q))
    return best[1]


def token_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, row of each token, token)`` by chunks; tokens are distinct and sorted within rows."""
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1] - offsets[lo]
        h, row, _, _ = word_hashes(raw[offsets[lo] : offsets[hi]], part)
        r, g = shingles(h, row, hi - lo, width)
        yield lo, hi - lo, r, g


def fingerprint(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sizes, 64-bit fingerprint)`` of the rows' sets."""
    n = np.bincount(row, minlength=rows)
    return n, mix(_sums(row, mix(token + _K[0]), rows) + n.astype(np.uint64) * _K[1])


def _sums(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Sums modulo 2**64 by group."""
    lo = np.bincount(group, weights=(value & U64(0xFFFFFFFF)).astype(np.float64), minlength=groups)
    hi = np.bincount(group, weights=(value >> U64(32)).astype(np.float64), minlength=groups)
    return lo.astype(np.uint64) + (hi.astype(np.uint64) << U64(32))


def signature(row: np.ndarray, token: np.ndarray, scheme_of: np.ndarray, schemes: list[Scheme], differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key)`` of every set whose ``scheme_of`` isn't -1, distinct and sorted, and how many keys each may leave out.

    ``differ`` is how many tokens a set may have apart from any set it links with.  A matching segment has no common
    key only if it is bare in both sets (empty, or of one token beside an empty one); a set with so many bare segments
    that no match is sure to have a key gets keys for them.
    """
    on = scheme_of >= 0
    m, q = (np.array([getattr(s, k) for s in schemes])[np.maximum(scheme_of, 0)] for k in ("m", "q"))
    m = np.where(on, m, 0)
    keep = on[row]
    row, token = row[keep], token[keep]
    base = np.cumsum(m) - m
    seg = (mix(token ^ _K[2]) % m[row].astype(np.uint64)).astype(np.int64)
    value = mix(token + _K[3])
    at = base[row] + seg
    total = int(m.sum())
    sums, size = _sums(at, value, total), np.bincount(at, minlength=total)
    owner = np.repeat(np.arange(len(m)), m)
    index = np.arange(total) - base[owner]
    double = index < q[owner]
    salt = mix(scheme_of[owner].astype(np.uint64) * _K[4] + index.astype(np.uint64))
    full = size > 0
    rows, keys = [owner[full]], [mix(sums[full] ^ salt[full])]
    less = double[at] & (size[at] > 1)
    rows.append(row[less])
    keys.append(mix((sums[at[less]] - value[less]) ^ salt[at[less]]))
    bare = (size == 0) | (double & (size <= 1))
    spare = matches(m, q, differ) - 1 - np.bincount(owner, weights=bare, minlength=len(m)).astype(np.int64)
    extra = bare & (spare < 0)[owner]
    rows.append(owner[extra])
    keys.append(mix(salt[extra] + _K[5]))
    r, k = np.concatenate(rows), np.concatenate(keys) >> U64(8)
    order = np.lexsort((k, r))
    r, k = r[order], k[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return r[new], k[new], np.maximum(spare, 0)


def leave_out(row: np.ndarray, key: np.ndarray, spare: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which keys stay when each row leaves out its ``spare`` most frequent ones; ties by key, alike in all sets."""
    order = np.lexsort((key, weight[(key % U64(len(weight))).astype(np.int64)], row))
    count = np.bincount(row, minlength=len(spare))
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row[order]]
    out = np.zeros(len(row), bool)
    out[order] = place < np.maximum(1, count - spare)[row[order]]
    return out


def bitmaps(row: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity of the tokens in each slot of a bitmap: a power of two bits, twice the set's size, from 64 to 32,768."""
    wide = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 64, 32768)
    base = np.cumsum(wide) - wide
    slot = base[row] + (token & (wide[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits(np.bincount(slot, minlength=int(wide.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [odd[b // 8 : (b + w) // 8] for b, w in zip(base.tolist(), wide.tolist(), strict=True)]


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            n, f, bits = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.uint64), []
            for lo, rows, r, g in token_sets(raw, offs, width):
                n[lo : lo + rows], f[lo : lo + rows] = fingerprint(r, g, rows)
                bits += bitmaps(r, g, n[lo : lo + rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(f.view(np.int64)), pa.array(bits, pa.binary())], ["doc_id", "n", "fp", "bits"])

    return run


#: Index rows of one block; its places in the dictionary of fingerprints are 16-bit numbers.
BLOCK_ROWS = 32_000
_BLOCK = "part int, keys array<bigint>, names array<bigint>, place array<smallint>"


def pack(part: int, key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, value)`` as blocks that Spark unpacks itself: keys, and values by place in a dictionary."""
    for lo in range(0, len(key), BLOCK_ROWS):
        names, place = np.unique(value[lo : lo + BLOCK_ROWS], return_inverse=True)
        columns = [(key[lo : lo + BLOCK_ROWS].view(np.int64), pa.int64()), (names, pa.int64()), (place.astype(np.int16), pa.int16())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in columns]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], ["part", "keys", "names", "place"])


def unpacked(blocks: DataFrame) -> DataFrame:
    """The rows ``(key, fp)`` of blocks made by :func:`pack`, without a Python worker."""
    return blocks.select(F.expr("inline(arrays_zip(keys, transform(place, p -> names[p])))").alias("key", "fp"))


def _signatures(batches: Iterator[pa.RecordBatch], width: int, bands: list[int], schemes: list[Scheme], num: int, den: int) -> Iterator[tuple]:
    """``(fingerprints, row, key, spare)`` of the sets in a task, each distinct one once while it is remembered."""
    low = np.array(bands)
    seen: set[int] = set()
    for batch in batches:
        raw, offs = text_bytes(batch.column(0))
        for _, rows, r, g in token_sets(raw, offs, width):
            n, f = fingerprint(r, g, rows)
            own = np.searchsorted(low, n, "right") - 1
            if len(seen) > 500_000:
                seen.clear()
            for i, x in enumerate(f.tolist()):
                if n[i] == 0 or x in seen:
                    own[i] = -1
                else:
                    seen.add(x)
            below = np.where((own > 0) & (den * (low[own] - 1) >= num * n), own - 1, -1)
            for scheme in (own, below):
                # the smaller of two linked sets has at most ``n * (den - num) / num`` tokens apart, the larger fewer
                most = (low[np.maximum(scheme, 0) + 1] - 1) * (den - num) // num
                yield f, *signature(r, g, scheme, schemes, np.minimum(most, n * (den - num) // num))


def _weigher(width: int, bands: list[int], schemes: list[Scheme], num: int, den: int):
    """Counts of the keys by slot, as blocks of ``(part, counts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(SLOTS, np.int64), [], 0
        for _, _, key, _ in _signatures(batches, width, bands, schemes, num, den):
            held.append((key % U64(SLOTS)).astype(np.int64))
            size += len(key)
            if size > SLOTS:
                counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        if counts.any():
            blocks = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in counts.reshape(64, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(blocks, pa.binary())], ["part", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks by part."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, block in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(block.as_py()), "<u4").astype(np.int64)
    done = [np.round(8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(done, pa.binary())], ["part", "weights"])


def key_weights(texts: DataFrame, width: int, bands: list[int], schemes: list[Scheme], num: int, den: int, parts: int) -> np.ndarray:
    """Eight times the logarithm of each slot's number of keys, over all sets: a megabyte whatever the corpus."""
    sums = texts.mapInArrow(tidy(_weigher(width, bands, schemes, num, den)), "part int, counts binary").repartition(min(64, parts), "part").mapInArrow(_add, "part int, weights binary")
    out = np.zeros((64, SLOTS // 64), np.uint8)
    for r in sums.collect():  # 64 rows
        out[r.part] = np.frombuffer(r.weights, np.uint8)
    return out.ravel()


def _indexer(width: int, bands: list[int], schemes: list[Scheme], num: int, den: int, weight: np.ndarray, parts: int):
    """Blocks of index rows ``(key, fingerprint)``, dealt by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, f = np.concatenate(held_k), np.concatenate(held_f)
            part = (mix(k + _K[5]) % U64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                at = order[cut[p] : cut[p + 1]]
                yield from pack(int(p), k[at], f[at])

        for f, row, key, spare in _signatures(batches, width, bands, schemes, num, den):
            stay = leave_out(row, key, spare, weight)
            held_k.append(key[stay])
            held_f.append(f[row[stay]].view(np.int64))
            held += len(held_k[-1])
            if held > 500_000:
                yield from flush()
                held_k, held_f, held = [], [], 0
        if held:
            yield from flush()

    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and fingerprint: ``(key, fp, lead)`` of keys that several sets have.

    The key given on is a hash of the sets that have it, so keys with the same sets become one; ``lead`` is the first
    of them.  A group of over ``LARGE`` sets isn't held but given on under a hash of its own key.
    """
    rest: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    large: tuple[int, int] | None = None  # a key that is being given on, and its lead

    def groups(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        k, f = k[new], f[new]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(k)))
        name = mix(np.add.reduceat(mix(f.view(np.uint64) + _K[0]), start) + size.astype(np.uint64)) if len(k) else np.zeros(0, np.uint64)
        _, once = np.unique(name, return_index=True)
        keep = np.zeros(len(start), bool)
        keep[once] = True
        keep = np.repeat(keep & (size > 1), size)
        return _rows(np.repeat(name.view(np.int64), size)[keep], f[keep], np.repeat(f[start], size)[keep])

    for b in batches:
        k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        if large is not None:
            mine = int(np.searchsorted(k, large[0], "right"))
            if mine:
                yield _rows(np.full(mine, mix(np.array([large[0]]).view(np.uint64)).view(np.int64)[0]), f[:mine], np.full(mine, large[1]))
            if mine == len(k):
                continue
            k, f, large = k[mine:], f[mine:], None
        k, f = np.concatenate([rest[0], k]), np.concatenate([rest[1], f])
        cut = int(np.searchsorted(k, k[-1], "left"))
        yield groups(k[:cut], f[:cut])
        rest = k[cut:], f[cut:]
        if len(rest[0]) > LARGE:
            large = int(rest[0][0]), int(rest[1][0])
            yield _rows(np.full(len(rest[0]), mix(rest[0][:1].view(np.uint64)).view(np.int64)[0]), rest[1], np.full(len(rest[0]), large[1]))
            rest = rest[0][:0], rest[1][:0]
    if len(rest[0]):
        yield groups(*rest)


def _rows(key: np.ndarray, fp: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(lead)], ["key", "fp", "lead"])


def _near(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether bitmaps leave it open that two sets link; the wider is folded to the other's size."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    for half in range((len(a) // len(b)).bit_length() - 1):
        bits = len(a) * 8 >> (half + 1)
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count() * (num + den) <= (den - num) * (na + nb)


def _open(num: int, den: int):
    """The pairs that bitmaps leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b")]
            yield b.filter(pa.array([_near(*x, num, den) for x in zip(*cols, strict=True)], pa.bool_())).select(["a", "b"])

    return run


def _setter(width: int):
    """Token sets of the wanted texts, once for each group of pairs they take part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offs = text_bytes(b.column("text"))
            want, groups = b.column("fp").to_numpy(zero_copy_only=False), b.column("groups")
            for lo, rows, r, g in token_sets(raw, offs, width):
                _, f = fingerprint(r, g, rows)
                cut = np.searchsorted(r, np.arange(rows + 1))
                for i in np.flatnonzero(f.view(np.int64) == want[lo : lo + rows]):
                    mine, tokens = groups[int(lo + i)].as_py(), g[cut[i] : cut[i + 1]].tobytes()
                    for at in range(0, len(mine), 64):
                        part = mine[at : at + 64]
                        cols = [pa.array([x[c] for x in part], pa.int64()) for c in ("lead", "block", "comp", "mine")]
                        cols.append(pa.array([int(want[lo + i])] * len(part), pa.int64()))
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([tokens] * len(part), pa.binary())], ["lead", "block", "comp", "mine", "fp", "tokens"])

    return run


def _verify(num: int, den: int):
    """Links between the lead of each ``(lead, block)`` and its other sets, exactly; the lead's row comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for lead, block, fp, tokens in zip(*(b.column(c).to_pylist() for c in ("lead", "block", "fp", "tokens")), strict=True):
                if (lead, block) != at:
                    at, own = (lead, block), None
                if fp == lead:
                    own = np.frombuffer(tokens, np.uint64)
                elif own is not None:
                    other = np.frombuffer(tokens, np.uint64)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if den * both >= num * (len(own) + len(other) - both):
                        out.append((lead, fp))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _flat(bits: list[np.ndarray]) -> np.ndarray:
    """Bitmaps folded to the narrowest of them."""
    words = min(len(b) for b in bits)
    return np.stack([np.bitwise_xor.reduce(b.reshape(-1, words), axis=0) for b in bits])


def _join(n: np.ndarray, comp: np.ndarray, block: np.ndarray, flat: np.ndarray, num: int, den: int, links) -> Iterator[tuple[int, int]]:
    """A forest over components: pairs of sets across them that bitmaps leave open and for which ``links(i, j)``.

    Sets of the largest component aren't compared with one another.  With sets of two blocks, only pairs across are.
    """
    _, root, size = np.unique(comp, return_inverse=True, return_counts=True)
    root, big = root.copy(), root == int(size.argmax())
    cross = bool((block != block[0]).any())
    place = np.arange(len(n))
    for i in np.flatnonzero(~big):
        j = np.flatnonzero((root != root[i]) & (big | (place < i)) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
        if cross:
            j = j[block[j] != block[i]]
        differ = np.bitwise_count(flat[j] ^ flat[i]).sum(1, dtype=np.int64)
        ok = differ * (num + den) <= (den - num) * (n[j] + n[i])
        for k in j[ok][np.argsort(differ[ok], kind="stable")].tolist():
            if root[k] != root[i] and links(int(i), k):
                root[root == root[k]] = root[i]
                yield int(i), k


def _each_part(columns: tuple[str, ...], solve):
    """Pairs found by ``solve`` in each run of rows that are equal in the first two of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            found: list[tuple[int, int]] = []
            for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if held and held[-1][:2] != r[:2]:
                    found += solve(held)
                    held = []
                held.append(r)
            yield _pairs(found)
        if held:
            yield _pairs(solve(held))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _forest(num: int, den: int):
    """Pairs of components, by bitmaps alone: ``(comp, comp)`` from rows sorted by key and part."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        n, comp, block = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        if (comp == comp[0]).all():
            return []
        flat = _flat([np.frombuffer(r[5], np.uint64) for r in rows])
        return [(rows[i][3], rows[j][3]) for i, j in _join(n, comp, block, flat, num, den, lambda i, j: True)]

    return _each_part(("key", "part", "n", "comp", "mine", "bits"), solve)


def _exactly(num: int, den: int):
    """Links across components, from token sets in rows sorted by cluster and part."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        rows = list({r[2]: r for r in rows}.values())
        comp, block = (np.array([r[k] for r in rows], np.int64) for k in (3, 4))
        if (comp == comp[0]).all():
            return []
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        n = np.array([len(x) for x in sets])
        flat = _flat([np.frombuffer(x, np.uint64) for x in bitmaps(np.repeat(np.arange(len(n)), n), np.concatenate(sets), n)])

        def links(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return den * both >= num * (len(sets[i]) + len(sets[j]) - both)

        return [(rows[i][2], rows[j][2]) for i, j in _join(n, comp, block, flat, num, den, links)]

    return _each_part(("lead", "block", "fp", "comp", "mine", "tokens"), solve)


def _compare(pairs: DataFrame, sets: DataFrame, narrow: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that link: by size and bitmaps first, then by whole token sets.

    A set named in many pairs is split into blocks of ``BLOCK`` partners; its tokens go once to each.
    """
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    left = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_open(num, den), "a long, b long")
    left = materialize(left, "open")
    sizes = left.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = left.join(broadcast_if_small(sizes, 200_000), "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    group = F.struct(F.col("a").alias("lead"), "block", F.lit(0).cast("long").alias("comp"), F.lit(0).cast("long").alias("mine")).alias("g")
    member = dealt.select(F.col("b").alias("fp"), group)
    leads = dealt.select(F.col("a").alias("fp"), group).distinct()
    found = materialize(_with_tokens(member.union(leads), sets, narrow, width, _verify(num, den), [F.col("fp") != F.col("lead")]), "links")
    discard(left)
    return found


def _with_tokens(member: DataFrame, sets: DataFrame, narrow: DataFrame, width: int, solve, order: list) -> DataFrame:
    """``solve`` over the token sets of ``member(fp, g)``, each sent to the groups ``g`` (lead and block) it is in."""
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = materialize(member.groupBy("fp").agg(F.collect_list("g").alias("groups")).join(sets.select("fp", "doc_id"), "fp"), "wanted")
    tokens = narrow.join(broadcast_if_small(wanted, 100_000), "doc_id").select("text", "fp", "groups").mapInArrow(
        tidy(_setter(width)), "lead long, block long, comp long, mine long, fp long, tokens binary"
    )
    return tokens.repartition(parts, "lead", "block").sortWithinPartitions("lead", "block", *order).mapInArrow(tidy(solve), "a long, b long")


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: groups of documents linked by shingle similarity.

    Words are runs outside space and 0x09-0x0D with A-Z folded; a document's set is its distinct ``width``-word
    shingles, or its whole word sequence when shorter.  Two documents link when ``den * |A & B| >= num * |A | B|``;
    ``component_id`` is the smallest ``doc_id`` reachable by links.  Equal sets are one node, so copies add no pairs.

    Null or empty text, or text without words, has an empty set and is linked with nothing.  Rows without a
    ``doc_id`` take no part and have a null component.  Rows that repeat a ``doc_id`` are judged each.  Extra columns
    are ignored; an empty table gives no rows.

    Words, shingles and sets are 64-bit hashes; keys, which only propose candidates, have 56 bits.  A frequent key is
    left out where the pigeonhole allows it; one that stays costs a row a set, and a second comparison only while its
    sets are in different components, in parts of two blocks of ``BLOCK`` sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profile = materialize(narrow.mapInArrow(tidy(_profile(width)), "doc_id long, n long, fp long, bits binary"), "profile")
    known = profile.where("n > 0 and doc_id is not null")
    bands = size_bands(num, den, known.agg(F.max("n")).first()[0] or 1)
    own = F.expr(f"aggregate(array({','.join(map(str, bands))}), -1, (k, x) -> if(n >= x, k + 1, k))")
    counts = {r.k: r["count"] for r in known.groupBy(own.alias("k")).count().collect()}  # a row a band
    schemes = [allocate(lo, hi - 1, counts.get(k, 0) + counts.get(k + 1, 0), num, den) for k, (lo, hi) in enumerate(zip(bands, bands[1:], strict=False))]
    texts = narrow.where("doc_id is not null and text is not null").select("text")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weight = key_weights(texts, width, bands, schemes, num, den, parts)
    packed = texts.mapInArrow(tidy(_indexer(width, bands, schemes, num, den, weight, parts)), _BLOCK)
    # one Python operator a stage: two in a row would double the workers that an executor keeps
    rows = unpacked(packed.repartitionById(parts, F.col("part"))).sortWithinPartitions("key", "fp")
    index = rows.mapInArrow(tidy(_live), "key long, fp long, lead long").groupBy("key", "fp", "lead").agg(F.count("*").alias("c"))
    index = materialize(index, "index")
    sets = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")).join(index.select("fp").distinct(), "fp", "left_semi"), "sets")
    met = index.where("fp <> lead").groupBy("fp", "lead").agg(F.sum("c").alias("c"))
    first = met.groupBy(F.col("fp").alias("b")).agg(F.max(F.struct("c", "lead")).alias("x")).select(F.col("x.lead").alias("a"), "b")
    links = _compare(first, sets, narrow, width, num, den)
    labels = materialize(connected_components(links), "labels")
    cuts = [links, labels]
    found = _link_components(index, sets, labels, narrow, width, num, den)
    if found is not None:
        cuts.append(found)
        labels = materialize(connected_components(links.union(found)), "labels")
        cuts.append(labels)
    labels = labels.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    labelled = profile.drop("bits").join(labels, "fp", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "fp")))
    least = labelled.where("n > 0 and doc_id is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = labelled.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id")
    )
    out = materialize(out, "components")
    for cut in (profile, index, sets, *cuts):
        discard(cut)
    return out


def _link_components(index: DataFrame, sets: DataFrame, labels: DataFrame, narrow: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """Links between sets that share a key but no component yet; None if bitmaps rule all of them out."""
    labels = labels.select(F.col("node").alias("fp"), F.col("component").alias("comp"))
    of = index.select("key", "fp").join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    of = materialize(of, "labelled")
    mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("f")).where("lo <> hi")
    mixed = materialize(mixed.select("key", F.ceil(F.col("f") / BLOCK).cast("long").alias("blocks")), "mixed")
    rows = _in_blocks(of.join(mixed, "key").join(sets.select("fp", "n", "bits"), "fp")).select("key", "part", "n", "comp", "mine", "bits")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part").mapInArrow(tidy(_forest(num, den)), "a long, b long")
    near = materialize(near.distinct(), "near")
    found = None
    if near.limit(1).count() > 0:
        clusters = materialize(connected_components(near).select(F.col("node").alias("comp"), F.col("component").alias("lead")), "clusters")
        # of a cluster's components, the sets that have a key which other components have too
        members = of.join(mixed.select("key"), "key", "left_semi").select("fp", "comp").distinct().join(clusters, "comp")
        members = materialize(members, "members")
        sizes = members.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        dealt = _in_blocks(members.join(broadcast_if_small(materialize(sizes, "sizes"), 200_000), "lead"))
        dealt = dealt.select("fp", F.struct("lead", F.col("part").alias("block"), "comp", "mine").alias("g"))
        found = materialize(_with_tokens(dealt, sets, narrow, width, _exactly(num, den), []), "links")
        discard(clusters)
        discard(members)
    for cut in (of, mixed, near):
        discard(cut)
    return found


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows(fp, blocks, ...)`` once for each part of two blocks they are in: ``mine`` is a row's own block."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.withColumn("part", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
