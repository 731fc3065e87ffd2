"""PII: fixed patterns for four kinds, and a linear-chain CRF over word shapes that finds more.

The CRF is trained on a small labelled table (made here by rule) and decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

# --- fixed patterns --------------------------------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Linear in the text: a match begins at the start of the run of local characters before an ``@``."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as in ``KINDS``, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the labelled table ------------------------------------------------------------------------------------------

#: Templates of the labelled table: {kind} is filled with a value of that kind, {w} with words, {n} with other numbers.
TEMPLATES = [
    "{w} call {phone} {w}", "{w} phone: {phone} {w}", "tel. {phone} {w}", "{w} mobile {phone}.", "{w} fax {phone}, {w}", "{w} {phone} {w}",
    "{w} mail {email} {w}", "{w} {email} {w}", "write to {email}, {w}", "e-mail: {email} {w}",
    "{w} ip {ip} {w}", "{w} {ip} {w}", "host {ip}, {w}", "{w} card {card} {w}", "{w} {card} {w}", "visa {card}. {w}",
    "{w} {phone} {email} {w}", "{w} {email} {phone} {card} {w}", "{w} {n} {w}", "{w} {n} {w} {n} {w}", "{w} version {n} {w}", "{w} {n}, {w}",
    "{w} in {n} {w}", "{w} token = \"{secret}\" {w}", "{w} {secret} {w}", "password={secret} {w}", "{w} section {n}. {w}", "{w} {w} {w}", "{w} @ {w} {w}", "{w} @{word} {w}",
]
_SYLLABLES = "an er in on re th st en ti es or te of ed is it al ar nd to ou ea ion le se ve me de hi ri ro co ch ge ung keit la pour ción".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.15 else w


def _value(r: random.Random, kind: str) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "phone":
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"00{r.randint(10, 99)} {d(2)} {d(4)} {d(4)}", f"+{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}"])
    if kind == "email":
        name = r.choice([_word(r).lower(), f"{_word(r).lower()}.{d(2)}", f"{_word(r).lower()}_{_word(r).lower()}", _word(r).lower() + d(2)])
        host = r.choice([f"mail{d(1)}.example.com", f"{_word(r).lower()}.org", f"{_word(r).lower()}.example.net"])
        return r.choice([f"{name}@{host}", f"{name} @ {host}", f"{name}(@){host}", f"{name}[@]{host}"]) if r.random() < 0.5 else f"{name}@{host}"
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        groups = [d(4) for _ in range(4)]
        return r.choice(["", " ", "-"]).join(groups)
    if kind == "secret":
        return r.choice(["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40])))])
    return r.choice([d(1) + ".", f"{d(1)}.{d(1)}", d(4), d(2), f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)},{d(3)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}%", d(6), f"{d(2)}.{d(3)}.{d(3)}", d(9), d(12)])


def labelled_table(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` labelled texts: ``(text, [(kind, start, end)])``."""
    r, out = random.Random(seed), []
    for i in range(n):
        text, spans = "", []
        for piece in re.split(r"(\{\w+\})", TEMPLATES[i % len(TEMPLATES)]):
            name = piece[1:-1]
            if not piece.startswith("{"):
                text += piece
            elif name == "w":
                text += " ".join(_word(r) for _ in range(r.randint(1, 7)))
            elif name == "word":
                text += _word(r)
            else:
                v = _value(r, "number" if name == "n" else name)
                if name in KINDS:
                    spans.append((name, len(text), len(text) + len(v)))
                text += v
        out.append((text, spans))
    return out


# --- the CRF -------------------------------------------------------------------------------------------------------

#: O, then the beginning and the inside of each kind.
STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_ALLOWED = np.array([[b[0] != "I" or (a != "O" and a[2:] == b[2:]) for b in STATES] for a in STATES])
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\w")
_TRIGGER = re.compile(r"[0-9@]")
#: Tokens of context on either side of a token with a digit or ``@``; other tokens are never examined.
CONTEXT = 8


def shape(token: str) -> str:
    """Letters as ``a``/``A`` (runs shortened to four), digits by their number, other characters as they are."""
    if token[0].isdigit():
        return f"9x{min(len(token), 20)}"
    s = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", s)


#: Cue words that are features by themselves.
CUES = frozenset("call phone tel mobile fax mail e email write ip host card visa version section token password in to".split())


def features(tokens: list[str], glued: list[bool]) -> list[list[str]]:
    """Shapes of a token and of its neighbours, and whether white space parts them."""
    s = [shape(t) for t in tokens]
    s = ["^^", "^", *s, "$", "$$"]
    out = []
    for i, t in enumerate(tokens):
        j = i + 2
        g = "g" if glued[i] else "s"
        h = "g" if i + 1 < len(tokens) and glued[i + 1] else "s"
        low = t.lower()
        cues = [f"c{k}:{tokens[i - k].lower()}" for k in (1, 2) if i >= k and tokens[i - k].lower() in CUES]
        out.append([f"0:{s[j]}", f"-:{g}{s[j - 1]}", f"+:{h}{s[j + 1]}", f"-0:{s[j - 1]}{g}{s[j]}", f"0+:{s[j]}{h}{s[j + 1]}", f"-0+:{s[j - 1]}{g}{s[j]}{h}{s[j + 1]}", f"--:{s[j - 2]}{s[j - 1]}", f"++:{s[j + 1]}{s[j + 2]}", *([f"w:{low}"] if low in CUES else []), *cues])
    return out


def windows(text: str) -> Iterator[tuple[list[tuple[int, int]], list[str], list[bool]]]:
    """Token sequences around digits and ``@``: ``(spans, tokens, glued)``; overlapping contexts are one sequence."""
    tokens: list[tuple[int, int]] = []
    hot: list[int] = []
    for line in re.finditer(r"[^\n]+", text):
        if not _TRIGGER.search(line.group()):
            continue
        tokens, hot = [], []
        for m in _TOKEN.finditer(text, line.start(), line.end()):
            if _TRIGGER.search(m.group()):
                hot.append(len(tokens))
            tokens.append(m.span())
        lo = hi = -1
        for h in [*hot, None]:
            if h is not None and lo >= 0 and h - CONTEXT <= hi:
                hi = h + CONTEXT + 1
                continue
            if lo >= 0:
                part = tokens[lo : min(hi, len(tokens))]
                yield part, [text[a:b] for a, b in part], [i > 0 and part[i - 1][1] == a for i, (a, b) in enumerate(part)]
            if h is not None:
                lo, hi = max(0, h - CONTEXT, 0 if lo < 0 else hi), h + CONTEXT + 1


class CRF:
    """Weights of a linear chain: ``emit[feature]`` and ``move``."""

    def __init__(self, emit: dict[str, np.ndarray], move: np.ndarray):
        self.emit, self.move = emit, np.where(_ALLOWED, move, -1e9)
        self.start = np.array([0.0 if s[0] != "I" else -1e9 for s in STATES])

    def scores(self, tokens: list[str], glued: list[bool]) -> np.ndarray:
        out = np.zeros((len(tokens), len(STATES)))
        for i, fs in enumerate(features(tokens, glued)):
            for f in fs:
                w = self.emit.get(f)
                if w is not None:
                    out[i] += w
        return out

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many sequences at once, the longest first."""
        order = np.argsort([-len(x) for x in batch], kind="stable")
        paths: list[np.ndarray] = [np.zeros(0, np.int8)] * len(batch)
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            sizes = np.array([len(batch[i]) for i in pick])
            n = int(sizes.max(initial=0))
            if n == 0:
                continue
            e = np.zeros((n, len(pick), len(STATES)))
            for c, i in enumerate(pick):
                e[: len(batch[i]), c] = batch[i]
            back = np.zeros((n, len(pick), len(STATES)), np.int8)
            best = e[0] + self.start
            last = best.copy()
            for t in range(1, n):
                k = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t
                step = best[:k, :, None] + self.move
                back[t, :k] = step.argmax(1)
                best = step.max(1) + e[t, :k]
                last[:k] = best
            state = last.argmax(1)
            for c, i in enumerate(pick):
                path, s = np.zeros(sizes[c], np.int8), state[c]
                for t in range(sizes[c] - 1, -1, -1):
                    path[t] = s
                    s = back[t, c, s]
                paths[i] = path
        return paths


def _targets(part: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(part), np.int64)
    for kind, s, e in spans:
        inside = [i for i, (a, b) in enumerate(part) if a >= s and b <= e]
        for k, i in enumerate(inside):
            y[i] = STATES.index(("B-" if k == 0 else "I-") + kind)
    return y


def train(table: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> CRF:
    """Maximum likelihood by stochastic gradient (AdaGrad), forward and backward passes in log space."""
    data = [(features(tok, glued), _targets(part, spans)) for text, spans in table for part, tok, glued in windows(text)]
    names = sorted({f for fs, _ in data for x in fs for f in x})
    at = {f: i for i, f in enumerate(names)}
    k = len(STATES)
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    sq_e, sq_m = np.full_like(emit, 1e-2), np.full_like(move, 1e-2)
    block = np.where(_ALLOWED, 0.0, -1e9)
    start = np.array([0.0 if s[0] != "I" else -1e9 for s in STATES])
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    rows = [[np.array([at[f] for f in x]) for x in fs] for fs, _ in data]
    r = random.Random(seed)
    for _ in range(epochs):
        for j in r.sample(range(len(data)), len(data)):
            y, idx = data[j][1], rows[j]
            n, m = len(y), move + block
            e = np.array([emit[i].sum(0) for i in idx])
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0] + start
            for t in range(1, n):
                a[t] = lse(a[t - 1][:, None] + m, 0) + e[t]
            for t in range(n - 2, -1, -1):
                b[t] = lse(m + e[t + 1] + b[t + 1], 1)
            z = lse(a[-1], 0)
            grad = np.exp(a + b - z)
            grad[np.arange(n), y] -= 1
            gm = np.zeros((k, k))
            for t in range(1, n):
                gm += np.exp(a[t - 1][:, None] + m + e[t] + b[t] - z)
                gm[y[t - 1], y[t]] -= 1
            gm += decay * move
            sq_m += gm * gm
            move -= rate * gm / np.sqrt(sq_m)
            for t, i in enumerate(idx):
                g = grad[t] + decay * emit[i]
                sq_e[i] += g * g
                emit[i] -= rate * g / np.sqrt(sq_e[i])
    return CRF({f: emit[i] for f, i in at.items()}, move)


_TRAINED: dict[tuple, CRF] = {}


def trained_crf(n: int = 600) -> CRF:
    """The CRF of the labelled table, trained once a process."""
    if n not in _TRAINED:
        _TRAINED[n] = train(labelled_table(n))
    return _TRAINED[n]


def _fits(kind: str, value: str) -> bool:
    """What a span of the method must hold to count as that kind."""
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return "@" in value and "." in value.split("@")[-1]
    if kind == "ip":
        return bool(_IP.fullmatch(value)) and all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= digits <= 19 and luhn("".join(c for c in value if c.isdigit()))
    return 8 <= digits <= 15


def find_spans(texts: list[str], crf: CRF) -> list[tuple[list, list]]:
    """``(base, all)`` spans of each text.  The method's spans are kept where they meet no span of the patterns."""
    base = [base_spans(t) if t else [] for t in texts]
    at, parts, scores = [], [], []
    for i, t in enumerate(texts):
        if t and _TRIGGER.search(t):
            for part, tok, glued in windows(t):
                at.append(i)
                parts.append(part)
                scores.append(crf.scores(tok, glued))
    more: dict[int, list] = {}
    for i, part, path in zip(at, parts, crf.decode(scores), strict=True):
        j = 0
        while j < len(path):
            if STATES[path[j]][0] != "B":
                j += 1
                continue
            kind, k = STATES[path[j]][2:], j + 1
            while k < len(path) and STATES[path[k]] == f"I-{kind}":
                k += 1
            s, e = part[j][0], part[k - 1][1]
            if _fits(kind, texts[i][s:e]) and not any(a < e and s < b for _, a, b in base[i]):
                more.setdefault(i, []).append((kind, s, e))
            j = k
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return [(b, sorted({*b, *more.get(i, [])}, key=order)) for i, b in enumerate(base)]


_OUT = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def pii_spans(docs: DataFrame, crf: CRF | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` for every row.

    Counts and the digest are of the fixed patterns' spans; ``spans`` also has those the CRF adds, as
    ``kind:start:end`` by kind, then start.  Null or empty text has none.  Rows repeating a ``doc_id`` are judged
    each, a null one stays null; extra columns are ignored.  One pass, without a shuffle, linear in the text.
    """
    model = crf or trained_crf()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        for b in batches:
            found = find_spans(b.column(1).to_pylist(), model)
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([join(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, spans], _OUT.fieldNames())

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _OUT)


def redact(docs: DataFrame, crf: CRF | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``<KIND>``; nulls stay null."""
    model = crf or trained_crf()
    names, schema = docs.columns, docs.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            out = []
            for t, (_, spans) in zip(texts, find_spans(texts, model), strict=True):
                end = len(t) + 1 if t else 0
                for k, s, e in sorted(spans, key=lambda x: (-x[1], -x[2])):
                    if e <= end:
                        t, end = f"{t[:s]}<{k.upper()}>{t[e:]}", s
                out.append(t)
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
