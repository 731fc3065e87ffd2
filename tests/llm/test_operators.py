"""Every corpus operator against brute force on a small table with nulls, empty and long texts, copies and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SPACE = r"[^\x20\x09-\x0D]+"


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def make_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij é") if k else r.choice("ABcd") for k in range(r.randint(1, 7))).replace(" ", "")
    para = lambda n: " ".join(word() for _ in range(n))
    passage, line = para(60), "The same long line in many texts"
    texts = {i: para(r.randint(1, 90)) for i in range(1, 40)}
    base = para(120).split(" ")
    for i in range(40, 60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        texts[i] = " ".join(w)
    for i in (60, 61, 62):
        texts[i] = f"{para(5)}\n  {line.upper()} \n{passage}\n{para(3)}"
    texts |= {63: None, 64: "", 65: texts[3], 66: "x" * 700, 67: "a b", 68: "  \t ", 69: para(5000), 70: "one\n\n" + line, 71: "mail a.b@c.org or +1 (632) 555-4827, 10.2.3.4 and 4111 1111 1111 1111"}
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en", 0.5) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("hot", [50_000, 0])
def test_substrings(docs, empty, hot, monkeypatch):
    from terrazzo.llm import suffix_dedup
    from terrazzo.llm.suffix_dedup import dedup_substrings

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    raw = {i: (t or "").encode() for i, t in TEXTS.items()}
    seen = {}
    for b in raw.values():
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    for r in dedup_substrings(docs).collect():
        b = raw[r.doc_id]
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(b), len(b) - len(left), runs, hashlib.sha256(left).hexdigest(), left)
    assert dedup_substrings(empty).count() == 0


def test_substrings_across_stretches(monkeypatch):
    from terrazzo.llm import suffix_dedup as S

    monkeypatch.setattr(S, "STRETCH", 300)
    raw = np.frombuffer(b"".join(bytes([k % 251, k // 251]) for k in range(900)), np.uint8)
    covered = set()
    for _, moved, part, offs in S._pieces(raw, np.array([0, len(raw)]), 200):
        *_, s0, s1, _ = S.anchors(part, offs, 200)
        for a, b in zip(s0, s1, strict=True):
            covered |= set(range(a + moved, b + moved + 1))
    assert covered == set(range(len(raw) - 199))


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (3, 1, 2)])
def test_jaccard(docs, empty, width, num, den, monkeypatch):
    from terrazzo.llm import jaccard as J
    from terrazzo.llm.jaccard import jaccard_components

    sets = {}
    for i, t in TEXTS.items():
        w = re.findall(SPACE, fold(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and den * both >= num * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    monkeypatch.setattr(J, "BLOCK", 7)  # hot keys and leads are split
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width, num, den).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    if width == 4:
        assert jaccard_components(empty, width, num, den).count() == 0


def test_jaccard_pigeonhole():
    """Any two sets within the bound share a key that neither leaves out, whatever the keys' weights."""
    from terrazzo.llm import jaccard as J

    deletions = J.allocate(40, 60, 10**10, 1, 2)
    assert deletions.q > 0
    r = np.random.default_rng(2)
    for scheme in (deletions, J.allocate(40, 60, 100, 1, 2), J.Scheme(90, 30)):
        for n in (48, 52, 58):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(20):
                k = int(r.integers(0, n // 3))
                b = np.unique(np.concatenate([a[k:], r.integers(0, 2**63, k).astype(np.uint64)]))
                row = np.repeat([0, 1], [len(a), len(b)])
                differ = np.minimum(60, np.array([len(a), len(b)]))
                who, key, spare = J.signature(row, np.concatenate([a, b]), np.array([0, 0]), [scheme], differ)
                stay = J.leave_out(who, key, spare, r.integers(0, 5, 64).astype(np.uint8))
                assert set(key[stay & (who == 0)]) & set(key[stay & (who == 1)])


def test_lines(docs, empty):
    from terrazzo.llm.line_dedup import dedup_lines

    blank = " \t\n\x0b\x0c\r"
    key = lambda x: fold(x).strip(blank)
    holders = {}
    for i, t in TEXTS.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    for r in dedup_lines(docs).collect():
        lines = (TEXTS[r.doc_id] or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == r.doc_id]
        assert (r.kept, r.n_lines, r.n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert dedup_lines(empty).count() == 0


def test_tokens(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from terrazzo.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, at = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in tokens.read_ids(spark, tokens.write_ids(docs, path)).collect()}
    for i in sorted(TEXTS):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.read_ids(spark, tokens.write_ids(empty, path)).count() == 0
    odd = ["a  b   c ", "é  x", "a\n b", "<|endoftext|> x", "  ", " a", "a ", "1 \t 2", "don't we'll"]
    raw = "".join(odd).encode()
    offs = np.concatenate([[0], np.cumsum([len(o.encode()) for o in odd])])
    ids, counts = tokens.encoder(path).encode(np.frombuffer(raw, np.uint8), offs)
    assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(o, add_special_tokens=False).ids for o in odd]


def test_token_pieces():
    """A word is one piece whatever mark or line feed follows it, and plain pieces don't go through the pattern."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from terrazzo.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, enc = Tokenizer.from_file(path), tokens.Encoder(path)

    class Cut:
        seen: list = []

        def findall(self, text, pattern=enc.cut):
            self.seen.append(text)
            return pattern.findall(text)

    enc.cut = Cut()

    def encode(texts):
        raw, offs = "".join(texts).encode(), np.cumsum([0, *(len(x.encode()) for x in texts)])
        ids, counts = enc.encode(np.frombuffer(raw, np.uint8), offs)
        assert [list(x) for x in np.split(ids, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]

    encode([" wörd wörd, wörd. wörd; wörd\n", " wörd\nwörd 12, 12."])
    assert sorted(bytes(enc.pool[i:j]).decode() for i, j in zip(enc.a, enc.b, strict=True)) == ["\n", " 12", " wörd", " wörd\n", ",", ".", ";", "wörd"]
    assert sorted(Cut.seen) == ["\n", " wörd\n"]
    encode(["it's 'sold' don''t", "2× a×b ÷, Ã×", "1,2.3", "a\n\nb\n c\nd\n", "\na,", ",a\u00a0\nb", "\u0436, \u4e2d. e\u0301, \u00b2, x\u00b2,", ""])


def test_rans_blocks():
    from terrazzo.llm import tokens

    r = np.random.default_rng(1)
    ids = np.minimum(r.geometric(0.01, 300_000), 50_256).astype(np.int32)
    freq = tokens.quantize(np.bincount(ids))
    assert freq.sum() == 1 << tokens.BITS
    tables = tokens._tables(tokens.unpack_table(tokens.pack_table(freq)))
    data = tokens.encode_block(np.array([1, 9]), np.array([100_000, 200_000]), ids, *tables[:2])
    assert len(data) < 2 * len(ids)
    assert (tokens.decode_block(data, tables)[2] == ids).all()
    with pytest.raises(ValueError, match="checksum"):
        tokens.decode_block(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], tables)


def test_pii(docs, empty):
    from terrazzo.llm import pii

    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    assert (got[71].n_email, got[71].n_ip, got[71].n_card, got[71].n_phone) == (1, 1, 1, 1)
    assert got[71].spans == "email:5:14,ip:37:45,card:50:69,phone:18:35"
    assert got[63].spans == got[64].spans == "" and got[63].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_spans(empty).count() == 0
    hit = miss = extra = 0
    table = pii.labelled_table(120, seed=77)
    for (text, spans), (_, found) in zip(table, pii.find_spans([t for t, _ in table], pii.trained_crf()), strict=True):
        want = {s for s in spans if pii._fits(s[0], text[s[1] : s[2]])}
        hit, miss, extra = hit + len(want & set(found)), miss + len(want - set(found)), extra + len(set(found) - want)
    assert hit / (hit + miss) > 0.9 and hit / (hit + extra) > 0.9


def test_contamination(spark, docs, empty):
    from terrazzo.llm.decontaminate import contaminated

    w = TEXTS[69].split()
    items = [(1, " ".join(w[100:130])), (2, " ".join(w[300:310] + w[200:210])), (3, " ".join(w[400:410]) + " q" * 10), (4, None), (5, ""), (6, " ".join(w[50:53]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in contaminated(docs, bench).collect()}
    assert {k: v for k, v in got.items() if k[0] == 69} == {(69, 1): 30, (69, 2): 20, (69, 6): 3}
    assert contaminated(empty, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_mixing(docs, empty):
    from terrazzo.llm import mixing

    plan, _ = mixing.mix_plan(docs, target_entropy=0.99, block_docs=4)
    rows = plan.collect()
    total = sum(r.n_tokens for r in rows)
    p = np.array([r.weight for r in rows])
    assert p.sum() == pytest.approx(1) and -(p * np.log(p)).sum() >= 0.99 * np.log(len(p)) - 1e-6
    used = {}
    for r in mixing.mix_schedule(docs, target_entropy=0.99, block_docs=4).collect():
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    longest = max(len(re.findall(SPACE, t or "")) for t in TEXTS.values())
    for r in rows:
        assert r.quota - longest <= used.get(r.source, 0) <= r.quota
    assert sum(used.values()) <= total
    assert mixing.mix_documents(docs, target_entropy=0.99).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0


def test_top_k(spark):
    from pyspark.sql import functions as F

    from terrazzo.llm.topk import top_k

    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).round(1)
    v[10] = v[20]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(300)] + [(300, None, 1), (301, [1.0, None] + [0.0] * 6, 1), (302, [float("nan")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for x in top_k(df, F.expr("vec_id % 50 = 0"), shard_rows=100).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.score, x.vec_id)
    e = np.floor(256 * v.astype(np.float32).astype(float))
    for q in range(0, 300, 50):
        want = sorted((-int(e[q] @ e[i]), i) for i in range(300) if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [(-s, i) for s, i in want]
    assert set(got) == set(range(0, 300, 50))
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_urls(spark):
    from terrazzo.llm.urls import judge_urls

    link = lambda h: f'<a href="http://{h}/x">x</a>'
    pages = [
        (1, "http://A.Example.org/es/1?q", ""), (2, "https://good.org/a", link("friend.net")), (3, "http://bad.com/de/1", ""), (4, "http://friend.net/p#f", None),
        (5, "http://shill.net/", link("bad.com") + link("bad.com")), (6, None, "x"), (7, "no-scheme/x", ""), (8, "http://x.com", ""), (8, "http://x.com", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("good.org", "/a", "org/", "allow")
    assert got[3] == ("bad.com", "/de/1", "com/de/", "block") and got[4] == ("friend.net", "/p", None, "allow")
    assert got[5] == ("shill.net", "/", None, "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("x.com", "", None, "allow")
    assert judge_urls(df.limit(0)).count() == 0


def test_quality(spark):
    from terrazzo.llm.quality import fit_quality, keep_quality, score_quality

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = fit_quality(docs, train)
    got = score_quality(docs, model).join(held, "doc_id").selectExpr("avg(cast((score >= 0.5) = (quality = 1) as int)) as a").first().a
    assert got > 0.9
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "en"), (3, " ", "s", "en")], "doc_id long, text string, source string, lang string")
    assert [r.score for r in score_quality(odd, model).collect()] == [0, 0, 0]
    assert keep_quality(odd, labels.limit(0)).count() == 0
