"""Operators 11 to 13 against plain Python: random small cases, odd rows, splits of every kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import SCHEMA, odd, none  # noqa: F401

from keysift.llm import decontamination, divergence, encoding, prefixes, substrings

# 11 source divergence


def audited(rows, least=3, ranks=200):
    """rows: (lang, source, text), as in the contract."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        n[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        every = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (every[t] + 1) // (sum(every.values()) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found[:most])}
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("heavy", [0.0, 0.3, 2.0])
def test_audit_equals_plain_python(spark, monkeypatch, heavy):
    rng = random.Random(11)
    words = ["A", "b", "é", "Éa", "ß", "日本", "x1y", "z-z"] + [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(40)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, *"abcdefg"])
        mine = words if source in ("a", "b") else words[: rng.randint(3, len(words))]
        rows.append((lang, source, rng.choice([None, "", " 1 "]) if i % 9 == 0 else " ".join(rng.choices(mine, k=rng.randint(1, 40)))))
    rows += [("xx", "only", "a b c"), ("yy", "s", "1 2"), ("yy", "t", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = rows_of(divergence.audit(df, heavy=heavy, ranks=5))
    assert len(got) == len(set(got)) and set(got) == audited(rows, ranks=5)


def test_audit_of_small_tiles_and_slices(monkeypatch):
    rng = np.random.default_rng(3)
    size, terms = 7, 30
    p0 = rng.integers(1, 1000, size)
    lists = [sorted(rng.choice(size, rng.integers(1, size + 1), replace=False)) for _ in range(terms)]
    p = [rng.integers(1, 10**9, len(x)) for x in lists]

    def sums(cells, dense):
        monkeypatch.setattr(divergence, "CELLS", cells)
        batch = pa.RecordBatch.from_pydict(
            {"lang": ["x"] * terms, "size": [size] * terms, "heavy": [dense] * terms, "g": lists, "p": p, "p0": [p0[x] for x in lists], "absent": [p0 if dense else None] * terms}
        )
        out = np.zeros((size, size), object)
        for b in divergence._tiles(iter([batch, batch])):
            for _, a, o, v in zip(*(c.to_pylist() for c in b.columns)):
                out[a, o] += v
        return out

    whole = np.zeros((size, size), object)
    both = np.zeros((size, size), object)
    f = lambda x, y: (int(x) - int(y)) ** 2 // int(y)
    for x, own in zip(lists, p):
        at = dict(zip(x, own))
        for a in range(size):
            for o in range(size):
                y, z = at.get(a, p0[a]), at.get(o, p0[o])
                whole[a, o] += 2 * f(y, z)
                if a in at and o in at:
                    both[a, o] += 2 * (f(y, z) - f(y, p0[o]) - f(p0[a], z) + f(p0[a], p0[o]))
    for cells in (1, 10, 60, 1 << 21):
        assert (sums(cells, True) == whole).all() and (sums(cells, False) == both).all()


def test_counting_in_slices_and_handing_on(spark, monkeypatch):
    text = ("Alpha beta1gamma " * 50 + "é日 ") * 3
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert Counter(w for part in divergence._slices(text.encode()) for w in part) == Counter(
        w.encode() for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    )
    assert list(divergence._slices(b"")) == []


def test_audit_of_odd_rows(spark, odd, none):  # noqa: F811
    lang = odd.withColumnRenamed("_text", "lang")
    got = rows_of(divergence.audit(lang, least_docs=2))
    assert set(got) == audited([(r["lang"], r["source"], r["text"]) for r in lang.collect()], least=2)
    assert divergence.audit(none.withColumnRenamed("_text", "lang")).count() == 0


def test_share_of_large_counts(spark):
    n, total = 9_223_372_036_854, 18_446_744_073_709
    df = spark.createDataFrame([(n, total, 7), (5, 9, 0)], "n long, total long, v long")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + 7), None]


# 12 prefix trie


def brute_trie(rows, shared=20, most=4):
    """rows: (conv_id, turn, role, text)."""
    md5 = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % shared) * (1 if c >= 0 else -1)
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, m in nodes.items():
        words = len((p[-1][1]).encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * words
    out = set()
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if convs[c] == p)))
        out.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for c in range(-30, 170):
        if rng.random() < 0.8:
            for t in range(rng.choice([1, 1, 2, 4, 7])):
                rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "bot", None]), rng.choice([None, "", "a", "a b", "c d  e\x0bf"])))
    rows += [(c, t, "user", "same old words") for c in range(1000, 1700) for t in range(5)]  # a large group of copies
    rows += [(None, 1, "user", "lost"), rows[0], (50_000, 0, "user", "x")] + [(60_000, t, "user", f"long {t}") for t in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVERSATIONS + ", key string, block int")
    want = brute_trie(rows)
    for per_block in (200_000, 40):  # the least number of blocks, and blocks smaller than the group
        got = rows_of(prefixes.trie(df, per_block=per_block))
        assert len(got) == len(set(got)) and set(got) == want


def test_trie_of_one_none_and_turnless(spark):
    for rows in ([], [(None, 1, "a", "b")], [(7, 1, None, None)], [(21, 1, "a", "b")], [(c, 1, "a", "b") for c in range(1, 20)]):
        got = rows_of(prefixes.trie(spark.createDataFrame(rows, CONVERSATIONS)))
        assert set(got) == brute_trie(rows) and len(got) == len(set(got))


def blocks_merged(convs, cuts):
    """The nodes of conversations of numbered turns, the order cut into blocks at any places."""
    turn = lambda t: hashlib.md5(str(t).encode()).digest()
    rows = sorted((b"".join(map(turn, s)), c, [t % 5 for t in s]) for c, s in convs)
    edges, local = [0, *sorted(cuts), len(rows)], []
    for block, (x, y) in enumerate(zip(edges, edges[1:])):
        key, ids, words = ([r[i] for r in rows[x:y]] for i in range(3))
        columns = [pa.array([block] * (y - x), pa.int32()), pa.array(ids, pa.int64()), pa.array(key, pa.binary()), pa.array(words, pa.list_(pa.int32()))]
        batch = pa.RecordBatch.from_arrays(columns, names=["block", "conv_id", "key", "words"])
        local += [r for b in prefixes._block(iter([batch])) for r in b.to_pylist()]
    items = sorted((r for r in local if r["kind"] == "item"), key=lambda r: (r["block"], r["seq"]))
    merged = [r for b in prefixes._merge(iter([pa.RecordBatch.from_pylist(items, schema=prefixes._SCHEMA)])) for r in b.to_pylist()]
    found = {(r["block"], r["seq"]): r["parent"] for r in merged if r["kind"] == "found"}
    pieces = [(r["key"], r["ends"]) for r in sorted((r for r in local if r["kind"] == "ids"), key=lambda r: (r["key"], r["block"], r["seq"]))]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.binary()), pa.array([e for _, e in pieces], pa.string())], names=["key", "ends"])
    ends = {r["key"]: r["ends"] for b in prefixes._digests(iter([batch])) for r in b.to_pylist()}
    out = []
    for r in (r for r in local + merged if r["kind"] == "node"):
        parent = r["parent"] if r["parent_seq"] is None else found[r["block"], r["parent_seq"]]
        n, least, leaves, saved = r["sums"]
        for i, before in enumerate(r["words"]):
            d, bottom = r["top"] + i, r["top"] + i == r["bottom"]
            own = (r["ends"] or ends[r["key"]]) if bottom else prefixes.EMPTY
            out.append((least, d, None if d == 0 else least if i else parent, n, r["children"] if bottom else 1, leaves, saved - (n - 1) * before, own))
    return out


def test_blocks_of_any_size_give_the_same_trie():
    rng = random.Random(1)
    for _ in range(400):
        n, turns = rng.randint(0, 14), rng.randint(1, 4)
        convs = [(i * 7 % 31 - 5, tuple(rng.randint(1, turns) for _ in range(rng.randint(0, rng.choice([0, 1, 3, 6]))))) for i in range(n)]
        nodes = defaultdict(list)
        for c, s in convs:
            for d in range(len(s) + 1):
                nodes[s[:d]].append(c)
        kids, want = Counter(p[:-1] for p in nodes if p), set()
        for p, m in nodes.items():
            below = [q for q in nodes if q[: len(p)] == p]
            saved = sum((len(nodes[q]) - 1) * (q[-1] % 5) for q in below if q)
            ends = ",".join(str(c) for c in sorted(c for c, s in convs if s == p))
            want.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
        got = blocks_merged(convs, [rng.randint(0, n) for _ in range(rng.randint(0, 6))])
        assert len(got) == len(set(got)) and set(got) == want


# 13 substring dedup


def brute_substrings(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    uses = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if uses[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substrings_equal_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(substrings, "SLICE", 700)  # texts cut into slices
    text = lambda n, letters="abcdefghijklmnop ": "".join(rng.choices(letters, k=n))
    passages = [text(n) for n in (40, 60, 90, 300)] + ["é日ß" * 40]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 20)
            parts += [p[a : a + rng.randint(20, len(p))], text(rng.randint(0, 50))]
        rows.append((i, "".join(parts)))
    rows += [(200, None), (201, ""), (202, "x" * 39), (203, "x" * 500), (204, "ab" * 300), (205, text(39)), (206, text(2000, "ab")), (None, rows[3][1]), rows[5], rows[5], (None, None)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, start int, bucket string")
    how = substrings.Strings(40, 8, 4)
    got = rows_of(substrings.dedup(df, how))
    assert sorted(got, key=str) == brute_substrings(rows, 40)


@pytest.mark.parametrize("length,q,block", [(16, 16, 1), (33, 16, 16), (200, 32, 16)])
def test_substrings_of_other_lengths(spark, length, q, block):
    rng = random.Random(length)
    base = ["".join(rng.choices("abcdefgh", k=700)) for _ in range(4)]
    rows = [(i, x) for i, x in enumerate(base)]
    for i in range(30):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = "Z"
        a = rng.randint(0, 300)
        rows.append((10 + i, "".join(x[a : a + rng.randint(0, 400)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(rows_of(substrings.dedup(df, substrings.Strings(length, q, block))), key=str) == brute_substrings(rows, length)


def test_substrings_keep_texts_and_refuse_odd_sizes(spark, odd, none):  # noqa: F811
    got = substrings.dedup(odd, texts=True).collect()
    want = brute_substrings([(r["doc_id"], r["text"]) for r in odd.collect()], 200)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert substrings.dedup(none).count() == 0
    for bad in ((200, 24, 16), (40, 32, 16), (40, 4, 1)):
        with pytest.raises(ValueError):
            substrings.Strings(*bad)


# Bounds and types of earlier operators


def test_memos_are_bounded_by_bytes():
    import sys

    import public_tokenizers
    from tokenizers import Tokenizer

    memo = encoding._Memo(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "", "byte")
    rng = random.Random(4)
    for _ in range(400):  # texts without a space: pieces that hardly come again
        memo["".join(rng.choices("汉字表达很长的一段没有空格", k=300))]
    assert not memo
    memo.room = 20_000
    for i in range(2000):
        memo[f"w{i}"]
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())
    assert 0 < len(memo) < 200 and held < 20_000
    terms = decontamination._Terms({"a": 0})
    for i in range(300):
        terms["x" * 50 + str(i)]
    assert not terms and terms["a"] == 0 and len(terms) == 1


@pytest.mark.parametrize("kind", ["string", "int", "double"])
def test_items_of_any_id(spark, kind):
    text = " ".join(f"word{i}" for i in range(40)) + "?\n\nAnswer: " + " ".join(f"reply{i}" for i in range(12))
    ids = {"string": ["b-1", None], "int": [7, None], "double": [2.5, None]}[kind]
    benchmark = spark.createDataFrame([(i, text) for i in ids], f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "nothing of it")], "doc_id long, text string")
    got = decontamination.hits(docs, benchmark)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect() if r["item_id"] is not None) == [(1, ids[0] if kind != "double" else "2.5")]
    assert {r["doc_id"] for r in got.collect()} == {1}
