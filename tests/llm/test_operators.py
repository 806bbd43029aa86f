"""Each operator against plain Python on edge cases, and against its SQL where it has one."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import DATA, same_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keysift.llm import decontamination, encoding, lines, packing, paragraphs, quality, queries, scratch, sharding, simhash, tokens, urls, warc

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)) + "."


def odd_documents():
    """Nulls, empty, blank and long texts, ties, repeated rows; and columns whose names the operators use inside."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 60) for _ in range(60))
    base = prose(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", " \n\t ", base, base, near, long, "a b", "é ü\nß", "A|B|C|D|E", "x!! Y!!", "\x1c", base + "\n" + base, "\n".join(["same line."] * 12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base), (None, base), (None, None)]
    return [(i, t, "s", -1, "clash", "clash") for i, t in rows]


SCHEMA = "doc_id long, text string, source string, n_words long, _text string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name]).df())


# 1 quality rules


def test_quality_measures(odd, none):
    def repeats(words):
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(grams)
        return len({i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)})

    rows = quality.measure(odd).select("doc_id", "text", *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text, words = r["text"] or "", split(r["text"])
        full = [x for x in text.split("\n") if split(x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in quality.SYMBOLS for c in text) and r["n_dup_lines"] == len(full) - len(set(full))
        assert r["n_repeat_words"] == repeats(words)
        assert r["base_failed"] == (len(words) < 50 or 100 * repeats(words) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.clean(odd).columns == odd.columns and quality.measure(none).count() == 0
    assert {r["doc_id"] for r in quality.clean(odd).collect()} >= {3, 5, 6}


def test_quality_measures_can_be_filtered(odd):
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    df = quality.measure(odd)
    filtered = df.filter("kept and n_words > 60").withColumn("x", F.col("n_words") + F.col("cleaned_chars")).filter("x > 3")
    assert size(filtered) < 2 * size(df)
    assert {r["doc_id"] for r in filtered.collect()} == {r["doc_id"] for r in df.collect() if r["kept"] and r["n_words"] > 60}
    assert {r["_text"] for r in df.collect()} == {"clash"}


def test_quality_hash_clash_is_settled_by_words(odd, monkeypatch):
    """With so few hash bits that windows clash, the exact way gives the same counts."""
    want = {(r["doc_id"], r["text"]): r["n_repeat_words"] for r in quality.measure(odd).collect()}
    monkeypatch.setattr(quality, "_POS_BITS", 60)
    monkeypatch.setattr(quality, "_POS_MASK", (1 << 60) - 1)
    assert {(r["doc_id"], r["text"]): r["n_repeat_words"] for r in quality.measure(odd).collect()} == want


def test_quality_lines(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = ["Home | News | Sport | More.", "no end mark here", "SHOUT AT YOU.", "x### y### z###.", "Read our privacy policy now."]
    df = spark.createDataFrame([(1, "\n".join([good, *bad])), (2, "\n".join([good, *[b + " " + b for b in bad] * 8]))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.measure(df).collect()}
    assert rows[1]["cleaned"] == good and rows[1]["n_failed_lines"] == 5 and rows[1]["kept"] and not rows[2]["kept"]


# 2 sharding


def test_sharding_moves_rows_into_the_new_shard_alone(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    for shards in (1, 5, 40):
        tree = sharding.Tree.build(shards)
        grown = tree.grow()
        both = sharding.assign(sharding.assign(df, "k", tree, "a"), "k", grown, "b").collect()
        assert {r["a"] for r in both} <= set(range(shards)) and all(r["b"] in (r["a"], shards) for r in both)
        again = sharding.assign(sharding.assign(df, "k", grown, "a"), "k", grown.grow(), "b").collect()
        assert all(r["b"] in (r["a"], shards + 1) for r in again)


def test_sharding_by_count_alone(spark):
    """Along a chain of counts, each made anew, a row stays or goes into the shard that is new."""
    df = spark.range(2000).withColumnRenamed("id", "k")
    for count in range(40, 45):
        df = sharding.assign(df, "k", sharding.Tree.sized(count), f"s{count}")
    rows = df.collect()
    for count in range(40, 44):
        moved = [r for r in rows if r[f"s{count}"] != r[f"s{count + 1}"]]
        assert moved and all(r[f"s{count + 1}"] == count for r in moved)
    assert {r["s44"] for r in rows} == set(range(44))
    with pytest.raises(ValueError):
        sharding.Tree.sized(39)


def test_sharding_follows_weights_and_confines_movement(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    one = sharding.Tree(((0, 0, 0, 1.0), (0, 1, 1, 1.0), (1, 0, 2, 2.0), (1, 1, 3, 4.0)))
    two = sharding.Tree(((0, 0, 0, 1.0), (0, 1, 1, 1.0), (1, 0, 2, 2.0), (1, 1, 3, 6.0)))
    rows = sharding.assign(sharding.assign(df, "k", one, "a"), "k", two, "b").collect()
    share = Counter(r["a"] for r in rows)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.02 for s, w in enumerate((1, 1, 2, 4)))
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b in (2, 3) for _, b in moved)  # only into the region that has grown, and there its grown rack


def test_numbers_are_gapless(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"))
    out = scratch.number_within(df, "g", scratch.hashed(4, F.col("id")), [F.col("id")], "n").collect()
    by = defaultdict(list)
    for r in out:
        by[r["g"]].append(r["n"])
    assert len(out) == 5000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_odd_rows(spark, odd, none, tmp_path):
    for df, n in ((odd, 17), (none, 0)):
        path = f"file://{tmp_path}/{n}"
        df.drop("_text").write.parquet(f"{path}/documents.parquet")
        rows = sharding.query(spark, path).collect()
        assert len(rows) == n
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


# 3 SimHash


def plain_fingerprint(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_equals_brute_force(odd, none):
    rows = simhash.classes(odd).collect()
    assert len(rows) == odd.count() and simhash.classes(none).count() == 0
    want = {(r["doc_id"], r["text"]): plain_fingerprint(r["text"]) for r in odd.collect()}
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in rows) == Counter((r["doc_id"], want[r["doc_id"], r["text"]]) for r in odd.collect())
    prints = sorted(set(want.values()))
    root = dict(zip(prints, plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)))
    least = defaultdict(list)
    for (d, _), p in want.items():
        least[root[p]] += [d] if d is not None else []
    assert all(r["component_id"] == min(least[root[r["fp"] % (1 << 64)]], default=None) for r in rows)


@pytest.mark.parametrize("group,bits", [(2, 3), (8, 3), (1024, 3), (40, 5), (8192, 5)])
def test_trie_join_finds_all_links(spark, group, bits):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(centre.tolist())
    for _ in range(160):
        x = int(rng.choice(centre))
        for bit in rng.integers(0, 64, rng.integers(1, bits + 2)):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, group)
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 64 for a, b in found.collect())
    component = {r["node"]: r["component"] for r in scratch.components(found).collect()}
    want = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= bits)
    got = [component.get(s, s) for s in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_chain_a_hub_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(7000, 7000)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in scratch.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 201 + 200 + 30
    assert all(c == (0 if n <= 200 else 1000 if n < 2000 else 2000) for n, c in got.items())
    assert scratch.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_keeps_one_of_each_group(odd):
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    by = {(r["doc_id"], r["fp"]): r["component"] for r in simhash.classes(odd, shingle=5, bits=simhash.NEAR_BITS).collect()}
    rows = [(r["doc_id"], np.uint64(plain_fingerprint(r["text"], 5)).view(np.int64).item()) for r in kept.collect()]
    assert sorted(by[r] for r in rows) == sorted(set(by.values()))


def test_exact_near_dedup_equals_brute_force(spark, odd, none):
    rng = random.Random(12)
    docs = []
    for _ in range(30):
        base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(200)]
        for edits in (0, 2, 4, 12):
            p = list(base)
            for at in rng.sample(range(5, 195), edits):
                p[at] = f"edit{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(p)))
    sets = [shingles(split(t)) for _, t in docs]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = plain_components(range(len(docs)), near)
    prints = [plain_fingerprint(t, 5) for _, t in docs]
    assert sum(near(i, i + 2) and (prints[i] ^ prints[i + 2]).bit_count() > simhash.NEAR_BITS for i in range(0, len(docs), 4)) > 5
    assert {r["doc_id"] for r in simhash.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == set(root)
    same = [(1, "a b c d e " * 40), (2, "a b c d e " * 40 + " ".join(f"x{i}" for i in range(60)))]  # within few bits, not near
    assert (plain_fingerprint(same[0][1], 5) ^ plain_fingerprint(same[1][1], 5)).bit_count() <= simhash.NEAR_BITS
    assert simhash.exact_dedup(spark.createDataFrame(same, "doc_id long, text string")).count() == 2
    assert simhash.exact_dedup(none).count() == 0 and simhash.exact_dedup(odd).columns == odd.columns


# 4 paragraphs


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def unusual(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(n)]


def plain_paragraphs(text):
    """(first word, words) of each paragraph: lines of enough words, and neighbouring shorter ones joined until they have as many."""
    at, held, begin = 0, [], 0
    for line in text.split("\n"):
        words = split(line.lower())
        if len(words) >= paragraphs.MIN_WORDS or not words:
            held = []
        begin = begin if held else at
        held = held + words
        at += len(words)
        if len(held) >= paragraphs.MIN_WORDS:
            yield begin, held
            held = []


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(80)] for _ in range(12)]
    docs = []
    for d in range(150):
        p = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            p[rng.randrange(len(p))] = f"edit{rng.randrange(10**6)}"
        p.insert(rng.choice([20, 40]), "\n") if d % 3 else None  # two lines: one is long enough or both together are
        docs.append((d, "\n".join([prose(rng, 50), " ".join(p), "short line.", "", prose(rng, 20), prose(rng, 30)])))
    docs += [(None, None), (500, ""), (501, docs[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = scratch.stash(paragraphs.units(df).filter("two is not null"), "marks")
    places = sorted({(d, at, tuple(w)) for d, t in docs for at, w in plain_paragraphs(t or "")}, key=str)
    assert {(r["doc_id"], r["at"], r["n_words"]) for r in marks.collect()} == {(d, at, len(w)) for d, at, w in places}
    groups = defaultdict(set)
    for r in marks.join(paragraphs.link(df, marks), ["one", "two"]).collect():
        groups[r["component"]].add((r["doc_id"], r["at"]))
    sets = [shingles(w) for _, _, w in places]
    root = plain_components(range(len(places)), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    want = defaultdict(set)
    for (d, at, _), c in zip(places, root):
        want[c].add((d, at))
    assert {frozenset(v) for v in want.values() if len(v) > 1} == {frozenset(v) for v in groups.values() if len(v) > 1}


def test_paragraph_removal_and_tuning(spark, odd, none):
    bands, rows = paragraphs.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL
    assert paragraphs.copies(none).count() == 0 and paragraphs.dedup(odd).columns == odd.columns and paragraphs.dedup(none).count() == 0
    assert sorted(map(str, paragraphs.dedup(odd).select("doc_id", "n_words", "kept").collect())) == sorted(map(str, odd.select("doc_id", "n_words", "kept").collect()))
    rng = random.Random(3)
    p, a, b = prose(rng, 60), prose(rng, 5), prose(rng, 6)
    df = spark.createDataFrame([(1, f"{a}\n{p}"), (2, f"{p}\n{b}"), (3, b)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in paragraphs.dedup(df).collect()} == {1: f"{a}\n{p}", 2: b, 3: b}
    assert paragraphs.without("ab cd\n\nef gh\nij", [(3, 6), (4, 3)]) == "ab \n\n gh\nij" and paragraphs.without("ab\ncd", [(0, 5)]) == ""


def test_keys_with_fewer_pivots_are_left_open(spark):
    rng = random.Random(2)
    near = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60)]
    docs = []
    for d in range(160):  # keys of four classes: one pair of near copies and two strangers each
        p = [w + f"g{d // 4}" for w in near] if d % 4 < 2 else prose(rng, 60).split()
        if d % 4 == 1:
            p[30] = "edit"
        docs.append((d, " ".join(p)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = paragraphs.units(df, whole=True).withColumn("keys", F.array(F.floor(F.col("doc_id") / 4).cast("long")))
    marks = scratch.stash(marks, "marks")
    found = {r["doc_id"]: r["component"] for r in marks.join(paragraphs.link(df, marks), ["one", "two"]).collect()}
    assert [d for d in range(0, 160, 4) if found[d] != found[d + 1]] == []
    assert len(set(found.values())) == 120


def test_units_do_not_depend_on_their_batch():
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["", "é " * 30, " \n\t", *[("\n" if d % 2 else " ").join(unusual(rng, rng.randrange(1, 150))) for d in range(30)], "x y " * 60, "ÀB c\x1c d" * 9]
    every = paragraphs.Texts(pa.array(texts))
    anchors = every.anchors()
    for d, t in enumerate(texts):
        one = paragraphs.Texts(pa.array([t]))
        assert len(one.start) == len(t.encode().split()) and one.anchors().tolist() == (anchors[every.doc[anchors] == d] - every.first[d]).tolist()
    low = [paragraphs.Texts(pa.array([t])).shingles[:1].tolist() for t in ("A b C d E f", "a B c D e g")]
    assert low[0] == low[1]


def test_passages_at_any_place_are_found(spark, odd, none):
    """Passages of 51 to 90 words at random offsets, over line ends and inside long lines, in two to five documents each."""
    rng = random.Random(21)
    docs, planted = [], []
    for _ in range(120):
        words = unusual(rng, rng.randrange(51, 90))
        passage = " ".join(w + ("\n" if rng.random() < rng.choice([0, 0.1]) else "") for w in words)
        members = []
        for _ in range(rng.randrange(2, 6)):
            own = unusual(rng, rng.randrange(5, 300))
            at = rng.randrange(len(own))
            members.append(len(docs))
            docs.append((len(docs), rng.choice([" ", "\n"]).join([" ".join(own[:at]), passage, " ".join(own[at:])])))
        planted.append((members, set(words)))
    clean = range(len(docs), len(docs) + 200)
    docs += [(d, " ".join(unusual(rng, 120))) for d in clean]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = paragraphs.passages(df).collect()
    found = {(r["doc_id"], r["removed"]) for r in rows}
    assert not {d for d, _ in found} & set(clean)
    late = [d for members, _ in planted for d in members[1:]]
    assert sum((d, True) in found for d in late) >= 0.97 * len(late)
    of = {d: words for members, words in planted for d in members}
    text = dict(docs)
    for r in rows:
        cut = text[r["doc_id"]][r["first_char"] : r["first_char"] + r["n_chars"]].split()
        assert len(set(cut) - of[r["doc_id"]]) <= 0.2 * len(cut) and len(cut) == r["n_words"]  # a near copy goes with what differs
        assert cut == text[r["doc_id"]].split()[r["at"] : r["at"] + r["n_words"]]
        assert r["first_doc_id"] <= r["doc_id"] and (r["doc_id"] in late or not r["removed"])
    kept = {r["doc_id"]: r["text"].split() for r in paragraphs.dedup(df).collect()}
    for d, t in docs:
        assert len(set(t.split()) - set(kept[d]) - of.get(d, set())) <= 0.2 * len(t.split()) and (d in late or kept[d] == t.split())
    twice = df.filter("doc_id = 1").unionAll(df.filter("doc_id = 1"))
    assert paragraphs.passages(twice).count() == 0  # repeated rows are one document
    assert paragraphs.passages(none).count() == 0 and paragraphs.passages(odd).count() > 0


# 5 WARC


def test_warc_round_trip(spark):
    big = "\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(3, "u\n1", "x" * 200), (1, None, "x" * 200), (2, "u", big), (2, "u", big), (None, "u", None), (9, "u", ""), (7, "é", "é" * 40000), (None, "z", "q" * 150), (5, "z", "q" * 150)]
    path = scratch.place(spark, "warc")
    warc.write(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int"), path)
    found = warc.read(spark, path).collect()
    assert len(found) == len(rows)
    got = Counter((r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found)
    want = Counter((p, "revisit" if p in (3,) or (p is None and h) else "response", {3: 1}.get(p) if p == 3 else 5 if p is None and h else None, None if p == 3 or (p is None and h) else (h or "").encode()) for p, _, h in rows)
    assert got == want
    sizes = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, path, digests=True).collect())
    assert sizes == Counter((p, None if x is None else len(x), None if x is None else hashlib.sha256(x).hexdigest()) for p, _, _, x in got.elements())
    files = spark.read.format("binaryFile").load(path).collect()
    assert all(r["path"].endswith(".gz") for r in files)
    heads = [h for r in files for h, _ in warc.parse(warc.unzipped(bytes(r["content"])))]
    names = {h["warc-record-id"]: h for h in heads}
    assert len(names) == len(heads) and all(names[h["warc-refers-to"]]["x-page-id"] == h["x-refers-to-page-id"] for h in heads if h["warc-type"] == "revisit")
    empty = scratch.place(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_faults_are_seen():
    page = {"page_id": 1, "row": 1, "url": "u", "again": None, "refers_to": None, "refers_row": None, "payload": b"p" * 50_000, "digest": "d"}
    whole = b"".join(r + b"\r\n\r\n" for r in warc.records(page))
    parts = list(warc.parse(whole))
    assert len(parts) > 2 and parts[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in parts))
    assert warc.payload_of(b"".join(b for _, b in parts)) == b"p" * 50_000
    for bad in (whole[:-300], b"x" + whole):
        with pytest.raises(warc.Malformed):
            list(warc.parse(bad))
    for body in (b"5\r\nabc", b"", b"3\r\nabcX"):
        with pytest.raises(warc.Malformed):
            warc.unchunked(body)
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


# 6 urls


def test_url_rules_and_reputation(spark):
    cases = [(None, "", "", None), ("nothing", "", "", None), ("HTTP://A.Example.COM?x", "a.example.com", "", None), ("x://net/de/1", "net", "/de/1", "net/de/"),
             ("a://b.net/de/8://", "b.net", "/de/8://", "net/de/"), ("h://example.net/de/8", "example.net", "/de/8", "example.net/de/8"), ("h://q.example.com/en/77", "q.example.com", "/en/77", "example.com/en/7"),
             ("h://badexample.com/en/", "badexample.com", "/en/", "com/en/"), ("h://x.org#/es/", "x.org", "", None), ("h://É.org/es/", "É.org", "/es/", "org/es/")]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, outcomes).collect()}
    verdict = {h + p: v for h, p, v in urls.RULES}
    assert got == {i: (h, p, r, verdict.get(r, "allow")) for i, (_, h, p, r) in enumerate(cases)}
    outcomes = spark.createDataFrame([("bad.x.co.uk", 1)] * 60 + [("good.y.com", 0)] * 60 + [("one.z.com", 1)], "host string, bad int")
    hosts = ["bad.x.co.uk", "new.x.co.uk", "good.y.com", "one.z.com", "new.com"]
    pages = spark.createDataFrame([(i, f"h://{h}/") for i, h in enumerate(hosts)], "page_id long, url string")
    rows = {r["host"]: r for r in urls.judge(pages, outcomes).collect()}
    assert rows["bad.x.co.uk"]["verdict"] == "block" and {rows[h]["verdict"] for h in ("good.y.com", "one.z.com", "new.com")} == {"allow"}
    assert rows["good.y.com"]["bad_rate"] < rows["new.com"]["bad_rate"] < rows["one.z.com"]["bad_rate"] < rows["bad.x.co.uk"]["bad_rate"]


# 7 packing and 9 token ids


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoding_equals_the_library(kind, file):
    path = public_tokenizers.path(file)
    get, library = encoding.encoder(kind, path), Tokenizer.from_file(path)
    rng = random.Random(2)
    alphabet = ["a", "B", "é", " ", " ", "\n", "\t", "\r", ".", ",", "'s", "'", "1", "\x1c", "\xa0", "́", "Σ", "ﬁ", "<|endoftext|>", "中", "_", "the", "İ", "ǰ", "ʰ", "ß"]
    texts = ["KİMİ, DİYE.", "", " ", "\n", "a  b", *["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(1500)]]
    for t in texts:
        assert np.frombuffer(get(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoding_when_the_memo_is_full(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO", 3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    get = encoding.byte_level(tokenizer)
    for t in ("one two three, four five. six", "six five four\nthree two one"):
        assert np.frombuffer(get(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for n in sorted(sizes.elements(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def least_bins(sizes, capacity):
    """The optimum, by trying every bin for each piece."""

    def place(left, gaps, most):
        if not left:
            return len(gaps)
        if len(gaps) > most:
            return most + 1
        best = most + 1
        for g in {*gaps, capacity}:
            if g >= left[0]:
                rest = list(gaps)
                if g in rest:
                    rest.remove(g)
                best = min(best, place(left[1:], [*rest, g - left[0]], best - 1))
        return best

    pieces = sorted(sizes, reverse=True)
    return place(pieces, [], len(pieces))


def test_plan_is_near_the_optimum_of_small_cases():
    rng = random.Random(14)
    ours = optimum = 0
    for _ in range(80):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 8))]
        n, least = sum(t for _, t in packing.plan(dict(Counter(sizes)), 12)), least_bins(sizes, 12)
        assert least <= n <= least + 1
        ours, optimum = ours + n, optimum + least
    assert ours <= 1.03 * optimum


def test_plan_uses_up_every_piece():
    rng = random.Random(8)
    for _ in range(60):
        sizes = Counter(rng.randint(1, 64) for _ in range(rng.randint(0, 200)))
        bins = packing.plan(dict(sizes), 64)
        used = Counter()
        for content, times in bins:
            assert sum(content) <= 64 and times > 0
            for n in content:
                used[n] += times
        assert used == sizes
        assert sum(t for _, t in bins) <= 1.05 * best_fit_decreasing(sizes, 64) + 1
    assert packing.plan({6: 1, 5: 2}, 10) and sum(t for _, t in packing.plan({7: 2, 4: 2, 3: 2, 6: 2}, 10)) == 4


def test_best_two_fit_replaces_the_smallest():
    # Greedy fills 6 + 3 of 10 and leaves 1; 2 + 2 fit the gap of 4 more tightly than 3.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def test_packing_of_odd_rows(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(packing.pieces(odd, path, keep_ids=True)).collect()
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        at = 0
        for k in range(-(-len(ids) // 1024)):
            size = len(ids) % 1024 or 1024 if k == 0 else 1024
            want[r["doc_id"], k, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at += size
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v)) and sum(n for _, n in v) <= 1024
    assert packing.pack(packing.pieces(none, path)).count() == 0
    joined = packing.sequences(packing.pack(packing.pieces(odd, path, keep_ids=True))).collect()
    assert all(len(r["ids"]) == sum(r["lengths"]) for r in joined) and len(joined) == len(by)


def test_token_files(spark, odd, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    at = f"file://{tmp_path}/t"
    tokens.write(odd, at, path)
    found = tokens.read(spark, at)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found.collect()) == want
    some = tokens.read(spark, at, first=3, last=5)
    assert {r["doc_id"] for r in some.collect()} == {3, 4, 5}
    plan = tokens.read(spark, at, first=3, ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[1]
    total = scratch.running_total(tokens.digests(found), found.drop("ids"), "doc_id", "n_tokens", "start").orderBy("start").collect()
    before = 0
    for r in total:
        assert r["start"] == before
        before += r["n_tokens"]
    tokens.write(none, f"{at}0", path)
    assert tokens.read(spark, f"{at}0").count() == 0


# 8 line dedup


def plain_line_dedup(docs):
    """Each text, by its place in ``docs``, without the repeated runs, with its lines and removed lines; and the lines that only long runs cost."""
    seen, out, short = set(), {}, 0
    for i, (_, t) in sorted(enumerate(docs), key=lambda x: x[1][0]):
        raw = (t or "").split("\n")
        at = [k for k, x in enumerate(raw) if split(x)]
        full, gone, threes = [raw[k] for k in at], set(), set()
        for size in range(1, lines.RUN + 1):
            for k in range(len(full) - size + 1):
                w = tuple(full[k : k + size])
                if size == lines.RUN or sum(len(split(x)) for x in w) > lines.WORDS or len(full) == size:
                    if w in seen:
                        gone.update(range(k, k + size))
                        threes |= set(range(k, k + size)) if size == lines.RUN else set()
                    seen.add(w)
        short += len(gone - threes)
        ends = [*at[1:], len(raw)]
        kept = raw[: at[0]] if at else raw
        for k in range(len(full)):
            kept = kept + ([] if k in gone else raw[at[k] : ends[k]])
        out[i] = ("\n".join(kept) if gone else t, len(full), len(gone))
    return out, short


def test_lines_equal_brute_force(spark, odd, none):
    rng = random.Random(6)
    pool = [f"line {i}." for i in range(9)]
    docs = [(d, "\n".join(rng.choices([*pool, "", " "], k=rng.randint(0, 14)))) for d in range(80)]
    docs += [(r["doc_id"], r["text"]) for r in odd.select((F.col("doc_id") + 100).alias("doc_id"), "text").filter("doc_id is not null").distinct().collect()]
    out = lines.dedup(spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, _n int"))
    got = {r["_n"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in out.collect()}
    assert got == plain_line_dedup(docs)[0]
    assert lines.dedup(none).count() == 0 and lines.dedup(odd).count() == odd.count()


def test_long_lines_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (3, 20, 24, 26, 30, 50, 51, 70)]
    docs = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(0, 9)))) for d in range(60)]
    docs += [(d + 100, "\n" + t.replace("\n", "\n\n") + "\n") for d, t in docs[::4]]
    want, short = plain_line_dedup(docs)
    out = lines.dedup(spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, _n int"))
    assert {r["_n"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in out.collect()} == want
    assert short > 20


# 10 decontamination


def test_wand_equals_exhaustive_search():
    rng = random.Random(7)
    items = [(i, " ".join(rng.choices(WORDS[:120], k=rng.randint(1, 40)))) for i in range(130)]
    frequency = Counter(w for _, t in items for w in set(decontamination.words(t)))
    index = decontamination.Index(items, frequency, len(items), 20.0)
    for _ in range(300):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randint(1, 60)))
        scores = Counter()
        for t in terms:
            for d, w in zip(index.items[t], index.weights[t]):
                scores[d] += w
        for least in (0.2, 0.5, 0.8):
            assert sorted(d for d, _ in index.wand(terms, least)) == sorted(d for d, s in scores.items() if s >= least - 1e-6)


@pytest.mark.parametrize("cells,spread", [(1, 1), (1 << 16, 8), (40, 1000)])
def test_block_bounds_keep_every_hit(monkeypatch, cells, spread):
    """However many chunks are bounded at a time and terms have rows, a chunk whose terms and the next one's reach the threshold is live."""
    monkeypatch.setattr(decontamination, "CELLS", cells)
    monkeypatch.setattr(decontamination, "SPREAD", spread)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS[:200], k=rng.randint(1, 30)))) for i in range(90)]
    frequency = Counter(w for _, t in items for w in set(t.split()))
    index = decontamination.Index(items, frequency, len(items), 15.0)
    for length in (1, 7, 40):
        chunks = [sorted(rng.sample(range(len(index.vocabulary)), rng.randint(0, 40))) for _ in range(length)]
        flat = [(c, t) for c, terms in enumerate(chunks) for t in terms] or [(0, 0)]
        got = set(index.live(np.array([c for c, _ in flat]), np.array([t for _, t in flat]), 0.7))
        for c in range(length):
            scores = Counter()
            for t in set(chunks[c]) | set(chunks[c + 1] if c + 1 < length else []):
                for d, w in zip(index.items[t], index.weights[t]):
                    scores[d] += w
            assert c in got or max(scores.values(), default=0) < 0.7


def test_decontamination(spark, odd, none):
    rng = random.Random(11)
    item = lambda n: f"{prose(rng, n)} {prose(rng, 6)}".capitalize()
    items = [(i, item(rng.randint(10, 40))) for i in range(30)] + [(90, None), (91, ""), (None, item(20)), (92, "one two three")]
    first = items[0][1]
    docs = [(1, f"{prose(rng, 300)} {first} {prose(rng, 200)}"), (2, prose(rng, 500)), (3, first.upper()), (4, " ".join(reversed(first.split()))),
            (5, first.rsplit(".", 2)[0]), (6, None), (7, f"x {items[5][1]} y {items[6][1]}"), (1, f"{prose(rng, 30)} {first}"), (8, "so one two three go")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    for chars in (4_000_000, 900):
        got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.hits(df, benchmark, block_chars=chars).collect())
        assert got == Counter([(1, 0), (1, 0), (3, 0), (7, 5), (7, 6), (8, 92)])
    clean = decontamination.decontaminate(df, benchmark)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 5, 6]
    assert decontamination.hits(none, benchmark).count() == 0 and decontamination.hits(odd, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("slots", [1, 1 << 19])
def test_sifting_loses_no_row(spark, monkeypatch, slots):
    monkeypatch.setattr(scratch, "SLOTS", slots)  # with one slot most rows are in doubt
    df = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("key"), F.col("id").alias("n"))
    keys = df.filter("n % 10 = 3 or key is null").select("key")
    maybe, clear = (sorted(r["n"] for r in x.collect()) for x in scratch.sifted(df, keys, "key"))
    assert sorted(maybe + clear) == list(range(2000))
    assert set(maybe) >= {i for i in range(2000) if i % 10 == 3 or i % 7 == 0}
    assert (slots == 1) == (len(maybe) > 1000)
    assert scratch.sifted(df, keys.limit(0), "key")[0].count() == 0
    assert scratch.sifted(df.limit(0), keys, "key")[1].count() == 0


def test_line_dedup_keeps_clashing_columns_and_repeated_rows(spark):
    text = "a b\nc d\ne f"
    rows = [(1, text, "x", 5, 7), (2, text, "y", 6, 8), (2, text, "y", 6, 8), (None, None, "z", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, doc int, removed int")
    got = sorted((tuple(r) for r in lines.dedup(df).collect()), key=str)
    assert got == sorted([(1, text, "x", 5, 7, 3, 0, 0), (2, "", "y", 6, 8, 3, 3, 1), (2, "", "y", 6, 8, 3, 3, 1), (None, None, "z", 1, 2, 0, 0, 0)], key=str)
