"""Queries that do their whole job, and steps whose cost grows no faster than their input."""

from hashlib import md5

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from keysift.functions import matching, text
from keysift.operators import bow, domains, prepare, spatial
from keysift.plans import catalog


def test_collection_sets_tells_all_members_in_order(spark, duck):
    rows = {r["source"]: (r["n_docs"], r["ids_md5"]) for r in catalog.queries()["collection_sets"](spark, DATA).collect()}
    found = {}
    for source, i in duck.sql("select distinct source, doc_id from documents order by doc_id").fetchall():
        found.setdefault(source, []).append(str(i))
    assert rows == {s: (len(ids), md5(" ".join(ids).encode()).hexdigest()) for s, ids in found.items()}


def test_members_pass_by_in_order_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(None if i % 3 == 0 else f"k{i % 3}", None if i == 5 else i % 20) for i in range(60)], "k string, m long")
        rows = {r["k"]: (r["n"], r["md5"]) for r in prepare.member_digests(df, "k", "m").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = " ".join(map(str, range(20)))
    assert rows == {None: (20, md5(text.encode()).hexdigest()), "k1": (20, md5(text.encode()).hexdigest()), "k2": (20, md5(text.replace(" 5 ", " ").encode()).hexdigest())}


def test_set_compare_has_every_member_of_both_sides(spark, duck):
    rows = catalog.queries()["set_compare_full_outer"](spark, DATA).collect()
    held = {(r["source"], r["doc_id"]) for r in rows if r["side"] == "documents"}
    assert held == set(duck.sql("select source, doc_id from documents where doc_id not in (select doc_id from labels)").fetchall())
    mixed = {(r["source"], r["doc_id"]) for r in rows if r["side"] == "good"}
    assert mixed == set(duck.sql("select source, doc_id from documents join labels using (doc_id) where quality = 1 and toxic <> 0").fetchall())


def test_differences_hold_nulls_equal(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("x", None)], "k string, m long")
    b = spark.createDataFrame([(None, 1), ("x", 3), ("x", None)], "k string, m long")
    assert {tuple(r) for r in prepare.differences(a, b, "k", "m").collect()} == {("x", 2, "left"), ("x", 3, "right")}


def test_readings_of_one_text_equal_the_plan(spark, duck):
    texts = [r[0] for r in duck.sql("select text from conversations where text is not null union all select text from documents limit 300").fetchall()]
    texts += ["Đường phố", "İstanbul ŉ ﬀ Straße ß Å Kelvin", "nguowif ddi xe ddapj", "glass bus2 abc12 zzz aall", "", "  ", "á̂ b c　d", "x" * 50 + " ½ ² ﷺ"]
    n = text.normalize(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n.alias("n"), text.candidates(text.variants(n)).alias("c")).collect()
    for r in rows:
        assert text.plain(r["t"]) == r["n"] and text.phrases(r["n"]) == r["c"], r["t"]
    null = domains.analyses(spark.createDataFrame([(None,)], "query string")).first()
    assert null["normalized"] is None and null["candidates"] == []


def test_a_text_has_no_more_candidates_than_asked_for(spark, duck, tmp_path):
    rest = "bus python glass html iot clip sql css open day"  # with one more word 31 candidates of the first reading; the second one is the last, before its first run
    texts = [f"{w} {rest}" for w in ("door1", "doorr", "doors", "ddoor", "door", "q1", "q")] + ["doors", "q1", None, ""]
    texts += [" ".join(f"w{chr(97 + i % n)}{'sx1'[i % 3]}" for i in range(n + k)) for n in (3, 5, 9, 10, 11, 12) for k in (0, 1, 4)]
    for t in filter(None, texts):
        every = text.phrases(text.plain(t), 10**9)
        for most in range(len(every) + 2):
            assert text.phrases(text.plain(t), most) == every[:most], (t, most)
    rows = spark.createDataFrame([(i // 3, i % 3, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    own = duck.cursor()
    own.sql(f"create temp view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    same_rows(catalog.queries()["ngram_candidates"](spark, str(tmp_path)), own.sql(catalog.oracle_sql()["ngram_candidates"]).df())


def test_terms_meet_in_tasks_and_by_keys_alike(spark, monkeypatch):
    words = ["red", "bolt", "large", "ring", "hot", "gear", "blue", "widget", "large ring", "red hot bolt", "large red hot ring", "bolt bolt", "xe", "dap", "xe dap"]
    phrases = [(i, f"{a} {b}") for i, a in enumerate(words) for b in words] + [(99, w) for w in words] + [(100, ""), (101, "smal ring"), (102, "widgett")]
    df, terms = spark.createDataFrame(phrases, "k int, candidate string"), spark.createDataFrame([(w,) for w in [*words, ""]], "target string")
    for fuzzy in (False, True):
        got = []
        for few in (matching.FEW, 3):
            monkeypatch.setattr(matching, "FEW", few)
            got.append(sorted((r["k"], r["target"], round(r["score"], 12)) for r in matching.join_terms(df, terms, ["k"], fuzzy_too=fuzzy).collect()))
            monkeypatch.undo()
        assert got[0] == got[1] and len(got[0]) > 100


def test_few_terms_deal_no_phrase(spark):
    df = spark.createDataFrame([(1, "red bolt")], "k int, candidate string")
    plan = matching.join_terms(df, spark.createDataFrame([("bolt",)], "target string"), ["k"], fuzzy_too=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_bags_of_texts_equal_bags_of_detections(spark):
    texts = [(1, "a a b c"), (2, None), (3, ""), (4, "B b É e e"), (1, "c c c d"), (None, "x y x"), (None, "x z"), (5, " ".join(f"w{i}" for i in range(40)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    words = df.select("doc_id", F.explode(text.tokens(text.normalize(F.coalesce("text", F.lit(""))))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    want = bow.bags(counts.select("doc_id", "term", (F.col("n") / F.max("n").over(Window.partitionBy("doc_id"))).alias("score")), "doc_id")
    rows = lambda d: sorted((str(r["doc_id"]), r["term"], r["weight"]) for r in d.collect())
    assert rows(bow.text_bags(df, "doc_id")) == rows(want)


def test_bags_deal_no_words(spark):
    plan = catalog._text_bags(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_equal_prototypes_have_equal_scores(spark):
    rng = np.random.default_rng(3)
    own = rng.normal(size=(3, 64))
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(50)], "i int, vector array<double>")
    got = domains.with_semantic_scores(df, [*own, own[1], own[0]]).join(df, "i").collect()
    for r in got:
        assert r["semantic"][3] == r["semantic"][1] and r["semantic"][4] == r["semantic"][0]
        x = np.asarray(r["vector"])
        assert np.allclose(r["semantic"][:3], (own @ x / np.linalg.norm(own, axis=1) / np.linalg.norm(x) + 1) / 2)


@pytest.mark.parametrize("pairs,block,asked,cells", [(40, 50_000, 50_000, 2_000_000), (40, 100, 3, 700), (10**9, 50, 7, 1)])
def test_blocks_of_tiles_find_what_a_full_scan_finds(spark, tmp_path, monkeypatch, pairs, block, asked, cells):
    for name, value in (("PAIRS", pairs), ("BLOCK", block), ("ASKS", asked), ("CELLS", cells)):
        monkeypatch.setattr(spatial, name, value)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 4)) + rng.integers(0, 4, size=(1500, 1)) * 5
    points[300:700] = points[0]  # one vector that many share
    df = spark.createDataFrame([(i, "AB"[i % 5 == 0], p.tolist()) for i, p in enumerate(points)], "position long, collection_id string, reduced array<double>")
    tree = spatial.fit_tree(points[::2], 1500, 20)
    path = f"file://{tmp_path}/t"
    spatial.tiled(df, ["collection_id"], tree, 20).write.partitionBy("collection_id", "tile").parquet(path)
    held = spark.read.parquet(path)
    tiles = spatial.boxes(held, ["collection_id"], 4).withColumn("grain", F.lit("frames")).withColumn("part", F.explode(F.array(F.lit("all"), F.col("collection_id"))))
    table = held.select("collection_id", "tile", "position", F.col("tile").alias("home"), "reduced")
    asks = [(a, ("all", "A", "B")[a % 3], points[(a * 41) % 1500].tolist(), (1, 7, 60, 5000)[a % 4]) for a in range(24)]
    pairs_made = []
    store = spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda d, name: (pairs_made.append(store(d, name).count()) if name == "bounds" else None, store(d, name))[1])
    found = spatial.nearest(spark.createDataFrame(asks, "ask int, part string, query array<double>, k int"), tiles, {"frames": (table, ["collection_id", "tile"])}).collect()
    names = np.array([i % 5 == 0 for i in range(1500)])
    for a, part, q, k in asks:
        d = np.zeros(1500)
        for i in range(4):
            d += (points[:, i] - q[i]) ** 2
        d = np.sqrt(np.where(np.ones(1500, bool) if part == "all" else names == (part == "B"), d, np.inf))
        kth = np.sort(d)[k - 1] if k <= 1500 else np.inf
        want = {int(i): float(d[i]) for i in np.flatnonzero((d <= kth) & np.isfinite(d))}
        assert {r["position"]: r["distance"] for r in found if r["ask"] == a} == want
    if block == 50_000:
        assert pairs_made[0] <= 2 * pairs  # of 24 asks and over 70 tiles


def test_an_index_has_a_bounded_number_of_tiles():
    assert spatial.tile_size(1000, 64) == 64 and spatial.tile_size(10**6, 64) * spatial.TILES >= 10**6
