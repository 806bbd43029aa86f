"""The spatial index, term joins, routing and search of tables of queries, encoders on executors, PCA."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.functions import encoder, matching
from keysift.functions.encoder import HashingEncoder, encode_texts, encoded
from keysift.operators import batch, routing, search, spatial
from keysift.operators.domains import Catalog, alias_terms, analyses, analyze, clip_prompt, expanded, route
from keysift.operators.index import BuildOptions, Index, build, fit_pca, moments


def files_read(df):
    """How many files the scans of an executed plan opened."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def clustered(rng, n, dims=4, clusters=12):
    centres = rng.normal(size=(clusters, dims)) * 5
    return centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dims)) * 0.3


def test_tree_halves_and_joins(spark):
    rng = np.random.default_rng(1)
    points = clustered(rng, 2000)
    tree = spatial.fit_tree(points, 2000, 50)
    assert tree.depth == 6
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "i int, p array<double>")
    leaves = np.array([r[0] for r in df.select("i", tree.leaf(F.col("p")).alias("l")).orderBy("i").select("l").collect()])
    sizes = np.bincount(leaves, minlength=64)
    assert sizes.max() <= 40 and sizes.min() >= 20
    assert spatial.fit_tree(points[:5], 1_000_000, 10).depth == 0 and spatial.fit_tree(points[:0], 0, 10).depth == 0
    assert spatial.fit_tree(np.zeros((64, 2)), 64, 8).depth == 3  # all points alike
    assert df.select(spatial.Tree(0).leaf(F.col("p")).alias("l")).distinct().collect() == [(0,)]


def test_box_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(200):
        pts, q = rng.normal(size=(5, 3)), rng.normal(size=3) * 2
        rows.append((q.tolist(), pts.min(0).tolist(), pts.max(0).tolist(), pts.tolist()))
    df = spark.createDataFrame(rows, "q array<double>, l array<double>, h array<double>, p array<array<double>>")
    from keysift.functions.vector import l2

    found = df.select(spatial.least_distance(F.col("q"), F.col("l"), F.col("h")).alias("b"), F.array_min(F.transform("p", lambda p: l2(p, F.col("q")))).alias("d"))
    assert all(r["b"] <= r["d"] for r in found.collect())


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    points = clustered(rng, 3000)
    points[1000:1400] = points[0]  # one vector that many share
    path = f"file://{tmp_path_factory.mktemp('tiles')}/t"
    rows = [(i, "AB"[i % 5 == 0], p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "position long, collection_id string, reduced array<double>")
    tree = spatial.fit_tree(points[::3], 3000, 30)
    spatial.tiled(df, ["collection_id"], tree, 30).write.partitionBy("collection_id", "tile").parquet(path)
    stored = spark.read.parquet(path)
    parts = spatial.boxes(stored, ["collection_id"], 4).withColumn("grain", F.lit("frames"))
    parts = parts.withColumn("part", F.explode(F.array(F.lit("all"), F.col("collection_id"))))
    held = {"frames": (stored.select("collection_id", "tile", "position", F.col("tile").alias("home"), "reduced"), ["collection_id", "tile"])}
    return points, np.array([r[1] for r in rows]), parts, held


def exact(points, mask, q, k):
    d = np.sqrt(((points - q) ** 2).sum(1))
    ids = np.flatnonzero(mask)
    order = sorted((d[i], i) for i in ids)
    kth = order[k - 1][0] if len(order) >= k else math.inf
    return {i for v, i in order if v <= kth + 1e-12}


def test_nearest_equals_a_full_scan(spark, tiles):
    points, names, parts, held = tiles
    rng = np.random.default_rng(4)
    asks = []
    for a in range(25):
        q = points[0] if a == 0 else points[rng.integers(3000)] + rng.normal(size=4) * (0.1 if a % 2 else 6)
        asks.append((a, ["all", "A", "B"][a % 3], q.tolist(), [1, 7, 60, 5000][a % 4]))
    asks.append((99, "none", [0.0] * 4, 3))
    found = spatial.nearest(spark.createDataFrame(asks, "ask int, part string, query array<double>, k int"), parts, held).collect()
    for a, part, q, k in asks:
        mine = [r for r in found if r["ask"] == a]
        mask = np.zeros(3000, bool) if part == "none" else np.ones(3000, bool) if part == "all" else names == part
        assert {r["position"] for r in mine} == exact(points, mask, np.array(q), k)
        assert all(r["place"] <= k for r in mine) and len(mine) == len({r["position"] for r in mine})


def test_nearest_opens_few_files(spark, tiles):
    points, _, parts, held = tiles
    table = held["frames"][0]
    every = files_read(table.select("position", "reduced"))
    opened = []
    scan = spatial.named

    def counted(table, wanted, keys):
        out = scan(table, wanted, keys)
        opened.append(files_read(out.select("position", "reduced")))
        return out

    spatial.named = counted
    try:
        asks = spark.createDataFrame([(0, "all", (points[77] + 0.05).tolist(), 10)], "ask int, part string, query array<double>, k int")
        assert {r["position"] for r in spatial.nearest(asks, parts, held).collect()} == exact(points, np.ones(3000, bool), points[77] + 0.05, 10)
    finally:
        spatial.named = scan
    assert every > 50 and sum(opened) < every / 5


def test_named_leaves_many_tiles_to_the_join(spark, tiles, monkeypatch):
    points, names, parts, held = tiles
    monkeypatch.setattr(spatial, "LITERALS", 1)
    asks = spark.createDataFrame([(0, "A", points[5].tolist(), 100)], "ask int, part string, query array<double>, k int")
    assert {r["position"] for r in spatial.nearest(asks, parts, held).collect()} == exact(points, names == "A", points[5], 100)


def test_near_words_loses_no_pair(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 11))) for _ in range(260)} | {"bicycle", "bicyclle", "bycicle", "trafic", "traffic"})

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    left, right = words[::2] + ["bicyclle", ""], words[1::2] + ["bicycle", "traffic", "trafic"]
    tables = spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in right], "target string")
    distance = {(a, b): levenshtein(a, b) for a in set(left) for b in set(right) if a and b}
    for share in (0.0, 0.07, 0.12, 0.2, 0.3):
        found = matching.near_words(*tables, share)
        got = {tuple(r) for r in found.collect()}
        assert got == {p for p, d in distance.items() if d <= share * (len(p[0]) + len(p[1])) + 1e-9}, share
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        matching.near_words(*tables, 0.4)


@pytest.mark.parametrize("least", [0.5, 0.667, 0.8, 0.9])
def test_join_terms_equals_all_pairs(spark, least):
    rng = random.Random(6)
    base = ["bicycle", "bicyclle", "bicycl", "traffic", "light", "trafic", "car", "red", "basketball", "basketbal", "living", "room", "livng", "rooom", "xe", "dap", "zebra", "zebras"]
    phrase = lambda most: " ".join(rng.choices(base, k=rng.randint(1, most)))
    phrases = [(i % 40, phrase(5)) for i in range(150)] + [(3, ""), (1, "xe dap")]
    terms = [(phrase(3),) for _ in range(80)] + [("",), ("a b c d e f g h i j k l",), ("xe dap",)] + [(w,) for w in base]
    got = matching.join_terms(
        spark.createDataFrame(phrases, "q int, candidate string"), spark.createDataFrame(terms, "target string"), ["q"], least=least
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {}
    for q, c in phrases:
        for (t,) in terms:
            s = matching.best_of([c], t)
            if s >= least:
                want[q, t] = max(s, want.get((q, t), 0))
    rows = {(r["q"], r["target"]): r["score"] for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)


QUERIES = [
    "xe đạp trên đường phố", "zzz qqq", "a dog and a bicyclle", "traffic light at night", "nguowif ddi xe ddapj", "Tìm người đi xe đạp", "people eating food in a kitchen",
    "phone on the table", "!!", "football match stadium",
]


def test_routing_a_table_equals_one_by_one(spark):
    catalog = Catalog()
    rng = np.random.default_rng(7)
    prototypes, vectors = rng.normal(size=(10, 6)).tolist(), rng.normal(size=(len(QUERIES), 6))
    df = spark.createDataFrame([(i, q, v.tolist()) for i, (q, v) in enumerate(zip(QUERIES, vectors))], "query_id int, query string, vector array<double>")
    analysed = analyses(df)
    aliases = routing.alias_terms(analysed, catalog)
    rows = routing.route_queries(analysed, aliases, catalog, prototypes).collect()
    prompts = dict(tuple(r) for r in routing.prompts(analysed, aliases).collect())
    words = routing.expanded(analysed, aliases).collect()
    for i, q in enumerate(QUERIES):
        a = analyze(spark, q)
        one = route(catalog, prototypes, a, vectors[i])
        mine = {r["domain_id"]: r for r in rows if r["query_id"] == i}
        assert {d: pytest.approx(r["score"]) for d, r in mine.items()} == one.scores and {d: pytest.approx(r["lexical"]) for d, r in mine.items()} == one.lexical
        assert tuple(r["domain_id"] for r in sorted(mine.values(), key=lambda r: r["place"]) if r["selected"]) == one.domain_ids
        assert prompts[i] == clip_prompt(catalog, q, a)
        assert sorted(r["term"] for r in words if r["query_id"] == i) == expanded(catalog, a)
    assert alias_terms(catalog, analyze(spark, QUERIES[0]))
    with pytest.raises(ValueError):
        routing.route_queries(analysed, aliases, catalog, prototypes[:3])


def test_encoding_on_executors_equals_the_driver(spark):
    coder = HashingEncoder(64)
    texts = ["a red bicycle", "", None, "A red BICYCLE", *[f"text number {i}" for i in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r["i"]: r["vector"] for r in encoded(df, "t", coder, batch=7).collect()}
    want = encode_texts(coder, texts)
    assert np.array_equal(np.array([got[i] for i in range(len(texts))]), want) and np.array_equal(want, encode_texts(coder, texts, batch=1000))
    assert encoder.model(HashingEncoder(64)) is encoder.model(coder)  # equal ones are loaded once
    assert encoded(df.limit(0), "t", coder).columns == ["i", "t", "vector"]


class Bad:
    """An encoder that gives too few rows, or values that aren't finite."""

    dimensions = 4

    def __init__(self, how):
        self.how = how

    def load(self):
        return (lambda texts: np.ones((1, 3))) if self.how == "shape" else (lambda texts: np.full((len(texts), 4), np.nan))


def test_bad_encoders_are_refused():
    for how in ("shape", "nan"):
        with pytest.raises(ValueError):
            encode_texts(Bad(how), ["a", "b"])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    coder = HashingEncoder(32)
    things = ["person", "bicycle", "dog", "car", "traffic light", "chair", "food", "book", "tree"]
    rows, vectors, found = [], [], []
    for i in range(240):
        c = f"L{21 + i % 3}"
        v = f"{c}_V{i % 4:03d}"
        rows.append((i, f"{v}_{i:06d}", c, v, i, i, i * 30, i * 1000, f"keyframes/{v}/{i:03d}.jpg", "" if i % 2 else f"videos/{v}.mkv"))
        vectors.append((v, i, (rng.normal(size=32)).tolist()))
        found += [(v, i, t, float(rng.uniform(0.2, 1.2))) for t in rng.choice(things, 2, replace=False)]
    manifest = spark.createDataFrame(
        rows, "position long, keyframe_id string, collection_id string, video_id string, keyframe_number int, clip_vector_index int, frame_number int, timestamp_ms long, image_path string, video_path string"
    )
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    clip = spark.createDataFrame(vectors, "video_id string, clip_vector_index int, vector array<float>")
    build(
        manifest, clip, spark.createDataFrame(found, "video_id string, keyframe_number int, term string, score double"), path, coder,
        options=BuildOptions(pca_dimensions=6, tile_rows=16), models={"text": "hashing"},
    )
    return Index.open(spark, path, whole=True), coder


def test_search_of_a_table_equals_single_searches(spark, index):
    held, coder = index
    asked = [(i, q, c) for i, (q, c) in enumerate(zip(QUERIES, [None, ["L21"], [" l22 "], None, ["L21", "L23"], None, ["L99"], None, None, ["L22"]]))]
    asked += [(20, "dog #L22 #l99", ["L21"]), (21, "#L21", None), (22, "", None), (23, "x", ["K1"]), (24, "y" * 501, None), (25, None, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string, collections array<string>")
    wrong = {r["query_id"]: r["error"] for r in batch.read_requests(queries).collect()}
    assert [i for i, e in wrong.items() if e] == [21, 22, 23, 24, 25] and "tags" in wrong[21] and "collection" in wrong[23]
    rows = batch.search_many(held, queries, coder, top_k=5).collect()
    for i, q, c in asked:
        mine = sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank"])
        if wrong[i]:
            assert not mine
            continue
        one = search.search(held, q, coder, collections=c or [], top_k=5).collect()
        assert [r["keyframe_id"] for r in mine] == [r["keyframe_id"] for r in one], q
        for x, y in zip(mine, one):
            x, y = x.asDict(), y.asDict()
            assert x.pop("score") == pytest.approx(y.pop("score")) and x.pop("score_components") == pytest.approx(y.pop("score_components"))
            assert {k: v for k, v in x.items() if k != "query_id"} == y
    with pytest.raises(ValueError):
        batch.search_many(held, queries, coder, top_k=0)


def test_candidates_equal_a_scan_of_the_parts(spark, index):
    held, coder = index
    vector = encode_texts(coder, ["a dog"])[0]
    point = np.array(held.pca.reduce_query(vector))
    found, trace = search.candidates(held, point.tolist(), ["animals", "people"], ["L21", "L22"], 500)
    rows = {(r["position"], r["collection_id"]): np.array(r["reduced"]) for r in held.frames.select("position", "collection_id", "reduced").collect()}
    members = {(r["collection_id"], r["domain_id"], r["position"]) for r in held.members.collect()}
    got = found.collect()
    for r in trace.collect():
        _, *key = r["tree_key"].split(":")
        own = {p: v for (p, c), v in rows.items() if c == key[0] and (len(key) == 1 or (c, key[1], p) in members)}
        order = sorted((math.sqrt(((v - point) ** 2).sum()), p) for p, v in own.items())
        assert {x["position"] for x in got if x["ord"] == r["ord"]} == {p for _, p in order[: r["requested"]]} and r["entry_count"] == len(own)
    assert sum(x["is_new"] for x in got) == len({x["position"] for x in got})


def test_an_index_with_missing_tables_is_refused(spark, index, tmp_path):
    import json
    import shutil

    held, _ = index
    for name, change in (("vocabulary", {"vocabulary_count": 1}), ("frames", {"record_count": 5})):
        at = tmp_path / name
        at.mkdir()
        shutil.copytree(held.path.removeprefix("file://"), at / "vx")
        (at / "CURRENT-000000000000-vx").touch()
        for f in (at / "vx/metadata").glob("*"):
            if not f.name.startswith((".", "_")):
                f.write_text(json.dumps(json.loads(f.read_text()) | change) + "\n")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            Index.open(spark, f"file://{at}")


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "position long, vector array<double>").repartition(7)
    n, mean, covariance = moments(df.select("vector"))
    assert n == 300 and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(x.T, bias=True))
    pca = fit_pca(df, 300, dimensions=3)
    _, _, vt = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.abs(np.array(pca.components) @ vt[:3].T), np.eye(3), atol=1e-6)
    assert all(c[int(np.argmax(np.abs(c)))] > 0 for c in np.array(pca.components))
    assert moments(df.limit(0).select("vector"))[0] == 0
    with pytest.raises(ValueError):
        fit_pca(df.filter("position = 0"), 1)
