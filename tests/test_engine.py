import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.functions import matching, text, vector
from keysift.functions.encoder import hashing_encoder
from keysift.operators import prepare
from keysift.operators.domains import Catalog, analyze, clip_prompt, route
from keysift.operators.index import BuildOptions, Index, build
from keysift.operators.search import Request, candidates, check_request, function_at, inspect, read_request, search, with_urls
from keysift.sources import dataset, versions


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_equals_unicodedata(spark):
    rng = random.Random(1)
    alphabet = "aAzZ09 _-đĐßéÉñüœǅﬁİıſÅåøØệỚ̈中Ω ½²ª"
    values = ["", "Người đi xe đạp", "Straße ﬁne İstanbul", *["".join(rng.choices(alphabet, k=12)) for _ in range(300)]]

    def plain(s):
        s = "".join(c for c in unicodedata.normalize("NFD", s.casefold().replace("đ", "d")) if unicodedata.category(c) != "Mn")
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s).split())

    assert column(spark, values, text.normalize) == [plain(v) for v in values]


def test_candidates(spark):
    a = analyze(spark, "Tìm người đi xe đạp")
    assert a.normalized == "tim nguoi di xe dap" and "xe dap" in a.candidates
    b = analyze(spark, "nguowif ddi xe ddapj")
    assert {"nguoi di xe dap", "xe dap"} <= set(b.candidates)
    assert analyze(spark, "").candidates == () and analyze(spark, "!!").candidates == ()
    assert len(analyze(spark, " ".join(f"word{chr(97 + i)}" for i in range(25))).candidates) == text.MAX_CANDIDATES


def test_query_repairs(spark):
    for f, given, want in (
        (text.drop_word_digits, "abc12 a1b 12", "abc a1b 12"),
        (text.single_final_letter, "carr aa bus glass bicyclee", "car aa bus glass bicycle"),
        (text.drop_tone_letter, "boats bus css cat", "boat bus css cat"),
        (text.resolve_telex, "nguowif food boats", "nguoi fod boats"),
    ):
        assert column(spark, [given], f) == [want]


def test_tags_and_paths(spark):
    assert column(spark, ["red shirt #L21 #l22 #L21"], text.collection_tags) == [["L21", "L22"]]
    assert column(spark, ["red #shirt #L21", "#L21"], text.untagged) == ["red shirt", ""]
    assert column(spark, ["\\a\\b", "//x/y", "a/../b", "a..b/c"], text.safe_path) == ["a/b", "x/y", None, "a..b/c"]
    assert check_request("x", [" l21", "L21", "L3"], 5) == ["L21", "L3"]
    for bad in (("", [], 5), ("x", [], 101), ("x", ["L"], 5), ("x" * 501, [], 5)):
        with pytest.raises(ValueError):
            check_request(*bad)


def test_match_scores():
    assert matching.best_of(["bicyclle"], "bicycle") >= 0.80
    assert matching.best_of(["tri"], "traffic") == 0.0
    assert matching.best_of(["a red car there"], "red car") == 0.97
    assert matching.best_of(["xe dap"], "xe dap") == 1.0
    assert matching.best_of(["", "x"], "") == 0.0


def test_plan_matches_as_the_driver_does(spark):
    rng = random.Random(2)
    words = ["bicycle", "bicyclle", "traffic", "light", "trafic", "car", "red", "basketball", "basketbal", "living", "room", "livng", ""]
    pairs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))).strip(), " ".join(rng.choices(words, k=rng.randint(1, 3))).strip()) for i in range(400)]
    pairs = [(i, " ".join(c.split()), " ".join(t.split())) for i, c, t in pairs]
    got = {r["i"]: r["score"] for r in matching.best_match(spark.createDataFrame(pairs, "i int, candidate string, target string"), ["i"], least=1e-9).collect()}
    for i, c, t in pairs:
        assert got.get(i, 0.0) == pytest.approx(matching.best_of([c], t)), (c, t)


def test_edit_distance_prefilter_is_lossless():
    rng = random.Random(3)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(2))
        assert levenshtein(a, b) <= (len(a) + len(b)) * (1 - SequenceMatcher(None, a, b).ratio()) + 1e-9


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<float>")
    rows = df.select(vector.norm(F.col("v")).alias("n"), vector.valid(F.col("v")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False] and rows[0]["n"] == 5
    assert column(spark, [0.0005, 0.0015, 3.0], vector.half_even_ms, "double") == [0, 2, 3000]
    for rows_, n in ((10, 4), (3, 10), (1, 5), (0, 5), (1000, 37)):
        got = spark.range(1).select(vector.linspace_positions(rows_, n)).first()[0]
        assert got == np.linspace(0, rows_ - 1, min(rows_, n), dtype=np.int64).tolist() if rows_ else got == []


def test_detector_layouts(spark):
    given = [
        '{"detection_scores": ["0.91", "0.30", "0.10"], "detection_class_entities": ["Human face", "Bicycle", "Noise", "Cut"]}',
        '{"detection_class_entities": ["Car"]}',
        '[{"label": "Dog", "confidence": 0.5}, {"name": "Cat"}, {"label": "x", "score": null}, 3]',
        '﻿{"results": [{"entity": "", "class_name": "Tree", "score": "0.4"}]}',
        "not json",
        '{"detection_scores": [], "detection_class_entities": ["Car"]}',
        None,
    ]
    got = [[(d["term"], d["score"]) for d in row] for row in column(spark, given, dataset.parse_detections)]
    assert got == [[("human face", 0.91), ("bicycle", 0.3), ("noise", 0.1)], [("car", 1.0)], [("dog", 0.5), ("cat", 1.0)], [("tree", 0.4)], [], [], []]


def test_package_list(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Filenames,Download link\nKeyframes_L21.zip,http://a\n,http://b\nother.zip,http://c\n")
    rows = dataset.packages(spark, f"file://{tmp_path}/p.csv").collect()
    assert [(r["filename"], r["group"]) for r in rows] == [("Keyframes_L21.zip", "keyframes"), ("other.zip", "other")]
    with pytest.raises(ValueError):
        dataset.packages(spark, f"file://{tmp_path}/p.csv", ("videos",))
    urls = ["https://x/spreadsheets/d/ab/edit?gid=7#gid=9", "https://x/d/ab/edit#gid=9", "https://x/d/ab", "https://x/ab"]
    assert [u and u[-5:] for u in column(spark, urls, dataset.sheet_csv_url)] == ["gid=7", "gid=9", "gid=0", None]


@pytest.fixture
def files(tmp_path):
    for d in ("keyframes/L21_V001", "map-keyframes", "media-info", "objects/L21_V001", "clip-features-32"):
        (tmp_path / d).mkdir(parents=True)
    for n in (1, 2):
        (tmp_path / f"keyframes/L21_V001/{n:03d}.jpg").write_bytes(b"x")
    (tmp_path / "keyframes/L21_V001/0001.png").write_bytes(b"x")
    (tmp_path / "map-keyframes/L21_V001.csv").write_text("﻿n,frame_idx,pts_time\r\n1,0,0\r\n2,90,3.0\r\n")
    (tmp_path / "media-info/L21_V001.json").write_text("{}")
    (tmp_path / "objects/L21_V001/001.json").write_text('{"detection_scores": ["0.9"], "detection_class_entities": ["Person"]}')
    (tmp_path / "objects/L21_V001/002.json").write_text('{"detection_scores": ["0.9", "0.9"], "detection_class_entities": ["Person", "Bicycle"]}')
    np.save(tmp_path / "clip-features-32/L21_V001.npy", np.eye(2, 4, dtype=np.float32))
    return tmp_path


class Encoder:
    def __call__(self, texts):
        if len(texts) > 1:
            return np.eye(4)[[i % 4 for i in range(len(texts))]]
        return np.eye(4)[[1 if "bicycle" in texts[0] or "xe đạp" in texts[0] else 0]]


def test_from_files_to_search(spark, files):
    root = f"file://{files}"
    report = prepare.scan(spark, root)
    assert report.valid and report.common == 1 and report.collections == {"L21": 1}
    deep = prepare.scan(spark, root, deep=True)
    assert not deep.valid  # 0001.png is one image more than the map has rows
    (files / "keyframes/L21_V001/0001.png").unlink()
    assert prepare.scan(spark, root, deep=True).valid

    rows = prepare.build_manifest(spark, root, f"{root}/manifest")
    got = [tuple(r) for r in rows.collect()]
    assert got[1] == ("L21_V001_000002", "L21", "L21_V001", 2, 1, 90, 3000, "keyframes/L21_V001/002.jpg", "")
    manifest = dataset.manifest(spark, f"{root}/manifest")
    assert [(r["position"], r["keyframe_id"]) for r in manifest.orderBy("position").collect()] == [(0, "L21_V001_000001"), (1, "L21_V001_000002")]
    assert [tuple(r) for r in prepare.collections(manifest).collect()] == [("L21", ["L21_V001"])]

    vectors, found = dataset.vectors(spark, f"{root}/clip-features-32"), dataset.detections(spark, f"{root}/objects")
    options = BuildOptions(pca_dimensions=2, pca_sample_size=2, domains_per_frame=1)
    meta = build(manifest, vectors, found, f"{root}/index", Encoder(), options=options)
    assert meta["record_count"] == 2 and meta["tree_counts"]["global"] == 2
    index = Index.open(spark, f"{root}/index")
    idf = {r["term"]: r["idf"] for r in index.vocab.collect()}
    assert idf["person"] < idf["bicycle"] == 1.0
    top = search(index, "xe đạp", Encoder(), collections=["l21"], top_k=1).collect()
    assert [r["keyframe_number"] for r in top] == [2] and "bicycle" in top[0]["matched_objects"]
    assert top[0]["video_path"] == "videos/L21_V001.mp4" and top[0]["rank"] == 1
    seen = inspect(index, "nguowif ddi xe ddapj", Encoder(), collections=["L21"], top_k=1)
    assert seen["routing"]["domains"][0]["domain_id"] == "transport"
    assert seen["candidate_trace"]["unique_candidate_count"] == 2
    assert any(t["tree_key"].startswith("collection_domain:L21:") and t["entry_count"] for t in seen["candidate_trace"]["trees"])
    assert search(index, "xe đạp", Encoder(), collections=["L99"], top_k=1).count() == 0
    with pytest.raises(ValueError):
        search(index, "  ", Encoder())
    with pytest.raises(ValueError):
        index.pca.reduce_query([1.0])
    with pytest.raises(ValueError):
        build(manifest, vectors.filter("clip_vector_index = 0"), found, f"{root}/index", Encoder(), options=options)
    assert Index.open(spark, f"{root}/index").path == index.path  # a failed build leaves the current index


def test_missing_source_is_reported(spark, tmp_path):
    (tmp_path / "keyframes/L21_V001").mkdir(parents=True)
    report = prepare.scan(spark, f"file://{tmp_path}")
    assert not report.valid and report.errors and "objects" in report.missing
    with pytest.raises(ValueError):
        prepare.build_manifest(spark, f"file://{tmp_path}").count()


def test_manifest_rules(spark):
    schema = "line int, keyframe_id string, collection_id string, video_id string, frame_number string, timestamp_ms string, image_path string, video_path string"
    good = (1, " L1_V1_000003 ", "l1", "L1_V1", "9", "300", "\\k\\3.jpg", "")
    rows = dataset.records(spark.createDataFrame([good, (2, "L1_V1_000004", "L1", "L1_V1", "12", "400", "k/4.jpg", "v.mp4")], schema)).orderBy("position").collect()
    assert [(r["keyframe_number"], r["clip_vector_index"], r["collection_id"], r["image_path"]) for r in rows] == [(3, 0, "L1", "k/3.jpg"), (4, 1, "L1", "k/4.jpg")]
    for bad in ([good, good], [], [(1, "a_1", "L1", "v", "x", "1", "p", "")], [(1, "a_1", "L1", "v", "1", "1", "../p", "")]):
        with pytest.raises(ValueError):
            dataset.records(spark.createDataFrame(bad, schema))


def test_request_is_read_as_written():
    assert read_request("  #L21 người #xe  đạp #l3 ", [" l3 ", "L5"], 7) == Request("người xe đạp", ("L3", "L5", "L21"), 7)
    assert read_request("#L21x y").collections == ()
    for bad in (("#L21 #l3",), ("   ",), ("",), ("x" * 501,), ("x", ["K1"]), ("x", [], 0), ("x", [], 101), ("x", ["L1"] * 51)):
        with pytest.raises(ValueError):
            read_request(*bad)
    assert function_at("keysift.operators.search.search") is search
    for bad in ("search", "keysift.operators.search.none", "no.such.module"):
        with pytest.raises(LookupError):
            function_at(bad)


def test_hashing_encoder():
    encode = hashing_encoder(256)
    v = encode(["a red bicycle", "A red BICYCLE", "red bicycles", "stormy weather", ""])
    assert v.shape == (5, 256) and np.allclose(np.linalg.norm(v, axis=1), 1) and np.array_equal(v, encode(["a red bicycle", "A red BICYCLE", "red bicycles", "stormy weather", ""]))
    assert np.array_equal(v[0], v[1]) and v[0] @ v[2] > 0.5 > v[0] @ v[3]
    assert encode([]).shape == (0, 256)


def test_client_rows(spark):
    rows = spark.createDataFrame([("\\\\k\\1.jpg", " ", "L1_V1", 5), ("k/2.jpg", "/v/x.mp4", "L1_V1", 6)], "image_path string, video_path string, video_id string, frame_number int")
    got = [tuple(r) for r in with_urls(rows, "http://h/d/").select("image_url", "video_url", "frame_id").collect()]
    assert got == [("http://h/d/k/1.jpg", "http://h/d/videos/L1_V1.mp4", 5), ("http://h/d/k/2.jpg", "http://h/d/v/x.mp4", 6)]


def test_manifest_errors(spark):
    schema = "keyframe_id string, collection_id string, video_id string, frame_number string, timestamp_ms string, image_path string"
    rows = spark.createDataFrame([("a", "L1", "L1_V1", "0", "0", "1"), ("b", "L2", "L1_V1", "-1", "x", "2"), ("b", "L1", "bad", "1", None, "2")], schema)
    images = spark.createDataFrame([("1",)], "image_path string")
    got = sorted(tuple(r) for r in prepare.manifest_errors(rows, images).collect())
    every = [("b", e) for e in ("collection_id", "collection_id", "frame_number", "no image", "no image", "timestamp_ms", "timestamp_ms", "repeated keyframe_id")]
    assert got == sorted([*every, ("2", "repeated image_path")])
    assert prepare.manifest_errors(rows.limit(0), images).count() == 0


def test_positions_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("line"), "id").repartition(5)
    got = sorted((r["line"], r["position"]) for r in dataset.positions(df, "line", splits=16).collect())
    assert [p for _, p in got] == list(range(1000))
    assert dataset.positions(df.limit(0), "line").count() == 0


def test_set_differences_and_collection_sink(spark, tmp_path):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("a", 2), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in prepare.differences(left, right, "k", "v").collect()) == [("a", 1, "left"), ("c", 4, "right")]
    rows = spark.createDataFrame([("L1", "L1_V2"), ("L1", "L1_V1")], "collection_id string, video_id string")
    prepare.write_collections(rows, f"file://{tmp_path}/c")
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/c").collect()] == [("L1", ["L1_V1", "L1_V2"])]


def test_set_comparison(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([("a", 2), ("c", 4)], "k string, v int")
    got = sorted(tuple(r) for r in prepare.compare_sets(left, right, "k", "v").collect())
    assert got == [("a", [1], []), ("b", [3], []), ("c", [], [4])]


def test_routing(spark):
    catalog = Catalog()
    assert len(catalog.domains) == 10 and len(catalog.aliases) == 61
    a = analyze(spark, "xe đạp trên đường phố")
    r = route(catalog, np.eye(10).tolist(), a, np.eye(10)[8])
    assert r.domain_ids[0] == "transport" and {"bicycle", "street"} <= set(r.expanded)
    assert clip_prompt(catalog, "xe đạp", analyze(spark, "xe đạp")) == "xe đạp. Visual concepts: bicycle."
    silent = route(catalog, np.eye(10).tolist(), analyze(spark, "zzz qqq"), np.eye(10)[8])
    assert silent.domain_ids[0] == "animals" and max(silent.lexical.values()) == 0
    with pytest.raises(ValueError):
        route(catalog, np.eye(3).tolist(), a, np.eye(3)[0])


def test_versions(spark, tmp_path):
    at = f"file://{tmp_path}/x"
    for v in (1, 2, 3):
        with versions.publish(spark, at) as path:
            spark.createDataFrame([(v,)], "v int").write.parquet(f"{path}/t")
    assert spark.read.parquet(f"{versions.current(spark, at)}/t").first()[0] == 3
    with pytest.raises(KeyError):
        with versions.publish(spark, at):
            raise KeyError
    assert spark.read.parquet(f"{versions.current(spark, at)}/t").first()[0] == 3
    assert len([p for p in (tmp_path / "x").iterdir() if p.is_dir()]) == 2
    with pytest.raises(FileNotFoundError):
        versions.current(spark, f"file://{tmp_path}/none")


def test_tree_counts_keep_empty_parts(spark):
    from keysift.operators.index import tree_counts

    members = spark.createDataFrame([("L21", "a", 0), ("L21", "b", 0), ("L22", "a", 1)], "collection_id string, domain_id string, position long")
    got = {(r["collection_id"], r["domain_id"]): r["entries"] for r in tree_counts(members, ("a", "b", "c")).collect()}
    some = {(None, None): 2, ("L21", None): 1, ("L22", None): 1, (None, "a"): 2, (None, "b"): 1, ("L21", "a"): 1, ("L21", "b"): 1, ("L22", "a"): 1}
    assert got == some | {(None, "c"): 0, ("L21", "c"): 0, ("L22", "b"): 0, ("L22", "c"): 0}
    assert {(r["collection_id"], r["domain_id"]): r["entries"] for r in tree_counts(members).collect()} == some


def test_candidates_ignore_unknown_parts(spark, files):
    (files / "keyframes/L21_V001/0001.png").unlink()
    root = f"file://{files}"
    prepare.build_manifest(spark, root, f"{root}/manifest")
    build(
        dataset.manifest(spark, f"{root}/manifest"), dataset.vectors(spark, f"{root}/clip-features-32"), dataset.detections(spark, f"{root}/objects"),
        f"{root}/index", Encoder(), options=BuildOptions(pca_dimensions=2, pca_sample_size=2),
    )
    index = Index.open(spark, f"{root}/index")
    found, trace = candidates(index, [0.0, 0.0], ["transport", "nowhere"], ["L21", "L99"], 500)
    rows = trace.collect()
    assert all("L99" not in r["tree_key"] and "nowhere" not in r["tree_key"] for r in rows)
    assert rows[-1]["role"] == "fallback" and rows[-1]["requested"] == 166
    assert found.filter("is_new").count() == 2
