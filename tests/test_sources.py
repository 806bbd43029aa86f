"""Matrices by ranges, listings on executors, file order, soft checks, the collection report."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.operators import prepare
from keysift.sources import dataset, files


@pytest.mark.parametrize("split", [1, 130, 7000, 1 << 26])
def test_matrices_are_cut_into_ranges_of_rows(spark, tmp_path, split):
    rng = np.random.default_rng(1)
    known = {
        "L1_V001": rng.normal(size=(90, 8)).astype(np.float32), "L1_V002": np.asfortranarray(rng.normal(size=(40, 8))), "L1_V003": np.zeros((0, 8), np.float32),
        "L1_V004": rng.integers(0, 9, (7, 8)), "L1_V005": rng.normal(size=(33, 3)).astype(np.float16),
    }
    known = known if split > 1 else {"L1_V003": known["L1_V003"], "L1_V004": known["L1_V004"][:2]}
    for name, x in known.items():
        np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / "other.txt").write_text("x")
    df = files.matrices(spark, f"file://{tmp_path}", split)
    got = {(r["video_id"], r["clip_vector_index"]): r["vector"] for r in df.collect()}
    assert len(got) == sum(len(x) for x in known.values()) == df.count()
    assert all(np.array_equal(np.float32(got[name, i]), np.float32(row)) for name, x in known.items() for i, row in enumerate(x))
    parts = df.rdd.getNumPartitions()
    assert parts > len(known) if split < 7000 else parts == len(known)


def test_broken_matrices_are_refused(spark, tmp_path):
    for name, x in (("cube", np.zeros((2, 2, 2))), ("objects", np.array([["a", "b"]], object)), ("text", np.array([["a", "b"]]))):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "v.npy", x, allow_pickle=True)
        with pytest.raises(Exception, match="dimensions|numbers"):
            files.matrices(spark, f"file://{tmp_path}/{name}").collect()
    (tmp_path / "cut").mkdir()
    np.save(tmp_path / "cut/v.npy", np.ones((50, 4), np.float32))
    raw = (tmp_path / "cut/v.npy").read_bytes()
    for part, message in ((raw[:300], "bytes"), (b"no matrix", "no matrix file")):
        (tmp_path / "cut/v.npy").write_bytes(part)
        with pytest.raises(Exception, match=message):
            files.matrices(spark, f"file://{tmp_path}/cut").collect()
    assert files.matrices(spark, f"file://{tmp_path}/nothing").count() == 0


def test_listings(spark, tmp_path):
    root = f"file://{tmp_path}"
    for d in ("k/L1_V2", "k/L1_V1", "k/empty one"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("k/L1_V1/001.jpg", "k/L1_V1/002.jpg", "k/L1_V2/001.png", "k/map.csv", "k/.csv"):
        (tmp_path / f).write_text("x")
    ids = lambda **how: [r["id"] for r in dataset.children(spark, f"{root}/k", **how).collect()]
    assert ids(folders=True) == ["L1_V1", "L1_V2", "empty one"] and ids(suffix=".csv") == ["", "map"] and ids() == [".csv", "map.csv"]
    assert dataset.children(spark, f"{root}/none", folders=True).count() == 0
    found = files.below(dataset.children(spark, f"{root}/k", folders=True), f"{root}/k", 2)
    assert sorted(tuple(r) for r in found.collect()) == [("L1_V1", "001.jpg", 1), ("L1_V1", "002.jpg", 1), ("L1_V2", "001.png", 1)]
    assert not files.reachable("viewfs://store/in") and files.reachable("/a/b")


def test_file_order_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "m").mkdir()
    rng, want = random.Random(2), []
    for name, n in (("a", 40), ("b", 900), ("c", 3)):  # the largest file isn't the first
        rows = [(name, i, "x" * rng.randint(0, 60)) for i in range(n)]
        want += [r[:2] for r in rows]
        (tmp_path / f"m/{name}.csv").write_text("f,i,t\n" + "".join(f"{f},{i},{t}\n" for f, i, t in rows))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("2000", "7000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = dataset.in_file_order(spark.read.option("header", True).csv(f"file://{tmp_path}/m"), "at")
            got = [(r["at"], r["f"], int(r["i"])) for r in df.collect()]
            assert sorted(got) == [(k, *w) for k, w in enumerate(want)], size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


MANIFEST = "line int, keyframe_id string, collection_id string, video_id string, frame_number string, timestamp_ms string, image_path string, video_path string"


def test_soft_checks_part_rows_in_one_scan(spark):
    rows = [
        (1, "L1_V1_000003", "l1", "L1_V1", "9", "300", "k/3.jpg", ""), (2, "L1_V1_000004", "L1", "L1_V1", "x", "", "../4.jpg", ""),
        (3, "L1_V1_000005", "L1", "L1_V1", "1", "1", "k/5.jpg", "a/../../v.mp4"), (4, "L1_V1_000003", "L1", "L1_V1", "9", "300", "k/3.jpg", ""),
        (5, "", "L1", "", "1", "1", "k/6.jpg", ""), (6, "L1_V1_000007", "L1", "L1_V1", "1", "1", "k/7.jpg", None),
    ]
    raw = spark.createDataFrame(rows, MANIFEST)
    found = dataset.check_records(raw)
    assert (found.rows, found.broken) == (6, 5)
    assert found.counts == {"keyframe_id": 1, "video_id": 1, "video_path": 1, "keyframe_number": 1, "frame_number": 1, "timestamp_ms": 1, "image_path": 1, "repeated keyframe_id": 2}
    assert [r["line"] for r in found.good.collect()] == [6] and sorted(r["line"] for r in found.bad.collect()) == [1, 2, 3, 4, 5]
    errors = {r["line"]: r["errors"] for r in found.bad.collect()}
    assert errors[2] == ["frame_number", "timestamp_ms", "image_path"] and errors[3] == ["video_path"] and errors[1] == errors[4] == ["repeated keyframe_id"]
    plan = dataset.judged(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # one scan
    with pytest.raises(ValueError, match="frame_number"):
        dataset.records(raw)
    empty = dataset.check_records(raw.limit(0))
    assert (empty.rows, empty.broken, empty.counts) == (0, 0, {})


def test_collection_report(spark, tmp_path):
    manifest = spark.createDataFrame([("L1", "a"), ("L1", "b"), ("L1", "b"), ("L2", "c"), ("L3", "d")], "collection_id string, video_id string")
    mapped = spark.createDataFrame(
        [(0, "L1", "a"), (0, "L1", "x"), (1, "L2", "b"), (1, "L2", "c"), (2, "L4", None), (3, "L1", "a")], "entry int, collection_id string, video_id string"
    )
    got = {(r["problem"], r["collection_id"], r["video_id"]): r["n"] for r in prepare.collection_report(manifest, mapped).collect()}
    assert got == {
        ("repeated collection", "L1", None): 2, ("repeated video", None, "a"): 2, ("missing collection", "L3", None): 1, ("extra collection", "L4", None): 1,
        ("missing video", None, "d"): 1, ("extra video", None, "x"): 1, ("missing in collection", "L1", "b"): 1, ("missing in collection", "L3", "d"): 1,
        ("extra in collection", "L1", "x"): 1, ("extra in collection", "L2", "b"): 1,
    }
    prepare.write_collections(manifest, f"file://{tmp_path}/map")
    written = prepare.read_collections(spark, f"file://{tmp_path}/map")
    assert prepare.collection_report(manifest, written).count() == 0
    assert prepare.collection_report(manifest.limit(0), mapped.limit(0)).count() == 0


def test_scan_reports_examples_and_all_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prepare, "EXAMPLES", 2)
    for i in range(5):
        (tmp_path / f"keyframes/L1_V00{i}").mkdir(parents=True)
        if i:
            (tmp_path / f"objects/L1_V00{i}").mkdir(parents=True)
    report = prepare.scan(spark, f"file://{tmp_path}")
    assert report.missing["media-info"] == ["L1_V000", "L1_V001"] and report.missing["objects"] == ["L1_V000"]
    assert report.missing_counts == {"objects": 1, "media-info": 5, "map-keyframes": 5, "clip-features-32": 5}
    assert report.missing_ids.count() == 16 and not report.valid
    assert report.missing_ids.filter(F.col("source") == "objects").first()["id"] == "L1_V000"
