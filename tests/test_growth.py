"""What grows with the input is worked out once, and a batch at a time."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import functions as F

from keysift.functions import text
from keysift.operators import index, spatial
from keysift.plans import catalog, standin

DATA = "/root/testdata/sf0.001"


def test_words_of_bytes_equal_those_of_characters():
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [*(f"a{c}b {c}" for c in every[:0x3000]), "".join(every[:256]), "".join(every), "Straße ÆON ÿ Đạp", "ΑΣ Kelvin K İx", "a b\x1fc d", ""]
    for t in texts:
        assert [w.decode() for w in text.words(t)] == t.lower().translate(text._PLAIN).split()
        assert text.plain(t) == " ".join(t.lower().translate(text._PLAIN).split())


def test_rerank_works_out_prototypes_once_and_scores_candidates_alone(spark, monkeypatch):
    calls, scored = [], []
    monkeypatch.setattr(catalog, "prototypes", lambda df: calls.append(1) or standin.prototypes(df))
    object_scores = catalog.bow.object_scores
    monkeypatch.setattr(catalog.bow, "object_scores", lambda bag, *rest: scored.append(bag.select("doc_id").distinct().count()) or object_scores(bag, *rest))
    rows = catalog.queries()["hybrid_rerank"](spark, DATA).collect()
    found = catalog._found(spark, DATA).select("position").distinct().count()
    assert len(rows) == catalog.TOP and len(calls) == 2  # of which one by the call of _found above
    assert 0 < scored[0] <= found


def test_leaves_and_boxes_a_batch_at_a_time_equal_those_of_the_plan(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(900, 3))
    points[7, 1] = points[8, 0] = np.nan
    rows = [(i, "AB"[i % 2] if i % 7 else None, i // 90, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "position long, part string, tile int, reduced array<double>")
    tree = spatial.fit_tree(points[20:], 900, 30)
    assert tree.leaves(df).withColumn("want", tree.leaf(F.col("reduced"))).filter("_leaf <> want or _leaf is null").count() == 0
    side = lambda f: F.array(*[f(F.get("reduced", F.lit(i))) for i in range(3)])
    want = df.groupBy("part", "tile").agg(F.count(F.lit(1)).alias("rows"), side(F.min).alias("low"), side(F.max).alias("high"))
    got = spatial.boxes(df, ["part"], 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_part_counts_equal_those_of_members(spark):
    rows = [("A", d, i) for i in range(30) for d in (["x", "y"] if i % 3 else ["y", "z"])] + [("B", d, i) for i in range(30, 40) for d in ("x", "z")]
    members = spark.createDataFrame(rows, "collection_id string, domain_id string, position long")
    want = {index.tree_key(r["collection_id"], r["domain_id"]): r["entries"] for r in index.tree_counts(members, ("w", "x", "y", "z")).collect()}
    own = members.withColumn("tile", F.col("position") % 4)
    tiles = own.select("collection_id", "position", "tile").distinct().groupBy("collection_id", "tile").agg(F.count(F.lit(1)).alias("rows"))
    tiles = tiles.withColumns({"domain_id": F.lit(None).cast("string"), "grain": F.lit("frames")})
    both = own.groupBy("collection_id", "tile", "domain_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("grain", F.lit("membership"))
    assert index.part_counts(tiles.unionByName(both), ("w", "x", "y", "z")) == want


def test_an_opened_index_lists_a_table_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/frames")
    opened = index.Index(spark, str(tmp_path), {})
    assert opened.frames is opened.frames
