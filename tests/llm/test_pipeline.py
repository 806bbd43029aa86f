"""The stages of the pipeline, one after another, on the smallest tables."""

import sys
from pathlib import Path

from conftest import DATA

from keysift.llm import quality, scratch

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    benchmark = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before, docs = docs, scratch.stash(stage(spark, docs, DATA), "stage")
        if i + 1 < len(pipeline.STAGES):
            assert docs.columns == columns
            counts.append(docs.count())
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.measure(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "line dedup":
            assert docs.count() == before.count()
        if name == "decontamination":
            assert not [r for r in docs.collect() if any(b in r["text"] for b in benchmark)]
            assert [r for r in before.collect() if any(b in r["text"] for b in benchmark)]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    by = {}
    for r in docs.collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 1024 for v in by.values())
    assert pipeline.run(spark, DATA).count() == docs.count()


def test_entry_point_has_all_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
