"""Operator 9, token ids as Parquet list columns.

Documents are range-partitioned and sorted by doc_id, encoded where they lie and
written by Spark's Parquet writer: ids are dictionary-encoded (a vocabulary of
16 bits packs to two bytes an id) with delta encoding beyond the dictionary, row
groups and pages have set sizes, and pages carry an index, so a reader fetches
the tokens of a few documents, or the metadata alone, without the rest.

Defined cases: a null text is an empty one and has the end id alone; a null
doc_id comes first; rows with the same doc_id follow one another in the order
of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.encoding import batch_encoder
from keysift.llm.scratch import place, running_total
from keysift.ship import ship

END = 1
ROW_GROUP = 32 << 20
PAGE = 256 << 10
PAGE_ROWS = 2_000


def encode(docs: DataFrame, tokenizer: str, *, kind: str = "word", end: int = END) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document, the end id included."""

    def encoded(b: pa.RecordBatch) -> pa.RecordBatch:
        edges, found = batch_encoder(kind, tokenizer)(b.column(1))
        offsets = (edges + np.arange(len(edges))).astype("<i4")
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.insert(found, edges[1:], end)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype("<i8")), ids], names=["doc_id", "n_tokens", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield encoded(b)
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took

    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens bigint, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, *, kind: str = "word", end: int = END) -> None:
    """Writes the ids of ``docs`` in ascending doc_id order; file names sort in that order."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    (
        encode(ordered, tokenizer, kind=kind, end=end)
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )


def read(spark: SparkSession, path: str, *, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """The documents of a range of doc_ids; the range reaches the row groups and pages. Without ``ids`` no token is read."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df if ids else df.drop("ids")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32), from the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            offsets = column.offsets.to_numpy()
            raw = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offsets).astype("<i8")), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "ids_crc32"]
            )

    ship(tokens.sparkSession)
    key = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {key}, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = place(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = running_total(digests(read(spark, path)), read(spark, path, ids=False), "doc_id", "n_tokens", "start")
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
