"""Operator 7, best-fit packing of token pieces into sequences, by best-two-fit.

Only the number of pieces of each length decides what goes together, so the
packing is planned on a histogram with at most one row for each length: a bin is
filled greedily with the longest piece that fits; then its smallest piece is
replaced by two unpacked ones if those fit the expanded gap more tightly; the bin
is repeated as often as its lengths last.  Pieces are numbered within their
length, in blocks, and a number leads to its bin and place: no task sees more
than its share, and the plan doesn't grow with the input.

Defined cases: a null text is an empty one, whose only piece is the end id;
repeated rows are packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.encoding import encoder
from keysift.llm.scratch import blocks_for, give_back, hashed, number_within, stash
from keysift.ship import ship

CAPACITY = 1024
END = 2


def pieces(docs: DataFrame, tokenizer: str, *, kind: str = "byte", end: int = END, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, and its ids if asked for.

    A document of more than ``capacity`` ids is cut so that all pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, get = end.to_bytes(4, "little"), encoder(kind, tokenizer)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                raw = get(text or "") + tail
                n = len(raw) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    size = n % capacity or capacity if k == 0 else capacity
                    part = raw[4 * at : 4 * (at + size)]
                    row.append(r), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    at += size
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) that use up the histogram of lengths."""
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []

    def longest(most: int, used: Counter) -> int:
        """The longest length up to ``most`` of which a piece is unpacked; 0 if none."""
        i = bisect.bisect_right(lengths, most) - 1
        while i >= 0 and used[lengths[i]] >= left[lengths[i]]:
            i -= 1
        return lengths[i] if i >= 0 else 0

    while lengths:
        content: list[int] = []
        used: Counter = Counter()
        gap = capacity
        while gap and (n := longest(gap, used)):
            content.append(n)
            used[n] += 1
            gap -= n
        if gap and len(content) > 1:
            smallest = content.pop()
            used[smallest] -= 1
            room, best = gap + smallest, (smallest, 0)
            for a in lengths[: bisect.bisect_right(lengths, room)]:
                if used[a] >= left[a]:
                    continue
                used[a] += 1
                b = longest(min(a, room - a), used)
                used[a] -= 1
                if b and a + b > sum(best):
                    best = (a, b)
            content += [n for n in best if n]
            used = Counter(content)
        times = min(left[n] // c for n, c in used.items())
        out.append((tuple(sorted(content, reverse=True)), times))
        for n, c in used.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return out


def _ranges(bins: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, copies in a bin, first sequence, offset in the bin), in order of length and number."""
    rows, taken, sequence = [], Counter(), 0
    for content, times in bins:
        offset = 0
        for n, c in sorted(Counter(content).items(), reverse=True):
            rows.append((n, taken[n], c, sequence, offset))
            taken[n] += c * times
            offset += n * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (from :func:`pieces`) with ``sequence_id`` and ``offset``; it is read more than once, so it is kept in the shared folder."""
    spark = parts.sparkSession
    parts = stash(parts, "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a length
    ranges = _ranges(plan(histogram, capacity))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", "ids_crc32")]
    block = hashed(blocks_for(sum(histogram.values())), F.col("doc_id"), F.col("piece"))
    numbered = number_within(parts, "length", block, order, "_number")
    kept = list(parts.columns)
    names = [*kept, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = (ranges[:, 0] << 44) + ranges[:, 1]
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            at = ranges[np.searchsorted(begin, (length << 44) + number, side="right") - 1]
            k = number - at[:, 1]
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths) of each sequence; a sequence has at most ``CAPACITY`` pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))
