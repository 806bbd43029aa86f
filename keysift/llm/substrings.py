"""Operator 13, removal of repeated substrings by bucket-pointer refinement.

Every string of ``length`` bytes that starts at two places or more is removed at all of them.
As in a suffix sorter by bucket-pointer refinement, strings with the same leading q-gram share a
bucket, and a bucket is refined by the identifiers of the buckets at later offsets:
an identifier of 2 k bytes is made of those of k bytes here and k bytes later, again and again, up
to q; longer strings are named by the q-gram identifiers at their offsets.  As only equality over
``length`` bytes counts, buckets are refined until they tell strings of that length apart, and
are never put in order.

A corpus has far more strings than a shuffle can carry, so they are dealt in pieces.  A string
belongs to the bucket of its least q-gram (by identifier, the first of equal ones), which equal
strings have at the same offset; strings in a row with the same such place are one piece, some 85 of them.

1. Buckets with one piece have no repeats; they go first, and with them most of a corpus.
2. Pieces with the same text from their first string's start to their last one's end are repeated whole.
3. The others of a bucket that has any, with one of each group of equal pieces, are cut
   into blocks by the offset of the bucket's q-gram.  What all strings of a block have in common must
   occur twice, else none of them does; a block whose whole text occurs twice is repeated whole.
4. What is still open is compared string by string.

So a bucket of any size costs its rows: pieces are only counted and joined by keys, no two
of them are compared, and no group is gathered in one task.  Names have 128 bits (buckets 64, whose clashes only
cost work); NumPy computes them in Arrow batches, a slice of a batch at a time.  A document is known by
128 bits of its doc_id and text; its removed places are joined to its text at the end.

Defined cases: a null text is empty; documents shorter than ``length`` lose nothing; rows
with equal doc_id and text are repeats of each other; in a text that is one string over and over
each place is a piece of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.scratch import remove, stash, tidy
from keysift.ship import ship

LENGTH = 200
SLICE = 1 << 18  # strings named at once
_U = np.uint64
# Odd multipliers, digits of pi and of the golden ratio.
_A, _B, _C, _D = (_U(x) for x in (0x9E3779B97F4A7C15, 0x243F6A8885A308D3, 0xC2B2AE3D27D4EB4F, 0x13198A2E03707345))


def _mix(x: np.ndarray, y: np.ndarray, by: np.uint64 = _A) -> np.ndarray:
    """One identifier for two."""
    z = x * by
    z ^= y * _B
    z ^= (z >> _U(29)) ^ (y >> _U(32))
    z *= _C
    z ^= z >> _U(32)
    return z


@dataclass(frozen=True)
class Strings:
    """How strings are named: their length, that of q-grams (8 times a power of two) and of blocks."""

    length: int = LENGTH
    q: int = 32
    block: int = 16

    def __post_init__(self) -> None:
        if self.q % 8 or self.q & (self.q - 1) or self.block < 1 or self.length - self.block + 1 < self.q:
            raise ValueError(f"{self}: q is 8 times a power of two, and what a block's strings share holds a q-gram")

    def grams(self, text: np.ndarray) -> np.ndarray:
        """The identifier of the q-gram at each place, by doubling."""
        n = len(text) - self.q + 1
        if n <= 0:
            return np.empty(0, _U)
        x, width = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,)).copy(), 8
        while width < self.q:
            x = _mix(x[:-width], x[width:])
            width *= 2
        return _mix(x, x) if self.q == 8 else x

    def names(self, grams: np.ndarray, start: np.ndarray, stop: np.ndarray, salt: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each text from start to stop, of the identifiers at its offsets."""
        size = stop - start
        one, two = size.astype(_U) * _D + _U(1), (size + np.int64(1) + salt).astype(_U) * _C
        for at in range(0, int(size.max(initial=0)), self.q):
            x = grams[np.minimum(start + at, stop - self.q)]
            one, two = _mix(one, x), _mix(two, x, _D)
        return one.view(np.int64), two.view(np.int64)

    def pieces(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, start, n, off, bucket, name, name) of the pieces of the documents of a batch: where its strings start, how many they are, and how far from the start the bucket's q-gram is."""
        width = self.length - self.q + 1
        for a in range(0, len(text), SLICE):
            part = text[a : a + SLICE + self.length - 1]
            n = len(part) - self.length + 1
            if n <= 0:
                break
            grams = self.grams(part)
            least = (grams >> _U(32) << _U(32)) | np.arange(len(grams), dtype=_U)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[: n], least[width - span : width - span + n])
            owner = (least & _U(0xFFFFFFFF)).astype(np.int64)
            cut = np.ones(n, bool)
            np.not_equal(owner[1:], owner[:-1], out=cut[1:])
            for edges in (offsets - a, offsets - self.length + 1 - a):
                cut[edges[(edges >= 0) & (edges < n)]] = True
            start = np.flatnonzero(cut)
            count = np.diff(np.append(start, n))
            doc = np.searchsorted(offsets, start + a, "right") - 1
            good = start + a + self.length <= offsets[doc + 1]
            start, count, doc = start[good], count[good], doc[good]
            at = owner[start]
            names = self.names(grams, start, start + count - 1 + self.length)
            yield doc, start + a - offsets[doc], count, at - start, grams[at].view(np.int64), *names


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and where each value begins, the end last."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _out(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


_PIECE = "k1 bigint, k2 bigint, start bigint, n int, off int, bucket bigint, w1 bigint, w2 bigint"
_KEY = ["k1", "k2"]


def _buckets(docs: DataFrame, how: Strings) -> DataFrame:
    """(bucket, n): how many pieces a slice of the texts has of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in how.pieces(*_texts(b.column(0))):
                bucket, n = np.unique(piece[4], return_counts=True)
                yield _out("bucket n", bucket, n)

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint")


def _pieces(docs: DataFrame, how: Strings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (b.column(i).to_numpy() for i in (0, 1))
            for doc, start, n, off, bucket, w1, w2 in how.pieces(*_texts(b.column(2))):
                yield _out("k1 k2 start n off bucket w1 w2", k1[doc], k2[doc], start, n.astype(np.int32), off.astype(np.int32), bucket, w1, w2)

    return docs.select(*_KEY, "text").mapInArrow(run, _PIECE)


def _asked(docs: DataFrame, units: DataFrame, how: Strings, answer, schema: str) -> DataFrame:
    """``answer(grams, at, k1, k2, start, n, off, open)`` for units of strings, with the identifiers of their texts; ``at``: where each one's text begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(3)
            fields = [asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            doc = np.repeat(np.arange(len(b)), np.diff(asked.offsets.to_numpy()))
            k1, k2 = (b.column(i).to_numpy()[doc] for i in (0, 1))
            data, offsets = _texts(b.column(2))
            first, size = offsets[doc] + fields[0], fields[1] + how.length - 1
            ends = np.cumsum(size)
            x = 0
            while x < len(doc):
                y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + SLICE, "right")))
                at = np.cumsum(size[x:y]) - size[x:y]
                text = np.concatenate([data[s : s + n] for s, n in zip(first[x:y].tolist(), size[x:y].tolist())])
                yield answer(how.grams(text), at, k1[x:y], k2[x:y], *(f[x:y] for f in fields))
                x = y

    own = units.groupBy(*_KEY).agg(F.collect_list(F.struct("start", F.col("n").cast("long"), F.col("off").cast("long"), "open")).alias("asked"))
    return docs.select(*_KEY, "text").join(own, _KEY).select(*_KEY, "text", "asked").mapInArrow(run, schema)


def _blocks(docs: DataFrame, units: DataFrame, how: Strings) -> DataFrame:
    """The blocks of open pieces (start, n), named by what their strings have in common (c1, c2) and, where they are full, by all of them (w1, w2)."""

    def answer(grams, at, k1, k2, start, n, off, open_) -> pa.RecordBatch:
        low, high = (off - n + 1) // how.block, off // how.block
        count = high - low + 1
        i = np.repeat(np.arange(len(at)), count)
        block = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]
        near, far = block * how.block, block * how.block + how.block - 1  # the q-gram's offset in the block's last and first string
        mid = at[i] + off[i]
        c1, c2 = how.names(grams, mid - near, mid - far + how.length, block + 1)
        last, first = np.maximum(near, off[i] - n[i] + 1), np.minimum(far, off[i])
        full = (last == near) & (first == far)
        w1, w2 = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        w1[full], w2[full] = how.names(grams, (mid - far)[full], (mid - near + how.length)[full])
        return _out(
            "k1 k2 start n open c1 c2 w1 w2", k1[i], k2[i], start[i] + off[i] - first, (first - last + 1).astype(np.int32), open_[i], c1, c2,
            pa.array(w1, mask=~full), pa.array(w2, mask=~full),
        )

    return _asked(docs, units, how, answer, "k1 bigint, k2 bigint, start bigint, n int, open boolean, c1 bigint, c2 bigint, w1 bigint, w2 bigint")


def _singles(docs: DataFrame, units: DataFrame, how: Strings) -> DataFrame:
    """The strings of open blocks, each by its name."""

    def answer(grams, at, k1, k2, start, n, off, open_) -> pa.RecordBatch:
        i = np.repeat(np.arange(len(at)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        w1, w2 = how.names(grams, at[i] + j, at[i] + j + how.length)
        return _out("k1 k2 start open w1 w2", k1[i], k2[i], start[i] + j, open_[i], w1, w2)

    units = units.withColumn("off", F.lit(0))
    return _asked(docs, units, how, answer, "k1 bigint, k2 bigint, start bigint, open boolean, w1 bigint, w2 bigint")


def _twice(df: DataFrame, *key: str) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text): the text as bytes, and 128 bits that tell documents apart."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(13), "doc_id", text).alias("k2"), text.alias("text"))


def repeats(docs: DataFrame, how: Strings) -> DataFrame:
    """(k1, k2, start, n): ``n`` strings in a row from byte ``start`` of a document of :func:`keyed` that start elsewhere as well."""
    spark, span, early = docs.sparkSession, [*_KEY, "start", "n"], []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A table of its own, so that a key's rows can be split in the join with it; it goes when nothing reads it any more."""
        return stash(df, name, drop=early)

    buckets = _buckets(docs, how).groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1").select("bucket")
    buckets = keep(buckets, "buckets")
    pieces = stash(_pieces(docs, how).join(buckets, "bucket", "left_semi"), "pieces", drop=(used := []))
    remove(spark, early)

    one = F.min(F.struct(*_KEY, "start", "n", "off")).alias("one")
    classes = keep(pieces.groupBy("bucket", "w1", "w2").agg(F.count(F.lit(1)).alias("uses"), one), "classes")
    whole = stash(pieces.join(classes.filter("uses > 1").select("bucket", "w1", "w2"), ["bucket", "w1", "w2"], "left_semi").select(*span), "whole")
    remove(spark, used)
    open_buckets = keep(classes.groupBy("bucket").agg(F.min("uses").alias("least")).filter("least = 1").select("bucket"), "open")
    units = keep(classes.join(open_buckets, "bucket", "left_semi").select("one.*", (F.col("uses") == 1).alias("open")), "units")

    blocks = stash(_blocks(docs, units, how), "blocks", drop=used)
    remove(spark, early)
    full = blocks.filter("w1 is not null")
    done = keep(_twice(full, "w1", "w2").withColumn("done", F.lit(True)), "done")
    judged = full.join(done, ["w1", "w2"], "left").unionByName(blocks.filter("w1 is null").withColumn("done", F.lit(None).cast("boolean")))
    judged = stash(judged.select(*span, "c1", "c2", "open", F.coalesce("done", F.lit(False)).alias("done")), "judged")
    remove(spark, used)
    state = F.count(F.lit(1)).alias("uses"), F.max(F.expr("open and not done")).alias("some")
    shared = keep(judged.groupBy("c1", "c2").agg(*state).filter("uses > 1 and some").select("c1", "c2"), "shared")
    units = keep(judged.join(shared, ["c1", "c2"], "left_semi").select(*span, F.expr("open and not done").alias("open")), "units")

    singles = keep(_singles(docs, units, how), "singles")
    last = singles.filter("open").join(keep(_twice(singles, "w1", "w2"), "twice"), ["w1", "w2"], "left_semi").select(*_KEY, "start", F.lit(1).alias("n"))
    last = stash(last, "last")
    remove(spark, early)
    return whole.unionByName(judged.filter("open and done").select(*span)).unionByName(last)


def _cut(df: DataFrame, length: int, *, texts: bool) -> DataFrame:
    """Removes the places of each document from its text."""
    key = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, runs, digests, kept = [], [], [], []
            for text, start, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                gone = 0
                merged = np.empty((0, 2), np.int64)
                if start:
                    order = np.argsort(start)
                    low = np.asarray(start)[order]
                    high = np.maximum.accumulate(low + np.asarray(n)[order] - 1 + length)
                    new = np.append(True, low[1:] > high[:-1])
                    merged = np.column_stack([low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]])
                    gone = int((merged[:, 1] - merged[:, 0]).sum())
                edges = [0, *merged.ravel().tolist(), len(text)]
                rest = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
                removed.append(gone)
                runs.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept.append(rest)
            sizes = pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64())
            cols = [b.column(0), sizes, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            names = "doc_id n_bytes n_removed n_spans kept_sha256"
            yield _out(names + " kept", *cols, pa.array(kept, pa.binary())) if texts else _out(names, *cols)

    schema = f"doc_id {key}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return df.mapInArrow(run, schema + ", kept binary" if texts else schema)


def dedup(docs: DataFrame, how: Strings | None = None, *, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document, and with ``texts`` the remaining bytes ``kept``, which may begin or end inside a character."""
    how = how or Strings()
    ship(docs.sparkSession)
    with tidy(docs.sparkSession):
        own = keyed(docs)
        found = repeats(own, how).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "n")).alias("x"))
        df = own.join(found, _KEY, "left").select("doc_id", "text", F.col("x.start").alias("start"), F.col("x.n").alias("n"))
        return stash(_cut(df, how.length, texts=texts), "kept", keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Bytes are compared by their hex digits, a text cut into stretches of 1,024 strings so that cutting costs no square of its length.
SQL = f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select rid, h, unnest(range(length(h) // 2048 + 1)) as b from d where length(h) >= {2 * LENGTH}),
q as (select rid, b * 1024 as o, substr(h, 2048 * b + 1, 2048 + {2 * LENGTH - 2}) as x from p),
w as (select rid, o + i as i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) as m
      from (select *, unnest(range(least(1024, length(x) // 2 - {LENGTH - 1}))) as i from q where length(x) >= {2 * LENGTH})),
s as (select rid, i from w semi join (select m from w group by m having count(*) > 1) using (m)),
n as (select rid, i, case when i > lag(i) over (partition by rid order by i) + {LENGTH} then 1 else 0 end as new from s),
g as (select rid, i, sum(new) over (partition by rid order by i) as g from n),
r as (select rid, min(i) as a, max(i) + {LENGTH} as b from g group by rid, g),
k as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as last from r),
c as (select rid, sum(k.b - k.a) as removed, count(*) as spans, max(k.b) as tail,
             string_agg(substr(d.h, 2 * k.last + 1, 2 * (k.a - k.last)), '' order by k.a) as kept
      from k join d using (rid) group by rid)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from d left join c using (rid)
"""
