"""Operator 3, SimHash near-dedup by a binary trie self-join.

Fingerprints that differ in at most ``BITS`` bits are links; documents joined by
links form a component.  Equal fingerprints are collapsed first.  Then, of four
blocks of a fingerprint (one more than the bits that may differ), at least one is
equal in any linked pair: each distinct fingerprint is dealt four times by the
value of one block.  A group of more than ``GROUP`` fingerprints is dealt anew by
four blocks of its remaining bits, and so on; after six steps at most 2^12
distinct fingerprints can still agree, which bounds every group whatever the
data.  Within a group a binary trie over the
remaining bits is joined with itself: node pairs are descended together, their
differing bits are added up, and a pair of nodes over the budget is pruned.  A
group returns a forest over its links, never all its pairs, and the forests of
all groups are joined by distributed connected components.

:func:`dedup` allows ``NEAR_BITS`` bits on five-word shingles; there groups may be
larger, since each step costs more copies.  :func:`exact_dedup`, the pipeline's
stage, takes their components as candidates only.  Most texts of Jaccard 0.8 differ
in more bits than a trie join can allow, so MinHash bands over whole documents (see
:mod:`keysift.llm.paragraphs`) give the other candidates, and every link is confirmed by
exact Jaccard before the components.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and
is linked like any other; fewer words than a shingle has are one shingle; equal
rows share a component; a null doc_id takes part, and a component of null ids
alone has the component id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm import paragraphs
from keysift.llm.scratch import components, give_back, remove, sifted, stash, tidy
from keysift.ship import ship

BITS = 3
SHINGLE = 3
SEED = 42
NEAR_BITS = 5
GROUP = 1024
NEAR_GROUP = 8192
LEAF = 32  # node pairs of at most so many fingerprint pairs are compared outright
SLICE = 1 << 20
STEPS = 6


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _deal(df: DataFrame, width: int, blocks: int) -> DataFrame:
    """Deals (fp, key, rest) once for each block: by the block's value in ``rest``, of which ``width`` bits are left."""
    block = width // blocks
    cut = lambda c, a, n: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << n) - 1)) if n < 64 else c
    copies = []
    for i in range(blocks):
        low = i * block
        above = width - low - block
        rest = cut(F.col("rest"), 0, low) if low else F.lit(0).cast("long")
        if above:
            rest = rest.bitwiseOR(F.shiftleft(cut(F.col("rest"), low + block, above), low))
        copies.append(F.struct(F.xxhash64("key", F.lit(i), cut(F.col("rest"), low, block)).alias("key"), rest.alias("rest")))
    df = df.withColumn("_c", F.explode(F.array(*copies)))
    return df.select("fp", F.col("_c.key").alias("key"), F.col("_c.rest").alias("rest"))


def trie_links(key: np.ndarray, rest: np.ndarray, fp: np.ndarray, bits: int = BITS, width: int = 48) -> np.ndarray:
    """For each fingerprint the index of one that it is linked to, directly or by others of its group; itself if none.

    ``key`` is sorted and each group is sorted by ``rest``.  All groups are descended
    at once, level by level; a node is a range of the sorted array.
    """
    n = len(fp)
    label = np.arange(n)
    prints = fp.view(np.uint64)  # of a signed number, bitwise_count() counts the bits of its absolute value
    if n < 2:
        return label

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        i, j = i[near], j[near]
        while len(i):  # hook the larger root to the smaller one and shorten the paths, until every link is inside a tree
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:
                shorter = label[label]
                if np.array_equal(shorter, label):
                    break
                label[:] = shorter
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]

    def leaves(al, ah, bl, bh) -> None:
        """Compares all pairs of the node pairs, in slices; of a node with itself, each pair once."""
        sizes = (ah - al) * (bh - bl)
        total, at = np.cumsum(sizes), 0
        while at < len(sizes):
            done = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, done + SLICE, side="right")))
            s = sizes[at:upto]
            which = np.repeat(np.arange(at, upto), s)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
            span = (bh - bl)[which]
            i, j = al[which] + inner // span, bl[which] + inner % span
            once = i < j
            compare(i[once], j[once])
            at = upto

    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    low, high = edges, np.r_[edges[1:], n]
    two = high - low > 1
    frontier = (low[two], high[two], low[two], high[two], np.zeros(int(two.sum()), np.int64))
    for depth in range(width - 1, -1, -1):
        al, ah, bl, bh, d = frontier
        if not len(al):
            return label
        small = (ah - al) * (bh - bl) <= LEAF
        leaves(al[small], ah[small], bl[small], bh[small])
        al, ah, bl, bh, d = (x[~small] for x in frontier)
        if not len(al):
            return label
        zero = np.r_[0, np.cumsum((rest >> np.int64(depth)) & 1 == 0)]
        am, bm = al + zero[ah] - zero[al], bl + zero[bh] - zero[bl]
        own = al == bl
        parts = [
            (al, am, bl, bm, d, slice(None)), (am, ah, bm, bh, d, slice(None)),
            (al, am, bm, bh, d + 1, slice(None)), (am, ah, bl, bm, d + 1, ~own),
        ]
        grown = []
        for a0, a1, b0, b1, dist, pick in parts:
            a0, a1, b0, b1, dist = (x[pick] for x in (a0, a1, b0, b1, dist))
            live = (a1 > a0) & (b1 > b0) & (dist <= bits) & ~((a0 == b0) & (a1 - a0 < 2))
            grown.append(tuple(x[live] for x in (a0, a1, b0, b1, dist)))
        frontier = tuple(np.concatenate(x) for x in zip(*grown))
    leaves(*frontier[:4])
    return label


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of (key, rest, fp), sorted; a batch's last group waits for the next batch."""
    held = tuple(np.empty(0, np.int64) for _ in range(3))
    for b in batches:
        now = tuple(np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        held = tuple(x[cut:] for x in now)
        if cut:
            yield tuple(x[:cut] for x in now)
    if len(held[0]):
        yield held


def links(distinct: DataFrame, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(a, b): a forest over the pairs of distinct fingerprints ``fp`` within ``bits`` differing bits."""
    blocks = bits + 1
    longest = 64 - 64 // blocks
    paths: list[str] = []
    ready, width = None, 64
    df = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"))
    for step in range(STEPS):
        dealt = _deal(df, width, blocks)
        width -= width // blocks
        dealt = stash(dealt, "dealt", drop=paths)
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        large = sizes.filter(F.col("n") > group) if step < STEPS - 1 else sizes.filter(F.lit(False))
        small = sizes if step == STEPS - 1 else sizes.filter(F.col("n") <= group)
        now = dealt.join(small.select("key"), "key", "left_semi").select("key", "rest", "fp")
        ready = now if ready is None else ready.unionByName(now)
        if not large.take(1):
            break
        df = dealt.join(large.select("key"), "key", "left_semi").select("fp", "key", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rest, fp in _groups(batches):
            label = trie_links(key, rest, fp, bits, longest)
            i = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[label[i]])], names=["a", "b"])

    ship(distinct.sparkSession)
    out = ready.repartition("key").sortWithinPartitions("key", "rest").mapInArrow(run, "a bigint, b bigint")
    out = stash(out, "forest")
    remove(out.sparkSession, paths)
    return out


def classes(docs: DataFrame, *, shingle: int = SHINGLE, bits: int = BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component, component_id) of each document; the component id is the smallest doc_id reachable."""
    with tidy(docs.sparkSession):
        prints = stash(fingerprints(docs, shingle), "prints", keep=True)
        distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
        found = components(links(distinct, bits, group))
        joined = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        joined = stash(joined, "classes", keep=True)
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = joined.join(least, "component").select("fp", "component", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component", "component_id")


def _firsts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the documents that ``found`` (key: struct of doc_id and doc, component) has after the first of their component;
    of rows with one doc_id and text one stays.  Only the texts of documents that may go are dealt."""
    order = F.struct(F.col("key.doc_id").isNull().alias("n"), F.col("key").alias("k"))
    first = found.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(first, "component").filter(F.col("key") != F.col("first.k")).select("key", F.lit(True).alias("later"))
    repeated = docs.select(document()).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.lit(False).alias("later"))
    marked = stash(later.unionByName(repeated).groupBy("key").agg(F.max("later").alias("later")), "marked", keep=True)
    # The input's columns go along as one, so that their names don't meet those of this function.
    rows = docs.select(document(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    maybe, clear = sifted(rows, marked, "key")
    same = Window.partitionBy("key").orderBy(F.lit(1))
    maybe = maybe.join(marked.filter("later").select("key"), "key", "left_anti").withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    rows = clear.select("row").unionByName(maybe.select("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def document() -> Column:
    """What a document is known by: its doc_id and a hash of its text."""
    return F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("doc")).alias("key")


def dedup(docs: DataFrame, *, shingle: int = 5, bits: int = NEAR_BITS, group: int = NEAR_GROUP) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of rows with one doc_id and text any one."""
    found = classes(docs.select(document().alias("doc_id"), "text"), shingle=shingle, bits=bits, group=group)
    return _firsts(docs, found.select(F.col("doc_id").alias("key"), "component").distinct())


def exact_dedup(docs: DataFrame, *, similarity: float = paragraphs.SIMILARITY, bits: int = NEAR_BITS, group: int = NEAR_GROUP) -> DataFrame:
    """As :func:`dedup`, of components of texts whose exact Jaccard similarity is ``similarity`` at least."""
    with tidy(docs.sparkSession):
        plain = docs.select("doc_id", "text")
        near = classes(plain.select(document().alias("doc_id"), "text"), shingle=paragraphs.SHINGLE, bits=bits, group=group)
        near = near.select(F.col("doc_id").alias("key"), F.xxhash64(F.lit("simhash"), "component").alias("near")).distinct()
        marks = paragraphs.units(plain, whole=True).withColumn("key", F.struct("doc_id", "doc")).dropDuplicates(["key"])
        # A SimHash component is one more key beside the MinHash bands.
        marks = stash(marks.join(near, "key").withColumn("keys", F.array_append("keys", F.col("near"))).drop("near"), "marks")
        found = stash(marks.join(paragraphs.link(plain, marks, similarity), ["one", "two"]).select("key", "component"), "found", keep=True)
    return _firsts(docs, found)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
