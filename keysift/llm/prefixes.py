"""Operator 12, the trie of conversation prefixes, as the Cartesian tree of an LCP array.

Conversations are sorted by their sequence of turns; a node of the trie is an interval of that
order.  L[i] is how many turns the conversations i - 1 and i share.  The nearest smaller values
left and right of L[i] bound the interval of all conversations that share so many turns; equal
values with equal bounds are one node, and the depths between a node and its parent have its
members as well, so they are filled in.  What is asked of a node are sums, minima and counts over
its interval.

All nearest smaller values are found block by block, in parallel (:func:`_block`): a block is one
range of the sorted order, and a stack gives each value its bounds inside it.  Only values that
are smaller than all to their left or right in the block stay open; these block minima, a few for
each block whatever its size, are merged over blocks by the same stack (:func:`_merge`), one item
for each.  Children of open nodes are joined to what the merge finds.

Turns are compared by 128 bits (MD5 of role and text), so texts never leave the first stage.  The
order ends with conv_id, so a conversation with any number of copies is split over blocks, and a
copy group's digest is made from pieces of its list, hashed in order.

Defined cases: null role and text are empty, a null turn comes first, and turns with equal numbers
follow by role, then by the MD5 of role and text; repeated rows are turns of their own; rows with a null conv_id
belong to no conversation and are left out; an empty table has no node; other columns are not read.
One conversation is held in one row, some 32 bytes a turn.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.quality import WORD
from keysift.llm.scratch import blocks_for, stash, tidy
from keysift.llm.sharding import CRC_SQL
from keysift.ship import ship

SHARED = 20  # conversations that take their first turns from the same one
MOST = 4  # fewer turns than this are taken over
WIDTH = 16  # bytes of a turn's digest
PIECE = 512  # conv_ids in a piece of a list
BATCH = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each its digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("x"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.transform("x", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuild(turns: DataFrame, shared: int = SHARED, most: int = MOST) -> DataFrame:
    """(conv_id, key, words): each conversation after its first turns are replaced by those of the first of its ``shared``."""
    base = F.col("conv_id") - F.col("conv_id") % shared
    heads = turns.filter(F.col("conv_id") % shared == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    df = turns.withColumn("base", base).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    df = df.withColumn("new", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), own))
    return df.select("conv_id", F.unhex(F.array_join("new.digest", "")).alias("key"), F.col("new.words").alias("words"))


# The sums over a run of conversations: how many, the least conv_id, leaves that end there, tokens of shared turns.
Sums = tuple[int, int, int, int]
NOTHING: Sums = (0, 0, 0, 0)


def _add(x: Sums, y: Sums) -> Sums:
    if not x[0] or not y[0]:
        return (x[0] + y[0], x[1] if x[0] else y[1], x[2] + y[2], x[3] + y[3])
    return (x[0] + y[0], min(x[1], y[1]), x[2] + y[2], x[3] + y[3])


@dataclass(slots=True)
class Row:
    """A conversation in the sorted order; ``words``: running totals, from 0."""

    conv_id: int
    key: bytes
    words: list[int]
    name: bytes  # what the list of conversations that end as it does is known by

    @property
    def depth(self) -> int:
        return len(self.key) // WIDTH


@dataclass(slots=True)
class Open:
    """A node whose right bound isn't known yet."""

    depth: int
    sums: Sums
    before: Sums  # what lies before its first value, since the node before it
    inner: Sums  # from its first value to its last
    equal: int
    ended: int  # values whose conversation before them ends at this depth
    words: list[int]
    last: int  # depth of the conversation before its first value
    seq: int = 0
    ids: list[int] = field(default_factory=list)  # conversations that end here
    key: bytes | None = None  # theirs
    waiting: list[dict] = field(default_factory=list)  # children
    items: list[tuple[int, int]] = field(default_factory=list)  # what it is merged from


@dataclass(slots=True)
class Stack:
    """Nearest smaller values by a stack of open nodes, deepest last.

    ``whole``: the order begins here, so the lowest node is bounded on the left; otherwise it is
    handed to ``left_open``, as what lies before it isn't known.
    """

    whole: bool
    give: Callable[[dict], None]  # takes a finished node
    left_open: Callable[[Open], None] = lambda node: None
    closed: Callable[[Open], None] = lambda node: None
    nodes: list[Open] = field(default_factory=list)
    made: int = 0

    def _below(self) -> int | None:
        return self.nodes[-1].depth if self.nodes else -1 if self.whole else None

    def _to(self, node: Open, child: dict) -> None:
        if node is self.nodes[0] and not self.whole:
            self.give(child | {"parent_seq": node.seq})  # it stays open, so nothing is gained by waiting
        else:
            node.waiting.append(child)

    def value(self, v: int, words: list[int], *, row: Row | None = None, sums: Sums = NOTHING, inner: Sums | None = None, last: int = 0, equal: int = 1, ended: int | None = None, key: bytes | None = None) -> Open | None:
        """The next value; before it lies ``row``, or a run of conversations whose sums are known and whose last is ``last`` deep."""
        below, children, here = self._below(), [], None
        if row is not None:
            last, sums = row.depth, (1, row.conv_id, int(row.depth > v), 0)
            if below is not None:
                parent = max(below, v)
                if last > parent:
                    leaf = {"top": parent + 1, "bottom": last, "sums": (1, row.conv_id, 1, 0), "children": 0, "words": row.words, "ids": [row.conv_id], "key": row.name}
                    children.append(leaf) if v >= below else self._to(self.nodes[-1], leaf)
                elif last == v:
                    here = row
                else:
                    self.nodes[-1].ids.append(row.conv_id)
                    self.nodes[-1].key = row.name
        if ended is None:
            ended = int(last == v)
        fresh = sums
        while self.nodes and self.nodes[-1].depth > v:
            node = self.nodes.pop()
            node.sums = _add(node.sums, sums)
            below = self._below()
            if below is None:
                self.left_open(node)
            else:
                fresh = node.sums
                parent = max(below, v)
                n = node.equal - node.ended + (last > node.depth)
                own = {"top": parent + 1, "bottom": node.depth, "sums": node.sums, "children": n, "words": node.words, "ids": node.ids, "key": node.key}
                children.append(own) if v >= below else self._to(self.nodes[-1], own)
                for x in node.waiting:
                    self.give(x | {"parent": node.sums[1]})
                self.closed(node)
            sums = node.sums
        if v < 0:
            for x in children:
                self.give(x)
            return None
        inner = inner if inner is not None else (0, 0, 0, words[v])
        if self.nodes and self.nodes[-1].depth == v:
            node = self.nodes[-1]
            node.sums, node.inner = _add(_add(node.sums, sums), inner), _add(_add(node.inner, sums), inner)
            node.equal, node.ended = node.equal + equal, node.ended + ended
        else:
            node = Open(v, _add(sums, inner), fresh, inner, equal, ended, words, last)
            if not self.nodes:
                self.made += 1
                node.seq = self.made
            self.nodes.append(node)
        if here is not None:
            node.ids.append(here.conv_id)
            node.key = here.name
        node.key = key if node.key is None else node.key
        for x in children:
            self._to(node, x)
        return node


def shared_turns(x: bytes, y: bytes) -> int:
    """How many leading turns two keys have in common."""
    n = min(len(x), len(y)) // WIDTH
    if x[: n * WIDTH] == y[: n * WIDTH]:
        return n
    return bisect_left(range(n), True, key=lambda i: x[: (i + 1) * WIDTH] != y[: (i + 1) * WIDTH])


# What a block or the merge gives: nodes, items of open nodes and edge rows, pieces of lists of conv_ids.
_FIELDS = {
    "kind": pa.string(), "block": pa.int32(), "seq": pa.int64(), "top": pa.int32(), "bottom": pa.int32(), "parent": pa.int64(),
    "parent_seq": pa.int64(), "sums": pa.list_(pa.int64()), "inner": pa.list_(pa.int64()), "equal": pa.int64(), "ended": pa.int64(),
    "last": pa.int32(), "children": pa.int64(), "words": pa.list_(pa.int64()), "ends": pa.string(), "key": pa.binary(),
}
_SCHEMA = pa.schema(list(_FIELDS.items()))
_DDL = (
    "kind string, block int, seq bigint, top int, bottom int, parent bigint, parent_seq bigint, sums array<bigint>, inner array<bigint>, "
    "equal bigint, ended bigint, last int, children bigint, words array<bigint>, ends string, key binary"
)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _FIELDS.items()], schema=_SCHEMA)
    rows.clear()
    return out


def _node(x: dict, block: int, ends: str | None, key: bytes | None) -> dict:
    """A finished node; ``words``: the running total before the last turn of each of its depths."""
    words = [x["words"][max(d - 1, 0)] for d in range(x["top"], x["bottom"] + 1)]
    return {"kind": "node", "block": block, "words": words, "ends": ends, "key": key} | {c: x.get(c) for c in ("top", "bottom", "parent", "parent_seq", "sums", "children")}


def _hash(key: bytes) -> bytes:
    return hashlib.md5(key).digest()


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finished nodes of one block of the order, and what is open at its edges."""
    out: list[dict] = []
    block, row, items = 0, None, 0

    def pieces(ids: list[int], key: bytes, seq: int) -> None:
        for i in range(0, len(ids), PIECE):
            out.append({"kind": "ids", "block": block, "seq": (seq << 32) + i, "ends": ",".join(map(str, ids[i : i + PIECE])), "key": _hash(key)})

    def edge(r: Row, seq: int) -> None:
        out.append({"kind": "item", "block": block, "seq": seq, "sums": [r.conv_id], "words": r.words, "key": r.key})

    def give(x: dict) -> None:
        out.append(_node(x, block, hashlib.sha256(",".join(map(str, x["ids"])).encode()).hexdigest(), None))

    def item(node: Open) -> None:
        nonlocal items
        items += 1
        node.seq = items
        if node.ids:
            pieces(node.ids, node.key, items)
        for x in node.waiting:
            give(x | {"parent_seq": node.seq})
        out.append(
            {"kind": "item", "block": block, "seq": items, "bottom": node.depth, "sums": list(node.before), "inner": list(node.inner), "equal": node.equal, "ended": node.ended}
            | {"last": node.last, "words": node.words[: node.depth + 1], "key": _hash(node.key) if node.key is not None else None}
        )

    stack, rows = Stack(False, give, left_open=item), 0
    for b in batches:
        for block, conv_id, key, words in zip(*(b.column(i).to_pylist() for i in range(4))):
            new = Row(conv_id, key, [0, *accumulate(words)], key)
            if row is None:
                edge(new, 0)
                pieces([conv_id], key, 0)
            else:
                stack.value(shared_turns(row.key, key), new.words, row=row)
            row, rows = new, rows + 1
            if len(out) >= BATCH:
                yield _batch(out)
    if row is not None:
        for node in stack.nodes:
            item(node)
        if rows > 1:
            edge(row, items + 1)
            pieces([row.conv_id], row.key, items + 1)
        yield _batch(out)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that reach over the edges of blocks, from the items in the order of blocks, and for each item its node's least conv_id."""
    out: list[dict] = []
    row: Row | None = None
    began = False

    def give(x: dict) -> None:
        out.append(_node(x, -1, None if x["key"] is not None else EMPTY, x["key"]))

    def closed(node: Open) -> None:
        out.extend({"kind": "found", "block": b, "seq": s, "parent": node.sums[1]} for b, s in node.items)

    stack = Stack(True, give, closed=closed)

    for b in batches:
        for x in b.to_pylist():
            if x["bottom"] is None:  # an edge row
                new = Row(x["sums"][0], x["key"], x["words"], _hash(x["key"]))
                if x["seq"] == 0 and row is not None:
                    stack.value(shared_turns(row.key, new.key), new.words, row=row)
                row = new
            else:
                node = stack.value(
                    x["bottom"], x["words"], row=row, sums=tuple(x["sums"]), inner=tuple(x["inner"]), last=x["last"], equal=x["equal"], ended=x["ended"], key=x["key"]
                )
                node.items.append((x["block"], x["seq"]))
                row = None
            began = True
            if len(out) >= BATCH:
                yield _batch(out)
    if began:
        stack.value(-1, [], row=row)
        yield _batch(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from the pieces of each key's list, in order; holds one piece at a time."""
    key, running = None, None
    keys, ends = [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])

    for b in batches:
        for k, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    ends.append(running.hexdigest())
                key, running = k, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
    if key is not None:
        keys.append(key)
        ends.append(running.hexdigest())
    yield out()


def trie(conversations: DataFrame, *, shared: int = SHARED, most: int = MOST, per_block: int = 200_000) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    ship(spark)
    with tidy(spark):
        keyed = stash(rebuild(turns_of(conversations), shared, most), "keyed")
        blocks = blocks_for(keyed.count(), per_block)
        ordered = keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
        ordered = ordered.select(F.spark_partition_id().alias("block"), "conv_id", "key", "words")
        local = stash(ordered.mapInArrow(_block, _DDL), "blocks")
        # A few rows for each block: the one place where all blocks meet.
        items = local.filter("kind = 'item'").repartition(1).sortWithinPartitions("block", "seq")
        merged = stash(items.mapInArrow(_merge, _DDL), "merged")
        ids = local.filter("kind = 'ids'").repartition("key").sortWithinPartitions("key", "block", "seq")
        ends = ids.select("key", "ends").mapInArrow(_digests, "key binary, ends string")

        nodes = local.filter("kind = 'node'")
        columns = ["top", "bottom", "parent", "sums", "children", "words", "ends"]
        found = merged.filter("kind = 'found'").select("block", F.col("seq").alias("parent_seq"), F.col("parent").alias("own_parent"))
        below = nodes.filter("parent_seq is not null").join(found, ["block", "parent_seq"]).withColumn("parent", F.col("own_parent"))
        over = merged.filter("kind = 'node'").withColumnRenamed("ends", "none").join(ends, "key", "left").withColumn("ends", F.coalesce("ends", "none"))
        every = nodes.filter("parent_seq is null").select(columns).unionByName(below.select(columns)).unionByName(over.select(columns))

        depth = every.select("*", F.posexplode("words").alias("i", "before")).withColumn("depth", (F.col("top") + F.col("i")).cast("long"))
        n, least = F.get("sums", F.lit(0)), F.get("sums", F.lit(1))
        bottom = F.col("depth") == F.col("bottom")
        out = depth.select(
            least.alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 0, F.when(F.col("i") == 0, F.col("parent")).otherwise(least)).alias("parent_conv_id"),
            n.alias("n_convs"),
            F.when(bottom, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            F.get("sums", F.lit(2)).alias("n_leaves"),
            (F.get("sums", F.lit(3)) - (n - 1) * F.col("before")).alias("saved_tokens"),
            F.when(bottom, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
        )
        return stash(out, "trie", keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as txt from conversations where conv_id is not null),
g as (select conv_id, turn, role, md5(octet_length(encode(role)) || ':' || role || txt) as g, len(regexp_extract_all(txt, '{WORD}')) as w from t),
m as (select conv_id, g, w, row_number() over (partition by conv_id order by turn nulls first, role, g) as k from g),
d as (select distinct conv_id as rid, conv_id::varchar as text from t),
{CRC_SQL},
h as (select rid as conv_id, text_crc32 % {MOST} as h from crc),
r as (select h.conv_id, 0 as o, m.k, m.g, m.w from h join m on m.conv_id = h.conv_id - h.conv_id % {SHARED} and m.k <= h.h
      union all select h.conv_id, 1, m.k, m.g, m.w from h join m using (conv_id) where m.k > h.h),
s as (select conv_id, list(g order by o, k) as gs, list(w order by o, k) as ws from r group by conv_id),
c as (select h.conv_id, coalesce(s.gs, []) as gs, coalesce(s.ws, []) as ws from h left join s using (conv_id)),
x as (select conv_id, gs, ws, unnest(range(len(gs) + 1)) as depth from c),
y as (select conv_id, depth, array_to_string(gs[1:depth], '') as p, coalesce(ws[depth], 0) as w, len(gs) = depth as ends from x),
n as (select p, depth, min(conv_id) as conv_id, count(*) as n, any_value(w) as w,
             sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
      from y group by p, depth),
k as (select substr(p, 1, 32 * (depth - 1)) as p, depth - 1 as depth, count(*) as n from n where depth > 0 group by all),
f as (select n.*, coalesce(k.n, 0) as children from n left join k using (p, depth)),
u as (select substr(p, 1, 32 * i) as p, i as depth, sum(case when children = 0 then 1 else 0 end) as leaves, sum((n - 1) * w) as saved
      from (select *, unnest(range(depth + 1)) as i from f) group by all)
select f.conv_id, f.depth, b.conv_id as parent_conv_id, f.n as n_convs, f.children as n_children,
       u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, f.ends_sha256
from f join u using (p, depth) left join n b on b.depth = f.depth - 1 and b.p = substr(f.p, 1, 32 * (f.depth - 1))
"""
