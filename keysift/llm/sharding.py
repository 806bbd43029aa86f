"""Operator 2, sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

A row descends region, rack and shard.  At each node every child draws
``-ln(u) / weight`` from a hash of the row's key and the child's name, and the
least draw wins, so a child is chosen in proportion to its weight.  When weights
change, a row moves only if it now enters or leaves a subtree whose weight has
changed.  A shard added by :meth:`Tree.grow` comes in a region of its own, so
it takes rows into itself and no other row moves: the ``key`` law.  :meth:`Tree.sized`
is the one tree for a number of shards under that law, whatever count a cluster has
grown from: ``BASE`` shards in an even tree, then each further one by itself.

Defined cases: a null text counts as empty; rows with a null key share one
draw; equal keys go to one shard; extra columns are kept by :func:`assign`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.scratch import blocks_for, number_within

SHARDS = 40
BASE = 40
REGIONS = 4
RACKS = 2
DIGITS = 13  # hex digits of a draw, 52 bits: what a double holds without rounding


@dataclass(frozen=True)
class Tree:
    """Shards by region and rack: ``leaves`` has (region, rack, shard, weight)."""

    leaves: tuple[tuple[int, int, int, float], ...]

    @classmethod
    def build(cls, shards: int, regions: int = REGIONS, racks: int = RACKS) -> Tree:
        """An even tree: shard i lies in region i mod regions, and there in the racks by turns."""
        return cls(tuple((i % regions, i // regions % racks, i, 1.0) for i in range(shards)))

    @classmethod
    def sized(cls, shards: int, base: int = BASE) -> Tree:
        """The tree that a cluster of ``base`` shards has come to at ``shards``: the count alone decides, and the next only takes rows."""
        if shards < base:
            raise ValueError(f"the law holds from {base} shards on")
        tree = cls.build(base)
        for _ in range(shards - base):
            tree = tree.grow()
        return tree

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        region, shard = (max(x[k] for x in self.leaves) + 1 for k in (0, 2))
        return Tree((*self.leaves, (region, 0, shard, weight)))

    def nodes(self) -> dict[str, dict[int, float]]:
        """The children of each inner node, with their weights; a node is named by its path, the root by ''."""
        out: dict[str, dict[int, float]] = {}
        for *path, weight in self.leaves:
            for depth, child in enumerate(path):
                below = out.setdefault("".join(f"/{x}" for x in path[:depth]), {})
                below[child] = below.get(child, 0.0) + weight
        return out


def _draw(key: Column, name: str, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(name))), 1, DIGITS), 16, 10).cast("double")
    return -F.log((h + F.lit(0.5)) / F.lit(float(16**DIGITS))) / F.lit(weight)


def _child(key: Column, node: str, below: dict[int, float]) -> Column:
    """The child of a node whose draw is least."""
    if len(below) == 1:
        return F.lit(next(iter(below)))
    return F.least(*[F.struct(_draw(key, f"{node}/{c}", w).alias("d"), F.lit(c).alias("c")) for c, w in below.items()])["c"]


def assign(df: DataFrame, key: str, tree: Tree, out: str = "shard") -> DataFrame:
    """The rows with the shard that their key is sent to; needs no shuffle.

    A level is one CASE over the nodes above it, of which only the branch that
    the row has reached is computed.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    nodes = tree.nodes()
    df = df.withColumn("_at0", F.lit(""))
    for depth in range(3):
        at, child = F.col(f"_at{depth}"), None
        for node, below in nodes.items():
            if node.count("/") == depth:
                child = (F if child is None else child).when(at == node, _child(name, node, below))
        df = df.withColumn(f"_child{depth}", child)
        df = df.withColumn(f"_at{depth + 1}", F.concat(at, F.lit("/"), F.col(f"_child{depth}").cast("string")))
    df = df.withColumn(out, F.col("_child2"))
    return df.drop(*[f"_at{i}" for i in range(4)], *[f"_child{i}" for i in range(3)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    df = docs.select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law")
    )
    df = assign(assign(df, "doc_id", Tree.sized(SHARDS)), "doc_id", Tree.sized(SHARDS + 1), "grown_shard")
    blocks = blocks_for(docs.count() // SHARDS)
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    return number_within(df, "shard", draw % blocks, order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


# CRC-32 of each text: the table of the 256 bytes follows from the polynomial 0xEDB88320.
CRC_SQL = """
tab as (select list_transform(range(256), lambda i: list_reduce(range(8),
          lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i::bigint)) as t),
crc as (select rid, xor(list_reduce(
          list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32
        from d, tab)
"""


def _sql() -> str:
    def tree_sql(tree: Tree, name: str) -> str:
        rows = ", ".join(f"('{p}', {c}, {w!r}::double)" for p, below in tree.nodes().items() for c, w in below.items())
        steps, at = [f"{name}_n(p, c, w) as (values {rows})", f"{name}_0 as (select rid, k, '' as p from d)"], f"{name}_0"
        for i in (1, 2, 3):
            u = f"((('0x' || substr(md5(k || p || '/' || c), 1, {DIGITS}))::ubigint::double + 0.5) / {float(16**DIGITS)!r})"
            steps.append(
                f"{name}_{i} as (select rid, any_value(k) as k, any_value(p) || '/' || arg_min(c, -ln({u}) / w) as p "
                f"from {at} join {name}_n using (p) group by rid)"
            )
            at = f"{name}_{i}"
        return ", ".join(steps)

    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(doc_id::varchar, 'null') as k from documents),
{CRC_SQL},
{tree_sql(Tree.sized(SHARDS), "a")}, {tree_sql(Tree.sized(SHARDS + 1), "g")},
leaf as (select d.doc_id, octet_length(encode(d.text)) + 16 as size, text_crc32,
                string_split(a_3.p, '/')[-1]::int as shard, string_split(g_3.p, '/')[-1]::int as grown_shard,
                ('0x' || substr(md5(d.k), 1, 8))::bigint
                  % greatest({blocks_for(0)}, ((select count(*) from d) // {SHARDS} + 199999) // 200000) as block
         from d join crc using (rid) join a_3 using (rid) join g_3 using (rid))
select doc_id, size, text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by block, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from leaf
"""


SQL = _sql()
