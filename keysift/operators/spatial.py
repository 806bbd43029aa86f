"""The spatial index: points packed into tiles by a tree of cuts, a bounding box for each tile, and searches that open few tiles.

A tree that halves a bounded sample again and again, each time across the dimension in which it is widest, gives
each point a leaf; a part of the index (a collection, or a collection and domain) joins leaves to tiles of some
``tile_rows`` points by dropping the tree's last cuts.  A tile is a partition folder, so a search that knows its tiles
reads those alone.

A search goes best first in two rounds.  A tile's least possible distance follows from its box.  The nearest tiles that
hold k points together are opened, which bounds the k-th distance; then all tiles that may hold a nearer or equally near
point.  The rows are those of a scan of all tiles, ties included.  Any number of searches go through one plan: what is
dealt between tasks is boxes and each task's k best.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keysift.functions.text import let
from keysift.ship import ship
from keysift.sources.shared import stored

TILE_ROWS = 100_000
TILES = 512  # folders that an index has for its frames, and for their membership, about; more rows make larger tiles
LITERALS = 5_000  # tiles that a filter names; more are left to the join alone
PAIRS = 400_000  # of asks and blocks: a search makes about as many at most
BLOCK = 50_000  # rows that a block of tiles has
ASKS = 50_000  # that come together with a block
CELLS = 2_000_000  # distances that a task holds at once


@dataclass(frozen=True)
class Tree:
    """Cuts in heap order: the node i has the children 2 i (up to the cut) and 2 i + 1; the place 0 isn't used."""

    depth: int
    dims: tuple[int, ...] = (0,)
    cuts: tuple[float, ...] = (math.inf,)

    def leaf(self, point: Column) -> Column:
        """The number of a point's leaf, from 0 to 2^depth - 1."""
        if not self.depth:
            return F.lit(0)
        table = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal
        dims, cuts = table(self.dims, "int"), table(self.cuts, "double")
        below = lambda p, node: node * 2 + (F.get(p, F.get(dims, node)) > F.get(cuts, node)).cast("int")
        return let(point, lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), lambda node, _: below(p, node))) - (1 << self.depth)


    def leaves(self, points: DataFrame) -> DataFrame:
        """``points`` (with ``reduced``) with the :meth:`leaf` of each as ``_leaf``, a batch at a time."""
        dims, cuts, depth = np.asarray(self.dims), np.asarray(self.cuts), self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, node, row = matrix_of(b.column(b.schema.get_field_index("reduced")), len(b)), np.ones(len(b), np.int64), np.arange(len(b))
                for _ in range(depth):
                    node = 2 * node + ~(x[row, dims[node]] <= cuts[node])  # NaN lies above every cut, as in Spark
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((node - (1 << depth)).astype(np.int32))], names=[*b.schema.names, "_leaf"])

        ship(points.sparkSession)
        return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("_leaf", T.IntegerType())]))


def matrix_of(column: pa.Array, rows: int) -> np.ndarray:
    """A column of equally long arrays as a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(rows, -1) if rows else values.reshape(0, 0)


def fit_tree(sample: np.ndarray, rows: int, tile_rows: int = TILE_ROWS, least: int = 8) -> Tree:
    """A tree for ``rows`` points from a bounded sample of them; a leaf has ``least`` of the sample at least."""
    wanted = math.ceil(math.log2(max(1, rows / tile_rows)))
    depth = max(0, min(wanted, int(math.log2(max(1, len(sample) / least)))))
    dims, cuts = [0] * (1 << depth), [math.inf] * (1 << depth)
    held = {1: sample}
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            dims[node] = int(np.argmax(np.ptp(own, axis=0)))
            cuts[node] = float(np.median(own[:, dims[node]]))
        over = own[:, dims[node]] > cuts[node]
        held[2 * node], held[2 * node + 1] = own[~over], own[over]
    return Tree(depth, tuple(dims), tuple(cuts))


def placed(points: DataFrame, parts: list[str], tree: Tree, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``points`` (with ``reduced``, or with ``_leaf`` as well) with ``_leaf``, ``tile`` and ``_pieces``, in how many files a tile is dealt; no point is dealt for it.

    Points that no cut can part, such as a vector that a third of them share, make one tile in several files.
    """
    known = "_leaf" in points.columns
    df = points if known else tree.leaves(points)
    sizes = (df if known else tree.leaves(points.select(*parts, "reduced"))).groupBy(*parts, "_leaf").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*parts))
    depth = F.ceil(F.log2(F.greatest(total / tile_rows, F.lit(1.0)))).cast("int")
    tile = F.call_function("shiftright", F.col("_leaf"), F.lit(tree.depth) - F.least(depth, F.lit(tree.depth)))
    sizes = sizes.withColumn("tile", tile)
    pieces = F.ceil(F.sum("_n").over(Window.partitionBy(*parts, "tile")) / (4 * tile_rows))
    sizes = sizes.withColumn("_pieces", pieces).drop("_n")
    return df.join(F.broadcast(sizes), [*parts, "_leaf"])  # a row for each part and leaf


def tiled(points: DataFrame, parts: list[str], tree: Tree, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``points`` (with ``position, reduced``) with ``tile``, and dealt for a write by ``parts`` and tile, as :func:`placed` says."""
    df = placed(points, parts, tree, tile_rows)
    return df.repartition(*parts, "tile", F.pmod(F.xxhash64("position"), F.col("_pieces"))).drop("_leaf", "_pieces")


def boxes(points: DataFrame, parts: list[str], dimensions: int) -> DataFrame:
    """(parts, tile, rows, low, high): how many points a tile has and the least and greatest value of each dimension."""
    keys = [*parts, "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                changed = np.zeros(len(b) - 1, bool)
                for c in b.columns[:-1]:
                    changed |= pc.fill_null(pc.not_equal(c[:-1], c[1:]), True).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.append(True, changed))
                x = matrix_of(b.column(len(keys)), len(b))
                # NaN is above all values, as in Spark.
                sides = [pa.array(list(f.reduceat(x, first, axis=0)), pa.list_(pa.float64())) for f in (np.fmin, np.maximum)]
                rows = pa.array(np.diff(np.append(first, len(b))))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(first)) for c in b.columns[:-1]), rows, *sides], names=[*keys, "rows", "low", "high"])

    ship(points.sparkSession)
    points = points.select(*keys, "reduced")
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*points.schema.fields[:-1], T.StructField("rows", T.LongType()), T.StructField("low", doubles), T.StructField("high", doubles)])
    runs = points.mapInArrow(run, schema)  # a row for each run of one tile's points in a batch
    return runs.groupBy(*keys).agg(F.sum("rows").alias("rows"), _elementwise(F.min, "low", dimensions).alias("low"), _elementwise(F.max, "high", dimensions).alias("high"))


def least_distance(query: Column, low: Column, high: Column) -> Column:
    """No point of a box is nearer; worked out as :func:`l2` is, so rounding can't turn them round."""
    gap = F.transform(F.arrays_zip(query.alias("q"), low.alias("l"), high.alias("h")), lambda x: F.greatest(x["l"] - x["q"], x["q"] - x["h"], F.lit(0.0)))
    return F.sqrt(F.aggregate(F.transform(gap, lambda g: g * g), F.lit(0.0), lambda s, x: s + x))


def named(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with a filter that names the wanted partitions, so that no other folder is opened; a great many are left to the join that follows."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in keys])
    names = [r[0] for r in wanted.select(key).distinct().limit(LITERALS + 1).collect()]
    return table.filter(key.isin(names)) if len(names) <= LITERALS else table


def tile_size(rows: int, tile_rows: int) -> int:
    """``tile_rows``, or more where an index would have more than some ``TILES`` folders."""
    return max(tile_rows, -(-rows // TILES))


def _elementwise(f, column: str, size: int) -> Column:
    return F.array(*[f(F.get(column, F.lit(i))) for i in range(size)])


def _block(tile: str | Column, shift: int) -> Column:
    return F.call_function("shiftright", F.col(tile) if isinstance(tile, str) else tile, F.lit(shift))


def _coarseness(asks: DataFrame, tiles: DataFrame) -> tuple[int, int]:
    """(shift, pieces): how many cuts of the tree are left out so that ``PAIRS`` pairs of asks and blocks are made at most, and in how many
    pieces the asks of a block are taken.  A block stays within ``BLOCK`` rows."""
    a = asks.groupBy("part").agg(F.count(F.lit(1)).alias("a"))
    t = tiles.groupBy("part").agg(F.count(F.lit(1)).alias("t"), F.sum("rows").alias("r"))
    row = a.join(t, "part").agg(F.sum(F.col("a") * F.col("t").cast("double")).alias("pairs"), F.max("a").alias("asks"), (F.sum("r") / F.sum("t")).alias("mean")).first()
    if not row["pairs"]:
        return 0, 1
    wanted = math.ceil(math.log2(max(1.0, row["pairs"] / PAIRS)))
    return min(wanted, max(0, int(math.log2(max(1.0, BLOCK / row["mean"]))))), -(-row["asks"] // ASKS)


def _best(asks: pa.Table, points: pa.Table, fields: list[str]) -> pa.Table:
    """Of each ask the points up to its k-th distance, ties included, and no farther than ``kth`` where it has one.

    Matrix products choose what can be among them; its distances are summed a dimension at a time, as :func:`l2` does.
    """
    array = lambda column: column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    m, n = len(asks), len(points)
    q, x = array(asks["query"]).reshape(m, -1), array(points["reduced"]).reshape(n, -1)
    most = asks["k"].to_numpy()
    limit = asks["kth"].combine_chunks().fill_null(math.inf).to_numpy(zero_copy_only=False)
    xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    step, out = max(1, CELLS // n), []
    for at in range(0, m, step):
        own = slice(at, min(m, at + step))
        near = xx[None, :] + qq[own, None] - 2 * (q[own] @ x.T)
        room = 1e-11 * (qq[own] + xx.max())  # more than products may be off
        bound = limit[own] ** 2
        for k in np.unique(most[own]):
            if k <= n:
                of = np.flatnonzero(most[own] == k)
                part = near if len(of) == len(near) else near[of]
                bound[of] = np.fmin(bound[of], np.partition(part, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(~(near > (bound + 2 * room)[:, None]))
        i += at
        total = np.zeros(len(i))
        for d in range(x.shape[1]):
            total += (x[j, d] - q[i, d]) ** 2
        distance = np.sqrt(total)
        order = np.lexsort((distance, i))
        i, j, distance = i[order], j[order], distance[order]
        first = np.searchsorted(i, np.arange(own.start, own.stop))
        place = np.arange(len(i)) - first[i - at]
        end = np.append(first[1:], len(i))
        last = first + most[own] - 1
        kth = np.where(last < end, distance[np.minimum(last, max(len(i) - 1, 0))] if len(i) else math.inf, math.inf)[i - at]
        kept = ((place < most[i]) | (distance <= kth) | (np.isnan(distance) & np.isnan(kth))) & ~(distance > limit[i])
        out.append((i[kept], j[kept], distance[kept]))
    i, j, distance = (np.concatenate(c) for c in zip(*out))
    left, right = pa.array(i), pa.array(j)
    columns = {"ask": asks["ask"].take(left), "k": asks["k"].take(left), "distance": pa.chunked_array([pa.array(distance)])}
    return pa.table([columns[c] if c in columns else points[c].take(right) for c in fields], names=fields)


def _met(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asks: pa.Table, points: pa.Table) -> pa.Table:
        return _best(asks, points, schema.names) if len(asks) and len(points) else schema.empty_table()

    return run


def nearest(asks: DataFrame, tiles: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(asks' columns, position, home, distance, place): for each ask the points up to the k-th distance, ties included.

    ``asks``: (ask, part, query, k) and more; ``tiles``: (part, grain, keys of the grain, rows, low, high), a tile once for each part it
    belongs to; ``tables``: of each grain its points (keys, position, home, reduced) and its keys.

    Few asks meet tiles.  Of many, each meets blocks: tiles under one node of the tree, so many that asks and blocks make a bounded
    number of pairs.  A block's points and the asks that open it come together in one group of bounded size.
    """
    groups = sorted({k for _, keys in tables.values() for k in keys} - {"tile"})
    shift, pieces = _coarseness(asks, tiles)
    blocks = tiles.withColumn("block", _block("tile", shift))
    if shift:
        size = tiles.select(F.size("low")).first()[0]
        sides = _elementwise(F.min, "low", size).alias("low"), _elementwise(F.max, "high", size).alias("high")
        blocks = blocks.groupBy("part", "grain", *groups, "block").agg(F.sum("rows").alias("rows"), *sides)
    blocks = blocks.select("part", "grain", *groups, "block", "rows", F.ceil(F.col("rows") / (2 * BLOCK)).cast("int").alias("cuts"), "low", "high")
    order = Window.partitionBy("ask").orderBy("bound", *groups, "block")
    bounds = asks.select("ask", "part", "query", "k").join(blocks, "part").withColumn("bound", least_distance(F.col("query"), F.col("low"), F.col("high"))).drop("low", "high", "query", "part")
    bounds = bounds.withColumn("before", F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bounds = stored(bounds, "bounds")

    def scan(wanted: DataFrame) -> DataFrame:
        out = None
        for grain, (points, keys) in tables.items():
            by = [*(k for k in keys if k != "tile"), "block"]
            own = wanted.filter(F.col("grain") == grain)
            if not shift:
                points = named(points, own.withColumn("tile", F.col("block")), keys)
            large = blocks.filter((F.col("grain") == grain) & (F.col("cuts") > 1)).select(*by, "cuts").distinct()
            points = points.withColumn("block", _block("tile", shift)).join(F.broadcast(large), by, "left")  # only such as a vector that many share has
            cut = F.pmod(F.xxhash64("position"), F.coalesce("cuts", F.lit(1))).cast("int")
            columns = list(dict.fromkeys(["collection_id", "position", "home"]))
            points = points.select(*by, cut.alias("cut"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"), *[c for c in columns if c not in by], "reduced")
            piece = F.pmod(F.xxhash64("ask"), F.lit(pieces)).cast("int")
            own = own.join(asks.select("ask", "query"), "ask").select(
                "ask", "query", F.col("k").cast("long").alias("k"), "kth", *by, F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), piece.alias("piece")
            )
            kinds = {"ask": asks.schema["ask"], "k": own.schema["k"], **{c: points.schema[c] for c in columns}}
            schema = T.StructType.fromDDL(", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in kinds.items()) + ", distance double")
            by += ["cut", "piece"]
            found = own.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(_met(to_arrow_schema(schema)), schema)
            out = found if out is None else out.unionByName(found)
        return out

    ship(asks.sparkSession)
    first = stored(scan(bounds.filter("before < k").withColumn("kth", F.lit(None).cast("double"))), "nearest")
    row = F.row_number().over(Window.partitionBy("ask").orderBy("distance"))
    kth = first.withColumn("row", row).filter("row = k").select("ask", F.col("distance").alias("kth"))
    # Those that found fewer than k in the first round have opened all their tiles.
    rest = stored(bounds.filter("before >= k").join(kth, "ask").filter("bound <= kth"), "rest")
    found = first.unionByName(scan(rest))
    found = found.withColumn("place", F.rank().over(Window.partitionBy("ask").orderBy("distance"))).filter("place <= k").drop("k")
    return asks.drop("query").join(found, "ask")
