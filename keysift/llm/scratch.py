"""Shared steps: tables in the cluster's shared folder, gapless numbers, running totals, connected components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; with a local master one of this machine where none is set, as in tests."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} is not set: a folder is needed that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keysift-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that :func:`stash` wrote inside, but for those with ``keep``, which are left to the surrounding
    :func:`tidy`, if any; gives the list of paths to delete."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield paths
    finally:
        _open.reset(token)
        remove(spark, paths)


def stash(df: DataFrame, name: str, *, keep: bool = False, drop: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends there and no executor is needed for it.

    ``keep``: it outlives the :func:`tidy` around it.  ``drop``: gets the table's path, for :func:`remove`, and then no
    :func:`tidy` deletes it.  The shuffle files behind the table go as soon as it is written.
    """
    spark = df.sparkSession
    path = place(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    outer = _open.get()[: -1 if keep else None]
    if drop is not None:
        drop.append(path)
    elif outer:
        outer[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that :func:`stash` wrote and nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Gives a worker's free memory back to the machine: workers live on between tasks, and the C library keeps what it has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


SLOTS = 1 << 19


def sifted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: the rows whose ``key`` may be among ``keys``, for an exact join to follow, and those whose isn't.

    A bit for each key's hash is set in at most ``SLOTS`` words of 64 bits, so what is broadcast has a bound whatever the
    data; with more keys than bits all rows go to the first part.  Wide rows that the join would pass are so never dealt.
    """
    slot = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 6), F.lit(SLOTS)).cast("int")
    place = F.xxhash64(key).bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(slot.alias("_slot"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("_bit"))
    words = words.groupBy("_slot").agg(F.bit_or("_bit").alias("_word"))
    found = df.join(F.broadcast(words), slot == F.col("_slot"), "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("_word"), place).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return found.filter(maybe).select(*df.columns), found.filter(~maybe).select(*df.columns)


def blocks_for(rows: int, per_block: int = 200_000, least: int = 8) -> int:
    """How many blocks a group that may hold all rows is cut into."""
    return max(least, -(-rows // per_block))


def hashed(blocks: int, *cols: Column) -> Column:
    """A block from 0 to ``blocks`` - 1 for each row."""
    return F.pmod(F.xxhash64(*cols), F.lit(blocks))


def number_within(df: DataFrame, group: str, block: Column, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``, gapless from 0 in each value of ``group``; any group may hold all rows.

    ``block`` cuts the rows into blocks (:func:`hashed` by a key, so that they are
    even); each is numbered by itself in ``order`` and begins where the blocks
    before it end.  The table of sizes has one row for each group and block.
    """
    df = df.withColumn("_block", block)
    sizes = df.groupBy(F.col(group).alias("_g"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    own = Window.partitionBy(group, "_block").orderBy(*order)
    df = df.withColumn("_own", F.row_number().over(own).cast("long") - 1)
    df = df.join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    return df.withColumn(out, F.col("_before") + F.col("_own")).drop("_block", "_g", "_b", "_size", "_before", "_own")


def running_total(df: DataFrame, sizes: DataFrame, by: str, amount: str, out: str, *, splits: int = 64) -> DataFrame:
    """Adds ``out``, the sum of ``amount`` over all rows before this one in the order of the integer ``by``.

    ``sizes`` has the same ``by`` and ``amount`` at less cost.  Cut points (fewer
    than ``splits``) are approximate quantiles of ``by``; each range is summed by
    itself and begins where the ranges before it end.  Null comes first.  Rows
    that share a key are ordered by ``amount`` and stay in one range, so ranges
    are even as long as keys are near unique.
    """
    shares = F.lit([i / splits for i in range(1, splits)])
    cuts = sizes.agg(F.percentile_approx(by, shares, 10 * splits).alias("c")).first()["c"] or []

    def bucket(table: DataFrame) -> DataFrame:
        place = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col(by))) if cuts else F.lit(0)
        return table.withColumn("_bucket", F.when(F.col(by).isNull(), F.lit(0)).otherwise(place))

    sums = bucket(sizes).groupBy(F.col("_bucket").alias("_b")).agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    own = Window.partitionBy("_bucket").orderBy(F.col(by).asc_nulls_first(), F.col(amount)).rowsBetween(Window.unboundedPreceding, -1)
    df = bucket(df).withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    df = df.join(F.broadcast(sums), F.col("_bucket") == F.col("_b"))  # at most ``splits`` rows
    return df.withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop("_bucket", "_b", "_sum", "_before", "_own")


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: longs): the component is its smallest node.

    Large-star and small-star rounds: each links a node's neighbours to the
    smallest of them, until nothing changes.  A round keeps at most one link for
    each one it got, so a chain or a hub costs no more than its rows (those of a
    hub meet its smallest neighbour, whose row can be joined to parts of them);
    each round is a table in the shared folder.
    """
    spark = links.sparkSession
    paths: list[str] = []
    old: list[str] = []
    edges = links.filter("a is not null and b is not null and a <> b")
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", drop=old)
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = stash(small.filter("a <> b").distinct(), "links", drop=paths)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, old)
        old, paths = paths, []
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: links still change after {most_rounds} rounds")
    if _open.get():
        _open.get()[-1].extend(old)
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
