"""Dataset preparation: cross-checks of the sources, the manifest and the collection map."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.functions.text import collection_of, frame_id
from keysift.functions.vector import half_even_ms
from keysift.ship import ship
from keysift.sources import dataset

EXAMPLES = 1000  # rows of a kind that a report on the driver names; all are in its tables
SOURCES = {"keyframes": None, "map-keyframes": ".csv", "media-info": ".json", "objects": None, "clip-features-32": ".npy"}  # None: folders


def missing_ids(ids: DataFrame) -> DataFrame:
    """(source, id) of each id that some source has and this one lacks, from (source, id)."""
    have = ids.groupBy("id").agg(F.collect_set("source").alias("have"))
    sources = [r[0] for r in ids.select("source").distinct().collect()]  # a handful of sources
    lacking = F.array_except(F.array(*[F.lit(s) for s in sorted(sources)]), "have")
    return have.select(F.explode(lacking).alias("source"), "id")


def common_ids(ids: DataFrame, sources: int) -> DataFrame:
    """(id) of each id that all of so many sources have."""
    return ids.groupBy("id").agg(F.count_distinct("source").alias("n")).filter(F.col("n") == sources).select("id")


def per_collection(videos: DataFrame) -> DataFrame:
    """(collection_id, videos) from distinct (video_id); a malformed id has no collection and is counted under null."""
    return videos.distinct().groupBy(collection_of(F.col("video_id")).alias("collection_id")).agg(F.count(F.lit(1)).alias("videos"))


def collections(manifest: DataFrame) -> DataFrame:
    """(collection_id, videos): the sorted videos of each collection."""
    return manifest.groupBy("collection_id").agg(F.sort_array(F.collect_set("video_id")).alias("videos"))


def member_digests(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, n, md5): how many distinct members a key has, and the MD5 of those in order with a space between; a null counts and adds no text.

    Members are dealt and sorted by Spark and digested as they pass, so a task holds a batch of them, whatever a key's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=[key, "n", "md5"])

        n, now, digest, gap = 0, None, md5(), b""
        for b in batches:
            kind = b.schema.field(0).type
            for k, same in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), itemgetter(0)):
                if n and k != now:
                    yield out()
                    n = 0
                if not n:
                    now, digest, gap = k, md5(), b""
                members = [m for _, m in same]
                n += len(members)
                if text := " ".join(m for m in members if m is not None):
                    digest.update(gap + text.encode())
                    gap = b" "
        if n:
            yield out()

    ship(rows.sparkSession)
    df = rows.select(key, member).distinct().repartition(key).sortWithinPartitions(key, member).select(key, F.col(member).cast("string"))
    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n bigint, md5 string")


def compare_sets(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, only_left, only_right) of two tables of members, for each key that either has."""
    a = left.groupBy(key).agg(F.collect_set(member).alias("_l"))
    b = right.groupBy(key).agg(F.collect_set(member).alias("_r"))
    none = F.array().cast(a.schema["_l"].dataType)
    l, r = F.coalesce("_l", none), F.coalesce("_r", none)
    return a.join(b, key, "full_outer").select(key, F.sort_array(F.array_except(l, r)).alias("only_left"), F.sort_array(F.array_except(r, l)).alias("only_right"))


def differences(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, side) of each member that one side alone has; one row each, so no key is gathered in one place."""
    a, b = left.select(key, member), right.select(key, member)
    sides = [x.subtract(y).withColumn("side", F.lit(name)) for x, y, name in ((a, b, "left"), (b, a, "right"))]  # nulls are equal
    return sides[0].unionByName(sides[1])


def collection_report(manifest: DataFrame, mapped: DataFrame) -> DataFrame:
    """(problem, collection_id, video_id, n): all that a collection map has otherwise than the manifest.

    ``manifest``: (collection_id, video_id); ``mapped``: (entry, collection_id, video_id), a row for each video of each of the
    map's entries, with a null video for an entry without videos.  Every problem is a row of its own, so a collection of any
    size is compared by keys and never gathered.
    """
    none = F.lit(None).cast("string")
    video = F.col("video_id").cast("string").alias("video_id")

    def rows(df: DataFrame, problem: str, collection=none, video=none, n=F.lit(1)) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), collection.alias("collection_id"), video.alias("video_id"), n.cast("long").alias("n"))

    own, listed = manifest.select("collection_id", video).distinct(), mapped.filter("video_id is not null").select("entry", "collection_id", video)
    entries = mapped.groupBy("collection_id").agg(F.count_distinct("entry").alias("n"))
    uses = listed.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    collections_, videos = own.select("collection_id").distinct(), own.select("video_id").distinct()
    c, v, n = F.col("collection_id"), F.col("video_id"), F.col("n")
    out = rows(entries.filter("n > 1"), "repeated collection", c, n=n).unionByName(rows(uses.filter("n > 1"), "repeated video", video=v, n=n))
    out = out.unionByName(rows(collections_.join(entries, "collection_id", "left_anti"), "missing collection", c))
    out = out.unionByName(rows(entries.join(collections_, "collection_id", "left_anti"), "extra collection", c))
    out = out.unionByName(rows(videos.join(uses, "video_id", "left_anti"), "missing video", video=v))
    out = out.unionByName(rows(uses.join(videos, "video_id", "left_anti"), "extra video", video=v))
    sides = differences(own, listed, "collection_id", "video_id")
    named = F.when(F.col("side") == "left", "missing in collection").otherwise("extra in collection")
    return out.unionByName(sides.select(named.alias("problem"), c, v, F.lit(1).cast("long").alias("n")))


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """(entry, collection_id, video_id) of a collection map as :func:`write_collections` writes it."""
    raw = spark.read.schema("collection_id string, videos array<string>").json(path).withColumn("entry", F.monotonically_increasing_id())
    return raw.select("entry", "collection_id", F.explode_outer("videos").alias("video_id"))


def write_collections(manifest: DataFrame, path: str) -> None:
    """Writes the videos of each collection as JSON, a line for each collection."""
    collections(manifest).write.mode("overwrite").json(path)


def manifest_errors(rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(keyframe_id, error) of each rule that a row of (keyframe_id, collection_id, video_id, frame_number, timestamp_ms, image_path) breaks.

    ``images`` (image_path): the images there are.  An id or path that occurs more than once is one error.
    """
    below = lambda c: F.coalesce(F.col(c).try_cast("bigint") < 0, F.lit(True))
    rules = {
        "frame_number": below("frame_number"),
        "timestamp_ms": below("timestamp_ms"),
        "collection_id": ~collection_of(F.col("video_id")).eqNullSafe(F.col("collection_id")),
    }
    broken = rows.select("keyframe_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))).alias("error"))
    again = [
        repeated(rows, c).select(F.col(c).cast("string").alias("keyframe_id"), F.lit(f"repeated {c}").alias("error")) for c in ("keyframe_id", "image_path")
    ]
    out = broken.unionByName(again[0]).unionByName(again[1])
    if images is not None:
        lacking = rows.join(images.select("image_path"), "image_path", "left_anti")
        out = out.unionByName(lacking.select("keyframe_id", F.lit("no image").alias("error")))
    return out


def repeated(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The keys that occur more than once, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@dataclass
class Report:
    counts: dict[str, int] = field(default_factory=dict)
    collections: dict[str, int] = field(default_factory=dict)
    common: int = 0
    missing: dict[str, list[str]] = field(default_factory=dict)  # the first EXAMPLES of each source
    missing_counts: dict[str, int] = field(default_factory=dict)
    missing_ids: DataFrame | None = None  # (source, id): all of them
    errors: list[str] = field(default_factory=list)
    error_rows: DataFrame | None = None  # (error): all that a deep scan found

    @property
    def valid(self) -> bool:
        return not self.errors


def scan(spark: SparkSession, root: str, *, deep: bool = False) -> Report:
    """Which videos each source has and lacks; ``deep`` compares images, key maps and vectors of each video."""
    ids, report = None, Report()
    for name, suffix in SOURCES.items():
        part = dataset.children(spark, f"{root}/{name}", folders=suffix is None, suffix=suffix or "").withColumn("source", F.lit(name))
        report.counts[name] = part.count()
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.persist()
    report.errors += [f"no video in {name}" for name, n in report.counts.items() if not n]
    lacking = missing_ids(ids)
    for name in [name for name, n in report.counts.items() if not n]:  # a source without ids is in no row
        lacking = lacking.unionByName(ids.select(F.lit(name).alias("source"), "id").distinct())
    report.missing_ids = lacking
    first = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    for r in lacking.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each source
        report.missing_counts[r["source"]] = r["n"]
    for r in lacking.withColumn("k", first).filter(F.col("k") <= EXAMPLES).orderBy("source", "k").collect():
        report.missing.setdefault(r["source"], []).append(r["id"])
    for r in per_collection(ids.select(F.col("id").alias("video_id"))).orderBy("collection_id").collect():
        if r["collection_id"] is None:
            report.errors.append(f"{r['videos']} video ids without a collection")
        else:
            report.collections[r["collection_id"]] = r["videos"]
    common = common_ids(ids, len(SOURCES)).persist()
    report.common = common.count()
    if not any(report.counts.values()):
        report.errors.append("no video in any source")
    elif not report.common:
        report.errors.append("no video that all sources have")
    if deep and report.common:
        report.error_rows = unequal(spark, root, common)
        found = [r["error"] for r in report.error_rows.orderBy("error").limit(EXAMPLES + 1).collect()]
        report.errors += found[:EXAMPLES] + ["and more of the kind"] * (len(found) > EXAMPLES)
    return report


def unequal(spark: SparkSession, root: str, videos: DataFrame) -> DataFrame:
    """(error) of each video whose images, key map and vectors don't agree in number, or whose images and map in names."""
    images = dataset.image_files(spark, f"{root}/keyframes").groupBy("video_id")
    images = images.agg(F.sort_array(F.collect_list("n")).alias("images"), F.count(F.lit(1)).alias("files"))
    maps = dataset.key_maps(spark, f"{root}/map-keyframes").groupBy("video_id").agg(F.sort_array(F.collect_list("n")).alias("maps"))
    vectors = dataset.vectors(spark, f"{root}/clip-features-32").groupBy("video_id").agg(F.count(F.lit(1)).alias("vectors"))
    df = videos.withColumnRenamed("id", "video_id")
    for part in (images, maps, vectors):
        df = df.join(part, "video_id", "left")
    i, m, v = F.coalesce("files", F.lit(0)), F.coalesce(F.array_size("maps"), F.lit(0)), F.coalesce("vectors", F.lit(0))
    counts = F.when((i != m) | (m != v), F.format_string("%s: %d images, %d map rows, %d vectors", "video_id", i, m, v))
    names = F.when(~F.col("images").eqNullSafe(F.col("maps")), F.format_string("%s: image names and the map's numbers differ", "video_id"))
    return df.select(F.explode(F.array_compact(F.array(counts, names))).alias("error"))


def build_manifest(spark: SparkSession, root: str, out: str | None = None) -> DataFrame:
    """The manifest rows of a dataset in order, written as CSV to ``out`` if given; an error where a source lacks a frame."""
    folders = dataset.children(spark, f"{root}/keyframes", folders=True).withColumnRenamed("id", "video_id")
    clips = dataset.children(spark, f"{root}/clip-features-32", suffix=".npy").withColumnRenamed("id", "video_id")
    films = dataset.children(spark, f"{root}/videos", suffix=".mp4").select(F.col("id").alias("video_id"), F.format_string("videos/%s.mp4", "id").alias("video_path"))
    listed = dataset.children(spark, f"{root}/map-keyframes", suffix=".csv").withColumnRenamed("id", "video_id")
    have = listed.intersect(clips)
    if bad := [r[0] for r in folders.join(have, "video_id", "left_anti").orderBy("video_id").take(5)]:
        raise ValueError(f"videos without a key map or vectors, such as {bad}")
    maps = dataset.key_maps(spark, f"{root}/map-keyframes")
    rows = maps.join(folders, "video_id", "left_semi").join(dataset.images(spark, f"{root}/keyframes"), ["video_id", "n"], "left")
    rows = rows.join(films, "video_id", "left")
    if bad := [tuple(r) for r in rows.filter("image_path is null").select("video_id", "n").take(5)]:
        raise ValueError(f"frames without an image, such as {bad}")
    rows = rows.orderBy("video_id", "vector_index").select(
        frame_id(F.col("video_id"), F.col("n")).alias("keyframe_id"), collection_of(F.col("video_id")).alias("collection_id"), "video_id",
        F.col("n").alias("keyframe_number"), F.col("vector_index").alias("clip_vector_index"), F.col("frame_idx").alias("frame_number"),
        half_even_ms(F.col("pts_time")).alias("timestamp_ms"), "image_path", F.coalesce("video_path", F.lit("")).alias("video_path"),
    )
    if out:
        rows.write.option("header", True).csv(out)
    return rows
