"""Readers of a keyframe dataset: listings, key maps, manifests, vectors, detections and package lists."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from keysift.functions.text import normalize, number_of, safe_path
from keysift.ship import ship
from keysift.sources import files
from keysift.sources.shared import stored

MAP_SCHEMA = "n string, frame_idx string, pts_time string"
REQUIRED = ("keyframe_id", "collection_id", "video_id", "frame_number", "timestamp_ms", "image_path", "video_path")
# What a package's name begins with, without case, which is its group too; the first that fits counts.
PACKAGE_GROUPS = ("keyframes", "videos", "clip-features-32", "map-keyframes", "media-info", "objects")


def children(spark: SparkSession, path: str, *, folders: bool = False, suffix: str = "") -> DataFrame:
    """(id): the names of a folder's subfolders, or of its files with a suffix and without it; none if there is no folder.

    A task lists the folder; only a store that nothing but Spark reads is listed by the driver.
    """
    if files.reachable(path):
        found = files.children(spark, path)
        found = found.filter("folder") if folders else found.filter(~F.col("folder") & F.col("name").endswith(suffix))
        name = F.col("name") if folders or not suffix else F.expr(f"left(name, length(name) - {len(suffix)})")
        return found.select(name.alias("id")).orderBy("id")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    if fs.exists(where):
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if s.isDirectory() if folders else s.isFile() and name.endswith(suffix):
                names.append((name if folders else name.removesuffix(suffix),))
    return spark.createDataFrame(names, "id string").orderBy("id")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def key_maps(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, vector_index, n, frame_idx, pts_time) of all key maps of a folder; ``vector_index`` is the row's place in its file.

    Each file is read whole, so its order doesn't depend on how Spark cuts files.
    """
    text = spark.read.text(f"{path}/*.csv", wholetext=True).select(_stem(F.input_file_name()).alias("video_id"), F.regexp_replace("value", "^﻿", "").alias("t"))
    lines = text.select("video_id", F.filter(F.split("t", "\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    names = F.transform(F.split(F.get("l", F.lit(0)), ","), F.trim)
    rows = lines.select("video_id", names.alias("names"), F.posexplode(F.slice("l", 2, 1_000_000_000)).alias("vector_index", "line"))
    cell = lambda c: F.trim(F.get(F.split("line", ","), (F.array_position("names", c) - 1).cast("int")))
    missing = F.filter(F.array(*[F.lit(c) for c in ("n", "frame_idx", "pts_time")]), lambda c: ~F.array_contains(F.col("names"), c))
    ok = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("key map without "), F.array_join(missing, ", "), F.lit(": "), "video_id")))
    return rows.select(
        "video_id", F.coalesce(ok.cast("int"), F.col("vector_index")).alias("vector_index"), cell("n").cast("int").alias("n"),
        cell("frame_idx").cast("int").alias("frame_idx"), cell("pts_time").cast("double").alias("pts_time"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of a manifest CSV, checked, with ``position`` in file order."""
    return records(manifest_lines(spark, path))


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw rows of a manifest CSV with ``line``, their place in the order of files."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if missing := [c for c in REQUIRED if c not in names]:
        raise ValueError(f"a manifest without the columns {missing}")
    return in_file_order(raw, "line").toDF(*names, "line")


def in_file_order(raw: DataFrame, out: str) -> DataFrame:
    """A table as read from text files with ``out``, gapless from 0 in the order of files (by path) and of the rows in each.

    However Spark cuts and orders files, a row's place is its file, where its block begins, and its place in the block, which
    one task reads from start to end.  A table of a row for each block gives where a block's numbers begin.
    """
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    rows = raw.select(*[F.col(f"`{c}`") for c in raw.columns], *block).withColumn("_row", F.monotonically_increasing_id())
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # over blocks, not rows
    starts = sizes.select("_file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row")) - 1
    rows = rows.withColumn("_own", own).join(starts, ["_file", "_block"])
    return rows.select(*[F.col(f"`{c}`") for c in raw.columns], (F.col("_start") + F.col("_own")).alias(out))


NEEDED = ("keyframe_number", "clip_vector_index", "frame_number", "timestamp_ms", "image_path")
RULES = ("keyframe_id", "video_id", "video_path", *NEEDED, "repeated keyframe_id")


def judged(raw: DataFrame) -> DataFrame:
    """Manifest rows from raw ones with a ``line`` that orders them, and ``errors``, the rules that each breaks.

    Defaults: ``keyframe_number`` from the id, ``clip_vector_index`` from the row's place among its video's rows.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    optional = lambda c: F.when(text(c) != "", text(c).try_cast("int")) if c in raw.columns else F.lit(None).cast("int")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("line")) - 1
    df = raw.withColumns({c: text(c) for c in REQUIRED})
    df = df.select(
        "line", "keyframe_id", F.upper("collection_id").alias("collection_id"), "video_id",
        F.coalesce(optional("keyframe_number"), number_of(F.col("keyframe_id"))).alias("keyframe_number"),
        F.coalesce(optional("clip_vector_index"), place).alias("clip_vector_index"),
        F.col("frame_number").try_cast("int").alias("frame_number"), F.col("timestamp_ms").try_cast("bigint").alias("timestamp_ms"),
        safe_path(F.col("image_path")).alias("image_path"), F.coalesce(safe_path(F.col("video_path")), F.lit("")).alias("video_path"),
        (F.col("video_path").isNotNull() & safe_path(F.col("video_path")).isNull()).alias("_unsafe"),
        F.count(F.lit(1)).over(Window.partitionBy("keyframe_id")).alias("_uses"),
    )
    broken = {"keyframe_id": F.col("keyframe_id") == "", "video_id": F.col("video_id") == "", "video_path": F.col("_unsafe")}
    broken |= {c: F.col(c).isNull() for c in NEEDED} | {"repeated keyframe_id": F.col("_uses") > 1}
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(broken[r], F.lit(r)) for r in RULES]))).drop("_unsafe", "_uses")


@dataclass(frozen=True)
class Checked:
    """What a check in soft mode found: the good rows, the bad ones with their ``errors``, and counts by rule."""

    good: DataFrame
    bad: DataFrame
    rows: int
    broken: int
    counts: dict[str, int]


def check_records(raw: DataFrame) -> Checked:
    """The rows of :func:`judged` parted in one scan, which counts them by rule on its way; bad rows stop nothing."""
    seen = Observation()
    counts = [F.count_if(F.array_contains("errors", r)).alias(f"r{i}") for i, r in enumerate(RULES)]
    observed = judged(raw).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("broken"), *counts)
    table = stored(observed, "records")
    found = seen.get
    good = table.filter(F.size("errors") == 0).drop("errors")
    return Checked(good, table.filter(F.size("errors") > 0), found["rows"], found["broken"], {r: found[f"r{i}"] for i, r in enumerate(RULES) if found[f"r{i}"]})


def records(raw: DataFrame) -> DataFrame:
    """The rows of :func:`judged` with ``position``; an error names the first rows that break a rule, and the rules."""
    found = check_records(raw)
    if found.broken:
        some = [r[0] for r in found.bad.orderBy("line").select("keyframe_id").take(5)]
        raise ValueError(f"manifest rows that break a rule: {found.counts}, such as {some}")
    if not found.rows:
        raise ValueError("the manifest has no rows")
    return positions(found.good, "line").drop("line")


def positions(df: DataFrame, order: str, *, splits: int = 256) -> DataFrame:
    """``df`` with ``position``, gapless from 0 in the order of a number column without repeats, without one task for all rows.

    A row's range comes from its number and fixed cuts alone, so a lost executor's rows are numbered anew alike.
    """
    shares = F.lit([i / splits for i in range(1, splits)])
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares, 100 * splits).alias("c")).first()["c"] or []))
    part = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_part", part)
    sizes = df.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``splits`` rows
    starts = sizes.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    df = df.withColumn("_own", own).join(F.broadcast(starts), F.col("_part") == F.col("_of"))
    return df.withColumn("position", F.col("_start") + F.col("_own")).drop("_part", "_own", "_of", "_start")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, clip_vector_index, vector) of all .npy matrices of a folder, one file for each video.

    A matrix is cut into ranges of rows (:class:`keysift.sources.files.NpySource`); in a store that nothing but Spark reads
    each is one row of bytes.
    """
    if files.reachable(path):
        return files.matrices(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for video, raw in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.load(io.BytesIO(raw.as_py()), allow_pickle=False)
                if m.ndim != 2:
                    raise ValueError(f"{video}: an array of {m.ndim} dimensions; 2 are needed")
                for i in range(0, len(m), 1024):
                    part = np.ascontiguousarray(m[i : i + 1024], np.float32)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.reshape(-1)), part.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([video] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), lists], names=["video_id", "clip_vector_index", "vector"]
                    )

    ship(spark)
    whole = spark.read.format("binaryFile").load(f"{path}/*.npy").select(_stem(F.col("path")).alias("video_id"), "content")
    return whole.mapInArrow(run, "video_id string, clip_vector_index int, vector array<float>")


def parse_detections(text: Column) -> Column:
    """array<struct<term, score>> of a detector's JSON in any of its layouts; terms are normalised, a missing score is 1.

    Layouts: two parallel arrays, cut to the shorter; a list of detections; or an object that holds such a list.
    """
    v = F.try_parse_json(F.regexp_replace(text, "^﻿", ""))
    get = lambda x, path, kind: F.try_variant_get(x, path, kind)
    names, scores = get(v, "$.detection_class_entities", "array<string>"), get(v, "$.detection_scores", "array<string>")
    paired = F.transform(
        F.sequence(F.lit(0), F.least(F.size(names), F.coalesce(F.when(F.size(scores) >= 0, F.size(scores)), F.size(names))) - 1),
        lambda i: F.struct(F.get(names, i).alias("name"), F.when(scores.isNull(), F.lit("1.0")).otherwise(F.get(scores, i)).alias("score")),
    )
    official = F.when(names.isNotNull(), F.when((F.size(names) > 0) & (F.coalesce(F.size(scores), F.lit(-1)) != 0), paired).otherwise(F.array()))
    listed = get(v, "$", "array<variant>")
    for key in ("detections", "objects", "predictions", "results"):
        listed = F.coalesce(listed, get(v, f"$.{key}", "array<variant>"))
    name = lambda x: F.coalesce(*[F.nullif(get(x, f"$.{k}", "string"), F.lit("")) for k in ("entity", "class_name", "label", "name")])

    def score(x: Column) -> Column:
        keys = F.json_object_keys(x.cast("string"))
        out = F.when(F.array_contains(keys, "score"), get(x, "$.score", "string")).when(F.array_contains(keys, "confidence"), get(x, "$.confidence", "string"))
        return F.when(F.array_contains(keys, "score") | F.array_contains(keys, "confidence"), out).otherwise(F.lit("1.0"))

    walked = F.transform(listed, lambda x: F.struct(name(x).alias("name"), score(x).alias("score")))
    found = F.coalesce(official, walked, F.array())
    return F.filter(
        F.transform(found, lambda d: F.struct(normalize(d["name"]).alias("term"), d["score"].try_cast("double").alias("score"))),
        lambda d: (F.coalesce(d["term"], F.lit("")) != "") & d["score"].isNotNull() & ~F.isnan(d["score"]),
    )


def detections(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, keyframe_number, term, score) of all detector files ``<video>/<number>.json``; of several names of one number
    those of three, four and six digits, in that order."""
    text = spark.read.text(f"{path}/*/*.json", wholetext=True)
    name = _stem(F.input_file_name())
    rows = text.select(_folder(F.input_file_name()).alias("video_id"), name.alias("name"), "value").filter(F.length("name").isin(3, 4, 6) & F.col("name").rlike("^[0-9]+$"))
    rows = rows.withColumn("keyframe_number", F.col("name").cast("int"))
    one = rows.groupBy("video_id", "keyframe_number").agg(F.min_by("value", F.length("name")).alias("value"))
    return one.select("video_id", "keyframe_number", F.inline(parse_detections(F.col("value"))))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, n): every image file of a folder's subfolders, with its number; null if its name is none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = listed.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    return found.select(_folder(F.col("path")).alias("video_id"), _stem(F.col("path")).try_cast("int").alias("n"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, n, image_path): the file of each keyframe; of several three digits come before four and six, jpg before jpeg and png."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    rows = listed.select(_folder(F.col("path")).alias("video_id"), F.regexp_extract("path", r"([0-9]+)\.(jpg|jpeg|png)$", 1).alias("d"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("e"))
    rows = rows.filter(F.length("d").isin(3, 4, 6) & F.col("e").isin("jpg", "jpeg", "png"))
    order = F.length("d") * 10 + F.when(F.col("e") == "jpg", 0).when(F.col("e") == "jpeg", 1).otherwise(2)
    name = F.concat_ws("/", F.lit("keyframes"), "video_id", F.concat("d", F.lit("."), "e"))
    return rows.groupBy("video_id", F.col("d").cast("int").alias("n")).agg(F.min_by(name, order).alias("image_path"))


def packages(spark: SparkSession, path: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """(filename, url, group) of a package list; rows without a name or a link are passed over, an empty list is an error."""
    raw = spark.read.option("header", True).csv(path)
    df = raw.select(F.trim("Filenames").alias("filename"), F.trim("Download link").alias("url")).filter("filename <> '' and url <> ''")
    df = df.withColumn("group", package_group(F.col("filename")))
    df = df.filter(F.col("group").isin(*groups)) if groups else df
    if not df.take(1):
        raise ValueError("the package list is empty")
    return df


def package_group(name: Column) -> Column:
    folded = F.lower(name)
    out = None
    for group in PACKAGE_GROUPS:
        out = (F if out is None else out).when(folded.startswith(group), group)
    return out.otherwise("other")


def sheet_csv_url(url: Column) -> Column:
    """The CSV export of a published sheet: the id after ``/d/``, the ``gid`` of the query, else of the fragment, else 0."""
    sheet = F.regexp_extract(url, "/d/([^/?#]+)", 1)
    gid = F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"\?[^#]*\bgid=([0-9]+)", r"#.*\bgid=([0-9]+)")], F.lit("0"))
    return F.when(sheet != "", F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), sheet, F.lit("/export?format=csv&gid="), gid))


__all__ = ["children", "detections", "images", "key_maps", "manifest", "packages", "vectors"]
