"""Listings and matrices read where the tasks are: folders are listed by tasks, and a matrix file is cut into ranges of rows.

Both open files through pyarrow; :func:`reachable` tells whether a path is of a kind that it opens.  Paths of other
stores, which Spark alone can read, go the ways of :mod:`keysift.sources.dataset`.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keysift.ship import ship

SPLIT = 64 << 20
ROWS = 2048  # rows of a matrix that a task holds
SCHEMES = ("", "file", "s3", "gs")


def reachable(path: str) -> bool:
    return urlparse(path).scheme in SCHEMES


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    url = urlparse(path)
    return (pafs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else pafs.FileSystem.from_uri(path)


def _entries(path: str) -> Iterator[pafs.FileInfo]:
    fs, at = _opened(path)
    yield from fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))


def children(spark: SparkSession, path: str) -> DataFrame:
    """(name, folder, size) of what lies in a folder, listed by one task and given on in batches; nothing if there is no folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                rows = [(x.base_name, x.type == pafs.FileType.Directory, x.size or 0) for x in _entries(folder)]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(("name", "folder", "size"), r)) for r in rows[i : i + 10_000]], schema=schema)

    schema = pa.schema([("name", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
    ship(spark)
    return spark.range(1).select(F.lit(path).alias("path")).mapInArrow(run, "name string, folder boolean, size bigint")


def below(folders: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """(id, name, size) of the files in the folders (id) of a path; the folders are dealt to tasks, which list them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = [{"id": name, "name": x.base_name, "size": x.size or 0} for x in _entries(posixpath.join(path, name)) if x.type == pafs.FileType.File]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("id", pa.string()), ("name", pa.string()), ("size", pa.int64())])
    ship(folders.sparkSession)
    tasks = tasks or folders.sparkSession.sparkContext.defaultParallelism
    return folders.select("id").repartition(tasks, "id").mapInArrow(run, "id string, name string, size bigint")


class Range(InputPartition):
    """The rows of a matrix file that begin between two of its bytes."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class NpySource(DataSource):
    """``.npy`` matrices of a folder as (video_id, clip_vector_index, vector), a file for each video.

    A partition is a range of bytes of one file, as for Spark's own formats, and holds ``ROWS`` rows at once whatever the
    file's size.  Options: ``path``, ``split`` (bytes).
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "video_id string, clip_vector_index int, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        files = sorted((x for x in _entries(self.path) if x.type == pafs.FileType.File and x.base_name.endswith(".npy")), key=lambda x: x.path)
        found = [Range(x.path, i, min(i + self.split, x.size)) for x in files for i in range(0, max(x.size, 1), self.split)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        video = posixpath.basename(partition.path).removesuffix(".npy")
        with _opened(self.path)[0].open_input_file(partition.path) as file:
            shape, by_column, kind, start = header(file, video)
            rows, size = shape
            width = size * kind.itemsize
            total = file.size() if callable(file.size) else file.size
            if total < start + rows * width:
                raise ValueError(f"{video}: {total} bytes; {start + rows * width} are needed for {rows} rows of {size}")
            # A row belongs to the range in which it begins; the header counts as part of the first.
            of = lambda byte: min(rows, max(0, -(-(byte - start) // width))) if width else 0
            first, last = 0 if partition.first == 0 else of(partition.first), of(partition.last)
            for i in range(first, last, ROWS):
                n = min(ROWS, last - i)
                if by_column:  # a row's values lie far apart: a read for each column
                    part = np.stack([np.frombuffer(file.read_at(n * kind.itemsize, start + (j * rows + i) * kind.itemsize), kind) for j in range(size)], 1)
                else:
                    part = np.frombuffer(file.read_at(n * width, start + i * width), kind).reshape(n, size)
                flat = pa.array(np.ascontiguousarray(part, np.float32).reshape(-1))
                vectors = pa.FixedSizeListArray.from_arrays(flat, size).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([video] * n), pa.array(range(i, i + n), pa.int32()), vectors], names=["video_id", "clip_vector_index", "vector"])


def header(file, name: str) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """(shape, whether by column, kind of number, where the numbers begin) of an open .npy file."""
    try:
        version = np.lib.format.read_magic(file)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
        shape, by_column, kind = read(file)
    except (ValueError, KeyError) as e:
        raise ValueError(f"{name}: no matrix file that can be read: {e}") from e
    if len(shape) != 2:
        raise ValueError(f"{name}: an array of {len(shape)} dimensions; 2 are needed")
    if kind.hasobject or not np.issubdtype(kind, np.number) or np.issubdtype(kind, np.complexfloating):
        raise ValueError(f"{name}: values of {kind}; numbers are needed")
    return shape, by_column, kind, file.tell()


def matrices(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The vectors of a folder's matrix files, by :class:`NpySource`."""
    ship(spark)
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("path", path).option("split", split).load()
