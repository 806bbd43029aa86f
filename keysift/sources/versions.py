"""Versioned folders: a new version is written beside the current one and becomes current by one small file."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """The names of the pointers, the newest last; each is written once and never replaced."""
    fs, new = _fs(spark, path)
    if not fs.exists(new(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(new(path))]
    return sorted(n for n in names if n.startswith(f"{POINTER}-"))


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version: the one that the newest pointer names."""
    found = _pointers(spark, path)
    if not found:
        raise FileNotFoundError(f"no version has been published at {path}")
    return f"{path}/{found[-1].rpartition('-')[2]}"


@contextmanager
def publish(spark: SparkSession, path: str) -> Iterator[str]:
    """Yields a new folder; when its writer ends well it becomes current, else it is removed and the old one stays.

    The new version becomes current by one atomic step, the making of an empty file whose name has a number and the
    version's folder; a crash at any time leaves a current version.  The one before is kept, older ones are removed.
    """
    fs, new = _fs(spark, path)
    name = f"v{uuid.uuid4().hex}"
    try:
        yield f"{path}/{name}"
        before = _pointers(spark, path)
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        pointer = f"{POINTER}-{number:012d}-{name}"
        fs.create(new(f"{path}/{pointer}"), False).close()
    except BaseException:
        fs.delete(new(f"{path}/{name}"), True)
        raise
    kept = [*before[-1:], pointer]
    folders = {p.rpartition("-")[2] for p in kept}
    for status in fs.listStatus(new(path)):
        found = status.getPath().getName()
        old = found.startswith(f"{POINTER}-") and found < kept[0]
        if old or re.fullmatch("v[0-9a-f]{32}", found) and found not in folders:
            fs.delete(status.getPath(), True)
