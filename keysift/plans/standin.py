"""The test tables in the roles of a keyframe dataset: embeddings are frames, documents their texts and objects, conversations queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.vector import mean_by, unit

QUERY_ID = 7
ROUTED = (0, 1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, collection_id, label, vector), the vectors of length 1."""
    df = table(spark, sf_dir, "embeddings")
    collection = F.concat(F.lit("L"), (F.lit(21) + F.col("vec_id") % 3).cast("string"))
    return df.select(F.col("vec_id").alias("position"), collection.alias("collection_id"), "label", unit(F.col("embedding")).alias("vector"))


def query_vector(df: DataFrame, position: int = QUERY_ID) -> list[float]:
    """One frame's vector, as the query's."""
    return list(df.filter(F.col("position") == position).first()["vector"])


def prototypes(df: DataFrame) -> list[tuple[int, list[float]]]:
    """(label, unit mean vector) in order of the label: one row for each of a few domains."""
    size = df.select(F.size("vector")).first()[0]
    rows = mean_by(df, "label", "vector", size).select("label", unit(F.col("mean")).alias("p")).orderBy("label").collect()
    return [(r["label"], list(r["p"])) for r in rows]


@dataclass(frozen=True)
class LengthEncoder:
    """Gives a text one of a few vectors, by the number of its characters."""

    vectors: tuple[tuple[float, ...], ...]

    @property
    def dimensions(self) -> int:
        return len(self.vectors[0])

    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        known = np.asarray(self.vectors)
        return lambda texts: known[[len(t) % len(known) for t in texts]]
