"""The index: stored tables of frames, membership, bags, vocabulary, domains and PCA, built and published as one version."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.functions.encoder import TextEncoder, encode_texts
from keysift.functions.text import let
from keysift.functions.vector import constant, dot, linspace_positions, matrix, unit, valid
from keysift.operators import bow
from keysift.operators.domains import Catalog, best_of_array, fused_domain_scores, object_domain_scores
from keysift.operators.spatial import TILE_ROWS, boxes, fit_tree, placed, tile_size, tiled
from keysift.ship import ship
from keysift.sources.shared import remove

FORMAT_VERSION = 3
TABLES = ("frames", "membership", "tiles", "bow", "vocab")


@dataclass(frozen=True)
class BuildOptions:
    pca_dimensions: int = 24
    pca_sample_size: int = 50_000
    domains_per_frame: int = 2
    object_min_score: float = bow.MIN_SCORE
    max_object_terms: int = bow.MAX_TERMS
    tile_rows: int = TILE_ROWS


@dataclass(frozen=True)
class Pca:
    mean: list[float]
    components: list[list[float]]

    def reduce(self, vector: Column) -> Column:
        """The centred vector in the space of the components."""
        centred = F.zip_with(vector, constant(self.mean), lambda x, m: x.cast("double") - m)
        return let(centred, lambda v: F.transform(matrix(self.components), lambda c: dot(v, c)))

    def reduce_query(self, vector) -> list[float]:
        v = np.asarray(vector, float).reshape(-1)
        if len(v) != len(self.mean):
            raise ValueError(f"a query vector of {len(v)} values; the index has {len(self.mean)}")
        return ((v - np.asarray(self.mean)) @ np.asarray(self.components).T).tolist()


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (n, sums, products) of a task's vectors: their number, sum and the sum of their outer products."""
    n, sums, products = 0, None, None
    for b in batches:
        column = b.column(0)
        if len(b):
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(b), -1)
            n, sums, products = n + len(x), x.sum(0) + (0 if sums is None else sums), x.T @ x + (0 if products is None else products)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums]), pa.array([products.ravel()])], names=["n", "sums", "products"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`_moments` as one, a row at a time."""
    total = None
    for b in batches:
        for i in range(len(b)):
            row = [b.column(c)[i].values.to_numpy(zero_copy_only=False) if c else b.column(0)[i].as_py() for c in range(3)]
            total = row if total is None else [x + y for x, y in zip(total, row)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]]), pa.array([total[2]])], names=["n", "sums", "products"])


def moments(vectors: DataFrame, ways: int = 16) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) of the vectors of the first column, in one pass: partial sums of tasks, merged ``ways`` at a time and then all."""
    ship(vectors.sparkSession)
    schema = "n bigint, sums array<double>, products array<double>"
    row = vectors.mapInArrow(_moments, schema).repartition(ways).mapInArrow(_merged, schema).repartition(1).mapInArrow(_merged, schema).first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = np.asarray(row["sums"]) / row["n"]
    return row["n"], mean, np.asarray(row["products"]).reshape(len(mean), -1) / row["n"] - np.outer(mean, mean)


def fit_pca(frames: DataFrame, rows: int, *, dimensions: int = 24, sample: int = 50_000) -> Pca:
    """PCA of (position, vector) over evenly spaced positions, of which there are ``rows``; the sample's bound is a parameter.

    A component's sign is that which makes its largest value positive.
    """
    chosen = frames.sparkSession.range(1).select(F.explode(linspace_positions(rows, sample)).alias("position"))
    part = frames.join(F.broadcast(chosen), "position", "left_semi").select(F.transform("vector", lambda x: x.cast("double")).alias("v"))
    n, mean, covariance = moments(part)
    k = min(dimensions, n, len(mean))
    if k < 2:
        raise ValueError("PCA needs two dimensions and two frames at least")
    _, found = np.linalg.eigh(covariance)  # least variance first
    components = found[:, ::-1][:, :k].T
    largest = components[np.arange(k), np.abs(components).argmax(1)]
    return Pca(mean.tolist(), (components * np.sign(largest)[:, None]).tolist())


def projected(frames: DataFrame, prototypes: Sequence[Sequence[float]], pca: Pca) -> DataFrame:
    """``frames`` with ``vector`` of length 1, its cosine with each prototype (from 0 to 1) as ``semantic`` and ``reduced``: matrix products, a batch at a time."""
    own, mean, components = (np.asarray(x, np.float64) for x in (prototypes, pca.mean, pca.components))

    def lists(x: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("vector")
            for i in range(0, len(b), 2048):
                part = b.slice(i, 2048)
                x = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                new = [lists(x), lists((np.clip(x @ own.T, -1, 1) + 1) / 2), lists((x - mean) @ components.T)]
                kept = [c for k, c in enumerate(part.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*(n for n in part.schema.names if n != "vector"), "vector", "semantic", "reduced"])

    ship(frames.sparkSession)
    doubles = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("vector", "semantic", "reduced")]
    return frames.mapInArrow(run, T.StructType([f for f in frames.schema.fields if f.name != "vector"] + doubles))


def membership(frames: DataFrame, ids: list[str], n: int = 2) -> DataFrame:
    """(collection_id, domain_id, position, reduced): each frame in its ``n`` best domains; and ``home`` and ``_leaf`` where the frames have them."""
    names = F.array(*[F.lit(i) for i in ids])
    best = F.transform(best_of_array(F.col("domain_scores"), n), lambda i: F.get(names, i))
    return frames.select("collection_id", F.explode(best).alias("domain_id"), "position", "reduced", *[c for c in ("home", "_leaf") if c in frames.columns])


def tree_counts(members: DataFrame, domain_ids: Sequence[str] = ()) -> DataFrame:
    """(collection_id, domain_id, entries) of all, each collection, each domain and each of both; null stands for all.

    Of ``domain_ids`` also those without an entry, in all and in each collection, are counted, as 0.
    """
    counts = members.groupingSets(
        [[], ["collection_id"], ["domain_id"], ["collection_id", "domain_id"]], "collection_id", "domain_id"
    ).agg(F.count_distinct("position").alias("entries"))
    if not domain_ids:
        return counts
    own = F.array(*[F.lit(d) for d in domain_ids])
    every = counts.filter("domain_id is null").select("collection_id", F.explode(own).alias("domain_id"), F.lit(0).cast("long").alias("entries"))
    return counts.unionByName(every).groupBy("collection_id", "domain_id").agg(F.max("entries").alias("entries"))


def part_counts(tiles: DataFrame, domain_ids: Sequence[str]) -> dict[str, int]:
    """The entries of each part by :func:`tree_key`, those of :func:`tree_counts`, from the tiles' rows: a position is in a collection once, and in a domain once."""
    rows = tiles.groupBy("grain", "collection_id", "domain_id").agg(F.sum("rows").alias("n")).collect()  # a row for each collection and domain
    collections = sorted({r["collection_id"] for r in rows}, key=lambda c: (c is None, c))
    counts = dict.fromkeys([tree_key(c, d) for c in [None, *collections] for d in domain_ids], 0)
    for r in rows:
        for c in {None, r["collection_id"]}:
            key = tree_key(c, r["domain_id"] if r["grain"] == "membership" else None)
            counts[key] = counts.get(key, 0) + r["n"]
    return counts


def check(frames: DataFrame) -> int:
    """The number of frames; an error names how many break a rule, with examples."""
    size = F.size("vector")
    row = frames.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("vector").isNull() | ~valid(F.col("vector"))).alias("invalid"),
        F.min(size).alias("least"), F.max(size).alias("most"),
    ).first()
    if not row["rows"]:
        raise ValueError("the manifest has no frames")
    if row["invalid"]:
        some = [r["keyframe_id"] for r in frames.filter(F.col("vector").isNull() | ~valid(F.col("vector"))).select("keyframe_id").limit(5).collect()]
        raise ValueError(f"{row['invalid']} frames without a valid vector, such as {some}")
    if row["least"] != row["most"]:
        raise ValueError(f"vectors of {row['least']} to {row['most']} values")
    return row["rows"]


def build(
    manifest: DataFrame, vectors: DataFrame, detections: DataFrame, path: str, encode: Callable[[list[str]], np.ndarray] | TextEncoder, *,
    catalog: Catalog | None = None, options: BuildOptions | None = None, models: dict | None = None,
) -> dict:
    """Writes an index and makes it the current one at ``path``; returns its metadata.

    ``manifest`` has a unique ``position``; ``vectors`` are (video_id, clip_vector_index, vector), ``detections``
    (video_id, keyframe_number, term, score).
    """
    from keysift.sources.versions import publish

    spark, catalog, options = manifest.sparkSession, catalog or Catalog(), options or BuildOptions()
    prompts = [prompt for _, prompt, _ in catalog.domains]
    prototypes = np.asarray(encode_texts(encode, prompts) if hasattr(encode, "load") else encode(prompts), float)

    with publish(spark, path) as at:
        # The join of frames and vectors is written once; all that follows reads it.
        manifest.join(vectors, ["video_id", "clip_vector_index"], "left").write.parquet(f"{at}/joined")
        frames = spark.read.parquet(f"{at}/joined")
        rows = check(frames)
        size = frames.select(F.size("vector")).first()[0]
        if prototypes.shape != (len(catalog.domains), size):
            raise ValueError(f"prototypes of shape {prototypes.shape}; {(len(catalog.domains), size)} is needed")
        prototypes = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).tolist()

        keys = manifest.select("position", "video_id", "keyframe_number")
        found = keys.join(detections, ["video_id", "keyframe_number"]).select("position", "term", "score")
        bow.bags(found, "position", min_score=options.object_min_score, max_terms=options.max_object_terms).write.parquet(f"{at}/bow")
        bag = spark.read.parquet(f"{at}/bow")
        bow.idf(bow.document_frequency(bag), rows).write.parquet(f"{at}/vocab")

        sample = frames.select("position", unit(F.col("vector")).alias("vector"))
        pca = fit_pca(sample, rows, dimensions=options.pca_dimensions, sample=options.pca_sample_size)
        objects = object_domain_scores(bag, catalog, "position")
        held = bag.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("objects"))  # ``max_object_terms`` at most
        none = F.array(*[F.lit(0.0)] * len(catalog.domains))
        frames = projected(frames, prototypes, pca).join(objects, "position", "left").join(held, "position", "left")
        frames = frames.withColumn("domain_scores", fused_domain_scores(F.col("semantic"), F.coalesce("object_domains", none))).drop("object_domains", "semantic")
        frames.write.parquet(f"{at}/scored")  # tiles are counted before they are dealt
        frames = spark.read.parquet(f"{at}/scored")
        remove(spark, f"{at}/joined")

        step = max(1, -(-rows // options.pca_sample_size))
        sample = [r["reduced"] for r in frames.filter(F.col("position") % step == 0).select("reduced").collect()]  # a bounded sample
        tile_rows = tile_size(rows, options.tile_rows)
        tree = fit_tree(np.asarray(sample).reshape(-1, len(pca.components)), rows, tile_rows)
        tiled(frames, ["collection_id"], tree, tile_rows).write.partitionBy("collection_id", "tile").parquet(f"{at}/frames")
        stored = spark.read.parquet(f"{at}/frames")
        homes = placed(tree.leaves(frames.select("collection_id", "position", "reduced", "domain_scores")), ["collection_id"], tree, tile_rows)
        members = membership(homes.withColumnRenamed("tile", "home"), catalog.ids, options.domains_per_frame)
        parts = ["collection_id", "domain_id"]
        tile_rows = tile_size(rows * options.domains_per_frame, options.tile_rows)  # the bound on folders holds for each grain
        tiled(members, parts, tree, tile_rows).write.partitionBy(*parts, "tile").parquet(f"{at}/membership")
        members = spark.read.parquet(f"{at}/membership")
        own = boxes(stored, ["collection_id"], len(pca.components)).withColumn("domain_id", F.lit(None).cast("string"))
        both = own.withColumn("grain", F.lit("frames")).unionByName(boxes(members, parts, len(pca.components)).withColumn("grain", F.lit("membership")))
        both.coalesce(1).write.parquet(f"{at}/tiles")  # a row for each tile
        remove(spark, f"{at}/scored")
        counts = part_counts(spark.read.parquet(f"{at}/tiles"), catalog.ids)
        meta = {
            "format_version": FORMAT_VERSION, "created_at": datetime.now(UTC).isoformat(), "record_count": rows, "feature_dimension": size,
            "vocabulary_count": spark.read.parquet(f"{at}/vocab").count(),
            "pca_dimensions": len(pca.components), "options": asdict(options), "models": models or {}, "prototypes": prototypes,
            "pca": asdict(pca), "domains": [list(d[:2]) + [list(d[2])] for d in catalog.domains], "aliases": catalog.aliases,
            "tree_counts": counts,
        }
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/metadata")
    return meta


def tree_key(collection: str | None, domain: str | None) -> str:
    """The name of a part of the index, as it stands in counts and traces."""
    if collection is None:
        return "global" if domain is None else f"domain:{domain}"
    return f"collection:{collection}" if domain is None else f"collection_domain:{collection}:{domain}"


@dataclass
class Index:
    """An opened index; its tables are read when a query needs them."""

    spark: SparkSession
    path: str
    meta: dict
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, whole: bool = False) -> Index:
        """The current index at ``path``, after the counts of its tables are held against its metadata; ``whole`` also holds the bags' terms against the vocabulary."""
        from keysift.sources.versions import current

        at = current(spark, path)
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{at}/metadata").collect()))
        if meta.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"index format {meta.get('format_version')}; {FORMAT_VERSION} is needed")
        found = cls(spark, at, meta)
        if found.frames.count() != meta["record_count"]:
            raise ValueError("the index is incomplete: frames are missing")
        # The vocabulary is that of the stored bags, each term once with its IDF.
        terms = found.bow.select("term").distinct().join(found.vocab.select("term", "idf"), "term", "full_outer")
        used = found.vocab.count()
        if used != meta["vocabulary_count"] or found.vocab.filter("idf is null").take(1) or (whole and terms.count() != used):
            raise ValueError("the index is incomplete: the vocabulary and its IDF differ")
        held = {r["grain"]: r["n"] for r in found.tiles.groupBy("grain").agg(F.sum("rows").alias("n")).collect()}
        if held.get("frames") != meta["record_count"]:
            raise ValueError("the index is incomplete: tiles are missing")
        return found

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:  # its folders are listed once
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._read[name]

    @property
    def frames(self) -> DataFrame:
        return self._table("frames")

    @property
    def members(self) -> DataFrame:
        return self._table("membership")

    @property
    def tiles(self) -> DataFrame:
        return self._table("tiles")

    @property
    def parts(self) -> DataFrame:
        """The tiles, each once for every part of the index that it belongs to."""
        one = F.concat_ws(":", F.lit("collection"), "collection_id")
        of_frames = F.array(F.lit(tree_key(None, None)), one)
        of_members = F.array(F.concat_ws(":", F.lit("domain"), "domain_id"), F.concat_ws(":", F.lit("collection_domain"), "collection_id", "domain_id"))
        return self.tiles.withColumn("part", F.explode(F.when(F.col("grain") == "frames", of_frames).otherwise(of_members)))

    @property
    def points(self) -> dict[str, tuple[DataFrame, list[str]]]:
        """Of each grain its points and what its folders are named by."""
        frames = self.frames.select("collection_id", "tile", "position", F.col("tile").alias("home"), "reduced")
        return {"frames": (frames, ["collection_id", "tile"]), "membership": (self.members, ["collection_id", "domain_id", "tile"])}

    @property
    def bow(self) -> DataFrame:
        return self._table("bow")

    @property
    def vocab(self) -> DataFrame:
        return self._table("vocab")

    @property
    def catalog(self) -> Catalog:
        return Catalog(tuple((i, p, tuple(t)) for i, p, t in self.meta["domains"]), dict(self.meta["aliases"]))

    @property
    def pca(self) -> Pca:
        return Pca(**self.meta["pca"])
