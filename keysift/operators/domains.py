"""Domains: prototypes, scores of frames by meaning and by objects, and the routing of queries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysift.functions import taxonomy
from keysift.functions.matching import MINIMUM, best_of
from keysift.functions.text import MAX_CANDIDATES, normalize, phrases, plain, tokens
from keysift.functions.vector import cosine01, matrix
from keysift.ship import ship

LEXICAL_WEIGHT = 0.65
MAX_DOMAINS = 3
RELATIVE_THRESHOLD = 0.60


@dataclass(frozen=True)
class Catalog:
    """The domains in order (id, prompt, terms) and the aliases; every text in it is normalised."""

    domains: tuple[tuple[str, str, tuple[str, ...]], ...] = taxonomy.DOMAINS
    aliases: dict[str, str] = field(default_factory=lambda: dict(taxonomy.ALIASES))
    version: int = taxonomy.VERSION

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """A catalog from a JSON file of {version, aliases: {}, domains: [{id, prompt, terms: []}]}."""
        schema = "version int, aliases map<string,string>, domains array<struct<id:string,prompt:string,terms:array<string>>>"
        raw = spark.read.schema(schema).json(path, multiLine=True)
        row = raw.select(
            "version",
            F.expr("map_entries(aliases)").alias("aliases"),
            "domains",
        ).select(
            F.coalesce("version", F.lit(1)).alias("version"),
            F.transform("aliases", lambda e: F.struct(normalize(e["key"]).alias("k"), normalize(e["value"]).alias("v"))).alias("aliases"),
            F.transform("domains", lambda d: F.struct(d["id"].alias("i"), d["prompt"].alias("p"), F.transform(d["terms"], normalize).alias("t"))).alias("domains"),
        ).first()
        return cls(tuple((d["i"], d["p"], tuple(d["t"])) for d in row["domains"]), {e["k"]: e["v"] for e in row["aliases"]}, row["version"])

    @property
    def ids(self) -> list[str]:
        return [d[0] for d in self.domains]


@dataclass(frozen=True)
class Analysis:
    original: str
    normalized: str
    tokens: tuple[str, ...]
    candidates: tuple[str, ...]


def _analysed(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    new = ("normalized", "tokens", "candidates")
    for b in batches:
        texts = [None if t is None else plain(t) for t in b.column(b.schema.get_field_index(column)).to_pylist()]
        words = pa.array([None if t is None else t.split() for t in texts], pa.list_(pa.string()))
        found = pa.array([phrases(t or "", most) for t in texts], pa.list_(pa.string()))
        kept = [n for n in b.schema.names if n not in new]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(texts, pa.string()), words, found], names=[*kept, *new])


def analyses(queries: DataFrame, column: str = "query") -> DataFrame:
    """``queries`` with ``normalized, tokens, candidates``, read where the rows are, a text at a time."""
    ship(queries.sparkSession)
    fields = [f for f in queries.schema.fields if f.name not in ("normalized", "tokens", "candidates")]
    words = T.ArrayType(T.StringType())
    schema = T.StructType([*fields, T.StructField("normalized", T.StringType()), T.StructField("tokens", words), T.StructField("candidates", words)])
    return queries.mapInArrow(lambda batches: _analysed(batches, column, MAX_CANDIDATES), schema)


def analyze(_: SparkSession, query: str) -> Analysis:
    """The same of one query, on the driver."""
    text = plain(query)
    return Analysis(query, text, tuple(text.split()), tuple(phrases(text)))


def alias_terms(catalog: Catalog, analysis: Analysis) -> list[str]:
    """The terms whose alias a query matches, sorted."""
    return sorted({term for alias, term in catalog.aliases.items() if best_of(list(analysis.candidates), alias) >= MINIMUM})


def expanded(catalog: Catalog, analysis: Analysis) -> list[str]:
    """The query's tokens and those of its alias terms, sorted."""
    return sorted({*analysis.tokens, *(t for term in alias_terms(catalog, analysis) for t in term.split())})


def clip_prompt(catalog: Catalog, query: str, analysis: Analysis) -> str:
    terms = alias_terms(catalog, analysis)
    return f"{query}. Visual concepts: {', '.join(terms)}." if terms else query


def lexical_scores(catalog: Catalog, analysis: Analysis) -> list[float]:
    """Of each domain the three best matches of its terms (phrases a fifth more) that reach the minimum, over the best domain's sum."""
    phrases = [*analysis.candidates, *alias_terms(catalog, analysis)]
    sums = []
    for _, _, terms in catalog.domains:
        matches = sorted((best_of(phrases, t) * (1.2 if " " in t else 1.0) for t in terms), reverse=True)
        sums.append(sum(m for m in matches[:3] if m >= MINIMUM))
    top = max(sums, default=0.0)
    return [s / top for s in sums] if top > 0 else sums


@dataclass(frozen=True)
class Route:
    domain_ids: tuple[str, ...]
    scores: dict[str, float]
    lexical: dict[str, float]
    expanded: tuple[str, ...]
    analysis: Analysis


def route(
    catalog: Catalog, prototypes: list[list[float]], analysis: Analysis, query_vector, *,
    lexical_weight: float = LEXICAL_WEIGHT, max_domains: int = MAX_DOMAINS, threshold: float = RELATIVE_THRESHOLD,
) -> Route:
    """The best domains of a query; words of the vocabulary weigh more than meaning, which alone counts where there are none."""
    if len(prototypes) != len(catalog.domains):
        raise ValueError("there must be one prototype for each domain")
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    semantic = (np.clip(unit(np.asarray(prototypes, float)) @ unit(np.asarray(query_vector, float)), -1, 1) + 1) / 2
    lexical = np.array(lexical_scores(catalog, analysis))
    weight = lexical_weight if lexical.max(initial=0.0) > 0 else 0.0
    scores = weight * lexical + (1 - weight) * semantic
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    chosen = [i for i in order[:max_domains] if scores[i] >= threshold * scores[order[0]]] or order[:1]
    ids = catalog.ids
    return Route(
        tuple(ids[i] for i in chosen), dict(zip(ids, scores.tolist())), dict(zip(ids, lexical.tolist())),
        tuple(expanded(catalog, analysis)), analysis,
    )


def object_domain_scores(objects: DataFrame, catalog: Catalog, key: str) -> DataFrame:
    """(key, object_domains): for each domain half of the tokens it shares with a frame's terms, 1 at most, as an array in catalog order."""
    words = objects.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set(tokens(F.col("term"))))).alias("_words"))
    scores = []
    for _, _, terms in catalog.domains:
        own = F.array(*[F.lit(t) for t in sorted({w for term in terms for w in term.split()})])
        scores.append(F.least(F.lit(1.0), F.size(F.array_intersect("_words", own)) / 2))
    return words.select(key, F.array(*scores).alias("object_domains"))


def with_semantic_scores(df: DataFrame, prototypes: Sequence[Sequence[float]], column: str = "vector", out: str = "semantic") -> DataFrame:
    """``df`` with the scores of :func:`semantic_domain_scores` for a column of vectors of any length, in place of it.

    A batch is worked out a dimension at a time, so sums run in the order of dimensions and equal prototypes have equal scores.
    """
    own = np.asarray(prototypes, np.float64)
    own = own / np.maximum(np.sqrt(_in_order(own, own)), 1e-12)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            if len(b):
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
                x = x / np.maximum(np.sqrt(_in_order(x, x)), 1e-12)[:, None]
                scores = (np.clip(_in_order(x[:, None, :], own[None, :, :]), -1, 1) + 1) / 2
                flat = pa.FixedSizeListArray.from_arrays(pa.array(scores.reshape(-1)), len(own)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), flat], names=[*(n for n in b.schema.names if n != column), out])

    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != column]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of two arrays summed over their last axis, one value after another."""
    total = 0.0
    for i in range(a.shape[-1]):
        total = total + a[..., i] * b[..., i]
    return total


def semantic_domain_scores(vector: Column, prototypes: list[list[float]]) -> Column:
    """The cosine of a unit vector with each unit prototype, from 0 to 1, as an array; a few prototypes are one literal of the plan."""
    return F.transform(matrix(prototypes), lambda p: cosine01(vector, p))


def fused_domain_scores(semantic: Column, objects: Column) -> Column:
    return F.zip_with(semantic, objects, lambda s, o: F.greatest(s, F.coalesce(o, F.lit(0.0))))


def top_domains(scores: DataFrame, key: str, n: int = 2) -> DataFrame:
    """(key, domain, score, place): of each frame its ``n`` best domains from (key, domain, score), of equal ones the first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "domain"))
    return scores.withColumn("place", place).filter(F.col("place") <= n)


def best_of_array(scores: Column, n: int) -> Column:
    """The indexes of the ``n`` largest scores of an array, of equal ones the first; needs no shuffle."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["i"])
