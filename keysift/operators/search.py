"""Queries over the index: budgeted candidates with a fallback, the hybrid rerank, search and inspect."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from importlib import import_module

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.functions.encoder import TextEncoder, encode_texts
from keysift.functions.matching import best_match
from keysift.functions.vector import constant, cosine01, l2
from keysift.operators import bow, spatial
from keysift.operators.domains import Route, analyze, best_of_array, clip_prompt, route
from keysift.operators.index import Index, tree_key
from keysift.sources.shared import stored

Encoding = Callable[[list[str]], np.ndarray] | TextEncoder
CLIP, OBJECT, DOMAIN = 0.82, 0.12, 0.06
MAX_QUERY, MAX_COLLECTIONS, MAX_TOP = 500, 50, 100
TAG = re.compile(r"#(L\d+)\b", re.IGNORECASE)


def candidate_budget(top_k: int) -> int:
    return max(25 * top_k, 500)


def budgets(candidate_k: int, routed: int) -> tuple[int, int]:
    """How many candidates each routed part and each fallback part may add."""
    return max(candidate_k // max(routed, 1), 1), max(candidate_k // 3, 50)


def nearest(points: DataFrame, query: Sequence[float], parts: str, k: int | Column) -> DataFrame:
    """``points`` with ``distance`` to the query and ``place``, in each part those up to the k-th distance, ties included.

    Spark keeps the best k of each part before the shuffle, so a part that holds all rows sends only those.
    """
    df = points.withColumn("distance", l2(F.col("reduced"), constant(query)))
    return df.withColumn("place", F.rank().over(Window.partitionBy(parts).orderBy("distance"))).filter(F.col("place") <= k)


def first_seen(found: DataFrame) -> DataFrame:
    """``found`` (ord, place, position, ...) with ``is_new``: true where a position is met first in the order of parts."""
    order = Window.partitionBy("position").orderBy("ord", "place")
    return found.withColumn("is_new", F.row_number().over(order) == 1)


def candidates(index: Index, query_reduced: Sequence[float], domain_ids: Sequence[str], collections: Sequence[str], candidate_k: int) -> tuple[DataFrame, DataFrame]:
    """(found, trace): found has (ord, position, collection_id, home, place, is_new); trace has a row for each part that was asked.

    Parts that the index doesn't have, or that have no frame, are dropped before the budget is shared out.
    """
    counts = index.meta["tree_counts"]
    wanted = [c.upper() for c in collections]
    routed = [(c, d) for c in wanted or [None] for d in domain_ids]
    fallback = [(c, None) for c in wanted or [None]]
    routed = [x for x in routed if counts.get(tree_key(*x))]
    fallback = [x for x in fallback if counts.get(tree_key(*x))]
    per_part, per_fallback = budgets(candidate_k, len(routed))
    spark = index.spark
    most = [per_part] * len(routed) + [per_fallback] * len(fallback)
    rows = [(i, tree_key(*x), list(map(float, query_reduced)), k) for i, (x, k) in enumerate(zip(routed + fallback, most))]
    asks = spark.createDataFrame(rows, "ask int, part string, query array<double>, k int")
    found = spatial.nearest(asks, index.parts, index.points).withColumnRenamed("ask", "ord")
    found = first_seen(found.select("ord", "position", "collection_id", "home", "place"))
    asked = [
        (i, tree_key(*x), "routed" if i < len(routed) else "fallback", counts[tree_key(*x)], per_part if i < len(routed) else per_fallback)
        for i, x in enumerate(routed + fallback)
    ]
    parts = spark.createDataFrame(asked, "ord int, tree_key string, role string, entry_count bigint, requested int")
    sums = found.groupBy("ord").agg(F.count(F.lit(1)).alias("returned"), F.count_if("is_new").alias("new_unique_candidates"))
    trace = parts.join(sums, "ord", "left").na.fill(0, ["returned", "new_unique_candidates"]).orderBy("ord")
    return found, trace


def query_terms(index: Index, r: Route) -> DataFrame:
    """(term, score): the vocabulary that the query's phrases match."""
    phrases = list(dict.fromkeys([*r.analysis.candidates, *r.expanded]))
    # At most 32 phrases and the query's own tokens: literals of the plan, no second table.
    pairs = index.vocab.select("term", F.col("term").alias("target"), F.explode(F.array(*[F.lit(p) for p in phrases])).alias("candidate"))
    return best_match(pairs, ["term"])


def fuse(clip: Column, objects: Column, domain: Column) -> Column:
    return CLIP * clip + OBJECT * objects + DOMAIN * domain


def at_home(index: Index, found: DataFrame) -> DataFrame:
    """The frames of (collection_id, home, position); only the tiles that they lie in are opened."""
    wanted = found.select("collection_id", F.col("home").alias("tile"), "position").distinct()
    keys = ["collection_id", "tile"]
    return spatial.named(index.frames, wanted, keys).join(wanted, [*keys, "position"], "left_semi")


def rerank(index: Index, query_vector: Sequence[float], r: Route, positions: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` best of the candidate positions by vector, objects and domain; ties by position."""
    q = np.asarray(query_vector, float)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    frames = at_home(index, positions)
    weights = constant([r.scores[i] for i in index.catalog.ids])
    frames = frames.withColumn("clip_score", cosine01(F.col("vector"), constant(q)))
    frames = frames.withColumn("domain_score", F.array_max(F.zip_with("domain_scores", weights, lambda s, w: s * w)))
    hits = frames.select("position", F.inline("objects"))
    scores = bow.object_scores(hits, index.vocab.select("term", "idf"), query_terms(index, r), "position")
    frames = frames.join(scores, "position", "left").withColumn("object_score", F.coalesce("object_score", F.lit(0.0)))
    frames = frames.withColumn("score", fuse(F.col("clip_score"), F.col("object_score"), F.col("domain_score")))
    return frames.orderBy(F.desc("score"), "position").limit(top_k)


def video_file() -> Column:
    """The path of a frame's video, by its id where the manifest has none."""
    return F.coalesce(F.nullif("video_path", F.lit("")), F.format_string("videos/%s.mp4", "video_id"))


def project(ranked: DataFrame, catalog_ids: Sequence[str], routed: Sequence[str]) -> DataFrame:
    """The result rows of a search, in rank order; the ranked rows are at most ``MAX_TOP``."""
    names = F.array(*[F.lit(i) for i in catalog_ids])
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "position"))
    return ranked.select(
        rank.alias("rank"), "keyframe_id", "collection_id", "video_id", "keyframe_number", "clip_vector_index", "frame_number", "timestamp_ms",
        "image_path", video_file().alias("video_path"), "score",
        F.transform(best_of_array(F.col("domain_scores"), 2), lambda i: F.get(names, i)).alias("domains"),
        F.coalesce("matched", F.array().cast("array<string>")).alias("matched_objects"),
        F.create_map(F.lit("clip"), "clip_score", F.lit("object_bow"), "object_score", F.lit("domain"), "domain_score").alias("score_components"),
        F.array(*[F.lit(i) for i in routed]).alias("routed_domains"),
    ).orderBy("rank")


@dataclass(frozen=True)
class Request:
    """A request as a user writes it, read: the query without its tags, all collection ids, the number of results."""

    query: str
    collections: tuple[str, ...]
    top_k: int


def read_request(query: str, collections: Sequence[str] = (), top_k: int = MAX_TOP) -> Request:
    """Reads ``#L21`` and the like out of a query and adds them to the collection ids, each once, those given before those tagged.

    An error if the request is out of bounds or has nothing but tags.
    """
    given = check_request(query, collections, top_k)
    tags = [t.upper() for t in re.findall(TAG, query)]
    clean = " ".join(re.sub(r"#(?=\w)", "", re.sub(TAG, " ", query)).split())
    if not clean:
        raise ValueError("the query is empty but for tags")
    return Request(clean, tuple(dict.fromkeys([*given, *tags])), top_k)


def prepare(index: Index, query: str, encode: Encoding) -> tuple[str, list[float], Route]:
    """The prompt, its vector and the route of a query without tags."""
    analysis = analyze(index.spark, query)
    prompt = clip_prompt(index.catalog, query, analysis)
    vector = np.asarray(encode_texts(encode, [prompt]) if hasattr(encode, "load") else encode([prompt]), float)[0]
    return prompt, vector.tolist(), route(index.catalog, index.meta["prototypes"], analysis, vector)


def search(index: Index, query: str, encode: Encoding, *, collections: Sequence[str] = (), top_k: int = MAX_TOP) -> DataFrame:
    """The frames that match a query best, in rank order; the request is read by :func:`read_request`."""
    asked = read_request(query, collections, top_k)
    _, vector, r = prepare(index, asked.query, encode)
    found, _ = candidates(index, index.pca.reduce_query(vector), r.domain_ids, asked.collections, candidate_budget(top_k))
    found = stored(found.filter("is_new").select("collection_id", "home", "position"), "candidates")
    ranked = rerank(index, vector, r, found, top_k)
    return project(ranked, index.catalog.ids, r.domain_ids)


def with_urls(rows: DataFrame, base: str) -> DataFrame:
    """The rows of :func:`search` as a client gets them: clean paths, their addresses under ``base``, and ``frame_id``."""
    clean = lambda c: F.ltrim(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), F.lit("/"))
    url = lambda c: F.concat(F.lit(base.rstrip("/") + "/"), F.col(c))
    video = F.when(F.trim("video_path") != "", clean("video_path")).otherwise(F.format_string("videos/%s.mp4", "video_id"))
    rows = rows.withColumns({"image_path": clean("image_path"), "video_path": video, "frame_id": F.col("frame_number")})
    return rows.withColumns({"image_url": url("image_path"), "video_url": url("video_path")})


def function_at(path: str) -> Callable:
    """The function that a dotted path names, so that another search can be put in this one's place."""
    module, _, name = path.rpartition(".")
    try:
        return getattr(import_module(module), name)
    except (ValueError, ImportError, AttributeError, OSError) as e:
        raise LookupError(f"no function can be loaded at {path}") from e


def inspect(index: Index, query: str, encode: Encoding, *, collections: Sequence[str] = (), top_k: int = MAX_TOP) -> dict:
    """How a query is read, routed and searched for, without the rerank."""
    asked = read_request(query, collections, top_k)
    prompt, vector, r = prepare(index, asked.query, encode)
    k = candidate_budget(top_k)
    _, trace = candidates(index, index.pca.reduce_query(vector), r.domain_ids, asked.collections, k)
    trees = [{c: row[c] for c in trace.columns if c != "ord"} for row in trace.collect()]  # a row for each part asked
    order = sorted(index.catalog.ids, key=lambda i: -r.scores[i])
    matched = query_terms(index, r).orderBy(F.desc("score"), "term").collect()  # what one query matches of the vocabulary
    return {
        "query": asked.query, "clip_query": prompt,
        "analysis": {
            "normalized_query": r.analysis.normalized, "keyword_candidates": list(r.analysis.candidates), "expanded_terms": list(r.expanded),
            "matched_object_vocabulary": [{"term": m["term"], "match_score": m["score"]} for m in matched],
        },
        "routing": {
            "selected_domains": list(r.domain_ids),
            "domains": [{"domain_id": i, "selected": i in r.domain_ids, "score": r.scores[i], "lexical_score": r.lexical[i]} for i in order],
        },
        "candidate_trace": {
            "requested_candidate_k": k, "unique_candidate_count": sum(t["new_unique_candidates"] for t in trees),
            "collection_ids": list(asked.collections), "selected_domains": list(r.domain_ids), "trees": trees,
        },
        "index": {c: index.meta[c] for c in ("format_version", "record_count", "feature_dimension", "pca_dimensions")} | {"tree_count": len(index.meta["tree_counts"])},
    }


def check_request(query: str, collections: Sequence[str], top_k: int) -> list[str]:
    """The collection ids of a request in upper case, each once; an error where it is out of bounds."""
    if not 1 <= len(query or "") <= MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    if not 1 <= top_k <= MAX_TOP:
        raise ValueError(f"top_k is 1 to {MAX_TOP}")
    ids = list(dict.fromkeys(c.strip().upper() for c in collections))
    if len(collections) > MAX_COLLECTIONS or any(not re.fullmatch(r"L[0-9]+", c) for c in ids):
        raise ValueError("collection ids are L and a number, 50 at most")
    return ids
