"""Routing a table of queries: which domains each query belongs to, as one plan for all of them.

The same rules as :func:`keysift.operators.domains.route` has for one query on the driver; here phrases, aliases and
terms meet by keys, sums and thresholds are windows over a query's few domains, and no query passes the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keysift.functions.matching import MINIMUM, join_terms
from keysift.functions.text import tokens
from keysift.operators.domains import LEXICAL_WEIGHT, MAX_DOMAINS, RELATIVE_THRESHOLD, Catalog, analyses, with_semantic_scores

PHRASE_WEIGHT = 1.2


def phrases_of(analysed: DataFrame) -> DataFrame:
    """(query_id, candidate) of the rows of :func:`analyses`."""
    return analysed.select("query_id", F.explode("candidates").alias("candidate"))


def alias_terms(analysed: DataFrame, catalog: Catalog, *, fuzzy: bool = True) -> DataFrame:
    """(query_id, term): the terms whose alias a query matches, each once."""
    spark = analysed.sparkSession
    aliases = spark.createDataFrame(sorted(catalog.aliases.items()), "target string, term string")
    found = join_terms(phrases_of(analysed), aliases, ["query_id"], least=MINIMUM, fuzzy_too=fuzzy)
    return found.join(aliases, "target").select("query_id", "term").distinct()


def prompts(analysed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, prompt): the query as an encoder gets it, with the terms of its aliases."""
    terms = aliases.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # a catalog's terms at most
    prompt = F.when(F.col("terms").isNotNull(), F.concat(F.col("query"), F.lit(". Visual concepts: "), F.array_join("terms", ", "), F.lit(".")))
    return analysed.join(terms, "query_id", "left").select("query_id", F.coalesce(prompt, F.col("query")).alias("prompt"))


def expanded(analysed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, term): the query's tokens and those of its alias terms, each once."""
    own = analysed.select("query_id", F.explode("tokens").alias("term"))
    return own.unionByName(aliases.select("query_id", F.explode(tokens(F.col("term"))).alias("term"))).distinct()


def lexical_scores(analysed: DataFrame, aliases: DataFrame, catalog: Catalog, *, fuzzy: bool = True) -> DataFrame:
    """(query_id, ord, lexical) of the domains that a query's phrases match: its three best matches, over those of its best domain."""
    rows = [(i, t) for i, (_, _, terms) in enumerate(catalog.domains) for t in terms]
    terms = analysed.sparkSession.createDataFrame(rows, "ord int, target string")
    phrases = phrases_of(analysed).unionByName(aliases.select("query_id", F.col("term").alias("candidate")))
    found = join_terms(phrases, terms, ["query_id"], least=MINIMUM / PHRASE_WEIGHT, fuzzy_too=fuzzy).join(terms, "target")
    weighted = F.col("score") * F.when(F.col("target").contains(" "), PHRASE_WEIGHT).otherwise(1.0)
    found = found.withColumn("weighted", weighted).filter(F.col("weighted") >= MINIMUM)
    place = F.row_number().over(Window.partitionBy("query_id", "ord").orderBy(F.desc("weighted"), "target"))
    sums = found.withColumn("place", place).filter("place <= 3").groupBy("query_id", "ord").agg(F.sum("weighted").alias("sum"))
    return sums.select("query_id", "ord", (F.col("sum") / F.max("sum").over(Window.partitionBy("query_id"))).alias("lexical"))


def route_queries(
    analysed: DataFrame, aliases: DataFrame, catalog: Catalog, prototypes: Sequence[Sequence[float]], *, fuzzy: bool = True,
    lexical_weight: float = LEXICAL_WEIGHT, max_domains: int = MAX_DOMAINS, threshold: float = RELATIVE_THRESHOLD,
) -> DataFrame:
    """(query_id, ord, domain_id, lexical, semantic, score, place, selected): each query against each domain of the catalog.

    ``analysed``: rows of :func:`analyses` with ``query_id`` and the query's ``vector``; ``aliases`` from :func:`alias_terms`.
    """
    if len(prototypes) != len(catalog.domains):
        raise ValueError("there must be one prototype for each domain")
    rows = with_semantic_scores(analysed.select("query_id", "vector"), prototypes).select("query_id", F.posexplode("semantic").alias("ord", "semantic"))
    rows = rows.join(lexical_scores(analysed, aliases, catalog, fuzzy=fuzzy), ["query_id", "ord"], "left").fillna(0.0, ["lexical"])
    of = Window.partitionBy("query_id")
    weight = F.when(F.max("lexical").over(of) > 0, lexical_weight).otherwise(0.0)
    rows = rows.withColumn("weight", weight).withColumn("score", F.col("weight") * F.col("lexical") + (1 - F.col("weight")) * F.col("semantic"))
    rows = rows.withColumn("place", F.row_number().over(of.orderBy(F.desc("score"), "ord"))).withColumn("best", F.max("score").over(of))
    chosen = (F.col("place") == 1) | ((F.col("place") <= max_domains) & (F.col("score") >= threshold * F.col("best")))
    names = F.array(*[F.lit(i) for i in catalog.ids])
    return rows.select("query_id", "ord", F.get(names, F.col("ord")).alias("domain_id"), "lexical", "semantic", "score", "place", chosen.alias("selected"))


__all__ = ["alias_terms", "analyses", "expanded", "lexical_scores", "prompts", "route_queries"]
