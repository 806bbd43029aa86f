"""How well phrases match a target: equality, containment and fuzzy similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from keysift.functions.text import contains_phrase, let, tokens
from keysift.ship import ship

MINIMUM = 0.80


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def fuzzy(candidate: str, target: str) -> float:
    """The fuzzy score of two normalised phrases, from 0 to 0.86."""
    have, want = candidate.split(), target.split()
    if len(want) == 1:
        close = [_ratio(t, target) for t in have if min(len(t), len(target)) >= 5]
        return 0.86 * max((r for r in close if r >= 0.88), default=0.0)
    best = 0.0
    for i in range(len(have) - len(want) + 1) if want else ():
        close = [_ratio(a, b) for a, b in zip(have[i:], want)]
        coverage = sum(r >= 0.8 for r in close) / len(want)
        if coverage >= 0.75 and sum(close) / len(close) >= 0.86:
            best = max(best, 0.84 * coverage)
    return best


def exact_part(candidate: Column, target: Column) -> Column:
    """The native part of the score: equal, target in candidate, or most of the target in the candidate."""
    share = F.size(tokens(candidate)) / F.greatest(F.size(tokens(target)), F.lit(1))
    inside = (F.size(tokens(candidate)) >= 2) & contains_phrase(target, candidate) & (share >= 0.6)
    score = F.when(candidate == target, 1.0).when(contains_phrase(candidate, target), 0.97).when(inside, 0.88 * F.least(share, F.lit(1.0)))
    return F.when((candidate == "") | (target == ""), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def may_be_fuzzy(candidate: Column, target: Column) -> Column:
    """Whether the fuzzy score can be over zero: edit distance never exceeds (1 - ratio) times both lengths."""
    n = F.length(target)
    one = F.exists(
        tokens(candidate),
        lambda t: (F.length(t) >= 5) & (F.levenshtein(t, target).cast("double") <= (F.length(t) + n) * 0.12 + 1e-9),
    )
    several = F.size(tokens(candidate)) >= F.size(tokens(target))
    return F.when(F.size(tokens(target)) == 1, (n >= 5) & one).otherwise(several & (target != ""))


def best_match(pairs: DataFrame, keys: list[str], *, least: float = MINIMUM) -> DataFrame:
    """(keys, score): the best score of each target over its candidates, from ``pairs`` (keys, candidate, target), both
    normalised; only scores of at least ``least``.

    Python sees only pairs that no native rule has decided and that the edit distance leaves open.
    """
    ship(pairs.sparkSession)

    @pandas_udf("double")
    def fuzzy_udf(candidate: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([fuzzy(c, t) for c, t in zip(candidate, target)], dtype="float64")

    scored = pairs.withColumn("score", exact_part(F.col("candidate"), F.col("target")))
    open_ = (F.col("score") < 0.86) & may_be_fuzzy(F.col("candidate"), F.col("target"))
    decided = scored.filter(~open_).select(*keys, "score")
    rest = scored.filter(open_).select(*keys, F.greatest("score", fuzzy_udf("candidate", "target")).alias("score"))
    return decided.unionByName(rest).groupBy(*keys).agg(F.max("score").alias("score")).filter(F.col("score") >= least)


def best_of(candidate_list: list[str], target: str) -> float:
    """The same score for one query on the driver, which never holds more than a query's few candidates."""
    best = 0.0
    want = target.split()
    for c in candidate_list if want else ():
        have = c.split()
        if c == target:
            return 1.0
        if f" {target} " in f" {c} ":
            best = max(best, 0.97)
        share = len(have) / len(want)
        if len(have) >= 2 and share >= 0.6 and f" {c} " in f" {target} ":
            best = max(best, 0.88 * min(1.0, share))
        best = max(best, fuzzy(c, target) if c else 0.0)
    return best


# Matching a table of phrases with a vocabulary by keys alone: no phrase meets a term that no key gives it.


def _segments(n: Column, share: float) -> Column:
    """(i, start, size) of the pieces that a word of ``n`` letters is cut into: one more than the edits it may have, so one piece is untouched."""
    longest = F.floor(n * ((1 + share) / (1 - share)) + 1e-9)
    pieces = F.least(F.floor((n + longest) * share + 1e-9) + 1, n)
    cut = lambda i: F.floor(i * n / pieces).cast("int")
    return F.transform(F.sequence(F.lit(0), (pieces - 1).cast("int")), lambda i: F.struct(i.alias("i"), cut(i).alias("start"), (cut(i + 1) - cut(i)).alias("size")))


def _index_keys(word: Column, share: float) -> Column:
    """The keys of a vocabulary word: its length, and each piece with its number."""
    return F.transform(_segments(F.length(word), share), lambda c: F.struct(F.length(word).alias("n"), c["i"].alias("i"), F.substr(word, c["start"] + 1, c["size"]).alias("piece")))


def _probe_keys(word: Column, share: float) -> Column:
    """All keys under which a vocabulary word in reach may stand.

    An untouched piece may be shifted by no more edits than there are touched pieces before it, nor than there are after it:
    were it shifted more, another piece would be untouched that is shifted less.
    """
    m = F.length(word)
    low, high = F.ceil(m * ((1 - share) / (1 + share)) - 1e-9).cast("int"), F.floor(m * ((1 + share) / (1 - share)) + 1e-9).cast("int")

    def of(n: Column) -> Column:
        def keys(pieces: Column) -> Column:
            edits = F.size(pieces) - 1

            def places(c: Column) -> Column:
                first = F.greatest(-c["i"], m - n - (edits - c["i"]), -c["start"])
                last = F.least(c["i"], m - n + (edits - c["i"]), m - c["start"] - c["size"])
                shifts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
                return F.transform(shifts, lambda s: F.struct(n.alias("n"), c["i"].alias("i"), F.substr(word, c["start"] + s + 1, c["size"]).alias("piece")))

            return F.flatten(F.transform(pieces, places))

        return let(_segments(n, share), keys)

    return F.flatten(F.transform(F.sequence(low, high), of))


def near_words(words: DataFrame, vocabulary: DataFrame, share: float) -> DataFrame:
    """(word, target) of all distinct words of two tables whose edit distance is at most ``share`` of both lengths.

    Words meet where a piece of the vocabulary's word stands in the other one, shifted by no more than the edits allowed; as
    there are more pieces than edits, no pair is lost.  ``share`` is below a third, so that a word has as many letters as pieces.
    """
    if not 0 <= share < 1 / 3:
        raise ValueError("the share of edits is below a third")
    left = words.select("word").filter("word <> ''").distinct().select("word", F.explode(_probe_keys(F.col("word"), share)).alias("key"))
    right = vocabulary.select("target").filter("target <> ''").distinct().select("target", F.explode(_index_keys(F.col("target"), share)).alias("key"))
    pairs = left.join(right, "key").select("word", "target").distinct()
    return pairs.filter(F.levenshtein("word", "target") <= (F.length("word") + F.length("target")) * share + 1e-9)


def _runs(words: Column, least: Column | int, most: Column) -> Column:
    """All runs of ``least`` to ``most`` words in a row, joined by spaces."""
    n = F.size(words)
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k >= least) & (k <= n) & (k <= most))
    runs = F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " ")))
    return F.array_distinct(F.flatten(runs))


def _held(found: list[tuple[str, float]], best: dict[str, float]) -> None:
    for target, score in found:
        if score > best.get(target, 0.0):
            best[target] = score


class _Terms:
    """A vocabulary of few terms as a task holds it: terms by themselves and by their first words, and by the runs of words that are most of them."""

    def __init__(self, targets: list[str], least: float):
        self.lengths: dict[str, list[int]] = {}  # by the first word, how many words the terms have that begin with it
        self.targets, self.most = set(targets), {}
        for t in targets:
            words = t.split()
            known = self.lengths.setdefault(words[0], [])
            if len(words) not in known:
                known.append(len(words))
            for k in range(2, len(words)):
                score = 0.88 * (k / len(words))
                if k / len(words) >= 0.6 and score >= least:
                    for run in {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}:
                        self.most.setdefault(run, []).append((t, score))

    def of(self, candidate: str) -> list[tuple[str, float]]:
        """The terms that a phrase is or has as whole words, and those that it is most of, with their scores."""
        words, best = candidate.split(), {}
        for i, w in enumerate(words):
            for k in self.lengths.get(w, ()):
                if i + k <= len(words) and (run := " ".join(words[i : i + k])) in self.targets:
                    best[run] = 1.0 if run == candidate else max(0.97, best.get(run, 0.0))
        _held(self.most.get(candidate, ()), best)
        return list(best.items())


FEW = 20_000  # terms that each task may hold; of more, phrases and terms are joined


def _met_in_tasks(phrases: DataFrame, targets: list[str], keys: list[str], least: float) -> DataFrame:
    """(keys, target, score): each phrase's matches where it is, so that no phrase is dealt; the best of a batch's neighbours with one key."""
    fields = [phrases.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(targets, least)
        for b in batches:
            at, named, scores = [], [], []
            for i, candidate in enumerate(b.column(len(keys)).to_pylist()):
                for target, score in terms.of(candidate) if candidate else ():
                    at.append(i), named.append(target), scores.append(score)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(len(keys))), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*keys, "target", "score"])

    return phrases.select(*keys, "candidate").mapInArrow(run, T.StructType([*fields, T.StructField("target", T.StringType()), T.StructField("score", T.DoubleType())]))


def join_terms(phrases: DataFrame, terms: DataFrame, keys: list[str], *, least: float = MINIMUM, fuzzy_too: bool = True) -> DataFrame:
    """(keys, target, score): the best score of each term over a key's phrases, of at least ``least``; what :func:`best_match` finds of all pairs.

    ``phrases`` (keys, candidate) and ``terms`` (target) are normalised.  Phrases are matched once each, whatever the number of keys
    that have them, and equal and contained ones where they are if there are ``FEW`` terms at most.  Of more terms these meet by their runs of words; misspelt ones by :func:`near_words` of single
    words: of a term of several words, so many of its longest as can't all be missing.  Python scores what has met.
    """
    if not 0.45 < least <= 1:
        raise ValueError("the least score is over 0.45, as lower ones tell nothing apart")
    spark = phrases.sparkSession
    ship(spark)

    @pandas_udf("double")
    def ratio(word: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([_ratio(w, t) for w, t in zip(word, target)], dtype="float64")

    @pandas_udf("double")
    def score(candidate: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([fuzzy(c, t) for c, t in zip(candidate, target)], dtype="float64")

    texts = phrases.select("candidate").filter("candidate <> ''").distinct()
    targets = terms.select("target").filter("target <> ''").distinct()
    size = lambda c: F.size(tokens(F.col(c)))
    few = sorted(r[0] for r in targets.limit(FEW + 1).collect())  # a bounded part, to see whether tasks can hold all
    met = _met_in_tasks(phrases, few, keys, least) if len(few) <= FEW else None
    if met is not None and not fuzzy_too:
        return _best_of(met, keys, least)
    found = spark.createDataFrame([], "candidate string, target string, score double")
    if met is None:
        longest = targets.agg(F.max(size("target"))).first()[0] or 1  # no longer run of words is looked up
        runs = texts.select("candidate", F.explode(_runs(tokens(F.col("candidate")), 1, F.lit(longest))).alias("target"))
        found = runs.join(targets, "target").select("candidate", "target", F.when(F.col("candidate") == F.col("target"), 1.0).otherwise(0.97).alias("score"))
        part = targets.filter(size("target") >= 2).withColumn("n", size("target"))
        part = part.select("target", "n", F.explode(_runs(tokens(F.col("target")), 2, F.col("n") - 1)).alias("candidate"))
        part = part.withColumn("share", size("candidate") / F.col("n")).filter((F.col("share") >= 0.6) & (0.88 * F.col("share") >= least))
        found = found.unionByName(part.join(texts, "candidate").select("candidate", "target", (0.88 * F.col("share")).alias("score")))
    if fuzzy_too:
        words = texts.select("candidate", F.posexplode(tokens(F.col("candidate"))).alias("at", "word"))
        floor = max(0.88, least / 0.86)
        if floor <= 1:
            single = targets.filter((size("target") == 1) & (F.length("target") >= 5))
            close = near_words(words.filter(F.length("word") >= 5), single, 1 - floor).withColumn("score", 0.86 * ratio("word", "target"))
            close = close.filter(F.col("score") >= 0.86 * floor - 1e-12)
            found = found.unionByName(words.join(close, "word").select("candidate", "target", "score"))
        share = max(0.75, least / 0.84)
        if share <= 1:
            several = targets.withColumn("n", size("target")).filter("n >= 2")
            spare = F.col("n") - F.ceil(F.col("n") * share - 1e-9)
            longest_first = F.array_sort(F.transform(tokens(F.col("target")), lambda t, j: F.struct((-F.length(t)).alias("k"), j.alias("j"), t.alias("t"))))
            anchors = several.select("target", "n", F.explode(F.slice(longest_first, F.lit(1), (spare + 1).cast("int"))).alias("x")).select("target", "n", "x.j", F.col("x.t").alias("own"))
            pairs = near_words(words, anchors.select(F.col("own").alias("target")), 0.2).withColumnRenamed("target", "own")
            at = words.withColumn("of", size("candidate")).join(pairs, "word").join(anchors, "own")
            at = at.filter("at >= j and at - j + n <= of").select("candidate", "target").distinct()
            found = found.unionByName(at.withColumn("score", score("candidate", "target")))
    best = found.filter(F.col("score") >= least).groupBy("candidate", "target").agg(F.max("score").alias("score"))
    rows = phrases.select(*keys, "candidate").join(best, "candidate").select(*keys, "target", "score")
    return _best_of(rows if met is None else rows.unionByName(met), keys, least)


def _best_of(found: DataFrame, keys: list[str], least: float) -> DataFrame:
    return found.filter(F.col("score") >= least).groupBy(*keys, "target").agg(F.max("score").alias("score"))
