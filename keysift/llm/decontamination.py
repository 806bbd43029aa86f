"""Operator 10, benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Every document is cut into chunks as long as the longest item of the index block;
each two neighbouring chunks are a passage, so an item that was copied into the
text lies whole in one of them.  Each passage queries the index.  A posting's
weight is its BM25 impact divided by the score of the item for itself, so one
threshold holds for items of any length.  Sums of block maxima over a passage's
terms rule out most passages at once; the others go through block-max WAND, which
returns all items at the threshold or above.  A hit counts if the passage has
``OVERLAP`` of the five-word shingles of the item's question (its sentences but the
last) and that share of the words of its answer (the last one).

Block maxima are kept beside each word's postings, for the blocks that have the word
alone (a word in one of ``SPREAD`` blocks or more has a row of all), and a text is bounded some chunks at a time (``CELLS`` of chunks by blocks), so
what an index and a search hold grows with the postings, not with words times items.

The index is broadcast in blocks of at most about ``BLOCK_CHARS`` characters of
items, whose number follows from the measured size of the item table; each block
is searched with every passage.

Defined cases: null texts and ids take part as empty texts and null ids; items
without words match nothing; an item shorter than a shingle is one shingle; equal
items are hits side by side; repeated documents are judged one by one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.encoding import ENTRY
from keysift.llm.scratch import give_back
from keysift.ship import ship

K1, B = 1.2, 0.75
THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
BLOCK_CHARS = 4_000_000
MEMO = 64 << 20  # bytes of tokens that a worker remembers the terms of
KEEP = 40  # characters of the longest of them
CELLS = 1 << 16
SPREAD = 8

_EDGES = re.compile(r"^\W+|\W+$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def normal(token: str) -> str:
    """A token in lower case without the marks at its ends."""
    return _EDGES.sub("", token.lower())


def words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; one sentence is a question without an answer."""
    sentences = [w for w in map(words, _SENTENCE.split(text.strip())) if w]
    if len(sentences) < 2:
        return (sentences[0] if sentences else []), []
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def _shingles(ids) -> set[tuple[int, ...]]:
    k = min(SHINGLE, len(ids))
    return {tuple(ids[i : i + k]) for i in range(len(ids) - k + 1)} if k else set()


class Index:
    """Postings of the items (item_id, text) by term, with weights from 0 to 1 and the greatest of each block of items.

    ``frequency``: how many of all ``total`` items have a word; ``average``: their mean number of words.
    """

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int, average: float):
        self.ids = [i for i, _ in items]
        texts = [words(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.longest = max([1, *map(len, texts)])
        self.questions, self.answers = [], []
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for d, (t, (_, text)) in enumerate(zip(texts, items)):
            impact = {}
            for w, tf in Counter(t).items():
                idf = math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / average))
            own = sum(impact.values())
            for w, x in impact.items():
                postings[self.vocabulary[w]].append((d, x / own))
            q, a = question_and_answer(text or "")
            self.questions.append(_shingles([self.vocabulary[w] for w in q]))
            self.answers.append({self.vocabulary[w] for w in a})
        self.items = [[d for d, _ in p] for p in postings]
        self.weights = [[x for _, x in p] for p in postings]
        self.upper = [max(w) for w in self.weights]
        self.n_blocks = -(-len(items) // BLOCK)
        maxima: list[dict[int, float]] = []
        for p in postings:
            most: dict[int, float] = {}
            for d, x in p:
                most[d // BLOCK] = max(most.get(d // BLOCK, 0.0), x)
            maxima.append(most)
        self.maxima = maxima
        # Terms in one of SPREAD blocks or more have a row of all blocks, so rows hold at most SPREAD cells for each maximum.
        spread = [SPREAD * len(m) >= self.n_blocks for m in maxima]
        self.row = np.where(spread, np.cumsum(spread) - 1, -1)
        self.rows = np.zeros((sum(spread), self.n_blocks), np.float32)
        for r, m in zip(self.row.tolist(), maxima):
            if r >= 0:
                self.rows[r, list(m)] = list(m.values())
        # The blocks of any other term t and their maxima lie from starts[t] up to starts[t + 1].
        rare = [{} if r >= 0 else m for r, m in zip(self.row.tolist(), maxima)]
        self.starts = np.cumsum([0, *map(len, rare)])
        self.block = np.array([b for m in rare for b in m], np.int64)
        self.most = np.array([x for m in rare for x in m.values()], np.float32)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose weights for the terms add up to the threshold or more, by block-max WAND."""
        least = threshold - 1e-6
        at = [[self.items[t][0], 0, t] for t in terms]  # an item, its place in the list, the term
        out = []

        def advance(x: list, to: int) -> bool:
            items = self.items[x[2]]
            x[1] = bisect.bisect_left(items, to, x[1])
            if x[1] == len(items):
                return False
            x[0] = items[x[1]]
            return True

        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for k, x in enumerate(at):
                bound += self.upper[x[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            d = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == d:
                pivot += 1
            if sum(self.maxima[x[2]].get(d // BLOCK, 0.0) for x in at[: pivot + 1]) < least:
                # No item up to the end of this block, or to the next list's item, can reach the threshold.
                to = (d // BLOCK + 1) * BLOCK
                if pivot + 1 < len(at):
                    to = min(to, at[pivot + 1][0])
                at = [x for k, x in enumerate(at) if k > pivot or advance(x, max(to, d + 1))]
            elif at[0][0] == d:
                score = sum(self.weights[x[2]][x[1]] for x in at[: pivot + 1])
                if score >= least:
                    out.append((d, score))
                at = [x for k, x in enumerate(at) if k > pivot or advance(x, d + 1)]
            else:
                at = [x for x in at if x[0] >= d or advance(x, d)]
        return out

    def live(self, chunk: np.ndarray, term: np.ndarray, threshold: float) -> list[int]:
        """The chunks that, with the next one, may hold an item at the threshold; ``chunk`` ascends, with each of its terms once."""
        found, rows = [], min(max(1, CELLS // max(1, self.n_blocks)), int(chunk[-1]) + 1)
        for low in range(0, int(chunk[-1]) + 1, rows):
            # One chunk more than is judged, as each is judged with the next one.
            a, b = np.searchsorted(chunk, (low, low + rows + 1))
            bounds = np.zeros((rows + 1, self.n_blocks), np.float32)
            here, row = chunk[a:b] - low, self.row[term[a:b]]
            wide, rare = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
            if len(wide):
                first = np.flatnonzero(np.r_[True, np.diff(here[wide]) > 0])
                bounds[here[wide[first]]] = np.add.reduceat(self.rows[row[wide]], first, axis=0)
            if len(rare):
                begin = self.starts[term[a:b][rare]]
                n = self.starts[term[a:b][rare] + 1] - begin
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                np.add.at(bounds.reshape(-1), np.repeat(here[rare], n) * self.n_blocks + self.block[at], self.most[at])
            found += (np.flatnonzero((bounds[:-1] + bounds[1:]).max(axis=1) >= threshold - 1e-4) + low).tolist()
        return found

    def verify(self, d: int, passage: list[int]) -> tuple[float, float]:
        """The shares of an item's question and answer that a passage has."""
        q, a = self.questions[d], self.answers[d]
        size = len(next(iter(q))) if q else SHINGLE
        have = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        return len(q & have) / len(q) if q else 1.0, len(a.intersection(passage)) / len(a) if a else 1.0


class _Terms(dict):
    """The index's term of each token, -1 for a word that no item has and -2 for a token without a word."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.room = vocabulary, MEMO

    def __missing__(self, token: str) -> int:
        word = normal(token)
        term = self.vocabulary.get(word, -1) if word else -2
        if len(token) <= KEEP and self.room > 0:
            self[token] = term
            self.room -= getsizeof(token) + ENTRY
        return term


def search(index: Index, term_of: _Terms, text: str | None, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
    """(item, first word, words, score, question share, answer share) of each item found in a text, its best passage."""
    terms = np.fromiter(map(term_of.__getitem__, (text or "").split()), np.int64)
    terms = terms[terms > -2]
    known = np.flatnonzero(terms >= 0)
    if not len(known):
        return []
    step, size = index.longest, len(index.vocabulary)
    chunk_term = np.unique(known // step * size + terms[known])  # each term once in a chunk
    best: dict[int, tuple] = {}
    for c in index.live(chunk_term // size, chunk_term % size, threshold):
        passage = terms[c * step : (c + 2) * step]
        for d, score in index.wand(np.unique(passage[passage >= 0]).tolist(), threshold):
            q, a = index.verify(d, passage.tolist())
            if q >= overlap and a >= overlap and (d not in best or (q + a, score) > (best[d][4] + best[d][5], best[d][3])):
                best[d] = (d, c * step, len(passage), score, q, a)
    return [best[d] for d in sorted(best)]


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The index, block by block; what reaches the driver at once is one block of the test items and its words' frequencies."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [words(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], names=["text", "words"])

    cut = items.select("text").mapInArrow(run, "text string, words array<string>")
    size = cut.agg(F.count(F.lit(1)), F.sum(F.size("words")), F.sum(F.length("text"))).first()
    total, average = size[0], (size[1] or 0) / max(size[0], 1) or 1.0
    blocks = max(1, -(-(size[2] or 0) // block_chars))
    frequency = cut.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").count()
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        own = items.filter(block == k)
        rows = sorted((r["item_id"] is not None, r["item_id"] if r["item_id"] is not None else 0, r["text"], r["item_id"]) for r in own.collect())
        ours = own.select("text").mapInArrow(run, "text string, words array<string>").select(F.explode("words").alias("w")).distinct()
        counts = {r["w"]: r["count"] for r in frequency.join(ours, "w").collect()}
        if rows:
            yield Index([(i, t) for _, _, t, i in rows], counts, total, average)


_KINDS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def hits(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, score, question_overlap, answer_overlap) of each item in each document.

    An item's id is a whole number or text; one of another type is given as text.
    """
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType.simpleString()
    if item not in _KINDS:
        item, benchmark = "string", benchmark.withColumn("item_id", F.col("item_id").cast("string"))
    kind = _KINDS[item]
    schema = f"doc_id {key}, item_id {item}, first_word bigint, n_words bigint, score double, question_overlap double, answer_overlap double"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            term_of = _Terms(index.vocabulary)
            for b in batches:
                ids, rows = b.column(0), []
                for r, text in enumerate(b.column(1).to_pylist()):
                    rows += [(r, *h) for h in search(index, term_of, text, threshold, overlap)]
                if rows:
                    r, d, *rest = zip(*rows)
                    columns = [ids.take(pa.array(r, pa.int64())), pa.array([index.ids[x] for x in d], kind)]
                    columns += [pa.array(x, t) for x, t in zip(rest, [pa.int64()] * 2 + [pa.float64()] * 3)]
                    names = ["doc_id", "item_id", "first_word", "n_words", "score", "question_overlap", "answer_overlap"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents in which no test item is found, in all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            term_of = _Terms(shared.value.vocabulary)
            for b in batches:
                clean = [not search(shared.value, term_of, t, threshold, overlap) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
