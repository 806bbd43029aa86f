"""Operator 4, substring dedup: paragraphs by MinHash banding, verified by exact Jaccard, removed by component.

Units are cut from the word stream of a whole text at two scales, so that both
copies of a repeated passage are cut alike whatever surrounds them:

* a paragraph: a line of ``MIN_WORDS`` words or more, or neighbouring shorter lines
  (up to a blank line) joined until they have as many;
* a window of ``WINDOW`` words that begins at an anchor.  Anchors are chosen by
  content: of each ``REACH`` neighbouring places the one whose five-word shingle
  hashes lowest, unless a lower one is within ``SPACING`` words (windows closer than
  that would be near copies of each other).  A passage of 50 words has such a
  window in all its copies all but surely, be it part of a line or several lines.

A paragraph has ``BANDS`` keys of ``ROWS`` MinHashes over its five-word shingles,
tuned by :func:`tune` so that two of the least similarity share a key all but
surely.  A window is so short that a change anywhere but at its end leaves less than
the least similarity, so its one band has all its words as rows: windows match as
they are, and a near copy of a passage shares the windows between its changes.
Units that share a key are candidates.
Equal units (by their words, A-Z lowered, told apart by 128 bits) are one class.
Within a key every class is compared with up to three pivots drawn by hash, which
links a large group of near copies in linear work; then, in keys whose other
classes still lie in different components, each class outside the largest
component meets the classes of other components that an exact bound on their
overlap leaves.  So no pair that collides is lost to its component, and no hot key
is expanded into all its pairs.  Jaccard is exact, on sets of 64-bit shingle
hashes.  Of each component the first occurrence (by doc_id, then place) stays and
the others are removed; removed units that overlap make up one passage.

Defined cases: null and empty texts have no unit; a unit of fewer words than a
shingle is one shingle; repeated rows with one doc_id and text count as one
document, so their units are marked alike; a null doc_id comes first; repeats of
fewer than ``WINDOW`` words are no passages; in a text that repeats a few words over
and over each place is a copy of the first; an empty table gives an empty result;
columns of the input besides doc_id and text play no part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.scratch import components, give_back, remove, sifted, stash, tidy
from keysift.ship import ship

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
MIN_WORDS = 45  # fifty, less what an edit may take
WINDOW = 25
REACH = 17
SPACING = 3
PIVOTS = 3
PARITIES = 4  # words of 64 bits
_PARITY = [f"p{i}" for i in range(PARITIES)]
SLACK = 1e-9
SLICE = 512 << 10  # bytes of text that a task looks at together
USUAL = SLICE + 1  # powers that a worker keeps


def tune(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 40) -> tuple[int, int]:
    """(bands, rows): the most rows to a band, and so the fewest chance collisions, at which ``recall`` of the pairs of
    ``similarity`` collide, with no more than ``most_hashes`` hashes."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


BANDS, ROWS = tune()


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


_A, _B = _multipliers(BANDS * ROWS)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDABA0B6EB09322E3  # odd bases of the rolling hashes
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] = _LOWER[97:123]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of ``base`` and of its inverse modulo 2^64; those for a very long text aren't kept."""
    return _usual_powers(base) if n <= USUAL else _run_of_powers(base, n)


@functools.lru_cache(maxsize=3)
def _usual_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _run_of_powers(base, USUAL)


def _run_of_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    run = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
    return run(base), run(pow(base, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Hashes of any run of a sequence of numbers from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.power, self.inverse = _powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[: len(values)], out=self.total[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.inverse[start])


class Texts:
    """The words of some texts, one after another.

    ``start, end``: each word's bytes; ``doc``: its text; ``first``: each text's first
    word, and one more; ``line``: the line breaks before it; ``shingles``: the hash of the
    five words that begin there, whether or not all are of one text.
    """

    def __init__(self, column: pa.Array):
        self.rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + self.rows + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.raw, cuts = raw, offsets - offsets[0]
        space = _SPACE[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[cuts[:-1][cuts[:-1] < len(raw)]] = True
        after[cuts[1:][cuts[1:] > 0] - 1] = True
        self.start, self.end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, cuts)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.cuts = cuts
        word = _Rolling(_LOWER[raw], _BYTES).run(self.start, self.end)
        self.one, self.two = _Rolling(word, _FIRST), _Rolling(word, _SECOND)
        n = len(word)
        self.shingles = np.zeros(n, np.uint64)
        at = np.arange(max(0, n - SHINGLE + 1))
        self.shingles[: len(at)] = self.one.run(at, at + SHINGLE)

    @functools.cached_property
    def characters(self) -> np.ndarray:
        """The characters before each byte."""
        return np.r_[0, np.cumsum((self.raw & 0xC0) != 0x80)]

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the number of words of each paragraph."""
        line = np.searchsorted(np.flatnonzero(self.raw == 10), self.start)
        fresh = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])]) if len(line) else line
        sizes = np.diff(np.r_[fresh, len(line)])
        apart = np.r_[True, (line[fresh[1:]] - line[fresh[:-1]] > 1) | (self.doc[fresh[1:]] != self.doc[fresh[:-1]])]
        out, begin, held = [], 0, 0
        for at, n, new in zip(fresh.tolist(), sizes.tolist(), apart.tolist()):
            if new or n >= MIN_WORDS:
                held = 0
            if not held:
                begin = at
            held += n
            if held >= MIN_WORDS:
                out.append((begin, held))
                held = 0
        found = np.array(out, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def anchors(self) -> np.ndarray:
        """The first word of each window."""
        n = len(self.start)
        place = np.arange(n) + (self.doc + 1) * REACH  # zeros between texts keep one from deciding on another's anchors
        fits = np.arange(n) + WINDOW <= self.first[1:][self.doc]
        h = np.zeros(n + (self.rows + 2) * REACH, np.uint64)
        h[place[fits]] = self.shingles[fits]
        least = _sliding(h, REACH, np.minimum)  # zero where it reaches beyond the text
        best = _sliding(np.r_[np.zeros(REACH - 1, np.uint64), least], REACH, np.maximum)  # of all stretches that hold a place
        own = h[place]
        chosen = fits & (own == best[place])
        for k in range(1, SPACING + 1):
            for near in (h[place - k], h[place + k]):
                chosen &= (near == 0) | (own <= near)
        return np.flatnonzero(chosen)

    def keys(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The keys of units, one row each: bands of MinHashes over their shingles."""
        shingled = size >= SHINGLE
        short = ~shingled & (size > 0)
        alone = self.one.run(begin[short], begin[short] + size[short])
        edges = np.c_[begin[shingled], begin[shingled] + size[shingled] - SHINGLE + 1].ravel()
        out = np.empty((len(begin), BANDS), np.uint64)
        padded = np.r_[self.shingles, _MOST]  # so that an edge may lie behind the last word
        for i in range(BANDS):
            key = np.full(len(begin), i, np.uint64)
            for j in range(i * ROWS, (i + 1) * ROWS):
                least = np.full(len(begin), _MOST, np.uint64)
                if len(edges):
                    least[shingled] = np.minimum.reduceat(padded * _A[j] + _B[j], edges)[::2]
                least[short] = alone * _A[j] + _B[j]
                key = _mixed(key + least)
            out[:, i] = key
        return out

    def sets(self, begin: int, size: int) -> np.ndarray:
        """The distinct shingle hashes of a unit."""
        if size >= SHINGLE:
            return np.unique(self.shingles[begin : begin + size - SHINGLE + 1])
        return self.one.run(np.array([begin]), np.array([begin + size])) if size else np.empty(0, np.uint64)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``SLICE`` bytes of text, one row at least."""
    column = batch.column(text)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text): a document is known by its doc_id and a hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("doc"), text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def units(docs: DataFrame, *, whole: bool = False) -> DataFrame:
    """(doc_id, doc, at, n_words, first_char, n_chars, one, two, keys, size, p0, p1, ...) of each unit; ``whole``: each text is one unit.

    ``at`` is the unit's first word; ``one`` and ``two`` are two hashes of its words, of a window ``two`` is null as its key can stand in.
    ``size`` and the parities are those of its set of shingles, null of a window.
    """
    names = ["doc_id", "doc", "at", "n_words", "first_char", "n_chars", "one", "two", "keys", "size", *_PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 2):
                texts = Texts(b.column(2))
                if whole:
                    begin, size, n = texts.first[:-1], np.diff(texts.first), texts.rows
                    row = np.arange(n)
                else:
                    (begin, size), windows = texts.paragraphs(), texts.anchors()
                    n = len(begin)
                    begin, size = np.r_[begin, windows], np.r_[size, np.full(len(windows), WINDOW)]
                    row = texts.doc[begin]
                ends = np.cumsum(np.r_[0, np.full(n, BANDS), np.ones(len(begin) - n, np.int64)]).astype(np.int32)
                if len(texts.start):
                    last = np.maximum(begin + size - 1, 0)
                    low = texts.characters[texts.start[np.minimum(begin, len(texts.start) - 1)]] - texts.characters[texts.cuts[row]]
                    high = texts.characters[texts.end[np.minimum(last, len(texts.end) - 1)]] - texts.characters[texts.cuts[row]]
                    low, high = np.where(size > 0, low, 0), np.where(size > 0, high, 0)
                else:
                    low = high = np.zeros(len(begin), np.int64)
                take = pa.array(row)
                numbers = (pa.array(x.astype(np.int64)) for x in (begin - texts.first[row], size, low, high - low))
                one, two = (_mixed(x.run(begin, begin + size) + size.astype(np.uint64)) for x in (texts.one, texts.two))
                keys = [texts.keys(begin[:n], size[:n]).ravel(), two[n:]]
                hashes = (_signed(one), pa.array(two.view(np.int64), mask=np.arange(len(begin)) >= n))
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(keys)))
                sets = [texts.sets(x, k) for x, k in zip(begin[:n].tolist(), size[:n].tolist())]
                none = pa.nulls(len(begin) - n, pa.int64())  # of windows
                profile = (pa.concat_arrays([x, none]) for x in (pa.array(np.array([len(x) for x in sets], np.int64)), *_parities(sets)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *numbers, *hashes, lists, *profile], names=names)
        give_back()

    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, doc bigint, at bigint, n_words bigint, first_char bigint, n_chars bigint, one bigint, two bigint, keys array<bigint>"
    schema += "".join(f", {c} bigint" for c in ("size", *_PARITY))
    return _keyed(docs).mapInArrow(run, schema)


def _same_doc(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b`` for the same document."""
    b = b.withColumnsRenamed({"doc_id": "_doc_id", "doc": "_doc"})
    return a.join(b, a["doc_id"].eqNullSafe(F.col("_doc_id")) & (a["doc"] == F.col("_doc")), how).drop("_doc_id", "_doc")


def _parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """``PARITIES`` words of parity bits of each set: two sets differ in at least as many members as their parities in bits."""
    out = np.zeros((PARITIES, len(sets)), np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if len(full):
        every, starts = np.concatenate(sets), np.cumsum([0, *(len(sets[i]) for i in full)])[:-1]
        bit, word = np.uint64(1) << (every & np.uint64(63)), (every >> np.uint64(6)) & np.uint64(PARITIES - 1)
        for i in range(PARITIES):
            out[i, full] = np.bitwise_xor.reduceat(np.where(word == i, bit, np.uint64(0)), starts)
    return [_signed(x) for x in out]


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, s): the shingle hashes of the units ``wanted`` (class, doc_id, doc, at, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch, 0):
                texts, places = Texts(b.column(0)), b.column(1)
                row = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
                rows = places.flatten()
                at, size = (rows.field(c).to_numpy() for c in ("at", "n_words"))
                out = [texts.sets(x, n) for x, n in zip((at + texts.first[row]).tolist(), size.tolist())]
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate([np.empty(0, np.uint64), *out])))
                yield pa.RecordBatch.from_arrays([rows.field("class"), lists], names=["class", "s"])
        give_back()

    ship(docs.sparkSession)
    key = F.struct("doc_id", "doc").alias("key")  # one column, so that the join's dealing serves the aggregate as well
    places = wanted.groupBy(key).agg(F.collect_list(F.struct("at", "n_words", "class")).alias("places"))
    places = stash(places, "places")
    texts = sifted(_keyed(docs).select(key, "text"), places, "key")[0]  # only the texts that may be asked for are dealt
    texts = texts.join(places, "key").dropDuplicates(["key"]).select("text", "places")
    return texts.mapInArrow(run, "class bigint, s array<bigint>")


def _sized(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and parities leave that Jaccard similarity open."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("size", *_PARITY)]), side)
    fits = f"a_size >= {similarity}D * b_size - {SLACK} and b_size >= {similarity}D * a_size - {SLACK} and {_differ('a', 'b', similarity)}"
    return pairs.filter(fits).select("a", "b")


def _differ(a: str, b: str, similarity: float) -> str:
    """Whether the parities leave the similarity open, as SQL: sets of it have at least ``similarity / (1 + similarity)`` of both sizes in common."""
    bits = " + ".join(f"bit_count({a}_{p} ^ {b}_{p})" for p in _PARITY)
    return f"{bits} <= {1 - 2 * similarity / (1 + similarity)}D * ({a}_size + {b}_size) + {SLACK}"


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity at least."""
    left, right = (sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _pair(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _unmet(open_: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of a key's classes in different components that may still reach the similarity.

    Shingles that only one class has can't be common to two.  So a class's other
    shingles bound its overlap with any partner, and with that the partner's size;
    classes meet by key and size range, and no pair that the bound rules out is formed.
    A class also has 256 parity bits of its shingles: two sets differ in at least as
    many shingles as their parities differ in bits, which rules out most other pairs.
    """
    least = similarity / (1 + similarity)  # of both sizes, what two sets of that Jaccard have in common
    own = sets.select("class", F.explode("s").alias("t"))
    alone = own.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.any_value("class").alias("class")).filter("n = 1")
    alone = alone.groupBy("class").agg(F.count(F.lit(1)).alias("alone"))
    size = classes.select("class", "size", *_PARITY).join(alone, "class", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0)))
    low, high = similarity * F.col("size") - SLACK, F.least(F.col("size") / similarity, F.col("common") / least - F.col("size")) + SLACK
    size = stash(size.withColumn("low", low).withColumn("high", high).filter("low <= high").drop("alone", "common"), "sizes")
    step = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / math.log(1.1)).cast("int")
    rows = open_.filter("not array_contains(pivots, class)").join(size, "class")
    few = rows.filter("component <> largest").withColumn("range", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))))
    names = ["class", "component", "size", "low", "high", *_PARITY]
    x = few.select("key", "range", *[F.col(c).alias(f"x_{c}") for c in names])
    y = rows.select("key", step(F.col("size")).alias("range"), *[F.col(c).alias(f"y_{c}") for c in names])
    fits = f"x_component <> y_component and y_size between x_low and x_high and x_size between y_low and y_high and {_differ('x', 'y', similarity)}"
    return x.join(y, ["key", "range"]).filter(fits).select(*_pair(F.col("x_class"), F.col("y_class"))).distinct()


def link(docs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(one, two, component) of the classes of ``marks`` (from :func:`units`) that share a key with another unit."""
    with tidy(docs.sparkSession):
        spark, early = docs.sparkSession, []  # tables that nothing reads any more go early
        identity = [F.col("one"), F.coalesce("two", F.get("keys", F.lit(0))).alias("two")]
        keyed = marks.select(*identity, F.explode("keys").alias("key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        shared = stash(shared, "shared", drop=early)
        hits = stash(keyed.join(shared, "key", "left_semi"), "hits", drop=early)
        # A number for each class; it is written with the class, so it never changes.
        numbered = stash(hits.select("one", "two").distinct().withColumn("class", F.monotonically_increasing_id()), "numbered")
        ends = [f(F.col(c)).alias(f"{c}_{n}") for c in ("one", "two") for n, f in (("low", F.min), ("high", F.max))]
        several = hits.groupBy("key").agg(*ends).filter("one_low <> one_high or two_low <> two_high").select("key")
        several = stash(several, "several", drop=early)  # by itself, so that a hot key's rows can be split
        open_keys = hits.join(several, "key", "left_semi").join(numbered, ["one", "two"])
        members = stash(open_keys.select("key", "class").distinct(), "members", drop=early)
        draws = [F.min(F.struct(F.xxhash64("class", "key", F.lit(i)).alias("h"), F.col("class").alias("c"))).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = F.array_distinct(F.array(*[F.col(f"p{i}.c") for i in range(PIVOTS)]))
        drawn = stash(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *draws).select("key", "n", pivots.alias("pivots")), "pivots", drop=early)
        members = stash(members.join(drawn, "key"), "drawn")
        remove(spark, early)
        # One occurrence of each class, whose text gives its set.
        profile = ["size", *_PARITY]
        place = F.min(F.struct("doc_id", "doc", "at", "n_words", *profile)).alias("p")
        several = numbered.join(members.select("class").distinct(), "class")
        wanted = marks.select("doc_id", "doc", "at", "n_words", *identity, *profile).join(several, ["one", "two"]).groupBy("class").agg(place)
        wanted = stash(wanted.select("class", "p.*"), "wanted")
        pairs = members.select("class", F.explode("pivots").alias("p")).filter("class <> p").select(*_pair(F.col("class"), F.col("p"))).distinct()
        pairs = stash(_sized(pairs, wanted, similarity), "pairs")  # few beside the candidates, so few sets are asked for
        named = lambda df: wanted.join(df.distinct(), "class", "left_semi")
        sets = stash(_sets(docs, named(pairs.select(F.explode(F.array("a", "b")).alias("class")))), "sets", drop=early)
        edges = stash(_verified(pairs, sets, similarity), "edges")
        remove(spark, early)
        found = stash(components(edges), "components")
        # What the pivots have left open: keys with pairs of classes that are no pivots, in more than one component.
        open_ = members.filter(F.col("n") > F.size("pivots") + 1).join(found, F.col("class") == F.col("node"), "left")
        open_ = open_.select("key", "class", "pivots", F.coalesce("component", "class").alias("component"))
        sizes = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        split = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        open_ = stash(open_.join(split.select("key", F.col("largest.component").alias("largest")), "key"), "open")
        if open_.take(1):
            loose = stash(named(open_.select("class")), "loose")
            sets = stash(_sets(docs, loose), "sets")
            more = stash(_unmet(open_, loose, sets, similarity), "pairs")
            more = stash(_verified(more, sets, similarity), "more")
            if more.take(1):  # these join components
                of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
                ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
                larger = stash(components(ends), "larger").withColumnsRenamed({"node": "_node", "component": "_larger"})
                alone = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
                found = found.unionByName(alone).join(larger, F.col("component") == F.col("_node"), "left")
                found = stash(found.select("node", F.coalesce("_larger", "component").alias("component")), "components")
        joined = numbered.join(found, F.col("class") == F.col("node"), "left")
        return stash(joined.select("one", "two", F.coalesce("component", "class").alias("component")), "classes", keep=True)


def copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each unit that has a copy or near copy elsewhere, with its component's first occurrence and ``removed``."""
    with tidy(docs.sparkSession):
        marks = stash(units(docs), "units")
        found = link(docs, marks, similarity)
        marks = marks.withColumn("two", F.coalesce("two", F.get("keys", F.lit(0)))).drop("keys", "size", *_PARITY)
        rows = stash(marks.join(found, ["one", "two"]).drop("one", "two"), "rows", keep=True)
        spot = F.xxhash64("doc_id", "doc", "at", "n_words")
        place = F.struct("doc_id", "doc", "at", "n_words")
        firsts = rows.groupBy("component").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.min(spot).alias("low"), F.max(spot).alias("high")
        )
        firsts = stash(firsts.filter("low <> high").drop("low", "high"), "firsts", keep=True)  # by itself, so that a hot component's rows can be split
    return rows.join(firsts, "component").select(
        "doc_id", "doc", "at", "n_words", "first_char", "n_chars", "component", "copies",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.at").alias("first_at"), (~place.eqNullSafe(F.col("first"))).alias("removed"),
    )


def passages(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The repeated passages: units of :func:`copies` of one document that meet are one, removed ones apart from first occurrences.

    ``at`` and ``n_words`` count words, ``first_char`` and ``n_chars`` characters; ``component``, ``copies`` and ``first_*``
    are those of its first unit.
    """
    rows = copies(docs, similarity)
    order = Window.partitionBy("doc_id", "doc", "removed").orderBy("at", F.desc("n_words"), "component")
    reach = F.max(F.col("at") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", reach.isNull() | (F.col("at") > reach))
    rows = rows.withColumn("run", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    of_first = lambda c: F.max(F.when(F.col("fresh"), F.col(c))).alias(c)
    runs = rows.groupBy("doc_id", "doc", "removed", "run").agg(
        F.min("at").alias("at"), F.max(F.col("at") + F.col("n_words")).alias("end"),
        F.min("first_char").alias("first_char"), F.max(F.col("first_char") + F.col("n_chars")).alias("last_char"),
        *[of_first(c) for c in ("component", "copies", "first_doc_id", "first_at")],
    )
    return runs.select(
        "doc_id", "doc", "at", (F.col("end") - F.col("at")).alias("n_words"), "first_char", (F.col("last_char") - F.col("first_char")).alias("n_chars"),
        "component", "copies", "first_doc_id", "first_at", "removed",
    )


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """A text without the given ranges of characters (first, number); lines that lose all their words go, other breaks stay."""
    parts, at = [], 0
    for first, n in sorted(cuts):
        parts += [text[at:first], "\n" * text.count("\n", max(at, first), first + n)]
        at = max(at, first + n)
    parts.append(text[at:])
    blank = " \t\x0b\x0c\r"
    lines = zip("".join(parts).split("\n"), text.split("\n"), strict=True)
    return "\n".join(now for now, before in lines if now.strip(blank) or not before.strip(blank))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the passages marked as removed."""
    gone = passages(docs, similarity).filter("removed").groupBy("doc_id", "doc").agg(F.collect_set(F.struct("first_char", "n_chars")).alias("cuts"))
    # The input's columns go along as one, so that their names don't meet those of this function.
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("doc"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _same_doc(rows, gone, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = [t if c is None else without(t, [(x["first_char"], x["n_chars"]) for x in c]) for t, c in zip(texts, cuts)]
            yield pa.RecordBatch.from_arrays([*b.column(2).flatten(), pa.array(out, pa.string())], names=names)

    names = [*(f"c{i}" for i in range(len(docs.columns))), "text"]
    ship(docs.sparkSession)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    cut = rows.select("row.text", "cuts", "row").mapInArrow(run, f"{kinds}, text string")
    return cut.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return passages(docs).drop("doc")
