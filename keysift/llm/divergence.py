"""Operator 11, an audit of how far the sources of a language differ in their terms, by a heavy-light split.

Each group, a (lang, source), gives every kept term a share p; the divergence of a pair of
groups sums (p - q)^2 / q over all kept terms of the language.  Terms present in at least
``HEAVY`` of a language's groups are heavy: their shares form dense numpy tiles, terms by
groups, and all pairs of columns are summed at once.  The rest are light.  A light term
gives nearly all pairs what two groups without it give, so it is counted at that value
for all pairs, and corrected where it occurs:

* for a group that has it against each group (one value for each distinct share of a
  group, whatever the number of terms with that share),
* for each two groups that both have it, from its posting list, which the split bounds.

Each part is a sum of whole numbers, so the parts add up exactly.

Counting runs in Arrow batches (a task's counts are combined before the shuffle and handed
on at a set number of entries, so memory is bounded and a hot source or word costs a row
a task); all else is joins, grouping and windows.  Nothing is collected: the table of
groups is joined by Spark, which broadcasts it where its written size is small.

Defined cases: null text, lang and source are empty; a language without kept terms has
pairs of value 0 and no terms; a group without terms is a group all the same; a repeated
row is a document of its own; an empty table gives an empty result; other columns are not
read.  Texts of any length are counted in slices.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift.llm.scratch import stash, tidy
from keysift.ship import ship

LEAST_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
HEAVY = 0.25  # the share of a language's groups that have a heavy term
ENTRIES = 300_000  # counts that a task holds
SLICE = 4 << 20  # bytes of a text counted at once
CELLS = 1 << 21  # numbers in a tile

# ASCII letters are lower-cased, all other ASCII ends a term; the bytes of other characters stay.
_LETTERS = string.ascii_letters.encode()
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if b in _LETTERS else 32 for b in range(256))


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if at + SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and of documents; a row with the empty term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, among) in held.items():
                terms = [b"", *n]
                cols = [
                    pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string(), safe=False),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *(among[t] for t in n)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                n, among = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _slices(text):
                    n.update(terms)
                    seen.update(terms)
                among.update(seen)
            if sum(len(n) + 1 for n, _ in held.values()) > ENTRIES:
                yield from out()
        yield from out()

    ship(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    return docs.select(empty("lang"), empty("source"), text).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any count; null where there is no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    div = lambda x, y: F.call_function("div", x, y)
    below = total + terms
    long = div(F.lit(SCALE).cast("long") * (n + 1), below)
    exact = div(F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 1), wide(below))
    return F.when(terms > 0, F.when(n < 9_000_000_000, long).otherwise(exact).cast("long") + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total, groups, lead) of each kept term in each group that has it, and of the empty term in each group.

    ``total`` and ``groups``: its occurrences and groups in the language; ``lead``: one row of each term.
    """
    own = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")  # at most a row for each source
    own = own.withColumn("all", F.sum("docs").over(of)).withColumn("total", F.sum("n").over(of)).withColumn("groups", F.count(F.lit(1)).over(of))
    own = own.withColumn("lead", F.row_number().over(of.orderBy("source")) == 1)
    return own.filter((F.col("all") >= least_docs) | (F.col("term") == "")).drop("docs", "all")


def groups_of(posts: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """(lang, source, g, size, n, p0, lang_n, terms, light): each group's number in its language, its occurrences and share of an absent term."""
    real = F.col("term") != ""
    per = posts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("lang")  # the groups of a language, of which the result has the square
    per = per.withColumn("size", F.count(F.lit(1)).over(of)).withColumn("lang_n", F.sum("n").over(of))
    per = per.withColumn("g", F.row_number().over(of.orderBy("source")) - 1)
    # Terms by how many groups have them, so that a language's terms are counted before they meet its size.
    spread = posts.filter(real & F.col("lead")).groupBy("lang", "groups").agg(F.count(F.lit(1)).alias("k"))
    spread = spread.join(per.select("lang", "size").distinct(), "lang")
    light = F.sum(F.when(F.col("groups") < heavy * F.col("size"), F.col("k")).otherwise(0)).alias("light")
    terms = spread.groupBy("lang").agg(F.sum("k").alias("terms"), light)
    per = per.join(terms, "lang", "left").fillna(0, ["terms", "light"])
    return per.withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("terms")))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, a, b, value) of the pairs of groups: heavy terms whole, light ones what both groups' having them changes."""
    held: dict[str, np.ndarray] = {}

    def rows(lang: str, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), *(pa.array(x, pa.int64()) for x in (a, b, value))], names=["lang", "a", "b", "value"])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, sums in held.items():
            a, b = np.nonzero(sums)
            yield rows(lang, a, b, sums[a, b])
        held.clear()

    def add(lang: str, size: int, first: int, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds the sums of the groups from ``first`` on against all; hands them on where there are too many groups to hold."""
        if size * size > CELLS:
            a, b = np.nonzero(part)
            yield rows(lang, a + first, b, part[a, b])
        else:
            if lang not in held and (len(held) + 1) * size * size > 4 * CELLS:
                yield from flush()
            held.setdefault(lang, np.zeros((size, size), np.int64))[first : first + len(part)] += part

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = p - q
        return d * d // q

    def flat(column: pa.Array, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the lists of some rows, and their lengths."""
        lists = column.filter(pa.array(mask))
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())

    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), object)
        heavy = np.array(batch.column("heavy").to_pylist(), bool)
        for lang in set(names):
            for dense in (True, False):
                mask = (names == lang) & (heavy == dense)
                if not mask.any():
                    continue
                size = batch.column("size")[int(np.flatnonzero(mask)[0])].as_py()
                g, counts = flat(batch.column("g"), mask)
                p, p0 = flat(batch.column("p"), mask)[0], flat(batch.column("p0"), mask)[0]
                start = np.cumsum(counts) - counts
                if dense:
                    table = flat(batch.column("absent"), mask)[0].reshape(-1, size).copy()
                    table[np.repeat(np.arange(len(counts)), counts), g] = p
                    high = max(1, min(len(table), 256, CELLS // size))
                    wide = max(1, CELLS // (high * size))
                    for t in range(0, len(table), high):
                        tile = table[t : t + high]
                        for a in range(0, size, wide):
                            yield from add(lang, size, a, f(tile[:, a : a + wide, None], tile[:, None, :]).sum(0))
                    continue
                ends = np.cumsum(counts.astype(np.int64) ** 2)
                t = 0
                while t < len(counts):  # as many terms as make a tile of pairs
                    until = max(t + 1, int(np.searchsorted(ends, (ends[t - 1] if t else 0) + CELLS, "right")))
                    n, at = counts[t:until], start[t:until]
                    i = np.arange(at[0], at[-1] + n[-1])
                    own = np.repeat(n, n)
                    x = np.repeat(i, own)
                    y = np.repeat(np.repeat(at, n), own) + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
                    change = f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y])
                    key, place = np.unique(g[x] * size + g[y], return_inverse=True)
                    sums = np.zeros(len(key), np.int64)
                    np.add.at(sums, place, change)
                    if size * size > CELLS:
                        yield rows(lang, key // size, key % size, sums)
                    else:
                        part = np.zeros(size * size, np.int64)
                        part[key] = sums
                        yield from add(lang, size, 0, part.reshape(size, size))
                    t = until
    yield from flush()


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS, heavy: float = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from each other of its language, and its most overused terms."""
    with tidy(docs.sparkSession):
        posts = stash(postings(docs, least_docs), "postings")
        groups = stash(groups_of(posts, heavy), "groups")
        own = posts.filter("term <> ''").join(groups.withColumnRenamed("n", "group_n"), ["lang", "source"])
        own = own.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("terms"))).withColumn("heavy", F.col("groups") >= heavy * F.col("size"))

        absent = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("g", "p0")))["p0"].alias("absent"))
        absent = stash(absent, "absent")
        lists = own.groupBy("lang", "term").agg(
            F.any_value("size").alias("size"), F.any_value("heavy").alias("heavy"), F.collect_list(F.struct("g", "p", "p0")).alias("x")
        )
        dense = lists.join(absent, "lang").select("lang", "size", "heavy", "x.g", "x.p", "x.p0", F.when(F.col("heavy"), F.col("absent")).alias("absent"))
        ship(docs.sparkSession)
        sums = dense.mapInArrow(_tiles, "lang string, a bigint, b bigint, value bigint")

        levels = own.filter("not heavy").groupBy("lang", "g", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
        other = groups.select("lang", F.col("g").alias("s"), F.col("p0").alias("s0"))
        against = levels.join(other, "lang").filter("g <> s")
        p, p0, s0, n = (F.col(c) for c in ("p", "p0", "s0", "n"))
        to = F.struct(F.col("g").cast("long").alias("a"), F.col("s").cast("long").alias("b"), (n * (apart(p, s0) - apart(p0, s0))).alias("value"))
        back = F.struct(F.col("s").cast("long").alias("a"), F.col("g").cast("long").alias("b"), (n * (apart(s0, p) - apart(s0, p0))).alias("value"))
        sums = sums.unionByName(against.select("lang", F.explode(F.array(to, back)).alias("x")).select("lang", "x.*"))
        sums = stash(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("sum")), "sums")

        one = groups.select("lang", "source", F.col("g").cast("long").alias("a"), "p0", "light")
        two = groups.select("lang", F.col("source").alias("item"), F.col("g").cast("long").alias("b"), F.col("p0").alias("s0"))
        pairs = one.join(two, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
        value = F.coalesce("sum", F.lit(0)) + F.coalesce(F.col("light") * apart(p0, s0), F.lit(0))
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

        q = share(F.col("total"), F.col("lang_n"), F.col("terms"))
        terms = own.withColumn("q", q).filter("n > 0 and p > q")
        terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(p, F.col("q")).cast("long").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        rank = F.row_number().over(order).alias("rank")
        out = pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= ranks))
        return stash(out, "audit", keep=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as t from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct rid) >= {LEAST_DOCS}),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select x.lang, count(k.term) as v from (select distinct lang from g) x left join k using (lang) group by x.lang),
n as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by all),
l as (select lang, sum(n) as n from n group by lang),
p as (select n.lang, n.source, k.term, coalesce(c.n, 0) as n,
             (1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (n.n + v.v))::bigint as p,
             (1 + ({SCALE}::hugeint * (k.total + 1)) // (l.n + v.v))::bigint as q
      from n join v using (lang) join l using (lang) join k using (lang)
      left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
         from g a join g b on a.lang = b.lang and a.source <> b.source
         left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
      from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= {TERM_RANKS}
"""
