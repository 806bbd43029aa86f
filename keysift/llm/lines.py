"""Operator 8, line dedup by winnowing, in DataFrame functions alone.

A document is its sequence of lines that have words.  A window is ``RUN`` such
lines in a row (a shorter document is one window); the least line hash of each
window is a fingerprint, so two documents that share a run of ``RUN`` lines share a
fingerprint at the same place of it.  Fingerprints that occur at one position
alone are set aside; around the others the windows are formed that hold them, and
positions are joined by the whole window, which extends a match both ways, line
by line.  Of a window's positions the first (by doc_id, then place) stays; the
lines of all later ones go.  Overlapping later windows make up a later run, so a
repeated run of any length of ``RUN`` lines or more goes whole, and no shorter one.

Every run of fewer than ``RUN`` lines that has more than ``WORDS`` words is a window
as well, so a repeated passage of so many words goes whole even where it fills one
or two lines of a longer document.

No pair of positions is ever formed: a window's positions meet only the first of
them, by an aggregate, so a line in a third of all documents costs its rows.

Defined cases: a null text is an empty one and stays null; blank lines carry no
hash and are never counted (one goes with the line with words that it follows; those
before the first such line stay); of documents with equal text the smallest doc_id counts as the first
(null comes before all), and repeated rows with the same doc_id are told apart by
their text and otherwise count as one document; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.quality import WORD
from keysift.llm.scratch import sifted, stash

RUN = 3
WORDS = 50


def _document() -> tuple[Column, Column]:
    """What a document is known by: its doc_id and a hash of its text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("doc"), F.col("doc_id").alias("id")


def _marks(docs: DataFrame, run: int) -> DataFrame:
    """(doc, id, hashes, at): a hash of the row's text and its doc_id, its line hashes and the place of each fingerprint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        *_document(),
        F.transform(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)).alias("hashes"),
    ).filter(F.size("hashes") > 0)
    h = F.col("hashes")
    starts = F.sequence(F.lit(0), F.greatest(F.size(h) - run, F.lit(0)))
    # The rightmost least hash of a window: the place of each, once.
    least = lambda i: F.array_max(
        F.transform(F.slice(h, i + 1, F.lit(run)), lambda x, j: F.struct((-(F.shiftright(x, 1))).alias("h"), (i + j).alias("at")))
    )["at"]
    return df.withColumn("at", F.array_distinct(F.transform(starts, least)))


def _long(docs: DataFrame, run: int, words: int) -> DataFrame:
    """(doc, id, at, hashes) of each run of fewer than ``run`` lines that has more than ``words`` words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(
        *_document(),
        F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(f"{WORD}+")).alias("n"))).alias("lines"),
    )
    total = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + x["n"])

    def runs(k: int) -> Column:
        every = F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.slice(F.col("lines"), i + 1, F.lit(k)).alias("w")))
        return F.filter(every, lambda x: (F.size(x["w"]) == k) & (total(x["w"]) > words))

    df = df.select("doc", "id", F.explode(F.concat(*[runs(k) for k in range(1, run)])).alias("x"))
    return df.select("doc", "id", F.col("x.at").alias("at"), F.col("x.w.h").alias("w"))


def _repeated(marks: DataFrame, run: int, long: DataFrame) -> DataFrame:
    """(id, doc, line) of each line that belongs to a later occurrence of a window; ``long``: windows beside those of ``run`` lines."""
    at = marks.select("doc", "id", F.explode("at").alias("at"), "hashes")
    at = at.withColumn("mark", F.get("hashes", F.col("at")))
    often = at.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mark")
    # Only what lies around a fingerprint goes along: the windows that hold it.
    low = F.greatest(F.col("at") - (run - 1), F.lit(0))
    last = F.greatest(F.size("hashes") - run, F.lit(0))
    near = at.select("doc", "id", "mark", low.alias("low"), F.least(F.col("at"), last).alias("high"), F.slice("hashes", low + 1, F.lit(2 * run - 1)).alias("near"))
    near = near.join(often, "mark", "left_semi")
    windows = near.select(
        "doc",
        "id",
        F.explode(
            F.transform(
                F.sequence("low", "high"),
                lambda i: F.struct(i.alias("at"), F.slice("near", i - F.col("low") + 1, F.lit(run)).alias("w")),
            )
        ).alias("x"),
    ).select("doc", "id", "x.at", "x.w")
    windows = windows.unionByName(long)
    # A window's key is 96 bits of hash and its size, as a short document is a window of its own.
    n = F.size("w")
    windows = windows.select("doc", "id", "at", F.xxhash64("w").alias("w"), F.hash("w").alias("v"), n.alias("n")).distinct()
    place = F.struct(F.col("id"), F.col("doc"), F.col("at"))
    key = ["w", "v", "n"]
    firsts = windows.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("uses")).filter("uses > 1").drop("uses")
    later = windows.join(firsts, key).filter(~place.eqNullSafe(F.col("first")))
    return later.select("id", "doc", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("line")).distinct()


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``docs`` with the later repeated runs of ``run`` lines, or of fewer with more than ``words`` words, cut from ``text``, and ``n_lines, n_removed_lines, n_removed_runs``, which take the place of input columns so named.

    Only texts that may lose lines are dealt to them; the others are passed on from where they are read.
    """
    marks = stash(_marks(docs, run), "marks")
    key = F.struct("id", "doc").alias("key")
    removed = _repeated(marks, run, _long(docs, run, words)).groupBy(key).agg(F.sort_array(F.collect_list("line")).alias("removed"))
    removed = stash(removed, "removed")
    # The input's columns go along as one, so that their names don't meet those of this function.
    rows = docs.select(*_document(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(key, "row")
    maybe, clear = sifted(rows, removed, "key")
    clear = clear.withColumn("removed", F.lit(None).cast("array<int>"))
    df = maybe.join(removed, "key", "left").unionByName(clear)
    df = df.withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n", -1))
    # Where each line with words is among all lines; the blank ones after it go or stay with it.
    places = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    df = df.withColumn("places", places).withColumn("full", F.size("places"))
    cut = F.col("removed").isNotNull()
    runs = F.size(F.filter("removed", lambda x, i: (i == 0) | (x != F.get("removed", i - 1) + 1)))
    # array_except() looks numbers up in a set, so a document of many lines costs no square of them.
    df = df.withColumn("rest", F.when(cut, F.array_except(F.sequence(F.lit(0), F.col("full") - 1), F.col("removed"))))
    first = lambda i: F.get("places", i)
    end = lambda i: F.coalesce(first(i + 1), F.size("lines"))
    parts = F.transform("rest", lambda i: F.slice("lines", first(i) + 1, end(i) - first(i)))
    head = F.slice("lines", F.lit(1), first(F.lit(0)))
    kept = F.array_join(F.concat(head, F.flatten(parts)), "\n")
    counts = {
        "n_lines": F.col("full").cast("long"),
        "n_removed_lines": F.coalesce(F.array_size("removed"), F.lit(0)).cast("long"),
        "n_removed_runs": F.when(cut, runs).otherwise(0).cast("long"),
    }
    old = {c: F.col(f"row.`{c}`") for c in docs.columns if c not in counts}
    old["text"] = F.when(cut, kept).otherwise(F.col("row.text"))
    out = old | counts
    df = df.select(F.struct(*[c.alias(name) for name, c in out.items()]).alias("out"))
    return df.select(*[F.col(f"out.`{name}`").alias(name) for name in out])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_runs", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


SQL = f"""
with d as (select row_number() over (order by doc_id nulls first, text) as rid, doc_id, text, coalesce(text, '') as t from documents),
r as (select rid, string_split(t, chr(10)) as raw from d),
s as (select rid, raw, list_filter(range(1, len(raw) + 1), lambda i: regexp_matches(raw[i], '[^\\x20\\x09-\\x0D]')) as st from r),
l as (select rid, raw, st, list_transform(st, lambda i: raw[i]) as ls,
             list_transform(st, lambda i: len(regexp_extract_all(raw[i], '[^\\x20\\x09-\\x0D]+'))) as ns from s),
k as (select unnest(range(1, {RUN})) as k),
w as (select rid, p, ls[p + 1:p + {RUN}] as w
      from (select rid, ls, unnest(range(0, greatest(len(ls) - {RUN}, 0) + 1)) as p from l where len(ls) > 0)
      union
      select rid, p, ls[p + 1:p + k]
      from (select rid, ls, ns, k, unnest(range(0, len(ls) - k + 1)) as p from l, k where len(ls) >= k)
      where list_sum(ns[p + 1:p + k]) > {WORDS}),
late as (select rid, p, len(w) as n from w
         qualify row_number() over (partition by w order by rid, p) > 1),
gone as (select distinct rid, unnest(range(p, p + n)) as i from late),
cut as (select rid, list(i order by i) as gone from gone group by rid),
j as (select d.doc_id, d.t, l.raw, l.st, l.ls, coalesce(cut.gone, []) as gone from d join l using (rid) left join cut using (rid))
select doc_id, len(ls)::bigint as n_lines, len(gone)::bigint as n_removed_lines,
       len(list_filter(gone, lambda x: not list_contains(gone, x - 1)))::bigint as n_removed_runs,
       md5(case when len(gone) = 0 then t else coalesce(array_to_string(list_concat(raw[1:st[1] - 1], flatten(
         list_transform(list_filter(range(len(ls)), lambda i: not list_contains(gone, i)),
                        lambda i: raw[st[i + 1]:coalesce(st[i + 2], len(raw) + 1) - 1]))), chr(10)), '') end) as text_md5
from j
"""
