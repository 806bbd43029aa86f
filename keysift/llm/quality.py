"""Operator 1, line-first quality rules, in DataFrame functions alone.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines go, and a document that loses too much of its text goes with them.  All
work stays inside a row: no shuffle, so a hot source or copy group costs nothing.

Defined cases: a null text counts as an empty one; an empty text has no words
and fails the base rule; blank lines neither fail nor count; repeated rows are
judged one by one; columns of the input with the names of result columns are
replaced in :func:`measure` and kept out of the query's result, all others stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|•·»›"
# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript",
    "lorem ipsum", "privacy policy", "sign up for", "subscribe to our", "terms of service", "terms of use",
)
TERMINAL = r"""[.!?…]["'”’»)\]]*[\x20\x09-\x0D]*$"""

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "cleaned", "cleaned_chars", "kept",
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOSS_PERCENT = 50

_POS_BITS = 24
_POS_MASK = (1 << _POS_BITS) - 1


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit("[" + characters + "]"))


def _squeezed(text: Column) -> Column:
    """The text without white space; chained replacements are far cheaper here than translate()."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def line_fails(line: Column, doc: dict[str, Column]) -> Column:
    """Whether a line breaks a rule; a line without words never does.

    ``doc`` has what is known of the whole document (``symbols, exclaims,
    separated, furniture, repeats``), so that rules that can't apply cost nothing.
    """
    n = F.regexp_count(line, F.lit(WORD))
    parts = F.split(F.trim(line), " ")
    punctuation = (
        ~line.rlike(TERMINAL)
        | (doc["symbols"] & (_count(line, SYMBOLS) * 10 > n))
        | (doc["exclaims"] & (_count(line, "!") * 5 > n))
    )
    navigation = doc["separated"] & (_count(line, SEPARATORS) >= 3) & (_count(line, SEPARATORS) * 4 >= n)
    lowered, phrase = F.lower(line), F.lit(False)
    for x in BOILERPLATE:
        phrase = phrase | lowered.contains(x)
    shouting = (line == F.upper(line)) & line.rlike("\\p{Lu}") & (n >= 3)
    repeating = doc["repeats"] & (F.size(parts) >= 10) & (F.size(F.array_distinct(parts)) * 3 < F.size(parts))
    return line.rlike(WORD) & (punctuation | navigation | (doc["furniture"] & phrase) | shouting | repeating)


def _covered(flagged: Column) -> Column:
    """Words covered by three-word windows that begin at the sorted positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    return F.aggregate(
        flagged,
        start,
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from ``_words``.

    A sorted array of longs (hash in the high bits, position in the low ones)
    brings equal windows together.  Where two different windows share the high
    bits, or positions don't fit, the windows themselves are sorted instead.
    """
    at = lambda arr, i: F.get(arr, i)
    words, n = F.col("_words"), F.col("_n")
    idx = lambda i: i.cast("int")
    packed = F.transform(
        words, lambda x, i: F.xxhash64(x, at(words, i + 1), at(words, i + 2)).bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("long"))
    )
    df = df.withColumn("_packed", F.sort_array(F.slice(packed, F.lit(1), F.greatest(n - 2, F.lit(0)).cast("int"))))
    high = lambda x: F.shiftright(x, _POS_BITS)
    p = F.col("_packed")
    same = lambda x, j: F.coalesce(high(x) == high(at(p, j)), F.lit(False))
    df = df.withColumn("_pairs", F.filter(p, lambda x, j: same(x, j - 1) | same(x, j + 1)))
    q = F.col("_pairs")
    pos = lambda x: idx(x.bitwiseAND(F.lit(_POS_MASK)))
    differs = lambda a, b: (
        (at(words, a) != at(words, b)) | (at(words, a + 1) != at(words, b + 1)) | (at(words, a + 2) != at(words, b + 2))
    )
    clash = F.exists(
        F.transform(q, lambda x, j: F.coalesce((high(x) == high(at(q, j - 1))) & differs(pos(x), pos(at(q, j - 1))), F.lit(False))),
        lambda x: x,
    )
    df = df.withColumn("_clash", (n > _POS_MASK) | clash)
    # The exact way for the rest: rows of (window, position), sorted as such.
    window = lambda x, i: F.struct(
        F.struct(x.alias("a"), at(words, i + 1).alias("b"), at(words, i + 2).alias("c")).alias("w"), i.cast("long").alias("i")
    )
    empty = F.array().cast("array<struct<w:struct<a:string,b:string,c:string>,i:bigint>>")
    df = df.withColumn("_exact", F.when(F.col("_clash"), F.sort_array(F.slice(F.transform(words, window), F.lit(1), (n - 2).cast("int")))).otherwise(empty))
    e = F.col("_exact")
    eq = lambda x, j: F.coalesce(x["w"] == at(e, j)["w"], F.lit(False))
    by_window = F.transform(F.filter(e, lambda x, j: eq(x, j - 1) | eq(x, j + 1)), lambda x: x["i"])
    by_hash = F.transform(q, lambda x: x.bitwiseAND(F.lit(_POS_MASK)))
    return df.withColumn("_flagged", F.sort_array(F.when(F.col("_clash"), by_window).otherwise(by_hash))).withColumn(
        "n_repeat_words", _covered(F.col("_flagged"))
    )


def measure(docs: DataFrame, *, min_words: int = MIN_WORDS, max_loss_percent: int = MAX_LOSS_PERCENT) -> DataFrame:
    """The documents with their measures, ``cleaned`` text and verdict ``kept``.

    The columns added are ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, n_failed_lines, cleaned,
    cleaned_chars, kept``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # The input's columns go along as one, so that their names don't meet those of this function.
    df = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))
    df = df.withColumn("_text", text).withColumn("_bare", F.btrim(F.col("_text"), F.lit(SPACES)))
    words = F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split(F.col("_bare"), GAP))
    df = df.withColumn("_words", words)
    df = df.withColumn("_n", F.size("_words").cast("long"))
    df = _repeat_words(df)
    t = F.col("_text")
    phrase, lowered = F.lit(False), F.lower(t)
    for x in BOILERPLATE:
        phrase = phrase | F.col("_lower").contains(x)
    separated = F.lit(False)
    for x in SEPARATORS:
        separated = separated | t.contains(x)
    df = df.withColumn("n_symbols", _count(t, SYMBOLS).cast("long")).withColumn("_lower", lowered)
    df = df.withColumn("_furniture", phrase).withColumn("_separated", separated).withColumn("_lines", F.split(t, "\n", -1))
    known = {
        "symbols": F.col("n_symbols") > 0, "exclaims": t.contains("!"), "separated": F.col("_separated"),
        "furniture": F.col("_furniture"), "repeats": F.col("n_repeat_words") * 5 >= F.col("_n"),
    }
    # One column that the rules read several times: the optimizer would put an expression that is read once into the
    # rules themselves, and judge the whole document anew for each line.
    flags = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(known.values())]
    df = df.withColumn("_flags", functools.reduce(Column.__add__, flags))
    known = {name: F.col("_flags").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(known)}
    df = df.withColumn("_full", F.filter(F.col("_lines"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_good", F.filter(F.col("_lines"), lambda x: ~line_fails(x, known)))
    df = df.withColumn("cleaned", F.array_join(F.col("_good"), "\n"))
    out = (
        df.withColumn("n_words", F.col("_n"))
        .withColumn("word_chars", F.length(_squeezed(F.col("_text"))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
        .withColumn("n_lines", F.size("_full").cast("long"))
        .withColumn("n_failed_lines", (F.size("_lines") - F.size("_good")).cast("long"))
        .withColumn("cleaned_chars", F.length(_squeezed(F.col("cleaned"))).cast("long"))
    )
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    lost = F.col("word_chars") - F.col("cleaned_chars")
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * lost <= max_loss_percent * F.col("word_chars")))
    # Out of a generator: the optimizer would else put each measure's whole expression into whatever a caller filters or
    # computes by it, again and again.
    given = [F.col(f"_in.`{c}`").alias(c) for c in docs.columns if c not in MEASURES]
    return out.select("_in", F.explode(F.array(F.struct(*MEASURES))).alias("_measures")).select(*given, "_measures.*")


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of ``docs``."""
    df = measure(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_in"))).filter("kept")
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return df.select(*[new.get(c, F.col(f"_in.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measure(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_failed_lines", "cleaned_chars",
    )


def _sql() -> str:
    sp = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    word = r"[^\x20\x09-\x0D]+"
    nchars = lambda s, chars: f"(length({s}) - length(translate({s}, {chars}, '')))"
    sym, sep = f"'{SYMBOLS}'", f"'{SEPARATORS}'"
    phrases = " or ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
    terminal = TERMINAL.replace("'", "''")
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{word}') as ws, string_split(t, chr(10)) as ls from d),
tri as (select rid, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] as g
        from (select rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
ln as (select rid, l, dw, rw, len(regexp_extract_all(l, '{word}')) as nw, string_split(trim(l, ' '), ' ') as ps
       from (select rid, unnest(ls) as l, len(ws) as dw, coalesce(cov.n, 0) as rw from w left join cov using (rid))),
lj as (select rid, l, nw, nw > 0 and (
         not regexp_matches(l, '{terminal}')
         or {nchars('l', sym)} * 10 > nw or {nchars('l', "'!'")} * 5 > nw
         or ({nchars('l', sep)} >= 3 and {nchars('l', sep)} * 4 >= nw)
         or {phrases}
         or (l = upper(l) and regexp_matches(l, '\\p{{Lu}}') and nw >= 3)
         or (5 * rw >= dw and len(ps) >= 10 and len(list_distinct(ps)) * 3 < len(ps))) as bad from ln),
la as (select rid, count(*) filter (nw > 0) as n_lines, count(*) filter (bad) as n_failed_lines,
              count(*) filter (nw > 0) - count(distinct case when nw > 0 then l end) as n_dup_lines,
              coalesce(sum(length(translate(l, {sp}, ''))) filter (not bad), 0)::bigint as cleaned_chars
       from lj group by rid),
m as (select w.doc_id, len(ws)::bigint as n_words, length(translate(t, {sp}, ''))::bigint as word_chars,
             {nchars('t', sym)}::bigint as n_symbols, n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
             n_lines, n_failed_lines, cleaned_chars
      from w join la using (rid) left join cov using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
       not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         and 100 * (word_chars - cleaned_chars) <= {MAX_LOSS_PERCENT} * word_chars as kept,
       n_lines, n_failed_lines, cleaned_chars
from m
"""


SQL = _sql()
