"""Operator 6, URL rules and empirical-Bayes host reputation.

A url that fits a rule gets the verdict of the longest one.  Any other is judged
by its host's reputation.  Labelled pages count as good or bad outcomes of their
host.  Rates are shrunk level by level: the prior of a suffix is fitted to all
outcomes, that of a registered domain is its suffix's posterior mean, that of a host
its domain's, each with a beta-binomial strength fitted by moments to the spread
of its level.  A host is blocked where the lower posterior bound of its bad
rate, mean less ``Z`` standard deviations, is over ``LIMIT``; a host without
outcomes inherits its domain's posterior, and an unseen domain its suffix's.

Everything is a DataFrame expression; what is grouped are sums, so a host with a
third of all pages costs no more than its partial sums, and pages meet the table
of hosts in a join that Spark splits where a host is hot.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the reputation of the empty host; a page whose label is
missing counts nowhere; repeated rows each get their verdict; no labels at all
mean that nothing is blocked but by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.scratch import stash

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
# Suffixes of two labels under which domains are registered.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.vn", "gov.uk", "org.uk")

LIMIT = 0.5
Z = 1.645
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000.0
LABEL_ID = r"^/[a-z]+/([0-9]{1,18})"  # a page's path names the document that it shows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host with A-Z lowered, up to ``/ ? #``; then the path up to ``? #``."""
    url = F.coalesce(url, F.lit(""))
    found = url.contains("://")
    rest = F.when(found, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that a url fits, as struct(rule, verdict); null if none.  Of equally long ones the first in order of name."""
    hits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_min(F.array_compact(F.array(*hits)))


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host of one label, or without any, is its own."""
    labels = F.split(host, r"\.")
    long = F.array_contains(F.lit(list(LONG_SUFFIXES)), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."))
    n = F.when(long & (F.size(labels) > 1), F.lit(2)).otherwise(F.lit(1))
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    return tail(n + 1), tail(n)


def _strength(rows: DataFrame) -> float:
    """The beta-binomial strength of a level's (n, bad, m), m being each group's prior mean, by moments; one number."""
    spread = F.sum(F.col("n") * (F.col("bad") / F.col("n") - F.col("m")) ** 2) / F.sum("n")
    noise = F.sum(F.col("m") * (1 - F.col("m"))) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))) / F.sum("n")
    over = spread - noise
    kappa = rows.filter("n > 0").agg(F.when(over > 0, between / over - 1).alias("k")).first()["k"]
    return MOST_STRENGTH if kappa is None else min(max(kappa, LEAST_STRENGTH), MOST_STRENGTH)


def _posterior(rows: DataFrame) -> DataFrame:
    """``rows`` with the posterior ``a, b`` of Beta(m k, (1 - m) k) after their outcomes."""
    k = F.lit(_strength(rows))
    return rows.withColumn("a", F.col("m") * k + F.col("bad")).withColumn("b", (1 - F.col("m")) * k + F.col("n") - F.col("bad"))


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, bad, mean, bound) of each of ``hosts`` (host), from ``outcomes`` (host, bad: 0 or 1)."""
    domain, suffix = levels(F.col("host"))
    counts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    known = hosts.select("host").distinct().join(counts, "host", "left").na.fill(0, ["n", "bad"])
    known = stash(known.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    n, bad = known.agg(*sums).first()
    by_suffix = _posterior(known.groupBy("suffix").agg(*sums).withColumn("m", F.lit(((bad or 0) + 1) / ((n or 0) + 2))))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    by_domain = known.groupBy("domain", "suffix").agg(*sums).join(by_suffix.select("suffix", mean.alias("m")), "suffix")
    by_domain = _posterior(by_domain)
    by_host = _posterior(known.join(by_domain.select("domain", mean.alias("m")), "domain"))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.select("host", "n", "bad", mean.alias("mean"), (mean - z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, *, limit: float = LIMIT, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bound) of each page; ``outcomes`` are (host, bad)."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    df = df.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    known = reputation(outcomes, df).select(F.col("host").alias("_h"), "mean", "bound")
    df = df.join(known, F.col("host") == F.col("_h"))
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return df.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        F.round("mean", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"),
    )


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of each page whose path names a labelled document: of low quality, or toxic, is bad."""
    host, path = host_and_path(F.col("url"))
    shown = pages.select(host.alias("host"), F.regexp_extract(path, LABEL_ID, 1).alias("d")).filter("d <> ''")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.select(F.col("doc_id").alias("_id"), bad.alias("bad")).filter("_id is not null and bad is not null")
    known = known.groupBy("_id").agg(F.max("bad").alias("bad"))
    return shown.join(known, F.col("d").cast("long") == F.col("_id")).select("host", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, outcomes_of(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _sql() -> str:
    def level(name: str, rows: str) -> str:
        return f"""
{name}_r as ({rows}),
{name}_k as (select least(greatest(coalesce(case when s - e > 0 then b / (s - e) - 1 else {MOST_STRENGTH} end, {MOST_STRENGTH}), {LEAST_STRENGTH}), {MOST_STRENGTH}) as k
  from (select sum(n * (bad::double / n - m) ** 2) / sum(n) as s, sum(m * (1 - m)) / sum(n) as e, sum(n * m * (1 - m)) / sum(n) as b
        from {name}_r where n > 0)),
{name} as (select *, m * k + bad as a, (1 - m) * k + n - bad as b from {name}_r, {name}_k)"""

    tests = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p}'"
        for h, p, _ in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    )
    verdicts = " ".join(f"when '{h + p}' then '{v}'" for h, p, v in RULES)
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    return f"""
with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
known as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels
          where doc_id is not null and (quality = 0 or toxic = 1 or (quality is not null and toxic is not null)) group by doc_id),
o as (select host, bad from (select host, regexp_extract(path, '{LABEL_ID}', 1) as d from p) x join known on x.d <> '' and try_cast(x.d as bigint) = doc_id),
c as (select host, count(*) as n, sum(bad) as bad from o group by host),
l as (select host, string_split(host, '.') as ls from (select distinct host from p)),
h as (select host, coalesce(c.n, 0) as n, coalesce(c.bad, 0) as bad,
             case when len(ls) > 1 and list_contains([{long}], array_to_string(ls[-2:], '.')) then 2 else 1 end as sn, ls
      from l left join c using (host)),
hl as (select host, n, bad, array_to_string(ls[greatest(len(ls) - sn, 1):], '.') as domain, array_to_string(ls[greatest(len(ls) - sn + 1, 1):], '.') as suffix from h),
ov as (select (sum(bad) + 1) / (sum(n) + 2)::double as m from hl),
{level("s", "select suffix, sum(n) as n, sum(bad) as bad, any_value(ov.m) as m from hl, ov group by suffix")},
{level("dm", "select g.domain, g.n, g.bad, s.a / (s.a + s.b) as m from (select domain, suffix, sum(n) as n, sum(bad) as bad from hl group by domain, suffix) g join s using (suffix)")},
{level("ho", "select hl.host, hl.n, hl.bad, dm.a / (dm.a + dm.b) as m from hl join dm using (domain)")},
r as (select host, a / (a + b) as mean, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ho),
j as (select page_id, p.host, path, mean, bound, case {tests} end as rule from p join r using (host))
select page_id, host, path, rule,
       coalesce(case rule {verdicts} end, case when bound > {LIMIT} then 'block' else 'allow' end) as verdict,
       round(mean, 9) as bad_rate, round(bound, 9) as bound
from j
"""


SQL = _sql()
