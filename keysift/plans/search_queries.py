"""Queries of the search engine over the test tables: the spatial index, matching and routing of tables of queries, PCA, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions import matching, text, vector
from keysift.functions.taxonomy import ALIASES, DOMAINS
from keysift.operators import batch, domains, routing, spatial
from keysift.operators.index import BuildOptions, Index, build, fit_pca, moments
from keysift.operators.search import CLIP, DOMAIN, MAX_QUERY, OBJECT, candidate_budget, inspect, search
from keysift.plans.catalog import _DISTANCE, _FRAMES, _PROTOTYPES, _VARIANTS, _grams_sql, _normal, _normal_sql, NEAR, TOP, query, r6
from keysift.plans.standin import LengthEncoder, frames, prototypes, query_vector, table
from keysift.sources.shared import place, stored

EVERY = 50  # the rows that ask: those whose id it divides
TILE = 32


def spatial_index(df: DataFrame, path: str, tile_rows: int = TILE, sample: int = 50_000) -> DataFrame:
    """Writes the points of (position, collection_id, reduced) in tiles to ``path`` and returns their boxes, as the index build does."""
    import numpy as np

    rows, size = df.count(), df.select(F.size("reduced")).first()[0]
    tile_rows = spatial.tile_size(rows, tile_rows)
    step = max(1, -(-rows // sample))
    chosen = df.filter(F.col("position") % step == 0).select("reduced").collect()  # a bounded sample
    tree = spatial.fit_tree(np.asarray([r[0] for r in chosen]), rows, tile_rows)
    spatial.tiled(df, ["collection_id"], tree, tile_rows).write.partitionBy("collection_id", "tile").parquet(path)
    return spatial.boxes(df.sparkSession.read.parquet(path), ["collection_id"], size)


@query(f"""
with {_FRAMES},
n as (select a.position as query_id, f.collection_id, f.position, sqrt(list_sum(list_transform(list_zip(f.vector, a.vector), lambda z: (z[1] - z[2]) ** 2))) as d
      from f join f a on a.position % {EVERY} = 0)
select query_id, collection_id, position, round(d, 6) as distance, rank() over (partition by query_id, collection_id order by d) as place
from n qualify place <= {NEAR}
""")
def spatial_knn(spark, sf_dir):
    """The nearest frames of each collection for a set of queries, by the tiles of the spatial index."""
    df = frames(spark, sf_dir).withColumn("reduced", F.col("vector"))
    path = place(spark, "tiles")
    tiles = spatial_index(df.select("position", "collection_id", "reduced"), path).withColumn("grain", F.lit("frames")).withColumn("part", F.col("collection_id"))
    points = spark.read.parquet(path).select("collection_id", "tile", "position", F.col("tile").alias("home"), "reduced")
    asking = df.filter(F.col("position") % EVERY == 0).select(F.col("position").alias("query_id"), F.col("vector").alias("query"))
    parts = [r[0] for r in df.select("collection_id").distinct().collect()]  # a handful of collections
    asks = asking.withColumn("part", F.explode(F.array(*[F.lit(c) for c in parts])))
    asks = asks.select(F.struct("query_id", "part").alias("ask"), "part", "query", F.lit(NEAR).alias("k"))
    found = spatial.nearest(asks, tiles, {"frames": (points, ["collection_id", "tile"])})
    return found.select("ask.query_id", "collection_id", "position", r6("distance").alias("distance"), F.col("place").cast("long").alias("place"))


_WORDS = f"""
w as (select distinct unnest(string_split({_normal_sql('text')}, ' ')) as word from conversations),
v as (select distinct unnest(string_split({_normal_sql('p_name')}, ' ')) as target from part)
"""
SHARE = 0.2


@query(f"""
with {_WORDS}
select word, target, levenshtein(word, target) as edits from w, v
where word <> '' and target <> '' and levenshtein(word, target) <= {SHARE} * (length(word) + length(target)) + 1e-9
""")
def fuzzy_word_pairs(spark, sf_dir):
    """All pairs of words of conversations and of part names within a fifth of both lengths in edits."""
    split = lambda name, column, out: table(spark, sf_dir, name).select(F.explode(text.tokens(_normal(column))).alias(out))
    pairs = matching.near_words(split("conversations", "text", "word"), split("part", "p_name", "target"), SHARE)
    return pairs.withColumn("edits", F.levenshtein("word", "target").cast("long"))


def _score_sql(c: str, t: str) -> str:
    share = f"(len(string_split({c}, ' ')) / len(string_split({t}, ' ')))"
    return (
        f"case when {c} = {t} then 1.0::double when contains(' ' || {c} || ' ', ' ' || {t} || ' ') then 0.97::double "
        f"when len(string_split({c}, ' ')) >= 2 and contains(' ' || {t} || ' ', ' ' || {c} || ' ') and {share} >= 0.6 then 0.88::double * {share} else 0.0::double end"
    )


def _phrases_sql(column: str) -> str:
    """``o`` (conv_id, turn, c, place): the phrases that a query of a conversation's row is matched by."""
    return f"""
{_VARIANTS.replace(_normal_sql('text'), _normal_sql(column))},
x as (select conv_id, turn, i, vv, list_filter(string_split(vv, ' '), lambda t: t <> '') as ws
      from (select conv_id, turn, unnest([v0, v1, v2, v3, v4]) as vv, unnest(range(5)) as i from v)
      where vv <> '' qualify row_number() over (partition by conv_id, turn, vv order by i) = 1),
g as (select conv_id, turn, i, list_concat(list_concat([vv], {_grams_sql(3)}), list_concat({_grams_sql(2)},
        list_filter(ws, lambda t: not list_contains({"[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"}, t) and length(t) > 1))) as cs from x),
u as (select conv_id, turn, i, unnest(cs) as c, generate_subscripts(cs, 1) as k from g),
o as (select conv_id, turn, c, row_number() over (partition by conv_id, turn order by min(i * 1000000 + k)) as place
      from u group by conv_id, turn, c qualify place <= {text.MAX_CANDIDATES})
"""


# A query is a conversation's text and two phrases that the catalog or the part names have, by turns.
_ASKED = [*sorted(ALIASES), *(t for _, _, terms in DOMAINS for t in terms), "small ring", "hot gear", "red bolt", "blue widget", "bolt"]
_ASKED_SQL = "[" + ", ".join(f"'{t}'" for t in _ASKED) + "]"
_QUERY = f"coalesce(text, '') || ' , ' || {_ASKED_SQL}[1 + (conv_id * 7 + turn) % {len(_ASKED)}] || ' / ' || {_ASKED_SQL}[1 + (conv_id * 3 + turn * 11) % {len(_ASKED)}]"


def asked(spark, sf_dir) -> DataFrame:
    """(query_id: (conv_id, turn), query): the text of a conversation's row and two phrases, in the role of a user's query."""
    phrases = F.split(F.lit("\t".join(_ASKED)), "\t")
    pick = lambda n: F.get(phrases, (n % len(_ASKED)).cast("int"))
    c, t = F.col("conv_id"), F.col("turn")
    both = F.concat(F.coalesce("text", F.lit("")), F.lit(" , "), pick(c * 7 + t), F.lit(" / "), pick(c * 3 + t * 11))
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("query_id"), both.alias("query"))


_VOCABULARY = f"""
{_phrases_sql(_QUERY)},
names as (select distinct {_normal_sql('p_name')} as name from part),
vocab as (select distinct target from (select unnest(list_concat(string_split(name, ' '), [name])) as target from names) where target <> '')
"""


@query(f"""
with {_VOCABULARY}
select conv_id, turn, target, round(max(score), 6) as score
from (select conv_id, turn, target, {_score_sql('c', 'target')} as score from o, vocab) where score >= {matching.MINIMUM} group by all
""")
def vocab_match(spark, sf_dir):
    """The terms of a vocabulary that each query's phrases have or are, by keys; misspelt ones are left to tests, as SQL has no such ratio."""
    analysed = stored(domains.analyses(asked(spark, sf_dir)).select("query_id", "candidates"), "analysed")
    name = _normal("p_name")
    terms = table(spark, sf_dir, "part").select(F.explode(F.concat(text.tokens(name), F.array(name))).alias("target")).filter("target <> ''").distinct()
    found = matching.join_terms(routing.phrases_of(analysed), terms, ["query_id"], fuzzy_too=False)
    return found.select("query_id.conv_id", "query_id.turn", "target", r6("score").alias("score"))


_TERMS_SQL = ", ".join(f"({i}, '{t}')" for i, (_, _, terms) in enumerate(DOMAINS) for t in terms)
_ALIAS_SQL = ", ".join(f"('{a}', '{t}')" for a, t in sorted(ALIASES.items()))
_LEXICAL = f"""
alias(target, term) as (values {_ALIAS_SQL}), terms(ord, target) as (values {_TERMS_SQL}),
am as (select distinct conv_id, turn, term from o, alias where {_score_sql('c', 'target')} >= {matching.MINIMUM}),
ph as (select conv_id, turn, c from o union select conv_id, turn, term from am),
dm as (select * from (select conv_id, turn, ord, target, max({_score_sql('c', 'target')} * case when contains(target, ' ') then {routing.PHRASE_WEIGHT} else 1.0::double end) as w
                      from ph, terms group by conv_id, turn, ord, target) where w >= {matching.MINIMUM}),
t3 as (select conv_id, turn, ord, sum(w) as s
       from (select *, row_number() over (partition by conv_id, turn, ord order by w desc, target) as r from dm) where r <= 3 group by conv_id, turn, ord),
lx as (select conv_id, turn, ord, s / max(s) over (partition by conv_id, turn) as lexical from t3)
"""
_ROUTES = f"""
sc as (select *, case when max(lexical) over (partition by conv_id, turn) > 0 then {domains.LEXICAL_WEIGHT} else 0 end as lw
       from (select sm.conv_id, sm.turn, sm.ord, semantic, coalesce(lexical, 0) as lexical from sm left join lx using (conv_id, turn, ord))),
rt as (select *, row_number() over (partition by conv_id, turn order by score desc, ord) as place, max(score) over (partition by conv_id, turn) as best
       from (select *, lw * lexical + (1 - lw) * semantic as score from sc))
"""


@query(f"""
with {_FRAMES}, {_PROTOTYPES.replace("s as (select f.", "ps as (select f.").replace("from s qualify", "from ps qualify")},
{_phrases_sql(_QUERY)},
{_LEXICAL},
dom as (select row_number() over (order by label) - 1 as ord, p from p),
sm as (select conv_id, turn, ord, (least(greatest(list_dot_product(f.vector, dom.p), -1), 1) + 1) / 2 as semantic
       from conversations join f on f.position = (conv_id * 31 + turn) % (select count(*) from embeddings), dom),
{_ROUTES}
select conv_id, turn, ord::int as ord, round(lexical, 6) as lexical, round(semantic, 6) as semantic, round(score, 6) as score, place::int as place,
       place = 1 or (place <= {domains.MAX_DOMAINS} and score >= {domains.RELATIVE_THRESHOLD} * best) as selected
from rt
""")
def route_queries(spark, sf_dir):
    """Every conversation's row as a query, routed in one plan by its words and by a frame's vector in the role of its own."""
    df = frames(spark, sf_dir)
    known = [p for _, p in prototypes(df)]
    catalog = domains.Catalog()
    n = df.count()
    c, t = F.col("query_id.conv_id"), F.col("query_id.turn")
    analysed = domains.analyses(asked(spark, sf_dir)).withColumn("position", (c * 31 + t) % n).join(df.select("position", "vector"), "position")
    analysed = stored(analysed, "analysed")
    aliases = stored(routing.alias_terms(analysed, catalog, fuzzy=False), "aliases")
    found = routing.route_queries(analysed, aliases, catalog, known, fuzzy=False)
    return found.select("query_id.conv_id", "query_id.turn", "ord", *[r6(c).alias(c) for c in ("lexical", "semantic", "score")], "place", "selected")


@query(f"""
with {_FRAMES},
m as (select i, avg(vector[i]) as m from f, range(1, 65) t(i) group by i)
select a.i as i, b.i as j, round(avg(f.vector[a.i] * f.vector[b.i]) - any_value(a.m) * any_value(b.m), 6) + 0.0::double as covariance from f, m a, m b group by a.i, b.i
""")
def vector_covariance(spark, sf_dir):
    """The covariance of the frames' dimensions, from which PCA is fitted, in one pass over the vectors."""
    _, _, covariance = moments(frames(spark, sf_dir).select("vector"))
    rows = [(i + 1, j + 1, float(v)) for i, row in enumerate(covariance) for j, v in enumerate(row)]  # dimensions squared
    return spark.createDataFrame(rows, "i long, j long, covariance double").withColumn("covariance", r6("covariance") + 0.0)  # no negative zero


@query(f"""
with {_FRAMES},
m as (select list(m order by i) as mean from (select i, avg(vector[i]) as m from f, range(1, 65) t(i) group by i))
select position, round({_DISTANCE}, 6) as distance, round({_DISTANCE.replace(', q)', ', mean)')}, 6) as from_mean from f, q, m
""")
def pca_project(spark, sf_dir):
    """Each frame in the space of all principal components: its distances from the query's frame and from the mean are those of the vectors."""
    df = frames(spark, sf_dir).select("position", "vector")
    n = df.count()
    size = df.select(F.size("vector")).first()[0]
    pca = fit_pca(df, n, dimensions=size, sample=n)  # all frames, so that the mean is theirs
    query_point = vector.constant(pca.reduce_query(query_vector(df)))
    df = df.withColumn("reduced", pca.reduce(F.col("vector")))
    return df.select("position", r6(vector.l2(F.col("reduced"), query_point)).alias("distance"), r6(vector.norm(F.col("reduced"))).alias("from_mean"))


OBJECTS = ("person", "bicycle", "car", "dog", "tree", "chair", "book")
SCORE = 0.9


def toy_index(spark, sf_dir) -> tuple[Index, LengthEncoder]:
    """An index over the test tables at a new place in the shared folder, with all principal components, and the encoder of its queries."""
    df = frames(spark, sf_dir)
    encoder = LengthEncoder(tuple(tuple(p) for _, p in prototypes(df)))
    video = F.concat("collection_id", F.lit("_V"), F.lpad((F.col("position") % 5).cast("string"), 3, "0"))
    rows = df.select(
        "position", text.frame_id(video, F.col("position")).alias("keyframe_id"), "collection_id", video.alias("video_id"),
        F.col("position").cast("int").alias("keyframe_number"), F.col("position").cast("int").alias("clip_vector_index"),
        (F.col("position") * 30).cast("int").alias("frame_number"), vector.half_even_ms(F.col("position") * 1.0).alias("timestamp_ms"),
        F.concat(F.lit("keyframes/"), video, F.lit("/"), F.lpad(F.col("position").cast("string"), 3, "0"), F.lit(".jpg")).alias("image_path"), F.lit("").alias("video_path"),
    )
    vectors = df.select(video.alias("video_id"), F.col("position").cast("int").alias("clip_vector_index"), "vector")
    term = F.get(F.array(*[F.lit(t) for t in OBJECTS]), (F.col("position") % len(OBJECTS)).cast("int"))
    found = df.select(video.alias("video_id"), F.col("position").cast("int").alias("keyframe_number"), term.alias("term"), F.lit(SCORE).alias("score"))
    path = place(spark, "index")
    build(rows, vectors, found, path, encoder, options=BuildOptions(pca_dimensions=encoder.dimensions, tile_rows=64))
    return Index.open(spark, path), encoder


def _search_sql(source: str, column: str, collections: tuple[str, ...] = ()) -> str:
    """CTEs up to ``rt`` (routes) and ``top`` (ranked frames) of the queries that ``source`` (conv_id, turn, text) has in ``column``."""
    lengths = ", ".join(f"({i}, {len(prompt)})" for i, (_, prompt, _) in enumerate(DOMAINS))
    tokens_ = ", ".join(f"({i}, '{w}')" for i, (_, _, terms) in enumerate(DOMAINS) for w in sorted({w for t in terms for w in t.split()}))
    objects = "[" + ", ".join(f"'{t}'" for t in OBJECTS) + "]"
    k = candidate_budget(TOP)
    parts = "[" + ", ".join(f"'{c}'" for c in collections or ("*",)) + "]"
    return f"""
{_FRAMES}, {_PROTOTYPES.replace("s as (select f.", "ps as (select f.").replace("from s qualify", "from ps qualify")},
tagged as (select conv_id, turn, {column} as raw from {source}),
asked as (select conv_id, turn, raw, trim(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)#L\\d+\\b', ' ', 'g'), '#(\\w)', '\\1', 'g'), '\\s+', ' ', 'g')) as clean
          from tagged where length(raw) between 1 and {MAX_QUERY}),
good as (select * from asked where clean <> ''),
{_phrases_sql('clean').replace('from conversations', 'from good')},
{_LEXICAL},
known as (select row_number() over (order by label) - 1 as i, p from p),
dom as (select ord, p from (values {lengths}) d(ord, n) join known on i = n % (select count(*) from known)),
prompt as (select conv_id, turn, any_value(clean) || case when count(term) > 0 then '. Visual concepts: ' || string_agg(term, ', ' order by term) || '.' else '' end as prompt
           from good left join am using (conv_id, turn) group by conv_id, turn),
qv as (select conv_id, turn, p as qvec from prompt join known on i = length(prompt) % (select count(*) from known)),
sm as (select conv_id, turn, ord, (least(greatest(list_dot_product(qvec, dom.p), -1), 1) + 1) / 2 as semantic from qv, dom),
{_ROUTES},
chosen as (select * from rt where place = 1 or (place <= {domains.MAX_DOMAINS} and score >= {domains.RELATIVE_THRESHOLD} * best)),
dtok(ord, word) as (values {tokens_}),
fo as (select position, collection_id, vector, {objects}[1 + position % {len(OBJECTS)}] as term from f),
od as (select t.term, ord, least(1.0::double, count(*) / 2.0::double) as o from (select unnest({objects}) as term) t join dtok on word = t.term group by t.term, ord),
fd as (select position, collection_id, dom.ord, greatest((least(greatest(list_dot_product(vector, dom.p), -1), 1) + 1) / 2, coalesce(o, 0)) as ds
       from fo cross join dom left join od on od.term = fo.term and od.ord = dom.ord),
mem as (select * from fd qualify row_number() over (partition by position order by ds desc, ord) <= 2),
cols as (select unnest({parts}) as c),
pts as (select 0 as fallback, cols.c, mem.ord, mem.position from mem join cols on c = '*' or c = collection_id
        union all select 1, cols.c, -1, position from f join cols on c = '*' or c = collection_id),
asks as (select conv_id, turn, 0 as fallback, c, ord from chosen, cols where exists (select 1 from pts where pts.fallback = 0 and pts.c = cols.c and pts.ord = chosen.ord)
         union all select conv_id, turn, 1, c, -1 from good, cols where exists (select 1 from pts where pts.fallback = 1 and pts.c = cols.c)),
budget as (select *, case when fallback = 1 then {max(k // 3, 50)} else greatest({k} // greatest(count(*) filter (fallback = 0) over (partition by conv_id, turn), 1), 1) end as k from asks),
nn as (select b.conv_id, b.turn, b.k, pts.position,
              rank() over (partition by b.conv_id, b.turn, b.fallback, b.c, b.ord order by sqrt(list_sum(list_transform(list_zip(f.vector, qvec), lambda z: (z[1] - z[2]) ** 2)))) as r
       from budget b join pts using (fallback, c, ord) join f using (position) join qv on qv.conv_id = b.conv_id and qv.turn = b.turn),
cand as (select distinct conv_id, turn, position from nn where r <= k),
df as (select term, count(*) as df from fo group by term),
idf as (select term, (ln(((select count(*) from f) + 1.0::double) / (df + 1)) + 1) / max(ln(((select count(*) from f) + 1.0::double) / (df + 1)) + 1) over () as idf from df),
ex as (select conv_id, turn, unnest(string_split(v0, ' ')) as c from v union select conv_id, turn, unnest(string_split(term, ' ')) from am union select conv_id, turn, c from o),
want as (select conv_id, turn, term, max({_score_sql('c', 'term')}) as score from ex, idf where c <> '' group by all),
obj as (select cand.conv_id, cand.turn, cand.position, {SCORE} * idf * want.score as object_score
        from cand join fo using (position) join idf using (term) join want on want.conv_id = cand.conv_id and want.turn = cand.turn and want.term = fo.term where want.score >= {matching.MINIMUM}),
dsc as (select cand.conv_id, cand.turn, cand.position, max(ds * rt.score) as domain_score
        from cand join fd using (position) join rt on rt.conv_id = cand.conv_id and rt.turn = cand.turn and rt.ord = fd.ord group by all),
sc2 as (select cand.conv_id, cand.turn, cand.position, {CLIP} * ((least(greatest(list_dot_product(f.vector, qvec), -1), 1) + 1) / 2) + {OBJECT} * coalesce(object_score, 0) + {DOMAIN} * domain_score as total
        from cand join f using (position) join qv on qv.conv_id = cand.conv_id and qv.turn = cand.turn
        join dsc on dsc.conv_id = cand.conv_id and dsc.turn = cand.turn and dsc.position = cand.position
        left join obj on obj.conv_id = cand.conv_id and obj.turn = cand.turn and obj.position = cand.position),
top as (select *, row_number() over (partition by conv_id, turn order by total desc, position) as rank from sc2 qualify rank <= {TOP})
"""


@query(f"with {_search_sql(f'(select * from conversations where conv_id % {EVERY} = 0)', _QUERY)} select conv_id, turn, rank::int as rank, position, round(total, 6) as score from top")
def search_batch(spark, sf_dir):
    """Every fiftieth conversation's rows as queries, searched in one plan against all frames."""
    index, encoder = toy_index(spark, sf_dir)
    queries = asked(spark, sf_dir).filter(F.col("query_id.conv_id") % EVERY == 0)
    rows = batch.search_many(index, queries, encoder, top_k=TOP, fuzzy=False)
    return rows.select("query_id.conv_id", "query_id.turn", "rank", F.col("keyframe_number").cast("long").alias("position"), r6("score").alias("score"))


_VIETNAMESE, _TYPED = "Tìm người đi xe đạp", "nguowif ddi xe ddapj"
_IDS_SQL = "[" + ", ".join(f"'{i}'" for i, _, _ in DOMAINS) + "]"


def _one(q: str) -> str:
    return f"(select 0 as conv_id, 0 as turn, '{q}' as text)"


@query(f"""
with {_search_sql(_one(_VIETNAMESE), 'text', ('L21', 'L22'))}
select rank::int as rank, 'L' || (21 + position % 3) || '_V' || lpad((position % 5)::varchar, 3, '0') || '_' || printf('%06d', position) as keyframe_id,
       'L' || (21 + position % 3) as collection_id, position * 1000 as timestamp_ms, round(total, 6) as score from top
""")
def hybrid_search(spark, sf_dir):
    """The flagship: an index is built over the tables and searched by a Vietnamese query within two collections."""
    index, encoder = toy_index(spark, sf_dir)
    rows = search(index, _VIETNAMESE, encoder, collections=["L21", "L22"], top_k=TOP)
    return rows.select("rank", "keyframe_id", "collection_id", "timestamp_ms", r6("score").alias("score"))


@query(f"""
with {_search_sql(_one(_TYPED), 'text')}
select {_IDS_SQL}[ord + 1] as domain_id, place = 1 or (place <= {domains.MAX_DOMAINS} and score >= {domains.RELATIVE_THRESHOLD} * best) as selected,
       round(score, 6) as score, round(lexical, 6) as lexical_score from rt
""")
def inspect_route(spark, sf_dir):
    """How a query typed without accents is routed: each domain with its scores."""
    index, encoder = toy_index(spark, sf_dir)
    found = inspect(index, _TYPED, encoder, top_k=TOP)["routing"]["domains"]  # a row for each domain
    return spark.createDataFrame([(d["domain_id"], d["selected"], round(d["score"], 6), round(d["lexical_score"], 6)) for d in found], "domain_id string, selected boolean, score double, lexical_score double")
