"""Vectors, search and selection (D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import diversity, promote, rerank, rewrite, search
from ..params import Params
from ..plans import retrieve
from . import inputs as I
from .text import VARIANTS

QUERIES, ORACLES, register = I.registry()


@register(
    """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN [0.0, 0.0]::DOUBLE[] ELSE list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) END AS v FROM embeddings),
  n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s)
  SELECT vec_id, list_transform(v, lambda x: round(x / CASE WHEN n = 0 THEN 1e-12 ELSE n END, 9)) AS unit FROM n"""
)
def d1_l2_normalize(spark, sf_dir):
    v = F.when(F.col("vec_id") % 10 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return I.table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.l2_normalize(v), lambda x: F.round(x, 9)).alias("unit"))


@register(f"WITH texts AS (SELECT doc_id AS id, text FROM documents), {I.EMBED} SELECT id AS doc_id, b AS dim, round(x, 9) AS value FROM vec WHERE x <> 0")
def d2_embed(spark, sf_dir):
    rows = search.embed(I.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode("vector").alias("dim", "v")).where("v <> 0").select("doc_id", "dim", F.round("v", 9).alias("value"))


@register(f"WITH {I.QUESTIONS}, texts AS (SELECT query_id AS id, 'passage query: ' || query AS text FROM questions), {I.EMBED} SELECT id AS query_id, b AS dim, round(x, 9) AS value FROM vec WHERE x <> 0")
def d3_embed_queries(spark, sf_dir):
    rows = search.embed_queries(I.questions(spark, sf_dir), prefix="passage query: ")
    return rows.select("query_id", F.posexplode("vector").alias("dim", "v")).where("v <> 0").select("query_id", "dim", F.round("v", 9).alias("value"))


_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS INTEGER) AS rank"


@register(f"WITH {I.SCORES}, r AS (SELECT query_id, chunk_id, score, {_RANK} FROM scores) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10")
def d4_knn(spark, sf_dir):
    asked = I.vector_queries(spark, sf_dir).drop("scope")
    return search.knn(asked, I.vectors(spark, sf_dir), 10, not_self=True).select("query_id", "rank", "chunk_id", "score")


@register(f"WITH {I.SCORES}, r AS (SELECT query_id, chunk_id, score, {_RANK} FROM scores WHERE q % 60 <> 0 OR document_id IN ('1', '4')) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10")
def d5_scoped_knn(spark, sf_dir):
    return search.knn(I.vector_queries(spark, sf_dir), I.vectors(spark, sf_dir), 10, not_self=True).select("query_id", "rank", "chunk_id", "score")


_TEXT_SCORES = f"""q AS (SELECT id, b, x FROM (WITH texts AS (SELECT query_id AS id, passage AS text FROM questions), {I.EMBED} SELECT * FROM vec)),
  c AS (SELECT id, b, x FROM (WITH texts AS (SELECT chunk_id AS id, text FROM lines), {I.EMBED} SELECT * FROM vec)),
  s AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.x * c.x), 6) + 0.0 AS score FROM q JOIN c USING (b) GROUP BY ALL)"""


@register(
    f"""WITH {I.QUESTIONS}, {I.LINES}, {_TEXT_SCORES}, r AS (SELECT query_id, chunk_id, document_id, chunk_index, score, {_RANK} FROM s JOIN lines USING (chunk_id) WHERE score >= 0.3)
  SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 5"""
)
def passage_search(spark, sf_dir):
    """Every benchmark passage against every line, by hashed words, above a least score."""
    asked = I.questions(spark, sf_dir).select("query_id", F.col("passage").alias("query"))
    return search.knn(search.embed_queries(asked), I.embedded_lines(spark, sf_dir), 5).where("score >= 0.3").select("query_id", "rank", "chunk_id", "score")


@register(
    f"""WITH {I.SCORES}, r AS (SELECT query_id, q, chunk_id, document_id, chunk_index, score, {_RANK} FROM scores), v AS (SELECT CAST(q % 200 AS VARCHAR) AS query_id, * EXCLUDE (query_id, rank) FROM r WHERE rank <= 10),
  b AS (SELECT query_id, chunk_id, document_id, chunk_index, max(score) AS score FROM v GROUP BY ALL HAVING max(score) >= 0.25)
  SELECT query_id, {_RANK}, chunk_id, score FROM b"""
)
def d6_fuse_variants(spark, sf_dir):
    hits = search.knn(I.vector_queries(spark, sf_dir).drop("scope"), I.vectors(spark, sf_dir), 10, not_self=True)
    hits = hits.withColumn("query_id", (F.col("query_id").cast("long") % 200).cast("string"))
    return search.fuse_variants(hits, 0.25).select("query_id", "rank", "chunk_id", "score")


@register("SELECT item_id, CAST(CASE WHEN item_id % 30 > 0 THEN greatest(20, item_id % 30) ELSE 20 END AS INTEGER) AS pool_k FROM benchmark")
def d7_pool_size(spark, sf_dir):
    q = I.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 30 > 0, (F.col("item_id") % 30).cast("int")).alias("top_k"))
    return search.pool_size(q).select("item_id", "pool_k")


@register("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE vec_id % 11 = 0")
def d8_vectors_for(spark, sf_dir):
    rows = I.vectors(spark, sf_dir)
    ids = rows.where("chunk_index % 11 = 0").select("chunk_id").union(rows.where("chunk_index = 0").select(F.lit("nowhere")))
    return search.vectors_for(ids, rows).select("chunk_id", F.round(F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_PROBE = "CASE WHEN CAST(query_id AS BIGINT) % 5 = 0 THEN 'no such thing' ELSE string_split(lower(passage), ' ')[2] END"


@register(
    f"""WITH {I.QUESTIONS}, {I.LINES}, {_TEXT_SCORES}, k AS (SELECT query_id, {_PROBE} AS keyword FROM questions),
  e AS (SELECT q.query_id, chunk_id, coalesce(score, 0) AS score FROM (SELECT query_id FROM questions) q JOIN lines ON true LEFT JOIN s USING (query_id, chunk_id)),
  r AS (SELECT query_id, document_id, chunk_index, text, {_RANK} FROM e JOIN lines USING (chunk_id)),
  f AS (SELECT query_id, min(rank) AS first FROM r JOIN k USING (query_id) WHERE rank <= 200 AND contains(lower(text), lower(keyword)) GROUP BY 1),
  p AS (SELECT DISTINCT query_id FROM k JOIN lines ON contains(lower(text), lower(keyword)))
  SELECT query_id, CASE WHEN first IS NOT NULL THEN first WHEN query_id IN (SELECT query_id FROM p) THEN -1 END AS first_rank FROM k LEFT JOIN f USING (query_id)"""
)
def d9_dense_rank_of_keyword(spark, sf_dir):
    q = I.questions(spark, sf_dir)
    probe = F.when(F.col("query_id").cast("long") % 5 == 0, "no such thing").otherwise(F.split(F.lower("passage"), " ")[1])
    asked = search.embed_queries(q.select("query_id", F.col("passage").alias("query"), probe.alias("keyword")))
    return search.dense_rank_of_keyword(asked, I.stored_lines(spark, sf_dir), 200)


@register(
    f"""WITH {I.LINES}, t AS (SELECT DISTINCT string_split(text, ' ')[1] AS term FROM benchmark UNION SELECT 'No Such Thing')
  SELECT term, (SELECT count(*) FROM lines WHERE contains(lower(text), lower(term))) AS chunks FROM t"""
)
def d10_term_presence(spark, sf_dir):
    b = I.table(spark, sf_dir, "benchmark")
    terms = b.select(F.split("text", " ")[0].alias("term")).union(b.where("item_id = 0").select(F.lit("No Such Thing"))).distinct()
    return search.term_presence(I.lines(spark, sf_dir), terms)


_ASKED = "asked AS (SELECT query_id, arg_min(text, rank) AS query FROM hits GROUP BY query_id)"


def _asked(spark, sf_dir):
    """Each query of the hits asks with its first hit's text."""
    return I.hits(spark, sf_dir).groupBy("query_id").agg(F.min_by("text", "rank").alias("query"))


def _overlap(q: str, t: str) -> str:
    return f"CASE WHEN len(list_distinct({I.words(q)})) = 0 THEN 0.0 ELSE CAST(len(list_intersect(list_distinct({I.words(q)}), list_distinct({I.words(t)}))) AS DOUBLE) / len(list_distinct({I.words(q)})) END"


@register(
    f"""WITH {I.HITS}, {_ASKED}, s AS (SELECT query_id, rank AS old, chunk_id, {_overlap("query", "text")} AS score FROM hits JOIN asked USING (query_id))
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank, chunk_id, round(score, 9) AS score FROM s"""
)
def f1_rerank(spark, sf_dir):
    return rerank.rerank(I.hits(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@register(
    f"""WITH {I.HITS}, v AS (SELECT query_id, text AS variant FROM hits WHERE rank IN (1, 2)), s AS (SELECT query_id, rank AS old, chunk_id, max({_overlap("variant", "text")}) AS score FROM hits JOIN v USING (query_id) GROUP BY ALL)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank, chunk_id, round(score, 9) AS score FROM s"""
)
def f2_rerank_over_variants(spark, sf_dir):
    hits = I.hits(spark, sf_dir)
    variants = hits.where("rank in (1, 2)").select("query_id", F.col("text").alias("variant"))
    return rerank.rerank_over_variants(hits, variants).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


@register(
    f"""WITH {I.HITS}, m AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM hits GROUP BY 1)
  SELECT query_id, rank, round(CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 9) AS relevance FROM hits JOIN m USING (query_id)"""
)
def f3_minmax_relevance(spark, sf_dir):
    return diversity.minmax_relevance(I.hits(spark, sf_dir)).select("query_id", "rank", F.round("relevance", 9).alias("relevance"))


_POOL = f"pool AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(v AS DOUBLE[]) AS v, {_RANK} FROM scores) WHERE rank <= 12)"


@register(
    f"""WITH RECURSIVE {I.SCORES}, {_POOL}, m AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM pool GROUP BY 1),
  p AS (SELECT query_id, rank, chunk_id, v, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel FROM pool JOIN m USING (query_id)),
  sim AS (SELECT a.query_id, a.rank AS x, b.rank AS y, round(list_inner_product(a.v, b.v), 9) AS s FROM p a JOIN p b USING (query_id)),
  step(query_id, n, sel, pick) AS (
    SELECT query_id, 0, []::INTEGER[], NULL::INTEGER FROM m
    UNION ALL
    SELECT query_id, n + 1, list_append(sel, x), x FROM (
      SELECT t.query_id, t.n, t.sel, p.rank AS x, row_number() OVER (PARTITION BY t.query_id ORDER BY 0.6 * p.rel - 0.4 * coalesce(max(sim.s), 0.0) DESC, p.rank) AS best
      FROM step t JOIN p ON p.query_id = t.query_id AND NOT list_contains(t.sel, p.rank)
      LEFT JOIN sim ON sim.query_id = t.query_id AND sim.x = p.rank AND list_contains(t.sel, sim.y)
      WHERE t.n < 4 GROUP BY t.query_id, t.n, t.sel, p.rank, p.rel HAVING coalesce(max(sim.s), 0.0) < 0.35) WHERE best = 1)
  SELECT step.query_id, CAST(n AS INTEGER) AS rank, chunk_id FROM step JOIN p ON p.query_id = step.query_id AND p.rank = step.pick WHERE n > 0"""
)
def f4_mmr_select(spark, sf_dir):
    """Diverse four of the best twelve, with a cap on similarity (F5)."""
    pool = search.knn(I.vector_queries(spark, sf_dir).drop("scope"), I.vectors(spark, sf_dir), 12, keep=("vector",), not_self=True)
    return diversity.mmr_select(pool, 4, 0.6, 0.35).select("query_id", "rank", "chunk_id")


@register(f"WITH {I.SCORES}, {_POOL} SELECT query_id, rank, chunk_id FROM pool WHERE rank <= 4")
def f6_missing_vector_fallback(spark, sf_dir):
    """A pool in which one vector is missing keeps its order."""
    pool = search.knn(I.vector_queries(spark, sf_dir).drop("scope"), I.vectors(spark, sf_dir), 12, keep=("vector",), not_self=True)
    return diversity.mmr_select(pool.withColumn("vector", F.when(F.col("rank") != 9, F.col("vector"))), 4).select("query_id", "rank", "chunk_id")


#: Texts go one by one behind those kept; {kept, x}: ranks and words of the kept ones, the next one
def _deduped(hits: str, keys: str = "query_id") -> str:
    """uniq(keys, rank): the hits that dedupe_by_text keeps."""
    row = "STRUCT(rank INTEGER, w VARCHAR[], bag VARCHAR[])"
    near = "len(y.bag) > 0 AND len(x.x.bag) > 0 AND CAST(len(list_intersect(y.bag, x.x.bag)) AS DOUBLE) / (len(y.bag) + len(x.x.bag) - len(list_intersect(y.bag, x.x.bag))) >= 0.85"
    return f"""forms AS (SELECT {keys}, CAST(rank AS INTEGER) AS rank, {I.words("text")} AS form FROM {hits}),
  ordered AS (SELECT {keys}, list({{'rank': rank, 'w': form, 'bag': list_distinct(form)}} ORDER BY rank) AS l FROM forms GROUP BY ALL),
  uniq AS (SELECT {keys}, unnest(list_reduce(list_transform(l, lambda r: {{'kept': []::{row}[], 'x': r}}), lambda a, x: {{
      'kept': CASE WHEN len(list_filter(a.kept, lambda y: y.w = x.x.w OR ({near}))) > 0 THEN a.kept ELSE list_append(a.kept, x.x) END, 'x': x.x}},
    {{'kept': []::{row}[], 'x': CAST(NULL AS {row})}}).kept).rank AS rank FROM ordered)"""


@register(f"WITH {I.HITS}, {_deduped('hits')}, n AS (SELECT query_id, rank AS old, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM uniq) SELECT query_id, n.rank, chunk_id FROM n JOIN hits USING (query_id) WHERE hits.rank = n.old")
def f7_dedupe_by_text(spark, sf_dir):
    return diversity.dedupe_by_text(I.hits(spark, sf_dir)).select("query_id", "rank", "chunk_id")


@register(
    f"""WITH {I.HITS}, q AS (SELECT query_id, 'ab1.c and ' || lower(string_split(arg_max(text, rank), ' ')[1]) AS word FROM hits GROUP BY 1),
  named AS (SELECT query_id, rank, chunk_id, contains(lower(text || CASE WHEN rank % 5 = 4 THEN ' x9.large' ELSE '' END), 'x9.large') AS m FROM hits),
  lead AS (SELECT query_id, min(rank) FILTER (WHERE m) AS first, bool_or(m) FILTER (WHERE rank <= 3) AS settled FROM named GROUP BY 1),
  o AS (SELECT n.query_id, chunk_id, CASE WHEN NOT coalesce(settled, false) AND first IS NOT NULL THEN CASE WHEN rank = first THEN 1 ELSE rank + 1 END ELSE rank END AS rank, rank AS old, first, settled FROM named n JOIN lead USING (query_id) JOIN q USING (query_id))
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM o WHERE rank <= 3 AND (old <= 3 OR (old = first AND NOT coalesce(settled, false)))"""
)
def f10_promote_hits(spark, sf_dir):
    hits = I.hits(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("rank") % 5 == 4, " x9.large").otherwise("")))
    queries = hits.select("query_id").distinct().withColumn("query", F.lit("how large is x9.large"))
    return promote.promote_hits(hits, hits, queries, 3).select("query_id", "rank", "chunk_id")


@register(
    f"""WITH {I.HITS}, h AS (SELECT query_id, max(score - 0.4 * (CAST(query_id AS BIGINT) % 4)) AS best FROM hits GROUP BY 1), q AS (SELECT query_id FROM h UNION ALL SELECT 'nothing')
  SELECT query_id, best IS NULL OR best < 0 AS refuse, round(best, 9) AS best FROM q LEFT JOIN h USING (query_id)"""
)
def f11_retrieval_gate(spark, sf_dir):
    hits = I.hits(spark, sf_dir).withColumn("score", F.col("score") - 0.4 * (F.col("query_id").cast("long") % 4))
    queries = hits.select("query_id").distinct()
    queries = queries.union(queries.where("query_id = '0'").select(F.lit("nothing")))
    return promote.retrieval_gate(hits, queries).select("query_id", "refuse", F.round("best", 9).alias("best"))


#: The lines as normalised hashed words
_LINE_VECTORS = f"""vc AS (WITH texts AS (SELECT chunk_id AS id, text FROM lines), {I.EMBED} SELECT id, b, x FROM vec),
  dense AS (SELECT id AS chunk_id, list(coalesce(x, 0.0) ORDER BY b) AS v FROM (SELECT DISTINCT id FROM vc) CROSS JOIN (SELECT CAST(range AS INTEGER) AS b FROM range(64)) LEFT JOIN vc USING (id, b) GROUP BY id)"""


def pooled(name: str = "pool", variants: str = "variants") -> str:
    """name(query_id, rank, chunk_id, document_id, chunk_index, text, score): the fused candidates of the variants, not reranked."""
    p = f"{name}_"
    return f"""{p}q AS (WITH texts AS (SELECT query_id || '#' || variant_no AS id, variant AS text FROM {variants}), {I.EMBED} SELECT id, b, x FROM vec),
  {p}s AS (SELECT q.id, c.id AS chunk_id, round(sum(q.x * c.x), 6) + 0.0 AS score FROM {p}q q JOIN vc c USING (b) GROUP BY ALL HAVING round(sum(q.x * c.x), 6) >= 0.3),
  {p}r AS (SELECT id, chunk_id, document_id, chunk_index, text, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, document_id, chunk_index) AS n FROM {p}s JOIN lines USING (chunk_id)),
  {p}f AS (SELECT split_part(id, '#', 1) AS query_id, chunk_id, document_id, chunk_index, text, max(score) AS score FROM {p}r WHERE n <= 20 GROUP BY ALL),
  {name} AS (SELECT query_id, {_RANK}, chunk_id, document_id, chunk_index, text, score FROM {p}f)"""


def reranked(name: str, pool: str, variants: str, variant: str = "variant") -> str:
    """name: the pool by the best share of a variant's words that a text has."""
    best = f"SELECT query_id, rank AS old, chunk_id, document_id, chunk_index, text, max({_overlap(variant, 'text')}) AS score FROM {pool} JOIN {variants} USING (query_id) GROUP BY ALL"
    return f"{name} AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank, chunk_id, document_id, chunk_index, text, score FROM ({best}))"


def selected(name: str, pool: str, control: str) -> str:
    """name(query_id, w, cap, k, rank, chunk_id, text, score): k diverse hits for each row of control(query_id, k, w, cap). Needs WITH RECURSIVE."""
    p = f"{name}_"
    return f"""{p}rel AS (SELECT query_id, rank, CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS rel FROM {pool} JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM {pool} GROUP BY 1) USING (query_id)),
  {p}sim AS (SELECT a.query_id, a.rank AS x, b.rank AS y, round(list_inner_product(u.v, t.v), 9) AS s FROM {pool} a JOIN {pool} b USING (query_id) JOIN dense u ON u.chunk_id = a.chunk_id JOIN dense t ON t.chunk_id = b.chunk_id),
  {p}step(query_id, w, cap, k, n, sel, pick) AS (
    SELECT query_id, w, cap, k, 0, []::INTEGER[], NULL::INTEGER FROM {control}
    UNION ALL
    SELECT query_id, w, cap, k, n + 1, list_append(sel, x), x FROM (
      SELECT t.query_id, t.w, t.cap, t.k, t.n, t.sel, r.rank AS x, row_number() OVER (PARTITION BY t.query_id, t.w, t.cap ORDER BY t.w * r.rel - (1 - t.w) * coalesce(max(s.s), 0.0) DESC, r.rank) AS best
      FROM {p}step t JOIN {p}rel r ON r.query_id = t.query_id AND NOT list_contains(t.sel, r.rank)
      LEFT JOIN {p}sim s ON s.query_id = t.query_id AND s.x = r.rank AND list_contains(t.sel, s.y)
      WHERE t.n < t.k GROUP BY t.query_id, t.w, t.cap, t.k, t.n, t.sel, r.rank, r.rel HAVING coalesce(max(s.s), 0.0) < t.cap) WHERE best = 1),
  {name} AS (SELECT t.query_id, w, cap, k, CAST(n AS INTEGER) AS rank, chunk_id, document_id, chunk_index, text, score FROM {p}step t JOIN {pool} p ON p.query_id = t.query_id AND p.rank = t.pick WHERE n > 0)"""


_KEYS = "query_id, w, cap"
#: final(query_id, w, cap, rank, chunk_id, ...): the selected hits without repeats of text, and a match of the query's kind in front
FINAL = rf"""{_deduped("picked", _KEYS)},
  once AS (SELECT {_KEYS}, k, CAST(row_number() OVER (PARTITION BY {_KEYS} ORDER BY picked.rank) AS INTEGER) AS rank, chunk_id FROM uniq JOIN picked USING ({_KEYS}, rank)),
  kinds AS (SELECT query_id, regexp_extract_all(lower(query), '(?:^|[^\p{{L}}\p{{N}}_])([a-z]\d+[a-z]?\.[a-z][a-z0-9]*)', 1) AS ids, regexp_matches(query, 'memory[- ]?(?:intensive|optimized)|(?:large|high)\s+(?:memory|ram)', 'i') AS family FROM questions),
  fits AS (SELECT query_id, chunk_id, rank FROM pool JOIN kinds USING (query_id) WHERE len(list_filter(ids, lambda i: contains(lower(text), i))) > 0
    OR (family AND contains(lower(text), 'memory optimized') AND contains(lower(text), 'designed') AND (contains(lower(text), 'workload') OR contains(lower(text), 'data sets in memory')))),
  settled AS (SELECT DISTINCT {_KEYS} FROM once JOIN fits USING (query_id, chunk_id) WHERE once.rank <= k),
  lead AS (SELECT {_KEYS}, k, arg_min(chunk_id, rank) AS first FROM control JOIN fits USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM settled s WHERE s.query_id = control.query_id AND s.w = control.w AND s.cap = control.cap) GROUP BY ALL),
  moved AS (SELECT {_KEYS}, once.k, CASE WHEN first IS NULL THEN rank ELSE rank + 1 END AS rank, chunk_id FROM once LEFT JOIN lead USING ({_KEYS}) WHERE rank <= once.k AND (first IS NULL OR chunk_id <> first)),
  final AS (SELECT {_KEYS}, CAST(m.rank AS INTEGER) AS rank, chunk_id, document_id, chunk_index, text, score FROM (SELECT {_KEYS}, rank, chunk_id FROM moved WHERE rank <= k UNION ALL SELECT {_KEYS}, 1, first FROM lead) m
    JOIN (SELECT query_id, chunk_id, document_id, chunk_index, text, score FROM pool) USING (query_id, chunk_id))"""
_RETRIEVAL = f"{I.QUESTIONS}, {I.LINES}, {VARIANTS}, {_LINE_VECTORS}, {pooled('fused')}, {reranked('pool', 'fused', 'variants')}"
_ONE = "control AS (SELECT query_id, 3 AS k, CAST(0.6 AS DOUBLE) AS w, CAST(0.85 AS DOUBLE) AS cap FROM questions)"


@register(f"WITH RECURSIVE {_RETRIEVAL}, {_ONE}, {selected('picked', 'pool', 'control')}, {FINAL} SELECT query_id, rank, chunk_id, document_id, chunk_index, round(score, 6) AS score FROM final")
def f12_retrieve(spark, sf_dir):
    """The whole retrieval of the benchmark questions over all lines."""
    found = retrieve.retrieve(I.questions(spark, sf_dir).select("query_id", "query"), I.stored_lines(spark, sf_dir), Params(min_score=0.3))
    return found.select("query_id", "rank", "chunk_id", "document_id", "chunk_index", F.round("score", 6).alias("score"))


@register(f"WITH {_RETRIEVAL} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM pool")
def multi_query_pool(spark, sf_dir):
    """Fused candidate pools over rewritten queries (E7, D6, F2)."""
    asked = rewrite.rewrite_queries(I.questions(spark, sf_dir).select("query_id", "query")).select("query_id", "variant")
    pool = retrieve.pool(I.questions(spark, sf_dir).select("query_id", "query"), I.stored_lines(spark, sf_dir), Params(min_score=0.3, rerank=False))
    return rerank.rerank_over_variants(pool, asked).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))
