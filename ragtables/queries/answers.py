"""Contexts, citations, prompts, answers (G) and their validation (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..operators import context, promote, validate
from ..params import DISCLAIMER, INTRO, REFUSAL, SYSTEM, VALIDATION_STOPWORDS
from ..plans import answer
from . import inputs as I

QUERIES, ORACLES, register = I.registry()
_q = lambda s: "'" + s.replace("'", "''") + "'"
_GROUPED = """grouped AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY lead) AS doc_rank, row_number() OVER (PARTITION BY query_id, document_id ORDER BY coalesce(page, 0), chunk_index, rank) AS pos,
  row_number() OVER (PARTITION BY query_id ORDER BY lead, coalesce(page, 0), chunk_index, rank) AS marker FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, document_id) AS lead FROM hits))"""


@register(f"WITH {I.HITS}, {_GROUPED} SELECT query_id, rank, CAST(doc_rank AS INTEGER) AS doc_rank, CAST(pos AS INTEGER) AS pos, CAST(marker AS INTEGER) AS marker FROM grouped")
def g1_group_hits(spark, sf_dir):
    return context.group_hits(I.hits(spark, sf_dir)).select("query_id", "rank", "doc_rank", "pos", "marker")


#: shown(query_id, ..., marker, shown): the text without what the hit before it in the same document already gave
_SHOWN = rf"""before AS (SELECT *, lag(text) OVER w AS prev, lag(chunk_index) OVER w AS prev_index FROM grouped WINDOW w AS (PARTITION BY query_id, document_id ORDER BY pos)),
  cut AS (SELECT *, {I.sentences("prev")}[-5:] AS last, {I.sentences("text")} AS mine FROM before),
  fresh AS (SELECT *, {I.strip("array_to_string(list_filter(mine, lambda s, i: len(list_filter(mine[:i], lambda t: NOT list_contains(last, t))) > 0), ' ')")} AS rest FROM cut),
  started AS (SELECT *, {I.strip("prev")} AS p, CASE WHEN chunk_index = prev_index + 1 AND len(last) > 0 AND len(mine) > 0 AND rest <> '' THEN rest ELSE text END AS start FROM fresh),
  ends AS (SELECT *, {I.strip("start")} AS c FROM started),
  twice AS (SELECT *, CASE WHEN length(c) >= 40 AND contains(p, left(c, 40)) THEN list_max(list_filter(range(40, least(600, length(p), length(c)) + 1), lambda n: right(p, n) = left(c, n))) END AS n FROM ends),
  shown AS (SELECT *, CASE WHEN prev IS NULL THEN text WHEN {I.ws("prev")} = {I.ws("text")} THEN ''
    WHEN n IS NULL OR regexp_replace(substring(c, CAST(n AS INTEGER) + 1), '^[{I.SPACES}]+', '') = '' THEN start ELSE regexp_replace(substring(c, CAST(n AS INTEGER) + 1), '^[{I.SPACES}]+', '') END AS shown FROM twice)"""
_CONTEXT = rf"""lines_of AS (SELECT *, '[' || marker || '] (' || CASE WHEN page IS NOT NULL THEN 'p.' || page ELSE 'chunk ' || chunk_index END || ')' || chr(10)
    || CASE WHEN {I.strip("shown")} = '' THEN '(See preceding passage [' || (marker - 1) || '] for full text.)' ELSE shown END AS line FROM shown),
  blocks AS (SELECT query_id, doc_rank, '### Source: ' || arg_min(filename, marker) || chr(10) || string_agg(line, chr(10) ORDER BY marker) AS block FROM lines_of GROUP BY ALL),
  contexts AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY doc_rank) AS context FROM blocks GROUP BY query_id)"""


@register(f"WITH {I.HITS}, {_GROUPED}, {_SHOWN} SELECT query_id, CAST(marker AS INTEGER) AS marker, shown FROM shown")
def g2_trim_overlap(spark, sf_dir):
    return context.trim_overlap(context.group_hits(I.hits(spark, sf_dir))).select("query_id", "marker", "shown")


@register(f"WITH {I.HITS}, {_GROUPED}, {_SHOWN}, {_CONTEXT} SELECT query_id, context FROM contexts")
def g3_grouped_context(spark, sf_dir):
    return context.build_grouped_context(I.hits(spark, sf_dir))


_FLAT = "string_agg('[' || rank || '] (source: ' || filename || coalesce(', p.' || page, '') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"


@register(f"WITH {I.HITS} SELECT query_id, {_FLAT} AS context FROM hits GROUP BY query_id")
def g4_flat_context(spark, sf_dir):
    return context.build_flat_context(I.hits(spark, sf_dir))


@register(f"WITH {I.HITS} SELECT query_id, rank AS marker, document_id, filename, chunk_id, round(score, 4) AS score, substring(text, 1, 280) || CASE WHEN length(text) > 280 THEN '…' ELSE '' END AS snippet, text AS chunk_text FROM hits")
def g5_citations(spark, sf_dir):
    return context.citations(I.hits(spark, sf_dir))


_PROMPTS = f"""prompts AS (SELECT query_id, 'CONTEXT:' || chr(10) || {_FLAT} || chr(10) || chr(10) || 'QUESTION: ' || 'What of ' || query_id || '?' || chr(10) || chr(10) || 'Answer with inline [n] citations.' AS prompt FROM hits GROUP BY query_id)"""


def _prompts(spark, sf_dir):
    flat = context.build_flat_context(I.hits(spark, sf_dir)).withColumn("query", F.concat(F.lit("What of "), "query_id", F.lit("?")))
    return context.build_prompt(flat)


@register(f"WITH {I.HITS}, {_PROMPTS} SELECT query_id, prompt FROM prompts")
def g6_build_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir).select("query_id", "prompt")


@register(
    f"""WITH {I.HITS}, {_PROMPTS}, turns AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
  m AS (SELECT query_id, -1 AS n, 'system' AS role, {_q(SYSTEM)} AS content FROM prompts UNION ALL SELECT query_id, turn, role, text FROM turns JOIN prompts USING (query_id) UNION ALL SELECT query_id, 1000000, 'user', prompt FROM prompts)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INTEGER) AS position, role, content FROM m"""
)
def g7_build_messages(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    history = turns.groupBy(F.col("conv_id").cast("string").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("history"))
    rows = context.build_messages(_prompts(spark, sf_dir), history)
    return rows.select("query_id", F.posexplode("messages").alias("position", "m")).select("query_id", "position", "m.role", "m.content")


_INNER = I.strip("split_part(substring(prompt, 9), 'QUESTION:', 1)")


@register(f"WITH {I.HITS}, {_PROMPTS} SELECT query_id, {_q(INTRO)} || {_INNER} AS answer FROM prompts")
def g8_extractive_answer(spark, sf_dir):
    return context.extractive_answer(_prompts(spark, sf_dir))


_FAILED = f"'The ''openai'' provider was unavailable, and the local fallback also failed or was not reachable. Here are the most relevant passages from your documents (cited below):' || chr(10) || chr(10) || {_INNER}"


@register(
    f"""WITH {I.HITS}, {_PROMPTS} SELECT query_id, CASE CAST(query_id AS BIGINT) % 3 WHEN 0 THEN 'remote ' || query_id WHEN 1 THEN 'local ' || query_id ELSE {_FAILED} END AS answer,
  CASE CAST(query_id AS BIGINT) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'extractive' END AS provider FROM prompts"""
)
def g9_select_answer(spark, sf_dir):
    prompts = _prompts(spark, sf_dir).withColumn("primary", F.lit("openai"))
    n = F.col("query_id").cast("long") % 3
    remote = prompts.select("query_id", F.lit("openai").alias("provider"), F.when(n == 0, F.concat(F.lit("remote "), "query_id")).alias("answer"))
    local = prompts.where(n < 2).select("query_id", F.lit("ollama").alias("provider"), F.concat(F.lit("local "), "query_id").alias("answer"))
    return context.select_answer(prompts, remote.unionByName(local))


_GROUPS = r"""marked AS (SELECT query_id, regexp_extract_all(answer, '(?s)(.+?)\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]', 1) AS c, regexp_extract_all(answer, '(?s)(.+?)\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]', 2) AS m FROM answers),
  grp AS (SELECT query_id, generate_subscripts(c, 1) AS g, string_split(unnest(c), chr(10))[-1] AS claim, list_transform(string_split(unnest(m), ','), lambda x: CAST(trim(x) AS INTEGER)) AS markers FROM marked)"""


_ALL = "answers AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, replace(replace(text, '. ', ' [1]. '), ', ', ' [2, 90] ') AS answer FROM documents)"


@register(f"WITH {_ALL}, {_GROUPS} SELECT query_id, CAST(g - 1 AS INTEGER) AS position, claim, array_to_string(markers, ',') AS markers FROM grp")
def h1_citation_groups(spark, sf_dir):
    marked = F.replace(F.replace("text", F.lit(". "), F.lit(" [1]. ")), F.lit(", "), F.lit(" [2, 90] "))
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), marked.alias("answer"))
    rows = docs.select("query_id", F.posexplode(C.citation_groups(F.col("answer"))).alias("position", "g"))
    return rows.select("query_id", "position", "g.claim", F.array_join(F.transform("g.markers", lambda m: m.cast("string")), ",").alias("markers"))


def _tokens(x: str, stop) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(map(_q, stop))}], t)))"


@register(f"SELECT doc_id, array_to_string(list_sort({_tokens('text', VALIDATION_STOPWORDS)}), ' ') AS tokens FROM documents")
def h2_claim_tokens(spark, sf_dir):
    tokens = C.claim_tokens(F.col("text"), VALIDATION_STOPWORDS)
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tokens), " ").alias("tokens"))


def supported(stop) -> str:
    """grp of answers against hits: g, ok per group, and per answer the hits' number."""
    return f"""cnt AS (SELECT query_id, count(*) AS hits FROM hits GROUP BY 1),
  tok AS (SELECT query_id, g, {_tokens("claim", stop)} AS tokens, markers FROM grp),
  cited AS (SELECT DISTINCT query_id, g, unnest(markers) AS m FROM tok),
  back AS (SELECT c.query_id, c.g, bool_or(len(tokens) = 0 OR len(list_filter(tokens, lambda t: contains(lower(h.text), t))) / CAST(len(tokens) AS DOUBLE) >= 0.25) AS ok FROM cited c JOIN tok USING (query_id, g) JOIN hits h ON h.query_id = c.query_id AND h.rank = c.m GROUP BY ALL),
  sup AS (SELECT t.query_id, count(*) AS n, count_if(coalesce(ok, false)) AS backed FROM tok t LEFT JOIN back b ON b.query_id = t.query_id AND b.g = t.g GROUP BY 1),
  bad AS (SELECT query_id, list(m ORDER BY m) AS invalid FROM (SELECT DISTINCT query_id, m FROM (SELECT query_id, unnest(markers) AS m FROM tok) LEFT JOIN cnt USING (query_id) WHERE m < 1 OR m > coalesce(hits, 0)) GROUP BY 1)"""


_WORDS = rf"CASE WHEN {I.strip('answer')} = '' THEN 0 ELSE len(regexp_split_to_array({I.strip('answer')}, '[{I.SPACES}]+')) END"
_VERDICT = rf"""v AS (SELECT a.query_id, answer, n, coalesce(hits, 0) AS hits, coalesce(invalid, []) AS invalid, n IS NULL AND coalesce(hits, 0) > 0 AND {_WORDS} > 12 AS claims,
    CASE WHEN n IS NULL THEN 1.0 ELSE backed / CAST(n AS DOUBLE) END AS share FROM answers a LEFT JOIN sup USING (query_id) LEFT JOIN cnt USING (query_id) LEFT JOIN bad USING (query_id)),
  checked AS (SELECT query_id, answer, CASE WHEN claims THEN 0.0 ELSE share END AS support, NOT claims AND len(invalid) = 0 AND share >= 0.5 AS passed, array_to_string(invalid, ',') AS invalid,
    array_to_string(list_filter([CASE WHEN claims THEN 'Answer makes claims but contains no [n] citations.' END,
      CASE WHEN len(invalid) > 0 THEN 'Answer cites passages that do not exist: [' || array_to_string(invalid, ', ') || '].' END,
      CASE WHEN n IS NOT NULL AND share < 0.5 THEN 'Only ' || CAST(CAST(round_even(share * 100, 0) AS INTEGER) AS VARCHAR) || '% of citations are supported by their sources.' END], lambda x: x IS NOT NULL), ' / ') AS notes FROM v)"""
_CHECK = f"WITH {I.HITS}, {I.ANSWERS}, {_GROUPS}, {supported(VALIDATION_STOPWORDS)}, {_VERDICT}"


def _checked(spark, sf_dir):
    return validate.validate_answers(I.answers(spark, sf_dir), I.hits(spark, sf_dir))


@register(f"{_CHECK} SELECT query_id, round(support, 9) AS support, passed, invalid, notes FROM checked")
def h3_validate_answers(spark, sf_dir):
    """Support of citations, answers without any (H4), and notes (H5)."""
    marks = F.array_join(F.transform(F.array_sort(F.array_distinct("invalid_markers")), lambda m: m.cast("string")), ",")
    return _checked(spark, sf_dir).select("query_id", F.round("support", 9).alias("support"), "passed", marks.alias("invalid"), F.array_join("notes", " / ").alias("notes"))


_DISC = _q(DISCLAIMER.strip("\n"))


@register(f"{_CHECK} SELECT query_id, answer || CASE WHEN passed THEN '' ELSE chr(10) || chr(10) || {_DISC} END AS answer, passed AS grounded FROM checked")
def h6_apply_validation(spark, sf_dir):
    return validate.apply_validation(_checked(spark, sf_dir)).select("query_id", "answer", "grounded")


_N = "CAST(query_id AS BIGINT) % 5"


@register(
    f"""{_CHECK} SELECT query_id, CASE WHEN {_N} = 0 THEN {_q(REFUSAL)} WHEN {_N} = 1 THEN {_q(REFUSAL)} WHEN passed THEN answer ELSE answer || chr(10) || chr(10) || {_DISC} END AS answer,
  CASE WHEN {_N} = 0 THEN 'none' ELSE 'openai' END AS provider, CASE WHEN {_N} = 0 THEN false WHEN {_N} = 1 THEN true ELSE passed END AS grounded FROM checked"""
)
def g10_assemble_results(spark, sf_dir):
    """A fifth of the queries is refused by the gate, a fifth by the answer itself."""
    n = F.col("query_id").cast("long") % 5
    raw = I.answers(spark, sf_dir)
    answers = raw.withColumns({"answer": F.when(n == 1, REFUSAL).otherwise(F.col("answer")), "provider": F.lit("openai")})
    hits = I.hits(spark, sf_dir)
    gate = promote.retrieval_gate(hits.where(n != 0), raw.select("query_id"))
    return context.assemble_results(gate, answers, validate.apply_validation(validate.validate_answers(answers, hits)))


_BATCH = f"""WITH {I.HITS}, {_GROUPED}, {_SHOWN}, {_CONTEXT}, asked AS (SELECT query_id, arg_min(text, rank) AS query FROM hits GROUP BY 1),
  prompts AS (SELECT query_id, 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || query || chr(10) || chr(10) || 'Answer with inline [n] citations.' AS prompt FROM contexts JOIN asked USING (query_id)),
  answers AS (SELECT query_id, {_q(INTRO)} || {_INNER} AS answer FROM prompts), {_GROUPS},
  byno AS (SELECT query_id, marker AS rank, text FROM grouped), {supported(VALIDATION_STOPWORDS).replace("JOIN hits h", "JOIN byno h")}, {_VERDICT}"""


@register(f"{_BATCH} SELECT query_id, answer || CASE WHEN passed THEN '' ELSE chr(10) || chr(10) || {_DISC} END AS answer, 'extractive' AS provider, passed AS grounded FROM checked")
def batch_answers(spark, sf_dir):
    """Whole answer jobs over the hits, without any completion."""
    hits = I.hits(spark, sf_dir)
    queries = hits.groupBy("query_id").agg(F.min_by("text", "rank").alias("query"))
    none = queries.select("query_id", F.lit("openai").alias("provider"), F.lit(None).cast("string").alias("answer"))
    return answer.answer(queries, hits, none)
