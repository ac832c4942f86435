"""Evaluation (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, search
from ..params import METRIC_STOPWORDS, REFUSAL, Params
from ..plans import evaluation, retrieve
from ..sources import files
from ..sources.tables import shared_folder
from . import answers as A
from . import inputs as I
from . import search as S
from . import text as T

QUERIES, ORACLES, register = I.registry()
_R = A._q(REFUSAL)


def _cases(spark, sf_dir):
    """A case per three documents: keywords of their texts, some to refuse, some with a source."""
    d, n, w = I.trios(spark, sf_dir), F.col("n"), F.split("text", " ")
    none = F.array().cast("array<string>")
    return d.select(
        n.cast("string").alias("id"), F.element_at(w, 1).alias("query"),
        F.when(n % 4 == 3, none).otherwise(F.array(F.lower(F.get(w, F.lit(0))), F.concat(F.get(w, F.lit(0)), F.lit("zzz")), F.get(F.reverse(w), F.lit(0)))).alias("relevant_keywords"),
        F.when(n % 3 == 2, none).otherwise(F.array(F.get(w, F.lit(0)), F.lit("the"))).alias("expected_answer_keywords"),
        F.array(F.lit("qqqq"), F.get(w, F.lit(0))).alias("forbidden_answer_keywords"),
        (n % 5 == 0).alias("should_refuse"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("doc"), F.when(n % 4 == 0, 3 * n + 1).otherwise(F.lit(-1)), F.lit(".txt")))).otherwise(none).alias("expected_source_filenames"),
    )


_CASES = """cases AS (SELECT CAST(n AS VARCHAR) AS id, CASE WHEN n % 4 = 3 THEN [] ELSE [lower(w[1]), w[1] || 'zzz', w[-1]] END AS relevant_keywords, CASE WHEN n % 3 = 2 THEN [] ELSE [w[1], 'the'] END AS expected_answer_keywords,
  ['qqqq', w[1]] AS forbidden_answer_keywords, n % 5 = 0 AS should_refuse, CASE WHEN n % 2 = 0 THEN ['doc' || CASE WHEN n % 4 = 0 THEN 3 * n + 1 ELSE -1 END || '.txt'] ELSE [] END AS expected_source_filenames
  FROM (SELECT n, string_split(text, ' ') AS w FROM trios))"""


def _answers(spark, sf_dir):
    return I.answers(spark, sf_dir).withColumn("answer", F.when(F.col("query_id").cast("long") % 10 == 0, REFUSAL).otherwise(F.col("answer")))


_ANSWERS = I.ANSWERS.replace("answers AS", "plain AS", 1) + f", answers AS (SELECT query_id, CASE WHEN CAST(query_id AS BIGINT) % 10 = 0 THEN {_R} ELSE answer END AS answer FROM plain)"
_METRICS = rf"""{I.HITS}, {_ANSWERS}, {_CASES}, {A._GROUPS}, {A.supported(METRIC_STOPWORDS)},
  got AS (SELECT query_id, list(text ORDER BY rank) AS t, list(DISTINCT filename) AS f, string_agg(text, chr(10) ORDER BY rank) AS ctx FROM hits GROUP BY 1),
  base AS (SELECT c.*, a.answer, a.answer = {_R} AS refused, g.t, g.f, g.ctx, list_filter(g.t, lambda x: len(list_filter(c.relevant_keywords, lambda k: contains(lower(x), lower(k)))) > 0) AS rel,
    regexp_replace(a.answer, '\[\s*\d+(?:\s*,\s*\d+)*\s*\]', ' ', 'g') AS bare, s.n, s.backed FROM cases c JOIN answers a ON a.query_id = c.id JOIN got g ON g.query_id = c.id LEFT JOIN sup s ON s.query_id = c.id),
  metrics AS (SELECT id AS case_id, len(rel) / CAST(len(t) AS DOUBLE) AS precision_at_k,
    CASE WHEN len(relevant_keywords) = 0 THEN CAST(should_refuse AS DOUBLE) ELSE len(list_filter(relevant_keywords, lambda k: contains(lower(ctx), lower(k)))) / CAST(len(relevant_keywords) AS DOUBLE) END AS recall_at_k,
    CASE WHEN should_refuse THEN NOT refused WHEN refused THEN false ELSE len(list_filter(forbidden_answer_keywords, lambda k: contains(lower(bare), lower(k)) AND NOT contains(lower(ctx), lower(k)))) > 0
      OR len(list_filter(regexp_extract_all(bare, '\b\d+(?:\.\d+)?\b'), lambda x: NOT regexp_full_match(x, '(?:19|20)\d\d') AND NOT list_contains(regexp_extract_all(ctx, '\b\d+(?:\.\d+)?\b'), x))) > 0 END AS hallucination,
    CASE WHEN refused THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE backed / CAST(n AS DOUBLE) END AS citation_accuracy,
    CASE WHEN len(expected_answer_keywords) = 0 THEN CAST(refused = should_refuse AS DOUBLE) WHEN refused THEN 0.0 ELSE len(list_filter(expected_answer_keywords, lambda k: contains(lower(answer), lower(k)))) / CAST(len(expected_answer_keywords) AS DOUBLE) END AS answer_keyword_recall,
    refused = should_refuse AS refused_correctly, CAST(len(rel) AS INTEGER) AS retrieved_relevant, CAST(len(t) AS INTEGER) AS retrieved_total,
    CASE WHEN len(expected_source_filenames) = 0 THEN 1.0 ELSE CAST(list_has_any(f, expected_source_filenames) AS DOUBLE) END AS source_accuracy, CAST(0 AS DOUBLE) AS redundancy FROM base)"""


def _metrics(spark, sf_dir):
    return evaluate.score_cases(_cases(spark, sf_dir), _answers(spark, sf_dir), I.hits(spark, sf_dir))


@register(f"WITH {_METRICS} SELECT * REPLACE (round(precision_at_k, 9) AS precision_at_k, round(recall_at_k, 9) AS recall_at_k, round(citation_accuracy, 9) AS citation_accuracy) FROM metrics")
def j9_score_cases(spark, sf_dir):
    """All case metrics (J1 to J8) at once."""
    return _metrics(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("precision_at_k", "recall_at_k", "citation_accuracy")})


@register(
    f"""WITH {I.SCORES}, top AS (SELECT * FROM (SELECT query_id, chunk_id, CAST(v AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM scores) WHERE rank <= 5)
  SELECT a.query_id, round(max(list_inner_product(a.v, b.v)), 6) AS redundancy FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank < b.rank GROUP BY 1"""
)
def j6_redundancy(spark, sf_dir):
    hits = search.knn(I.vector_queries(spark, sf_dir).drop("scope"), I.vectors(spark, sf_dir), 5, keep=("vector",), not_self=True)
    return evaluate.redundancy(hits).select("query_id", F.round("redundancy", 6).alias("redundancy"))


@register(
    f"""WITH {_METRICS} SELECT case_id, array_to_string(list_filter([CASE WHEN should_refuse AND NOT refused_correctly THEN 'Expected refusal but got an answer.' END, CASE WHEN NOT should_refuse AND recall_at_k < 1 THEN 'Not all expected retrieval keywords found in top-k.' END,
    CASE WHEN hallucination THEN 'Hallucination heuristic triggered.' END, CASE WHEN len(expected_source_filenames) > 0 AND source_accuracy < 1 THEN 'Expected source document not found in top-k.' END], lambda x: x IS NOT NULL), ' / ') AS notes
  FROM metrics JOIN cases ON cases.id = metrics.case_id"""
)
def j10_case_notes(spark, sf_dir):
    return evaluate.case_notes(_metrics(spark, sf_dir), _cases(spark, sf_dir)).select("case_id", F.array_join("notes", " / ").alias("notes"))


_MEANS = "round(avg(precision_at_k), 9) AS precision_at_k, round(avg(recall_at_k), 9) AS recall_at_k, round(avg(citation_accuracy), 9) AS citation_accuracy, round(avg(answer_keyword_recall), 9) AS answer_keyword_recall, round(avg(source_accuracy), 9) AS source_accuracy, round(avg(redundancy), 9) AS redundancy, round(avg(CAST(hallucination AS DOUBLE)), 9) AS hallucination_rate, round(avg(CAST(refused_correctly AS DOUBLE)) FILTER (WHERE should_refuse), 9) AS refusal_accuracy"


def _rounded(report):
    return report.withColumns({c: F.round(c, 9) for c in (*evaluate.METRICS, "hallucination_rate", "refusal_accuracy")})


@register(f"WITH {_METRICS} SELECT count(*) AS num_cases, {_MEANS} FROM metrics JOIN cases ON cases.id = metrics.case_id")
def j11_build_report(spark, sf_dir):
    return _rounded(evaluate.build_report(_metrics(spark, sf_dir), _cases(spark, sf_dir)))


@register(
    f"""WITH {_METRICS}, old AS (SELECT * REPLACE (0.5 AS precision_at_k) FROM metrics), new AS (SELECT * FROM metrics WHERE CAST(case_id AS BIGINT) % 3 = 0),
  merged AS (SELECT * FROM old WHERE case_id NOT IN (SELECT case_id FROM new) UNION ALL SELECT * FROM new)
  SELECT count(*) AS num_cases, {_MEANS} FROM merged JOIN cases ON cases.id = merged.case_id"""
)
def j12_merge_reports(spark, sf_dir):
    rows = _metrics(spark, sf_dir)
    old = rows.withColumn("precision_at_k", F.lit(0.5)).unionByName(rows.where("case_id = '0'").withColumn("case_id", F.lit("gone")))
    return _rounded(evaluate.merge_reports(old, rows.where("cast(case_id as bigint) % 3 = 0"), _cases(spark, sf_dir))[1])


_COMBOS = ", ".join(f"(CAST({w} AS DOUBLE), CAST({c} AS DOUBLE))" for w, c in evaluation.COMBOS)

@register(
    f"""WITH RECURSIVE {S._RETRIEVAL}, control AS (SELECT query_id, CAST(CASE WHEN CAST(query_id AS BIGINT) % 5 = 0 THEN 5 ELSE 3 END AS INTEGER) AS k, w, cap FROM questions, (VALUES {_COMBOS}) c(w, cap)), {S.selected("picked", "pool", "control")}, {S.FINAL},
  pair AS (SELECT a.query_id, a.w, a.cap, a.rank AS i, b.rank AS j, list_inner_product(u.v, t.v) AS s FROM final a JOIN final b ON b.query_id = a.query_id AND b.w = a.w AND b.cap = a.cap AND a.rank < b.rank JOIN dense u ON u.chunk_id = a.chunk_id JOIN dense t ON t.chunk_id = b.chunk_id),
  keys AS (SELECT query_id, list_transform(string_split(passage, ' ')[1:4], lambda x: lower(x)) AS kw FROM questions),
  per AS (SELECT query_id, w, cap, count(chunk_id) AS n, count_if(len(list_filter(kw, lambda k: contains(lower(text), k))) > 0) AS rel, coalesce(string_agg(lower(text), chr(10)), '') AS ctx, any_value(kw) AS kw
    FROM control JOIN keys USING (query_id) LEFT JOIN final USING (query_id, w, cap) GROUP BY ALL),
  red AS (SELECT query_id, w, cap, max(s) AS r FROM pair GROUP BY ALL)
  SELECT w AS lambda, cap, round(avg(CASE WHEN n = 0 THEN 0.0 ELSE rel / CAST(n AS DOUBLE) END), 6) AS precision, round(avg(len(list_filter(kw, lambda k: contains(ctx, k))) / CAST(len(kw) AS DOUBLE)), 6) AS recall,
    round(avg(coalesce(r, 0.0)), 6) AS redundancy, round(avg(n), 6) AS hits FROM per LEFT JOIN red USING (query_id, w, cap) GROUP BY ALL"""
)
def j13_sweep_mmr(spark, sf_dir):
    """Diversity parameters over the benchmark questions; the words of a passage are its keywords, and a fifth wants five hits."""
    q = I.questions(spark, sf_dir)
    own = F.when(F.col("query_id").cast("long") % 5 == 0, 5)
    cases = q.select(F.col("query_id").alias("id"), "query", F.slice(F.split("passage", " "), 1, 4).alias("relevant_keywords"), F.lit(False).alias("should_refuse"), own.alias("top_k"))
    pool = retrieve.pool(q.select("query_id", "query"), I.stored_lines(spark, sf_dir), Params(min_score=0.3))
    report = evaluation.sweep_mmr(cases, pool)
    return report.select("lambda", "cap", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "redundancy", "hits")))


def _side(name: str, variants: str) -> str:
    """Pool and selection with these variants, reranked by the query itself, and what is told of them."""
    return f"""{S.pooled(f"raw_{name}", variants)}, {S.reranked(f"pool_{name}", f"raw_{name}", "questions", "query")}, {S.selected(f"sel_{name}", f"pool_{name}", "control")},
  pair_{name} AS (SELECT a.query_id, a.rank AS i, b.rank AS j, list_inner_product(u.v, t.v) AS s FROM sel_{name} a JOIN sel_{name} b ON b.query_id = a.query_id AND a.rank < b.rank JOIN dense u ON u.chunk_id = a.chunk_id JOIN dense t ON t.chunk_id = b.chunk_id),
  told_{name} AS (SELECT query_id, any_value(p.n) AS pool_{name}, count_if(contains(lower(text), keyword)) AS keyword_hits_{name}, list(chunk_id ORDER BY rank) AS list_{name} FROM sel_{name} JOIN asked USING (query_id) JOIN (SELECT query_id, count(*) AS n FROM pool_{name} GROUP BY 1) p USING (query_id) GROUP BY 1),
  red_{name} AS (SELECT query_id, max(s) AS r_{name} FROM pair_{name} GROUP BY 1)"""


@register(
    f"""WITH RECURSIVE {I.QUESTIONS}, {I.LINES}, {T.VARIANTS}, {S._LINE_VECTORS}, plain AS (SELECT query_id, 0 AS variant_no, {T._COLLAPSED} AS variant FROM questions), asked AS (SELECT query_id, string_split(lower(passage), ' ')[2] AS keyword FROM questions),
  control AS (SELECT query_id, 3 AS k, CAST(0.6 AS DOUBLE) AS w, CAST(1.01 AS DOUBLE) AS cap FROM questions), {_side("off", "plain")}, {_side("on", "variants")}
  SELECT query_id, coalesce(list_off, []) <> coalesce(list_on, []) AS changed, CAST(len(list_filter(coalesce(list_on, []), lambda x: NOT list_contains(coalesce(list_off, []), x))) AS BIGINT) AS new_chunks,
    pool_off, keyword_hits_off, CASE WHEN list_off IS NOT NULL THEN round(coalesce(r_off, 0.0), 6) END AS redundancy_off, pool_on, keyword_hits_on, CASE WHEN list_on IS NOT NULL THEN round(coalesce(r_on, 0.0), 6) END AS redundancy_on
  FROM told_off FULL JOIN told_on USING (query_id) LEFT JOIN red_off USING (query_id) LEFT JOIN red_on USING (query_id)"""
)
def j14_compare_rewrite(spark, sf_dir):
    q = I.questions(spark, sf_dir).select("query_id", "query", F.split(F.lower("passage"), " ")[1].alias("keyword"))
    rows = evaluation.compare_rewrite(q, I.stored_lines(spark, sf_dir), Params(min_score=0.3))
    return rows.withColumns({c: F.round(c, 6) for c in ("redundancy_off", "redundancy_on")})


@register(f"WITH {_METRICS}, r AS (SELECT count(*) AS num_cases, avg(precision_at_k) AS p FROM metrics) SELECT num_cases, round(p, 9) AS mean_precision, case_id, round(recall_at_k, 9) AS recall_at_k, hallucination, retrieved_total FROM metrics, r")
def a7_write_report(spark, sf_dir):
    """A report with its case metrics as a JSON file, written and read back."""
    metrics, path = _metrics(spark, sf_dir), shared_folder(spark, "report")
    files.write_report(evaluate.build_report(metrics, _cases(spark, sf_dir)), metrics, path)
    case = "case_id string, recall_at_k double, hallucination boolean, retrieved_total int"
    back = spark.read.schema(f"num_cases long, precision_at_k double, cases array<struct<{case.replace(' ', ':').replace(',:', ',')}>>").json(path)
    rows = back.select("num_cases", F.round("precision_at_k", 9).alias("mean_precision"), F.explode("cases").alias("c")).select("num_cases", "mean_precision", "c.*")
    return rows.withColumn("recall_at_k", F.round("recall_at_k", 9))


@register(
    f"""WITH {I.HITS}, runs AS (SELECT 'a' AS run, query_id AS case_id, chunk_id FROM hits UNION ALL SELECT 'b', query_id, chunk_id FROM hits WHERE NOT (CAST(query_id AS BIGINT) % 7 = 0 AND rank = 2)),
  s AS (SELECT run, case_id, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS s FROM runs GROUP BY ALL), c AS (SELECT case_id, count(DISTINCT s) AS n, count(*) AS r FROM s GROUP BY 1)
  SELECT CAST(count_if(n = 1 AND r = 2) AS BIGINT) AS agreements, count(*) AS total FROM c"""
)
def j15_run_agreement(spark, sf_dir):
    hits = I.hits(spark, sf_dir)
    runs = hits.select(F.lit("a").alias("run"), F.col("query_id").alias("case_id"), "chunk_id")
    other = hits.where(~((F.col("query_id").cast("long") % 7 == 0) & (F.col("rank") == 2))).select(F.lit("b").alias("run"), F.col("query_id").alias("case_id"), "chunk_id")
    return evaluate.run_agreement(runs.unionByName(other))


@register("WITH s AS (SELECT round(value / 7.013, 1) AS s FROM events) SELECT count(*) AS num_cases, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, min(s) AS min_s, max(s) AS max_s FROM s")
def j16_latency_summary(spark, sf_dir):
    """Event values as seconds per case."""
    rows = evaluate.latency_summary(I.table(spark, sf_dir, "events").select((F.col("value") / F.lit(7.013)).alias("elapsed_seconds")))
    return rows.withColumns({"mean_s": F.round("mean_s", 6), "median_s": F.round("median_s", 6)})
