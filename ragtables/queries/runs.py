"""Whole runs: a labelled question set from its scopes to the report, and questions in running conversations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import evaluate, memory
from ..params import INTRO, METRIC_STOPWORDS, REFUSAL, VALIDATION_STOPWORDS, Params
from ..plans import converse, evaluation
from . import answers as A
from . import dialogue as D
from . import evaluation as E
from . import inputs as I
from . import search as S

QUERIES, ORACLES, register = I.registry()
_PARAMS = Params(min_score=0.3, history=D.N)

#: From `questions` to `told`(query_id, answer, provider, grounded): retrieval, context, prompt, answer, check. `done` has the completions.
_TOLD = rf"""{S._ONE}, {S.selected("picked", "pool", "control")}, {S.FINAL},
  hits AS (SELECT query_id, rank, chunk_id, document_id, 'doc' || document_id || '.txt' AS filename, chunk_index, CAST(NULL AS INTEGER) AS page, text, score FROM final),
  {A._GROUPED}, {A._SHOWN}, {A._CONTEXT}, byno AS (SELECT query_id, marker AS rank, chunk_id, text, filename FROM grouped),
  prompts AS (SELECT query_id, 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || asked || chr(10) || chr(10) || 'Answer with inline [n] citations.' AS prompt FROM contexts JOIN questions USING (query_id)),
  answers AS (SELECT query_id, coalesce(d.answer, {A._q(INTRO)} || {A._INNER}) AS answer, CASE WHEN d.answer IS NULL THEN 'extractive' ELSE 'openai' END AS provider FROM prompts LEFT JOIN done d USING (query_id)),
  {A._GROUPS}, {A.supported(VALIDATION_STOPWORDS).replace("JOIN hits h", "JOIN byno h")}, {A._VERDICT},
  told AS (SELECT q.query_id, CASE WHEN c.answer IS NULL THEN {A._q(REFUSAL)} WHEN passed THEN c.answer ELSE c.answer || chr(10) || chr(10) || {A._DISC} END AS answer,
    coalesce(provider, 'none') AS provider, coalesce(passed, false) AS grounded FROM questions q LEFT JOIN checked c USING (query_id) LEFT JOIN answers a USING (query_id))"""


def _renamed(sql: str) -> str:
    """The check of citations under other names, as the metrics count it with their own stop words."""
    return re.sub(r"\b(cnt|tok|cited|back|sup|bad)\b", r"m_\1", sql)


def _metrics() -> str:
    sql = E._METRICS[E._METRICS.index("got AS") :]
    changes = {
        "got AS (SELECT query_id, list(text ORDER BY rank) AS t, list(DISTINCT filename) AS f, string_agg(text, chr(10) ORDER BY rank) AS ctx FROM hits GROUP BY 1)":
        "got AS (SELECT id AS query_id, coalesce(list(text ORDER BY rank) FILTER (WHERE text IS NOT NULL), []) AS t, coalesce(list(DISTINCT filename) FILTER (WHERE text IS NOT NULL), []) AS f, coalesce(string_agg(text, chr(10) ORDER BY rank), '') AS ctx FROM cases LEFT JOIN byno ON query_id = id GROUP BY 1)",
        "JOIN answers a ON": "JOIN told a ON",
        "LEFT JOIN sup s": "LEFT JOIN m_sup s",
        "len(rel) / CAST(len(t) AS DOUBLE) AS": "CASE WHEN len(t) = 0 THEN 0.0 ELSE len(rel) / CAST(len(t) AS DOUBLE) END AS",
        "WHEN refused THEN 1.0": "WHEN refused OR len(t) = 0 THEN 1.0",
        "CAST(0 AS DOUBLE) AS redundancy": "coalesce((SELECT max(list_inner_product(u.v, w.v)) FROM byno x JOIN byno y ON x.query_id = y.query_id AND x.rank < y.rank JOIN dense u ON u.chunk_id = x.chunk_id JOIN dense w ON w.chunk_id = y.chunk_id WHERE x.query_id = id), 0.0) AS redundancy",
    }
    for old, new in changes.items():
        assert old in sql
        sql = sql.replace(old, new)
    return sql


_ID = "CAST(query_id AS BIGINT)"
_CASES = f"""cases AS (SELECT query_id AS id, list_transform(string_split(passage, ' ')[1:3], lambda x: lower(x)) AS relevant_keywords, string_split(passage, ' ')[2:3] AS expected_answer_keywords, ['qqqq'] AS forbidden_answer_keywords,
    {_ID} % 6 = 0 AS should_refuse, CASE WHEN {_ID} % 4 = 0 THEN ['doc1.txt'] ELSE []::VARCHAR[] END AS expected_source_filenames FROM questions)"""
_DONE = f"done AS (SELECT query_id, passage || ' [1]. ' || passage || ' [7].' AS answer FROM questions WHERE {_ID} % 3 = 1)"
_KNOWN = I.QUESTIONS.replace("questions AS (", "named AS (", 1) + f", questions AS (SELECT *, query AS asked FROM named WHERE {_ID} % 11 <> 3)"
_RUN = f"WITH RECURSIVE {S._RETRIEVAL.replace(I.QUESTIONS, _KNOWN, 1)}, {_DONE}, {_CASES}, {_TOLD}, {_renamed(A.supported(METRIC_STOPWORDS)).replace('JOIN hits h', 'JOIN byno h')}, {_metrics()}"


def _cases(spark, sf_dir):
    """The benchmark as a question set: some to refuse, some of another provider, some with a source, every eleventh of a file that is missing."""
    q, n = I.questions(spark, sf_dir), F.col("query_id").cast("long")
    words, none = F.split("passage", " "), F.array().cast("array<string>")
    return q.select(
        F.col("query_id").alias("id"), "query", F.transform(F.slice(words, 1, 3), F.lower).alias("relevant_keywords"), F.slice(words, 2, 2).alias("expected_answer_keywords"), F.array(F.lit("qqqq")).alias("forbidden_answer_keywords"),
        (n % 6 == 0).alias("should_refuse"), F.when(n % 11 == 3, F.array(F.lit("nofile.txt"))).otherwise(none).alias("document_filenames"), F.when(n % 4 == 0, F.array(F.lit("doc1.txt"))).otherwise(none).alias("expected_source_filenames"),
        F.when(n % 3 == 1, "openai").otherwise("auto").alias("mode"), "passage",
    )


def _ran(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    done = cases.where("mode = 'openai'").select(F.col("id").alias("query_id"), F.lit("openai").alias("provider"), F.concat("passage", F.lit(" [1]. "), "passage", F.lit(" [7].")).alias("answer"))
    return evaluation.run_cases(cases.drop("passage"), I.stored_lines(spark, sf_dir), I.catalogue(spark, sf_dir), done, _PARAMS)


_SHARES = ("precision_at_k", "recall_at_k", "citation_accuracy", "answer_keyword_recall", "source_accuracy", "redundancy")
_NOTES = """array_to_string(list_filter([CASE WHEN should_refuse AND NOT refused_correctly THEN 'Expected refusal but got an answer.' END, CASE WHEN NOT should_refuse AND recall_at_k < 1 THEN 'Not all expected retrieval keywords found in top-k.' END,
    CASE WHEN hallucination THEN 'Hallucination heuristic triggered.' END, CASE WHEN len(expected_source_filenames) > 0 AND source_accuracy < 1 THEN 'Expected source document not found in top-k.' END], lambda x: x IS NOT NULL), ' / ') AS notes"""


@register(
    f"""{_RUN} SELECT case_id, answer, provider, grounded, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)}, hallucination, refused_correctly, retrieved_relevant, retrieved_total, {_NOTES}
  FROM metrics JOIN told ON told.query_id = case_id JOIN cases ON cases.id = case_id"""
)
def j17_run_cases(spark, sf_dir):
    """A whole question set: every case with its answer, all metrics and notes."""
    results, _, _ = _ran(spark, sf_dir)
    rounded = results.withColumns({c: F.round(c, 6) for c in _SHARES}).withColumn("notes", F.array_join("notes", " / "))
    return rounded.select("case_id", "answer", "provider", "grounded", *_SHARES, "hallucination", "refused_correctly", "retrieved_relevant", "retrieved_total", "notes")


@register(f"{_RUN} SELECT count(*) AS num_cases, {E._MEANS.replace(', 9)', ', 6)')} FROM metrics JOIN cases ON cases.id = metrics.case_id")
def j17_run_report(spark, sf_dir):
    """The report of the same run."""
    _, report, _ = _ran(spark, sf_dir)
    return report.withColumns({c: F.round(c, 6) for c in (*evaluate.METRICS, "hallucination_rate", "refusal_accuracy")})


_SAID = "CASE WHEN conv_id % 2 = 0 THEN 'what about it?' ELSE 'please say in how many places ' || coalesce(first, 'nothing') || ' is found' END"
_TALK = rf"""turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')),
  last_turn AS (SELECT conv_id, max(turn) + 1 AS turn, string_split(arg_max(text, turn), ' ')[1] AS first FROM turns GROUP BY 1),
  new_turn AS (SELECT conv_id, turn, 'user' AS role, {_SAID} AS text FROM last_turn), both_ AS (SELECT *, false AS fresh FROM turns UNION ALL SELECT *, true FROM new_turn),
  around AS (SELECT *, count(*) OVER f AS has, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER f AS said FROM both_ WINDOW f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {D.N} PRECEDING AND 1 PRECEDING)),
  questions AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, turn, text AS asked, CASE WHEN {D._NEEDS} AND said IS NOT NULL THEN said || ' — follow-up: ' || text ELSE text END AS query FROM around WHERE fresh)"""


@register(
    f"""WITH RECURSIVE {S._RETRIEVAL.replace(I.QUESTIONS, _TALK, 1)}, done AS (SELECT '' AS query_id, '' AS answer WHERE false), {_TOLD}
  SELECT CAST(query_id AS BIGINT) AS conv_id, turn, 'user' AS role, asked AS text FROM questions UNION ALL SELECT CAST(query_id AS BIGINT), turn + 1, 'assistant', answer FROM told JOIN questions USING (query_id)"""
)
def i8_conversations_go_on(spark, sf_dir):
    """A new question in every conversation, searched with what was said before, answered, and remembered."""
    turns = I.table(spark, sf_dir, "conversations")
    held = memory.dialogue(turns)
    first = F.split(F.max_by("text", "turn"), " ")[0]
    ends = held.groupBy("conv_id").agg(first.alias("first"))
    text = F.when(F.col("conv_id") % 2 == 0, "what about it?").otherwise(F.concat(F.lit("please say in how many places "), F.coalesce("first", F.lit("nothing")), F.lit(" is found")))
    asked = ends.select("conv_id", text.alias("query"))
    questions, hits, messages = converse.prepare(turns, asked, I.stored_lines(spark, sf_dir), _PARAMS)
    none = messages.select("query_id", F.lit("openai").alias("provider"), F.lit(None).cast("string").alias("answer"))
    _, after = converse.conclude(turns.limit(0), questions, hits, none, _PARAMS)
    return after.select("conv_id", "turn", "role", "text")
