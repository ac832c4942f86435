"""Cleaning, splitting, chunking (B) and query rewriting (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import queries as Q
from ..functions import text as T
from ..operators import chunking, rewrite
from ..params import QUESTION_WORDS
from ..plans.ingest import chunk_table
from . import inputs as I

QUERIES, ORACLES, register = I.registry()
_NOISY = r"replace(replace(replace(text, ', ', '-' || chr(10)), '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10)), 'the ', 'the' || chr(9) || ' ')"


def _noisy():
    return F.replace(F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("-\n")), F.lit(". "), F.lit(".  \r\n\n\n")), F.lit("the "), F.lit("the\t "))


def _clean(x: str) -> str:
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]+\n', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return I.strip(rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')")


@register(f"SELECT doc_id, {_clean(_NOISY)} AS cleaned FROM documents")
def b1_clean_text(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(_noisy()).alias("cleaned"))


@register(f"SELECT doc_id, {I.ws('text')} AS normal FROM documents")
def b2_normalize_ws(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("normal"))


@register(f"SELECT doc_id, {I.norm('text')} AS normal FROM documents")
def b3_normalize_words(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", T.normalize_words(F.col("text")).alias("normal"))


@register(
    rf"""WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS t FROM documents),
  q AS (SELECT doc_id, generate_subscripts(t, 1) AS k, unnest(t) AS para FROM p),
  s AS (SELECT doc_id, k, {I.sentences(I.strip("para"))} AS l FROM q),
  u AS (SELECT doc_id, k, generate_subscripts(l, 1) AS j, unnest(l) AS sentence FROM s)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS position, sentence FROM u"""
)
def b4_split_sentences(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_sentences(text)).alias("position", "sentence"))


#: Sentences go one by one behind what is held; {out, held, s}: closed chunks, sentences of the open one, the next sentence.
_HELD = "array_to_string(a.held, ' ')"
_CLOSED = f"list_concat(a.out, CASE WHEN len(a.held) > 0 THEN [{_HELD}] ELSE []::VARCHAR[] END)"
_TAIL = "list_filter(a.held, lambda s, i: length(array_to_string(a.held[i:], ' ')) <= 120)"
_FULL = f"len(a.held) > 0 AND length({_HELD}) + length(x.s) + 2 > 800"
_PIECES = "list_transform(range(0, length(x.s), 680), lambda i: substring(x.s, CAST(i AS INTEGER) + 1, 800))"
CHUNKED = rf"""cleaned AS (SELECT document_id, filename, {_clean("text")} AS text FROM pages_in WHERE text IS NOT NULL),
  paras AS (SELECT document_id, filename, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {I.strip("p")}), lambda p: p <> '') AS p FROM cleaned WHERE text <> ''),
  sents AS (SELECT document_id, filename, flatten(list_transform(p, lambda q: {I.sentences("q")})) AS l FROM paras),
  folded AS (SELECT document_id, filename, list_reduce(list_transform(l, lambda s: {{'out': []::VARCHAR[], 'held': []::VARCHAR[], 's': s}}), lambda a, x: {{
      'out': CASE WHEN length(x.s) > 800 THEN list_concat({_CLOSED}, {_PIECES}) WHEN {_FULL} THEN {_CLOSED} ELSE a.out END,
      'held': CASE WHEN length(x.s) > 800 THEN {_TAIL} WHEN {_FULL} THEN list_append({_TAIL}, x.s) ELSE list_append(a.held, x.s) END, 's': ''}},
    {{'out': []::VARCHAR[], 'held': []::VARCHAR[], 's': ''}}) AS a FROM sents WHERE len(l) > 0),
  packed AS (SELECT document_id, filename, {_CLOSED} AS l FROM folded)"""
#: The chunks of documents that are not rejected, numbered, without later repeats inside a document
INGESTED = f"""{I.PAGES}, {CHUNKED}, numbered AS (SELECT document_id, filename, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk_index, CAST(NULL AS INTEGER) AS page, unnest(l) AS text FROM packed),
  chunks AS (SELECT document_id || ':' || n.chunk_index AS chunk_id, document_id, filename, n.chunk_index, page, text FROM numbered n
    WHERE NOT EXISTS (SELECT 1 FROM numbered e WHERE e.document_id = n.document_id AND e.chunk_index < n.chunk_index AND {I.ws("e.text")} = {I.ws("n.text")}))"""


@register(f"WITH {I.PAGES}, {CHUNKED} SELECT document_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, unnest(l) AS text FROM packed")
def b5_chunk_pages(spark, sf_dir):
    """Packed chunks of every page."""
    packed = chunking.chunk_pages(I.pages(spark, sf_dir))
    return packed.select("document_id", F.posexplode("chunks").alias("position", "text"))


@register(
    """WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 160)) AS begins FROM documents)
  SELECT doc_id, CAST(begins // 160 AS INTEGER) AS position, substring(text, CAST(begins AS INTEGER) + 1, 200) AS piece FROM w"""
)
def b6_hard_split(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.hard_windows(F.col("text"), 200, 40)).alias("position", "piece"))


@register(
    rf"""WITH p AS (SELECT source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, string_split(text, chr(10)) AS t FROM documents),
  n AS (SELECT *, coalesce(sum(len(t)) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
  u AS (SELECT document_id, page, start, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS text FROM n)
  SELECT document_id || ':' || CAST(start + pos AS BIGINT) AS chunk_id, document_id, CAST(start + pos AS INTEGER) AS chunk_index, CAST(page AS INTEGER) AS page, text FROM u"""
)
def b7_number_chunks(spark, sf_dir):
    """Running index over the pages of a source (B8: the ids made of it)."""
    packed = I.source_pages(spark, sf_dir).withColumn("chunks", F.split("text", "\n"))
    return chunking.number_chunks(packed).drop("filename")


@register(f"WITH {I.LINES} SELECT document_id, count(*) AS num_chunks, CAST(sum(length(text)) AS BIGINT) AS num_chars FROM lines GROUP BY document_id")
def b9_document_stats(spark, sf_dir):
    return chunking.document_stats(I.lines(spark, sf_dir))


@register(f"WITH {INGESTED} SELECT chunk_id, document_id, filename, chunk_index, page, text FROM chunks")
def ingest_chunk_table(spark, sf_dir):
    """Cleaned, packed, numbered chunks of all documents without repeats."""
    return chunk_table(I.pages(spark, sf_dir))


_COLLAPSED = I.strip(rf"regexp_replace(query, '[{I.SPACES}]+', ' ', 'g')")


@register(f"WITH {I.QUESTIONS} SELECT query_id, {_COLLAPSED} AS normal FROM questions")
def e1_normalize_query(spark, sf_dir):
    return I.questions(spark, sf_dir).select("query_id", Q.normalize_query(F.col("query")).alias("normal"))


_STOP = ", ".join(f"'{w}'" for w in QUESTION_WORDS)
_KEYWORDS = f"array_to_string(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t)), ' ')"
_KEYWORD_VARIANT = f"CASE WHEN {_KEYWORDS} <> '' AND {_KEYWORDS} <> lower(query) THEN {_KEYWORDS} END"
_REST = r"regexp_replace(regexp_replace(query, '^\s*(?:what|which|who|when|where|why|how|is|are|do|does|did|can|could|should|would|will)(?:\b)[\s,]*', '', 'i'), '^[ ?.]+|[ ?.]+$', '', 'g')"
_STRIPPED_VARIANT = f"CASE WHEN {_REST} <> '' AND lower({_REST}) <> lower(query) THEN {_REST} END"


@register(f"WITH {I.QUESTIONS} SELECT query_id, {_KEYWORD_VARIANT} AS variant FROM questions")
def e2_keyword_variant(spark, sf_dir):
    return I.questions(spark, sf_dir).select("query_id", Q.keyword_variant(F.col("query")).alias("variant"))


@register(f"WITH {I.QUESTIONS} SELECT query_id, {_STRIPPED_VARIANT} AS variant FROM questions")
def e3_stripped_variant(spark, sf_dir):
    return I.questions(spark, sf_dir).select("query_id", Q.stripped_variant(F.col("query")).alias("variant"))


_TAX = r"CASE WHEN regexp_matches(query, '\b(?:categor(?:y|ies)|families|types?|kinds?)\b.*\b(?:instance|ec2)\b|\b(?:instance|ec2)\b.*\b(?:categor(?:y|ies)|families|types?|kinds?)\b', 'is') THEN 'EC2 instance type families general purpose compute optimized memory optimized storage optimized accelerated computing' END"
_FAM = r"CASE WHEN regexp_matches(query, '\bmemory[- ]?(?:intensive|optimized)\b|\b(?:large|high)\s+(?:memory|ram)\b', 'i') THEN 'memory optimized designed deliver fast performance workloads process large data sets in memory' END"
_SPEC = r"CASE WHEN regexp_matches(query, '\b(?:vcpu|vcpus|memory|gi[b]|ram|bandwidth|network|storage|iops|processor|cores?|threads?)\b', 'i') AND regexp_extract(query, '\b[A-Za-z]\d+[A-Za-z]?\.[A-Za-z][A-Za-z0-9]*\b') <> '' THEN regexp_extract(query, '\b[A-Za-z]\d+[A-Za-z]?\.[A-Za-z][A-Za-z0-9]*\b') || ' performance specifications vCPUs memory processor' END"


@register(f"WITH {I.QUESTIONS} SELECT query_id, {_TAX} AS taxonomy, {_FAM} AS family, {_SPEC} AS specification FROM questions")
def e4_e5_e6_rule_variants(spark, sf_dir):
    spec, family, taxonomy = Q.RULES
    q = F.col("query")
    return I.questions(spark, sf_dir).select("query_id", Q.rule_variant(q, taxonomy).alias("taxonomy"), Q.rule_variant(q, family).alias("family"), Q.rule_variant(q, spec).alias("specification"))


#: variants(query_id, variant_no, variant) of the questions
VARIANTS = rf"""every AS (SELECT query_id, list_filter([query, {_SPEC}, {_FAM}, {_TAX}, {_KEYWORD_VARIANT}, {_STRIPPED_VARIANT}], lambda x: x IS NOT NULL AND x <> '') AS l,
    4 + CAST({_SPEC} IS NOT NULL AS INTEGER) + CAST({_FAM} IS NOT NULL AS INTEGER) + CAST({_TAX} IS NOT NULL AS INTEGER) AS most
    FROM (SELECT query_id, {_COLLAPSED} AS query FROM questions)),
  u AS (SELECT query_id, most, generate_subscripts(l, 1) AS k, unnest(l) AS variant FROM every),
  o AS (SELECT query_id, most, min(k) AS k, arg_min(variant, k) AS variant FROM u GROUP BY query_id, most, lower(variant)),
  o_n AS (SELECT query_id, most, variant, row_number() OVER (PARTITION BY query_id ORDER BY k) AS n FROM o),
  variants AS (SELECT query_id, CAST(n - 1 AS INTEGER) AS variant_no, variant FROM o_n WHERE n <= most)"""


@register(f"WITH {I.QUESTIONS}, {VARIANTS} SELECT query_id, variant_no, variant FROM variants")
def e7_rewrite_queries(spark, sf_dir):
    return rewrite.rewrite_queries(I.questions(spark, sf_dir)).select("query_id", "variant_no", "variant")


_UNMARKED = I.strip(r"regexp_replace(x, '^\s*(?:\d+[.)]|[-*])\s*', '')")
_PARAPHRASE = I.strip(rf"""regexp_replace(regexp_replace({_UNMARKED}, '^"+|"+$', '', 'g'), '[{I.SPACES}]+', ' ', 'g')""")


@register(
    rf"""WITH t AS (SELECT conv_id, turn, string_split('1. "' || replace(text, '. ', chr(10) || '- ') || '"', chr(10)) AS l FROM conversations),
  s AS (SELECT conv_id, turn, list_filter(list_transform(l, lambda x: {_PARAPHRASE}), lambda x: x <> '') AS l FROM t)
  SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS position, unnest(l) AS paraphrase FROM s"""
)
def e8_parse_paraphrases(spark, sf_dir):
    output = F.concat(F.lit('1. "'), F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")), F.lit('"'))
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(Q.parse_paraphrases(output)).alias("position", "paraphrase"))


@register(
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(lower(text) || ' m5.xlarge, r6i.4xlarge (m5.xlarge) c5n.18xlarge', '(?:^|[^\p{{L}}\p{{N}}_])([a-z]\d+[a-z]?\.[a-z][a-z0-9]*)\b', 1) AS l FROM documents)
  SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS identifiers FROM p"""
)
def f9_extract_identifiers(spark, sf_dir):
    text = F.concat(F.lower("text"), F.lit(" m5.xlarge, R6i.4XLARGE (m5.xlarge) c5n.18xlarge"))
    return I.table(spark, sf_dir, "documents").select("doc_id", Q.extract_identifiers(text).alias("identifiers"))


@register(
    f"""WITH d AS (SELECT doc_id, list_distinct({I.words("text")}) AS w FROM documents), p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
  SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END, 9) AS jaccard FROM p"""
)
def f8_word_jaccard(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(other, "doc_id").select("doc_id", F.round(T.word_jaccard(F.col("text"), F.col("other")), 9).alias("jaccard"))
