"""The given tables as documents, chunks, queries and turns; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import search
from ..operators.chunking import with_chunk_id
from ..operators.numbering import numbered
from ..params import SPACES
from ..sources.tables import checkpointed



def registry() -> tuple[dict, dict, object]:
    """QUERIES, ORACLES and a decorator that enters a query under its name, with its SQL."""
    found, sql = {}, {}

    def register(oracle: str | None = None):
        def enter(f):
            found[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return enter

    return found, sql, register


#: A table of so few files may have one row group in all, which one task reads and works on alone.
FEW_FILES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts of few files are dealt to all cores once; tables of many files are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "documents" and len(df.inputFiles()) <= FEW_FILES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document."""
    return as_pages(table(spark, sf_dir, "documents"))


def as_pages(d: DataFrame) -> DataFrame:
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc"), "doc_id", F.when(F.col("doc_id") % 50 == 7, ".xls").otherwise(".txt")).alias("filename"), F.lit(None).cast("int").alias("page"), "text")


PAGES = "pages_in AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc' || doc_id || CASE WHEN doc_id % 50 = 7 THEN '.xls' ELSE '.txt' END AS filename, CAST(NULL AS INTEGER) AS page, text FROM documents)"


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source as its pages."""
    d = table(spark, sf_dir, "documents")
    places = numbered(d.select("source", "doc_id"), [F.col("doc_id").asc()], within=("source",), name="before").select("doc_id", (F.col("before") + 1).cast("int").alias("page"))
    return d.join(places, "doc_id").select(F.col("source").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("filename"), "page", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: the lines of the documents."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("filename"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return with_chunk_id(rows.select("document_id", "filename", "chunk_index", F.lit(None).cast("int").alias("page"), "text"))


LINES = """lines AS (SELECT document_id || ':' || chunk_index AS chunk_id, * FROM (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, 'doc' || doc_id || '.txt' AS filename,
         CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS chunk_index, CAST(NULL AS INTEGER) AS page, unnest(t) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the documents; three documents share a file name."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("file"), F.floor(F.col("doc_id") / 3), F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"), F.col("n_chars").cast("long").alias("num_chars"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") * 7919) % 100_003).alias("uploaded_at"))


CATALOGUE = "catalogue AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'file' || (doc_id // 3) || '.txt' AS filename, 'text/plain' AS content_type, CAST(n_chars AS BIGINT) AS num_chars, CAST(1700000000 + (doc_id * 7919) % 100003 AS BIGINT) AS uploaded_at FROM documents)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a query per three documents: their lines, interleaved, with falling scores."""
    rows = lines(spark, sf_dir).withColumn("query_id", F.floor(F.col("document_id").cast("long") / 3).cast("string"))
    w = Window.partitionBy("query_id").orderBy("chunk_index", F.col("document_id").cast("long"))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.select("query_id", "rank", "chunk_id", "document_id", "filename", "chunk_index", (F.when(F.col("document_id").cast("long") % 3 == 1, F.col("chunk_index") % 4 + 1)).cast("int").alias("page"), "text", (1.0 / F.col("rank")).alias("score"))


HITS = (
    LINES
    + """, hits AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_index, CAST(document_id AS BIGINT)) AS INTEGER) AS rank,
  chunk_id, document_id, filename, chunk_index, CASE WHEN CAST(document_id AS BIGINT) % 3 = 1 THEN CAST(chunk_index % 4 + 1 AS INTEGER) END AS page, text,
  1.0::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY chunk_index, CAST(document_id AS BIGINT)) AS score
  FROM (SELECT *, CAST(CAST(document_id AS BIGINT) // 3 AS VARCHAR) AS query_id FROM lines))"""
)


def trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n, text): three documents each, their texts one below the other."""
    d = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 3).alias("n")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    return d.select("n", F.array_join(F.transform("d", lambda x: x["text"]), "\n").alias("text"))


TRIOS = "trios AS (SELECT doc_id // 3 AS n, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to each query of the hits: the texts of its documents, to three in four of them with marks put in."""
    text = F.when(F.col("n") % 4 == 1, F.col("text")).otherwise(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" [1]. ")), F.lit(", "), F.lit(" [2, 90] ")))
    return trios(spark, sf_dir).select(F.col("n").cast("string").alias("query_id"), text.alias("answer"))


ANSWERS = (
    TRIOS
    + ", answers AS (SELECT CAST(n AS VARCHAR) AS query_id, CASE WHEN n % 4 = 1 THEN text ELSE replace(replace(text, '. ', ' [1]. '), ', ', ' [2, 90] ') END AS answer FROM trios)"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors; the label is the document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), F.col("vec_id").cast("int").alias("chunk_index"), F.col("embedding").alias("vector"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks, a third of them in the scope of two labels."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    scope = F.when(F.col("vec_id") % 60 == 0, F.array(F.lit("1"), F.lit("4")))
    return e.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"), scope.alias("scope"))


SCORES = """scores AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, q.vec_id AS q, CAST(c.vec_id AS VARCHAR) AS chunk_id, CAST(c.label AS VARCHAR) AS document_id, CAST(c.vec_id AS INTEGER) AS chunk_index,
  round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score, c.embedding AS v
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of the benchmark passages."""
    b = table(spark, sf_dir, "benchmark")
    lead = F.element_at(F.array(*map(F.lit, ("How do I ", "What is the memory of m5.xlarge and ", "Which types of EC2 instance ", "memory intensive "))), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.concat(lead, "text", F.lit(" ?")).alias("query"), F.col("text").alias("passage"))


QUESTIONS = "questions AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CASE item_id % 4 WHEN 0 THEN 'How do I ' WHEN 1 THEN 'What is the memory of m5.xlarge and ' WHEN 2 THEN 'Which types of EC2 instance ' ELSE 'memory intensive ' END || text || ' ?' AS query, text AS passage FROM benchmark)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def ws(x: str) -> str:
    return strip(rf"regexp_replace(lower({x}), '[{SPACES}]+', ' ', 'g')")


def norm(x: str) -> str:
    return strip(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')")


def words(x: str) -> str:
    return f"CASE WHEN {norm(x)} = '' THEN []::VARCHAR[] ELSE string_split({norm(x)}, ' ') END"


def sentences(x: str) -> str:
    """The parts of x behind ., ! or ? and white space, without empty ones."""
    marked = rf"regexp_replace({x}, '([.!?])[{SPACES}]+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def embedded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.embed(lines(spark, sf_dir))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, encoded once for searches that read the chunks more than once."""
    return checkpointed(embedded_lines(spark, sf_dir))


#: vec(id, v): normalised hashed words of texts(id, text)
EMBED = """tok AS (SELECT id, unnest({words}) AS w FROM texts),
  cell AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS b, 1 - 2 * (('0x' || substr(md5(w), 9, 1))::BIGINT % 2) AS s FROM tok),
  sums AS (SELECT id, b, CAST(sum(s) AS DOUBLE) AS s FROM cell GROUP BY ALL),
  lens AS (SELECT id, sqrt(sum(s * s)) AS n FROM sums GROUP BY ALL),
  vec AS (SELECT id, b, s / CASE WHEN n = 0 THEN 1e-12 ELSE n END AS x FROM sums JOIN lens USING (id))""".format(words=words("text"))
