"""Sources, duplicate removal and the catalogue (A, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, dedup, evaluate, search
from ..sources import files, tables
from ..sources.store import ChunkStore
from ..sources.tables import shared_folder
from . import inputs as I

QUERIES, ORACLES, register = I.registry()
_DOUBLED = "doubled AS (SELECT document_id, filename, chunk_index, page, text FROM lines UNION ALL SELECT document_id, filename, chunk_index + 1000, page, replace(replace(text, 'e', 'E'), ' ', '  ') || '  ' FROM lines WHERE chunk_index % 2 = 0)"


def _doubled(spark, sf_dir):
    """The lines, and every other one again in other letters and with blanks behind."""
    rows = I.lines(spark, sf_dir).select("document_id", "filename", "chunk_index", "page", "text")
    again = rows.where("chunk_index % 2 = 0").withColumns({"chunk_index": F.col("chunk_index") + 1000, "text": F.concat(F.replace(F.replace("text", F.lit("e"), F.lit("E")), F.lit(" "), F.lit("  ")), F.lit("  "))})
    return rows.unionByName(again)


_PATH = "'/in/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.MD' ELSE '.txt' END"


@register(f"SELECT sha256({_PATH}) AS document_id, substring({_PATH}, 5) AS filename, CAST(NULL AS INTEGER) AS page, '\ufffd' || text AS text FROM documents WHERE doc_id % 3 <> 2")
def a1_text_pages(spark, sf_dir):
    """The decoding rule over documents as file rows, with broken bytes and a genuine replacement character in front; a third are no text files."""
    d = I.table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("/in/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".txt").otherwise(".pdf")).alias("path"), F.concat(F.unhex(F.lit("FFEFBFBDE282")), F.col("text").cast("binary")).alias("content"))
    return files.text_pages(rows)


@register(
    """WITH p AS (SELECT '/in/' || doc_id || '.pdf' AS path, string_split(text, chr(10)) AS l FROM documents)
  SELECT sha256(path) AS document_id, substring(path, 5) AS filename, CAST(generate_subscripts(l, 1) AS INTEGER) AS page, unnest(l) AS text FROM p"""
)
def a2_read_pages(spark, sf_dir):
    """Documents as files whose pages a caller's extractor finds: here, their lines."""
    d = I.table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("/in/"), "doc_id", F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))
    return files.read_pages(rows, lambda content: content.decode().split("\n"))


@register(
    """SELECT 'benchmark' AS dataset, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS position, CAST(item_id AS VARCHAR) AS id, text AS query,
  CASE WHEN item_id % 2 = 0 THEN string_split(text, ' ')[1] ELSE '' END AS keywords, item_id % 3 = 0 AS should_refuse, CASE WHEN item_id % 5 = 0 THEN 7 END AS top_k, 'auto' AS mode FROM benchmark"""
)
def a6_read_eval_dataset(spark, sf_dir):
    """The benchmark as the JSON file of a question set, written and read back with its defaults."""
    b, path = I.table(spark, sf_dir, "benchmark"), shared_folder(spark, "cases")
    case = F.struct(
        F.col("item_id").alias("n"), F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.split("text", " ")[0])).alias("relevant_keywords"), F.when(F.col("item_id") % 3 == 0, True).alias("should_refuse"), F.when(F.col("item_id") % 5 == 0, 7).alias("top_k"),
    )
    b.agg(F.to_json(F.struct(F.lit("benchmark").alias("name"), F.array_sort(F.collect_list(case)).alias("cases"))).alias("value")).write.text(path)  # a question set is one file
    cases = files.read_eval_dataset(spark, path)
    return cases.select("dataset", "position", "id", "query", F.array_join("relevant_keywords", ",").alias("keywords"), "should_refuse", "top_k", "mode")


@register(
    f"""WITH {I.PAGES}, g AS (SELECT document_id, filename, max(length({I.strip("coalesce(text, '')")})) AS n FROM (SELECT document_id, filename, CASE WHEN CAST(document_id AS BIGINT) % 40 = 3 THEN ' ' || chr(10) ELSE text END AS text FROM pages_in) GROUP BY ALL)
  SELECT document_id, filename, CASE WHEN filename LIKE '%.xls' THEN 'unsupported type' ELSE 'no text' END AS reason FROM g WHERE filename LIKE '%.xls' OR n = 0"""
)
def a3_split_rejects(spark, sf_dir):
    pages = I.pages(spark, sf_dir).withColumn("text", F.when(F.col("document_id").cast("long") % 40 == 3, F.lit(" \n")).otherwise(F.col("text")))
    return catalog.split_rejects(pages)[1]


@register("SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(label AS VARCHAR) AS document_id, CAST(vec_id AS INTEGER) AS chunk_index, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def a4_write_and_read_chunks(spark, sf_dir):
    path = shared_folder(spark, "chunks")
    rows = I.vectors(spark, sf_dir).select("chunk_id", "document_id", F.lit("f").alias("filename"), "chunk_index", F.lit(None).cast("int").alias("page"), F.lit("").alias("text"), F.col("vector").cast("array<double>").alias("vector"))
    tables.write_chunks(rows, path, mode="overwrite")
    return tables.read_chunks(spark, path).select("chunk_id", "document_id", "chunk_index", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@register("SELECT CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings WHERE vec_id % 7 = 0")
def a5_check_dimension(spark, sf_dir):
    rows = I.vectors(spark, sf_dir).withColumn("vector", F.when(F.col("chunk_index") % 7 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    return search.check_dimension(rows, 64)[1].select("chunk_id")


@register("SELECT CAST(item_id AS VARCHAR) AS id, text AS query FROM benchmark WHERE item_id IN (1, 5, 7)")
def a8_select_cases(spark, sf_dir):
    cases = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"))
    return evaluate.select_cases(cases, ["1", "5", "7"])


@register(f"WITH {I.LINES}, {_DOUBLED} SELECT document_id, min(chunk_index) AS chunk_index, arg_min(text, chunk_index) AS text FROM doubled GROUP BY document_id, {I.ws('text')}")
def c1_drop_duplicate_chunks(spark, sf_dir):
    return dedup.drop_duplicate_chunks(_doubled(spark, sf_dir)).select("document_id", "chunk_index", "text")


@register(
    f"""WITH {I.LINES}, {_DOUBLED}, r AS (SELECT document_id, chunk_index, text, row_number() OVER (PARTITION BY {I.ws("text")} ORDER BY document_id, chunk_index) AS n FROM doubled)
  SELECT document_id, chunk_index, text FROM r WHERE n = 1"""
)
def c2_compact_corpus(spark, sf_dir):
    return dedup.compact_corpus(_doubled(spark, sf_dir))[0].select("document_id", "chunk_index", "text")


@register(f"WITH {I.LINES}, {_DOUBLED} SELECT count(*) AS before, count(DISTINCT {I.ws('text')}) AS after, count(*) - count(DISTINCT {I.ws('text')}) AS removed FROM doubled")
def c2_compaction_stats(spark, sf_dir):
    return dedup.compact_corpus(_doubled(spark, sf_dir))[1]


def _ids(spark, sf_dir):
    """Ids to delete: every 13th document and one that is unknown."""
    d = I.table(spark, sf_dir, "documents").where("doc_id % 13 = 0").select(F.col("doc_id").cast("string").alias("document_id"))
    return d.unionByName(d.where("document_id = '0'").select(F.lit("unknown").alias("document_id")))


_IDS = "gone AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'unknown')"


@register(f"WITH {I.LINES}, {_IDS} SELECT document_id, count(*) AS chunks FROM lines WHERE document_id NOT IN (SELECT document_id FROM gone) GROUP BY document_id")
def c3_delete_documents(spark, sf_dir):
    kept, _, _ = catalog.delete_documents(I.lines(spark, sf_dir), I.catalogue(spark, sf_dir), _ids(spark, sf_dir))
    return kept.groupBy("document_id").agg(F.count("*").alias("chunks"))


@register(
    f"""WITH {I.LINES}, {_IDS}, n AS (SELECT document_id, count(*) AS n FROM lines GROUP BY 1)
  SELECT document_id, document_id <> 'unknown' AS existed, coalesce(n, 0) AS removed FROM gone LEFT JOIN n USING (document_id)"""
)
def c3_delete_report(spark, sf_dir):
    return catalog.delete_documents(I.lines(spark, sf_dir), I.catalogue(spark, sf_dir), _ids(spark, sf_dir))[2]


@register(
    f"""WITH {I.CATALOGUE}, new AS (SELECT 'new' || id AS id, filename FROM catalogue WHERE CAST(id AS BIGINT) % 9 = 0)
  SELECT id, filename FROM catalogue WHERE filename NOT IN (SELECT filename FROM new) UNION ALL SELECT id, filename FROM new"""
)
def c4_replace_by_filename(spark, sf_dir):
    old, chunks = I.catalogue(spark, sf_dir), I.lines(spark, sf_dir)
    new = old.where("cast(id as bigint) % 9 = 0").withColumn("id", F.concat(F.lit("new"), "id"))
    registry, _ = catalog.replace_by_filename(old, chunks, new, chunks.where("false"))
    return registry.select("id", "filename")


@register(
    f"""WITH {I.CATALOGUE}, new AS (SELECT id, 'v2-' || filename AS filename, uploaded_at + CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 5 ELSE -5 END AS uploaded_at FROM catalogue WHERE CAST(id AS BIGINT) % 5 = 0),
  u AS (SELECT id, filename, uploaded_at FROM catalogue UNION ALL SELECT * FROM new)
  SELECT id, arg_max(filename, uploaded_at) AS filename, max(uploaded_at) AS uploaded_at FROM u GROUP BY id"""
)
def c5_upsert_registry(spark, sf_dir):
    old = I.catalogue(spark, sf_dir).select("id", "filename", F.unix_seconds("uploaded_at").alias("uploaded_at"))
    even = F.when(F.col("id").cast("long") % 2 == 0, 5).otherwise(-5)
    new = old.where("cast(id as bigint) % 5 = 0").select("id", F.concat(F.lit("v2-"), "filename").alias("filename"), (F.col("uploaded_at") + even).alias("uploaded_at"))
    return catalog.upsert_registry(old, new)


@register(f"WITH {I.CATALOGUE} SELECT id, filename, uploaded_at, (SELECT count(*) FROM catalogue) AS total FROM catalogue ORDER BY uploaded_at DESC, id")
def c6_list_documents(spark, sf_dir):
    return catalog.list_documents(I.catalogue(spark, sf_dir)).select("id", "filename", F.unix_seconds("uploaded_at").alias("uploaded_at"), "total")


def _named(spark, sf_dir):
    """Cases that name two known files and, every fourth, one that is missing."""
    b = I.table(spark, sf_dir, "benchmark")
    name = lambda c: F.concat(F.lit("file"), c, F.lit(".txt"))
    return b.select(F.col("item_id").cast("string").alias("id"), F.array(name(F.col("item_id") + 1), name(F.when(F.col("item_id") % 4 == 0, F.lit("X")).otherwise(F.lit("0")))).alias("document_filenames"))


_NAMED = "names AS (SELECT CAST(item_id AS VARCHAR) AS case_id, unnest([0, 1]) AS pos, unnest(['file' || (item_id + 1) || '.txt', CASE WHEN item_id % 4 = 0 THEN 'fileX.txt' ELSE 'file0.txt' END]) AS filename FROM benchmark)"


@register(
    f"""WITH {I.CATALOGUE}, {_NAMED}, latest AS (SELECT filename, arg_max(id, (uploaded_at, id)) AS document_id FROM catalogue GROUP BY filename)
  SELECT case_id, array_to_string(coalesce(list(document_id ORDER BY pos) FILTER (WHERE document_id IS NOT NULL), []), ',') AS document_ids FROM names LEFT JOIN latest USING (filename) GROUP BY case_id"""
)
def c7_resolve_document_ids(spark, sf_dir):
    ids, _ = catalog.resolve_document_ids(_named(spark, sf_dir), I.catalogue(spark, sf_dir))
    return ids.select("case_id", F.array_join("document_ids", ",").alias("document_ids"))


@register(f"WITH {I.CATALOGUE}, {_NAMED} SELECT case_id, array_to_string(list_sort(list(DISTINCT filename)), ',') AS missing FROM names WHERE filename NOT IN (SELECT filename FROM catalogue) GROUP BY case_id")
def c7_missing_files(spark, sf_dir):
    _, missing = catalog.resolve_document_ids(_named(spark, sf_dir), I.catalogue(spark, sf_dir))
    return missing.select("case_id", F.array_join("missing", ",").alias("missing"))


@register("SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN item_id % 6 = 0 THEN 'none-a, none-b' ELSE 'none-b' END AS missing FROM benchmark WHERE item_id % 3 = 0")
def c8_check_scope(spark, sf_dir):
    b = I.table(spark, sf_dir, "benchmark")
    scope = F.when(F.col("item_id") % 6 == 0, F.array(F.lit("none-b"), F.lit("1"), F.lit("none-a"))).when(F.col("item_id") % 3 == 0, F.array(F.lit("none-b"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("0")))
    return catalog.check_scope(b.select(F.col("item_id").cast("string").alias("query_id"), scope.alias("scope")), I.catalogue(spark, sf_dir))


@register(f"WITH {I.LINES} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(DISTINCT document_id) AS chunked_documents FROM lines")
def c9_corpus_health(spark, sf_dir):
    return catalog.corpus_health(I.catalogue(spark, sf_dir), I.lines(spark, sf_dir))


def _stored(spark, sf_dir, chunks=None):
    """The lines (or other chunks) and the catalogue as a corpus on disk."""
    store = ChunkStore(spark, shared_folder(spark, "corpus"))
    store.append(I.lines(spark, sf_dir) if chunks is None else chunks, I.catalogue(spark, sf_dir))
    return store


@register(f"WITH {I.LINES} SELECT chunk_id, document_id, chunk_index, text FROM lines WHERE CAST(document_id AS BIGINT) % 13 <> 0")
def c3_stored_delete(spark, sf_dir):
    """Documents taken out of a corpus on disk, and the chunks that are left there."""
    store = _stored(spark, sf_dir)
    store.delete(_ids(spark, sf_dir))
    return store.chunks().select("chunk_id", "document_id", "chunk_index", "text")


@register(
    f"""WITH {I.LINES}, {I.CATALOGUE}, new AS (SELECT 'new' || id AS id, filename FROM catalogue WHERE CAST(id AS BIGINT) % 7 = 0),
  old AS (SELECT id FROM catalogue WHERE filename IN (SELECT filename FROM new)), kept AS (SELECT document_id, text FROM lines WHERE document_id NOT IN (SELECT id FROM old)),
  rows AS (SELECT document_id, text FROM kept UNION ALL SELECT id, upper(filename) FROM new), named AS (SELECT id, filename FROM catalogue WHERE id NOT IN (SELECT id FROM old) UNION ALL SELECT * FROM new)
  SELECT id, filename, count(document_id) AS chunks, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM named LEFT JOIN rows ON document_id = id GROUP BY ALL"""
)
def c4_stored_replace(spark, sf_dir):
    """New documents in place of those of the same file names in a corpus on disk: registry and chunks after it."""
    store = _stored(spark, sf_dir)
    new = I.catalogue(spark, sf_dir).where("cast(id as bigint) % 7 = 0").withColumn("id", F.concat(F.lit("new"), "id"))
    chunks = new.select(F.concat("id", F.lit(":0")).alias("chunk_id"), F.col("id").alias("document_id"), "filename", F.lit(0).alias("chunk_index"), F.upper("filename").alias("text"))
    empty = [F.lit(None).cast("int").alias("page"), F.lit(None).cast("array<double>").alias("vector")]
    store.replace(chunks.select("*", *empty), new)
    held = store.chunks().groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return store.registry().join(held, "id", "left").select("id", "filename", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"))


@register(
    f"""WITH {I.LINES}, {I.CATALOGUE}, again AS (SELECT id, 'v2-' || filename AS filename, CAST(id AS BIGINT) % 10 = 0 AS bad FROM catalogue WHERE CAST(id AS BIGINT) % 5 = 0),
  rows AS (SELECT document_id, text FROM lines WHERE CAST(document_id AS BIGINT) % 5 <> 0 UNION ALL SELECT id, filename FROM again WHERE NOT bad)
  SELECT c.id, coalesce(a.filename, c.filename) AS filename, coalesce(bad, false) AS rejected, (SELECT count(*) FROM rows WHERE document_id = c.id) AS chunks FROM catalogue c LEFT JOIN again a USING (id)"""
)
def c5_stored_upsert(spark, sf_dir):
    """Documents that come again to a corpus on disk, every other one to be rejected: what stands after two runs are merged."""
    store = _stored(spark, sf_dir)
    again = I.catalogue(spark, sf_dir).where("cast(id as bigint) % 5 = 0").withColumn("filename", F.concat(F.lit("v2-"), "filename"))
    bad = F.col("id").cast("long") % 10 == 0
    chunks = again.where(~bad).select(F.concat("id", F.lit(":0")).alias("chunk_id"), F.col("id").alias("document_id"), "filename", F.lit(0).alias("chunk_index"), F.col("filename").alias("text"))
    store.append(chunks, again.where(~bad), again.where(bad).select(F.col("id").alias("document_id"), "filename", F.lit("no text").alias("reason")))
    store.compact()
    held = store.chunks().groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"))
    known = store.registry().select("id", "filename", F.lit(False).alias("rejected")).union(store.rejects().select("document_id", "filename", F.lit(True)))
    return known.join(held, "id", "left").select("id", "filename", "rejected", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@register(
    f"""WITH {I.LINES}, {_DOUBLED}, r AS (SELECT document_id, chunk_index, text, row_number() OVER (PARTITION BY {I.ws("text")} ORDER BY document_id, chunk_index) AS n FROM doubled)
  SELECT document_id, chunk_index, text FROM r WHERE n = 1"""
)
def c2_stored_compaction(spark, sf_dir):
    """Repeats of the whole corpus taken out of it on disk."""
    rows = _doubled(spark, sf_dir).withColumn("chunk_id", F.concat_ws(":", "document_id", "chunk_index"))
    store = _stored(spark, sf_dir, rows)
    store.compact(runs=0, clean=lambda chunks: dedup.compact_corpus(chunks)[0])
    return store.chunks().select("document_id", "chunk_index", "text")


@register(
    f"""WITH {I.SCORES}, r AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS INTEGER) AS rank
  FROM scores WHERE document_id = '1' OR (q % 60 = 0 AND document_id = '4')) SELECT query_id, rank, chunk_id, score FROM r WHERE rank <= 10"""
)
def d5_stored_scope(spark, sf_dir):
    """Search in a corpus on disk of which only the buckets of the asked documents are read."""
    asked = I.vector_queries(spark, sf_dir)
    asked = asked.withColumn("scope", F.coalesce("scope", F.array(F.lit("1"))))
    store = ChunkStore(spark, shared_folder(spark, "corpus"))
    rows = I.vectors(spark, sf_dir)
    store.append(rows, rows.select(F.col("document_id").alias("id")).distinct())
    return search.knn(asked, store.chunks(scopes=asked), 10, not_self=True).select("query_id", "rank", "chunk_id", "score")
