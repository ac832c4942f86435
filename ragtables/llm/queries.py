"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm, merkle, mixing, multiindex, neardup, outliers, packing, pieces, resampling, sitequality, substrings, toxicity, urltrust
from .session import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.held_out("doc_id", 7)
    scored = lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: piece count, digest of the ids, digest of the decoded text."""
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = F.sha2(F.array_join("ids", ",").cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return sitequality.site_quality(docs, labels.where(~toxicity.held_out("doc_id")))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge_urls(table(spark, sf_dir, "pages"))


def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), changed=changed))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Windows of 13 words, the smallest document of each, and the words that no later window covers.
_OP2 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
  win AS (SELECT doc_id, unnest(range(1, len(l) - 11)) AS i, l FROM w WHERE len(l) >= 13),
  seq AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS s FROM win),
  late AS (SELECT doc_id, i FROM seq JOIN (SELECT s, min(doc_id) AS first FROM seq GROUP BY s) USING (s) WHERE first < doc_id),
  gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(13) t(k)),
  words AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS word FROM w),
  marked AS (SELECT words.doc_id, words.i, word, gone.i IS NOT NULL AS removed FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i),
  sums AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE removed) AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM marked GROUP BY doc_id)
  SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums USING (doc_id)"""


#: crc32 of the bytes of a text x, by the bits of each byte.
_CRC = """xor(list_reduce(list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex({x}), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)),
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda r, k: xor(r >> 1, (r & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Runs of one and two words, the buckets of the distinct ones, gains, weights and ranks.
_OP11 = f"""WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
  w AS (SELECT side, id, regexp_extract_all({_LOW.format(x="coalesce(text, '')")}, '{_ALNUM}') AS l FROM texts),
  f AS (SELECT side, id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS g FROM w),
  n AS (SELECT side, id, g, count(*) AS n FROM f GROUP BY ALL),
  b AS (SELECT g, {_CRC.format(x="g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM n)),
  c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM n JOIN b USING (g) GROUP BY bucket),
  z AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM c),
  gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM c, z),
  sums AS (SELECT id, sum(n) AS n, sum(n * gain) AS total FROM n JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
  docs AS (SELECT id AS doc_id, len(l) AS n_words, coalesce(sums.n, 0)::BIGINT AS n_features, coalesce(floor(total / sums.n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN sums USING (id) WHERE side = 0),
  scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs),
  ranked AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS r, 25 * count(*) FILTER (WHERE n_words >= 20) OVER () // 100 AS most FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= most THEN r END AS rank FROM ranked"""

#: Targets by the level at which the open sources stand, blocks by the highest quotients, places by running sums.
_OP12 = r"""WITH sized AS (SELECT doc_id, coalesce('s' || source, 'n') AS key, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
  src AS (SELECT key, source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY ALL),
  weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM src),
  levels AS (SELECT *, 2 * source_size / weight AS r, sum(2 * source_size) OVER o AS capped, sum(weight) OVER () - sum(weight) OVER o AS open, lead(2 * source_size / weight) OVER o AS next
    FROM weighed WINDOW o AS (ORDER BY 2 * source_size / weight, key ROWS UNBOUNDED PRECEDING)),
  found AS (SELECT total / sum(weight) AS level, 0 AS capped FROM weighed GROUP BY total HAVING total / sum(weight) < min(2 * source_size / weight)
    UNION ALL SELECT (total - capped) / open, capped FROM levels WHERE open > 0 AND (total - capped) / open >= r AND (total - capped) / open < next),
  level AS (SELECT coalesce((SELECT level FROM found ORDER BY capped LIMIT 1), 'infinity'::DOUBLE) AS level),
  targets AS (SELECT key, source_size, n_docs, least((2 * source_size)::DOUBLE, level * weight) AS target,
    greatest(1, ceil(source_size / 1048576), ceil(n_docs / 4096))::BIGINT AS shards FROM weighed, level),
  dealt AS (SELECT sized.*, source_size, target, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard, ('0x' || substr(h, 9, 8))::BIGINT AS seat FROM sized JOIN targets USING (key)),
  held AS (SELECT key, shard, sum(size)::BIGINT AS words, CASE WHEN sum(size) > 0 THEN greatest(1, (sum(size) + 8) // 16) ELSE 0 END::BIGINT AS blocks FROM dealt GROUP BY ALL),
  owned AS (SELECT key, sum(blocks)::BIGINT AS owned FROM held GROUP BY key),
  votes AS (SELECT key, owned, CASE WHEN source_size > 0 THEN floor(target * owned / source_size * 1000) ELSE 0 END::BIGINT AS votes FROM targets JOIN owned USING (key)),
  seats AS (SELECT (sum(votes) + 500) // 1000 AS seats FROM votes),
  q1 AS (SELECT key, row_number() OVER (ORDER BY votes / (2 * s - 1) DESC, key) AS r FROM votes, unnest(range(1, 2 * owned + 3)) t(s) WHERE votes > 0),
  quota AS (SELECT key, least(count(*), any_value(2 * owned)) AS seats FROM q1 JOIN votes USING (key) WHERE r <= (SELECT seats FROM seats) GROUP BY key),
  q2 AS (SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY blocks / (2 * s - 1) DESC, shard) AS r FROM held, unnest(range(1, 2 * blocks + 3)) t(s) WHERE blocks > 0),
  given AS (SELECT key, shard, count(*) AS quota FROM q2 JOIN quota USING (key) WHERE r <= seats GROUP BY ALL),
  placed AS (SELECT dealt.*, words, blocks, coalesce(quota, 0) AS quota, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY seat, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f,
    [2147483647, 2147483629, 2147483587, 2147483579, 2147483563][shard % 5 + 1] AS factor, ('0x' || substr(md5('7:' || key || '/' || shard), 17, 8))::BIGINT AS turn
    FROM dealt JOIN held USING (key, shard) LEFT JOIN given USING (key, shard)),
  parts AS (SELECT doc_id, f, size, words, blocks, quota, factor, turn, unnest(range(((f + 1) * blocks - 1) // words, ((f + size) * blocks - 1) // words + 1)) AS j FROM placed WHERE size > 0),
  sums AS (SELECT doc_id, sum((least((j + 1) * words // blocks, f + size) - greatest(j * words // blocks, f)) * (quota // blocks + CASE WHEN (factor % blocks * j + turn) % blocks < quota % blocks THEN 1 ELSE 0 END))::BIGINT AS taken FROM parts GROUP BY doc_id)
  SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN sums USING (doc_id)"""

_FIELD = "coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

#: The levels of each language's tree, then of the tree of their roots; siblings of each leaf in order, folded back.
_OP13 = f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('s' || lang, 'n') AS key, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_LEAF.format(text=_LOW.format(x="text"))} ELSE {_LEAF.format(text="text")} END AS other FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
  tree AS (SELECT key, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY key) AS n FROM placed
    UNION ALL SELECT key, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY key, level, i // 8),
  subroots AS (SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
  crown AS (SELECT 0 AS level, g AS i, subroot AS digest, n FROM subroots
    UNION ALL SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 7) // 8) FROM crown WHERE n > 1 GROUP BY level, i // 8),
  steps AS (SELECT p.doc_id, p.leaf, t.level, string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i < p.i // (8 ** t.level)::BIGINT) AS l, string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i > p.i // (8 ** t.level)::BIGINT) AS r
      FROM placed p JOIN tree t ON t.key = p.key AND t.i // 8 = p.i // (8 ** (t.level + 1))::BIGINT WHERE t.n > 1 GROUP BY ALL
    UNION ALL SELECT p.doc_id, p.leaf, 1000 + t.level, string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i < g // (8 ** t.level)::BIGINT), string_agg(t.digest, '' ORDER BY t.i) FILTER (WHERE t.i > g // (8 ** t.level)::BIGINT)
      FROM placed p JOIN subroots USING (key) JOIN crown t ON t.i // 8 = g // (8 ** (t.level + 1))::BIGINT WHERE t.n > 1 GROUP BY ALL),
  paths AS (SELECT doc_id, leaf, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY level) AS path FROM steps GROUP BY ALL),
  done AS (SELECT p.doc_id, p.leaf, subroot, (SELECT digest FROM crown WHERE n = 1) AS root, coalesce(path, []) AS path, other FROM placed p JOIN subroots USING (key) LEFT JOIN paths USING (doc_id, leaf)),
  folded AS (SELECT *, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, list_reduce(path, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), other) AS folded_root FROM done)
  SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _OP2, "op11_prefix_crc_resampling": _OP11, "op12_sainte_lague_mixing": _OP12, "op13_merkle_manifest": _OP13}
