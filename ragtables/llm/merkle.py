"""A Merkle manifest of a table, kept as strings of concatenated digests.

Leaves of a group are numbered in order and dealt to aligned blocks of fan^depth. A block holds each of its levels as one
string of hex digests: fixed-width substrings of a level are the children of a parent, whose digests make the string of
the next level, and the substrings on both sides of a digest, inside its run, are its siblings. The roots of the blocks
are the leaves of the next round, until a group has one block; the subroots of the groups are then the leaves of one more
tree. Going back, every block hands the siblings above it down to its leaves. Nothing but SHA-256 and substrings of SQL.

Digests are lower-case hex; a node is the SHA-256 of its children's digests as text, one after the other. A level with
one node is the end: a lone leaf is its own subroot, while the last run of a level with several nodes may be a single one
that is hashed again.

Defined results: a null field is written `-`, so a null and an empty text differ; groups come in the order of their bytes,
a null group first; leaves by id, null ids first, rows that share an id by their leaves (equal rows are equal leaves and
interchangeable); the digest of an empty proof is that of the empty string; an empty table gives no rows; only the named
fields are read, so other columns cannot clash. A text of any length is hashed once in the row it stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .session import beside_group, checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, DEPTH = 8, 2
_HEX = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The digest of the values, each written as its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)))


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def _part(level: str, first: Column, n: Column) -> Column:
    """n digests of a level, from the one numbered `first` on."""
    return F.col(level).substr((first * _HEX + 1).cast("int"), (n * _HEX).cast("int"))


def _parents(level: str, fan: int) -> Column:
    """The level above: one digest for each run of `fan`."""
    runs = F.sequence(F.lit(0), (F.ceil(F.length(level) / (fan * _HEX)) - 1).cast("int"))
    return F.array_join(F.transform(runs, lambda i: digest(_part(level, i * fan, F.lit(fan)))), "")


def climb(nodes: DataFrame, *, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """nodes (key, number, digest, total, payload) as (key, payload, number, digest, path, top).

    total: nodes of the key. path: from below to the top, the siblings left and right of the node or of what is above it.
    """
    size = fan**depth
    item = F.struct(F.col("number"), F.col("digest"), F.col("payload"))
    # at most fan^depth rows in a group
    blocks = nodes.groupBy("key", F.expr(f"number div {size}").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("total").alias("total"))
    blocks = blocks.withColumn("level0", F.array_join(F.transform("items", lambda x: x["digest"]), ""))
    for i in range(depth):
        blocks = blocks.withColumn(f"level{i + 1}", F.when(F.col("total") > fan**i, _parents(f"level{i}", fan)))
    levels = [f"level{i}" for i in range(depth + 1)]
    blocks = checkpointed(blocks.withColumn("root", F.coalesce(*reversed(levels))))
    if blocks.where(F.col("total") > size).isEmpty():
        above = blocks.withColumns({"above": F.array().cast("array<struct<l:string,r:string>>"), "top": F.col("root")})
    else:
        roots = blocks.select("key", F.col("block").alias("number"), F.col("root").alias("digest"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.lit(0).alias("payload"))
        upper = climb(roots, fan=fan, depth=depth).select("key", F.col("number").alias("block"), F.col("path").alias("above"), "top")
        above = blocks.join(upper, ["key", "block"])
    rows = above.select("key", *levels, "above", "top", F.explode("items").alias("item"))
    steps = []
    for i in range(depth):
        at = F.expr(f"(item.number % {size}) div {fan**i}")
        place = at % fan
        step = F.struct(_part(f"level{i}", at - place, place).alias("l"), _part(f"level{i}", at + 1, fan - 1 - place).alias("r"))
        steps.append(F.when(F.col(f"level{i + 1}").isNotNull(), step))
    path = F.concat(F.filter(F.array(*steps), lambda x: x.isNotNull()), F.col("above"))
    return rows.select("key", F.col("item.payload").alias("payload"), F.col("item.number").alias("number"), F.col("item.digest").alias("digest"), path.alias("path"), "top")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda held, x: digest(F.concat(x["l"], held, x["r"])))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", *, changed: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, path, other_leaf) of every row: path leads from the leaf to the root.

    changed: for some fields the values that other_leaf is made of, to see whether the manifest notices.
    """
    changed = changed or {}
    key = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))  # n is before s
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), leaf_of(*map(F.col, fields)).alias("digest"), leaf_of(*(changed.get(f, F.col(f)) for f in fields)).alias("other"))
    rows = checkpointed(rows)
    totals = checkpointed(rows.groupBy("key").agg(F.count("*").alias("total")))
    placed = numbered(rows, [F.col("id").asc_nulls_first(), F.col("digest").asc()], within=("key",))
    nodes = beside_group(placed, totals, ["key"], "id")
    leaves = climb(nodes.select("key", "number", "digest", "total", F.struct("id", "other").alias("payload")), fan=fan, depth=depth)
    tops = checkpointed(leaves.groupBy("key").agg(F.first("top").alias("digest")))  # equal in a group
    groups = numbered(tops, [F.col("key").asc()]).withColumn("total", F.lit(tops.count()).cast("long"))
    roots = climb(groups.select(F.lit("").alias("key"), "number", "digest", "total", F.col("key").alias("payload")), fan=fan, depth=depth)
    roots = checkpointed(roots.select(F.col("payload").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("upper"), F.col("top").alias("root")))
    found = beside_group(leaves, roots, ["key"], "number")
    return found.select(F.col("payload.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "upper").alias("path"), F.col("payload.other").alias("other_leaf"))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""))


def verified(listed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A manifest's rows with the digest of each proof and whether other_leaf still leads to the root."""
    folded = listed.withColumn("folded_root", fold(F.col("other_leaf"), F.col("path")))
    return folded.select(id_col, "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(text: Column, id_: Column) -> Column:
    """The text in lower case where 3 divides the CRC-32 of the id in decimal, elsewhere as it is."""
    return F.when(F.crc32(id_.cast("string").cast("binary")) % 3 == 0, lowered(text)).otherwise(text)
