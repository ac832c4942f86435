"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. Each source gets a target: its weight's share of the whole mix, but at most `most` times its size; what is above goes
   to the other sources by weight until none is above. All capped sources of a round are found by one sum, so a round is
   one row, and the rounds end when no further source is capped.
2. Documents are dealt to shards of bounded size inside their source, put in seeded order there and cut into blocks of
   (nearly) `block` words; a block may begin in one document and end in another.
3. All blocks of the mix are apportioned to the sources by the highest quotients votes / 1, / 3, / 5..., votes being the
   target in blocks; then each source's blocks to its shards in the same way, votes being the blocks they hold. Only
   the quotients near the cut are ranked, by a sort by ranges.
4. A shard with n blocks and a quota of q takes every block q div n times and q mod n of them once more: those to which
   a seeded permutation of 0..n-1 (multiplication by a prime beyond n, then a turn) gives the first places.

No block is taken more than `most` times (rounded up), as a shard's quota is at most `most` times its blocks: if a source
is given no more than that, the highest quotients spread it so.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last one; a
null id is put in order as `-`; rows that share an id are documents of their own; all numbers depend on the rows and the
seed alone, not on their order or partitions; an empty table gives no rows; of the documents only id, text and source
are read, so other columns cannot clash. A text of any length is one row of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .session import beside_group, checkpointed

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK = 16
SHARD_WORDS, SHARD_DOCS = 1 << 20, 1 << 12
SEED = 7
#: Primes below 2^31, beyond the number of blocks of any shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)
_SPACE = " \t\n\x0b\x0c\r"
_STEP = 4096  # candidates of one party that are made together


def size_of(text: Column) -> Column:
    """Number of words: each becomes one letter, and white space goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x"), _SPACE, "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size, ...) with weight and target. Sources are weighed in order of their code points, null last."""
    listed = checkpointed(numbered(sources, [F.col("source").asc_nulls_last()], name="place"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    listed = listed.withColumns({"weight": weight, "most": F.col("source_size") * most})
    whole = listed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not whole["weight"]:
        return listed.withColumn("target", F.lit(0.0)).drop("place", "most")
    total, level, capped = share * whole["size"], share * whole["size"] / whole["weight"], 0
    while True:
        above = F.col("most") > F.lit(level) * F.col("weight")  # room is left at this level
        r = listed.agg(F.count_if(~above).alias("n"), F.sum(F.when(~above, F.col("most"))).alias("taken"), F.sum(F.when(above, F.col("weight"))).alias("open")).first()
        if r["n"] == capped or not r["open"]:
            break
        level, capped = (total - (r["taken"] or 0)) / r["open"], r["n"]
    if capped != r["n"]:
        level = float("inf")  # all are capped
    return listed.withColumn("target", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))).drop("place", "most")


def _beside(rows: DataFrame, sums: DataFrame, within: tuple[str, ...], order: list[str]) -> DataFrame:
    """rows beside the sums of their group; without groups there is one row of sums."""
    if within:
        return beside_group(rows, checkpointed(sums), list(within), F.struct(*order))
    return rows.withColumns({c: F.lit(v) for c, v in sums.first().asDict().items()})


def apportion(parties: DataFrame, votes: str, seats: str, order: list[str], *, within: tuple[str, ...] = ()) -> DataFrame:
    """parties with `quota`: the seats of their group (a column, equal inside it), given to the highest quotients votes / (2 s - 1).

    Ties go by `order`, which names a party inside its group. With k parties, a party's seats differ from its share of the
    seats by at most its share of k / 2 and a half, so only about 2 k quotients of a group are compared.
    """
    sums = parties.groupBy(*within).agg(F.sum(votes).alias("__all"), F.count_if(F.col(votes) > 0).alias("__k"), F.max(seats).alias("__seats"))
    rows = _beside(parties, sums, within, order)
    part = F.col(votes) / F.col("__all")
    low = F.greatest(F.ceil(part * (F.col("__seats") - F.col("__k") / 2) - 0.5) - 1, F.lit(0))
    high = F.floor(part * (F.col("__seats") + F.col("__k") / 2) + 0.5) + 1
    rows = checkpointed(rows.where((F.col(votes) > 0) & (F.col("__seats") > 0)).withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).select(*within, *order, votes, "__seats", "__low", "__high"))
    held = rows.groupBy(*within).agg((F.max("__seats") - F.sum("__low")).alias("__rest"))
    steps = rows.select(*within, *order, votes, "__low", "__high", F.explode(F.sequence("__low", F.greatest("__high", "__low") - 1, F.lit(_STEP))).alias("__from"))
    tried = steps.select(*within, *order, votes, F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("__from") + _STEP, "__high"))).alias("__seat"))
    tried = tried.select(*within, *order, (F.col(votes) / (2 * F.col("__seat") - 1)).alias("__quotient"))
    ranked = numbered(tried, [F.desc("__quotient"), *(F.col(c).asc_nulls_last() for c in order)], within=within, name="__rank")
    more = _beside(ranked, held, within, order).where(F.col("__rank") < F.col("__rest")).groupBy(*within, *order).agg(F.count("*").alias("__more"))
    given = rows.select(*within, *order, "__low").join(more, [*within, *order], "left").select(*within, *order, (F.col("__low") + F.coalesce("__more", F.lit(0))).alias("quota"))
    return parties.join(given, [*within, *order], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def _digits(id_: Column, seed: int, first: int) -> Column:
    """Eight hex digits of a digest, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("-"))).cast("binary")), first, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(id, source, size, source_size, target, shard, taken, spans) of every document.

    spans: the parts of the text that the mix takes, as words [start, end) and how often.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sized = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), size_of(F.col(text_col)).alias("size")))
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = checkpointed(targets(sources, weights, share, most))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    dealt = beside_group(sized, sources.select("key", "source_size", "target", shards.alias("shards")), ["key"], "id")
    dealt = dealt.withColumn("shard", F.pmod(_digits(F.col("id"), seed, 1), F.col("shards"))).drop("shards")

    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor((F.col("words") + block // 2) / block))).otherwise(0).cast("long")
    held = checkpointed(dealt.groupBy("key", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", blocks))
    owned = held.groupBy("key").agg(F.sum("blocks").alias("owned"))
    # the target in blocks of the source's own mean length, in thousandths, so that sums are exact
    votes = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("owned") / F.col("source_size") * 1000)).otherwise(0).cast("long")
    voting = sources.join(owned, "key").select("key", "owned", votes.alias("votes"))
    voting = checkpointed(voting)
    seats = ((voting.agg(F.sum("votes")).first()[0] or 0) + 500) // 1000
    quotas = apportion(voting.withColumn("seats", F.lit(seats).cast("long")), "votes", "seats", ["key"]).select("key", F.least("quota", F.col("owned") * most).alias("seats"))
    parties = beside_group(held, checkpointed(quotas), ["key"], "shard")
    quotas = apportion(checkpointed(parties), "blocks", "seats", ["shard"], within=("key",)).select("key", "shard", "words", "blocks", "quota")

    # a shard holds about shard_words words or shard_docs documents; texts are not in these rows
    before = Window.partitionBy("key", "shard").orderBy(_digits(F.col("id"), seed, 9), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("from", F.coalesce(F.sum("size").over(before), F.lit(0))).join(checkpointed(quotas), ["key", "shard"])
    placed = placed.withColumns({
        "whole": F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0),
        "more": F.when(F.col("blocks") > 0, F.expr("quota % blocks")).otherwise(0),
        "factor": F.element_at(F.array(*map(F.lit, PRIMES)), (F.col("shard") % len(PRIMES) + 1).cast("int")).cast("long"),
        "turn": _digits(F.concat_ws("/", "key", "shard"), seed, 17),
    })
    touched = F.when((F.col("size") > 0) & (F.col("blocks") > 0), F.sequence(F.expr("((`from` + 1) * blocks - 1) div words"), F.expr("((`from` + size) * blocks - 1) div words"))).otherwise(F.array().cast("array<bigint>"))

    def span(j: Column) -> Column:
        begin = F.greatest(F.call_function("div", j * F.col("words"), F.col("blocks")), F.col("from")) - F.col("from")
        end = F.least(F.call_function("div", (j + 1) * F.col("words"), F.col("blocks")), F.col("from") + F.col("size")) - F.col("from")
        again = F.pmod(F.col("factor") % F.col("blocks") * j + F.col("turn"), F.col("blocks")) < F.col("more")
        return F.struct(begin.alias("start"), end.alias("end"), (F.col("whole") + again.cast("int")).cast("int").alias("copies"))

    spans = F.filter(F.transform(touched, span), lambda x: x["copies"] > 0)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]) * x["copies"])
    return placed.withColumn("spans", spans).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "shard", taken.alias("taken"), "spans")


def mixed_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, copy, text): what the mix takes, words joined by one blank. Ids must name rows, else ValueError."""
    named = mixed.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("ids")).first()
    if named["n"] != named["ids"]:
        raise ValueError(f"{id_col} must be there and differ from row to row")
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select(id_col, text_col).join(mixed.select(id_col, "spans"), id_col).withColumn("words", words)
    parts = parts.select(id_col, F.transform("spans", lambda x: F.struct(x["copies"].alias("copies"), F.array_join(F.slice("words", x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int")), " ").alias("text"))).alias("spans"))
    rows = parts.select(id_col, F.posexplode("spans").alias("part", "x"))
    return rows.select(id_col, "part", F.explode(F.sequence(F.lit(1), F.col("x.copies"))).alias("copy"), F.col("x.text").alias("text"))
