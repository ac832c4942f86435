"""Conversation memory over tables of turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from ..params import AFTER, BEFORE, REFERENTIAL, SPACES

ROLES = ("user", "assistant")


def dialogue(turns: DataFrame) -> DataFrame:
    """The turns of the roles that memory knows."""
    return turns.where(F.col("role").isin(*ROLES))


def _before(n: int):
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)


def recent_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """turns with history, the up to n messages before each: array<struct<turn, role, text>>."""
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    held = F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")).over(_before(n)) if n > 0 else empty
    return turns.withColumn("history", held)


def referential(query: Column) -> Column:
    return F.rlike(query, F.lit(f"(?i){BEFORE}(?:{'|'.join(REFERENTIAL)}){AFTER}"))


def needs_context(query: Column, has_history: Column) -> Column:
    """Whether a query leans on what was said before: it refers to it, or is shorter than six words."""
    return has_history & (referential(query) | (word_count(query) < 6))


def contextualized(query: Column, has_history: Column, last_user: Column) -> Column:
    """The query behind the last user message, where it needs one and there is one."""
    return F.when(needs_context(query, has_history) & last_user.isNotNull(), F.concat(last_user, F.lit(" — follow-up: "), query)).otherwise(query)


def contextualize(turns: DataFrame, n: int = 10) -> DataFrame:
    """User turns with needs_context and standalone, the query to search for."""
    if n <= 0:
        return turns.where("role = 'user'").withColumns({"needs_context": F.lit(False), "standalone": F.col("text")})
    w = _before(n)
    rows = turns.withColumns({"__has": F.count("*").over(w) > 0, "__user": F.last(F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("text")), True).over(w)})
    return rows.where("role = 'user'").withColumns({"needs_context": needs_context(F.col("text"), F.col("__has")), "standalone": contextualized(F.col("text"), F.col("__has"), F.col("__user"))}).drop("__has", "__user")


def history_block(history: Column) -> Column:
    """The last six messages of a history as labelled lines."""
    last = F.when(F.size(history) > 6, F.slice(history, -6, 6)).otherwise(history)
    return F.array_join(F.transform(last, lambda t: F.concat(F.when(t["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), t["text"])), "\n")


SALTS = 16


def last_messages(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each thread.

    First the last n of each thread and salt, then of these: the limit applies before rows are shuffled, and a thread of
    any length is many groups.
    """
    late = [F.desc("turn"), F.desc("role"), F.desc("text")]
    salted = turns.withColumn("__salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
    some = salted.withColumn("__back", F.row_number().over(Window.partitionBy("conv_id", "__salt").orderBy(*late))).where(F.col("__back") <= n)
    return some.withColumn("__back", F.row_number().over(Window.partitionBy("conv_id").orderBy(*late))).where(F.col("__back") <= n).drop("__salt", "__back")


def conversation_state(turns: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, turns, created, updated): the last n messages of each thread (n <= 0: all), first and last turn number."""
    kept = last_messages(turns, n) if n > 0 else turns
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("created"), F.max("turn").alias("updated"))
    held = kept.groupBy(F.col("conv_id").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return ends.join(held, F.col("conv_id").eqNullSafe(F.col("__of"))).select("conv_id", "turns", "created", "updated")


def get_conversations(turns: DataFrame, ids: DataFrame) -> DataFrame:
    return turns.join(ids.select("conv_id"), "conv_id", "left_semi")


def delete_conversations(turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns that stay, and per id whether there was a thread."""
    ids = ids.select("conv_id").distinct()
    known = turns.select("conv_id", F.lit(True).alias("__d")).distinct()
    return turns.join(ids, "conv_id", "left_anti"), ids.join(known, "conv_id", "left").select("conv_id", F.coalesce("__d", F.lit(False)).alias("deleted"))


def parse_standalone(output: Column, query: Column) -> Column:
    """First line of an external rewriter's output, blanks collapsed; the query itself if that is empty."""
    line = F.regexp_replace(F.split(strip(output), r"\r\n|\r|\n")[0], f"[{SPACES}]+", " ")
    return F.coalesce(F.nullif(strip(line), F.lit("")), query)
