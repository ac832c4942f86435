"""Questions in running conversations: from the turns before to the remembered exchange.

The model's completions come from outside, so a job has two halves: `prepare` finds passages and writes the messages,
`conclude` takes the completions, checks the answers and adds both to the turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, memory
from ..params import Params
from ..sources.tables import checkpointed
from . import answer, retrieve


def prepare(turns: DataFrame, asked: DataFrame, chunks: DataFrame, params: Params = Params(), **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, hits, messages) of asked (conv_id, query, optional top_k and scope), at most one row per conversation.

    turns: conv_id, turn, role, text; a conversation without turns begins with its question. questions: query_id (the
    conversation), turn, query, standalone (what is searched for), and what else asked holds. messages: query_id,
    messages; questions without a hit have none.
    """
    held = memory.dialogue(turns).join(asked.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    last = held.groupBy("conv_id").agg(F.max("turn").alias("__last"))
    new = asked.join(last, "conv_id", "left").select("conv_id", (F.coalesce("__last", F.lit(-1)) + 1).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"), F.lit(True).alias("__new"))
    rows = held.withColumn("__new", F.lit(False)).unionByName(new)
    alone = memory.contextualize(rows, params.history).where("__new").select("conv_id", "turn", "standalone")
    questions = checkpointed(asked.join(alone, "conv_id").withColumnRenamed("conv_id", "query_id"))
    past = memory.recent_turns(rows, params.history).where("__new")
    past = past.select(F.col("conv_id").alias("query_id"), F.transform("history", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("history"))
    searched = questions.drop("query", "turn").withColumnRenamed("standalone", "query")
    hits = checkpointed(retrieve.retrieve(searched, chunks, params, **options))
    contexts = context.build_grouped_context(hits).join(questions.select("query_id", "query"), "query_id")
    return questions, hits, context.build_messages(context.build_prompt(contexts), past)


def conclude(turns: DataFrame, questions: DataFrame, hits: DataFrame, completions: DataFrame, params: Params = Params(), *, primary: str = "extractive") -> tuple[DataFrame, DataFrame]:
    """(answers, turns with the exchanges): query_id, answer, provider, grounded; refusals are remembered as well."""
    answers = checkpointed(answer.answer(questions, hits, completions, params, primary=primary))
    said = questions.join(answers, "query_id")
    pair = F.array(F.struct(F.lit(0).alias("i"), F.lit("user").alias("role"), F.col("query").alias("text")), F.struct(F.lit(1).alias("i"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    added = said.select(F.col("query_id").alias("conv_id"), "turn", F.explode(pair).alias("m")).select("conv_id", (F.col("turn") + F.col("m.i")).alias("turn"), "m.role", "m.text")
    return answers, turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(added)
