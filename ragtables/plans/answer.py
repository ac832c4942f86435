"""Batch question answering over retrieved hits and externally produced completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, promote, validate
from ..params import Params


def answer(queries: DataFrame, hits: DataFrame, completions: DataFrame, params: Params = Params(), *, primary: str = "extractive") -> DataFrame:
    """(query_id, answer, provider, grounded) for every query (query_id, query, optional primary: its own provider)."""
    own = F.coalesce("primary", F.lit(primary)) if "primary" in queries.columns else F.lit(primary)
    gate = promote.retrieval_gate(hits, queries, params.gate_min, enabled=params.gate)
    contexts = context.build_grouped_context(hits).join(queries.select("query_id", "query", own.alias("primary")), "query_id")
    prompts = context.build_prompt(contexts)
    answers = context.select_answer(prompts, completions)
    checked = validate.apply_validation(validate.validate_answers(answers, context.group_hits(hits), params.min_support, marker_col="marker"))
    return context.assemble_results(gate, answers, checked)
