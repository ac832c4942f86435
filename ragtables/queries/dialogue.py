"""Conversation memory (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory
from ..params import REFERENTIAL
from . import inputs as I

QUERIES, ORACLES, register = I.registry()
N = 4
_TURNS = "turns AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant'))"
_LABEL = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text"


def _turns(spark, sf_dir):
    return memory.dialogue(I.table(spark, sf_dir, "conversations"))


@register(f"WITH {_TURNS} SELECT conv_id, turn, coalesce(array_to_string(list(turn || role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING), ','), '') AS history FROM turns")
def i1_recent_turns(spark, sf_dir):
    rows = memory.recent_turns(_turns(spark, sf_dir), N)
    return rows.select("conv_id", "turn", F.array_join(F.transform("history", lambda t: F.concat(t["turn"].cast("string"), t["role"])), ",").alias("history"))


_REF = r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(REFERENTIAL) + r")(?:$|[^\p{L}\p{N}_])"
_NEEDS = rf"coalesce(has > 0, false) AND (regexp_matches(text, '{_REF}', 'i') OR (CASE WHEN {I.strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({I.strip('text')}, '[{I.SPACES}]+')) END) < 6)"

CONTEXTUALIZED = f"""WITH {_TURNS}, w AS (SELECT *, count(*) OVER f AS has, last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER f AS said FROM turns WINDOW f AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING))
  SELECT conv_id, turn, {_NEEDS} AS needs_context, CASE WHEN {_NEEDS} AND said IS NOT NULL THEN said || ' — follow-up: ' || text ELSE text END AS standalone FROM w WHERE role = 'user'"""


@register(CONTEXTUALIZED)
def i2_i3_contextualize(spark, sf_dir):
    return memory.contextualize(_turns(spark, sf_dir), N).select("conv_id", "turn", "needs_context", "standalone")


@register(f"WITH {_TURNS} SELECT conv_id, turn, coalesce(array_to_string(list({_LABEL}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), chr(10)), '') AS block FROM turns")
def i4_history_block(spark, sf_dir):
    rows = memory.recent_turns(_turns(spark, sf_dir), 10)
    return rows.select("conv_id", "turn", memory.history_block(F.col("history")).alias("block"))


@register(
    f"""WITH {_TURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns)
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE back <= {N}) AS kept, min(turn) AS created, max(turn) AS updated FROM b GROUP BY conv_id"""
)
def i5_conversation_state(spark, sf_dir):
    rows = memory.conversation_state(_turns(spark, sf_dir), N)
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("kept"), "created", "updated")


def _ids(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.where("conv_id % 5 = 0").union(c.where("conv_id = 0").select(F.lit(-1).cast("long")))


@register("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 = 0 AND role <> 'system'")
def i6_get_conversations(spark, sf_dir):
    return memory.get_conversations(_turns(spark, sf_dir), _ids(spark, sf_dir)).select("conv_id", "turn")


@register("SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0 AND role <> 'system'")
def i6_delete_conversations(spark, sf_dir):
    return memory.delete_conversations(_turns(spark, sf_dir), _ids(spark, sf_dir))[0].select("conv_id", "turn")


@register(f"WITH {_TURNS}, i AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT -1) SELECT conv_id, conv_id IN (SELECT conv_id FROM turns) AS deleted FROM i")
def i6_delete_report(spark, sf_dir):
    return memory.delete_conversations(_turns(spark, sf_dir), _ids(spark, sf_dir))[1]


_OUT = "CASE WHEN turn % 3 = 0 THEN '  ' || chr(10) ELSE chr(10) || '  ' || replace(text, ' ', '  ') || chr(10) || 'more' END"


@register(rf"""SELECT conv_id, turn, coalesce(nullif({I.strip("regexp_replace(string_split(" + I.strip(_OUT) + ", chr(10))[1], '[" + I.SPACES + "]+', ' ', 'g')")}, ''), text) AS query FROM conversations""")
def i7_parse_standalone(spark, sf_dir):
    output = F.when(F.col("turn") % 3 == 0, "  \n").otherwise(F.concat(F.lit("\n  "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\nmore")))
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", memory.parse_standalone(output, F.col("text")).alias("query"))
