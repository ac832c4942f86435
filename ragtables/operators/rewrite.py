"""Query rewriting over a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.queries import normalize_query, variants
from ..params import RULES, Rule


def rewrite_queries(queries: DataFrame, n: int = 3, rules: tuple[Rule, ...] = RULES, *, enabled: bool = True, paraphrase_col: str | None = None) -> DataFrame:
    """queries exploded to rows (..., variant_no, variant); variant 0 is the query itself."""
    every = variants(F.col("query"), n, rules, F.col(paraphrase_col) if paraphrase_col else None) if enabled else F.array(normalize_query(F.col("query")))
    return queries.select("*", F.posexplode(every).alias("variant_no", "variant"))
