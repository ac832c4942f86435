"""Citation functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a citation is written, and what stands before it.
_GROUP = r"(?s)(.+?)(?:\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]|\z)"
MARKS = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"


def citation_groups(answer: Column) -> Column:
    """array<struct<claim, markers>>: each citation group with the line before it.

    At least one character precedes a group, so in [1][2][3] the second match is the claim [2] with marker 3. What
    stands behind the last group matches up to the end, without a mark, and is left out; so no place is searched twice.
    """
    before, marks = (F.regexp_extract_all(answer, F.lit(_GROUP), F.lit(i)) for i in (1, 2))
    cited = F.filter(F.zip_with(before, marks, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), lambda x: x["m"] != "")
    numbers = lambda m: F.transform(F.split(m, ","), lambda x: F.regexp_replace(x, r"\s", "").cast("int"))
    return F.transform(cited, lambda x: F.struct(F.substring_index(x["b"], "\n", -1).alias("claim"), numbers(x["m"]).alias("markers")))


def claim_tokens(claim: Column, stopwords: Sequence[str]) -> Column:
    """Distinct ASCII words of more than two characters, lower case, that are no stop words."""
    tokens = F.regexp_extract_all(F.lower(claim), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*stopwords)))


def group_supported(tokens: Column, markers: Column, texts: Column, share: float = 0.25) -> Column:
    """Whether one validly cited text holds enough of the tokens as substrings. texts: lower case, by marker."""
    valid = F.filter(markers, lambda m: (m >= 1) & (m <= F.size(texts)))
    holds = lambda text: F.size(F.filter(tokens, lambda t: F.contains(text, t))) / F.size(tokens) >= share
    backed = F.exists(valid, lambda m: holds(F.get(texts, m - 1)))
    return F.when(F.size(valid) == 0, False).when(F.size(tokens) == 0, True).otherwise(backed)


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, MARKS, " ")


def numbers(c: Column) -> Column:
    """Distinct numbers that stand as whole tokens."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:\.\d+)?)(?![\p{L}\p{N}_])"), F.lit(1)))
