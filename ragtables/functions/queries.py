"""Query rewriting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import AFTER, BEFORE, IDENTIFIER, LEADING_WORDS, QUESTION_WORDS, RULES, SPACES, Rule
from .text import strip


def normalize_query(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACES}]+", " "))


def keyword_variant(query: Column) -> Column:
    """ASCII words of more than two characters that are no question words; null if that is nothing or the query itself."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.array_join(F.filter(tokens, lambda t: ~t.isin(*QUESTION_WORDS) & (F.length(t) > 2)), " ")
    return F.when((kept != "") & (kept != F.lower(query)), kept)


def stripped_variant(query: Column) -> Column:
    """The query without a leading question word; null if that is nothing or the query itself."""
    lead = rf"(?i)^\s*(?:{'|'.join(LEADING_WORDS)})(?![\p{{L}}\p{{N}}_])[\s,]*"
    rest = F.regexp_replace(F.regexp_replace(query, lead, ""), r"^[ ?.]+|[ ?.]+$", "")
    return F.when((rest != "") & (F.lower(rest) != F.lower(query)), rest)


def first_identifier(query: Column) -> Column:
    return F.regexp_extract(query, rf"{BEFORE}({IDENTIFIER}){AFTER}", 1)


def extract_identifiers(query: Column) -> Column:
    """Identifiers that the query names, lower case, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(rf"(?<![\p{{L}}\p{{N}}_])({IDENTIFIER})(?![\p{{L}}\p{{N}}_])"), F.lit(1)))


def rule_variant(query: Column, rule: Rule) -> Column:
    """The rule's expansion where the query matches it, else null."""
    hit = F.rlike(query, F.lit(rule.pattern))
    if rule.identifier is None:
        return F.when(hit, F.lit(rule.expansion))
    named = F.regexp_extract(query, rf"{BEFORE}({rule.identifier}){AFTER}", 1)
    before, _, after = rule.expansion.partition("{}")
    return F.when(hit & (named != ""), F.concat(F.lit(before), named, F.lit(after)))


def parse_paraphrases(text: Column) -> Column:
    """Lines of an external rewriter's output, without numbering, bullets and quotes."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(strip(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*])\s*", "")), '^"+|"+$', ""))
    return F.filter(F.transform(lines, normalize_query), lambda x: x != "")


def variants(query: Column, n: int = 3, rules: tuple[Rule, ...] = RULES, paraphrases: Column | None = None) -> Column:
    """[query, rule variants, base variants]: each once ignoring case, at most n + 1 and one more per matching rule."""
    q = normalize_query(query)
    ruled = [rule_variant(q, r) for r in rules]
    base = F.filter(F.array(keyword_variant(q), stripped_variant(q)), lambda x: x.isNotNull())
    if paraphrases is not None:
        base = F.when(F.size(F.coalesce(paraphrases, F.array().cast("array<string>"))) > 0, paraphrases).otherwise(base)
    every = F.concat(F.filter(F.array(q, *ruled), lambda x: x.isNotNull()), base)
    once = F.filter(every, lambda x, i: (x != "") & (F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1))
    extra = sum((r.isNotNull().cast("int") for r in ruled), F.lit(0))
    return F.slice(once, F.lit(1), F.lit(n + 1) + extra)
