"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SPACE_CHARACTERS, SPACES


def strip(c: Column) -> Column:
    """c without white space at its edges (all kinds that Unicode has, not only blanks)."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def _where(c: Column, marks: tuple[str, ...], pattern: str, by: str) -> Column:
    """c with the pattern replaced, if it has any of the marks without which the pattern fits nowhere.

    Most texts have none, and looking for a mark is much cheaper than running the pattern. c is made once: it is the
    variable of the function.
    """
    marked = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(m)) for m in marks))
    return F.transform(F.array(c), lambda x: F.when(marked(x), F.regexp_replace(x, pattern, by)).otherwise(x))[0]


def clean_text(c: Column) -> Column:
    """Words broken by a hyphen joined, line ends unified, runs of blanks and empty lines collapsed.

    The hyphen rule looks at line feeds only and comes first, so a break by CR LF stays.
    """
    w = r"[\p{L}\p{N}_]"
    c = _where(c, ("-\n",), rf"({w})-\n({w})", "$1$2")
    c = _where(c, ("\r",), r"\r\n?", "\n")
    c = _where(c, (" \n", "\t\n"), r"[ \t]+\n", "\n")
    c = _where(c, ("\n\n\n",), r"\n{3,}", "\n\n")
    return strip(_where(c, ("  ", "\t"), r"[ \t]{2,}", " "))


def normalize_ws(c: Column) -> Column:
    """Lower case, words joined by single blanks."""
    return strip(F.regexp_replace(F.lower(c), f"[{SPACES}]+", " "))


def normalize_words(c: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as blanks, collapsed."""
    return strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def words(c: Column) -> Column:
    """The words of the normal form; none for an empty text."""
    n = normalize_words(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def split_sentences(c: Column) -> Column:
    """Sentences of all paragraphs, in order, without empty ones."""
    paragraphs = F.split(c, "\n\n")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(strip(p), rf"(?<=[.!?])[{SPACES}]+")))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets; 0 if a side has no word."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def contains_ci(text: Column, part: Column) -> Column:
    """Whether part is in text, ignoring case."""
    return F.contains(F.lower(text), F.lower(part))


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    t = strip(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"[{SPACES}]+")))
