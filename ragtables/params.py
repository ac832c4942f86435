"""Parameters of the jobs and the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    """A fixed expansion of queries that match a pattern (and, if given, name an identifier)."""

    name: str
    pattern: str
    expansion: str
    identifier: str | None = None


#: Fixed values. What counts as a letter, digit or underscore; edges of words are written with it,
#: because engines differ on what \b means beside accented letters.
WORD = r"[\p{L}\p{N}_]"
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

#: The characters that count as white space (one class for all engines), and the same one by one.
SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARACTERS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Words that a keyword variant of a query leaves out.
QUESTION_WORDS = (
    "what which who whom whose when where why how is are was were do does did can could should would will "
    "the a an of to in on for and or me tell about please"
).split()
#: Question words that may lead a query.
LEADING_WORDS = "what which who when where why how is are do does did can could should would will".split()
#: Words that do not count as evidence for a claim; the metric uses a shorter list.
VALIDATION_STOPWORDS = (
    "a an the and or to of in on for is are was were be with at by from that this it you your can will if as when which"
).split()
METRIC_STOPWORDS = "a an the and or to of in on for is are was were be with at by from that this it".split()
#: Words that refer to what was said before.
REFERENTIAL = "it its they them their that those this these also more above earlier previous same another else instead".split()
#: Identifiers such as m5.xlarge.
IDENTIFIER = r"[A-Za-z]\d+[A-Za-z]?\.[A-Za-z][A-Za-z0-9]*"
#: Queries about memory families.
FAMILY = r"memory[- ]?(?:intensive|optimized)" + AFTER + "|" + BEFORE + r"(?:large|high)\s+(?:memory|ram)"
TOPICS, THINGS = r"(?:categor(?:y|ies)|families|types?|kinds?)", r"(?:instance|ec2)"
#: The default query expansions, in the order in which they precede other variants.
RULES = (
    Rule("specification", f"(?i){BEFORE}(?:vcpu|vcpus|memory|gi[b]|ram|bandwidth|network|storage|iops|processor|cores?|threads?){AFTER}", "{} performance specifications vCPUs memory processor", IDENTIFIER),
    Rule("memory family", f"(?i){BEFORE}{FAMILY}{AFTER}", "memory optimized designed deliver fast performance workloads process large data sets in memory"),
    Rule("taxonomy", f"(?is){BEFORE}{TOPICS}{AFTER}(?:.*{BEFORE})?{THINGS}{AFTER}|{BEFORE}{THINGS}{AFTER}(?:.*{BEFORE})?{TOPICS}{AFTER}", "EC2 instance type families general purpose compute optimized memory optimized storage optimized accelerated computing"),
)
#: Texts that answers are compared with or extended by.
REFUSAL = "I couldn't find anything relevant in your uploaded documents to answer that question."
DISCLAIMER = "\n\n_Note: parts of this answer may not be fully supported by the cited sources; please verify against the referenced passages._"
INTRO = "No LLM is configured, so here are the most relevant passages from your documents (cited below):\n\n"
FAILED_INTRO = (
    "The '%s' provider was unavailable, and the local fallback also failed or was not reachable. "
    "Here are the most relevant passages from your documents (cited below):\n\n"
)
SYSTEM = "Answer only from the numbered passages and cite them as [n]."


@dataclass(frozen=True)
class Params:
    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 3
    min_score: float = 0.20
    rerank: bool = True
    retrieve_k: int = 20
    rewrite: bool = True
    num_variants: int = 3
    mmr: bool = True
    mmr_lambda: float = 0.6
    mmr_cap: float = 0.85
    dedupe_jaccard: float = 0.85
    gate: bool = True
    gate_min: float = 0.0
    min_support: float = 0.5
    history: int = 10
    dim: int = 64
    rules: tuple[Rule, ...] = field(default=RULES)

    def __post_init__(self):
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
