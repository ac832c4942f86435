"""URL filters: rules first, then trust and distrust spread over the graph of hosts.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's; the longest fitting rule decides. For the other urls the links
between hosts decide: personalised PageRank carries trust along links from hosts
whose urls are allowed, and distrust against the links from hosts whose urls are
blocked (whoever links to a bad host is suspect). A seed weighs as the share of its
urls that the rules allow or block. The same walk from all hosts alike tells how much
could arrive at a host: what does arrive counts as a share of that, so that one of
many hosts that link to a popular blocked one is judged like its only one. A host is
blocked if its distrust (its own share of blocked urls, or that which arrives) is more
than half, and more than its trust.

Everything is DataFrame functions. Links are the absolute references in the pages'
HTML; where there are none between hosts, only the seeds themselves have scores.

Defined results: a null url, or one without ://, has an empty host and path and is
allowed; null HTML has no links; a null id is carried through; repeated rows get
equal verdicts; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, salted_join

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
GROWTH = 1e-3  # of all scores in four rounds, below which the walk ends; what is left falls by the damping every round
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, longer, are asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def _spread(edges: DataFrame, base: DataFrame, rounds: int | None, damping: float) -> DataFrame:
    """(kind, host, score, plain): both walks, from the seeds and from all hosts; edges: kind, src, dst, share; base: kind, host, score, plain."""
    now, before = base, None
    for step in count() if rounds is None else range(rounds):
        # a busy host's links are dealt to several tasks
        met = salted_join(edges, now.withColumnRenamed("host", "src"), ["kind", "src"], "dst")
        sent = met.select("kind", F.col("dst").alias("host"), *((F.lit(damping) * F.col(c) * F.col("share")).alias(c) for c in ("score", "plain")))
        now = sent.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("plain").alias("plain"))
        if step % 4 == 3:
            now = checkpointed(now)
            total = now.agg(F.sum("plain")).first()[0]
            if before is not None and total - before <= GROWTH * total:
                break
            before = total
    return now


def host_scores(urls: DataFrame, links: DataFrame, *, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, trusted, distrusted): scores, and shares of what could arrive or the host's own share of urls.

    urls: host, ruled (verdict or null); links: src, dst, both hosts.
    """
    shares = urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("good").alias("k")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("k"))))
    own = shares.select("host", "n", kinds.alias("s")).where("s.k > 0").select("s.kind", "host", (F.col("s.k") / F.col("n")).alias("weight"))
    pairs = checkpointed(links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").count().select("src", "dst"))
    if pairs.isEmpty():
        base = own.select("kind", "host", "weight", (F.lit(1 - damping) * F.col("weight")).alias("score"), F.lit(1 - damping).alias("plain"))
        now = base.withColumns({"s0": F.col("score"), "p0": F.col("plain")})
    else:
        both = pairs.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(pairs.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        degree = both.groupBy("kind", "src").agg((1 / F.count("*")).alias("share"))
        ends = both.select("kind", F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("weight"))
        nodes = ends.unionByName(own).groupBy("kind", "host").agg(F.max("weight").alias("weight"))
        base = checkpointed(nodes.select("kind", "host", "weight", (F.lit(1 - damping) * F.col("weight")).alias("score"), F.lit(1 - damping).alias("plain")))
        edges = checkpointed(salted_join(both, degree, ["kind", "src"], "dst"))
        now = _spread(edges, base.drop("weight"), rounds, damping)
        now = now.join(base.select("kind", "host", "weight", F.col("score").alias("s0"), F.col("plain").alias("p0")), ["kind", "host"])
    arrived = F.when(F.col("plain") - F.col("p0") > 1e-12, (F.col("score") - F.col("s0")) / (F.col("plain") - F.col("p0"))).otherwise(0.0)
    now = now.withColumn("share", F.greatest("weight", arrived))
    one = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0.0))
    return now.groupBy("host").agg(one("trust", "score").alias("trust"), one("distrust", "score").alias("distrust"), one("trust", "share").alias("trusted"), one("distrust", "share").alias("distrusted"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, rules=RULES, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust, trusted, distrusted) of every row."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "ruled": ruled})
    links = pages.where(F.contains(F.col(html_col), F.lit("//"))).select(host.alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst"))
    scores = host_scores(urls.select("host", "ruled"), links, rounds=rounds, damping=damping)
    judged = salted_join(urls, scores, ["host"], F.struct("path", id_col), "left")
    bad = F.coalesce((F.col("distrusted") > 0.5) & (F.col("distrusted") > F.col("trusted")), F.lit(False))
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    figures = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "trusted", "distrusted")]
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), *figures)
