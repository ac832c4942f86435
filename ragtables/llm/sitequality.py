"""Quality classification by hierarchical empirical Bayes.

A logistic regression over text figures gives each document its own evidence. The
evidence is averaged per host and per path (a part of a host); how far hosts
differ beyond chance sets how strongly a host's mean is pulled to the global one,
and the same between paths and their host. A document's odds are then those of
its text times what its path's posterior says against the global prior. Sparse
sites hardly move; a large site speaks for itself. All means are grouped sums,
so a host with a third of all rows is pre-aggregated in every task.

The classifier learns from at most `sample` labelled rows (by a hash of the id).

Defined results: null and empty texts are scored like any text without words; a
null host or path is a site of its own; a null id is carried through; repeated
rows get equal scores and count each; an empty table gives no rows; without
labels of both kinds the evidence is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import beside_group, checkpointed
from .stats import shape, text_counts
from .textkit import logistic, sigmoid, slices

SAMPLE = 40_000
THRESHOLD = 0.5


def _figures(column: pa.Array) -> np.ndarray:
    x = shape(text_counts(column))
    return np.hstack([x, x[:, 2:5] ** 2, x[:, :1] ** 2 / 10])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights of the text classifier and the share of good labels."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min((F.col(label_col) > 0).cast("int")).alias("__y"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * sample // n)))
    known = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(labels.limit(2 * sample)), id_col).select("__text", "__y")  # bounded by the sample

    def run(batches):
        for batch in slices(batches, "__text", 2 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(list(_figures(batch.column("__text"))), pa.list_(pa.float64())), batch.column("__y")], names=["x", "y"])

    rows = known.mapInArrow(run, "x array<double>, y int").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return np.zeros(0), float(y.mean()) if len(y) else 0.5
    return logistic(np.stack(rows["x"].to_numpy()), y), float(y.mean())


def evidence(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(id, host, path, h, p): what each text says by itself; h is a fingerprint of text, host and path."""
    weights, share = model
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    frame = docs.select(F.col(id_col).alias("__id"), name(host_col).alias("host"), name(path_col).alias("path"), _print(text_col, host_col, path_col).alias("h"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches, "__text", 2 << 20):
            p = sigmoid(_figures(batch.column("__text")) @ weights[:-1] + weights[-1]) if len(weights) else np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(p, 1e-6, 1 - 1e-6))], names=["__id", "host", "path", "h", "p"])

    return frame.mapInArrow(run, f"__id {frame.schema[0].dataType.simpleString()}, host string, path string, h long, p double")


def _print(text_col: str, host_col: str, path_col: str) -> Column:
    return F.xxhash64(*(F.col(c).cast("string") for c in (text_col, host_col, path_col)))


def posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, host_mean, path_mean, prior) with both means shrunk."""
    paths = checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))

    def strength(groups: DataFrame, n: str, s: str, q: str, within: str) -> DataFrame:
        """One row: pseudo-count k = noise within / variance between groups, by moments (at least 1)."""
        mean = F.col(s) / F.col(n)
        noise = F.sum(F.col(q) - F.col(s) * mean) / F.greatest(F.sum(F.col(n) - 1), F.lit(1))
        base = groups.withColumn("__c", F.col(within))
        between = (F.sum(F.col(n) * (mean - F.col("__c")) ** 2) - noise * F.greatest(F.count("*") - 1, F.lit(0))) / F.greatest(F.sum(F.col(n)) - F.sum(F.col(n) * F.col(n)) / F.sum(F.col(n)), F.lit(1))
        return base.agg(F.least(F.greatest(noise / F.greatest(between, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6)).alias("k"))

    # each of these has one row
    whole = hosts.agg((F.sum("hs") / F.sum("hn")).alias("prior"))
    hosts = hosts.join(F.broadcast(whole))
    hosts = hosts.join(F.broadcast(strength(hosts, "hn", "hs", "hq", "prior")))
    hosts = hosts.select("host", "prior", ((F.col("hs") + F.col("k") * F.col("prior")) / (F.col("hn") + F.col("k"))).alias("host_mean"))
    paths = paths.join(hosts, "host")
    paths = paths.join(F.broadcast(strength(paths, "n", "s", "q", "host_mean")))
    return paths.select("host", "path", "host_mean", ((F.col("s") + F.col("k") * F.col("host_mean")) / (F.col("n") + F.col("k"))).alias("path_mean"), "prior")


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, evidence, host_mean, path_mean, score, predicted (1: good)."""
    rows = _judged(docs, labels, id_col, text_col, host_col, path_col, threshold=threshold, sample=sample)
    return rows.select(F.col("__id").alias(id_col), F.col("p").alias("evidence"), "host_mean", "path_mean", "score", "predicted")


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    rows = checkpointed(evidence(docs, fit(docs, labels, id_col, text_col, sample=sample), id_col, text_col, host_col, path_col))
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    score = 1 / (1 + F.exp(-(logit("p") + logit("path_mean") - logit("prior"))))
    beside = beside_group(rows, checkpointed(posteriors(rows)), ["host", "path"], "h")
    return beside.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **options) -> DataFrame:
    """docs without those that are predicted poor. Rows are judged each, also those without an id or with the same one:
    a verdict follows from text, host and path."""
    poor = _judged(docs, labels, id_col, text_col, host_col, path_col, **options).where("predicted = 0").select(F.col("__id").alias("__poor"), F.col("h").alias("__h"))
    return docs.join(poor, F.col(id_col).eqNullSafe(F.col("__poor")) & (_print(text_col, host_col, path_col) == F.col("__h")), "left_anti")
