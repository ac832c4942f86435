"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text becomes a vector of transformed counts. For every (language, source) a
minimum-covariance-determinant estimate is made by concentration steps that are
grouped aggregations over all rows: keep the share CORE of the rows with the
smallest distances, estimate mean and covariance from these, and repeat. Steps
begin from several starts (medians with usual spreads, and hashed parts of the
rows); after two of them the start with the least determinant goes on, until no
group's determinant falls any more. The covariance of the core is scaled up by
what normal data would have lost, and a last step re-weights. Sources with few
rows are shrunk towards the estimate over all. Rows whose Mahalanobis distance
exceeds the chi-square limit are rejected.

Defined results: a null text has no words and fails the fixed limits; a null
language or source forms a group of its own; a null id is carried through;
repeated rows get equal verdicts, and so do ties at the core's edge, which are all
in it; a text of any length is one vector; an empty table gives no rows; only id,
text and the group columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce
from math import exp, gamma, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import beside_group, checkpointed
from .stats import shape, text_counts
from .textkit import slices

#: Standard deviations that rank the rows for the first step.
START = (1.4, 0.3, 0.3, 0.4, 0.24, 0.16, 0.24, 0.24)
#: Added to every spread against a singular covariance (most texts have no symbol and no repeated line): about what one
#: symbol, line or repeated run adds to a short text. An extreme of any one dimension is still beyond the limit.
FLOOR = (0.2, 0.05, 0.1, 0.15, 0.07, 0.04, 0.06, 0.06)
D = len(FLOOR)
CORE = 0.75
STARTS = 3  # the first from medians, the others from hashed parts of the rows
PART = 4  # one row in so many is in such a part
FALL = 1e-3  # of a log-determinant: less is none
REWEIGHT = 3.0  # normal deviate within which rows count in the last step
PRIOR = 60.0  # rows that the estimate over all counts as
TAIL = 3.5  # normal deviate of the chi-square limit: about two in 10,000 under normality
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi_square(deviate: float, d: int = D) -> float:
    """Quantile of the chi-square distribution at a standard normal deviate."""
    return d * (1 - 2 / (9 * d) + deviate * sqrt(2 / (9 * d))) ** 3


def chi_square_share(x: float, d: int) -> float:
    """Share of the chi-square distribution below x."""
    a, z = d / 2, x / 2
    term = total = 1 / gamma(a + 1)
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return total * z**a * exp(-z)


def core_scale(x: float, d: int = D) -> float:
    """What the covariance of normal rows with squared distances up to x falls short of that of all."""
    return chi_square_share(x, d) / chi_square_share(x, d + 2)


def core_edge(share: float = CORE, d: int = D) -> float:
    """The squared distance within which that share of normal rows lies."""
    low, high = 0.0, 100.0 * d
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, d) < share else (low, mid)
    return low


def measured(docs: DataFrame, id_col: str, text_col: str, groups: tuple[str, ...]) -> DataFrame:
    """Counts and vector of every row, without its text."""
    frame = docs.select(F.col(id_col).alias("__id"), *(F.coalesce(F.col(g).cast("string"), F.lit("\x00")).alias(f"__g{i}") for i, g in enumerate(groups)), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in slices(batches, "__text", 2 << 20):
            c = text_counts(batch.column("__text"))
            x = shape(c)
            columns = batch.columns[:-1] + [pa.array(c[k]) for k in COUNTS] + [pa.ListArray.from_arrays(np.arange(0, x.size + 1, D, dtype=np.int32), x.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *COUNTS, "x"])

    kind = frame.schema[0].dataType.simpleString()
    return frame.mapInArrow(run, f"__id {kind}, " + "".join(f"__g{i} string, " for i in range(len(groups))) + "".join(f"{c} long, " for c in COUNTS) + "x array<double>")


def _distance() -> F.Column:
    """Squared Mahalanobis distance: |w (x - m)|^2 with the upper triangle w."""
    rows, at = [], 0
    for i in range(D):
        terms = []
        for j in range(i, D):
            terms.append(F.col("w")[at] * (F.col("x")[j] - F.col("m")[j]))
            at += 1
        rows.append(reduce(lambda a, b: a + b, terms))
    return reduce(lambda a, b: a + b, (r * r for r in rows))


def _triangle(cov: np.ndarray) -> np.ndarray:
    """Upper triangle w, row by row, with w'w the inverse of the covariance."""
    w = np.linalg.cholesky(np.linalg.inv(cov)).T
    return w[np.triu_indices(D)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(F.col("x")[i]) for i in range(D)] + [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(D) for j in range(i, D)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("s"))


def _estimates(moments: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean, triangle and log-determinant per group and start, shrunk towards the pooled estimate of the start."""
    pooled = moments.groupBy(F.col("__s").alias("__p")).agg(F.sum("n").alias("n0"), F.array(*(F.sum(F.col("s")[i]) for i in range(D + D * (D + 1) // 2))).alias("s0"))
    kinds = ", ".join(f"{k} string" for k in keys)

    def solve(batches):
        for pdf in batches:
            out = [regularised(_central(n, s), _central(n0, s0), n, scale) for n, s, n0, s0 in zip(pdf["n"], pdf["s"], pdf["n0"], pdf["s0"], strict=True)]
            columns = {"m": [m for m, _ in out], "w": [_triangle(c) for _, c in out], "logdet": [float(np.linalg.slogdet(c)[1]) for _, c in out]}
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "__s": pdf["__s"], **columns})

    # a row for each start against the rows of all groups
    return moments.join(F.broadcast(pooled), F.col("__s") == F.col("__p")).mapInPandas(solve, f"{kinds}, __s int, m array<double>, w array<double>, logdet double")


def regularised(own: tuple, all_: tuple, n: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a core of n rows, scaled, shrunk towards those of all groups and floored."""
    (m, c), (m0, c0), k = own, all_, PRIOR / (n + PRIOR)
    return (1 - k) * m + k * m0, scale * ((1 - k) * c + k * c0 + k * (1 - k) * np.outer(m - m0, m - m0)) + np.diag(np.square(FLOOR))


def _central(n: float, s) -> tuple[np.ndarray, np.ndarray]:
    s = np.asarray(s, float)
    m = s[:D] / max(n, 1)
    c = np.zeros((D, D))
    c[np.triu_indices(D)] = s[D:] / max(n, 1)
    c = c + np.triu(c, 1).T
    return m, c - np.outer(m, m)


def _concentrated(rows: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """The estimates from the rows that are nearest by `now`, for each group and start."""
    far = beside_group(rows, now, keys, "x").select(*keys, "__s", "x", _distance().alias("d"))
    limit = checkpointed(far.groupBy(*keys, "__s").agg(F.percentile_approx("d", CORE).alias("limit")))
    near = beside_group(far, limit, [*keys, "__s"], "x").where("d <= limit")
    return checkpointed(_estimates(_moments(near, [*keys, "__s"]), keys, core_scale(core_edge())))


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, w): robust mean and whitening triangle per group, from rows with x."""
    middle = rows.groupBy(*keys).agg(F.array(*(F.percentile_approx(F.col("x")[i], 0.5) for i in range(D))).alias("m"))
    spread = np.diag(np.square(START))
    now = middle.select(*keys, F.lit(0).alias("__s"), "m", F.array(*map(F.lit, _triangle(spread).tolist())).alias("w"), F.lit(0.0).alias("logdet"))
    part = F.pmod(F.xxhash64("x"), F.lit(PART)).cast("int") + 1
    parts = rows.withColumn("__s", part).where(F.col("__s") < STARTS)
    now = checkpointed(now.unionByName(_estimates(_moments(parts, [*keys, "__s"]), keys, 1.0)))
    for _ in range(2):
        now = _concentrated(rows, now, keys)
    least = F.min_by(F.struct("m", "w", "logdet"), F.struct("logdet", "__s")).alias("e")
    now = checkpointed(now.groupBy(*keys).agg(least).select(*keys, F.lit(0).alias("__s"), "e.*"))
    while True:  # every round lowers a determinant that has a least value
        after = _concentrated(rows, now, keys)
        both = checkpointed(now.unionByName(after.withColumn("__s", F.lit(1))))
        falls = both.groupBy(*keys).agg((F.max(F.when(F.col("__s") == 0, F.col("logdet"))) - F.min("logdet")).alias("fall")).where(F.col("fall") > FALL)
        now = both.groupBy(*keys).agg(least).select(*keys, F.lit(0).alias("__s"), "e.*")
        if falls.isEmpty():
            break
        now = checkpointed(now)
    near = beside_group(rows, now, keys, "x").select(*keys, "__s", "x", _distance().alias("d")).where(F.col("d") <= chi_square(REWEIGHT))
    return checkpointed(_estimates(_moments(near, [*keys, "__s"]), keys, core_scale(chi_square(REWEIGHT))).drop("__s", "logdet"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), *, tail: float = TAIL) -> DataFrame:
    """Per row: id, n_words, the counts, base_failed, distance (squared), kept."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    rows = checkpointed(measured(docs, id_col, text_col, groups).withColumn("base_failed", (n < 10) | (100 * repeated > 20 * n)))
    keys = [f"__g{i}" for i in range(len(groups))]
    now = estimates(rows.where("not base_failed"), keys)
    judged = beside_group(rows, now, keys, "x", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square(tail))
    return judged.select(F.col("__id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "distance")
