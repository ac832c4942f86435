"""Nearest neighbours with an inverted multi-index.

The two halves of the vectors are quantised apart, so K centroids a side give K*K
cells. A query walks the cells by the sum of its two half distances with a heap,
until the cells it has passed hold the wanted share of all vectors and at least
k besides those of its own id, and all entries of these cells are reranked by
their exact distance. Vectors and queries travel in packed blocks of bounded
size, and each block of queries meets each block of its cell by a key of cell and
block, so a crowded cell (or a vector that a third of all rows repeat) is many
tasks.

Centroids are fitted on at most `sample` vectors; every vector is indexed.

Defined results: vectors that are null, zero, of another dimension than most, or
hold a null or non-finite component, and rows without an id, take no part; ties
go to the smaller id; rows that share an id are each a candidate, but for the
query of that id; a query gets all candidates where there are fewer than k; an
empty table gives no rows; only id and vector are read, so other columns cannot
clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import mix, pack

SAMPLE = 20_000
SHARE = 0.75
BLOCK, QUERIES = 512, 128


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    r = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[r.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in the order of left[i] + right[j] until they hold `enough` vectors."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, held = [(left[a[0]] + right[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(right) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (left[a[p]] + right[b[q]], p, q))
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, queries: F.Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, share: float = SHARE, sample: int = SAMPLE, centroids: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that satisfy `queries`, a condition on the id column named id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    shape = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], shape)
    d, n = sizes[0]["d"], sizes[0]["count"]
    half = max(1, d // 2)
    rows = rows.where(F.size("v") == d)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(max(1, 1_000_000 * sample // n))).limit(2 * sample) if n > sample else rows
    x = np.array([r["v"] for r in some.select("v").toLocalIterator()], np.float64).reshape(-1, d)
    if not len(x):
        x = np.array([r["v"] for r in rows.select("v").limit(sample).collect()], np.float64)
    side = centroids or int(min(64, max(8, round((n / 80) ** 0.5))))
    c1, c2 = kmeans(x[:, :half], side), kmeans(x[:, half:], side) if d > half else np.zeros((1, 0))
    cells = len(c1) * len(c2)

    def cell_of(v: np.ndarray) -> np.ndarray:
        return nearest(v[:, :half], c1) * len(c2) + (nearest(v[:, half:], c2) if d > half else 0)

    def occupancy(batches):
        count = np.zeros(cells, np.int64)
        for batch in batches:
            count += np.bincount(cell_of(_matrix(batch.column("v"), d)), minlength=cells)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["cell", "n"])

    held = np.zeros(cells, np.int64)
    for r in rows.mapInArrow(occupancy, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most 64 * 64 cells
        held[r["cell"]] = r["n"]

    def entries(batches):
        for batch in batches:
            v, ids = _matrix(batch.column("v"), d), batch.column("id").to_numpy(zero_copy_only=False)
            cell = cell_of(v)
            part = (mix(ids.astype(np.uint64) + np.uint64(3)) % np.maximum(1, -(-held[cell] // BLOCK)).astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part), batch.column("id"), pa.array([row.tobytes() for row in v], pa.binary())], names=["cell", "part", "id", "v"])

    asked = rows.where(queries)
    own = asked.groupBy("id").agg(F.count("*").alias("own"))  # rows of a query's id: they are no candidates of it
    parts = max(1, -(-asked.count() // QUERIES))

    def visits(batches):
        for batch in batches:
            v, ids = _matrix(batch.column("v"), d), batch.column("id").to_numpy(zero_copy_only=False)
            left = ((v[:, None, :half] - c1) ** 2).sum(2)
            right = ((v[:, None, half:] - c2) ** 2).sum(2)
            part = (mix(ids.astype(np.uint64) + np.uint64(5)) % np.uint64(parts)).astype(np.int32)
            most = batch.column("own").to_numpy(zero_copy_only=False) + k
            for i in range(len(ids)):
                to = walk(left[i], right[i], held, max(int(np.ceil(share * n)), int(most[i])))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([part[i]] * len(to), pa.int32()), pa.array([ids[i]] * len(to), pa.int64()), pa.array([v[i].tobytes()] * len(to), pa.binary())], names=["cell", "part", "id", "v"])

    def block(table: pa.Table) -> pa.Table:
        ids = table["id"].combine_chunks().to_numpy()
        of_cell = max(1, -(-int(held[table["cell"][0].as_py()]) // BLOCK))
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "parts": pa.array([of_cell], pa.int32()), "ids": pa.array([pack(ids)], pa.binary()), "vs": pa.array([b"".join(table["v"].to_pylist())], pa.binary())})

    kind, packed = "cell int, part int, id long, v binary", "cell int, part int, parts int, ids binary, vs binary"
    stored = rows.mapInArrow(entries, kind).groupBy("cell", "part").applyInArrow(block, packed).select("cell", "part", "ids", "vs")
    asking = asked.join(own, "id").select("id", "v", "own").mapInArrow(visits, kind).groupBy("cell", "part").applyInArrow(block, packed)

    def best(q: np.ndarray, v: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((v, far, q))
        q, v, far = q[order], v[order], far[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], v[top], far[top]

    def rerank(batches):
        for batch in batches:
            out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for qi, qv, vi, vv in zip(*(batch.column(c) for c in ("qids", "qvs", "ids", "vs")), strict=True):
                qi, vi = (np.frombuffer(x.as_buffer(), np.int64) for x in (qi, vi))
                q, v = (np.frombuffer(x.as_buffer()).reshape(-1, d) for x in (qv, vv))
                rough = (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T
                rough[qi[:, None] == vi] = np.inf
                kth = np.partition(rough, min(k, rough.shape[1]) - 1, 1)[:, min(k, rough.shape[1]) - 1]
                kth = np.where(np.isfinite(kth), kth, np.finfo(float).max / 4)
                # what rounding could hide is kept until the exact distances are known
                a, b = np.nonzero(rough <= kth[:, None] + 1e-9 * (1 + (q * q).sum(1)[:, None] + np.abs(kth)[:, None]))
                exact = np.sqrt(((q[a] - v[b]) ** 2).sum(1))
                out = best(*(np.concatenate(x) for x in zip(out, (qi[a], vi[b], exact), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "vec_id", "score"])

    asking = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
    pairs = asking.join(stored, ["cell", "part"]).drop("cell", "part")
    found = pairs.mapInArrow(rerank, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
