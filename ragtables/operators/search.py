"""Exact top-k search for whole tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import bytes_of
from ..params import Params
from ..sources.tables import BUCKETS, bucket_of, checkpointed
from .encode import check_dimension, embed, embed_queries, hash_encoder  # noqa: F401  (search includes how vectors are made)
from .terms import TermIndex, term_presence, text_slices  # noqa: F401

#: Queries whose vectors are sent to every task by a broadcast; more are packed in groups, each of which meets all chunks.
QUERY_BLOCK = 8192
SCOPE_BLOCK = 1 << 20  # document ids in the scopes of these queries, in all
GROUP = 1 << 14  # queries of a group
PACKED = 8 << 20  # bytes of a packed block of chunks, and of an Arrow batch of such blocks, about
CELLS = 1 << 21  # scores held at once
FIRST = 1024  # rows that are scored in full, before there is a score to beat
FEW = 500_000  # hashes of hits' ids that are broadcast once they are counted
DIGITS = 6  # scores are rounded to this, so that equal texts tie however they were summed
_UNIT = 10**DIGITS
_NEVER = np.iinfo(np.int64).min
IDS = ("chunk_id", "document_id", "chunk_index")


def knn(queries: DataFrame, chunks: DataFrame, k: int | None = None, *, k_col: str | None = None, keep: tuple[str, ...] = (), not_self: bool = False) -> DataFrame:
    """Exact best chunks by inner product: (query_id, rank, chunk_id, document_id, chunk_index, score, keep...).

    queries: query_id, vector, optional scope (array of document ids; null or empty: all) and k_col. Scopes are
    applied before ranking. Every task holds up to QUERY_BLOCK queries and, for each, the ids of its best k chunks so far;
    they are merged batch by batch and leave the task once, at its end, so at most tasks x queries x k slim rows are
    shuffled, however many batches there are. More queries are dealt to groups that meet every part of the chunks in a
    task of their own; they do not pass through the driver, and the chunks are not shuffled but packed once and read once a group. The columns in `keep` are fetched for the final hits alone, in a second
    read of the chunks: if their vectors are computed, they should be stored first. A chunk is named by chunk_id,
    document_id and chunk_index; of rows that share all three, each is a hit, with what one of them has in `keep`.
    Ties: document_id, then chunk_index. Chunks read with their bucket (sources.tables) are only scored for the queries
    whose scope may be in it.
    """
    want = F.col(k_col).cast("int") if k_col else F.lit(k)
    asked = queries.select("query_id", "vector", want.alias("k"), *_scope(queries, chunks))
    source = chunks.where("vector is not null").select(*IDS, "vector", *(["bucket"] if "bucket" in chunks.columns else []))
    kinds = ", ".join([f"query_id {asked.schema['query_id'].dataType.simpleString()}", "k int", *(f"{c} {source.schema[c].dataType.simpleString()}" for c in IDS), "score double"])
    found = beside_queries(asked, source, lambda table, batches: _best(table, batches, not_self), kinds)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "chunk_index")
    hits = found.withColumn("rank", F.row_number().over(best)).where("rank <= k")
    if not k_col:
        hits = hits.where(F.col("rank") <= k)  # a limit that the window can apply by group
    hits = hits.select("query_id", "rank", *IDS, "score")
    others = [c for c in keep if c not in IDS]
    return fetched(hits, chunks, others).select("query_id", "rank", *IDS, *others, "score") if others else hits


def fetched(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """hits with further columns of their chunks. Only the chunks of hits are shuffled or computed upon.

    They are found by the hash of their ids; the join with the hits leaves out what merely has the same hash.
    """
    hits = checkpointed(hits)
    named = F.xxhash64(*IDS).alias("__named")
    names = hits.select(named).distinct()
    small = (lambda df: F.broadcast(df)) if names.count() <= FEW else (lambda df: df)

    def same(a: str, b: str) -> F.Column:
        return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in IDS))

    rows = chunks.select(*IDS, *columns, named).join(small(names), "__named", "left_semi")
    rows = rows.groupBy(*IDS).agg(F.first(F.struct(*columns)).alias("__kept"))
    return hits.alias("h").join(rows.alias("r"), same("h", "r")).select("h.*", "r.__kept.*")


def _scope(queries: DataFrame, chunks: DataFrame) -> list:
    """The scope of the queries, without repeats, and the buckets that it is in if the chunks have theirs."""
    if "scope" not in queries.columns:
        return []
    scope = F.when(F.size("scope") > 0, F.array_sort(F.array_distinct("scope")))
    buckets = [F.array_distinct(F.transform(scope, lambda d: bucket_of(d, BUCKETS))).alias("buckets")] if "bucket" in chunks.columns else []
    return [scope.alias("scope"), *buckets]


def beside_queries(asked: DataFrame, source: DataFrame, work: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kinds: str) -> DataFrame:
    """work(queries, batches of the source) in tasks that cover every query and row of the source together exactly once.

    Few queries with few ids in their scopes are held by every task; others meet the source group by group.
    """
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("scope") if "scope" in asked.columns else F.lit(0)).alias("scoped")).first()
    scoped = max(size["scoped"] or 0, 0)
    if size["n"] <= QUERY_BLOCK and scoped <= SCOPE_BLOCK:
        held = source.sparkSession.sparkContext.broadcast(_packed(asked.toArrow()))
        return source.mapInArrow(lambda batches: work(_unpacked(held.value), batches), kinds)

    def meet(batches):
        filled = (b for b in batches if b.num_rows)
        if (first := next(filled, None)) is not None:
            queries = _unpacked(first.column("q")[0].as_py())  # a copy, as the batch is large
            blocks, first = _opened(chain([first], filled)), None
            yield from work(queries, blocks)

    met = _in_groups(asked, source, max(-(-size["n"] // GROUP), -(-scoped // SCOPE_BLOCK))).mapInArrow(meet, kinds)
    # a batch of the usual 64 MB would be held several times over by the task and its worker; the setting counts when the plan is run
    conf, name = source.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = conf.get(name, None)
    conf.set(name, str(PACKED))
    try:
        return checkpointed(met)
    finally:
        conf.unset(name) if usual is None else conf.set(name, usual)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed blocks c, one at a time; a batch of them is let go before the next one is read."""
    while (batch := next(batches, None)) is not None:
        for i in range(batch.num_rows):
            yield from _unpacked(batch.column("c")[i].as_buffer()).to_batches()
        batch = None


def _in_groups(asked: DataFrame, source: DataFrame, groups: int) -> DataFrame:
    """Rows (q, c): a task for every group of queries and part of the source, whose blocks are c; q is the packed group in its first row.

    A group is one row and a partition of its own, and a product makes a task of each pair of partitions. The source is
    cut into few parts, as each sends k rows for each query: about a quarter as many tasks as shuffle partitions. Its blocks
    are packed once, before, so that a task has one worker and not two.
    """
    spark = asked.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 2 * spark.sparkContext.defaultParallelism)

    def group(batches):
        if held := list(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_packed(pa.Table.from_batches(held).combine_chunks())], pa.binary())], names=["q"])

    def blocks(batches):
        for batch in batches:
            step = max(1, batch.num_rows // max(1, -(-batch.nbytes // PACKED)))
            for i in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays([pa.array([_packed(pa.Table.from_batches([batch.slice(i, step)]))], pa.binary())], names=["c"])

    packed = checkpointed(asked.repartition(groups).mapInArrow(group, "q binary"))
    parts = checkpointed(source.mapInArrow(blocks, "c binary")).coalesce(max(1, tasks // groups))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    return parts.crossJoin(packed.hint("shuffle_replicate_nl")).select(F.when(first, F.col("q")).alias("q"), "c")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _behind(batch: pa.RecordBatch) -> np.ndarray:
    """How many rows of the batch come after each one in a tie."""
    order = pc.sort_indices(pa.table({c: batch.column(c) for c in IDS[1:]}), sort_keys=[(c, "ascending") for c in IDS[1:]]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))[::-1]
    return out


def _units(products: np.ndarray) -> np.ndarray:
    """Inner products in units of the last digit that counts."""
    return np.rint(np.round(products, DIGITS) * _UNIT).astype(np.int64)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _units(q @ v.T)


def _best(table: pa.Table, batches: Iterator[pa.RecordBatch], not_self: bool) -> Iterator[pa.RecordBatch]:
    held = _Running(table, not_self)
    for batch in batches:
        held.add(batch)
    yield from held.rows()


class _Running:
    """The best rows seen so far for a block of queries: ids and scores."""

    def __init__(self, table: pa.Table, not_self: bool):
        self.ids = table["query_id"].combine_chunks()
        n = len(self.ids)
        self.k = table["k"].to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
        self.vectors = _matrix(table["vector"], n) if n else np.zeros((0, 0))
        self.most = int(self.k.max(initial=0))
        self.floor = np.full(n, _NEVER)  # the score of the k-th row, once k are held
        self.held, self.fresh, self.waiting, self.seen = None, [], 0, 0
        self.small = self.vectors.astype(np.float32)
        self.norm = np.sqrt((self.vectors**2).sum(1))
        self.own = pc.cast(self.ids, pa.string()).to_pylist() if not_self else []
        self.scope, self.scopes, self.buckets = np.full(n, -1), [], None
        if "scope" in table.column_names:
            known: dict[tuple, int] = {}
            for i, ids in enumerate(table["scope"].to_pylist()):
                if ids:
                    self.scope[i] = known.setdefault(tuple(ids), len(known))
            self.scopes = [pa.array(ids) for ids in known]  # equal scopes are looked up once a batch
        if "buckets" in table.column_names:
            self.buckets = np.ones((n, BUCKETS), bool)
            for i, b in enumerate(table["buckets"].to_pylist()):
                if b:
                    self.buckets[i] = np.isin(np.arange(BUCKETS), b)

    def add(self, batch: pa.RecordBatch) -> None:
        """In parts of as many rows as were seen before, so that most rows meet a score to beat that is nearly the last one."""
        begin = 0
        while begin < batch.num_rows:
            part = batch.slice(begin, max(FIRST, self.seen))
            self._add(part)
            begin += part.num_rows
            self.seen += part.num_rows
            if self.waiting > max(4096, self.held.num_rows if self.held else 0):
                self._merge()

    def _add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        mine = np.arange(len(self.k))
        if self.buckets is not None:
            mine = np.flatnonzero(self.buckets[:, np.unique(batch.column("bucket").to_numpy(zero_copy_only=False))].any(1))
        if not self.most or not len(mine):
            return
        vectors, behind = _matrix(batch.column("vector"), n), _behind(batch)
        outside = {c: ~pc.is_in(batch.column("document_id"), value_set=self.scopes[c].cast(batch.column("document_id").type)).to_numpy(zero_copy_only=False) for c in np.unique(self.scope[mine]).tolist() if c >= 0}
        chunk = {c: i for i, c in enumerate(batch.column("chunk_id").to_pylist())} if self.own else {}
        found = []
        # what the scores of half the digits may be off by, and whether they hold these numbers
        off = (vectors.shape[1] + 8) * 2.0**-23 * self.norm * (longest := np.sqrt((vectors**2).sum(1)).max())
        warm = (self.floor[mine] > _NEVER) & (self.norm[mine] * longest < 1e30) & (longest < 1e30) & (self.norm[mine] < 1e30)
        step = max(1, CELLS // n)
        for some, rough in ((mine[warm], True), (mine[~warm], False)):
            few = np.ascontiguousarray(vectors.T, np.float32) if rough and len(some) else None
            for i in range(0, len(some), step):
                who = some[i : i + step]
                if rough:
                    floor = self.floor[who] / _UNIT
                    live = self.small[who] @ few >= (floor - 1.0 / _UNIT - off[who] - 1e-7 * np.abs(floor)).astype(np.float32)[:, None]
                else:
                    score = scores(self.vectors[who], vectors)
                    live = score >= self.floor[who, None]
                for j, c in enumerate(self.scope[who].tolist() if self.scopes else ()):
                    if c >= 0:
                        live[j, outside[c]] = False
                for j, w in enumerate(who.tolist() if self.own else ()):
                    if self.own[w] in chunk:
                        live[j, chunk[self.own[w]]] = False
                if rough:
                    j, at = np.divmod(np.flatnonzero(live), n)
                    key = np.concatenate([np.zeros(0, np.int64), *(_units(np.einsum("ij,ij->i", self.vectors[who[j[a : a + CELLS // 16]]], vectors[at[a : a + CELLS // 16]])) for a in range(0, len(j), CELLS // 16))])
                    fits = key >= self.floor[who[j]]
                    j, at, key = j[fits], at[fits], key[fits]
                else:
                    if self.most < n and live.sum(1).max(initial=0) > 2 * self.most:
                        rank = np.where(live, score * n + behind, _NEVER)
                        top = np.argpartition(rank, n - self.most, 1)[:, n - self.most :]
                        j, at = np.nonzero(np.take_along_axis(rank, top, 1) > _NEVER)
                        at = top[j, at]
                    else:
                        j, at = np.nonzero(live)
                    key = score[j, at]
                if len(j) and np.bincount(j).max() > self.most:
                    order = np.lexsort((-behind[at], -key, j))
                    j, at, key = j[order], at[order], key[order]
                    first = np.arange(len(j)) - np.searchsorted(j, j) < self.most
                    j, at, key = j[first], at[first], key[first]
                found.append((who[j].astype(np.int32), key, at))
        who, key, at = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(at):
            taken = batch.select(list(IDS)).take(pa.array(at))
            self.fresh.append(pa.table({"who": pa.array(who), "key": pa.array(key), **{c: taken.column(c) for c in IDS}}))
            self.waiting += len(at)

    def add_pairs(self, batch: pa.RecordBatch, pairs: Iterator[tuple[list[int], np.ndarray]]) -> None:
        """The same for k = 1 and given (queries, rows) alone."""
        vectors, behind = _matrix(batch.column("vector"), batch.num_rows) if batch.num_rows else None, _behind(batch)
        for who, at in pairs:
            if len(at):
                score = scores(self.vectors[who], vectors[at])
                j = np.arange(len(who))
                top = (score * batch.num_rows + behind[at]).argmax(1)
                better = score[j, top] >= self.floor[who]
                taken = batch.take(pa.array(at[top[better]]))
                self.fresh.append(pa.table({"who": pa.array(np.array(who, np.int32)[better]), "key": pa.array(score[j, top][better]), **{c: taken.column(c) for c in IDS}}))
                self.waiting += int(better.sum())
        if self.waiting > 4096:
            self._merge()

    def _merge(self) -> None:
        rows = pa.concat_tables(([self.held] if self.held else []) + self.fresh)
        who, key = rows["who"].to_numpy(), rows["key"].to_numpy()
        order = np.lexsort((-key, who))
        who, key = who[order], key[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        full = place == self.k[who] - 1
        self.floor[who[full]] = key[full]
        beyond = (place >= self.k[who]) & (key == self.floor[who])
        if beyond.any():  # of those that tie for the last places, the first by document and index
            tied = np.flatnonzero((key == self.floor[who]) & np.isin(who, who[beyond]))
            names = rows.select(["who", *IDS[1:]]).take(pa.array(order[tied]))
            order[tied] = order[tied[pc.sort_indices(names, sort_keys=[(c, "ascending") for c in names.column_names]).to_numpy()]]
        self.held, self.fresh, self.waiting = rows.take(pa.array(order[place < self.k[who]])), [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.fresh:
            self._merge()
        for b in self.held.to_batches() if self.held else ():
            who = b.column("who").to_numpy()
            yield pa.RecordBatch.from_arrays([self.ids.take(b.column("who")), pa.array(self.k[who].astype(np.int32)), *(b.column(c) for c in IDS), pa.array(b.column("key").to_numpy() / _UNIT)], names=["query_id", "k", *IDS, "score"])


def pool_size(queries: DataFrame, params: Params = Params()) -> DataFrame:
    """queries with pool_k: retrieve_k if a second stage trims the pool, at least top_k."""
    top = F.coalesce("top_k", F.lit(params.top_k))
    wide = F.lit(params.retrieve_k) if params.rerank or params.mmr else top
    return queries.withColumn("pool_k", F.greatest(wide, top))


def fuse_variants(hits: DataFrame, min_score: float | None = None) -> DataFrame:
    """The pools of a query's variants as one: best score per chunk, ranked, scores below min_score dropped."""
    others = [c for c in hits.columns if c not in ("query_id", "chunk_id", "score", "rank", "variant_no")]
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), *(F.first(c).alias(c) for c in others))
    if min_score is not None:
        best = best.where(F.col("score") >= min_score)
    return ranked(best).select("query_id", "rank", "chunk_id", *others, "score")


def ranked(hits: DataFrame, *order) -> DataFrame:
    """hits with rank by score (descending), then the order given, then document and index."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *order, "document_id", "chunk_index")
    return hits.drop("rank").withColumn("rank", F.row_number().over(w))


def vectors_for(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, vector) of the ids that exist."""
    return chunks.select("chunk_id", "vector").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def dense_rank_of_keyword(queries: DataFrame, chunks: DataFrame, depth: int = 1000) -> DataFrame:
    """(query_id, first_rank) of the first of a query's hits that holds its keyword: null if no chunk does, -1 if none within depth.

    queries: query_id, vector, keyword. Two reads of the chunks (whose vectors should be stored): the best chunk with the
    keyword, found through an index of the keywords, then the number of chunks that come before it. A task sends one row
    of ids or one count per query, whatever the depth.
    """
    asked = queries.select("query_id", "vector", F.lower("keyword").alias("keyword"), F.lit(1).alias("k")).where("keyword is not null")
    source = chunks.where("vector is not null").select(*IDS, "vector")
    kind = asked.schema["query_id"].dataType.simpleString()
    kinds = ", ".join([f"query_id {kind}", "k int", *(f"{c} {source.schema[c].dataType.simpleString()}" for c in IDS), "score double"])
    texts = chunks.where("vector is not null").select(*IDS, "vector", F.lower("text").alias("text"))
    # -score: the least struct is the first in rank
    first = F.min(F.struct((-F.col("score")).alias("s"), "document_id", "chunk_index"))
    best = checkpointed(beside_queries(asked, texts, _best_with_keyword, kinds).groupBy("query_id").agg(first.alias("b")))
    ranked = asked.select("query_id", "vector").join(best, "query_id").select("query_id", "vector", (-F.col("b.s")).alias("score"), F.col("b.document_id").alias("document_id"), F.col("b.chunk_index").alias("chunk_index"))
    before = beside_queries(ranked, source, _count_before, f"query_id {kind}, n long").groupBy("query_id").agg(F.sum("n").alias("n"))
    rank = F.coalesce("n", F.lit(0)) + 1
    places = best.join(before, "query_id", "left").select("query_id", F.when(rank <= depth, rank).otherwise(-1).cast("int").alias("first_rank"))
    return queries.select("query_id").join(places, "query_id", "left")


def _best_with_keyword(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query its best row among those whose text has its keyword."""
    held, words = _Running(table, False), table["keyword"].to_pylist()
    listed = sorted(set(words))
    index, number = TermIndex(listed), {t: i for i, t in enumerate(listed)}
    of_term = [[] for _ in listed]
    for q, w in enumerate(words):
        of_term[number[w]].append(q)
    for batch in batches:
        held.add_pairs(batch, _having(index, of_term, batch))
    yield from held.rows()


def _having(index: TermIndex, of_term: list[list[int]], batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray]]:
    """(queries, rows) of each keyword in the batch."""
    found = [np.zeros((2, 0), np.int64)]
    for begin, column in text_slices(batch.column("text")):
        term, row = index.find(*bytes_of(column))
        found.append(np.stack([term, row + begin]))
    term, row = np.concatenate(found, axis=1)
    edges = np.searchsorted(term[order := np.argsort(term, kind="stable")], np.arange(len(of_term) + 1))
    for t in np.flatnonzero(np.diff(edges)).tolist():
        yield of_term[t], row[order[edges[t] : edges[t + 1]]]
    everywhere = np.flatnonzero(batch.column("text").is_valid().to_numpy(zero_copy_only=False))
    for t in index.empty.tolist():
        yield of_term[t], everywhere


def _count_before(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query how many rows rank before the one that it brings."""
    n = table.num_rows
    if not n:
        return
    vectors, best, count = _matrix(table["vector"], n), np.rint(table["score"].to_numpy() * _UNIT).astype(np.int64), np.zeros(n, np.int64)
    names = {c: table[c].combine_chunks() for c in IDS[1:]}
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        # the place of each query's row in the batch's order of ties
        both = pa.table({c: pa.concat_arrays([names[c].cast(batch.column(c).type), batch.column(c)]) for c in IDS[1:]} | {"mine": pa.array(np.arange(n + m) >= n)})
        order = pc.sort_indices(both, sort_keys=[*((c, "ascending") for c in IDS[1:]), ("mine", "ascending")]).to_numpy()
        seen = np.cumsum(order >= n)
        place = np.empty(n + m, np.int64)
        place[order] = seen
        step, v, ahead = max(1, CELLS // m), _matrix(batch.column("vector"), m), place[n:] - 1
        for i in range(0, n, step):
            s = scores(vectors[i : i + step], v)
            count[i : i + step] += ((s > best[i : i + step, None]) | ((s == best[i : i + step, None]) & (ahead < place[i : min(i + step, n), None]))).sum(1)
    yield pa.RecordBatch.from_arrays([table["query_id"].combine_chunks(), pa.array(count)], names=["query_id", "n"])
