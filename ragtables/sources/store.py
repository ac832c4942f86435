"""A corpus of chunks and its registry on disk that changes in place, by whole buckets and numbered manifests.

Documents are dealt to buckets by a hash of their id, chunks and registry rows alike. Data lie in run folders that are
never changed:

    <path>/chunks/seq=12/try=<id>/bucket=7/*.parquet      <path>/registry/seq=12/try=<id>/bucket=7/*.parquet
    <path>/manifest/version=9/*.json                      which run folders count, for each bucket

A change writes new run folders first (appended documents, or the touched buckets anew) and then the next manifest, one
file that a job commits as a whole: readers see the old table or the new one, and a run that dies in between leaves
folders that nobody names. Buckets that a change does not touch keep their files. Of a document that is in several runs of
its bucket, the last one counts, also if it holds no chunk of it; compaction makes one run of several. Only manifests (at
most a few rows a bucket) pass through the driver. One writer at a time: a second one fails on the manifest's folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import CHUNKS, bucket_of

REGISTRY = "id string, filename string, content_type string, num_chunks long, num_chars long, uploaded_at timestamp, reason string"
_ENTRY = "name string, bucket int, seq long, folder string, batch long"
_RUN = ", seq long, try string, bucket int"
_KEYS = {"chunks": "document_id", "registry": "id"}
_SCHEMAS = {"chunks": CHUNKS, "registry": REGISTRY}
_ROWS = 1_000_000  # rows of a file at most


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # reading

    def entries(self) -> list:
        """The newest manifest: a row for each run of each bucket, and one for the last batch of a stream."""
        version = self.version()
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/manifest/version={version}").collect() if version else []

    def version(self) -> int:
        """The number of the newest manifest, 0 if there is none; manifests are listed, not read."""
        try:
            files = self.spark.read.schema(_ENTRY).json(f"{self.path}/manifest").inputFiles()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return max((int(re.search(r"/version=(\d+)/", f)[1]) for f in files), default=0)

    def _read(self, name: str, entries: Iterable) -> DataFrame:
        folders = sorted({e["folder"] for e in entries if e["name"] == name})
        schema = _SCHEMAS[name] + _RUN
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{f}" for f in folders))

    def _live(self, name: str, entries: list) -> DataFrame:
        """The rows of each document's last run, with seq, try and bucket."""
        runs: dict[int, set[int]] = {}
        for e in entries:
            if e["name"] != "batch":
                runs.setdefault(e["bucket"], set()).add(e["seq"])
        several = {b for b, s in runs.items() if len(s) > 1}
        once = self._read(name, [e for e in entries if e["bucket"] not in several])
        if not several:
            return once
        mixed = [e for e in entries if e["bucket"] in several]
        last = self._read("registry", mixed).groupBy("id").agg(F.max("seq").alias("__seq"))
        rows, key = self._read(name, mixed), _KEYS[name]
        kept = rows.join(last.withColumnRenamed("id", "__id"), (F.col(key) == F.col("__id")) & (F.col("seq") == F.col("__seq")), "left_semi")
        return once.unionByName(kept)

    def _chosen(self, buckets: Iterable[int] | None) -> list:
        entries = self.entries()
        if buckets is None:
            return entries
        chosen = set(buckets)
        return [e for e in entries if e["bucket"] in chosen]

    def chunks(self, *, scopes: DataFrame | None = None) -> DataFrame:
        """All chunks, with their bucket. scopes (a table with `scope`, document ids): only the buckets that hold any of them are read.

        A null or empty scope stands for all documents, so then every bucket is.
        """
        buckets = None
        if scopes is not None and scopes.where("scope is null or size(scope) = 0").isEmpty():
            buckets = self.buckets_of(scopes.select(F.explode("scope").alias("document_id")))
        rows = self._live("chunks", self._chosen(buckets))
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.drop("seq", "try")

    def registry(self) -> DataFrame:
        return self._live("registry", self.entries()).where("reason is null").drop("seq", "try", "bucket", "reason")

    def rejects(self) -> DataFrame:
        return self._live("registry", self.entries()).where("reason is not null").select(F.col("id").alias("document_id"), "filename", "reason")

    @staticmethod
    def buckets_of(ids: DataFrame) -> list[int]:
        """The buckets of documents (document_id): at most BUCKETS numbers."""
        return sorted(r[0] for r in ids.where("document_id is not null").select(bucket_of(F.col("document_id"))).distinct().collect())

    def has_batch(self, number: int) -> bool:
        """Whether this batch of a stream is in the table."""
        return any(e["name"] == "batch" and e["batch"] >= number for e in self.entries())

    # writing

    def _stage(self, name: str, rows: DataFrame, seq: int) -> list[tuple]:
        """rows in a run folder of their own, and its manifest entries."""
        run = f"{name}/seq={seq}/try={uuid.uuid4().hex}"
        wanted = self.spark.createDataFrame([], _SCHEMAS[name]).schema
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
        rows = rows.select(*columns).withColumn("bucket", bucket_of(F.col(_KEYS[name])))
        # tasks of even size, each with few buckets; a large bucket is split over several
        rows.hint("rebalance", F.col("bucket")).write.option("maxRecordsPerFile", _ROWS).partitionBy("bucket").parquet(f"{self.path}/{run}")
        files = self.spark.read.schema(_SCHEMAS[name] + ", bucket int").parquet(f"{self.path}/{run}").inputFiles()
        return [(name, b, seq, f"{run}/bucket={b}", None) for b in sorted({int(re.search(r"/bucket=(\d+)/", f)[1]) for f in files})]

    def _swap(self, entries: list[tuple]) -> None:
        """The next manifest: from here on, these entries are the table."""
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/version={self.version() + 1}")

    @staticmethod
    def _next(entries: list) -> int:
        return max((e["seq"] for e in entries), default=0) + 1

    def append(self, chunks: DataFrame, registry: DataFrame, rejects: DataFrame | None = None, *, batch: int | None = None) -> bool:
        """Documents that are new or stand for earlier ones of their id, as one more run. False if the batch is in the table already.

        registry has every document of the chunks; a rejected one (document_id, filename, reason) hides what was there before.
        """
        if batch is not None and self.has_batch(batch):
            return False
        entries = self.entries()
        seq = self._next(entries)
        if rejects is not None:
            gone = rejects.groupBy(F.col("document_id").alias("id")).agg(F.first("filename").alias("filename"), F.min("reason").alias("reason"))
            registry = registry.unionByName(gone.join(registry.select("id"), "id", "left_anti"), allowMissingColumns=True)
        new = [*self._stage("chunks", chunks, seq), *self._stage("registry", registry, seq)]
        if batch is not None:
            entries = [e for e in entries if e["name"] != "batch"]
            new.append(("batch", None, seq, None, batch))
        self._swap([*map(tuple, (e[:5] for e in entries)), *new])
        return True

    def _rewrite(self, buckets: list[int], change: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
        """The live chunks and registry rows of these buckets, changed and written anew as one run each."""
        if not buckets:
            return
        entries, chosen = self.entries(), set(buckets)
        mine = [e for e in entries if e["bucket"] in chosen]
        chunks, registry = change(*(self._live(name, mine).drop("seq", "try", "bucket") for name in ("chunks", "registry")))
        seq = self._next(entries)
        staged = [*self._stage("chunks", chunks, seq), *self._stage("registry", registry, seq)]
        self._swap([*(tuple(e[:5]) for e in entries if e["bucket"] not in chosen), *staged])

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (document_id) out of the chunks and the registry."""
        ids = ids.select("document_id").where("document_id is not null").distinct()

        def change(chunks: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
            return chunks.join(ids, "document_id", "left_anti"), registry.join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti")

        self._rewrite(self.buckets_of(ids), change)

    def replace(self, chunks: DataFrame, registry: DataFrame) -> None:
        """New documents stand for stored ones of the same file name or id: both changes are one swap."""
        names = registry.select("filename").distinct()
        old = self.registry().join(names, "filename", "left_semi").select(F.col("id").alias("document_id"))
        gone = old.union(registry.select("id")).distinct()

        def change(stored: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
            kept = stored.join(gone, "document_id", "left_anti"), listed.join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")
            return kept[0].unionByName(chunks.select(*kept[0].columns)), kept[1].unionByName(registry, allowMissingColumns=True).select(*kept[1].columns)

        self._rewrite(self.buckets_of(gone), change)

    def compact(self, *, runs: int = 1, clean: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Buckets of more than `runs` runs are written as one. clean: a change of their chunks on the way, such as dedup.compact.

        Returns how many buckets were written; runs=0 writes all.
        """
        held: dict[int, set[int]] = {}
        for e in self.entries():
            if e["name"] != "batch":
                held.setdefault(e["bucket"], set()).add(e["seq"])
        chosen = sorted(b for b, s in held.items() if len(s) > runs)
        self._rewrite(chosen, lambda chunks, registry: (clean(chunks) if clean else chunks, registry))
        return len(chosen)
