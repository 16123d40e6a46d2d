"""Sharding by size-tiered compaction.

A shard store is a folder of immutable runs, each a folder of Parquet files
that one append or one merge wrote, and a series of versioned manifests.
Arrivals are appended as a run of small shards; compaction merges runs of
similarly sized shards (one tier) into a run of files of about the target
size, and a new manifest version replaces them.

A version is committed by its marker, which holds the manifest's name and the
schema of all rows. The marker is written under a name of its own and then
moved to ``commits/<version>`` without overwriting, so it is never seen empty
or half written, and of two writers of one version the second fails, rebases
on the version that holds then, and tries again. Runs that no manifest names
any more stay until ``vacuum``.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import file_system, new_path, table

MB = 1 << 20
MANIFEST = "run STRING, file STRING, rows BIGINT, bytes BIGINT, tier INT, since BIGINT"


class ShardStore:
    """Shards under ``path``, in storage shared by all machines that can rename a file atomically.

    target_bytes: size of a finished shard; small_bytes: size of tier 0, the
    tiers above are ``fanout`` times larger each; a tier is merged when it has
    ``fanout`` shards at least; row_group: bytes of a row group of merged
    shards, which a writing task buffers. A run's tier is that of its mean shard.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 * MB, small_bytes: int = 4 * MB, fanout: int = 4, row_group: int = 32 * MB):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.small, self.fanout, self.row_group = target_bytes, small_bytes, fanout, row_group

    def _hadoop(self, name: str):
        return file_system(self.spark, f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs, path = self._hadoop("commits")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        return max(self.versions(), default=0)

    def _marker(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version}").first().value)

    def schema(self, version: int) -> StructType:
        """Of all rows of a version; without columns for version 0."""
        return StructType.fromJson(self._marker(version)["schema"]) if version else StructType()

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per shard: its run and file, rows, bytes, the run's tier, and the version it came with."""
        version = self.version() if version is None else version
        if version:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._marker(version)['manifest']}")
        fields = StructType.fromDDL(MANIFEST)
        return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def commit(self, manifest: DataFrame, version: int, schema: StructType) -> int:
        """Write the manifest and make it ``version``; FileExistsError, and nothing is changed, if that version exists."""
        name = f"{version}-{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        fs, own = self._hadoop(f"commits/.{name}")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        out.close()
        self._publish(own, self._hadoop(f"commits/{version}")[1], version)
        return version

    def _publish(self, own, marker, version: int) -> None:
        """Move a file to a name that must not exist yet."""
        jvm, uri = self.spark._jvm, own.toUri()
        try:
            if uri.getScheme() in (None, "file"):
                # A local rename would overwrite; a hard link never does.
                files, at = jvm.java.nio.file.Files, lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                files.createLink(at(marker), at(own))
                files.delete(at(own))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsparkSession.sessionState().newHadoopConf()).rename(own, marker, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(f"version {version} is already committed") from None
            raise

    def _tier(self, size):
        """0 for shards under small_bytes, then one tier for each factor of fanout; -1 from half of the target on."""
        steps = F.ceil(F.log(F.greatest(size, F.lit(1)) / F.lit(float(self.small))) / F.lit(math.log(self.fanout)))
        return F.when(size >= self.target // 2, -1).otherwise(F.greatest(steps, F.lit(0))).cast("int")

    def _written(self, run: str, version: int) -> DataFrame:
        """A manifest row for each file of a run; rows come from the footers' counts, not from texts."""
        files = self.spark.read.parquet(f"{self.path}/data/{run}")
        found = files.groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("rows"))
        mean = found.agg(F.avg("file_size").alias("mean"))
        return found.join(F.broadcast(mean), F.lit(True)).select(  # a single row
            F.lit(run).alias("run"), F.col("file_path").alias("file"), "rows", F.col("file_size").cast("long").alias("bytes"),
            self._tier(F.col("mean")).alias("tier"), F.lit(version).cast("long").alias("since"),
        )

    def append(self, arrivals: DataFrame, max_rows: int = 0, attempts: int = 100) -> int:
        """Write arrivals as they are partitioned, without a shuffle, as small shards (``max_rows`` a file, if given).

        Columns that the store lacks are added to it, and are null in older
        rows; columns that the arrivals lack are null in theirs. A column that
        comes with another type is refused. If another writer commits first,
        the same run is committed on top of that version.
        """
        run = uuid.uuid4().hex
        merged_schema(self.schema(self.version()), arrivals.schema)  # refuse before writing
        fs, empty = self._hadoop("empty")
        fs.mkdirs(empty)  # what a version without rows reads
        arrivals.write.option("maxRecordsPerFile", max_rows).parquet(f"{self.path}/data/{run}")
        for _ in range(attempts):
            base = self.version()
            schema = merged_schema(self.schema(base), arrivals.schema)
            try:
                return self.commit(self.manifest(base).unionByName(self._written(run, base + 1)), base + 1, schema)
            except FileExistsError:
                continue
        raise RuntimeError(f"no commit in {attempts} attempts")

    def compact(self, attempts: int = 100) -> int:
        """Merge each tier with ``fanout`` shards or more; returns the version that holds then.

        The driver sees one row a run, never one a file. Runs are read in place
        by tasks that each take several whole small shards: there is no
        shuffle. If another writer commits first, the merged runs take the
        place of the same runs in its version; if it has merged one of them
        too, this merge is given up.
        """
        base = self.version()
        schema, runs = self.schema(base), self.manifest(base).filter("tier >= 0").groupBy("tier", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        tiers: dict[int, list] = {}
        for r in runs.collect():
            tiers.setdefault(r.tier, []).append(r)
        due = {t: found for t, found in sorted(tiers.items()) if sum(r.n for r in found) >= self.fanout}
        if not due:
            return base
        merged = []
        for found in due.values():
            merged.append(uuid.uuid4().hex)
            files = max(1, round(sum(r.bytes for r in found) / self.target))
            rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{r.run}" for r in found))
            rows.coalesce(files).write.option("parquet.block.size", self.row_group).parquet(f"{self.path}/data/{merged[-1]}")
        gone = {r.run for found in due.values() for r in found}
        for _ in range(attempts):
            base = self.version()
            old = self.manifest(base)
            if old.filter(F.col("run").isin(gone)).select("run").distinct().count() < len(gone):
                return base
            new = old.filter(~F.col("run").isin(gone))
            for run in merged:
                new = new.unionByName(self._written(run, base + 1))
            try:
                return self.commit(new, base + 1, self.schema(base))
            except FileExistsError:
                continue
        raise RuntimeError(f"no commit in {attempts} attempts")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with the file that holds each in ``_metadata``. Runs, not files, are listed by the driver."""
        version = self.version() if version is None else version
        schema = self.schema(version)
        runs = sorted(r.run for r in self.manifest(version).select("run").distinct().toLocalIterator())
        return self.spark.read.schema(schema).parquet(*([f"{self.path}/data/{r}" for r in runs] or [f"{self.path}/empty"]))

    def vacuum(self, keep: int = 2, older_than: float = 86_400) -> list[str]:
        """Delete runs that none of the last ``keep`` versions names and that are older than ``older_than`` seconds, so that writers in flight keep theirs."""
        live = {r.run for v in self.versions()[-keep:] for r in self.manifest(v).select("run").distinct().collect()}
        fs, data = self._hadoop("data")
        before = (time.time() - older_than) * 1000
        dead = [s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in live and s.getModificationTime() <= before]
        for name in dead:
            fs.delete(self._hadoop(f"data/{name}")[1], True)
        return dead


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The old fields, then the new ones that it lacks, all nullable; names are compared as Spark does, without case."""
    fields = {f.name.lower(): f for f in old}
    for f in new:
        had = fields.get(f.name.lower())
        if had is None:
            fields[f.name.lower()] = StructField(f.name, f.dataType, True)
        elif had.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} is {had.dataType.simpleString()} in the store, {f.dataType.simpleString()} in the arrivals")
    return StructType(list(fields.values()))


def shard(docs: DataFrame, path: str | None = None, target_bytes: int = 256 * MB, small_bytes: int = 4 * MB) -> ShardStore:
    """Append ``docs`` to the store at ``path`` (new if None) and compact until no tier is due."""
    store = ShardStore(docs.sparkSession, path or new_path(docs.sparkSession, "shards"), target_bytes, small_bytes)
    before, now = -1, store.append(docs)
    while now != before:
        before, now = now, store.compact()
    return store


def placement(store: ShardStore) -> DataFrame:
    """One row per stored document: doc_id, its text's digest, its shard and that shard's size, from the finished files.

    Every column of the arrivals is stored as it came; nulls and empty texts
    are kept, repeated rows stay repeated, and an empty table makes an empty
    store.
    """
    rows = store.read()
    file = F.regexp_extract("_metadata.file_path", r"/data/(.+)$", 1)
    return rows.select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.lit(store.version()).cast("long").alias("version"), file.alias("shard"),
        F.col("_metadata.file_size").cast("long").alias("shard_bytes"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the finished shards hold them, and whether their shard is one that the committed manifest names, with its size.

    Which shard a row is in depends on the cluster's partitions, so the
    shards' names, which SQL can't tell, are left to ``placement``.
    """
    store = shard(table(spark, sf_dir, "documents"))
    rows = store.read().select(
        "doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
    )
    # A key of this join has the rows of one shard, which its target size bounds.
    named = rows.join(store.manifest().select("file", "bytes"), "file", "left")
    return named.withColumn("in_manifest", F.coalesce(F.col("bytes") == F.col("size"), F.lit(False))).drop("file", "size", "bytes")


ORACLE = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256, true AS in_manifest FROM documents
"""
