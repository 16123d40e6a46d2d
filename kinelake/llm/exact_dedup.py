"""Exact dedup against a persistent digest index.

The index is a Parquet table of (digest, keep_id), bucketed and sorted by
digest, so a lookup is a sort-merge join that shuffles the new rows only. New
data is reduced to one row per digest before any join, anti-joined to the
index, and what remains is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, file_system, join_counted, materialise, scratch_path, table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text) -> "F.Column":
    """Null counts as empty; every run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): lowercase hex SHA-256 of the normalised text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))


class DigestIndex:
    """A bucketed Parquet table of every digest seen so far.

    ``path`` lies in storage that all machines share; opening the same path
    with the same number of buckets later continues the index, and another
    number is refused. Buckets are a property of the table: choose them for
    the size it is to reach (a few hundred MB a bucket).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self._claim(buckets)
        self.buckets = buckets
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        self.close()
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _claim(self, buckets: int) -> None:
        """Note the number of buckets beside the data, where readers of the table don't look; refuse another one."""
        fs, folder = file_system(self.spark, f"{self.path}/_buckets")
        if not fs.exists(folder):
            fs.mkdirs(file_system(self.spark, f"{self.path}/_buckets/{buckets}")[1])
        found = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder))
        if found != [buckets]:
            raise ValueError(f"the index at {self.path} has {found} buckets, not {buckets}")

    def close(self) -> None:
        """Take the table out of the catalog; its files stay, and so do results that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def entries(self) -> DataFrame:
        """(digest, keep_id), one row a digest.

        Writers that read the same state may both enter a digest. Whichever
        files are there first, the smallest id stands for it from then on, for
        all readers; the table's buckets group by digest, so nothing is shuffled.
        """
        return self.spark.table(self.name).groupBy("digest").agg(F.min("keep_id").alias("keep_id"))

    def append(self, groups: DataFrame) -> None:
        """Enter the digests of (digest, first_id, n) rows that the index lacks, with their first_id.

        A digest that the index already holds keeps its first entry. Null ids
        are never entered.
        """
        fresh = groups.filter("first_id IS NOT NULL").join(self.entries().select("digest"), "digest", "left_anti")
        # One file a bucket and append: the table's own hash partitioning, sorted.
        (
            fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .select("digest", F.col("first_id").alias("keep_id"))
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )


def exact_dedup(docs: DataFrame, path: str | None = None, buckets: int = 64) -> DataFrame:
    """Deduplicate ``docs`` against the index at ``path`` (new and empty if None), and enter them.

    One row per document row: doc_id, keep_id, group_size, kept, text_sha256.
    Texts are normalised and hashed once. Copies are counted before any
    shuffle; the documents of a digest that a large share of them has meet
    its one row where they are, not in one task. Null texts count as empty
    and equal the empty text. Repeated rows with one doc_id are all kept or
    all dropped; without a doc_id a row is never kept, and its keep_id is
    null if no equal text has one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrivals = materialise(digests(docs), "digests")
    groups = arrivals.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups, "copies")
    total = groups.agg(F.sum("n")).first()[0] or 0
    index = DigestIndex(spark, path or scratch_path(spark, "digest-index"), buckets)
    index.append(groups)
    known = materialise(groups.join(index.entries(), "digest", "left").select("digest", "keep_id", "n"), "known")
    index.close()
    discard(groups)
    return join_counted(arrivals, known, ["digest"], total).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches on one index: those that ``labels`` knows, then the others, which meet the digests of the first."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    path = scratch_path(spark, "digest-index")
    first = materialise(exact_dedup(docs.join(known, "doc_id", "left_semi"), path), "first-batch")
    second = exact_dedup(docs.join(known, "doc_id", "left_anti"), path)
    return first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""

BATCHES_ORACLE = r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS batch,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, batch, count(*) AS group_size, first_value(min(doc_id)) OVER (PARTITION BY text_sha256 ORDER BY batch) AS keep_id FROM d GROUP BY text_sha256, batch)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256, d.batch FROM d JOIN g ON d.text_sha256 = g.text_sha256 AND d.batch = g.batch
"""
