"""Scratch tables in the folder that the driver and all executors share, and joins on keys of any frequency."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings of the jobs that write scratch tables.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: A key is hot with more than one in HOT_SHARE of all rows, so that there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 10_000
#: Keys are counted by hash in so many bins where most of them can't be hot; more than HOT_SHARE, so that an even bin is below a hot key's share.
BINS = 1 << 14
#: Tables of up to so many short rows (a few MB) are broadcast whole.
BROADCAST_ROWS = 200_000
_own: dict[str, str] = {}
_begun: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode (tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-kinelake-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for something that outlives the application."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, name: str):
    """Hadoop's file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table; all of them are deleted when the application ends."""
    root = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if root not in _begun:
        fs, path = file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _begun.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _writing(spark: SparkSession):
    """WHILE_WRITING holds, and what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and lets Spark drop
    the shuffle files of the finished job at once instead of at the driver's
    next garbage collection. Batches for Python are small while it runs.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with _writing(spark):
        df.write.option("compression", "lz4").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for t in tables:
        fs, path = file_system(t.sparkSession, t._scratch)
        fs.delete(path, True)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, a materialised table of one row a key and how many of ``total`` rows have it.

    A key with a third of all rows would put them all in one task. Hot keys,
    fewer than HOT_SHARE whatever the input, are broadcast instead, so the rows
    of a hot key stay where they are; what goes through the shuffle has at most
    one in HOT_SHARE of the rows a key. Both branches read ``rows``.
    """
    keyed = keyed.select(*keys, *(c for c in keyed.columns if c not in keys))
    hot = F.col(n) > F.lit(max(total // HOT_SHARE, 1))
    few = keyed.filter(hot)
    joined = rows.join(F.broadcast(few), keys)  # fewer than HOT_SHARE rows
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(keyed.filter(~hot), keys)
    return joined.unionByName(rest)


def hot_keys(rows: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """(keys, aggregates) of the keys that more than one in HOT_SHARE of all rows have, a materialised table of fewer than HOT_SHARE rows.

    No row is shuffled: rows are counted by bins of their keys' hashes, and
    only keys in bins with as many rows as a hot key has are counted one by
    one. ``rows`` is read twice, and should be a written table.
    """
    number = F.pmod(F.xxhash64(*keys), F.lit(BINS))
    bins = materialise(rows.groupBy(number.alias("__bin")).agg(F.count(F.lit(1)).alias("__n")), "bins")
    most = max((bins.agg(F.sum("__n")).first()[0] or 0) // HOT_SHARE, 1)
    full = bins.filter(F.col("__n") > most).select("__bin")  # at most BINS rows
    within = rows.withColumn("__bin", number).join(F.broadcast(full), "__bin", "left_semi")
    out = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *aggregates).filter(F.col("__n") > most).drop("__n")
    out = materialise(out, "hot-keys")
    discard(bins)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write a table once in buckets of a key: joins on the key then leave its rows where they are. ``discard`` deletes it."""
    spark, path, entry = df.sparkSession, scratch_path(df.sparkSession, name), f"scratch_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _writing(spark):
        rows = df.repartition(buckets, key).write.format("parquet").option("compression", "lz4").bucketBy(buckets, key)
        rows.option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    out.schema  # looked up before the catalog forgets the name; the files stay
    spark.sql(f"DROP TABLE {entry}")
    out._scratch = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def first_by_hash(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, the first by a hash ``h`` of the table (then by ``keys``); fewer only if there are no more.

    The hashes are spread evenly, so the rows are counted and all but about
    twice ``most`` are filtered out before the sort: what meets in one task
    doesn't grow with the table.
    """
    n = df.count()
    if n > 2 * most:
        share = 2 * most / n + 4 * (2 * most) ** 0.5 / n
        df = df.filter(F.col("h") <= F.lit(min(int(share * 2.0**64 - 2.0**63), 2**63 - 1)))
    return df.orderBy("h", *keys).limit(most)
