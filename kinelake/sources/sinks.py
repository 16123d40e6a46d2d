"""Sinks and stores: submission csv, thresholds, models, reports of non-finite values."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import group_starts
from ..operators import boosting

#: Frames of a file of a recording; longer ones have a file for each stretch.
STRETCH = 1 << 20


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all machines share, deleted when the application ends; in local mode a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-kinelake-")
    found = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, path = _path(spark, found)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return found


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """row_id from 0 in the given order, without a single-task sort.

    Rows are range-partitioned by the order and sorted; each partition's
    offset is the sum of the counts before it, one small row a partition.
    """
    from ..functions.ordering import global_row_number

    return global_row_number(df, order, "row_id")


def write_submission(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One csv with a header and row_id: the file format wants a single file, so the intervals, not frames, pass one task."""
    rows = with_row_id(df, order or ["video_id", "agent_id", "target_id", "start_frame"])
    cols = ["row_id", "video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame"]
    rows.select(*cols).coalesce(1).sortWithinPartitions("row_id").write.mode("overwrite").option("header", True).csv(path)


def save_thresholds(df: DataFrame, path: str) -> None:
    """(section_slug, switch, action, threshold); a section's and switch's earlier rows are replaced."""
    df.select("section_slug", "switch", "action", "threshold").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section_slug", "switch").parquet(path)


def load_thresholds(spark: SparkSession, path: str, section_slug: str, switch: str) -> dict[str, float]:
    """The thresholds of one section by action: a handful of rows."""
    rows = spark.read.parquet(path).filter((F.col("section_slug") == section_slug) & (F.col("switch") == switch))
    return {r.action: r.threshold for r in rows.select("action", "threshold").collect()}


def write_videos(rows: DataFrame, folder: str, frame: str = "video_frame", stretch: int = STRETCH) -> None:
    """A file of each lab and video, <folder>/<stretch>/<lab>/<video>.parquet, however many tasks had its rows.

    Spark's own writers can't name files, and a folder for each video makes
    thousands of them (on local disks each with processes that set its mode).
    A task streams its videos, one open file at a time, and moves each into
    place when it is whole, so a repeated task changes nothing. Only
    partitions of lab and video are written where the store isn't a local or
    a mounted disk.
    """
    keys = ["__stretch", "lab_id", "video_id"]
    rows = rows.withColumn("__stretch", F.floor(F.col(frame) / stretch).cast("long")).repartition(*keys)
    fs, at = _path(rows.sparkSession, folder)
    if fs.getScheme() != "file":
        return rows.drop("__stretch").write.partitionBy("lab_id", "video_id").parquet(folder)
    root = fs.makeQualified(at).toUri().getPath()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = FileSystem.from_uri("file:///")
        last, out, moves, n = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = group_starts(batch, keys, last)
            data = batch.drop_columns(keys)
            bounds = sorted({0, *np.flatnonzero(new).tolist(), len(new)})
            for a, b in zip(bounds, bounds[1:]):
                if new[a]:
                    if out is not None:
                        out.close()
                        disk.move(*moves)
                    k, lab, video = (batch.column(batch.schema.get_field_index(c))[a].as_py() for c in keys)
                    own = f"{root}/{k}/{lab}"
                    disk.create_dir(own)
                    moves, n = (f"{own}/.{video}-{uuid.uuid4().hex}", f"{own}/{video}.parquet"), n + 1
                    out = pq.ParquetWriter(moves[0], data.schema, filesystem=disk)
                out.write_batch(data.slice(a, b - a))
        if out is not None:
            out.close()
            disk.move(*moves)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.sortWithinPartitions(*keys).mapInArrow(files, "n LONG").agg(F.sum("n")).collect()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def has_models(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def save_models(spark: SparkSession, models: dict[str, list], columns: list[str], path: str) -> None:
    """The nodes of all trees of each action's forests, and the names of their features: one table, moved into place when it is whole."""
    nodes = boosting.as_rows(models)
    named = pd.DataFrame({"feature": range(len(columns)), "name": columns})
    rows = pd.concat([nodes.assign(name=None), named])[[c.split()[0] for c in (boosting.NODES + ", name STRING").split(", ")]]
    rows = rows.astype({c: "Int32" for c in ("model", "tree", "node", "feature", "left", "right")}).astype(object).where(rows.notna(), None)
    new = f"{path}-{uuid.uuid4().hex}"
    spark.createDataFrame(rows.values.tolist(), boosting.NODES + ", name STRING").coalesce(1).write.parquet(new)
    fs, at = _path(spark, path)
    fs.delete(at, True)
    if not fs.rename(_path(spark, new)[1], at):
        raise OSError(f"could not move the models to {path}")


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, list], list[str]]:
    """Forests by action, and the features they were fitted on, in order. A model's nodes are read to the driver, as they are sent to every task."""
    rows = spark.read.parquet(path).toPandas()
    named = rows[rows["name"].notna()].sort_values("feature")
    return boosting.from_rows(rows[rows["name"].isna()]), named["name"].tolist()


def scratch_writer(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """Stores tables in new scratch folders, which are deleted when the application ends."""
    root, numbers = scratch_folder(spark, name), itertools.count()

    def write(rows: DataFrame) -> DataFrame:
        path = f"{root}/{next(numbers)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return write


def log_non_finite(report: DataFrame, context: str, path: str) -> None:
    """Append the columns that had non-finite values, if any, with what they belong to."""
    report.withColumn("context", F.lit(context)).write.mode("append").parquet(path)


