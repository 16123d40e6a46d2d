"""Scans of metadata, tracking and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _path

#: Bytes of files that a task reads at least, where there are more files than tasks.
TASK_BYTES = 32 << 20
METADATA = (
    "video_id LONG, lab_id STRING, frames_per_second DOUBLE, pix_per_cm_approx DOUBLE, arena_width_cm DOUBLE, arena_height_cm DOUBLE, "
    "arena_shape STRING, body_parts_tracked STRING, behaviors_labeled STRING, mouse1_condition STRING, "
    + ", ".join(f"mouse{i}_strain STRING, mouse{i}_sex STRING" for i in range(1, 5))
)


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """Video metadata from a csv with a header; quotes inside fields are doubled. Columns are matched by the header's names."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    types = {f.split()[0]: f.split()[1] for f in schema.split(", ")}
    have = set(rows.columns)
    return rows.select(*((F.col(c) if c in have else F.lit(None)).cast(t.lower()).alias(c) for c, t in types.items()))


def _with_ids(rows: DataFrame) -> DataFrame:
    """Lab and video from the path: <lab>/<video>.parquet, a file or a folder of files, or partitions lab_id=<lab>/video_id=<video>."""
    path = F.substring_index("_metadata.file_path", "/", -3)
    of = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(path, form, i), F.lit("")) for form in (r"lab_id=([^/]+)/video_id=(\d+)/[^/]+$", r"([^/]+)/(\d+)\.parquet(?:/[^/]+)?$")))
    return rows.select("*", F.url_decode(of(1)).alias("lab_id"), of(2).cast("long").alias("video_id"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder, by their size in no more tasks than they fill: Spark deals small files as if they had 4 MB each, a task for every few of them."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
    fs, at = _path(spark, folder)
    return rows.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")), fs.getContentSummary(at).getLength() // TASK_BYTES))


def read_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """Long poses of all videos in one scan; ids come from the path, so a filter on them is cheap to add before a shuffle."""
    schema = "video_frame INT, mouse_id STRING, bodypart STRING, x DOUBLE, y DOUBLE"
    rows = _with_ids(_files(spark, folder))
    types = {f.split()[0]: f.split()[1].lower() for f in schema.split(", ")}
    return rows.select("lab_id", "video_id", *(F.col(c).cast(t).alias(c) for c, t in types.items()))


def read_annotation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_ids(_files(spark, folder))
    return rows.select("lab_id", "video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame")


def annotation_files(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id) of the annotation files, empty ones too: from the listing, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).cast("long").alias("video_id")).distinct()
