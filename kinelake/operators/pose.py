"""Metadata filters, long-to-wide poses, gap filling and cleaning."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.rolling import Track
from ..functions.scalars import finite, quoted_list

# Parts that are left out where more than five are tracked.
DROPPED_PARTS = (
    "headpiece_bottombackleft", "headpiece_bottombackright", "headpiece_bottomfrontleft", "headpiece_bottomfrontright",
    "headpiece_topbackleft", "headpiece_topbackright", "headpiece_topfrontleft", "headpiece_topfrontright",
    "spine_1", "spine_2", "tail_middle_1", "tail_middle_2", "tail_midpoint",
)


# Labs and condition of recordings of sleep.
SLEEP_LAB, SLEEP_CONDITION = "MABe22", "lights on"


def is_sleeping() -> Column:
    """A recording of sleep, by its lab and condition; an unknown condition isn't."""
    return F.coalesce(F.col("lab_id").contains(SLEEP_LAB) & (F.lower("mouse1_condition") == SLEEP_CONDITION), F.lit(False))


def drop_sleeping(metadata: DataFrame) -> DataFrame:
    return metadata.filter(~is_sleeping())


def flag_sleeping(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("sleeping", is_sleeping())


def count_individuals(metadata: DataFrame) -> DataFrame:
    """n_mice: how many of the four strain columns are filled."""
    return metadata.withColumn("n_mice", sum((F.col(f"mouse{i}_strain").isNotNull().cast("int") for i in range(1, 5)), F.lit(0)))


def sections(metadata: DataFrame) -> DataFrame:
    """The distinct part lists, in order, with their parts; long lists without DROPPED_PARTS."""
    parts = quoted_list(F.col("body_parts_tracked"))
    kept = F.when(F.size(parts) > 5, F.array_except(parts, F.array(*map(F.lit, DROPPED_PARTS)))).otherwise(parts)
    return metadata.select("body_parts_tracked").distinct().select("body_parts_tracked", kept.alias("parts"))


def of_section(metadata: DataFrame, section: str) -> DataFrame:
    return metadata.filter(F.col("body_parts_tracked") == section)


def drop_parts(track: DataFrame, dropped: tuple[str, ...] = DROPPED_PARTS, most: int = 5) -> DataFrame:
    """Leave out ``dropped`` in the videos that have more than ``most`` parts."""
    counts = track.groupBy("video_id").agg(F.count_distinct("bodypart").alias("__parts"))
    rows = track.join(counts, "video_id").filter(~((F.col("__parts") > most) & F.col("bodypart").isin(*dropped)))
    return rows.drop("__parts")


def pivot(track: DataFrame, parts: list[str]) -> DataFrame:
    """One row per individual and frame, ``<part>_x`` and ``<part>_y`` for each part.

    Conditional aggregates with the parts given: one shuffle, no job to find
    them. A key with two rows is an error, which the same aggregate raises, for
    a pivot would silently pick. A frame seen for any individual of a video is
    a row for all of them, as windows count rows.
    """
    key = ["video_id", "mouse_id", "video_frame"]
    cells = [F.max(F.when(F.col("bodypart") == p, F.col(a))).alias(f"{p}_{a}") for p in parts for a in "xy"]
    most = F.greatest(*(F.count_if(F.col("bodypart") == p) for p in parts), F.lit(0))
    seen = track.groupBy(*key).agg(*cells, most.alias("__most"))
    twice = F.raise_error(F.concat(F.lit("more than one row for a part of "), F.to_json(F.struct(*key))))
    # The check hangs on a column that every use of the rows needs.
    seen = seen.withColumn("video_frame", F.when(F.col("__most") > 1, twice.cast("int")).otherwise(F.col("video_frame"))).drop("__most")
    frames, who = seen.select("video_id", "video_frame").distinct(), seen.select("video_id", "mouse_id").distinct()
    return frames.join(who, "video_id").join(seen, key, "left")


def to_cm(pose: DataFrame, videos: DataFrame, coords: list[str]) -> DataFrame:
    """Coordinates divided by the video's pixels per cm; NULL where that is 0 or unknown."""
    scales = videos.select("video_id", F.col("pix_per_cm_approx").alias("__scale"))
    out = pose.join(scales, "video_id", "left").withColumns({c: F.try_divide(F.col(c), F.col("__scale")) for c in coords})
    return out.drop("__scale")


def fill_gaps(track: Track, columns: list[str], empty: float | None = None) -> Track:
    """Linear interpolation by row position, held constant before the first and after the last value.

    A column without any value in a trajectory becomes ``empty``. All columns
    go through one grouped Arrow function, on the trajectory's own exchange
    and sort: a plan of window functions would grow with their number.
    """
    order, own = track.order, set(columns)

    def fill(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column(order).to_numpy(), kind="stable")))
        at = np.arange(t.num_rows)
        for i, name in enumerate(t.column_names):
            if name in own:
                values = t.column(i).to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(values)
                if known.any() and not known.all():
                    values = np.interp(at, at[known], values[known])
                elif not known.any() and empty is not None:
                    values = np.full(len(values), empty)
                t = t.set_column(i, name, pa.array(values, pa.float64(), from_pandas=True))
        return t

    df = track.df.select(*(F.col(f"`{c}`").cast("double").alias(c) if c in own else F.col(f"`{c}`") for c in track.df.columns))
    return track.on(df.groupBy(*track.keys).applyInArrow(fill, StructType([StructField(f.name, f.dataType, True) for f in df.schema])))


def available_parts(pose: DataFrame, parts: list[str]) -> DataFrame:
    """(video_id, mouse_id, part): the parts that have a value at all."""
    flags = [F.max(F.col(f"{p}_x").isNotNull() & F.col(f"{p}_y").isNotNull()).alias(p) for p in parts]
    wide = pose.groupBy("video_id", "mouse_id").agg(*flags)
    return wide.unpivot(["video_id", "mouse_id"], parts, "part", "known").filter("known").drop("known")


def sanitize(track: Track, columns: list[str]) -> Track:
    """Infinities become gaps, gaps are interpolated, what stays empty is 0."""
    return fill_gaps(track.on(track.df.withColumns({c: finite(F.col(f"`{c}`").cast("double")) for c in columns})), columns, 0.0)


def non_finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_nan, n_pos_inf, n_neg_inf) of the columns with any; NULL counts as NaN."""
    c = lambda n: F.col(f"`{n}`").cast("double")
    n_of = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    inf = float("inf")
    counts = [
        F.struct(F.lit(n).alias("column_name"), n_of(c(n).isNull() | F.isnan(c(n))).alias("n_nan"), n_of(c(n) == inf).alias("n_pos_inf"), n_of(c(n) == -inf).alias("n_neg_inf"))
        for n in columns
    ]
    rows = df.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.filter("n_nan + n_pos_inf + n_neg_inf > 0")


def union_features(parts: list[DataFrame]) -> DataFrame:
    """Sections on top of each other; columns that one lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def like_template(df: DataFrame, keys: list[str], template: list[str], fill: float | None = None) -> DataFrame:
    """The template's columns in its order; those missing are ``fill``, others are dropped."""
    have = set(df.columns)
    return df.select(*keys, *((F.col(f"`{c}`") if c in have else F.lit(fill).cast("double")).alias(c) for c in template))
