"""From frame probabilities to intervals, and repairs of intervals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import Track, centred
from ..functions.scalars import quoted_list

# The threshold of an action without a tuned one, and the shortest run of an action.
DEFAULT_THRESHOLD = 0.27
LEAST_FRAMES = 3


def smooth(track: Track, actions: list[str], width: int = 7) -> Track:
    """Centred means of each action's probability, in place."""
    rolled = track.roll({f"__r_{a}": centred(a, "mean", width) for a in actions})
    return rolled.on(rolled.df.withColumns({a: F.col(f"__r_{a}") for a in actions}).drop(*(f"__r_{a}" for a in actions)))


def only_labelled(scored: DataFrame, labelled: DataFrame, keys: tuple[str, ...], actions: list[str]) -> DataFrame:
    """Probabilities of a pair's labelled actions, NULL for all others; ``labelled`` has the keys and action, few rows a pair."""
    mine = labelled.groupBy(*keys).agg(F.collect_set("action").alias("__mine"))
    has = lambda a: F.array_contains(F.coalesce("__mine", F.array().cast("array<string>")), a)
    return scored.join(mine, list(keys), "left").withColumns({a: F.when(has(a), F.col(a)) for a in actions}).drop("__mine")


def best_action(actions: list[str], thresholds: dict[str, float] | None = None, mask_first: bool = True, default: float = DEFAULT_THRESHOLD) -> Column:
    """The position of the chosen action, -1 for none.

    With ``mask_first`` the largest of those at or above their threshold: a
    runner-up wins where the leader is under its own. Without it the largest
    of all, if at or above its threshold. Ties go to the first action; NULL
    takes no part.
    """
    thresholds = thresholds or {}
    at = [(F.col(a), F.lit(float(thresholds.get(a, default))), i) for i, a in enumerate(actions)]
    ok = lambda p, t: p >= t if mask_first else p.isNotNull()
    options = F.filter(F.array(*(F.when(ok(p, t), F.struct(p.alias("p"), F.lit(-i).alias("i"), t.alias("t"))) for p, t, i in at)), lambda x: x.isNotNull())
    top = F.array_max(options)
    return F.when(top.isNull() | (top["p"] < top["t"]), -1).otherwise(-top["i"])


def to_intervals(track: Track, actions: list[str], chosen: str = "__best", least: int = LEAST_FRAMES, drop_last: bool = True) -> DataFrame:
    """(keys, action, start_frame, stop_frame) of the runs of one action; the stop is the frame where the next run starts.

    The last run of a trajectory has no next one and is dropped, as the
    metric's source does; with ``drop_last`` False it stops after its last
    frame. Runs of fewer than ``least`` frames are noise.
    """
    w = track.window
    change = F.coalesce(F.col(chosen) != F.lag(chosen).over(w), F.lit(True))
    end = F.max(track.order).over(Window.partitionBy(*track.keys)) + 1
    rows = track.df.select(*track.keys, track.order, chosen, change.alias("__new"), end.alias("__end")).filter("__new")
    stop = F.lead(track.order).over(w)
    stop = stop if drop_last else F.coalesce(stop, F.col("__end"))
    runs = rows.select(*track.keys, F.col(chosen).alias("__i"), F.col(track.order).alias("start_frame"), stop.alias("stop_frame"))
    runs = runs.filter(F.col("stop_frame").isNotNull() & (F.col("__i") >= 0) & (F.col("stop_frame") - F.col("start_frame") >= least))
    name = F.element_at(F.array(*map(F.lit, actions)), F.col("__i") + 1)
    return runs.select(*track.keys, name.alias("action"), "start_frame", "stop_frame")


def valid(intervals: DataFrame) -> DataFrame:
    return intervals.filter("start_frame < stop_frame")


def without_overlap(intervals: DataFrame) -> DataFrame:
    """Of each pair's intervals by start (then stop, action), those that start at or after the last kept one's stop.

    What is kept depends on what was: a fold over a pair's sorted intervals,
    which are the behaviour of one pair in one recording, in one run of a
    grouped Arrow function. Starts below 0 go.
    """
    keys, whole = ["video_id", "agent_id", "target_id"], valid(intervals).withColumns({c: F.col(c).cast("int") for c in ("start_frame", "stop_frame")})
    rows = whole.select(*keys, "action", "start_frame", "stop_frame")

    def keep(t: pa.Table) -> pa.Table:
        t = t.sort_by([("start_frame", "ascending"), ("stop_frame", "ascending"), ("action", "ascending")])
        last, kept = 0, []
        for i, (start, stop) in enumerate(zip(t.column("start_frame").to_pylist(), t.column("stop_frame").to_pylist())):
            if start >= last:
                kept.append(i)
                last = stop
        return t.take(pa.array(kept, pa.int64()))

    return rows.groupBy(*keys).applyInArrow(keep, rows.schema)


def tiles(spans: DataFrame, strict: bool = False) -> DataFrame:
    """Equal tiles of a span, one per action.

    ``spans`` has (video_id, agent_id, target_id, actions, first_frame,
    end_frame). Tiles are ceil(span / actions) long and cut at the end, so
    late ones may start behind it; ``strict`` drops those.
    """
    n, lo, hi = F.size("actions"), F.col("first_frame"), F.col("end_frame")
    size = F.ceil((hi - lo) / n)
    rows = spans.select("video_id", "agent_id", "target_id", F.posexplode("actions").alias("i", "action"), lo.alias("lo"), hi.alias("hi"), size.alias("size"))
    start = F.col("lo") + F.col("i") * F.col("size")
    rows = rows.select("video_id", "agent_id", "target_id", "action", start.cast("int").alias("start_frame"), F.least(start + F.col("size"), F.col("hi")).cast("int").alias("stop_frame"))
    return valid(rows) if strict else rows


def fill_missing(intervals: DataFrame, metadata: DataFrame, ranges: DataFrame, strict: bool = False) -> DataFrame:
    """Add tiles of the labelled actions for the videos without any interval.

    ``ranges`` has (video_id, first_frame, end_frame). Actions are in the
    order of the sorted labels; repeated labels count once.
    """
    missing = metadata.filter(F.col("behaviors_labeled").isNotNull()).join(intervals.select("video_id").distinct(), "video_id", "left_anti")
    labels = F.array_sort(F.array_distinct(F.transform(quoted_list(F.col("behaviors_labeled")), lambda x: F.regexp_replace(x, "'", ""))))
    rows = missing.select("video_id", F.posexplode(labels).alias("at", "l")).withColumn("l", F.split("l", ","))
    rows = rows.groupBy("video_id", F.col("l")[0].alias("agent_id"), F.col("l")[1].alias("target_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("l")[2].alias("a")))), lambda x: x["a"]).alias("actions")
    )
    cols = ["video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame"]
    text = intervals.withColumns({c: F.col(c).cast("string") for c in ("agent_id", "target_id")}).select(*cols)
    return text.unionByName(tiles(rows.join(ranges, "video_id"), strict).select(*cols))


def fallback(intervals: DataFrame, row: tuple) -> DataFrame:
    """The intervals, or ``row`` if there are none at all."""
    some = intervals.limit(1).withColumn("__some", F.lit(True)).select("__some")
    default = intervals.sparkSession.createDataFrame([row], intervals.schema)
    return intervals.unionByName(default.join(some, F.lit(True), "left_anti"))


def frame_ranges(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.min("video_frame").alias("first_frame"), (F.max("video_frame") + 1).alias("end_frame"))
