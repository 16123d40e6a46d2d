"""F-beta of predicted intervals by frame, averaged over actions and then over labs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quoted_list

COLUMNS = ("video_id", "agent_id", "target_id", "action", "start_frame", "stop_frame")
KEYS = ["lab_id", "video_id", "agent_id", "target_id", "action"]


class OverlapError(ValueError):
    """Two actions predicted for one frame of a pair."""


def validate(solution: DataFrame, submission: DataFrame) -> None:
    """Raise on missing columns, empty tables and intervals that end before they start."""
    for name, df in (("solution", solution), ("submission", submission)):
        missing = [c for c in COLUMNS if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks {missing}")
        bad = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("start_frame") > F.col("stop_frame")).alias("bad")).first()
        if not bad.n:
            raise ValueError(f"{name} is empty")
        if bad.bad:
            raise ValueError(f"{name} has intervals that end before they start")


def _levels(intervals: DataFrame, keys: list[str], counts: tuple[str, ...]) -> DataFrame:
    """(keys, frame, until, counts): between two neighbouring bounds of half-open intervals, how many of each kind are open.

    A sweep over bounds: an interval is +1 at its start and -1 at its stop in
    the columns it has as 1, and running sums tell the rest. The work grows with
    the number of intervals, not of frames.
    """
    some = intervals.filter("stop_frame > start_frame")
    bound = F.explode(F.array(F.struct(F.col("start_frame").alias("frame"), F.lit(1).alias("d")), F.struct(F.col("stop_frame").alias("frame"), F.lit(-1).alias("d"))))
    bounds = some.select(*keys, *counts, bound.alias("b")).groupBy(*keys, F.col("b.frame").alias("frame")).agg(*(F.sum(F.col(c) * F.col("b.d")).alias(c) for c in counts))
    w = Window.partitionBy(*keys).orderBy("frame")
    return bounds.select(*keys, "frame", F.lead("frame").over(w).alias("until"), *(F.sum(c).over(w).alias(c) for c in counts))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("agent_id", "target_id")})


def active_predictions(solution: DataFrame, submission: DataFrame) -> DataFrame:
    """Predictions on the solution's videos whose behaviour is labelled there."""
    lists = solution.groupBy("video_id").agg(F.min("behaviors_labeled").alias("l"), F.min("lab_id").alias("lab_id"))
    active = lists.select("video_id", "lab_id", F.explode(F.array_distinct(quoted_list(F.col("l")))).alias("label"))
    rows = _text(submission).withColumn("label", F.concat_ws(",", "agent_id", "target_id", "action"))
    return rows.join(active, ["video_id", "label"]).select(*KEYS, "start_frame", "stop_frame")


def check_overlap(predictions: DataFrame) -> None:
    """Raise if two actions hold in one frame of a pair. Intervals of one action may overlap."""
    levels = _levels(predictions.withColumn("p", F.lit(1)), KEYS, ("p",)).filter("p > 0")
    several = _levels(levels.withColumnsRenamed({"frame": "start_frame", "until": "stop_frame"}).withColumn("p", F.lit(1)), KEYS[:-1], ("p",))
    if not several.filter("p > 1").isEmpty():
        raise OverlapError("several actions predicted for one frame of a pair")


def action_scores(solution: DataFrame, submission: DataFrame, beta: float = 1.0, truncate: bool = True) -> DataFrame:
    """(lab_id, action, tp, fn, fp, f): frame counts per action of a lab.

    Frames are counted between the bounds of intervals. An action only ever
    predicted, while active, scores 0 and counts; with ``truncate`` actions
    are merged by what follows their last '_'. 0/0 is 0.
    """
    truth = _text(solution).select(*KEYS, "start_frame", "stop_frame", F.lit(1).alias("t"), F.lit(0).alias("p"))
    guess = active_predictions(solution, submission)
    both = _levels(truth.unionByName(guess.withColumns({"t": F.lit(0), "p": F.lit(1)})), KEYS, ("t", "p"))
    name = F.substring_index("action", "_", -1) if truncate else F.col("action")
    n = lambda a, b: F.coalesce(F.sum(F.when(a & b, (F.col("until") - F.col("frame")).cast("long"))), F.lit(0))
    t, p = F.col("t") > 0, F.col("p") > 0
    counts = both.groupBy("lab_id", name.alias("action")).agg(n(t, p).alias("tp"), n(t, ~p).alias("fn"), n(~t, p).alias("fp"))
    # Labelled or predicted with no frame at all: an action that counts, with 0.
    named = _text(solution).select("lab_id", name.alias("action")).union(guess.select("lab_id", name.alias("action"))).distinct()
    rows = named.join(counts, ["lab_id", "action"], "left").fillna(0, ["tp", "fn", "fp"])
    b2 = beta * beta
    f = F.try_divide((1 + b2) * F.col("tp"), (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp"))
    return rows.withColumn("f", F.coalesce(f, F.lit(0.0)))


def lab_scores(solution: DataFrame, submission: DataFrame, beta: float = 1.0) -> DataFrame:
    return action_scores(solution, submission, beta).groupBy("lab_id").agg(F.avg("f").alias("f"))


def score(solution: DataFrame, submission: DataFrame, beta: float = 1.0, row_id: str | None = None) -> float:
    """The mean over labs; raises on invalid input and on overlapping predictions."""
    if row_id:
        solution, submission = solution.drop(row_id), submission.drop(row_id)
    validate(solution, submission)
    check_overlap(active_predictions(solution, submission))
    return lab_scores(solution, submission, beta).agg(F.avg("f")).first()[0]
