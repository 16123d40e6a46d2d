"""Trajectories cut into blocks give what whole ones give."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions import blocks
from kinelake.functions.rolling import Roll, Track, aggregates, centred, ewm, future, together, trailing
from kinelake.operators import pair, pose, single
from kinelake.plans import behaviour
from kinelake.plans.views import view

from .conftest import SF

KEYS = ("video_id", "mouse_id")
PARTS = ["body_center", "nose", "tail_base", "ear_left", "ear_right"]


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    def stored(df):
        path = f"{tmp_path_factory.mktemp('blocks')}/rows"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return stored


@pytest.fixture(scope="module")
def track(spark, write):
    rng = random.Random(2)
    gap = lambda i: i < 37 or i > 260 or 90 < i < 140 or rng.random() < 0.2
    rows = [(1, m, 3 * i + (i > 50), None if gap(i) else rng.uniform(-5, 5), None if m == 2 else rng.uniform(0, 9)) for m in (1, 2, 3) for i in range(300)]
    rows += [(2, 1, 0, 3.0, None), (2, 2, 0, None, None)] + [(3, 1, i, float(i), None) for i in range(10)]
    return blocks.numbered(Track(write(spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double").repartition(4)), KEYS), write)


def same(got, want, columns, keys=(*KEYS, "video_frame")):
    """Both tables have the same rows, and the same values up to rounding."""
    g, w = (df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns)).toPandas().sort_values(list(keys)).reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(g[list(keys)], w[list(keys)])
    for c in columns:
        np.testing.assert_allclose(g[c].astype(float), w[c].astype(float), rtol=1e-6, atol=1e-7, err_msg=c)


def test_rows_are_numbered_in_order(track):
    rows = track.df.toPandas().sort_values([*KEYS, "video_frame"])
    for _, g in rows.groupby(list(KEYS)):
        assert g["row"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("size", [30, 299, 1000])
def test_windows_reach_into_the_halo(track, size):
    rolls = {
        "m": centred("a", "mean", 25, 2), "v": trailing("a", "var", 29, 3), "x": future("a", "max", 30), "r": trailing("a", "rank", 20, 2),
        "d": centred("a", "median", 11), "c": trailing("a", "corr", 29, 2, other="b"), "s": centred("b", "slope", 15, 2),
    }
    cut = blocks.own_rows(blocks.cut(track, size, 30).add({"l": F.lit(0.0)}).roll(rolls))
    lagged = blocks.cut(track, size, 30)
    lagged = blocks.own_rows(lagged.add({"back": lagged.lag("a", 30), "ahead": lagged.lag("b", -30)}))
    same(cut.df, track.roll(rolls).df, list(rolls))
    same(lagged.df, track.add({"back": track.lag("a", 30), "ahead": track.lag("b", -30)}).df, ["back", "ahead"])


def test_a_row_is_dealt_about_once_however_small_a_block(track):
    """Of blocks of 5 rows with halos of 30 on both sides, thirteen copies of a row would be shuffled; here only the spans' halos are."""
    n, rolls = track.df.count(), {"m": centred("a", "median", 25, 2), "v": trailing("b", "var", 29, 3)}
    cut = blocks.cut(track, 5, 30)
    rolled = cut.roll(rolls, length=True)
    again = rolled.roll({"w": centred("m", "mean", 9), "x": trailing("v", "max", 20)})
    assert max(c.df.count() for c in (cut, rolled, again)) < 1.4 * n
    both = track.roll(rolls).roll({"w": centred("m", "mean", 9), "x": trailing("v", "max", 20)})
    same(blocks.own_rows(again).df, both.df, [*rolls, "w", "x"])


def test_short_trajectories_share_a_call_without_meeting():
    rng = np.random.default_rng(3)
    sizes = [1, 40, 3, 1, 200, 17]
    values = {c: np.where(rng.random(sum(sizes)) < 0.2, np.nan, rng.normal(size=sum(sizes)) * np.repeat([1, 1e6, 1e-3, 1, 1e3, 1], sizes)) for c in "ab"}
    rolls = {f"{kind}{lo}{hi}": Roll("a", kind, lo, hi, 2, "b" if kind == "corr" else "") for kind in ("mean", "sum", "count", "min", "max", "median", "rank", "ewm", "var", "std", "corr", "slope") for lo, hi in ((-29, 0), (-7, 6), (0, 11))}
    starts = np.cumsum([0, *sizes[:-1]])
    got = aggregates(rolls, values.get, sum(sizes), starts)
    for a, n in zip(starts, sizes):
        for name, want in aggregates(rolls, lambda c: values[c][a : a + n], n).items():
            np.testing.assert_array_equal(got[name][a : a + n], want, err_msg=name)


@pytest.mark.parametrize("size", [1, 30, 1000])
def test_smoothing_goes_on_over_blocks(track, write, size):
    spans = {"a5": ("a", 5), "a60": ("a", 60), "b1": ("b", 1), "b9": ("b", 9)}
    same(blocks.smoothed(track, spans, write, size), ewm(track, spans), list(spans))


@pytest.mark.parametrize("empty", [None, 0.0])
@pytest.mark.parametrize("size", [1, 30, 1000])
def test_gaps_are_filled_over_blocks(track, write, size, empty):
    same(blocks.filled(track, ["a", "b"], write, size, empty), pose.fill_gaps(track, ["a", "b"], empty).df, ["a", "b"])


def test_blocks_are_filled_many_at_a_time(spark, write):
    """A call for each short trajectory was most of a study's time: no function is called by group of rows."""
    rows = write(spark.range(1000).select((F.col("id") % 100).cast("int").alias("video_id"), F.lit(1).alias("mouse_id"), F.expr("CAST(id DIV 100 AS INT)").alias("video_frame"), F.when(F.col("id") % 7 > 2, F.col("id").cast("double")).alias("a")).coalesce(1))
    track = blocks.numbered(Track(rows, KEYS), write)
    filled = blocks.filled(track, ["a"], write, 1000)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and plan.count("MapInArrow") >= 1
    same(filled, pose.fill_gaps(track, ["a"], None).df, ["a"])


def poses(spark, fps):
    return view(spark, SF, "pose").filter("video_id = 0").drop("fps", "event_id")


def test_groups_together_are_the_groups_one_by_one(spark):
    track, groups = Track(poses(spark, 30), KEYS, 30), [single.centre_statistics, single.speed_states, single.multiscale_speed, single.grooming, single.segments, single.ears]
    both = together(track, groups).df
    for group in groups:
        alone = group(track).df
        same(both, alone, [c for c in alone.columns if c not in track.df.columns and not c.startswith("__")])
    with pytest.raises(ValueError):
        together(track, [lambda t: t.add({"__z": F.lit(1)}), lambda t: t.add({"__z": F.lit(2)})])


def test_matrices_of_cut_trajectories(spark, write):
    """About ten blocks a trajectory; single features reach further than a block."""
    rows = write(poses(spark, 60))
    numbered = blocks.numbered(Track(rows, KEYS), write).df
    keys = [*KEYS, "video_frame"]
    whole = write(behaviour.single_matrix(rows, PARTS, 60))
    columns = [c for c in whole.columns if c not in keys]
    assert {"ear_left+ear_right", "sp_lf_l5", "cx_m5", "elong", "x_e240", "sp_pct240", "trans_120"} <= set(columns) and len(columns) > 160
    cut = behaviour.Blocks(write, 35)
    same(behaviour.single_matrix(numbered, PARTS, 60, cut=cut), whole, columns)
    pairs, keys = pair.ordered_pairs(rows), [*behaviour.PAIR_KEYS, "video_frame"]
    whole = write(behaviour.pair_matrix(rows, pairs, ["body_center", "nose"], 60))
    same(behaviour.pair_matrix(numbered, pairs, ["body_center", "nose"], 60, cut=cut), whole, [c for c in whole.columns if c not in keys], keys)


def test_a_matrix_is_one_function_on_two_exchanges(spark, write):
    """First windows of all groups in one function; its second windows, on what the first found, are window functions."""
    plan = behaviour.single_matrix(write(poses(spark, 30)), PARTS, 30, clean=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and plan.count("Exchange hashpartitioning") == 2
