"""Rolling aggregates against pandas one-liners, on random series with gaps and on edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions.ordering import global_row_number
from kinelake.functions.rolling import Track, centred, ewm, future, trailing
from kinelake.functions.scalars import clipped, finite, slug, trailing_number
from kinelake.functions.scaling import scale, scale_signed

KEYS = ("video_id", "mouse_id")


def series(seed=0, n=60):
    rng = random.Random(seed)
    return [None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3) for _ in range(n)]


@pytest.fixture(scope="module")
def track(spark):
    rows = [(1, m, i, v, w) for m in (1, 2) for i, (v, w) in enumerate(zip(series(m), series(m + 10)))]
    rows += [(2, 1, 0, 3.0, None), (2, 2, 0, None, None), (3, 1, 0, 1.0, 1.0), (3, 1, 1, 1.0, 1.0), (3, 1, 2, 1.0, 2.0)]
    return Track(spark.createDataFrame(rows, "video_id int, mouse_id int, video_frame int, a double, b double").repartition(3), KEYS)


def compare(df, names, want):
    pdf = df.toPandas().sort_values([*KEYS, "video_frame"])
    for _, g in pdf.groupby(list(KEYS)):
        a, b = g["a"].astype(float).reset_index(drop=True), g["b"].astype(float).reset_index(drop=True)
        for n in names:
            np.testing.assert_allclose(g[n].astype(float).to_numpy(), want[n](a, b).to_numpy(dtype=float), atol=1e-9, err_msg=n)


@pytest.mark.parametrize("w", [1, 4, 7])
def test_sums_and_extremes(track, w):
    least = max(1, w // 2)
    rolls, want = {}, {}
    for kind in ("mean", "sum", "std", "var", "min", "max", "median", "count"):
        rolls |= {f"c_{kind}": centred("a", kind, w, least), f"t_{kind}": trailing("a", kind, w, least), f"f_{kind}": future("a", kind, w, least)}
        f = lambda r, k=kind: getattr(r, k)()
        if kind == "count":
            continue
        want |= {
            f"c_{kind}": lambda a, b, f=f: f(a.rolling(w, min_periods=least, center=True)), f"t_{kind}": lambda a, b, f=f: f(a.rolling(w, min_periods=least)),
            f"f_{kind}": lambda a, b, f=f: f(a[::-1].rolling(w, min_periods=least))[::-1],
        }
    compare(track.roll(rolls).df, list(want), want)


def test_rank_correlation_slope_and_ewm(track):
    got = track.roll({"r": trailing("a", "rank", 8, 3), "c": trailing("a", "corr", 9, 3, other="b")})
    want = {"r": lambda a, b: a.rolling(8, min_periods=3).rank(pct=True)}
    compare(got.df, ["r"], want)
    pdf = got.df.filter("video_id = 1 AND mouse_id = 1").orderBy("video_frame").toPandas()
    np.testing.assert_allclose(pdf["c"][20:], pdf["a"].rolling(9, min_periods=3).corr(pdf["b"])[20:], atol=1e-9)
    smooth = ewm(track, {"e": ("a", 5)}).join(track.df, [*KEYS, "video_frame"])
    compare(smooth, ["e"], {"e": lambda a, b: a.ewm(span=5, min_periods=1).mean()})
    filled = track.add({"a": F.coalesce("a", F.lit(0.0))}).roll({"s": centred("a", "slope", 7, 2)})

    def slope(x):
        return np.polyfit(np.arange(len(x)), x, 1)[0] if len(x) > 1 else 0.0

    compare(filled.df, ["s"], {"s": lambda a, b: a.fillna(0).rolling(7, min_periods=2, center=True).apply(slope, raw=True)})


def test_constant_and_single_rows(track):
    got = {(r.video_id, r.mouse_id, r.video_frame): r for r in track.roll({"c": trailing("a", "corr", 5, 1, other="b"), "s": trailing("a", "std", 5)}).df.filter("video_id > 1").collect()}
    assert got[3, 1, 2].c is None and got[2, 1, 0].s is None and got[3, 1, 2].s == pytest.approx(0)


def test_one_exchange_and_sort(track):
    plan = track.roll({"m": centred("a", "mean", 5), "x": trailing("b", "max", 9), "v": future("a", "var", 4)}).df
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_scaling_rounds_half_to_even():
    assert [scale(n, f) for n, f in ((15, 25), (5, 25), (1, 10), (10, 60))] == [12, 4, 1, 20]
    assert scale_signed(-10, 25) == -8 and scale_signed(0, 60) == 0 and scale_signed(-1, 3) == -1


def test_scalars_keep_null(spark):
    r = spark.range(1).select(
        clipped(F.lit(None).cast("double"), 0.0, 1.0).alias("a"), clipped(F.lit(3.0), 0.0, 1.0).alias("b"), finite(F.lit(float("nan"))).alias("c"),
        trailing_number(F.lit("mouse12")).alias("d"), trailing_number(F.lit("x")).alias("e"), slug(F.lit("--a b--c!")).alias("f"), slug(F.lit("!")).alias("g"),
        F.length(slug(F.lit("ab " * 60))).alias("h"),
    ).first()
    assert tuple(r) == (None, 1.0, None, 12, None, "a-b-c", "default", 80)


def test_global_row_number_is_total(spark):
    rows = [(i % 7, i) for i in range(200)]
    got = global_row_number(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], "n", 4).orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows) and [r.n for r in got] == list(range(200)) and not math.isnan(got[0].n)
    assert pd.Series([r.n for r in got]).is_unique
