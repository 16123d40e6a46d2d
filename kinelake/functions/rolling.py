"""Rolling aggregates over frame-ordered trajectories.

Means, sums and counts alone come from running sums over the whole trajectory
and their values at the two ends of the frame, as window functions, so their
cost does not depend on the width; a series is centred on its mean first,
against cancellation. Where spreads, extremes, medians, ranks, correlations or
slopes are among the aggregates, one grouped Arrow function computes all of
them in numpy: one pass for any number of aggregates, where window functions
would need a frame of their own for each. Extremes, medians and ranks cost the
same for any width (``order_statistics``), as do means; the others come from sliding views,
in blocks of bounded size. Both share the trajectory's exchange and sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .order_statistics import sliding_extreme, sliding_ranks

SUMS = ("mean", "sum", "count")
#: Values of a sliding view that are worked on at once.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Roll:
    """An aggregate of a column over rows lo..hi around each row; NULL with fewer than ``least`` values."""

    series: str
    kind: str
    lo: int
    hi: int
    least: int = 1
    other: str = ""


def trailing(series: str, kind: str, width: int, least: int = 1, other: str = "") -> Roll:
    return Roll(series, kind, 1 - width, 0, least, other)


def centred(series: str, kind: str, width: int, least: int = 1) -> Roll:
    return Roll(series, kind, -(width // 2), (width - 1) // 2, least)


def future(series: str, kind: str, width: int, least: int = 1) -> Roll:
    return Roll(series, kind, 0, width - 1, least)


@dataclass(frozen=True)
class Track:
    """Trajectories of one frame rate: rows keyed by ``keys``, in the order of ``order``."""

    df: DataFrame
    keys: tuple[str, ...]
    fps: float = 30.0
    order: str = "video_frame"

    @cached_property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def add(self, columns: dict[str, Column]) -> "Track":
        return self.on(self.df.withColumns(columns))

    def on(self, df: DataFrame) -> "Track":
        return Track(df, self.keys, self.fps, self.order)

    def lag(self, c: str, rows: int = 1) -> Column:
        """The value ``rows`` before; a negative number looks ahead."""
        return F.lag(c, rows).over(self.window) if rows >= 0 else F.lead(c, -rows).over(self.window)

    def diff(self, c: str, rows: int = 1) -> Column:
        return F.col(c) - self.lag(c, rows)

    def length(self) -> Column:
        return F.count(F.lit(1)).over(Window.partitionBy(*self.keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def long_enough(self, width: int, c: Column) -> Column:
        """NULL on trajectories shorter than the window."""
        return F.when(F.col("__length") >= width, c)

    def roll(self, rolls: dict[str, Roll], length: bool = False) -> "Track":
        """Add a column for each roll; with ``length`` also the number of the trajectory's rows."""
        return self._slide(rolls, length) if any(r.kind not in SUMS for r in rolls.values()) else self._run(rolls, length)

    def _run(self, rolls: dict[str, Roll], length: bool) -> "Track":
        """Sums by window functions, from running sums."""
        whole = self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        run = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        series = sorted({r.series for r in rolls.values()})
        mean = {f"__m_{s}": F.avg(s).over(whole) for s in series}
        sums: dict[str, Column] = {}
        for s in series:
            off = F.coalesce(F.col(s) - F.col(f"__m_{s}"), F.lit(0.0))
            sums |= {f"__n_{s}": F.count(s).over(run), f"__s_{s}": F.sum(off).over(run)}
        ends: dict[str, Column] = {}

        def at(name: str, shift: int) -> str:
            key = f"{name}_{'b' if shift < 0 else 'f'}{abs(shift)}"
            if shift < 0:
                ends[key] = F.coalesce(F.lag(name, -shift).over(self.window), F.lit(0))
            elif shift:
                ends[key] = F.coalesce(F.lead(name, shift).over(self.window), F.last(name).over(whole))
            else:
                return name
            return key

        def span(name: str, r: Roll) -> Column:
            return F.col(at(name, r.hi)) - F.col(at(name, r.lo - 1))

        out: dict[str, Column] = {}
        for name, r in rolls.items():
            n, s, m = span(f"__n_{r.series}", r), span(f"__s_{r.series}", r), F.col(f"__m_{r.series}")
            out[name] = F.when(n >= r.least, {"mean": F.try_divide(s, n) + m, "sum": s + n * m, "count": n.cast("double")}[r.kind])
        df = self.df.withColumns(mean).withColumns(sums | ({"__length": self.length()} if length else {}))
        df = df.withColumns(ends).withColumns(out)
        return self.on(df.drop(*mean, *sums, *ends))

    def _slide(self, rolls: dict[str, Roll], length: bool) -> "Track":
        """All aggregates by one grouped Arrow function; a trajectory, never more, is in one task's memory."""
        more = [StructField(n, DoubleType()) for n in rolls] + ([StructField("__length", DoubleType())] if length else [])
        order, new = self.order, {f.name for f in more}
        df = self.df.select(*(F.col(f"`{c}`") for c in self.df.columns if c not in new))

        def slide(t: pa.Table) -> pa.Table:
            at = t.column(order).to_numpy()
            if (np.diff(at) < 0).any():
                t = t.take(pa.array(np.argsort(at, kind="stable")))
            get = lambda name: t.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for name, values in aggregates(rolls, get, t.num_rows).items():
                t = t.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
            return t.append_column("__length", pa.array(np.full(t.num_rows, float(t.num_rows)))) if length else t

        return self.on(df.groupBy(*self.keys).applyInArrow(slide, StructType([*df.schema.fields, *more])))


class Steps(Track):
    """A Track that notes what is added to it instead of adding it."""

    def __init__(self, track: Track):
        super().__init__(track.df, track.keys, track.fps, track.order)
        object.__setattr__(self, "phases", [([], {}, False)])

    def add(self, columns: dict[str, Column]) -> "Steps":
        self.phases[-1][0].append(columns)
        return self

    def roll(self, rolls: dict[str, Roll], length: bool = False) -> "Steps":
        layers, before, long = self.phases[-1]
        self.phases[-1] = (layers, before | rolls, long or length)
        self.phases.append(([], {}, False))
        return self


def together(track: Track, groups: list[Callable[[Track], Track]]) -> Track:
    """All groups of features at once: their first rolls in one function on one exchange, then their second ones, and so on.

    A group sees only its own columns and those of ``track``. A name that two
    groups give must mean the same in both.
    """
    noted = []
    for group in groups:
        steps = Steps(track)
        group(steps)
        noted.append(steps.phases)
    given: dict[str, tuple[int, str]] = {}

    def new(columns: dict, who: int) -> dict:
        out = {}
        for name, c in columns.items():
            means = str(c)
            owner, known = given.get(name, (who, None))
            if known == means:
                continue
            if owner != who:
                raise ValueError(f"two groups give {name} a different meaning")
            given[name], out[name] = (who, means), c
        return out

    for phase in range(max(map(len, noted), default=0)):
        now = [(who, p[phase]) for who, p in enumerate(noted) if phase < len(p)]
        for layer in range(max(len(p[0]) for _, p in now)):
            columns: dict[str, Column] = {}
            for who, p in now:
                if layer < len(p[0]):
                    columns |= new(p[0][layer], who)
            track = track.add(columns) if columns else track
        rolls: dict[str, Roll] = {}
        for who, p in now:
            rolls |= new(p[1], who)
        if rolls:
            track = track.roll(rolls, any(p[2] for _, p in now))
    return track


def aggregates(rolls: dict[str, Roll], get: Callable[[str], np.ndarray], n: int, starts: np.ndarray = np.zeros(1, np.int64)) -> dict[str, np.ndarray]:
    """Each roll's values over trajectories in order, ``n`` rows in all, that begin at ``starts``; gaps are NaN.

    Each has its own padding, so that no frame reaches into another; short
    ones share the calls.
    """
    out = {name: np.full(n, np.nan) for name in rolls}
    sizes = np.diff([*starts, n])
    one = np.repeat(np.arange(len(starts)), sizes)
    frames: dict[tuple, list[str]] = {}
    for name, r in rolls.items():
        frames.setdefault((r.series, r.lo, r.hi), []).append(name)
    for (series, lo, hi), names in frames.items():
        width = hi - lo + 1
        # Of the padded series: where each row's frame starts, and where each trajectory's padding does.
        first, bounds = np.arange(n) + one * (width - 1), np.array([*starts, n]) + np.arange(len(starts) + 1) * (width - 1)

        def padded(s: str) -> np.ndarray:
            x = np.full(bounds[-1], np.nan)
            x[first - lo] = get(s)
            return x

        own = padded(series)
        count = _counts(own, width)[first]
        for name in names:
            r = rolls[name]
            if r.kind in WHOLE:
                if r.kind in ALONE:
                    value = np.concatenate([WHOLE[r.kind](own[a:b], width, -lo)[: b - a - width + 1] for a, b in zip(bounds, bounds[1:])])
                else:
                    value = WHOLE[r.kind](own, width, -lo)[first]
                out[name] = np.where(count >= r.least, value, np.nan)
        names = [k for k in names if rolls[k].kind not in WHOLE]
        if not names:
            continue
        views = {s: np.lib.stride_tricks.sliding_window_view(padded(s) if s != series else own, width) for s in {series, *(rolls[k].other for k in names if rolls[k].other)}}
        for at in range(0, n, max(1, BLOCK // width)):
            rows = slice(at, at + max(1, BLOCK // width))
            frame = rows if len(starts) == 1 else first[rows]
            v, c = views[series][frame], count[rows]
            with np.errstate(all="ignore"):
                for name in names:
                    r = rolls[name]
                    value = KINDS[r.kind](v, c, own[first[rows] - lo], views[r.other][frame] if r.other else None)
                    out[name][rows] = np.where(c >= r.least, value, np.nan)
    return out


def _counts(x: np.ndarray, width: int) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    return seen[width:] - seen[:-width]


def _sums(x: np.ndarray, width: int, mean: bool) -> np.ndarray:
    """Sums or means of all frames from running sums, the series being centred against cancellation."""
    known = ~np.isnan(x)
    if not known.any():
        return np.full(len(x) - width + 1, np.nan if mean else 0.0)
    middle = x[known].mean()
    total = np.concatenate([[0.0], np.cumsum(np.where(known, x - middle, 0.0))])
    out, n = total[width:] - total[:-width], _counts(x, width)
    with np.errstate(all="ignore"):
        return out / n + middle if mean else out + n * middle


def _mean(v, c):
    return np.nansum(v, 1) / c


def _var(v, c, *_):
    m = _mean(v, c)
    return np.where(c > 1, np.nansum((v - m[:, None]) ** 2, 1) / (c - 1), np.nan)


def _correlation(v, c, now, other):
    """Pearson's, over the rows that have both values; none where either is constant."""
    both = ~(np.isnan(v) | np.isnan(other))
    n = both.sum(1)
    a, b = np.where(both, v, np.nan), np.where(both, other, np.nan)
    flat = (np.fmin.reduce(a, 1) == np.fmax.reduce(a, 1)) | (np.fmin.reduce(b, 1) == np.fmax.reduce(b, 1))
    a, b = a - _mean(a, n)[:, None], b - _mean(b, n)[:, None]
    return np.where(flat, np.nan, np.nansum(a * b, 1) / np.sqrt(np.nansum(a * a, 1) * np.nansum(b * b, 1)))


def _slope(v, c, *_):
    """Least-squares slope over the values' own positions; 0 for a single one."""
    known = ~np.isnan(v)
    x = np.where(known, np.cumsum(known, 1) - 1.0, np.nan)
    x = x - (c[:, None] - 1) / 2
    slope = np.nansum(x * (v - _mean(v, c)[:, None]), 1) / np.nansum(x * x, 1)
    return np.where(c > 1, slope, 0.0)


#: By kind: (frames' values, how many there are, each frame's own row, another series' frames).
KINDS: dict[str, Callable] = {
    "var": _var, "std": lambda v, c, *_: np.sqrt(_var(v, c)), "corr": _correlation, "slope": _slope,
}
#: By kind: (the padded series, width, rows from a frame's start to its own row), all frames at once.
WHOLE: dict[str, Callable] = {
    "mean": lambda x, width, _: _sums(x, width, True), "sum": lambda x, width, _: _sums(x, width, False), "count": lambda x, width, _: _counts(x, width).astype(float),
    "ewm": lambda x, width, back: pd.Series(x[back:]).ewm(span=width, min_periods=1).mean().to_numpy(),
    "min": lambda x, width, _: sliding_extreme(x, width, np.fmin), "max": lambda x, width, _: sliding_extreme(x, width, np.fmax),
    "median": lambda x, width, back: sliding_ranks(x, width, back, True), "rank": lambda x, width, back: sliding_ranks(x, width, back, False),
}
#: Those that a trajectory has to itself: sums, so that they are rounded by its own values only, and recurrences.
ALONE = ("mean", "sum", "ewm")


def ewm(track: Track, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponentially weighted means (adjusted, from the first value on) as {name: (column, span)}.

    A recurrence over the whole trajectory: one grouped pandas function for all
    columns. A trajectory, never more, is in one task's memory; only keys,
    order and the smoothed columns go there.
    """
    series = sorted({c for c, _ in spans.values()})
    slim = track.df.select(*track.keys, track.order, *series)
    out_schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*track.keys, track.order).schema] + [f"{n} double" for n in spans])
    keys, order = list(track.keys), track.order

    def smooth(pdf):
        pdf = pdf.sort_values(order)
        out = pdf[[*keys, order]].copy()
        for name, (c, span) in spans.items():
            out[name] = pdf[c].astype(float).ewm(span=span, min_periods=1).mean()
        return out

    return slim.groupBy(*keys).applyInPandas(smooth, out_schema)
