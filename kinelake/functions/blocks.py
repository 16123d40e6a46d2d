"""Trajectories in blocks of rows, so that a recording of any length fills many tasks and none holds a whole one.

Two ways to be exact across the cuts:

* ``cut`` deals spans of neighbouring blocks with a halo, the rows around them
  that windows and lags of their own rows reach; in the task each block has a
  halo of its own, and is a short trajectory.
* ``block_scan`` is for what reaches any distance: every block is summed up in
  one row, the rows of a trajectory are composed in order, and each block goes
  on from what the blocks around it come to.

Rows are numbered by ``numbered``, itself a scan over ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .rolling import Roll, Track, aggregates
from .scan import scan, whole_groups

#: Rows of a block: with some 250 columns, 64 MB in a task.
SIZE = 1 << 15
#: Blocks go to tasks in spans of neighbours, of so many times the halo at least.
SPAN = 8
#: Rows of blocks, their halos included, that are worked on at once, or one block.
LOT = 1 << 15
Write = Callable[[DataFrame], DataFrame]


def numbered(track: Track, write: Write) -> Track:
    """Add ``row``, from 0 in each trajectory; ``track.df`` is a written table."""
    rows = scan(track.df, list(track.keys), [F.col(track.order)], write, "row")
    return track.on(rows.withColumn("row", F.col("row") - 1))


@dataclass(frozen=True)
class Spans(Track):
    """Trajectories in spans of blocks with halos, as ``cut`` deals them. A span is a trajectory to window functions, a block is one to functions in Arrow."""

    size: int = SIZE
    halo: int = 0

    def on(self, df: DataFrame) -> "Spans":
        return Spans(df, self.keys, self.fps, self.order, self.size, self.halo)

    def _slide(self, rolls: dict[str, Roll], length: bool) -> "Spans":
        """As of a track. The spans' own rows come back, and are dealt again with the halos' new columns, so that a row is shuffled about once however small a block."""
        more = [StructField(n, DoubleType()) for n in rolls] + ([StructField("__length", DoubleType())] if length else [])
        keys, size, halo = list(self.keys), self.size, self.halo
        gone = {"__span", "__own", *(f.name for f in more)}
        kept = [f for f in self.df.schema.fields if f.name not in gone]
        names = [f.name for f in kept]

        def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, starts in whole_groups(batches, keys):
                row, own = t.column("row").to_numpy(), t.column("__own").to_numpy(zero_copy_only=False)
                ends, todo, series = [*starts[1:], len(row)], [], {}
                out = {f.name: np.full(len(row), np.nan) for f in more}

                def get(name: str) -> np.ndarray:
                    if name not in series:
                        series[name] = t.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
                    return series[name]

                def work() -> None:
                    at = np.concatenate([np.arange(a, b) for a, b, *_ in todo])
                    begin = np.cumsum([0, *(b - a for a, b, *_ in todo)])
                    mine = np.concatenate([np.arange(c, d) - a + i for (a, _, c, d), i in zip(todo, begin)])
                    for name, values in aggregates(rolls, lambda s: get(s)[at], len(at), begin[:-1]).items():
                        out[name][at[mine]] = values[mine]
                    if length:
                        out["__length"][at[mine]] = np.repeat([float(b - a) for a, b, *_ in todo], [d - c for *_, c, d in todo])
                    todo.clear()

                n = 0
                for a, b in zip(starts, ends):
                    here, places = row[a:b], row[a:b][own[a:b]]
                    for k in range(places[0] // size, places[-1] // size + 1) if len(places) else ():
                        reach = [k * size - halo, (k + 1) * size + halo, max(k * size, places[0]), min((k + 1) * size, places[-1] + 1)]
                        todo.append(tuple(a + np.searchsorted(here, reach)))
                        n += todo[-1][1] - todo[-1][0]
                        if n >= LOT:
                            work()
                            n = 0
                if todo:
                    work()
                t = t.select(names)
                for name, values in out.items():
                    t = t.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
                yield from t.filter(pa.array(own)).to_batches()

        df = self.df.drop(*(f.name for f in more)).sortWithinPartitions(*keys, "row")
        return cut(Track(df.mapInArrow(slide, StructType([*kept, *more])), self.keys[:-1], self.fps, self.order), size, halo)


def cut(track: Track, size: int, halo: int) -> Spans:
    """The trajectories in blocks, each with up to ``halo`` rows of its neighbours on both sides; ``track.df`` has ``row``.

    Windows and lags that reach at most ``halo`` rows are exact on a block's
    own rows. So are lengths that are compared to at most that many rows: a
    block after the first has its halo, and the first one is as long as the
    trajectory or longer than the halo, if ``size`` is.

    What is added to the spans must keep each row in its task.
    """
    at, rows = F.col("row"), size * max(1, -(-SPAN * halo // size))
    spans = F.sequence(F.greatest(F.floor((at - halo) / rows), F.lit(0)), F.floor((at + halo) / rows))
    df = track.df.withColumn("__span", F.explode(spans)).withColumn("__own", F.floor(at / rows) == F.col("__span"))
    return Spans(df.repartition(*track.keys, "__span"), (*track.keys, "__span"), track.fps, track.order, size, halo)


def own_rows(track: Spans) -> Track:
    """The blocks' own rows, as rows of whole trajectories again."""
    return Track(track.df.filter("__own").drop("__own", "__span"), track.keys[:-1], track.fps, track.order)


def block_scan(track: Track, columns: list[str], size: int, write: Write, summarise: Callable, compose: Callable, finish: Callable, out: list[StructField]) -> DataFrame:
    """Rows with the columns of ``out`` set by ``finish``.

    summarise(values, rows, starts) -> the states of blocks, a vector each, from their columns by name and where each starts;
    compose(states, lengths) -> for each block of a trajectory in order what it starts from, a row each;
    finish(values, rows, starts, states) -> columns by name.
    Blocks come many at a time, as far as a task's batches go.
    """
    keys = list(track.keys)
    at = [*keys, "__block"]
    fields = {f.name: f for f in track.df.schema.fields}
    state = StructType([*(fields[k] for k in keys), StructField("__block", LongType()), StructField("__n", LongType()), StructField("__state", ArrayType(DoubleType()))])
    rows = track.df.withColumn("__block", F.floor(F.col("row") / size))

    def inputs(t: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        get = lambda n: t.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False)
        return {c: get(c) for c in columns}, t.column("row").to_numpy()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, at):
            found = list(np.asarray(summarise(*inputs(t), starts), float))
            first = {k: t.column(k).take(pa.array(starts)) for k in at}
            yield from pa.table({**first, "__n": pa.array(np.diff([*starts, t.num_rows])), "__state": pa.array(found, pa.list_(pa.float64()))}).to_batches()

    def carried(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("__block").to_numpy())))
        states = np.array(t.column("__state").to_pylist(), float).reshape(t.num_rows, -1)
        started = compose(states, t.column("__n").to_numpy())
        return t.set_column(t.column_names.index("__state"), "__state", pa.array(list(started), pa.list_(pa.float64())))

    names = {f.name for f in out}
    kept = [c for c in track.df.columns if c not in names]
    schema = StructType([*(fields[c] for c in kept), *out])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's first row has its state."""
        for t, starts in whole_groups(batches, at):
            states = np.stack(t.column("__state").take(pa.array(starts)).to_numpy(zero_copy_only=False))
            t, starts = t.filter(pc.greater_equal(t.column("row"), 0)), starts - np.arange(len(starts))
            done = finish(*inputs(t), starts, states)
            t = t.select(kept)
            for name in (f.name for f in out):
                t = t.append_column(name, pa.array(done[name], pa.float64(), from_pandas=True))
            yield from t.to_batches()

    slim = rows.select(*at, "row", *(F.col(f"`{c}`") for c in columns)).repartition(*at).sortWithinPartitions(*at, "row")
    summaries = write(slim.mapInArrow(summary, state))
    starts = summaries.groupBy(*keys).applyInArrow(carried, state).select(*at, F.lit(-1).cast(fields["row"].dataType).alias("row"), "__state")
    both = rows.unionByName(starts, allowMissingColumns=True)
    return both.repartition(*at).sortWithinPartitions(*at, "row").mapInArrow(finished, schema)


def _decay(span: int) -> float:
    return (span - 1) / (span + 1)


def decayed(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values, and of how many there are, where all earlier rows count less by a factor each row."""
    known = ~np.isnan(values)
    run = lambda x: pd.Series(x).ewm(alpha=1 - _decay(span), adjust=True).sum().to_numpy()
    return run(np.where(known, values, 0.0)), run(known.astype(float))


def smoothed(track: Track, spans: dict[str, tuple[str, int]], write: Write, size: int = SIZE) -> DataFrame:
    """Exponentially weighted means (adjusted, from the first value on) as {name: (column, span)}, across blocks.

    A block comes to two decayed sums a column; those before it count for as
    much less as the block has rows.
    """
    columns, each = sorted({c for c, _ in spans.values()}), list(spans.values())
    factors = np.repeat([_decay(s) for _, s in each], 2)

    def summarise(values, rows, starts):
        return [[x[-1] for c, span in each for x in decayed(values[c][a:b], span)] for a, b in zip(starts, [*starts[1:], len(rows)])]

    def compose(states, lengths):
        out, now = np.zeros_like(states), np.zeros(len(factors))
        for i, (state, n) in enumerate(zip(states, lengths)):
            out[i], now = now, now * factors**n + state
        return out

    def finish(values, rows, starts, states):
        sizes = np.diff([*starts, len(rows)])
        out, ago = {}, np.arange(1, len(rows) + 1) - np.repeat(starts, sizes)
        for i, (name, (c, span)) in enumerate(spans.items()):
            total, weight = (np.concatenate(x) for x in zip(*(decayed(values[c][a : a + n], span) for a, n in zip(starts, sizes))))
            left, (sums, weights) = _decay(span) ** ago, (np.repeat(states[:, 2 * i + k], sizes) for k in (0, 1))
            weight = weight + weights * left
            with np.errstate(all="ignore"):
                out[name] = np.where(weight > 0, (total + sums * left) / weight, np.nan)
        return out

    return block_scan(track, columns, size, write, summarise, compose, finish, [StructField(n, DoubleType()) for n in spans])


def filled(track: Track, columns: list[str], write: Write, size: int = SIZE, empty: float | None = None) -> DataFrame:
    """Linear interpolation by row, held constant before the first and after the last value, across blocks.

    A block goes on from the last value known before it to the first one known
    after it. A column without any value in a trajectory becomes ``empty``.
    """

    def near(known, starts):
        """Of each row: the last known one up to it and the first one from it on within its block, and whether there are."""
        n, sizes = len(known), np.diff([*starts, len(known)])
        before = np.maximum.accumulate(np.where(known, np.arange(n), -1))
        after = np.minimum.accumulate(np.where(known, np.arange(n), n)[::-1])[::-1]
        return before, after, before >= np.repeat(starts, sizes), after < np.repeat(starts + sizes, sizes)

    def summarise(values, rows, starts):
        """Row and value of the first and last known value; NaN without any."""
        out, ends = np.full((len(starts), len(columns), 4), np.nan), np.array([*starts[1:], len(rows)]) - 1
        for i, c in enumerate(columns):
            before, after, _, _ = near(~np.isnan(values[c]), starts)
            some = after[starts] <= ends
            a, z = after[starts][some], before[ends][some]
            out[some, i] = np.stack([rows[a], values[c][a], rows[z], values[c][z]], 1)
        return out.reshape(len(starts), -1)

    def compose(states, _):
        states, out = states.reshape(len(states), -1, 4), None
        out = np.full_like(states, np.nan)
        now = np.full((states.shape[1], 2), np.nan)
        for i in range(len(states)):
            out[i, :, :2] = now
            now = np.where(np.isnan(states[i, :, 2:3]), now, states[i, :, 2:])
        now = np.full((states.shape[1], 2), np.nan)
        for i in reversed(range(len(states))):
            out[i, :, 2:] = now
            now = np.where(np.isnan(states[i, :, :1]), now, states[i, :, :2])
        return out.reshape(len(states), -1)

    def finish(values, rows, starts, states):
        out, sizes = {}, np.diff([*starts, len(rows)])
        for i, c in enumerate(columns):
            v = values[c]
            known = ~np.isnan(v)
            if known.all():
                out[c] = v
                continue
            before, after, had, has = near(known, starts)
            ends = np.repeat(states[:, 4 * i : 4 * i + 4], sizes, 0)
            x0, y0 = np.where(had, rows[before], ends[:, 0]), np.where(had, v[before], ends[:, 1])
            after = np.minimum(after, len(rows) - 1)
            x1, y1 = np.where(has, rows[after], ends[:, 2]), np.where(has, v[after], ends[:, 3])
            with np.errstate(all="ignore"):
                line = (y1 - y0) / (x1 - x0) * (rows - x0) + y0
            alone = np.where(np.isnan(x0), y1, y0)
            found = np.where(np.isnan(x0) | np.isnan(x1), alone, line)
            none = np.isnan(x0) & np.isnan(x1)
            out[c] = np.where(known, v, np.where(none, np.nan if empty is None else empty, found))
        return out

    return block_scan(track, columns, size, write, summarise, compose, finish, [StructField(c, DoubleType()) for c in columns])
