"""Running totals over ordered groups of any size: a group's rows may fill many tasks.

Rows are dealt by ranges of (keys, order) and sorted, so a group is cut where
a range ends. Each task runs over its own rows; the totals of the group that
goes on in the next range, one row a range, are summed up in order and added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


def group_starts(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which rows of a sorted batch begin a group, ``last`` being the keys of the row before it; and the keys of its last row."""
    new = np.zeros(batch.num_rows, bool)
    columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    for c in columns:
        codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first, end = (tuple(c[i].as_py() for c in columns) for i in (0, batch.num_rows - 1))
    new[0] = last is None or first != last
    return new, end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 13) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a sorted task, as soon as ``rows`` rows are held, and where each group starts."""
    held, starts, n, last = [], [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new, last = group_starts(batch, keys, last)
        at = np.flatnonzero(new)
        if n >= rows and len(at):
            yield pa.Table.from_batches([*held, batch.slice(0, at[-1])]), np.array([*starts, *(n + at[:-1])])
            held, starts, n = [batch.slice(at[-1])], [0], batch.num_rows - at[-1]
        else:
            held, starts, n = [*held, batch], [*starts, *(n + at)], n + batch.num_rows
    if n:
        yield pa.Table.from_batches(held), np.array(starts)


def _restarted(values: np.ndarray, start: np.ndarray, carry: int, op: np.ufunc, undo: np.ufunc) -> np.ndarray:
    """Running ``op`` that begins anew where each row's ``start`` says; rows before the first start go on from ``carry``."""
    with np.errstate(over="ignore"):
        total = op.accumulate(values)
        before = np.concatenate([[op.identity], total])[np.maximum(start, 0)]
        return np.where(start < 0, op(total, carry), undo(total, before))


def scan(rows: DataFrame, keys: list[str], order: list[Column], write: Callable[[DataFrame], DataFrame], at: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with each row's position in its group from 1 as ``at``, and long columns replaced by their running sum or exclusive-or, its own value included.

    ``write`` stores a table and reads it back: ``rows`` should be stored
    already, for the ranges are found in a pass of their own. ``order`` must
    decide between any two rows of a group. Values must not be NULL.
    """
    schema = StructType([*rows.schema.fields, StructField(at, LongType()), StructField("__part", IntegerType())])
    running = {**{c: (np.add, np.subtract) for c in sums}, **{c: (np.bitwise_xor, np.bitwise_xor) for c in xors}}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, dict.fromkeys([at, *running], np.int64(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = group_starts(batch, keys, last)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            out = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for name, (op, undo) in {at: (np.add, np.subtract), **running}.items():
                own = np.ones(len(new), np.int64) if name == at else out[name].to_numpy(zero_copy_only=False)
                values = _restarted(own, start, carry[name], op, undo)
                carry[name], out[name] = values[-1], pa.array(values, pa.int64())
            out["__part"] = pa.array(np.full(len(new), part, np.int32))
            yield pa.RecordBatch.from_pydict(out)

    ranged = rows.repartitionByRange(*(F.col(k).asc() for k in keys), *order).sortWithinPartitions(*(F.col(k).asc() for k in keys), *order)
    done = write(ranged.mapInArrow(local, schema))
    key = F.struct(*(F.col(k) for k in keys))
    edges = done.groupBy("__part").agg(F.min(key).alias("__a"), F.max(F.struct(key.alias("k"), at, *running)).alias("__z"))
    # A row a range from here on.
    upto = Window.partitionBy("__z.k").orderBy("__part")
    total = {c: F.bit_xor(f"__z.{c}") if c in xors else F.sum(f"__z.{c}") for c in [at, *running]}
    edges = edges.select("__part", "__a", F.col("__z.k").alias("__k"), *(t.over(upto).alias(f"__c_{c}") for c, t in total.items()))
    before, goes_on = Window.orderBy("__part"), F.lag("__k").over(Window.orderBy("__part")) == F.col("__a")
    carried = edges.select("__part", "__a", *(F.when(goes_on, F.lag(f"__c_{c}").over(before)).alias(f"__c_{c}") for c in total)).filter(f"`__c_{at}` IS NOT NULL")
    carried = carried.withColumnRenamed("__part", "__p")
    joined = done.join(F.broadcast(carried), (F.col("__part") == F.col("__p")) & key.eqNullSafe(F.col("__a")), "left")
    whole = {c: (F.col(c).bitwiseXOR(F.coalesce(f"__c_{c}", F.lit(0))) if c in xors else F.col(c) + F.coalesce(f"__c_{c}", F.lit(0))) for c in total}
    return joined.withColumns(whole).select(*(F.col(f"`{f.name}`") for f in schema.fields if f.name != "__part"))
