"""Hard negatives by a secondary sort of scored pairs.

Anchors are scored against all rows in blocks; a block keeps of each anchor
only what could be among the first of it, so the pairs that are shuffled are
few a block, however many rows there are. A pair is packed into one key of
(anchor, descending score, positive before negative, id), and
repartitionAndSortWithinPartitions brings those of an anchor together in
order. An iterator then streams over a partition: a positive opens a window of
scores, a negative is emitted to each window it is in, and a window is closed
once it is full or passed. It holds an anchor's open windows, never its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialise, table

#: Rows scored at once, against as many anchors.
ROWS = 2048
#: Bytes of anchors that go to every task at once; more anchors are more passes over the rows.
ANCHOR_BYTES = 32 << 20
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies from LOW / 100 to HIGH / 100 of the positive's.
LOW, HIGH = 50, 95
#: Scores below this are exact in sums of doubles, and leave room for a place in a block.
EXACT = 2**50
_FAR = np.int64(-(2**62))
_BIAS = np.uint64(1 << 63)
KEY_BYTES = 25


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): rows with a label and finite components only; every seventh id has the next label."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def anchors_of(rows: DataFrame, every: int = 50) -> DataFrame:
    """The rows whose id ``every`` divides, one for each id: the one with the smallest label, then vector."""
    first = F.min(F.struct("label", "vector"))
    return rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(first.alias("f")).select("vec_id", "f.label", "f.vector")


@dataclass
class Block:
    """Rows in order of their ids; codes are whole numbers, shorter vectors end in zeros."""

    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    windows: np.ndarray | None = None


def block(batch: pa.RecordBatch | pa.Table) -> Block:
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    ids, labels = (get(n).to_numpy(zero_copy_only=False) if isinstance(get(n), pa.Array) else get(n).to_numpy() for n in ("vec_id", "label"))
    vector = get("vector").combine_chunks() if isinstance(get("vector"), pa.ChunkedArray) else get("vector")
    sizes = np.diff(vector.offsets.to_numpy())
    codes = np.zeros((len(ids), int(sizes.max(initial=0))))
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.floor(256 * vector.flatten().to_numpy(zero_copy_only=False))
    order = np.lexsort((labels, ids))
    return Block(ids[order], labels[order], codes[order])


def blocks(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[Block]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield block(batch.slice(at, most))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond a long they are its ends."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = dim * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(a).dot(whole(b).T) if dim else np.zeros((len(a), len(b)), object)
    return np.array([[max(min(int(x), 2**63 - 1), -(2**63)) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def _first(found: np.ndarray, allowed: np.ndarray, most: int) -> np.ndarray:
    """(row, most) columns of the first allowed scores of each row, higher first, then earlier; -1 where there are no more."""
    n = found.shape[1]
    if not n:
        return np.full((len(found), most), -1)
    if np.abs(found).max(initial=0) < EXACT:
        packed = np.where(allowed, found * n + (n - 1 - np.arange(n)), _FAR)
        if n > most:
            packed = np.partition(packed, n - most, axis=1)[:, n - most :]
        packed = np.sort(packed, axis=1)[:, ::-1]
        columns = np.where(packed == _FAR, -1, n - 1 - packed % n)
    else:
        order = np.lexsort((np.broadcast_to(np.arange(n), found.shape), ~found, ~allowed), axis=1)[:, :most]
        columns = np.where(np.take_along_axis(allowed, order, 1), order, -1)
    return np.pad(columns, ((0, 0), (0, most - columns.shape[1])), constant_values=-1)


def pack(anchor: np.ndarray, score: np.ndarray, negative: bool, ids: np.ndarray) -> pa.RecordBatch:
    """One key a pair; bytes in their order are pairs in theirs."""
    out = np.empty((len(ids), KEY_BYTES), np.uint8)
    part = lambda v: np.ascontiguousarray(v).astype(">u8").view(np.uint8).reshape(-1, 8)
    biased = lambda v: v.astype(np.int64).view(np.uint64) ^ _BIAS
    out[:, :8], out[:, 8:16], out[:, 16], out[:, 17:] = part(biased(anchor)), part(~biased(score)), int(negative), part(biased(ids))
    offsets = pa.py_buffer((np.arange(len(ids) + 1) * KEY_BYTES).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(out.tobytes())])], ["key"])


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    """(anchor, score, negative, id)"""
    big = lambda at: int.from_bytes(key[at : at + 8], "big")
    return big(0) - 2**63, 2**63 - 1 - big(8), key[16] == 1, big(17) - 2**63


def _raised(bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The best scores known so far, the least of them first, after those of one more block."""
    return np.sort(np.concatenate([bounds, found], axis=-1), axis=-1)[..., found.shape[-1] :]


def positive_pairs(anchors: Block, rows: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    """Of each block of rows, each anchor's first rows of its label that no earlier block of the task rules out."""
    best = np.full((len(anchors.ids), POSITIVES), _FAR)
    for r in rows:
        for label in np.intersect1d(anchors.labels, r.labels):
            own, of = np.flatnonzero(anchors.labels == label), np.flatnonzero(r.labels == label)
            for at in range(0, len(own), ROWS):
                a = own[at : at + ROWS]
                found = scores(anchors.codes[a], r.codes[of])
                j = _first(found, anchors.ids[a][:, None] != r.ids[of][None, :], POSITIVES)
                value = np.where(j >= 0, np.take_along_axis(found, np.maximum(j, 0), 1), _FAR)
                i, k = np.nonzero((j >= 0) & (value >= best[a][:, :1]))
                best[a] = _raised(best[a], value)
                yield pack(anchors.ids[a][i], value[i, k], False, r.ids[of][j[i, k]])


def negative_pairs(anchors: Block, rows: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    """Of each block of rows, the first of another label in each window of each anchor that no earlier block of the task rules out."""
    best = np.full((*anchors.windows.shape[:2], NEGATIVES), _FAR)
    for r in rows:
        for at in range(0, len(anchors.ids), ROWS):
            a = slice(at, at + ROWS)
            found, picked = scores(anchors.codes[a], r.codes), []
            other = (anchors.labels[a][:, None] != r.labels[None, :]) & (anchors.ids[a][:, None] != r.ids[None, :])
            for w in range(anchors.windows.shape[1]):
                low, high = anchors.windows[a, w, 0], anchors.windows[a, w, 1]
                if not (low <= high).any():
                    continue
                low = np.maximum(low, best[a, w, 0])
                j = _first(found, other & (found >= low[:, None]) & (found <= high[:, None]), NEGATIVES)
                best[a, w] = _raised(best[a, w], np.where(j >= 0, np.take_along_axis(found, np.maximum(j, 0), 1), _FAR))
                i, k = np.nonzero(j >= 0)
                picked.append(i * len(r.ids) + j[i, k])
            if picked:  # a row in several windows is one pair
                i, j = np.divmod(np.unique(np.concatenate(picked)), len(r.ids))
                yield pack(anchors.ids[a][i], found[i, j], True, r.ids[j])


def window(positive: int) -> tuple[int, int]:
    """The least and the greatest score of a negative; none where the first is greater."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def secondary_sort(keys: DataFrame, reduce: Callable[[Iterator[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """Keys of one anchor in one partition, in order, through ``reduce``: a function of an iterator over the keys of a partition."""
    spark = keys.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), keys.count() // 1_000_000)
    packed = keys.rdd.map(lambda r: (bytes(r[0]), None))
    ordered = packed.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(ordered.mapPartitions(lambda pairs: reduce(k for k, _ in pairs)), schema, verifySchema=False)


def first_positives(keys: Iterator[bytes]) -> Iterator[tuple]:
    """(anchor_id, score, id) of each anchor's first pairs."""
    anchor, n = None, 0
    for key in keys:
        a, score, _, i = unpack(key)
        anchor, n = a, (n + 1 if a == anchor else 1)
        if n <= POSITIVES:
            yield a, score, i


def windows_of(keys: Iterator[bytes]) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), streamed from keys in order."""
    anchor, windows = None, []  # of [positive, score, emitted]
    for key in keys:
        a, score, negative, i = unpack(key)
        if a != anchor:
            anchor, windows = a, []
        if not negative:
            windows.append([i, score, 0])
            continue
        windows = [w for w in windows if LOW * w[1] <= 100 * score and w[2] < NEGATIVES]
        for w in windows:
            if 100 * score <= HIGH * w[1]:
                w[2] += 1
                yield a, w[0], w[2], i, w[1], score


def _scored(rows: DataFrame, anchors: Block, pairs: Callable, name: str, at_once: int) -> DataFrame:
    """The keys of all pairs that ``pairs`` keeps, written."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)  # at most about ANCHOR_BYTES
    try:
        return materialise(rows.mapInArrow(lambda batches: pairs(sent.value, blocks(batches, at_once)), "key binary"), name)
    finally:
        sent.unpersist()


def mine(rows: DataFrame, anchors: DataFrame, anchor_bytes: int = ANCHOR_BYTES, at_once: int = ROWS) -> DataFrame:
    """Hard negatives of ``anchors`` among ``rows``, both of (vec_id, label, vector), one anchor an id.

    Anchors go to the tasks in parts of at most about ``anchor_bytes``, dealt by a
    hash of their ids; each part is two passes over the rows. Rows with an
    anchor's id are neither its positives nor its negatives; other rows that
    repeat count each. Scores beyond a long's range are taken as its ends.
    """
    spark = rows.sparkSession
    size = anchors.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0
    parts, out = -(-size // anchor_bytes), []
    for part in range(parts):
        own = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        block_of = block(own.toArrow())
        keys = _scored(rows, block_of, positive_pairs, "positives", at_once)
        positives = materialise(secondary_sort(keys, first_positives, "anchor_id long, score long, id long"), "first")
        discard(keys)
        found = positives.select("anchor_id", "score", "id").toArrow()  # at most POSITIVES an anchor of this part
        block_of.windows = _windows(block_of, found)
        keys = _scored(rows, block_of, negative_pairs, "negatives", at_once)
        both = keys.union(positives.mapInArrow(_packed_positives, "key binary"))
        mined = secondary_sort(both, windows_of, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        out.append(materialise(mined, "mined"))
        discard(keys, positives)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out[0] if len(out) == 1 else _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _packed_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pack(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(2)), False, b.column(2).to_numpy(zero_copy_only=False))


def _windows(anchors: Block, positives: pa.Table) -> np.ndarray:
    """(anchor, positive, 2): the least and greatest score of each window; empty ones have a least score above the greatest."""
    out = np.zeros((len(anchors.ids), POSITIVES, 2), np.int64)
    out[:, :, 0] = 1
    taken = np.zeros(len(anchors.ids), np.int64)
    at = np.searchsorted(anchors.ids, positives.column("anchor_id").to_numpy())
    for i, score in zip(at.tolist(), positives.column("score").to_pylist()):
        out[i, taken[i]] = window(score)
        taken[i] += 1
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives of each of the five positives of every fiftieth row.

    Rows without an id, which nothing can name, take no part, nor do rows
    without a label or vector, or with a null or non-finite component. Of rows
    that share an anchor's id, the one with the smallest label, then vector,
    is the anchor. A shorter vector ends in zeros. Without anchors, or rows,
    the result is empty.
    """
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return mine(rows, anchors_of(rows))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
