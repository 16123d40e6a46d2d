"""Substring dedup by level-wise doubling.

A run of words can only repeat if its parts do. Level one hashes anchors of
half the window's length and finds those that two documents share. Only
windows that contain a shared anchor are hashed at the full length, and only
windows shared at one length are extended to twice that length, until no
candidates survive or the wanted length is reached.

Anchors are sampled without loss: of each window, the part with the smallest
hash. Equal windows have equal smallest parts, so a repeated window has a
repeated anchor, while about one word in four starts one.

Anchors only filter, by 64-bit hashes. Windows are equal if 96 bits of two
hashes are: among 10^13 windows one in a thousand corpora would have two
different ones that agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, bucketed, discard, hot_keys, materialise, table
from .text import Words, column, token_batches

WINDOW = 13
WINDOWS = "h long, g int, doc_id long, at int"
ANCHORS = "doc_id long, anchors array<long>"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a batch: the word its anchor starts at, and at each word the hash of its part (0 where none fits)."""
    half = (window + 1) // 2
    h, _, first = words.windows(half)
    part = np.full(len(words.hashes) + window, np.iinfo(np.uint64).max, np.uint64)
    part[first] = h
    counts = np.maximum(words.counts - window + 1, 0)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - words.bounds[:-1], counts)
    best, at = part[starts], starts.copy()
    for k in range(1, window - half + 1):
        other = part[starts + k]
        less = other < best
        best[less], at[less] = other[less], starts[less] + k
    return starts, at, part


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, anchors): each document's anchors, once."""
    schema = arrow_schema(docs.sparkSession.createDataFrame([], ANCHORS).schema)

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            for words in token_batches(column(b, "text")):
                _, at, part = anchors(words, window)
                at = np.unique(at)
                ends = np.searchsorted(at, words.bounds).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(part[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(words.rows.start, len(lists)), lists.cast(schema.field(1).type)], schema=schema)

    return docs.mapInArrow(run, ANCHORS)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a written table whose key two documents or more have, with ``lo``, the smallest of these.

    One scan and one exchange, in which each row meets all that have its key.
    What hot keys come to is known beforehand, so their rows are dealt by
    document as well.
    """
    lo, hi = F.min("doc_id"), F.max("doc_id")
    hot = hot_keys(rows, keys, lo.alias("hot_lo"), hi.alias("hot_hi"))
    met = rows.join(F.broadcast(hot), keys, "left").withColumn("deal", F.when(F.col("hot_lo").isNotNull(), F.col("doc_id")))
    group = Window.partitionBy(*keys, "deal")
    met = met.select(*rows.columns, F.coalesce("hot_lo", lo.over(group)).alias("lo"), F.coalesce("hot_hi", hi.over(group)).alias("hi"))
    return met.filter("lo < hi").drop("hi")


def _level(docs: DataFrame, known: DataFrame, window: int, before: int | None) -> DataFrame:
    """(h, doc_id, at) of the windows that may repeat.

    ``known`` has for each document the hashes of its shared anchors (before
    is None), or the starts of its repeated windows of ``before`` words: a
    longer window is a candidate if both its ends are among them.
    """
    schema = arrow_schema(docs.sparkSession.createDataFrame([], WINDOWS).schema)

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id")).to_numpy()
            found = b.column(b.schema.get_field_index("known"))
            values, offsets = found.values.to_numpy(), found.offsets.to_numpy()
            for words in token_batches(column(b, "text")):
                rows = words.rows
                own, to = values[offsets[rows.start] : offsets[rows.stop]], offsets[rows.start : rows.stop + 1] - offsets[rows.start]
                doc_of = np.repeat(np.arange(len(to) - 1), np.diff(to))
                if before is None:
                    starts, at, part = anchors(words, window)
                    doc = np.searchsorted(words.bounds, starts, "right") - 1
                    keys = part[at].view(np.int64)
                    listed = np.unique(np.stack([doc_of, own], 1), axis=0)
                    pair = np.dtype([("d", np.int64), ("h", np.int64)])
                    mine = np.ascontiguousarray(np.stack([doc, keys], 1)).view(pair).ravel()
                    ok = np.isin(mine, np.ascontiguousarray(listed).view(pair).ravel())
                    starts = starts[ok]
                else:
                    member = np.zeros(len(words.hashes) + window + 1, bool)
                    member[words.bounds[:-1][doc_of] + own] = True
                    starts = np.flatnonzero(member)
                    doc = np.searchsorted(words.bounds, starts, "right") - 1
                    starts = starts[member[starts + window - before] & (starts + window <= words.bounds[doc + 1])]
                if len(starts):
                    h, _, first = words.windows(window)
                    g, at = words.windows(window, True)[0], np.searchsorted(first, starts)
                    h, g = h[at], (g[at] >> np.uint64(32)).astype(np.uint32)
                    doc = np.searchsorted(words.bounds, starts, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(g.view(np.int32)), pa.array(ids[rows.start + doc].astype(np.int64)), pa.array((starts - words.bounds[doc]).astype(np.int32))], schema=schema
                    )

    joined = docs.join(known.select("doc_id", "known"), "doc_id").select("doc_id", "text", "known")
    return joined.mapInArrow(run, WINDOWS)


def by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with a doc_id, written once in buckets of it: the one time that texts are shuffled."""
    return bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL"), "doc_id", "texts")


def repeated_windows(docs: DataFrame, window: int = WINDOW, upto: int | None = WINDOW, first: bool = True) -> list[tuple[int, DataFrame]]:
    """Repeated windows by length: (length, (doc_id, at, lo)), lo being the smallest document that has the window.

    ``window`` is the shortest length of interest. Lengths double from it
    until no candidates survive, or to ``upto``. All rows of a document with a
    window are listed; the first document's as well, but for ``first`` False,
    which ends at ``window``. A window or anchor that a large share of all
    rows has is no task of its own. Each level joins on doc_id: ``docs`` in
    buckets of it, as ``by_document`` writes them, stay where they are.
    """
    listed = materialise(_anchors(docs, window), "anchors")
    rows = listed.select("doc_id", F.explode("anchors").alias("h"))
    known = _repeated(rows, ["h"]).groupBy("doc_id").agg(F.collect_list("h").alias("known"))
    known, before, out = materialise(known, "known"), None, []
    discard(listed)
    while True:
        found = materialise(_level(docs, known, window, before), f"windows-{window}")
        discard(known)
        repeated = _repeated(found, ["h", "g"]).select("doc_id", "at", "lo")
        if not first:
            repeated = repeated.filter("lo < doc_id")
        repeated = materialise(repeated, f"repeats-{window}")
        discard(found)
        if before is not None and repeated.isEmpty():
            return out
        out.append((window, repeated))
        if upto is not None and window >= upto:
            return out
        known = materialise(repeated.groupBy("doc_id").agg(F.collect_list("at").alias("known")), "known")
        before, window = window, min(2 * window, upto or 2 * window)


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, at, n_words, lo): repeated windows of each doubled length that lie in no repeated window of the next one."""
    docs = by_document(docs)
    levels, out = repeated_windows(docs, window, None), None
    discard(docs)
    for i, (n, rows) in enumerate(levels):
        if i + 1 < len(levels):
            m, longer = levels[i + 1]
            inner = longer.select("doc_id", F.explode(F.sequence("at", F.col("at") + m - n)).alias("at")).distinct()
            rows = rows.join(inner, ["doc_id", "at"], "left_anti")
        rows = rows.select("doc_id", "at", F.lit(n).alias("n_words"), "lo").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def kept_text(words: Words, removed: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each document joined by one space, in one buffer, and the documents' offsets in it."""
    kept = np.flatnonzero(~removed)
    doc = words.doc_of_word()[kept]
    step = np.zeros(len(words.data) + 1, np.int64)
    step[words.starts[kept]] += 1
    np.add.at(step, words.ends[kept], -1)
    inside = np.cumsum(step)[:-1] > 0
    follows = np.zeros(len(kept), bool)
    follows[:-1] = doc[1:] == doc[:-1]
    out, spaces = words.data.copy(), words.ends[kept[follows]]
    out[spaces] = 32
    inside[spaces] = True
    total = np.concatenate([[0], np.cumsum(inside)])
    return out[inside].tobytes(), total[words.offsets]


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, with ``text`` also the kept text.

    A word goes if a window of ``window`` words that covers it also starts in
    a document with a smaller doc_id; windows are judged on the input. Null
    and empty texts have no words; a document shorter than the window, or
    without a doc_id, stays whole; rows that repeat a doc_id are not smaller
    than each other, and each loses the words that any of them would.
    """
    schema_of = RESULT + (", kept_text string" if text else "")
    schema = arrow_schema(docs.sparkSession.createDataFrame([], schema_of).schema)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = by_document(own)
    (_, repeated), = repeated_windows(texts, window, window, False)
    covered = materialise(repeated.groupBy("doc_id").agg(F.collect_list("at").alias("known")), "covered")
    discard(repeated)

    def run(batches):
        for b in batches:
            ids, found, rows = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("known")), []
            for words in token_batches(column(b, "text")):
                step = np.zeros(len(words.hashes) + window + 1, np.int64)
                for d in range(words.rows.start, words.rows.stop):
                    if found[d].is_valid:
                        i = d - words.rows.start
                        at = found[d].values.to_numpy() + words.bounds[i]
                        at = at[at + window <= words.bounds[i + 1]]
                        np.add.at(step, at, 1)
                        np.add.at(step, at + window, -1)
                removed = np.cumsum(step)[: len(words.hashes)] > 0
                data, offsets = kept_text(words, removed)
                n = np.bincount(words.doc_of_word(), removed, len(words.bounds) - 1).astype(int)
                for d, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
                    own = data[lo:hi]
                    row = (int(words.counts[d]), int(n[d]), hashlib.sha256(own).hexdigest())
                    rows.append((*row, own.decode()) if text else row)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:]))], schema=schema)

    # Rows without a doc_id would all be one key.
    whole = own.filter("doc_id IS NULL").withColumn("known", F.lit(None).cast("array<int>"))
    joined = texts.join(covered, "doc_id", "left").select("doc_id", "text", "known").unionByName(whole)
    return joined.mapInArrow(lambda it: run(b for b in it if b.num_rows), schema_of)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
