"""Benchmark decontamination with SimHash windows.

A benchmark item of n words is compared to windows of n words of documents,
and to the whole of a document that has fewer. An item of one to four words is
one shingle, found by its hash. Other windows and items have 64-bit SimHash
fingerprints of their weighted five-word shingles (a shingle weighs as many
bytes as its words have). Eight 8-bit blocks index a window's fingerprint: of
two fingerprints at most RADIUS bits apart, one block at least differs in
RADIUS // 8 bits or fewer, so the lookup loses none within the radius. The
exact weighted Jaccard similarity of the shingle multisets then decides.

Documents and items meet in joins, and neither comes to the driver. One pass
over the documents cuts out the segments in which some window has enough
weight in benchmark shingles, by a bit filter of fixed size that only errs by
keeping too much. A segment meets the items with which it shares one of the
item's rarest shingles: those without which the rest weighs too little for the
similarity. Both tests are exact bounds and lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, discard, hot_keys, materialise, table
from .text import PUNCTUATION, Words, column, token_batches

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 23, 8
#: The filter of benchmark shingles has 2**FILTER bits (8 MB), whatever the benchmark's size, and two bits a shingle.
FILTER = 26
#: Segments are cut into pieces of so many starts of windows.
SPAN = 1 << 14
RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"
ITEMS = "item_id long, k1 long, k2 long, n int, print long, total long, h array<long>, counts array<int>, weights array<int>"
SEGMENTS = "key {}, row long, piece long, at int, size int, short int, h array<long>, w array<int>"
MATCHES = "row long, k1 long, k2 long, similarity double, first int, n_words int"

_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)]) <= RADIUS // BLOCKS


def _signed_bits(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _weights(words: Words, first: np.ndarray) -> np.ndarray:
    size = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    return size[first + SHINGLE] - size[first]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """One row per item with an item_id and a word: its key (equal items have equal ones), size, fingerprint, weight and distinct shingles."""
    schema = arrow_schema(benchmark.sparkSession.createDataFrame([], ITEMS).schema)

    def item(words: Words, d: int) -> tuple:
        lo, n = int(words.bounds[d]), int(words.counts[d])
        one = slice(lo, lo + n)
        whole = Words(slice(0, 1), words.data, words.starts[one], words.ends[one], words.hashes[one], np.array([0, n]), words.total, words.offsets)
        key = [int(whole.windows(n, second)[0].view(np.int64)[0]) for second in (False, True)]
        h, _, first = whole.windows(min(n, SHINGLE))
        if n < SHINGLE:
            return *key, n, 0, 0, h.view(np.int64).tolist(), [1], [0]
        w = _weights(whole, first)
        distinct, at, counts = np.unique(h, return_index=True, return_counts=True)
        fingerprint = _pack((_signed_bits(h) * w[:, None]).sum(0)[None])
        return *key, n, int(fingerprint.view(np.int64)[0]), int(w.sum()), distinct.view(np.int64).tolist(), counts.tolist(), w[at].tolist()

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("item_id")).to_pylist()
            for words in token_batches(column(b, "text"), lower=True, space=PUNCTUATION):
                rows = [(ids[words.rows.start + d], *item(words, d)) for d in np.flatnonzero(words.counts)]
                if rows:
                    yield _table(rows, schema)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL").mapInArrow(run, ITEMS)


def _filter_bits(shingles: DataFrame) -> np.ndarray:
    """The filter's words: each shingle of the benchmark sets two bits. At most 2**FILTER / 64 rows come to the driver."""
    h, mask = F.col("h"), F.lit((1 << FILTER) - 1)
    bits = F.explode(F.array(F.shiftrightunsigned(h, 64 - FILTER), F.shiftrightunsigned(h, 12).bitwiseAND(mask))).alias("bit")
    words = shingles.select(bits).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER - 6, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    both = np.ones(len(h), bool)
    for bit in (h >> np.uint64(64 - FILTER), h >> np.uint64(12) & np.uint64((1 << FILTER) - 1)):
        both &= (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    return both


def _rare_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """(h, k1, k2): of each item the shingles rarest in the benchmark, so many that the others weigh less than ``similarity`` of it.

    A window that has none of them shares less than that with the item, and can't reach the similarity.
    """
    rows = items.select("k1", "k2", "total", F.explode(F.arrays_zip("h", "counts", "weights")).alias("s"))
    rows = rows.select("k1", "k2", "total", F.col("s.h").alias("h"), (F.col("s.counts") * F.col("s.weights")).cast("long").alias("w"))
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("k1", "k2").orderBy("n", "h")
    rest = F.col("total") - F.sum("w").over(order) + F.col("w")
    return rows.join(counted, "h").withColumn("rest", rest).filter(F.col("rest") / F.col("total") >= similarity).select("h", "k1", "k2")


def _join_dealt(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: DataFrame, by: str) -> DataFrame:
    """Inner join in which the rows of hot keys are dealt by ``by`` over all tasks, each of which has those keys' side of ``keyed``."""
    deals = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("is_hot")))  # fewer than HOT_SHARE rows
    left = rows.join(hot, keys, "left").withColumn("deal", F.when(F.col("is_hot"), F.pmod(F.xxhash64(by), F.lit(deals)).cast("int")).otherwise(0)).drop("is_hot")
    every = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(deals - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.join(hot, keys, "left").withColumn("deal", F.explode(every)).drop("is_hot")
    return left.join(right, [*keys, "deal"]).drop("deal")


def _segments(docs: DataFrame, kind: str, bits: np.ndarray, sizes: dict[int, int], similarity: float) -> DataFrame:
    """Pieces of documents (key, text) where a window may be like an item; ``row`` and ``piece`` are unique once the table is written.

    ``short`` above 0 marks benchmark shingles of so many words (under SHINGLE), with the first word of each.
    """
    spark = docs.sparkSession
    schema, filter_bits = arrow_schema(spark.createDataFrame([], SEGMENTS.format(kind)).schema), spark.sparkContext.broadcast(bits)
    short = sorted(n for n in sizes if n < SHINGLE)
    # (shingles of the item's window, the least weight that it shares with a like one)
    least = [(n - SHINGLE + 1, similarity * t) for n, t in sorted(sizes.items()) if n >= SHINGLE]
    longest = max((width for width, _ in least), default=1)

    def pieces_of(weight, hit):
        total, own = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, np.where(hit, weight, 0)))
        step = np.zeros(len(weight) + 1, np.int64)
        for width, t in least:
            width = min(width, len(weight))
            shared = own[width:] - own[:-width]
            starts = np.flatnonzero((shared >= t) & (shared >= similarity * (total[width:] - total[:-width])))
            np.add.at(step, starts, 1)
            np.add.at(step, starts + width, -1)
        inside = np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            for at in range(a, b, SPAN):
                yield at, min(b, at + SPAN + longest - 1)
                if at + SPAN + longest - 1 >= b:
                    break

    def run(batches):
        bits, row, piece = filter_bits.value, TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 40
        for b in batches:
            ids = b.column(b.schema.get_field_index("key")).to_pylist()
            for words in token_batches(column(b, "text"), lower=True, space=PUNCTUATION):
                out, base = [], row
                row += len(words.counts)
                for n in short:
                    h, doc, first = words.windows(n)
                    at = np.flatnonzero(_hits(bits, h))
                    order = at[np.lexsort((first[at], h[at], doc[at]))]
                    new = np.ones(len(order), bool)
                    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                    order = order[new]
                    for d in np.unique(doc[order]).tolist():
                        mine = order[doc[order] == d]
                        out.append((ids[words.rows.start + d], base + d, piece, 0, 0, n, h[mine].view(np.int64), first[mine] - words.bounds[d]))
                        piece += 1
                if least:
                    h, doc, first = words.windows(SHINGLE)
                    weight, hit = _weights(words, first), _hits(bits, h)
                    share = np.bincount(doc[hit], weight[hit], len(words.bounds) - 1)
                    for d in np.flatnonzero(share >= min(t for _, t in least)).tolist():
                        lo, hi = np.searchsorted(doc, [d, d + 1])
                        for a, z in pieces_of(weight[lo:hi], hit[lo:hi]):
                            out.append((ids[words.rows.start + d], base + d, piece, a, int(hi - lo), 0, h[lo + a : lo + z].view(np.int64), weight[lo + a : lo + z]))
                            piece += 1
                if out:
                    yield _table(out, schema)

    return docs.mapInArrow(run, SEGMENTS.format(kind))


def best_window(h: np.ndarray, weight: np.ndarray, size: int, item: dict, similarity: float):
    """(similarity, start, words) of the window of a segment that is most like an item, the first of equal ones; None if none is like it.

    ``size`` is how many shingles the whole document has.
    """
    width = min(item["n"] - SHINGLE + 1, size)
    if width > len(h):
        return None
    theirs = np.asarray(item["h"], np.int64).view(np.uint64)
    hit = np.isin(h, theirs)
    total, own = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, np.where(hit, weight, 0)))
    shared, whole = own[width:] - own[:-width], total[width:] - total[:-width]
    starts = np.flatnonzero((shared >= similarity * item["total"]) & (shared >= similarity * whole))
    if not len(starts):
        return None
    a, b = starts[0], starts[-1] + width
    sums = np.zeros((b - a + 1, 64), np.int64)
    np.cumsum(_signed_bits(h[a:b]) * weight[a:b, None], axis=0, out=sums[1:])
    prints, own_print = _pack(sums[starts - a + width] - sums[starts - a]), np.array([item["print"]], np.int64).view(np.uint64)
    blocks, of_item = prints.view(np.uint8).reshape(-1, BLOCKS), own_print.view(np.uint8)
    near = np.zeros(len(starts), bool)
    for k in range(BLOCKS):
        near |= _NEAR[of_item[k]][blocks[:, k]]
    apart = np.bitwise_count(prints ^ own_print)
    near = np.flatnonzero(near & (apart <= RADIUS))
    other = dict(zip(theirs.tolist(), zip(item["counts"], item["weights"])))
    best = (0.0, 0)
    for i in near[np.argsort(apart[near], kind="stable")]:
        s = int(starts[i])
        one, counts = np.unique(h[s : s + width][hit[s : s + width]], return_counts=True)
        both = sum(min(c, other[x][0]) * other[x][1] for x, c in zip(one.tolist(), counts.tolist()))
        best = max(best, (both / (int(whole[s]) + item["total"] - both), -s))
        if best[0] >= 1.0:
            break
    return (best[0], -best[1], width + SHINGLE - 1) if best[0] >= similarity else None


def _verify(pairs: DataFrame, similarity: float) -> DataFrame:
    schema = arrow_schema(pairs.sparkSession.createDataFrame([], MATCHES).schema)

    def run(batches):
        for b in batches:
            rows, columns = [], {name: b.column(i) for i, name in enumerate(b.schema.names)}
            segment, weight = columns["seg_h"], columns["seg_w"]
            plain = {c: columns[c].to_pylist() for c in ("row", "at", "size", "k1", "k2", "n", "print", "total")}
            for i in range(b.num_rows):
                item = {c: plain[c][i] for c in ("n", "print", "total")}
                item |= {c: columns[c][i].values.to_numpy().tolist() for c in ("counts", "weights")}
                item["h"] = columns["h"][i].values.to_numpy()
                h = segment[i].values.to_numpy().view(np.uint64)
                found = best_window(h, weight[i].values.to_numpy().astype(np.int64), plain["size"][i], item, similarity)
                if found:
                    rows.append((plain["row"][i], plain["k1"][i], plain["k2"][i], found[0], plain["at"][i] + found[1], found[2]))
            if rows:
                yield _table(rows, schema)

    return pairs.mapInArrow(run, MATCHES)


def _leaks(docs: DataFrame, kind: str, benchmark: DataFrame, similarity: float) -> DataFrame:
    """(key, item_id, similarity, first_word, n_words) of documents (key, text), once for each of their rows and each item's row."""
    items = materialise(benchmark_items(benchmark), "items")
    # Sizes of items: their number is at most the square root of twice the benchmark's words.
    sizes = {r.n: r.least for r in items.groupBy("n").agg(F.min("total").alias("least")).collect()}
    segments = materialise(_segments(docs, kind, _filter_bits(items.select(F.explode("h").alias("h"))), sizes, similarity), "segments")
    members = items.select("k1", "k2", "n", "item_id")
    length = F.col("n").cast("long").alias("n_words")
    out = None
    if any(n >= SHINGLE for n in sizes):
        pieces = segments.filter("short = 0")
        one = [F.first(c).alias(c) for c in ("n", "print", "total", "h", "counts", "weights")]
        distinct = materialise(items.filter(F.col("n") >= SHINGLE).groupBy("k1", "k2").agg(*one), "distinct-items")
        rare = materialise(_rare_shingles(distinct, similarity), "rare-shingles")
        rows = pieces.select("piece", F.explode(F.array_distinct("h")).alias("h"))
        rows = materialise(rows, "shingles")
        pairs = materialise(_join_dealt(rows, rare, ["h"], hot_keys(rows, ["h"]), "piece").select("piece", "k1", "k2").distinct(), "pairs")
        discard(rows, rare)
        hot = hot_keys(pairs, ["k1", "k2"])
        met = _join_dealt(pairs, distinct, ["k1", "k2"], hot, "piece")
        texts = pieces.select("piece", "row", "at", "size", F.col("h").alias("seg_h"), F.col("w").alias("seg_w"))
        found = _verify(_join_dealt(met, texts, ["piece"], hot_keys(pairs, ["piece"]), "k1"), similarity)
        best = F.max_by(F.struct("similarity", "first", "n_words"), F.struct("similarity", -F.col("first"))).alias("best")
        found = materialise(found.groupBy("row", "k1", "k2").agg(best), "found")
        discard(pairs, distinct)
        keys = pieces.select("row", "key").distinct()
        found = _join_dealt(found, members.drop("n"), ["k1", "k2"], hot, "row").join(keys, "row")
        out = found.select("key", "item_id", "best.similarity", F.col("best.first").cast("long").alias("first_word"), F.col("best.n_words").cast("long").alias("n_words"))
    if any(n < SHINGLE for n in sizes):
        rows = segments.filter("short > 0").select("key", "row", F.col("short").alias("n"), F.explode(F.arrays_zip("h", "w")).alias("s"))
        rows = materialise(rows.select("key", "row", "n", F.col("s.h").alias("k1"), F.col("s.w").cast("long").alias("first_word")), "short")
        found = _join_dealt(rows, members.filter(F.col("n") < SHINGLE).drop("k2"), ["k1", "n"], hot_keys(rows, ["k1", "n"]), "row")
        found = found.select("key", "item_id", F.lit(1.0).alias("similarity"), "first_word", length)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], RESULT.replace("doc_id long", f"key {kind}")) if out is None else out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for each document that has a window like an item.

    One row per document row and item, at the most similar window (the first
    of equal ones). Words are runs of letters and digits, ASCII letters in
    lower case. A document with fewer words than the item is its own window;
    an item of one to four words is found wherever its words follow each
    other. Texts without words match nothing; neither do items without an
    item_id. Documents are read once, whatever the benchmark's size, and only
    segments of benchmark shingles are shuffled.
    """
    return _leaks(docs.select(F.col("doc_id").cast("long").alias("key"), "text"), "long", benchmark, similarity).withColumnRenamed("key", "doc_id")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without a window like an item, with all their columns; rows, not ids, are judged, by a digest of their text."""
    digest = F.md5(F.col("text").cast("string"))
    name = "key"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    leaks = _leaks(docs.select(digest.alias("key"), "text"), "string", benchmark, similarity)
    leaks = materialise(leaks.select(F.col("key").alias(name)).distinct(), "leaks")
    return docs.withColumn(name, digest).join(leaks, name, "left_anti").select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
