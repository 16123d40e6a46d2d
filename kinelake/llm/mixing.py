"""Mixing sources to target weights by capped water-filling.

Targets are solved on the small table of sources: each round shares what is
left by weight among the sources below their cap, and clamps those that the
share would lift above it, until none is. Documents are then repeated whole:
every document of a source ``floor(target / size)`` times, and once more from
the start of a seeded order up to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): the key orders documents; without an id it is that of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to (source, weight, source_size).

    ``share`` times all sizes is given out by weight; no source gets more than
    ``max_epochs`` times its size, and the excess goes to the others by weight.
    Each round moves one row of three sums to the driver, never the sources.
    ``share`` above ``max_epochs`` fills every source to its cap.
    """
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("source_size") * max_epochs <= F.col("weight") * F.lit(level)
        total, used, weight, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("source_size") * max_epochs)),
            F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1)),
        ).first()
        if n == capped or not weight:
            break
        level, capped = (share * (total or 0) - (used or 0)) / weight, n
    cap = (F.col("source_size") * max_epochs).cast("double")
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level is not None else cap)


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each document.

    ``weights`` has (source, weight), a null source included. The last
    repetition takes documents in the order of md5(seed, doc_id) while half of
    the next one still fits. The running sum over a source is made of sums
    over up to 4,096 ranges of that order, so a source with a third of all
    rows is no task of its own. A document without words, or of an empty
    source, is taken zero words. A document without an id is ordered by its
    text; rows that repeat an id are taken one by one, smaller ones first.
    """
    docs = materialise(sized(docs), "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.join(weights.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    sources = materialise(sources.select("source", "weight", "source_size"), "sources")
    sources = materialise(water_fill(sources, share, max_epochs), "targets")
    epochs = F.try_divide(F.col("target"), F.col("source_size"))
    whole = F.coalesce(F.floor(epochs), F.lit(0))
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - whole * F.col("source_size"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary"))
    docs = docs.withColumn("at", order).withColumn("range", (F.conv(F.substring("at", 1, 3), 16, 10)).cast("int"))
    # Pre-aggregated per range; a running sum over at most 4,096 rows a source.
    ranges = docs.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = ranges.withColumn("before", F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranges = ranges.join(sources, same(ranges, sources)).select(
        ranges["source"], "range", "before", "source_size", "target", "whole", "rest"
    )
    within = Window.partitionBy("source", "range").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("run", F.sum("size").over(within))
    joined = docs.join(ranges, same(docs, ranges) & (docs["range"] == ranges["range"]))
    reached = F.col("before") + F.col("run") - F.col("size") / 2
    return joined.select(
        docs["doc_id"], docs["source"], docs["size"], "source_size", "target",
        ((F.col("whole") + (reached < F.col("rest")).cast("long")) * F.col("size")).cast("long").alias("taken"),
    )


def cycled_weights(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights repeating over the sources by code point, null last. One row per source.

    Sources are ranked within ranges of their order, each after the counts of
    the ranges before it, so any number of them is ranked without one task for all.
    """
    key = F.col("source").asc_nulls_last()
    distinct = materialise(docs.select("source").distinct(), "named")
    ranged = materialise(distinct.repartitionByRange(key).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    ranked = ranged.withColumn("rank", rank).join(F.broadcast(before), "part")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in cycle]), ((F.col("before") + F.col("rank")) % len(cycle) + 1).cast("int"))
    return ranked.select("source", weight.alias("weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, cycled_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")


# Water-filling in closed form: with the sources by cap / weight, the level is
# that of the first prefix whose next source stays under it.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) AS weight FROM s0),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS i FROM s),
l AS (SELECT i, 2 * source_size AS cap, weight,
 (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(2 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
 / (sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
v AS (SELECT (SELECT level FROM l WHERE cap > weight * level ORDER BY i LIMIT 1) AS level),
t AS (SELECT source, source_size, coalesce(least((2 * source_size)::DOUBLE, weight * level), (2 * source_size)::DOUBLE) AS target FROM s, v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole,
 sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('7:', CAST(d.doc_id AS VARCHAR))), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS reached
 FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
 CAST((whole + CASE WHEN reached < target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
