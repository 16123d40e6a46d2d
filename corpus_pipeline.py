"""A training corpus from ``documents``: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet and read again before the next. Stages judge
rows, not ids: a row without a doc_id, or with one that other rows have too,
is judged by its own text. Null and empty texts are clean, near copies of
nothing, free of benchmark items, and have no words to mix. Other columns, of
any name, go along. Empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from kinelake.llm.shared import discard, materialise, table

ROW = "__corpus_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, written, so that every later read finds the same numbers."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold of their language; those without a text have the score of no words.

    The labels of ``labels`` are learned from by doc_id; without any, or of
    one kind only, every row gets the same score and is kept unless all are toxic.
    """
    return toxicity.keep_clean(docs, toxicity.train_scorer(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies, linked at op4's similarity of 0.85.

    Of rows that repeat, with the same doc_id or none, one stays as well. Every row without words stays.
    """
    rows = _numbered(docs)
    keyed = rows.select(F.col(ROW).alias("doc_id"), "text")
    kept = near_dedup.near_duplicates(keyed).filter("kept").select(F.col("doc_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item. An empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each. Rows without words take part in no mix.

    A null source is a source. Rows that repeat are mixed one by one.
    """
    rows = _numbered(docs)
    keyed = rows.select(F.col(ROW).alias("doc_id"), "source", "text")
    mixed = mixing.mix(keyed, mixing.cycled_weights(keyed)).filter("taken > 0")
    times = mixed.select(F.col("doc_id").alias(ROW), F.floor(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    repeated = rows.join(times.withColumnRenamed("__times", "__corpus_times"), ROW)
    return repeated.withColumn("__corpus_times", F.explode(F.sequence(F.lit(1), "__corpus_times"))).select(*(f"`{c}`" for c in docs.columns))


def store_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in size-tiered shards; a row for each says where it lies. An empty table makes an empty store."""
    return sharding.placement(sharding.shard(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", store_shards),
]

#: The classifier and the MinHash groups have no SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one keeps is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
