"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import block_queries, flow_queries, pair_queries, single_queries

QUERIES = {**single_queries.QUERIES, **pair_queries.QUERIES, **flow_queries.QUERIES, **block_queries.QUERIES}
ORACLES = {**single_queries.ORACLES, **pair_queries.ORACLES, **flow_queries.ORACLES, **block_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["runs_to_intervals"](spark, sf_dir)
