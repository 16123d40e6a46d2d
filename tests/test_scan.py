"""Running totals over groups that fill many tasks, against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinelake.functions.scan import scan


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    def stored(df):
        path = f"{tmp_path_factory.mktemp('scan')}/rows"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return stored


def test_positions_sums_and_xors_cross_ranges(spark, write):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice("ab") if i % 9 else None, i, rng.randint(-5, 5), rng.randint(-(2**62), 2**62)) for i in range(1000)]
    df = write(spark.createDataFrame(rows, "k long, j string, i int, v long, x long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r.i: (r.pos, r.v, r.x) for r in scan(df, ["k", "j"], [F.col("i").desc()], write, "pos", ("v",), ("x",)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = defaultdict(lambda: [0, 0, 0])
    for k, j, i, v, x in sorted(rows, key=lambda r: -r[2]):
        own = state[k, j]
        own[0], own[1], own[2] = own[0] + 1, own[1] + v, own[2] ^ x
        assert got[i] == tuple(own)


def test_no_rows(spark, write):
    assert scan(write(spark.createDataFrame([], "k long, i int")), ["k"], [F.col("i")], write, "pos").count() == 0
