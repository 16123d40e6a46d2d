"""The driver's contract: names, SQL, the flagship, and one query of each kind against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract
from kinelake.plans import registry

from .conftest import SF


def cells(rows):
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"model_ensemble", "study_run"}


def test_flagship_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["single_states", "single_ear", "pair_approach", "third_party_ctx", "label_paint", "greedy_nonoverlap", "frame_fbeta_lab", "sanitize", "meta_encode", "blocks_matrix", "tracks_by_section", "group_folds"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in ("events", "customer", "orders", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert cells(map(tuple, got.select(*(f"`{c}`" for c in order)).collect())) == cells(want.select(", ".join(f'"{c}"' for c in order)).fetchall())
