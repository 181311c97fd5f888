"""Every registered query against its SQL twin on the smallest fixture tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.registry.QUERIES]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c].dtype) and not pd.api.types.is_bool_dtype(df[c].dtype):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else str(v.tolist() if isinstance(v, np.ndarray) else v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, sf, name):
    got = entry.registry.QUERIES[name](spark, sf).toPandas()
    if name not in entry.registry.ORACLES:
        assert len(got) > 0
        return
    want = db.execute(entry.registry.ORACLES[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-7, atol=1e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_python_in_plans(spark, sf):
    """The library's own queries stay in the JVM."""
    for name in ("policy_retention_cube", "context_sequences", "temporal_variation", "loss_concentration"):
        plan = entry.registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    d = entry.registry.QUERIES["visual_categories"](spark, sf)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double,l_tax:double,l_returnflag:string>" in plan
