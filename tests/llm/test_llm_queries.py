"""The registered queries against their SQL twins, and clean separation of the subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import TABLES, plain

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_url_reputation", "op5_jaccard_join", "op10_license_scan", "op11_prefix_trie", "op12_secret_scan", "op13_filter_audit"])
def test_sql_twins(spark, db, sf, name):
    import pandas as pd

    got, want = entry.queries()[name](spark, sf).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_library_does_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op1_') for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)})
