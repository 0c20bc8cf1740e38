import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from elevspark.plans import queries as plans

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
D = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["pixel", "n", "slope", "intercept", "sigma", "slope_ci"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(plans.QUERIES) >= 70


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_columns_and_rows_match_the_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    ours, want = plans.QUERIES[name](spark, D), con.sql(plans.SQL[name])
    assert sorted(ours.columns) == sorted(want.columns)
    assert ours.count() == len(want.df())


def test_imports_without_the_training_data_folder(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); assert 'pipeline' not in e.queries(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
