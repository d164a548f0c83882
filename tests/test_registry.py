"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"
QUICK = (
    "merge_roi_wide", "roi_moments", "outline_status", "cell_metrics", "neighbor_count_density",
    "dose_response", "split_within_folder", "group_kfold", "agg_cell_to_image_hot", "clean_cells",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert compare(rows, df.columns, result.fetchall(), cols) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


def test_registry_needs_no_session():
    """The driver may ask for queries and SQL before it starts Spark."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
