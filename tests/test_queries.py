"""Every registered query against its SQL at the smallest scale."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver
from verification.compare import compare, connect
from verification.spark_queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns[0] == "folder"


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) & set(QUERIES)))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(driver.oracle_sql())))
def test_query_runs(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_entry_without_tokenizers():
    hidden = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as d; print(len(d.queries()))"
    out = subprocess.run([sys.executable, "-c", hidden], capture_output=True, text=True, check=True,
                         cwd=Path(__file__).parents[1])
    assert int(out.stdout) == len(QUERIES)
