"""Every registered query against its SQL in DuckDB."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from notewright.plans.registry import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, wrong = differences(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert not wrong, "\n".join(wrong)
    if name != "c09_best_pdf":
        assert rows > 0


@pytest.mark.parametrize("name, folder", [("k06_error_rows", "errors_csv"), ("k07_article_files", "articles"), ("k07_basic_files", "articles-basic")])
def test_rows_come_from_written_files(spark, name, folder):
    files = QUERIES[name](spark, FOLDER).inputFiles()
    assert files and all(f"/{folder}" in f for f in files)
