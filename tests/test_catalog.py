"""Every registered query against its SQL twin on the smallest data."""

import importlib.util
import os

import pytest

from stoopwise.catalog import all_queries

FOLDER = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(__file__), "..", "tools", "compare.py")
_spec = importlib.util.spec_from_file_location("compare", _path)
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def twin():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, twin, name):
    query = all_queries()[name]
    df = query.run(spark, FOLDER)
    mine = compare.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert query.sql, "every query has its SQL"
    columns, rows = compare.twin(twin, query.sql)
    assert sorted(columns) == sorted(df.columns)
    assert mine == compare.rows_of(columns, rows)
