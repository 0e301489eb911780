"""Every registered query with an oracle agrees with DuckDB; the others run and return rows."""

import pytest
from parity import compare, duck, registry, test_dir as data_dir

SF_DIR = data_dir("0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, SF_DIR)
    assert ok, text


def test_registry_shape(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.entry(spark).limit(1).count() == 1
