"""Every registered query against its SQL on the same files."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from methlake.plans import catalog
from parity import compare, connect

QUERIES, SQL = catalog.QUERIES, catalog.SQL  # the optional subpackage's queries have their own tests


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registered_queries_are_these_at_least():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_every_sql_has_its_query():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) - set(SQL) <= {"crc_fingerprint"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_checksums_equal_zlib(spark):
    import zlib

    rows = QUERIES["crc_fingerprint"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    assert rows and all(r["crc"] == zlib.crc32(r["text"].encode()) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).columns == ["sample_id", "depth", "node", "p", "tau", "met"]
