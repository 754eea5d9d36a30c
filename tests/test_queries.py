"""Every registered query against DuckDB where it has SQL, else for rows and a stable schema."""

import oracle
import pytest

from pricetide.plans import catalog

MAY_BE_EMPTY = {"E5_F32_listings"}  # invented prose holds no listings


@pytest.mark.skipif(not oracle.there(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries))
def test_query(spark, name):
    if name in catalog.oracle:
        oracle.compare(spark, catalog.queries[name], catalog.oracle[name])
    else:
        df = catalog.queries[name](spark, oracle.FOLDER)
        assert name in MAY_BE_EMPTY or df.count() > 0


@pytest.mark.skipif(not oracle.there(), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
