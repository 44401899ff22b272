"""Every catalog query against its SQL in a second engine, over whole tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from clickfold.plans.catalog import checked_queries  # noqa: E402
from tests.conftest import SF_DIR  # noqa: E402

TABLES = ("events", "part", "customer", "nation", "region")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_an_oracle():
    assert set(checked_queries()) <= set(queries())
    assert set(checked_queries()) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(checked_queries()))
def test_query_equals_oracle(spark, duck, name):
    result = queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    ours = [tuple(row) for row in result.select(*columns).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    cursor = duck.execute(f"SELECT * FROM ({oracle_sql()[name]})")
    assert sorted(d[0] for d in cursor.description) == columns
    theirs = duck.execute(f"SELECT {quoted} FROM ({oracle_sql()[name]})").fetchall()
    assert len(ours) == len(theirs)
    assert theirs, "an empty result compares nothing"
    assert _sorted(ours) == _sorted(theirs)
