"""Every registered query against its SQL, on the smallest test data: same columns, types of values, and rows."""

import duckdb
import pytest

import __spark_entry__ as contract

# One workspace has too few rows in the smallest data.
SF_DIR, TUNED_SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connected(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def views():
    found = {sf_dir: connected(sf_dir) for sf_dir in (SF_DIR, TUNED_SF_DIR)}
    yield found
    for connection in found.values():
        connection.close()


def normal(columns, rows):
    """Rows as typed values, with columns by name and rows in a fixed order."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    typed = [tuple((type(row[i]).__name__, str(row[i])) for i in order) for row in rows]
    return sorted(columns), sorted(typed)


@pytest.mark.parametrize("name", sorted(contract._own_queries()))
def test_query(spark, views, name):
    sf_dir = TUNED_SF_DIR if name.endswith("_tuned") else SF_DIR
    df = contract.queries()[name](spark, sf_dir)
    expected = views[sf_dir].execute(contract.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    rows = expected.fetchall()
    assert rows
    assert normal(df.columns, df.collect()) == normal(columns, rows)


def test_every_query_has_sql():
    assert contract._own_queries().keys() <= contract.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).count() == 9
