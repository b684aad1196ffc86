"""Every registered query against its SQL at the smallest scale; model queries run in test_models."""

import duckdb
import pytest

import __spark_entry__ as entry
from ticketloom.plans import all_oracles
from tools.check import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), all_oracles()
# Fitting a model takes longer than the rest together; tools/check.py runs these.
FITTED = {"pseudo_label_counts", "save_model", "hybrid_features"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - FITTED))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.execute(ORACLES[name])
    assert got == rows_of([d[0] for d in relation.description], relation.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
