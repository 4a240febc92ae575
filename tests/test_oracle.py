"""Every registered query against its DuckDB oracle (sf0.001), and the
rows-only queries for a stable, non-empty schema."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.oracle_check import compare, duck

from freshstream.plans import load_all

QUERIES, ORACLES = load_all()       # the corpus queries have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def duck_type(t):
    from pyspark.sql import types as T
    simple = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
              T.StringType: "VARCHAR", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
              T.BooleanType: "BOOLEAN"}
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return simple.get(type(t), str(t))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    msg = compare(df, con, ORACLES[name])
    assert msg is None, msg
    spark_types = {f.name: duck_type(f.dataType) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert spark_types == duck_types


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() > 0


def test_every_query_has_oracle_or_is_listed():
    assert set(ORACLES) <= set(QUERIES) <= set(E.queries())
    assert set(QUERIES) - set(ORACLES) == {"table_sizes", "probe_histogram"}


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert set(df.columns) == {"region", "cnt", "total", "avg_amount"}
