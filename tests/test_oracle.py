"""Every registered query against its SQL oracle (the driver's check),
at sf0.001 so the suite stays quick; sf0.01 is run by the driver."""

import pytest

from conftest import SF_SMALL
from quadflow.plans.catalog import oracle_sql, queries
from quadflow.plans.compare import compare, duckdb_connection

Q = queries()
O = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "decimal(10,2)": "DECIMAL(10,2)"}


@pytest.mark.parametrize("name", sorted(O))
def test_matches_oracle(spark, con, name):
    df = Q[name](spark, SF_SMALL)
    ok, msg = compare(df, O[name], con)
    assert ok, msg
    # the driver compares schemas too: same column types on both sides
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    rel = con.sql(O[name])
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_rows_only(spark, name):
    assert Q[name](spark, SF_SMALL).count() >= 0


def test_every_query_has_an_oracle_or_is_a_fold():
    assert set(Q) - set(O) <= {"trade_log"}
    assert len(Q) >= 70
