"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from conftest import SF_SMALL
from stagewatch.plans.registry import QUERIES as OWN_QUERIES

QUERIES = E.queries()
ORACLE = E.oracle_sql()
OWN = sorted(OWN_QUERIES)  # the corpus operators have their own tests


def test_every_query_has_an_oracle():
    assert set(OWN) == set(ORACLE) & set(OWN)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ingestion_batch_id", "num_jobs", "successful_jobs", "errored_jobs",
                          "creation_time", "last_updation_time"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_running_queries_leaves_shared_schemas_unchanged(spark):
    from stagewatch.schema import EVENT_SCHEMA

    before = EVENT_SCHEMA.simpleString()
    QUERIES["s3_append_roundtrip"](spark, SF_SMALL).count()
    QUERIES["s2_table_roundtrip"](spark, SF_SMALL).count()
    assert EVENT_SCHEMA.simpleString() == before
