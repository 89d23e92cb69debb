"""DuckDB-side definitions of the derived tables, for the SQL oracle.

These mirror ``sources.derive`` expression by expression (FIXTURES.md) so that every
registered query can be checked against an independent engine on the same parquet.
"""

from __future__ import annotations

from ..schema import JOB_TYPES, REPO_IDS, STAGE_NAMES
from ..sources.derive import FIXTURE_STORES, FIXTURE_USERS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MONITORING_EVENTS_CTE = f"""
me_jobs AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS d,
           {_list(FIXTURE_USERS)}[(o_custkey % 7) + 1] AS user_id,
           {_list(REPO_IDS)}[(o_orderkey % 3) + 1] AS repo_id,
           CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) AS repo_version,
           CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'HIGH'
                WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
           CASE WHEN o_orderkey % 10 = 0 THEN 1 + o_orderkey % 7 % 5 ELSE 6 END AS last_stage
    FROM orders
),
monitoring_events AS (
    SELECT repo_id || '__' || repo_version || '__' || user_id AS ingestion_batch_id,
           CASE WHEN c % 7 < 5 THEN '1' ELSE '2' END AS org_id,
           user_id, repo_id, repo_version, priority,
           'job-' || CAST(k AS VARCHAR) AS job_id,
           {_list(JOB_TYPES)}[(k % 3) + 1] AS job_type,
           d AS created_at,
           'DS' || CAST(c AS VARCHAR) AS dataset_id,
           CAST(6 AS INTEGER) AS num_stages,
           d + to_seconds(k % 3600 + sp * 20) AS time,
           {_list(STAGE_NAMES)}[sp + 1] AS stage,
           CAST(sp AS INTEGER) AS stage_progress,
           (k % 10 = 0 AND sp = last_stage) AS errored,
           (sp = 6) AS finished
    FROM me_jobs CROSS JOIN LATERAL (SELECT unnest(range(0, last_stage + 1)) AS sp) AS s
)"""

BENCHMARK_RUNS_CTE = f"""
benchmark_runs AS (
    SELECT CAST(event_id AS VARCHAR) AS record_id,
           {_list(FIXTURE_STORES)}[(event_id % 4) + 1] AS data_store,
           CASE WHEN event_id % 11 = 0 THEN 'basic_write'
                ELSE 'query_type_' || CAST(1 + user_id % 5 AS VARCHAR) || '__'
                     || CAST(CAST(1 + floor(value) % 8 AS BIGINT) AS VARCHAR) || 'x' END AS operation,
           CAST(floor(value * 100) AS BIGINT) AS exec_time,
           CASE WHEN event_id % 11 = 0 THEN CAST(1 + event_id % 500 AS INTEGER) END AS num_records,
           CASE WHEN event_id % 11 <> 0 THEN event_id % 10 = 1 END AS is_first_query
    FROM events
)"""


def with_me(select_sql: str, *extra_ctes: str) -> str:
    """``WITH monitoring_events AS (...) [, extra] select_sql``."""
    ctes = [MONITORING_EVENTS_CTE] + [c for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + select_sql


def with_runs(select_sql: str, *extra_ctes: str) -> str:
    ctes = [BENCHMARK_RUNS_CTE] + [c for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + select_sql
