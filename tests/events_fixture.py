"""Hand-made stage events (FIXTURES.md, last table)."""

from __future__ import annotations

import datetime as dt

from stagewatch.schema import EVENT_COLUMNS, EVENT_SCHEMA, STAGE_NAMES

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def event(batch, job, sp, *, user="1110", t=None, created=T0, errored=False, repo="16554252419", version="1661749456"):
    return {
        "ingestion_batch_id": batch, "org_id": "1", "user_id": user, "repo_id": repo, "repo_version": version,
        "priority": "HIGH", "job_id": job, "job_type": "ADD", "created_at": created, "dataset_id": "ABCDEF_GHIJ",
        "num_stages": 6, "time": t if t is not None else created + dt.timedelta(seconds=10 * sp),
        "stage": STAGE_NAMES[sp], "stage_progress": sp, "errored": errored, "finished": sp == 6,
    }


def job(batch, job_id, last=6, fails=False, **kw):
    return [event(batch, job_id, s, errored=fails and s == last, **kw) for s in range(last + 1)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in EVENT_COLUMNS) for r in rows], EVENT_SCHEMA)


B1 = "16554252419__1661749456__1110"
B2 = "16554252419__1661749456__0011"


def standard_rows():
    """good job, failed at 1, failed at 5 in B1; two good jobs in B2."""
    rows = job(B1, "good") + job(B1, "fail1", 1, True) + job(B1, "fail5", 5, True)
    rows += job(B2, "b2-a", user="0011") + job(B2, "b2-b", user="0011", created=T0 + dt.timedelta(minutes=1))
    return rows
