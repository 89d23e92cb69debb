"""Job lifecycle operators.

L1 ``expand_jobs``: one job row -> its stage events 0..last_stage (narrow explode).
L2 ``split_batch_pairs`` / ``jobs_per_batch``: a batch pair is split between two users
    by a fraction, expanded into jobs, and rolled back up per batch id.
L3 ``lifecycle_checks``: per-job invariants (gap-free stages, one terminal event,
    terminal event last), pure aggregates so Spark combines them map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timefns as TF
from ..functions.strings import fraction_count, stage_name
from ..schema import EVENT_COLUMNS, LAST_STAGE, NUM_STAGES
from .monitoring import order_key_stage

# Batch-pair generation is split into chunks of this many jobs, so that one huge
# batch is spread over many tasks instead of being generated by a single row.
JOB_CHUNK = 4096


def expand_jobs(jobs: DataFrame, step_seconds: int = 20) -> DataFrame:
    """Stage events of each job, cut off at its last stage (L1).

    ``jobs`` carries the event columns that are constant per job plus ``last_stage``
    (int), ``fails`` (bool: the job errors at ``last_stage``), ``start_time``
    (timestamp) and ``start_offset_s`` (int seconds). Stage ``s`` happens at
    ``start_time + start_offset_s + s * step_seconds`` seconds.
    """
    sp = F.col("stage_progress")
    exploded = jobs.select("*", F.explode(F.sequence(F.lit(0), F.col("last_stage"))).alias("stage_progress"))
    return exploded.select(
        *[F.col(c) for c in EVENT_COLUMNS[:10]],
        F.lit(NUM_STAGES).cast("int").alias("num_stages"),
        (F.col("start_time") + F.make_dt_interval(secs=(F.col("start_offset_s") + sp * step_seconds))).alias("time"),
        stage_name(sp).alias("stage"),
        sp.cast("int").alias("stage_progress"),
        (F.col("fails") & (sp == F.col("last_stage"))).alias("errored"),
        (sp == LAST_STAGE).alias("finished"),
    )


def split_batch_pairs(pairs: DataFrame, chunk: int = JOB_CHUNK) -> DataFrame:
    """Expand batch pairs into job rows (L2).

    ``pairs``: repo_id, repo_version, first_user_id, second_user_id, num_jobs,
    split_pct (int percent). Jobs 1..floor(num_jobs*split_pct/100) belong to the first
    user, the rest to the second. The expansion runs in two steps, chunks then jobs,
    with a round-robin repartition between them so one big pair does not land in
    one task.
    """
    n = F.col("num_jobs")
    chunks = pairs.select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("chunk_no")
    ).where(n > 0)
    # Round robin: the chunks of one hot pair are spread over as many tasks as the session shuffles to
    # (a fixed number: chunks are tiny before the second explode, so AQE must not merge them).
    spread = chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lo = F.col("chunk_no") * chunk + 1
    hi = F.least(n, (F.col("chunk_no") + 1) * chunk)
    jobs = spread.select("*", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("job_no"))
    first_n = fraction_count(n, F.col("split_pct"))
    user = F.when(F.col("job_no") <= first_n, F.col("first_user_id")).otherwise(F.col("second_user_id"))
    return jobs.select(
        F.concat_ws("__", "repo_id", "repo_version", user).alias("ingestion_batch_id"),
        user.alias("user_id"),
        "repo_id",
        "repo_version",
        F.col("job_no").cast("long").alias("job_no"),
    )


def jobs_per_batch(jobs: DataFrame) -> DataFrame:
    """Roll job rows back up to one row per batch id (the inverse of L2)."""
    return jobs.groupBy("ingestion_batch_id", "user_id").agg(
        F.count(F.lit(1)).alias("num_jobs"),
        F.min("job_no").alias("first_job_no"),
        F.max("job_no").alias("last_job_no"),
    )


def lifecycle_checks(events: DataFrame) -> DataFrame:
    """Per job: the invariants of a well-formed stage history (L3).

    gap_free: stages are exactly 0..max once each; one_terminal: exactly one event
    is finished or errored; terminal_last: that event has the highest stage and the
    latest time; ok: all three.
    """
    sp, t = F.col("stage_progress"), F.col("time")
    terminal = F.col("finished") | F.col("errored")
    agg = events.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        # distinct stages as a bit set: one shuffle; shifts beyond 62 are no stages (see gap_free)
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, stage_progress)"))).alias("n_stages"),
        F.min(sp).alias("min_stage"),
        F.max(sp).alias("max_stage"),
        F.count_if(terminal).alias("n_terminal"),
        F.max(F.when(terminal, sp)).alias("terminal_stage"),
        F.max(F.when(terminal, t)).alias("terminal_time"),
        F.max(t).alias("last_time"),
        # stage of the latest event: the low bits of the largest (time, stage) key
        # (stages beyond the key's three bits are cut to them; such jobs are not ok anyway)
        order_key_stage(F.max(TF.to_epoch_us(t) * 8 + F.least(F.greatest(sp.cast("long"), F.lit(0)), F.lit(7)))).alias("stage_at_last_time"),
    )
    gap_free = (F.col("min_stage") == 0) & (F.col("max_stage") < 63) & (F.col("n_stages") == F.col("max_stage") + 1) & (
        F.col("n_events") == F.col("n_stages")
    )
    one_terminal = F.col("n_terminal") == 1
    terminal_last = (
        (F.col("terminal_stage") == F.col("max_stage"))
        & (F.col("terminal_time") == F.col("last_time"))
        & (F.col("stage_at_last_time") == F.col("max_stage"))
    )
    return agg.select(
        "job_id",
        "n_events",
        F.coalesce(gap_free, F.lit(False)).alias("gap_free"),
        one_terminal.alias("one_terminal"),
        F.coalesce(terminal_last, F.lit(False)).alias("terminal_last"),
        F.coalesce(gap_free & one_terminal & terminal_last, F.lit(False)).alias("ok"),
    )


def lifecycle_violations(events: DataFrame) -> DataFrame:
    return lifecycle_checks(events).where(~F.col("ok"))
