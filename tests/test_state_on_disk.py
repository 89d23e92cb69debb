"""Where the T2 and T4 streams keep their state: on disk, not on the executors' heap."""

import json

import pytest

from events_fixture import frame, standard_rows
from stagewatch.operators import monitoring as M
from stagewatch.streaming import monitor as T

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STREAMS = {
    "t2": (T.batch_rollup_stream, T.batch_rollup_result, M.batch_rollup),
    "t4": (T.latest_status_stream, T.latest_status_result, M.latest_job_status),
}


def _run(spark, kind, rows, src, sink, ckpt):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(src)
    with T.state_partitions(spark, 2):
        STREAMS[kind][0](T.event_stream(spark, src, 1), sink, ckpt)


def _provider(spark, ckpt):
    """The store that the checkpoint's offset log names."""
    line = spark.read.text(f"{ckpt}/offsets/0").where("value like '{%conf%'").first()[0]
    return json.loads(line)["conf"][PROVIDER].rsplit(".", 1)[-1]


def _same(spark, kind, rows, sink):
    _, result, batch = STREAMS[kind]
    want = batch(frame(spark, rows))
    return sorted(map(tuple, result(spark, sink).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_state_is_kept_on_disk_and_the_session_is_as_before(spark, kind):
    src, sink, ckpt = T.scratch_stream_paths(spark, f"disk-{kind}")
    rows, before = standard_rows(), spark.conf.getAll
    _run(spark, kind, rows[::2], src, sink, ckpt)
    assert _provider(spark, ckpt) == "RocksDBStateStoreProvider"
    assert {k: v for k, v in spark.conf.getAll.items() if "stateStore" in k} == {k: v for k, v in before.items() if "stateStore" in k}
    _run(spark, kind, rows[1::2], src, sink, ckpt)  # a later run goes on from the state
    assert _same(spark, kind, rows, sink)


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_a_store_that_was_chosen_stays(spark, kind):
    src, sink, ckpt = T.scratch_stream_paths(spark, f"chosen-{kind}")
    rows, heap = standard_rows(), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(PROVIDER, heap)
    try:
        _run(spark, kind, rows[::2], src, sink, ckpt)
        assert spark.conf.get(PROVIDER) == heap
    finally:
        spark.conf.unset(PROVIDER)
    _run(spark, kind, rows[1::2], src, sink, ckpt)  # by the session's default now, on the checkpoint's store
    assert _provider(spark, ckpt) == "HDFSBackedStateStoreProvider" and _same(spark, kind, rows, sink)
