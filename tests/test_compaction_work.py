"""How much a stream's compactions rewrite."""

from pyspark.sql import functions as F

from stagewatch.session import scratch_path
from stagewatch.streaming import compaction as G
from stagewatch.streaming import monitor as T


def test_small_batches_do_not_rewrite_a_large_generation(spark, monkeypatch):
    dest, done, real = scratch_path(spark, "pays"), [], G.compact
    monkeypatch.setattr(G, "compact", lambda spark, dest, keys: done.append(dest) or real(spark, dest, keys))
    sink = G.compacting_sink(T.batch_folder_sink(dest), dest, ["id"], 1)
    for b in range(13):  # all keys at first, then few of them again and again
        sink(spark.range(200_000 if b == 0 else 100).coalesce(1).select("id", F.lit(b).alias("v")), b)
    assert len(done) == 1
    got = T.read_latest(spark, dest, ["id"]).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {0: 199_900, 12: 100}


def test_the_source_of_a_stream_is_not_held(spark):
    from conftest import SF_SMALL
    from stagewatch.sources.derive import monitoring_events

    ev, held = monitoring_events(spark, SF_SMALL), []
    ev.persist = lambda *a: held.append(a)
    dest = T.stage_rounds_source(ev, scratch_path(spark, "rounds"))
    assert not held and spark.read.parquet(dest).exceptAll(ev).isEmpty() and spark.read.parquet(dest).count() == ev.count()
