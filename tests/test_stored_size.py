"""What the log sinks keep on disk, next to the text that they hold."""

import glob
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from stagewatch.plans.registry import QUERIES, load_all
from stagewatch.session import checkpoint_root, scratch_path
from stagewatch.sources import jsonlog as JL
from stagewatch.sources import sinks as SK
from stagewatch.sources.derive import monitoring_events


def _bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/part-*", recursive=True))


def _text(ev):
    return JL.to_log_records(ev).agg(F.sum(F.length("message"))).first()[0]


def test_a_log_is_stored_in_a_part_of_its_text_and_read_back_whole(spark):
    ev, path = monitoring_events(spark, SF_SMALL), scratch_path(spark, "log-size")
    JL.write_log(ev, path, unit="month")
    assert _bytes(path) < _text(ev) / 4
    want, got = JL.to_log_records(ev), JL.read_log(spark, path).drop("log_date")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_the_stream_fan_out_stores_its_log_compressed(spark):
    load_all()
    there = set(glob.glob(f"{checkpoint_root(spark)}/stagewatch/t5-*"))
    n = QUERIES["t5_stream_fan_out"](spark, SF_SMALL).count()
    run = (set(glob.glob(f"{checkpoint_root(spark)}/stagewatch/t5-*")) - there).pop()
    ev = monitoring_events(spark, SF_SMALL)
    assert n == ev.count() == spark.read.json(f"{run}/sink/log").count()
    assert _bytes(f"{run}/sink/log") < _text(ev) / 4


def test_generated_ids_are_stored_shorter_than_their_text(spark):
    path = scratch_path(spark, "ids-size")
    SK.append_with_ids(spark.range(20000).coalesce(1), path)
    assert spark.read.parquet(path).select("_id").distinct().count() == 20000
    assert _bytes(path) < 20000 * 30
