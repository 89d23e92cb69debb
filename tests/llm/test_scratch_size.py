"""What operators shuffle and keep on disk, next to the texts that they read."""

import glob
import os
import random

import pytest
from stagewatch.llm import common, near_dup, packing, pii
from stagewatch.session import checkpoint_root


def _texts(n, words=200):
    draw = random.Random(7)
    return [(i, " ".join(f"{draw.getrandbits(40):x}" for _ in range(words))) for i in range(n)]


def _stored(spark, label, run):
    at = f"{checkpoint_root(spark).removeprefix('file://')}/stagewatch/llm-{label}-*"
    there = set(glob.glob(at))
    run()
    return sum(os.path.getsize(f) for d in set(glob.glob(at)) - there for f in glob.glob(f"{d}/part-*"))


def test_texts_without_an_identifier_are_not_stored(spark):
    rows = _texts(200)
    docs = spark.createDataFrame([*rows, (900, "mail ann@x.org now"), (None, None)], "doc_id long, text string")
    held = _stored(spark, "identifiers", lambda: pii.find_personal_data(docs, everywhere=True).count())
    assert 0 < held < sum(len(t) for _, t in rows) / 4


def test_rows_of_other_ids_stay_out_of_the_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([*((i % 900 - 5, f"t{i}") for i in range(1000)), (None, "none")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in (-5, 3, 3, 64, 800, 10**15, None)], "doc_id long")
    want = sorted(tuple(r) for r in docs.join(ids, "doc_id", "left_semi").collect())
    assert len(want) == 7
    assert common.maybe_with_ids(docs, ids).count() < 20
    for bits in (common.BITS, 64):
        monkeypatch.setattr(common, "BITS", bits)
        assert sorted(tuple(r) for r in common.with_ids(docs, ids).collect()) == want
    assert common.with_ids(docs, ids.limit(0)).count() == 0
    monkeypatch.setattr(common, "BITS", 1 << 23)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = common.with_ids(docs, ids)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert -1 < plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")  # what stands deeper runs first


def test_signatures_are_dealt_out_once(spark):
    docs = spark.createDataFrame(_texts(20), "doc_id long, text string")
    signed = near_dup.signatures(docs)
    plan = near_dup.class_nodes(signed.where("doc_id is not null and n_shingles > 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_batches_of_stored_tables_are_short(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = spark.range(0, 5000, 1, 1).mapInPandas(lambda it: (b.iloc[:1].assign(id=len(b)) for b in it), "id long")
    assert sum(r["id"] for r in common.stored(sizes, "sizes").collect()) == 5000
    assert max(r["id"] for r in common.stored(sizes, "sizes").collect()) <= common.BATCH_ROWS
    assert spark.conf.get(key) == before


def test_batches_are_bounded_by_bytes_and_settings_come_back(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('x', 20000) as text").coalesce(1)
    rows = common.stored(docs.mapInArrow(sizes, "n long, bytes long"), "batches").collect()
    assert sum(r["n"] for r in rows) == 2000 and max(r["bytes"] for r in rows) < 2 * common.BATCH_BYTES  # 20 MB before
    assert [spark.conf.get(k) for k in keys] == before


def test_quality_stage_is_read_in_short_batches(spark):
    import corpus_pipeline

    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    docs = spark.createDataFrame([(1, "One line. Another one."), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    try:
        spark.conf.set(keys[0], "50")
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(corpus_pipeline, "read_table", lambda *_: labels)
            corpus_pipeline.quality_stage(spark, docs, "")
        assert spark.conf.get(keys[0]) == "50"  # a smaller one stays
        assert int(spark.conf.get(keys[1])) <= common.BATCH_BYTES
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_packing_starts_no_workers_for_its_plan(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: pytest.fail("rows of the plan go through Python workers"))
    rows = packing.pack(docs, capacity=64).collect()
    assert {r["doc_id"] for r in rows} == set(range(20))
