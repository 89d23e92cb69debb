"""Disclosing terms in texts that have no identifier themselves."""

from stagewatch.llm import pii, queries
from stagewatch.session import scratch_path


def _rows():
    rows = [(i, f"the note {i} has the word") for i in range(600)]
    rows += [(1000, "the zanzibar agent ann@x.org left"), (1001, "the agent ann@x.org of zanzibar came")]
    return [*rows, (1003, "Zanzibar alone, \U0001f600 zanzibar"), (1003, "Zanzibar alone, \U0001f600 zanzibar"), (None, "in zanzibar"), (1004, None)]


def test_terms_of_all_texts(spark):
    folder = scratch_path(spark, "pii-everywhere")
    spark.createDataFrame(_rows(), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = queries.op4_pii(spark, folder).collect()
    assert len(got) == len(_rows())
    assert [r["spans"] for r in got if r["doc_id"] == 1003] == ["term:0:8,term:18:26"] * 2
    assert [r["spans"] for r in got if r["doc_id"] is None] == ["term:3:11"]
    assert {r["spans"] for r in got if r["doc_id"] is not None and r["doc_id"] < 600 or r["doc_id"] == 1004} == {""}
    assert all("term:4:12" in r["spans"] for r in got if r["doc_id"] == 1000)


def test_the_same_terms_where_there_are_identifiers(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string")
    some, every = (sorted((r["doc_id"], r["identifiers"], r["terms"]) for r in pii.find_personal_data(docs, e).where("size(identifiers) > 0").collect())
                   for e in (False, True))
    assert some == every and len(some) == 2
