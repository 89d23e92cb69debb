"""The operators' registered queries, each over its whole table, and the SQL where there is some."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewatch.sources.tables import read_table

from . import (ann, conversations, embedding_dedup, licenses, near_dup, packing, pii, quality, sentencepieces, token_counts, topk,
               url_filter, whitening)

QUERIES, ORACLE = {}, {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


@_query()
def op1_sentencepiece(spark, sf_dir):
    return sentencepieces.encode(read_table(spark, sf_dir, "documents"), keep_ids=False)


@_query()
def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


@_query()
def op3_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@_query()
def op4_pii(spark, sf_dir):
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"), everywhere=True)
    counts = [F.expr(f"cast(size(filter(identifiers, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    base = "transform(identifiers, s -> concat_ws(':', s.kind, s.start, s.end))"
    terms = "transform(terms, t -> concat_ws(':', 'term', t.start, t.end))"
    return found.select("doc_id", *counts, F.sha2(F.expr(f"array_join({base}, ',')"), 256).alias("base_sha256"),
                        F.expr(f"array_join(concat({base}, {terms}), ',')").alias("spans"))


@_query()
def op5_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


@_query()
def op6_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, token_counts.edits_from(docs))


@_query()
def op7_url_filter(spark, sf_dir):
    return url_filter.judge_pages(read_table(spark, sf_dir, "pages"))


@_query()
def op8_nearest_neighbours(spark, sf_dir):
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


@_query("""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
           from embeddings
           where vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, r.vec_id,
                 cast(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * r.c[i])) as bigint) as score
          from v q join v r on q.vec_id <> r.vec_id and len(q.c) = len(r.c)
          where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 5""")
def op9_top_products(spark, sf_dir):
    return topk.top_products(read_table(spark, sf_dir, "embeddings"))


@_query()
def op10_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


@_query()
def op11_conversation_repair(spark, sf_dir):
    rows = conversations.damage(read_table(spark, sf_dir, "conversations"))
    return conversations.repair_digests(rows, conversations.plan_repairs(rows))


@_query()
def op12_whitening(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@_query()
def op13_embedding_near_duplicates(spark, sf_dir):
    return embedding_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
