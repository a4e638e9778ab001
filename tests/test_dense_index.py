"""The stored vector index against exhaustive search, and the wiring of all legs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.operators import dense_index as D
from reportmill.operators import lexical_index as L
from reportmill.operators import retrieval as R
from reportmill.operators import search as S


def vectors(spark, n, seed, start=0, clusters=9, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    rows = [(start + i, [float(x) for x in (centres[i % clusters] + rng.normal(0, 0.2, dims)).astype(np.float32)]) for i in range(n)]
    rows += [(start + n, [0.0] * dims), (start + n + 1, None), (None, rows[0][1])]
    return spark.createDataFrame(rows, "chunk_id bigint, vector array<float>")


def found(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in hits.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    return vectors(spark, 600, 1).cache()


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(6)] + [(9, [0.0] * 8)]
    return spark.createDataFrame(rows, "query_id int, vector array<float>")


def exhaustive(rows, queries, limit):
    return found(R.dense(rows.filter("chunk_id IS NOT NULL"), queries, "chunk_id", limit))


def test_same_hits_as_all_pairs(spark, corpus, queries, tmp_path, monkeypatch):
    index = D.DenseIndex(spark, str(tmp_path), "chunk_id", cells=12)
    assert index.upsert(corpus.filter("chunk_id < 350")) == 350 and index.upsert(corpus.filter("chunk_id >= 350")) == 251
    for limit in (1, 5, 700):
        assert found(index.search(queries, limit)) == exhaustive(corpus, queries, limit)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    assert found(index.search(queries, 5)) == exhaustive(corpus, queries, 5)
    near = corpus.filter("chunk_id % 50 = 3").select(F.col("chunk_id").alias("query_id"), "vector")
    effort = index.effort(near, 3).agg(F.sum("scored"), F.sum("vectors")).first()
    assert effort[0] < 0.5 * effort[1]


def test_upserts_write_what_changed(spark, corpus, queries, tmp_path):
    index = D.DenseIndex(spark, str(tmp_path), "chunk_id", cells=5)
    index.upsert(corpus)
    segments = index.names()
    assert index.upsert(corpus) == 0 and index.names() == segments
    turned = corpus.withColumn("vector", F.when(F.col("chunk_id") % 5 == 0, F.transform("vector", lambda x: (-x).cast("float"))).otherwise(F.col("vector")))
    changed = corpus.filter("chunk_id % 5 = 0 AND vector IS NOT NULL").count()
    assert index.upsert(turned.unionByName(vectors(spark, 20, 4, start=900))) in (changed + 21, changed + 20)  # minus zero is zero
    assert found(index.search(queries)) == exhaustive(turned.unionByName(vectors(spark, 20, 4, start=900)), queries, 5)
    assert index.upsert(corpus) > 0 and found(index.search(queries, 3)) == exhaustive(corpus.unionByName(vectors(spark, 20, 4, start=900)), queries, 3)


def test_cells_are_pruned_from_the_scan(spark, corpus, tmp_path):
    index = D.DenseIndex(spark, str(tmp_path), "chunk_id", cells=12)
    index.upsert(corpus)
    plan = index._live().filter(F.col("cell").isin([1, 2])).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_odd_vectors(spark, tmp_path):
    index = D.DenseIndex(spark, str(tmp_path), "chunk_id")
    with pytest.raises(ValueError, match="nothing is indexed"):
        index.search(spark.createDataFrame([(1, [1.0])], "query_id int, vector array<float>"))
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "chunk_id bigint, vector array<float>")
    assert index.upsert(zero.limit(0)) == 0 and index.upsert(zero) == 2
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert found(index.search(q)) == [(1, 1, 1, 0.0), (1, 2, 2, 0.0)]
    with pytest.raises(Exception, match="differ in length"):
        index.search(q.withColumn("vector", F.array(F.lit(1.0)))).collect()


def test_all_legs_are_fused_and_indexes_are_made_once(spark, corpus, tmp_path):
    passages = corpus.filter("chunk_id < 40").select("chunk_id", "vector").withColumn("text", F.concat(F.lit("liver report "), F.col("chunk_id") % 7, F.lit(" lactate")))
    passages = passages.withColumn("headings", F.array(F.when(F.col("chunk_id") % 3 == 0, "PLAN").otherwise("LABS")))
    lexical, dense = L.LexicalIndex(spark, str(tmp_path / "l"), "chunk_id"), D.DenseIndex(spark, str(tmp_path / "d"), "chunk_id", cells=4)
    seen = []

    def embed(rows):
        seen.append(rows.count())
        return rows

    assert len(S.legs(passages, "chunk_id", "chunk_id", lexical, dense, lambda q: q)) == 2
    assert S.ensure_lexical(lexical, passages, "p") == 40 and S.ensure_dense(dense, passages, embed) == 40
    written = (lexical.names(), dense.names())
    assert S.ensure_lexical(lexical, passages, "p") == 0 and S.ensure_dense(dense, passages, embed) == 0 and seen == [40, 0]
    assert (lexical.names(), dense.names()) == written
    queries = spark.createDataFrame([(1, "what should I do next about lactate"), (2, "liver 3")], "query_id int, query string")
    vector = passages.select((F.col("chunk_id") + 1).cast("int").alias("query_id"), "vector").filter("query_id = 1")
    hits = R.hybrid(queries, S.legs(passages, "chunk_id", "chunk_id", lexical, dense, lambda q: q.join(vector, "query_id", "left")), "chunk_id")
    legs = [R.bm25(passages, queries, "chunk_id", 10), R.route_sections(passages, queries, "chunk_id", "chunk_id", 10), R.dense(passages, vector, "chunk_id", 10)]
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, R.fuse(legs, "chunk_id").collect()))
