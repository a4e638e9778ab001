"""Ranking, fusion, packing and scoring on a handful of passages."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.functions.vectors import cosine
from reportmill.operators import evaluation as E
from reportmill.operators import retrieval as R
from reportmill.operators.dense_index import DenseIndex
from reportmill.plans.queries import QUERIES


@pytest.fixture(scope="module")
def passages(spark):
    rows = [
        ("p1#1", 0, ["IMPRESSION"], "Normal liver. No masses seen."),
        ("p1#2", 1, ["LABS"], "Lactate | 6.1 | mmol/L\nALT | 1001 | IU/L"),
        ("p2#1", 2, ["PLAN"], "Repeat lactate in two weeks. Lactate was high."),
        ("p2#2", 3, ["MEDICATIONS"], "Aspirin once daily for the kidneys"),
    ]
    return spark.createDataFrame(rows, "chunk_id string, chunk_ix int, headings array<string>, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def ids(hits, q=0):
    return [r["chunk_id"] for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()]


def test_bm25_orders_and_scores(spark, passages):
    hits = R.bm25(passages, ask(spark, "lactate", "kidney", "6.1", "nothing here"), "chunk_id")
    assert ids(hits, 0) == ["p2#1", "p1#2"] and ids(hits, 1) == ["p2#2"] and ids(hits, 2) == ["p1#2"] and ids(hits, 3) == []
    docs = {r["chunk_id"]: T.tokenize for r in passages.collect()}
    assert len(docs) == 4
    rows = passages.select("chunk_id", T.tokenize(R.passage_text(passages)).alias("t")).collect()
    terms = {r["chunk_id"]: Counter(r["t"]) for r in rows}
    mean = sum(sum(c.values()) for c in terms.values()) / 4
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    c = terms["p2#1"]
    want = idf * c["lactate"] * 2.2 / (c["lactate"] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    assert hits.filter("query_id = 0 and rank = 1").first()["score"] == pytest.approx(want, abs=1e-8)


def test_repeated_query_terms_count_again(spark, passages):
    one = R.bm25(passages, ask(spark, "lactate"), "chunk_id").first()["score"]
    two = R.bm25(passages, ask(spark, "lactate lactate"), "chunk_id").first()["score"]
    assert two == pytest.approx(2 * one)


def test_section_routing(spark, passages):
    hits = R.route_sections(passages, ask(spark, "What did the scan find?", "What should I do next?", "Which pills do I take?", "lactate"), "chunk_id", "chunk_ix")
    assert [ids(hits, q) for q in range(4)] == [["p1#1"], ["p2#1"], ["p2#2"], []]


def test_fusion_sums_over_lists(spark):
    lists = [spark.createDataFrame([(0, c, i + 1) for i, c in enumerate(x)], "query_id int, chunk_id string, rank int") for x in ("ab", "ca")]
    hits = R.fuse(lists, "chunk_id")
    assert ids(hits) == ["a", "c", "b"]
    assert hits.filter("chunk_id = 'a'").first()["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_hybrid_drops_failing_strategies_and_blank_queries(spark, passages):
    def broken(q, k):
        raise RuntimeError("no index")

    failed = []
    hits = R.hybrid(ask(spark, "lactate", "   "), [broken, lambda q, k: R.bm25(passages, q, "chunk_id", k)], "chunk_id", failed=failed)
    assert ids(hits) == ["p2#1", "p1#2"] and ids(hits, 1) == [] and len(failed) == 1
    with pytest.raises(RuntimeError):
        R.hybrid(ask(spark, "lactate"), [broken], "chunk_id")


def test_a_failing_strategy_fails_the_search_of_who_takes_no_note(spark, passages):
    def broken(q, k):
        raise RuntimeError("no index")

    with pytest.raises(RuntimeError, match="no index"):
        R.hybrid(ask(spark, "lactate"), [lambda q, k: R.bm25(passages, q, "chunk_id", k), broken], "chunk_id")


def test_three_legs_fail_with_a_leg_and_have_no_hits_without_documents(spark, sf, monkeypatch, tmp_path):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["three_leg_search"](spark, str(tmp_path)).collect() == []

    def broken(self, queries, limit):
        raise OSError("a cell can't be read")

    monkeypatch.setattr(DenseIndex, "search", broken)
    with pytest.raises(OSError, match="a cell"):
        QUERIES["three_leg_search"](spark, sf)


def test_dense_keeps_negative_scores(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "query_id int, vector array<float>")
    assert [(r["chunk_id"], r["score"]) for r in R.dense(rows, q, "chunk_id").orderBy("rank").collect()] == [("a", 1.0), ("c", 0.0), ("b", -1.0)]
    with pytest.raises(Exception, match="differ in length"):
        spark.range(1).select(cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


def test_dense_in_tasks_is_the_plain_search(spark, monkeypatch):
    """Copies, zero vectors, nulls and more queries than a block, dealt out to several tasks; no pair is made by a join."""
    from reportmill.operators import leaders

    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(leaders, "PAIRS_A_TASK", 900)
    monkeypatch.setattr(leaders, "CHUNK", 16)
    monkeypatch.setattr(leaders, "WAITING", 20)
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(40)] + [[0.0] * 5, [1.0, None, 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(f"k{i:03}", None if i == 50 else some[i % 42]) for i in range(300)], "k string, vector array<float>")
    q = rows.filter("k < 'k020' OR k IN ('k040', 'k041')").select(F.col("k").alias("query_id"), "vector")
    pairs = rows.filter("vector IS NOT NULL").crossJoin(q.select("query_id", F.col("vector").alias("v")))
    want = R.ranked(pairs.select("query_id", "k", F.round(cosine(F.col("vector"), F.col("v")), 9).alias("score")), "k", 9, ["query_id"])
    got = R.dense(rows, q, "k", 9)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_packing_keeps_a_prefix(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "x" * 60), (1, 3, "x"), (2, 1, "x" * 500)], "q int, rank int, text string")
    kept = R.pack(rows, ["q"], budget=100)
    assert sorted((r["q"], r["rank"]) for r in kept.collect()) == [(1, 1), (2, 1)]


def test_lab_passages(spark):
    rows = [("d", 0, "prose", "MRN 12345 phone 555"), ("d", 1, "table", "Lactate | 6.1 mmol/L"), ("d", 2, "prose", "Blood test in 2 weeks"), ("d", 3, "prose", "nothing")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_ix int, kind string, text string")
    assert {r["chunk_ix"]: r["signal"] for r in R.lab_passages(df, ["doc_id"], "chunk_ix").collect()} == {1: 3, 2: 1}


def test_edges_of_lab_words_are_those_of_ascii_words(spark):
    rows = [(0, "7 élab"), (1, "7 lab"), (2, "7 xlab"), (3, "5 flé"), (4, "5 flx"), (5, "5\x0bmg"), (6, "5 \u00b5mol"), (7, "9 testñ"), (8, "9 re\u017fults")]
    df = spark.createDataFrame(rows, "chunk_ix int, text string").withColumns({"doc_id": F.lit("d"), "kind": F.lit("prose")})
    assert {r["chunk_ix"]: r["signal"] for r in R.lab_passages(df, ["doc_id"], "chunk_ix").collect()} == {0: 1, 1: 1, 3: 2, 6: 2, 7: 1, 8: 1}


def test_snippets(spark):
    text = "start " + "filler " * 40 + "Lactate rose " + "after " * 40
    df = spark.createDataFrame([(1, text), (2, "short  text"), (3, "other " * 60), (4, None)], "i int, text string")
    got = {r["i"]: r["snippet"] for r in T.add_snippet(df, "text", T.tokenize(F.lit("lactate"))).collect()}
    assert got[1].startswith("…filler") and "Lactate rose" in got[1] and got[1].endswith("…") and len(got[1]) <= 162
    assert got[2] == "short text" and got[3].endswith("…") and got[4] is None


def test_scores(spark):
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), ("b", 4)], "kind string, first_rank int")
    rows = {r["kind"]: r for r in E.retrieval_scores(first, [["kind"], []]).collect()}
    assert [rows[None][c] for c in ("recall_1", "recall_3", "recall_5", "mrr")] == [0.25, 0.5, 0.75, 0.4375]
    assert rows["a"]["recall_3"] == 1.0 and rows["b"]["questions"] == 2


def test_multiset_matching(spark):
    found = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    gold = spark.createDataFrame([("x",), ("z",)], "k string")
    r = E.match_counts(E.multiset_match(found, gold, ["k"])).first()
    assert (r["correct"], r["extra"], r["missed"]) == (1, 2, 1) and r["precision"] == pytest.approx(1 / 3)
    none = E.match_counts(E.multiset_match(found.limit(0), gold.limit(0), ["k"])).first()
    assert (none["precision"], none["recall"], none["f1"]) == (1.0, 1.0, 1.0)


def test_passages_for_a_selected_term(spark, passages):
    hits = spark.createDataFrame([("p2#2", 1), ("p2#1", 2)], "chunk_id string, rank int")
    got = R.passages_for_term(passages, hits, "Lactate", "chunk_id", "chunk_ix")
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == ["p1#2", "p2#1", "p2#2"]


def test_prompt_passages(spark):
    row = spark.range(1).select(T.format_passage(F.lit(2), F.lit(3), F.lit(4), F.array(F.lit("A"), F.lit("B")), F.lit("text")).alias("p")).first()
    assert row["p"] == "[2] (p.3-4 · A > B)\ntext"
