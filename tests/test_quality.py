"""The six reports end to end: search, readings and verification reach the published figures."""

import pytest
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.operators import assess, chunking, grounding, lab_tables, retrieval
from reportmill.operators import evaluation as E
from reportmill.sources import corpus
from tests.six_reports import REPORTS

KEY = ["doc_id", "chunk_id"]


@pytest.fixture(scope="module")
def blocks(spark):
    return corpus.blocks(spark, REPORTS).cache()


@pytest.fixture(scope="module")
def passages(blocks):
    return chunking.chunks(blocks).cache()


@pytest.fixture(scope="module")
def rows(blocks):
    return lab_tables.read_tables(blocks).cache()


def test_systems_reach_the_published_scores(spark, passages):
    questions = corpus.questions(spark, REPORTS)
    asked = questions.select("query_id", "query")

    def searched(*strategies):
        hits = retrieval.hybrid(asked, strategies, "chunk_id", by=("query_id", "doc_id"))
        return hits.join(questions.select("query_id", "doc_id"), ["query_id", "doc_id"])

    lexical = lambda q, k: retrieval.bm25(passages, q, "chunk_id", k, ["doc_id"])
    sections = lambda q, k: retrieval.route_sections(passages, q, "chunk_id", "chunk_ix", k, ["doc_id"])
    systems = {"BM25": searched(lexical), "BM25 + sections": searched(lexical, sections)}
    texts = passages.withColumn("text", T.embedding_text(F.col("headings"), F.col("text")))
    scores = E.compare_systems(systems, questions, texts, KEY).cache()
    got = {(r["system"], r["kind"]): r for r in scores.collect()}
    percent = lambda x: round(100 * x, 1)
    figures = {s: (*(percent(got[s, None][f"recall_{k}"]) for k in (1, 3, 5)), round(got[s, None]["mrr"], 3)) for s in systems}
    assert figures == {"BM25": (65.9, 75.6, 75.6, 0.707), "BM25 + sections": (73.2, 80.5, 80.5, 0.768)}
    kinds = {s: [percent(got[s, k]["recall_5"]) for k in ("lexical", "paraphrase", "section")] for s in systems}
    assert kinds == {"BM25": [100.0, 61.9, 60.0], "BM25 + sections": [100.0, 61.9, 100.0]}
    assert got["BM25", None]["questions"] == 41
    floors = [("system = 'BM25' AND kind = 'lexical'", "recall_5", 0.85)]
    assert E.below_floors(scores, floors).isEmpty()
    assert E.below_floors(scores, [("system = 'BM25' AND kind IS NULL", "recall_5", 0.85)]).count() == 1


def test_all_readings_and_statuses(spark, rows):
    keyed = lambda df: df.withColumn("name", T.normalize_name(F.col("name")))
    gold = corpus.known_readings(spark, REPORTS)
    matched = E.multiset_match(keyed(assess.assess(rows)), keyed(gold), ["doc_id", "name", "value"], "status").cache()
    counts = E.match_counts(matched).first()
    assert (counts["correct"], counts["extra"], counts["missed"]) == (43, 0, 0)
    assert counts["precision"] == counts["recall"] == counts["f1"] == 1.0
    status = E.status_accuracy(matched).first()
    assert (status["right"], status["matched"], status["status_accuracy"]) == (43, 43, 1.0)


def test_genuine_rows_stay_and_fakes_fall(rows, passages):
    model = rows.select(
        "doc_id", "name", F.col("value_text").alias("value"), "unit", F.col("printed_range_text").alias("reference_range"), F.lit(None).cast("string").alias("flag"), "date", "page"
    )
    kept = lambda df: grounding.kept_and_discarded(grounding.ground(df, passages), []).first()
    assert tuple(kept(model)) == (43, 0)
    numbers = rows.select("doc_id", "name", F.col("value").cast("string").alias("value"), "unit", F.col("printed_range_text").alias("reference_range"), F.lit(None).cast("string").alias("flag"), "date", "page")
    by_value = E.fabricate(numbers).filter("fake = 'value'")
    others = E.fabricate(model, wrong_page=F.when(F.col("page") == 1, 2).otherwise(1)).filter("fake <> 'value'")
    assert tuple(kept(by_value.unionByName(others))) == (0, 129)
    invented = grounding.ground(model.withColumn("reference_range", F.lit("987.1-991.3")), passages)
    assert invented.filter("kept AND printed_range IS NULL").count() == 43
