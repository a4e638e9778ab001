"""The stored index against scanning search: ranks, appended and repeated batches, plans, skipped blocks."""

import random

import pytest
from pyspark.sql import functions as F

from reportmill.operators import lexical_index as L
from reportmill.operators import retrieval as R
from reportmill.sources import segments

COLUMNS = ("query_id", "team", "doc_id", "score", "rank")


def corpus(spark, n, seed, start=0):
    """Words with a long tail, lengths from nothing to hundreds, null texts and teams."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ran", "lem", "tok", "wix", "zud", "yop")]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(start, start + n):
        size = rng.choice([0, 3, 8, 30, 200])
        text = None if i % 17 == 0 else " ".join(rng.choices(words, weights, k=size))
        rows.append((i, rng.choice(["x", "y", None]), text, "more"))
    return spark.createDataFrame(rows, "doc_id bigint, team string, text string, scope string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


QUESTIONS = ("bran zud gzud", "gyop gyop fyop", "bran blem btok the", "nothing here", "", "gyop")


def found(hits, scoped):
    return sorted(tuple(r[c] for c in COLUMNS if c != "team" or scoped) for r in hits.collect())


def scanned(docs, queries, limit, scoped):
    """Scanning search joins on the scope by equality, so its nulls get a name."""
    named = docs.withColumn("team", F.coalesce("team", F.lit("none")))
    return found(R.bm25(named, queries, "doc_id", limit, ["team"] if scoped else []), scoped)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, 700, 1).cache()


@pytest.mark.parametrize("scoped", [False, True])
def test_same_ranks_as_a_scan(spark, docs, tmp_path, monkeypatch, scoped):
    monkeypatch.setattr(L, "BLOCK_BITS", 3)
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id", ["team"] if scoped else [], buckets=8)
    named = docs.withColumn("team", F.coalesce("team", F.lit("none"))) if scoped else docs
    index.add(named.filter("doc_id < 400"), "a")
    index.add(index.absent(named), "b")
    queries = ask(spark, *QUESTIONS)
    for limit in (1, 4, 1000):
        assert found(L.LexicalIndex.open(spark, str(tmp_path)).search(queries, limit), scoped) == scanned(docs, queries, limit, scoped)


def test_null_scopes_are_one(spark, docs, tmp_path):
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id", ["team"])
    index.add(docs, "a")
    got = index.search(ask(spark, "bran zud"), 3)
    assert sorted((r["team"] or "none", r["doc_id"], r["rank"]) for r in got.collect()) == [(t, d, k) for _, t, d, _, k in scanned(docs, ask(spark, "bran zud"), 3, True)]


def test_most_blocks_are_skipped_where_a_term_is_rare(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BITS", 2)
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id")
    index.add(docs.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit(" rarest rarest"))).otherwise(F.col("text"))), "a")
    (row,) = index.effort(ask(spark, "bran rarest"), 3).collect()
    assert row["scored"] < 0.3 * row["blocks"]


def test_batches_are_replaced_and_added(spark, docs, tmp_path):
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id")
    some, more = docs.filter("doc_id < 300"), corpus(spark, 50, 3, start=300)
    queries = ask(spark, *QUESTIONS)
    index.add(docs, "a")
    index.add(some, "a")  # again, with less
    assert found(index.search(queries), False) == scanned(some, queries, 5, False)
    before = {r[0] for r in index.manifest().select("segment").collect()}
    index.add(more, "b")
    assert before < {r[0] for r in index.manifest().select("segment").collect()}
    assert found(index.search(queries), False) == scanned(some.unionByName(more), queries, 5, False)
    assert index.absent(docs).count() == docs.filter("doc_id >= 350").count()


def test_an_unfinished_batch_is_not_seen(spark, docs, tmp_path, monkeypatch):
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id")
    some = docs.filter("doc_id < 200")
    index.add(some, "a")
    monkeypatch.setattr(L.Segments, "new_name", staticmethod(lambda: "broken"))
    monkeypatch.setattr(segments.time, "time_ns", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(docs.filter("doc_id >= 200"), "b")
    monkeypatch.undo()
    assert (tmp_path / "postings" / "segment=broken").exists()
    queries = ask(spark, *QUESTIONS)
    assert found(index.search(queries), False) == scanned(some, queries, 5, False)


def test_a_search_reads_its_terms_folders_and_no_text(spark, docs, tmp_path):
    index = L.LexicalIndex(spark, str(tmp_path), "doc_id", buckets=16)
    index.add(docs, "a")
    wanted = R.query_terms(ask(spark, "gyop"))
    rows = index._read(wanted)
    files = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    plan = rows.select("term", "n")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters")[1] and "hits" not in scan.split("ReadSchema")[1]
    kept = rows.select("bucket").distinct().count()
    assert kept == 1 and len(files) > 1  # inputFiles lists all folders; the scan's filter leaves one
    assert not {"text", "query"} & set(rows.columns)


def test_empty_corpora_and_queries(spark, docs, tmp_path):
    index = L.LexicalIndex(spark, str(tmp_path / "none"), "doc_id")
    index.add(docs.limit(0), "a")
    assert index.search(ask(spark, "bran")).count() == 0
    index.add(docs.filter("doc_id < 40"), "b")
    assert index.search(ask(spark, "the", "")).count() == 0
    assert index.search(ask(spark, "bran").limit(0)).count() == 0


def test_terms_are_counted_and_inverted_where_they_lie(spark, docs, monkeypatch):
    """As many shuffles as it takes to order the passages, and the terms that a scan finds."""
    monkeypatch.setattr(L, "ROWS", 50)
    rows = docs.withColumn("scope", F.struct(F.lit(0).alias("_"))).repartition(1)
    counted = L._counted(rows, "doc_id", "text")
    got = counted.select("doc_id", F.inline("terms"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.postings(docs, "doc_id").collect()))
    placed = counted.sortWithinPartitions("doc_id").withColumn("block", F.shiftright(F.monotonically_increasing_id(), 3))
    made = L._inverted(placed, "doc_id")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    blocks = made.collect()
    assert len({(r["term"], r["block"]) for r in blocks}) == len(blocks)
    assert sorted((h["key"], r["term"], h["tf"]) for r in blocks for h in r["hits"]) == sorted(map(tuple, got.collect()))
    assert all(r["n"] == len(r["hits"]) and r["max_tf"] == max(h["tf"] for h in r["hits"]) and r["min_len"] == min(h["len"] for h in r["hits"]) for r in blocks)
