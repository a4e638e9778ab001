"""Series as figures against series of collected readings, in one part and in merged ones; many terms at once."""

import random

import pytest
from pyspark.sql import functions as F

from reportmill.operators import assess as A
from reportmill.operators import retrieval as R
from reportmill.operators import series_table as S
from reportmill.operators.automaton import containing

def day():
    return F.to_date("day")


FIELDS = ("doc_id", "test", "n", "first_ix", "out_of_range", "trend")


@pytest.fixture(scope="module")
def results(spark):
    """A series with a third of all rows, unread dates in some series, and a null document."""
    rng = random.Random(8)
    rows = []
    for ix in range(600):
        doc, test = ("hot", "alt") if ix % 3 == 0 else (rng.choice(["a", "b", None]), rng.choice(["alt", "crp", "k"]))
        day = None if test == "k" and rng.random() < 0.2 else f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}"
        rows.append((doc, test, ix, day, float(rng.randint(1, 40)), rng.choice(["low", "normal", "high"]), rng.randint(1, 6)))
    return spark.createDataFrame(rows, "doc_id string, test string, ix int, day string, value double, status string, page int").cache()


def shown(found, ends):
    return sorted((tuple(str(r[c]) for c in FIELDS) + tuple((e["ix"], e["value"], e["status"]) for e in ends(r))) for r in found.collect())


def by_arrays(results):
    return shown(A.series(results, ["doc_id"], "ix", day(), ["value", "status", "page"]), lambda r: (r["readings"][0], r["readings"][-1]))


def by_figures(figures):
    return shown(S.finished(figures, ["doc_id"]), lambda r: (r["first"], r["latest"]))


def test_figures_tell_what_arrays_do(results):
    assert by_figures(S.summarize(results, ["doc_id"], "ix", day(), ["value", "status"])) == by_arrays(results)


def test_parts_merge(results):
    parts = [S.summarize(results.filter(F.col("ix") % 4 == i), ["doc_id"], "ix", day(), ["value", "status"]) for i in range(4)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    assert by_figures(S.merged(every, ["doc_id"])) == by_arrays(results)
    plan = S.summarize(results, ["doc_id"], "ix", day(), ["value", "status"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "partial_min" in plan


def test_a_stored_table_takes_batches(spark, results, tmp_path):
    table = S.SeriesTable(spark, str(tmp_path), ["doc_id"])
    first, rest = results.filter("ix < 200"), results.filter("ix >= 200")
    for batch, rows in (("1", first), ("2", rest), ("1", first)):
        table.add(rows, batch, "ix", day(), ["value", "status"])
    assert shown(table.series(), lambda r: (r["first"], r["latest"])) == by_arrays(results)
    want = A.headline(A.series(results, ["doc_id"], "ix", day(), ["value", "status", "page"]), ["doc_id"])
    assert sorted(map(repr, table.headline().collect())) == sorted(map(repr, want.collect()))
    table.add(rest.limit(0), "2", "ix", day(), ["value", "status"])
    assert shown(table.series(), lambda r: (r["first"], r["latest"])) == by_arrays(first)


def test_an_automaton_finds_what_contains_does():
    rng = random.Random(3)
    terms = ["", *("".join(rng.choices("abé ", k=rng.randint(1, 5))) for _ in range(300))]
    search = containing(terms)
    for _ in range(200):
        text = "".join(rng.choices("abé c", k=rng.randint(0, 30)))
        assert sorted(search(text)) == sorted({t for t in terms if t in text})
    assert containing([])("abc") == [] and containing([""])("") == [""]


@pytest.mark.parametrize("most", [200_000, 700])
def test_many_terms_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_TERMS", most)
    rng = random.Random(4)
    n = 100_000 if most == 200_000 else 2000
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", *(" ".join(rng.choices(words, k=40)) for _ in range(60))]
    passages = spark.createDataFrame([(f"p{i}", i, t) for i, t in enumerate(texts)], "chunk_id string, chunk_ix int, text string")
    terms = [(i, rng.choice([f"W{i % 4000}", f"w{i}  w{i + 1}", "nowhere at all", f" w{i % 50} "])) for i in range(n)] + [(n, None), (n + 1, "W1"), (n + 1, "w2")]
    asked = spark.createDataFrame(terms, "term_id int, term string")
    hits = spark.createDataFrame([(0, "p9", 1), (0, "p5", 2)], "term_id int, chunk_id string, rank int")
    got = {}
    for r in R.passages_for_terms(passages, hits, asked, "chunk_id", "chunk_ix").collect():
        got.setdefault(r["term_id"], []).append((r["rank"], r["chunk_id"]))
    plain = lambda t: " ".join(t.split()).lower()
    flat = [None if t is None else plain(t) for t in texts]
    known, want = {}, {}
    for i, t in terms:
        if t is not None:
            if plain(t) not in known:
                known[plain(t)] = [k for k, x in enumerate(flat) if x is not None and plain(t) in x]
            want.setdefault(i, set()).update(known[plain(t)])
    want = {i: [f"p{k}" for k in sorted(found)] for i, found in want.items()}
    want[0] = [*want.get(0, []), *(p for p in ("p9", "p5") if p not in want.get(0, []))]
    assert {i: [p for _, p in sorted(x)] for i, x in got.items()} == {i: x[:4] for i, x in want.items() if x}


def test_copies_of_frequent_terms_shuffle_a_few_rows_a_term(spark, tmp_path):
    """2000 ids of one term in 2000 passages are 4 rows a task before the ids meet them, not 4 million pairs."""
    passages = spark.range(2000).select(F.col("id").alias("k"), (2000 - F.col("id")).alias("ix"), F.lit("a Frequent word").alias("text"))
    asked = passages.select(F.col("k").alias("term_id"), F.lit("frequent  word").alias("term"))
    rows = R._containing(passages, spark.createDataFrame([("frequent word",), ("word",), ("none",)], "_term string"), "k", "ix", 4)
    assert rows.count() <= 8 * passages.rdd.getNumPartitions()
    got = R.passages_for_terms(passages, asked.limit(0).select("term_id", F.col("term_id").alias("k"), F.lit(0).alias("rank")), asked, "k", "ix")
    assert got.count() == 8000 and {(r["rank"], r["k"]) for r in got.collect()} == {(i + 1, 1999 - i) for i in range(4)}
