"""Limits, validation, event streams, failures and stores; batch and streaming."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reportmill.functions import text
from reportmill.operators import serving as S
from reportmill.sources import stores
from reportmill.streaming import limiter

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def requests(spark, rows):
    return spark.createDataFrame([(k, at(ms), i) for i, (k, ms) in enumerate(rows)], "key string, ts timestamp, i int")


def test_windows_start_at_the_first_request(spark):
    rows = [("a", 100), ("a", 500), ("a", 900), ("b", 900), ("a", 1099), ("a", 1100), ("a", 1101)]
    got = S.fixed_windows(requests(spark, rows), ["key"], ["ts", "i"], 2, 1.0).orderBy("i").collect()
    assert [r["allowed"] for r in got] == [True, True, False, True, False, True, True]


def test_denied_requests_leave_the_day_alone(spark):
    rows = [("c", "labs", at(i * 100), i) for i in range(9)] + [("c", "chat", at(i * 60_000), 100 + i) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "client string, route string, ts timestamp, i int")
    got = S.two_level(df, order=("ts", "i"))
    assert got.filter("route = 'labs' and allowed").count() == 6
    assert got.filter("route = 'chat' and allowed").count() == 394


def test_streaming_limiter(spark, tmp_path):
    for i, batch in enumerate([[("a", 0), ("a", 10), ("a", 20)], [("a", 900), ("a", 1000), ("b", 1000)]]):
        requests(spark, batch).select("key", "ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
        q = limiter.limit_stream(stream, 2, 1.0).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert i in (0, 1)
    got = [(r["key"], r["nth"], r["allowed"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("key", "ts").collect()]
    assert got == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("a", 1, True), ("b", 1, True)]


def test_streaming_windows(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limiter.counted_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_event_lines(spark, tmp_path):
    rows = spark.createDataFrame([("x", 0, "delta", "Hel"), ("x", 1, "delta", ""), ("x", 2, "delta", "lo \"é\"\n"), ("x", 3, "error", "busy"), ("y", 0, "delta", "ok")], "answer_id string, seq int, kind string, text string")
    lines = S.encode_events(rows)
    assert lines.count() == 4
    stores.write_events(lines, str(tmp_path / "events"))
    assert stores.read_events(spark, str(tmp_path / "events")).count() == 4
    bad = spark.createDataFrame([("x", 9, "{broken"), ("x", 10, '{"type":"ping"}'), ("x", 11, "")], "answer_id string, seq int, line string")
    got = {r["answer_id"]: (r["answer"], r["error"]) for r in S.assemble(S.parse_events(lines.unionByName(bad))).collect()}
    assert got == {"x": ('Hello "é"\n', "busy"), "y": ("ok", None)}


@pytest.mark.parametrize(
    ("texts", "statuses", "want"),
    [
        (["explicit deny", "429"], [429], ("budget", 503)),
        (["x"], [429], ("rate limit", 429)),
        (["Quota exceeded"], [], ("rate limit", 429)),
        (["x"], [403], ("credentials", 502)),
        (["model is overloaded"], [500], ("busy", 502)),
        (["request timed out"], [], ("timeout", 504)),
        (["x"], [404], ("unknown model", 502)),
        (["x"], [], ("other", 502)),
    ],
)
def test_failures(spark, texts, statuses, want):
    df = spark.createDataFrame([(texts, statuses)], "t array<string>, s array<int>")
    r = df.select(S.classify_failure(F.col("t"), F.col("s")).alias("r")).first()["r"]
    assert (r["reason"], r["status"]) == want


def test_failover(spark):
    tries = spark.createDataFrame([(1, 0, None, "busy"), (1, 1, "yes", None), (2, 0, None, "a"), (2, 1, None, "b"), (3, 0, "", None), (3, 1, "no", None)], "q int, model_ix int, response string, error string")
    got = {r["q"]: (r["response"], r["error"]) for r in S.first_success(tries, ["q"]).collect()}
    assert got == {1: ("yes", None), 2: (None, "b"), 3: ("", None)}
    streams = spark.createDataFrame([(1, 0, "", "busy"), (1, 1, "yes", None), (2, 0, "part", "cut"), (2, 1, "x", None), (3, 0, "", None), (3, 1, "x", None)], "q int, model_ix int, text string, error string")
    assert {r["q"]: r["model_ix"] for r in S.first_stream(streams, ["q"]).collect()} == {1: 1, 2: 0, 3: 0}


def test_validation_and_hints(spark):
    rows = spark.createDataFrame([('{"q": "hi"}',), ("[1",), ('{"q": "' + "x" * 90 + '"}',), ('{"z": 1}',), (None,)], "body string")
    got = [r["status"] for r in S.validate(rows, "q string", most_bytes=80, checks=F.col("parsed.q").isNotNull()).collect()]
    assert got == [200, 400, 413, 400, 400]
    hint = lambda s: spark.range(1).select(S.retry_hint(F.lit(s)).alias("h")).first()["h"]
    assert [hint(x) for x in (0.2, 119.0, 121.0, 7300.0)] == ["1 second", "119 seconds", "3 minutes", "3 hours"]


def test_client_keys(spark):
    df = spark.createDataFrame([(" 1.2.3.4 ", None), ("", "5.6.7.8, 9.9.9.9"), (None, None)], "r string, f string")
    assert [r[0] for r in df.select(S.client_key(F.col("r"), F.col("f"))).collect()] == ["1.2.3.4", "5.6.7.8", "unknown"]


def test_vector_store_replaces_documents(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "vectors"))
    rows = lambda k, n: spark.createDataFrame([(k, f"c{i}", [float(i), 1.0]) for i in range(n)], "doc_key string, chunk_id string, vector array<double>")
    store.put(rows("a", 3).unionByName(rows("b", 2)))
    store.put(rows("a", 1))
    assert store.read("a").count() == 1 and store.read("b").count() == 2
    assert store.has("b") and not store.has("z")
    assert stores.absent_documents(spark.createDataFrame([("a",), ("q",)], "doc_key string"), store.read()).collect()[0][0] == "q"


def test_embedding_plug_in_and_cache(spark):
    texts = spark.createDataFrame([("aa",), ("b",), ("aa",)], "text string")
    cached = stores.missing_texts(texts, texts.limit(0).selectExpr("text as key"))
    assert cached.count() == 2
    got = stores.embed(texts, lambda batch: [[float(len(t))] for t in batch])
    assert sorted(r["vector"] for r in got.collect()) == [[1.0], [2.0], [2.0]]


def test_files_and_reports(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.txt").write_bytes(b"no")
    got = {r["doc_id"]: r["problem"] for r in stores.read_files(spark, str(tmp_path)).select("doc_id", "problem").collect()}
    assert got == {"file:x.pdf:4": None, "file:y.txt:2": "type"}  # Spark lists no empty files
    shown = spark.range(1).select(stores.admission(F.lit("z.PDF"), F.lit(0)).alias("p")).first()["p"]
    assert shown == "empty"
    assert stores.markdown_table(spark.range(1)) == "| id |\n| --- |\n| 0 |"


def test_history_and_bursts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "open")], "conv_id int, turn int, role string, text string")
    assert [(r["role"], r["text"]) for r in S.history(turns).orderBy("turn", "part").collect()] == [("user", "q"), ("assistant", "a")]
    bursts = S.debounce(requests(spark, [("a", 0), ("a", 100), ("a", 400)]), ["key"])
    assert sorted(r["n"] for r in bursts.collect()) == [1, 2]


def test_limits_of_each_route(spark):
    import json

    passage = {"id": "p1#1", "text": "t", "page": 1, "endPage": 1, "headings": [], "kind": "prose"}
    rows = [
        ("chat", {"question": "why?", "passages": [passage] * 12}, 200),
        ("chat", {"question": "why?", "passages": [passage] * 13}, 400),
        ("chat", {"question": "why?", "passages": [], "history": [{"role": "user", "content": "x"}] * 21}, 400),
        ("chat", {"question": " ", "passages": []}, 400),
        ("define", {"term": "ALT", "passages": [passage] * 5}, 400),
        ("define", {"term": "ALT", "passages": [passage] * 4}, 200),
        ("embed", {"values": ["x" * 8000] * 50}, 200),
        ("embed", {"values": ["x" * 8000] * 51}, 400),
        ("embed", {"values": []}, 400),
        ("simplify", {"text": "y" * 17_000}, 413),
        ("other", {}, 413),
    ]
    df = spark.createDataFrame([(i, r, json.dumps(b)) for i, (r, b, _) in enumerate(rows)] + [(99, "chat", "{oops")], "i int, route string, body string")
    got = {r["i"]: r["status"] for r in S.validate_routes(df).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(rows)} | {99: 400}


def test_failures_are_walked_down(spark):
    inner = '{"message": "quota", "statusCode": 429}'
    error = f'{{"name": "Retry", "lastError": {{"message": "outer", "cause": {inner}}}}}'
    x = spark.createDataFrame([(error,)], "e string").select(S.collect_failure(F.col("e")).alias("f")).select("f.*", S.classify_failure(F.col("f.texts"), F.col("f.statuses")).alias("c")).first()
    assert sorted(x["texts"]) == ["Retry", "outer", "quota"] and x["statuses"] == [429] and x["c"]["status"] == 429


def test_summaries(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (3, 2)], "f int, d int")
    got = [r[0] for r in df.select(text.model_read_summary(F.col("f"), F.col("d"))).collect()]
    assert got == [
        "AI found no further results in the text.",
        "AI found 1 result in the text. 1 more was not in the report and was dropped.",
        "AI found 3 results in the text. 2 more were not in the report and were dropped.",
    ]


def test_windows_against_a_walk(spark):
    """Random bursts, equal times, long gaps, null keys and times, times before 1970, and a key with a third of all rows."""
    import random

    rng = random.Random(6)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, ""])
        ms = rng.choice([rng.randrange(-5000, 5000), rng.randrange(0, 40) * 250, rng.randrange(10**6), None])
        rows.append((key, ms, i))
    df = spark.createDataFrame([(k, None if ms is None else at(ms), i) for k, ms, i in rows], "key string, ts timestamp, i int")
    want, state = {}, {}
    for k, ms, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        start, n = state.get(k, (None, 0))
        if n == 0 or (start is None) != (ms is None) or (ms is not None and ms - start >= 1000):
            start, n = ms, 0
        state[k] = (start, n + 1)
        want[i] = (n + 1, n + 1 <= 3, start)
    got = S.fixed_windows(df, ["key"], ["i"], 3, 1.0).collect()
    shown = lambda t: None if t is None else round((t - at(0)) / dt.timedelta(milliseconds=1))
    assert {r["i"]: (r["nth"], r["allowed"], shown(r["window_start"])) for r in got} == want and len(got) == 900
    assert S.fixed_windows(df.limit(0), ["key"], ["i"], 3, 1.0).count() == 0


def test_no_task_holds_a_hot_keys_requests(spark):
    """Requests of a key spread over stretches: no exchange deals them by key alone."""
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.timestamp_millis(F.col("id") * 700).alias("ts"), "id")
    done = S.fixed_windows(df, ["key"], ["id"], 5, 1.0)
    plan = done._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and all("tretch" in x or "_start" in x for x in dealt)
    assert done.filter("key = 'hot'").count() == 1334


def test_two_levels_as_a_stream(spark, tmp_path):
    rows = [("c", "labs", f"2024-01-01 00:00:{i:02d}") for i in range(9)] + [("c", "labs", "2024-01-01 00:01:01"), ("d", "nowhere", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "client string, route string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = limiter.two_level_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("two_level").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda d: sorted(map(tuple, d.select("client", "route", "ts", "route_ok", "allowed").collect()))
    got = key(spark.table("two_level"))
    assert got == key(S.two_level(df)) and sum(r[-1] for r in got) == 7


def test_the_minute_is_worked_out_once_for_the_day(spark, monkeypatch):
    """What the routes' minutes say is read from the shared folder by all steps of the day."""
    from reportmill.operators import windows

    seen = []
    monkeypatch.setattr(windows, "written", lambda df, real=windows.written: seen.append(set(df.columns)) or real(df))
    rows = spark.createDataFrame([(i, "c", "labs", i * 5) for i in range(30)], "i int, client string, route string, s int")
    done = S.two_level(rows.withColumn("ts", F.timestamp_seconds("s")).drop("s"), order=("ts", "i"))
    assert any("route_ok" in columns for columns in seen)
    assert sorted((r["i"], r["allowed"]) for r in done.collect()) == [(i, i % 12 < 6) for i in range(30)]
