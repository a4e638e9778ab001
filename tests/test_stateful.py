"""Streams with typed state against their batch counterparts, on shuffled, late, repeated and missing rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reportmill.operators import serving

pytest.importorskip("google.protobuf", reason="typed state talks to its store in protocol buffers")

from reportmill.streaming import stateful  # noqa: E402

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def streamed(spark, tmp_path):
    """Rows of a stream over batches of rows, one micro-batch each, and the rows of state at the end."""

    def run(batches, schema, make):
        path = tmp_path / "in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"{i:03d}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(path))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(240)
            states = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
        finally:
            query.stop()
        return spark.read.parquet(str(tmp_path / "out")).collect(), states

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_two_levels_agree_with_the_batch(spark, streamed):
    rng = random.Random(2)
    rows = [(f"c{i % 3}", rng.choice(["chat", "labs", "none"]), at(i * 2 + rng.random())) for i in range(120)]
    batches = [rows[i : i + 40] for i in range(0, 120, 40)]
    for b in batches:
        rng.shuffle(b)
    end = [("z", "chat", at(200_000))]
    schema = "client string, route string, ts timestamp"
    got, states = streamed([*batches, end, [("z", "chat", at(400_000))]], schema, lambda s: stateful.two_level_stream(s))
    want = serving.two_level(spark.createDataFrame(rows, schema)).collect()
    show = lambda rs: sorted((r["client"], r["route"], r["ts"], r["route_ok"], r["allowed"]) for r in rs if r["client"] != "z")
    assert show(got) == show(want) and any(not r["route_ok"] for r in got)
    assert sum(states) <= 5  # only the last client's


def test_the_latest_result_wins(spark, streamed):
    rows = [("a", 2, "two", at(1)), ("a", 1, "one", at(2)), ("b", 1, "x", at(2)), ("a", 3, "three", at(3)), ("a", 2, "again", at(4))]
    schema = "key string, ticket bigint, value string, ts timestamp"
    got, _ = streamed([[r] for r in rows], schema, lambda s: stateful.latest_stream(s))
    assert [(r["ticket"], r["value"]) for r in sorted(got, key=lambda r: r["ticket"]) if r["key"] == "a"] == [(2, "two"), (3, "three")]
    want = {r["key"]: r["value"] for r in serving.latest_by_ticket(spark.createDataFrame(rows, schema), ["key"], "ticket", "value").collect()}
    assert {r["key"]: r["value"] for r in sorted(got, key=lambda r: r["ticket"])} == want


def test_bursts_agree_with_the_batch(spark, streamed):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), at(rng.randrange(300))) for _ in range(80)]
    schema = "key string, ts timestamp"
    later = [("z", at(10_000))]
    got, _ = streamed([rows[:40], rows[40:], later, [("z", at(20_000))]], schema, lambda s: stateful.debounce_stream(s, ["key"], "5 seconds", "10 minutes"))
    want = serving.debounce(spark.createDataFrame(rows, schema), ["key"], settle="5 seconds").collect()
    assert sorted(tuple(r) for r in got if r["key"] != "z") == sorted(map(tuple, want))


def test_answers_are_shown_in_order(spark, streamed):
    """Late, repeated and missing deltas, a backup, an error after text; joined parts are what ``assemble`` gives."""
    ev = lambda a, m, s, text, t, kind="delta": (a, m, s, kind, text, at(t))
    batches = [
        [ev("x", 0, 1, "lo ", 1), ev("y", 0, 0, "busy", 1, "error"), ev("w", 0, 0, "", 1)],
        [ev("x", 0, 0, "Hel", 2), ev("x", 0, 1, "lo ", 2), ev("y", 1, 1, "b", 2), ev("z", 0, 0, "p", 2), ev("w", 0, 1, "off", 2, "error")],
        [ev("x", 0, 2, "you", 3), ev("y", 1, 0, "a", 3), ev("z", 0, 1, "cut", 3, "error"), ev("z", 1, 0, "never", 3), ev("w", 1, 0, "ok", 3)],
        [ev("x", 0, 4, "!", 4), ev("x", 0, 0, "Hel", 4)],
        [ev("end", 0, 0, "e", 200)],
        [ev("end", 0, 1, "e", 400)],
    ]
    schema = "answer_id string, model_ix int, seq bigint, type string, text string, ts timestamp"
    got, states = streamed(batches, schema, lambda s: stateful.answer_stream(s))
    shown = {}
    for r in sorted(got, key=lambda r: r["part"]):
        shown.setdefault(r["answer_id"], []).append((r["kind"], r["model_ix"], r["text"]))
    assert shown["x"] == [("delta", 0, "Hel"), ("delta", 0, "lo "), ("delta", 0, "you"), ("delta", 0, "!"), ("end", 0, None)]
    assert shown["y"] == [("failed", 0, "busy"), ("delta", 1, "a"), ("delta", 1, "b"), ("end", 1, None)]
    assert shown["z"] == [("delta", 0, "p"), ("error", 0, "cut"), ("end", 0, None)]
    assert shown["w"] == [("delta", 0, ""), ("failed", 0, "off"), ("delta", 1, "ok"), ("end", 1, None)]
    events = spark.createDataFrame([e for b in batches for e in b], schema).dropDuplicates(["answer_id", "model_ix", "seq"])
    whole = events.select("answer_id", "model_ix", "seq", "type", F.when(F.col("type") == "delta", F.col("text")).alias("text"), F.when(F.col("type") == "error", F.col("text")).alias("message"))
    tries = serving.assemble(whole.withColumn("answer_id", F.concat_ws("/", "answer_id", "model_ix"))).select(F.substring_index("answer_id", "/", 1).alias("q"), F.substring_index("answer_id", "/", -1).cast("int").alias("model_ix"), F.col("answer").alias("text"), "error")
    want = {r["q"]: (r["model_ix"], r["text"], r["error"]) for r in serving.first_stream(tries, ["q"]).collect()}
    for answer, parts in shown.items():
        if answer != "end":
            model = parts[-1][1]
            text = "".join(t for k, m, t in parts if k == "delta" and m == model)
            errors = [t for k, m, t in parts if k == "error"]
            assert (model, text, errors[-1] if errors else None) == want[answer]
    assert sum(states) <= 3
