"""Requests and answers as tables: limits, validation, event streams, failures, failover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as T
from reportmill.operators import windows

#: Requests a minute by route, and a day for all (fixed values).
PER_MINUTE = {"chat": 20, "define": 40, "embed": 10, "labs": 6, "simplify": 40}
PER_DAY = 400
#: Bytes, passages and messages that a route takes (fixed values).
BODY_LIMITS = {"chat": 512_000, "define": 64_000, "embed": 1_200_000, "labs": 256_000, "simplify": 16_000}
ITEM_LIMITS = {"chat": 12, "define": 4, "embed": 400, "labs": 12}
#: Messages of a chat's history, and characters of all texts to embed, of one, of a question, a
#: term and a passage (fixed values).
MOST_HISTORY, MOST_CHARS, MOST_TEXT, MOST_QUESTION, MOST_TERM, MOST_PASSAGE = 20, 400_000, 8_000, 2_000, 300, 8_000


def client_key(real_ip: Column, forwarded: Column) -> Column:
    hop = T.trim_ws(F.split(forwarded, ",")[0])
    return F.coalesce(F.nullif(T.trim_ws(real_ip), F.lit("")), F.nullif(hop, F.lit("")), F.lit("unknown"))


def fixed_windows(requests: DataFrame, key: list[str], order: list[str], limit: Column | int, seconds: float, at: str = "ts") -> DataFrame:
    """Add window_start, nth and allowed: windows start at a key's first request after the last.

    Denied requests count as well. See :mod:`windows`; rounds are written to the shared folder.
    """
    cap = F.lit(limit) if isinstance(limit, int) else limit
    return windows.fixed_windows(requests, key, order, cap, int(seconds * 1_000_000), at)


def two_level(requests: DataFrame, client: str = "client", route: str = "route", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Requests with ``allowed`` by their route's minute, then by the client's day.

    The day only counts requests that their route's minute let pass; what the minute says is written
    to the shared folder, as the day's steps read it several times.
    """
    caps = F.create_map(*(F.lit(x) for pair in PER_MINUTE.items() for x in pair))
    minute = fixed_windows(requests, [client, route], list(order), F.coalesce(F.try_element_at(caps, F.col(route)), F.lit(0)), 60)
    minute = windows.written(minute.withColumnRenamed("allowed", "route_ok").drop("nth", "window_start"))
    passed = fixed_windows(minute.filter("route_ok"), [client], list(order), PER_DAY, 86_400).drop("nth", "window_start")
    return passed.unionByName(minute.filter("not route_ok").withColumn("allowed", F.lit(False)))


def retry_hint(seconds: Column) -> Column:
    n = F.greatest(F.ceil(seconds), F.lit(1))
    return F.when(n < 120, T.plural(n, "second")).when(n < 7200, T.plural(F.ceil(n / 60), "minute")).otherwise(T.plural(F.ceil(n / 3600), "hour"))


def validate(requests: DataFrame, schema: str, body: str = "body", most_bytes: Column | int = 512_000, checks: Column | None = None) -> DataFrame:
    """Add parsed, and status 200, 400 or 413: too long, not JSON of the schema, or failing checks."""
    parsed = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"})
    out = requests.withColumn("parsed", parsed)
    fine = F.col("parsed").isNotNull() & F.coalesce(checks if checks is not None else F.lit(True), F.lit(False))
    long = F.octet_length(body) > most_bytes
    return out.withColumn("status", F.when(long, 413).when(fine, 200).otherwise(400))


_PASSAGE = "struct<id:string,text:string,page:int,endPage:int,headings:array<string>,kind:string>"
BODY = f"question string, term string, passages array<{_PASSAGE}>, history array<struct<role:string,content:string>>, values array<string>"


def validate_routes(requests: DataFrame, route: str = "route", body: str = "body") -> DataFrame:
    """Add parsed, and status 200, 400 or 413 by the limits of each request's route.

    Routes that are not listed take nothing (413). ``simplify`` has no list and only a bound on bytes.
    """
    r, p = F.col(route), F.col("parsed")
    between = lambda c, low, high: F.coalesce(F.length(T.trim_ws(c)).between(low, high), F.lit(False))
    passages = F.coalesce(F.size(p["passages"]) <= _by_route(r, ITEM_LIMITS), F.lit(False)) & F.forall(p["passages"], lambda x: F.length(x["text"]) <= MOST_PASSAGE)
    values = F.size(p["values"]).between(1, ITEM_LIMITS["embed"]) & F.forall(p["values"], lambda v: F.length(v) <= MOST_TEXT)
    values &= F.aggregate(p["values"], F.lit(0), lambda a, v: a + F.length(v)) <= MOST_CHARS
    checks = (
        F.when(r == "chat", between(p["question"], 1, MOST_QUESTION) & passages & (F.coalesce(F.size(p["history"]), F.lit(0)) <= MOST_HISTORY))
        .when(r == "define", between(p["term"], 1, MOST_TERM) & passages)
        .when(r == "embed", values)
        .when(r == "labs", passages)
        .when(r == "simplify", F.lit(True))
    )
    return validate(requests, BODY, body, F.coalesce(_by_route(r, BODY_LIMITS), F.lit(0)), checks)


def _by_route(route: Column, limits: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), route)


def encode_events(rows: DataFrame) -> DataFrame:
    """(answer_id, seq, kind, text) -> line: one JSON object an event; empty deltas are skipped."""
    kept = rows.filter((F.col("kind") == "error") | (F.col("text") != ""))
    delta = F.to_json(F.struct(F.lit("delta").alias("type"), F.col("text").alias("text")))
    error = F.to_json(F.struct(F.lit("error").alias("type"), F.col("text").alias("message")))
    return kept.select("answer_id", "seq", F.when(F.col("kind") == "error", error).otherwise(delta).alias("line"))


EVENT = "type string, text string, message string"


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of well-formed lines; blank, malformed and unknown lines are skipped."""
    e = F.from_json("line", EVENT, {"mode": "PERMISSIVE"})
    ok = ((F.col("e.type") == "delta") & F.col("e.text").isNotNull()) | ((F.col("e.type") == "error") & F.col("e.message").isNotNull())
    return lines.withColumn("e", e).filter(ok).select("answer_id", "seq", "e.type", "e.text", "e.message")


def assemble(events: DataFrame) -> DataFrame:
    """(answer_id, answer, error): deltas in order; the last error beside the partial text.

    An answer is one text, so its deltas meet in one row: it has to fit a string (2 GB at most).
    """
    deltas = F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))
    answer = F.array_join(F.transform(F.array_sort(deltas), lambda d: d["text"]), "")
    return events.groupBy("answer_id").agg(answer.alias("answer"), F.max_by("message", F.when(F.col("type") == "error", F.col("seq"))).alias("error"))


def first_success(tries: DataFrame, by: list[str], order: str = "model_ix") -> DataFrame:
    """The first try that worked, else the last error; an empty answer without error works."""
    ok = F.col("error").isNull()
    return tries.groupBy(*by).agg(
        F.min_by("response", F.when(ok, F.col(order))).alias("response"),
        F.min(F.when(ok, F.col(order))).alias("model_ix"),
        F.when(F.count_if(ok) == 0, F.max_by("error", order)).alias("error"),
    )


def first_stream(tries: DataFrame, by: list[str], order: str = "model_ix") -> DataFrame:
    """The try whose stream an answer shows: backups step in only before any text came."""
    settled = (F.col("text") != "") | F.col("error").isNull()
    pick = F.coalesce(F.min(F.when(settled, F.col(order))), F.max(order)).alias("pick")
    chosen = tries.groupBy(*by).agg(pick)
    return tries.join(chosen, by).filter(F.col(order) == F.col("pick")).drop("pick")


#: (status of the answer, provider statuses, phrases), the first that fits (fixed values).
FAILURES = (
    ("budget", 503, (), ("explicit deny",)),
    ("rate limit", 429, (429,), ("rate limit", "resource_exhausted", "quota")),
    ("credentials", 502, (401, 403), ("api key not valid", "api_key_invalid", "invalid api key")),
    ("busy", 502, (503,), ("high demand", "overloaded")),
    ("timeout", 504, (), ("timeout", "timed out")),
    ("unknown model", 502, (404,), ("model identifier is invalid",)),
)


def classify_failure(texts: Column, statuses: Column) -> Column:
    """struct(reason, status) of a failure's collected messages and provider statuses."""
    said = F.lower(F.array_join(texts, " "))
    out = F.struct(F.lit("other").alias("reason"), F.lit(502).alias("status"))
    for reason, status, codes, phrases in reversed(FAILURES):
        fits = F.lit(False)
        for c in codes:
            fits = fits | F.array_contains(statuses, c)
        for p in phrases:
            fits = fits | F.contains(said, F.lit(p))
        out = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(reason).alias("reason"), F.lit(status).alias("status"))).otherwise(out)
    return out


#: Fields of a failure that may say what went wrong, and links to the failure below (fixed values).
SAYS, CODES, BELOW, DEPTH = ("message", "responseBody", "code", "name"), ("statusCode", "status"), ("cause", "lastError"), 5


def collect_failure(error: Column, depth: int = DEPTH) -> Column:
    """struct(texts, statuses) of a failure in JSON and of those that it wraps, ``depth`` levels down."""

    def schema(left: int) -> str:
        below = [f"{b}:{schema(left - 1)}" for b in BELOW] if left else []
        return f"struct<{','.join([*(f'{s}:string' for s in SAYS), *(f'{c}:int' for c in CODES), *below])}>"

    def walk(x: Column, left: int) -> list[Column]:
        return [x, *(y for b in BELOW for y in walk(x[b], left - 1))] if left else [x]

    def collected(x: Column) -> Column:
        all_ = walk(x, depth)
        named = lambda fields: F.array_compact(F.array(*(y[f] for y in all_ for f in fields)))
        return F.struct(named(SAYS).alias("texts"), named(CODES).alias("statuses"))

    return T.let(F.from_json(error, schema(depth)), collected)


def log_line(names: Column, statuses: Column, message: Column) -> Column:
    """A line without provider texts: names from outer to inner, statuses, the safe message."""
    codes = F.array_join(F.array_distinct(F.transform(statuses, lambda s: s.cast("string"))), ", ")
    return F.concat(F.array_join(F.array_distinct(names), " < "), F.lit(" ["), codes, F.lit("] "), message)


def latest_by_ticket(results: DataFrame, by: list[str], ticket: str, value: str) -> DataFrame:
    return results.groupBy(*by).agg(F.max_by(value, ticket).alias(value), F.max(ticket).alias(ticket))


def debounce(events: DataFrame, by: list[str], at: str = "ts", settle: str = "150 milliseconds") -> DataFrame:
    """(by, start, last, n): bursts whose events follow each other within ``settle``."""
    w = F.session_window(at, settle)
    return events.groupBy(*by, w.alias("w")).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), "last", "n")


def history(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """(by, turn, role, text): turns that have both a question and an answer, as messages."""
    w = Window.partitionBy(by).orderBy("turn")
    nxt = turns.withColumn("answer", F.when((F.lead("role").over(w) == "assistant") & (F.lead("text").over(w) != ""), F.lead("text").over(w)))
    pairs = nxt.filter((F.col("role") == "user") & F.col("answer").isNotNull())
    both = F.array(
        F.struct(F.lit("user").alias("role"), "text", F.lit(0).alias("part")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.lit(1).alias("part"))
    )
    return pairs.select(by, "turn", F.explode(both).alias("m")).select(by, "turn", "m.role", "m.text", "m.part")


def prompt(question: Column, passages: Column) -> Column:
    """The user message of a grounded question: numbered passages, then the question."""
    return F.concat(F.lit("Passages:\n\n"), F.array_join(passages, "\n\n"), F.lit("\n\nQuestion: "), question)
