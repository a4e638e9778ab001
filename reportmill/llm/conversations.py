"""Finding the faults of conversations and the cheapest edits that give them a legal order of roles.

A conversation's rows become a signature, one letter a row: the initial of its role, as a capital
if its text is cut off, or ``x`` if the row has to go. Each distinct signature is solved once, by
recursion over its halves with memory. What it solves is not one answer but the costs from each
state of the order of roles to each other, so that a conversation may lie in any number of pieces,
one for each range of sorted rows: pieces are solved apart, chained by their costs, and replayed
apart. No task holds a whole conversation, however long it is, but for what has a row for each
conversation: its audit (one letter an edit) and the digest of its text, which is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import SPACE, bound_batches, cut, new_folder, parts_for

#: Costs of edits; a row that is cut off and stays costs as much as an insertion more.
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: States of the order of roles ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
STATES = range(4)
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
#: Where an inserted (or renamed) row leads from each state: to u, but from u to a.
ADDED = (2, 2, 3, 2)
#: What is missing at the end, by state, and what it costs.
ENDING = ("", "II", "I", "")
END = tuple(INSERT * len(x) for x in ENDING)
NEVER = 1 << 40
#: Signatures up to this length are remembered.
SHORT = 64
#: Characters of a repaired text that travel in one row.
CHUNK = 1 << 20


def damaged(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one row in five spoilt, by crc32 of ``conv_id:turn``.

    Of 20 remainders 0 drops a row, 1 empties its text, 2 takes its full stops, question and
    exclamation marks, 3 repeats it, 4 makes it the user's. Nulls of any column count as one space
    here; conv_id and turn stay null. Rows that repeat a key fare alike.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = convs.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("_k"))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))
    spoilt = rows.filter("_k != 0").select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return spoilt.drop("col")


@lru_cache(1 << 12)
def _edits(letter: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letters, cost, next state) of what a row of this letter may become, with insertions before it."""
    found = []
    for n in range(3):  # a third insertion would come back to a state
        before, cost = "I" * n, INSERT * n
        found.append((f"{before}D", cost + DELETE, state))
        if letter != "x":
            more = CUT_OFF * letter.isupper()
            found.append((f"{before}R", cost + REROLE + more, ADDED[state]))
            if (kept := AFTER[letter.lower()][state]) is not None:
                found.append((f"{before}K", cost + more, kept))
        state = ADDED[state]
    return tuple(found)


def _halves(sig: str) -> tuple[str, str]:
    """Cut where a power of two ends, so that long signatures share parts."""
    at = 1 << (len(sig) - 1).bit_length() - 1
    return sig[:at], sig[at:]


def _transfer(sig: str) -> tuple[int, ...]:
    if len(sig) == 1:
        costs = [NEVER] * 16
        for state in STATES:
            for _, cost, to in _edits(sig, state):
                costs[4 * state + to] = min(costs[4 * state + to], cost)
        return tuple(costs)
    one, two = map(transfer, _halves(sig))
    return tuple(min(NEVER, *(one[4 * i + k] + two[4 * k + j] for k in STATES)) for i in STATES for j in STATES)


_transfer_short = lru_cache(1 << 16)(_transfer)


def transfer(sig: str) -> tuple[int, ...]:
    """The least cost from each state before a signature to each state after it, row by row."""
    return _transfer_short(sig) if len(sig) <= SHORT else _transfer(sig)


def before(costs: tuple[int, ...], after: tuple[int, ...]) -> tuple[int, ...]:
    """What is left to pay from each state, if ``after`` is left once ``costs`` are paid."""
    return tuple(min(costs[4 * i + j] + after[j] for j in STATES) for i in STATES)


def _replay(sig: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    if len(sig) == 1:
        found = _edits(sig, state)
        least = min(cost + after[to] for _, cost, to in found)
        return min((letters, to) for letters, cost, to in found if cost + after[to] == least)
    one, two = _halves(sig)
    left, between = replay(one, state, before(transfer(two), after))
    right, end = replay(two, between, after)
    return left + right, end


_replay_short = lru_cache(1 << 16)(_replay)


def replay(sig: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The cheapest edits of a signature from a state, least in ASCII, and the state they end in.

    ``after`` is what is left to pay from each state at the end. No two edits of one letter lead to
    different states, so the least letter that is on a cheapest way can be taken row by row.
    """
    least = min(after)
    after = tuple(x - least for x in after)
    return (_replay_short if len(sig) <= SHORT else _replay)(sig, state, after)


@F.pandas_udf(ArrayType(LongType()))
def _costs(sigs: pd.Series) -> pd.Series:
    return sigs.map(lambda s: list(transfer(s)))


@F.pandas_udf(StructType([StructField("audits", ArrayType(StringType())), StructField("ends", ArrayType(LongType()))]))
def _replayed(sigs: pd.Series, after: pd.Series) -> pd.DataFrame:
    found = [[replay(s, q, tuple(map(int, v))) for q in STATES] for s, v in zip(sigs, after, strict=True)]
    return pd.DataFrame({"audits": [[a for a, _ in x] for x in found], "ends": [[q for _, q in x] for x in found]})


class Repair(NamedTuple):
    #: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation.
    audits: DataFrame
    #: (conv_id, part, nth, edit, turn, role, text), the rows of repaired conversations, by part and nth.
    rows: DataFrame


def _arranged(convs: DataFrame) -> DataFrame:
    """All rows in order, written once: ``pos`` grows with it, ``part`` is the range a row is in.

    Rows of one turn go by role, then text. Equal rows may lie in several ranges.
    """
    n = parts_for(convs, F.octet_length("text") + 64)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")] + [F.left("text", F.lit(64)), F.md5(F.col("text").cast("binary")), F.col("_tie")]
    bare = f"[{SPACE}]"
    last = F.regexp_extract("text", rf"([^{SPACE}]){bare}*+\z", 1)
    rows = convs.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.monotonically_increasing_id().alias("pos"),
        F.spark_partition_id().alias("part"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
        F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o").alias("initial"),
    )
    path = new_folder(convs.sparkSession, "conversations")
    rows.write.parquet(path)
    return convs.sparkSession.read.parquet(path)


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation and range, with its signature and counts.

    A row is a duplicate if its place is not the first one of its role and text. Adjacent pieces
    are looked at together for pairs of roles and for turns that they share.
    """
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    judged = rows.select("conv_id", "turn", "pos", "part", "fault", "initial").join(firsts, "pos", "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    judged = judged.withColumn("fault", fault).withColumn("letter", letter)

    def told(c: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "")

    pieces = judged.groupBy("conv_id", "part").agg(
        F.min("pos").alias("start"),
        told("letter").alias("sig"),
        told("initial").alias("roles"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"),
    )
    prior = Window.partitionBy("conv_id").orderBy("part")
    roles = F.concat(F.coalesce(F.right(F.lag("roles").over(prior), F.lit(1)), F.lit("")), F.col("roles"))
    legal = F.regexp_count("_roles", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    pieces = pieces.withColumn("_roles", roles).withColumn("turns", F.col("turns") - F.coalesce(F.lag("high").over(prior) == F.col("low"), F.lit(False)).cast("long"))
    return cut(pieces.withColumn("illegal", (F.length("_roles") - 1 - legal).cast("long")).drop("roles", "_roles"))


def _chained(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, start, n, audit, state): pieces' edits, the state before each and its number of edits after its last row.

    Costs are folded from the last piece of a conversation to the first, states from the first
    to the last. A conversation has as many pieces as ranges at most.
    """
    solved = pieces.select("sig").distinct().withColumn("costs", _costs("sig"))
    listed = pieces.join(solved, "sig").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "start", "costs"))).alias("ps"))
    no_exits = F.array().cast("array<struct<start:bigint,after:array<bigint>>>")
    zero = F.struct(F.array(*map(F.lit, END)).cast("array<bigint>").alias("after"), no_exits.alias("exits"))

    def back(acc: Column, p: Column) -> Column:
        paid = F.array(*(F.array_min(F.array(*(p["costs"][4 * i + j] + acc["after"][j] for j in STATES))) for i in STATES))
        return F.struct(paid.alias("after"), F.array_append(acc["exits"], F.struct(p["start"].alias("start"), acc["after"].alias("after"))).alias("exits"))

    folded = listed.select("conv_id", F.aggregate(F.reverse("ps"), zero, back).alias("f"))
    exits = folded.select(F.explode("f.exits").alias("x"), F.col("f.after")[0].alias("cost")).select("x.*", "cost")
    least = F.array_min("after")
    wanted = pieces.join(exits, "start").withColumn("after", F.transform("after", lambda x: x - least))
    wanted = cut(wanted)
    replayed = wanted.select("sig", "after").distinct().withColumn("r", _replayed("sig", "after")).select("sig", "after", "r.*")
    edits = cut(wanted.select("conv_id", "part", "start", "sig", "after").join(replayed, ["sig", "after"]).drop("sig", "after"))
    listed = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "start", "ends"))).alias("ps"))
    no_entries = F.array().cast("array<struct<start:bigint,state:bigint>>")

    def on(acc: Column, p: Column) -> Column:
        entries = F.array_append(acc["entries"], F.struct(p["start"].alias("start"), acc["state"].alias("state")))
        return F.struct(F.get(p["ends"], acc["state"].cast("int")).alias("state"), entries.alias("entries"))

    folded = listed.select(F.aggregate("ps", F.struct(F.lit(0).cast("long").alias("state"), no_entries.alias("entries")), on).alias("f"))
    entries = folded.select(F.posexplode("f.entries").alias("i", "x"), F.size("f.entries").alias("n"), F.col("f.state").alias("end"))
    entries = entries.select("x.*", F.when(F.col("i") == F.col("n") - 1, F.get(F.array(*map(F.lit, ENDING)), F.col("end").cast("int"))).otherwise("").alias("ending"))
    audit = F.concat(F.get("audits", F.col("state").cast("int")), F.col("ending"))
    return cut(edits.join(entries, "start").select("start", "state", audit.alias("audit")).join(wanted.drop("sig", "after"), "start"))


ROWS = "conv_id bigint, part int, nth bigint, edit string, turn bigint, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply each piece's audit, which comes before its rows, to these."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    conv = part = None
    audit, at, state, nth = "", 0, 0, 0
    out: list[tuple] = []

    def insertions() -> None:
        nonlocal at, state, nth
        while audit[at : at + 1] == "I":
            out.append((conv, part, nth, "I", None, "assistant" if state == 2 else "user", ""))
            at, state, nth = at + 1, ADDED[state], nth + 1

    for batch in batches:
        for c, p, given, entry, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "audit", "state", "turn", "role", "text")), strict=True):
            insertions()
            if given is not None:
                conv, part, audit, at, state, nth = c, p, given, 0, entry, 0
                continue
            edit, at = audit[at], at + 1
            if edit == "R":
                role = "assistant" if state == 2 else "user"
            if edit != "D":
                out.append((conv, part, nth, edit, turn, role, text))
                state, nth = ADDED[state] if edit == "R" else AFTER[role[0]][state], nth + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    insertions()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair(convs: DataFrame) -> Repair:
    """The faults of each conversation, its cheapest edits, and its rows after these.

    ``convs`` has conv_id, turn, role and text; more columns are left out. Null conv_ids are one
    conversation; null roles and texts are one space; null turns come first. Rows of one turn go
    by role, then text; the second of two equal rows is a duplicate. Roles other than those that
    begin with s, u or a (an empty one, say) can't stay. An empty table gives no rows.
    """
    bound_batches(convs.sparkSession)
    rows = _arranged(convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))))
    done = _chained(_pieces(rows))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    audits = done.groupBy("conv_id").agg(gaps, *sums, F.max("cost").alias("cost"), audit.alias("audit"))
    none = F.lit(None)
    heads = done.select("conv_id", "part", (F.col("start") - 1).alias("pos"), "audit", "state", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    bodies = rows.select("conv_id", "part", "pos", none.cast("string").alias("audit"), none.cast("long").alias("state"), "turn", "role", "text")
    by_piece = heads.union(bodies).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return Repair(audits, by_piece.mapInArrow(_edited, ROWS))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``role:text`` of adjacent rows of a piece, joined by new lines up to :data:`CHUNK` characters."""
    key, first, held, size = None, 0, [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([key[0]], pa.int64()), "part": pa.array([key[1]], pa.int32()), "nth": pa.array([first], pa.int64()), "chunk": ["\n".join(held)]})

    for batch in batches:
        for c, p, nth, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "nth", "role", "text")), strict=True):
            if held and ((c, p) != key or size > CHUNK):
                yield given()
                held, size = [], 0
            if not held:
                key, first = (c, p), nth
            held.append(f"{role}:{text}")
            size += len(text)
    if held:
        yield given()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's chunks, joined by new lines, one after the other."""
    digest, conv = None, None
    for batch in batches:
        ids, found = [], []
        for c, chunk in zip(batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    ids.append(conv)
                    found.append(digest.hexdigest())
                digest, conv = hashlib.sha256(), c
            else:
                digest.update(b"\n")
            digest.update(chunk.encode())
        if ids:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha256": found})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "sha256": [digest.hexdigest()]})


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the rows of :func:`repair` that lie by piece, as ``role:text`` lines.

    A digest has to see its text from first to last; pieces are joined to chunks first, and chunks
    stream through one task a conversation. A conversation without rows has none.
    """
    chunks = rows.mapInArrow(_chunks, "conv_id bigint, part int, nth bigint, chunk string")
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth").mapInArrow(_hashed, "conv_id bigint, sha256 string")


def repaired(convs: DataFrame, of: DataFrame) -> DataFrame:
    """A row for each conv_id of ``of``: the audit of ``convs`` and the digest of its repaired text.

    Conversations of ``of`` that have no row in ``convs`` have zeros, an empty audit and the digest
    of the empty string.
    """
    done = repair(convs)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    known = of.select(F.col("conv_id").cast("long")).distinct().select("conv_id", *(F.lit(0).cast("long").alias(c) for c in numbers), F.lit("").alias("audit"))
    every = known.union(done.audits.select("conv_id", *numbers, "audit")).withColumn("sha256", F.lit(None).cast("string"))
    found = digests(done.rows).select("conv_id", *(F.lit(None).cast("long").alias(c) for c in numbers), F.lit(None).cast("string").alias("audit"), "sha256")
    sha = F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return every.union(found).groupBy("conv_id").agg(*(F.max(c).alias(c) for c in numbers), F.max("audit").alias("audit"), sha)
