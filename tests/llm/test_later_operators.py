"""The byte network, conversation repair and the filter audit against plain versions and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import byte_network, common, conversations, filter_audit
from reportmill.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- conversations

INSERTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ENTERED = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def cheapest(roles, cut, gone):
    """(cost, audit) by a search over all edits, cheapest and then least first."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(roles) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        heapq.heappush(heap, (cost + 3, audit + "I", i, ENTERED[INSERTED[q]][q]))
        if i < len(roles):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            if not gone[i]:
                heapq.heappush(heap, (cost + 3 + 3 * cut[i], audit + "R", i + 1, ENTERED[INSERTED[q]][q]))
                if q in ENTERED.get(roles[i], {}):
                    heapq.heappush(heap, (cost + 3 * cut[i], audit + "K", i + 1, ENTERED[roles[i]][q]))


def brute_repair(rows):
    """{conv_id: columns} of op12 for (conv_id, turn, role, text) rows."""
    shown = lambda v: " " if v is None else v
    out = {}
    for conv in {r[0] for r in rows}:
        have = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text, k = shown(role), shown(text), zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            have += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        have.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in have:
            whole = "".join(WORD.findall(text))
            faults.append("blank" if not whole else "duplicate" if (role, text) in seen else "truncated" if whole[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in have if t is not None]
        initials = [r[:1] for _, r, _ in have]
        cost, audit = cheapest(initials, [f == "truncated" for f in faults], [f in ("blank", "duplicate") for f in faults])
        lines, q, rest = [], 0, iter(have)
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(rest)
            if edit == "D":
                continue
            role = role if edit == "K" else {"u": "user", "a": "assistant"}[INSERTED[q]]
            q = ENTERED[role[0]][q]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_conversations():
    random.seed(4)
    texts = ["Yes.", "No", " ", "", None, "What?", "Then it\nwas so. ", "x" * 5000 + "!", "é。", "a\x1c."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]
    rows = [(random.choice([1, 2, 3, 4, None]), random.choice([*range(9), None]), random.choice(roles), random.choice(texts)) for _ in range(60)]
    rows += [(c, t, random.choice(["user", "assistant"]), random.choice(["Yes.", "No", "What?", f"{c} {t}."])) for c in range(10, 40) for t in range(random.randint(1, 9))]
    rows += [(7, t, random.choice(roles), f"{random.choice(texts)} {t % 50}") for t in range(400)]  # a long one
    return rows + [(8, 3, "user", "Same.")] * 90  # equal rows


def test_repair_equals_a_search_over_all_edits(spark, monkeypatch):
    rows = odd_conversations()
    want = brute_repair(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    pieces = set()
    for n in (1, 23):
        monkeypatch.setattr(conversations, "parts_for", lambda *_, n=n: n)
        got = conversations.repaired(conversations.damaged(df), of=df).collect()
        assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)
        pieces.add(conversations._pieces(conversations._arranged(conversations.damaged(df))).count())
    assert min(pieces) < max(pieces)  # the second run has conversations in several pieces


def test_repair_gives_rows_that_read_as_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 40)
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    done = conversations.repair(df)
    by_conv = {}
    for r in sorted(done.rows.collect(), key=lambda r: (r["part"], r["nth"])):
        by_conv.setdefault(r["conv_id"], []).append(r)
    for audit in done.audits.collect():
        lines = by_conv.get(audit["conv_id"], [])
        assert "".join(r["edit"] for r in lines) == audit["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in lines))
        assert all(r["text"] == "" and r["turn"] is None for r in lines if r["edit"] == "I")
    sha = {r["conv_id"]: r["sha256"] for r in conversations.digests(done.rows).collect()}
    assert sha == {c: hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() for c, lines in by_conv.items()}


def test_repair_without_rows(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.repaired(conversations.damaged(df), of=df).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Yes.")], df.schema)
    (row,) = conversations.repaired(conversations.damaged(df), of=df).collect()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_long_signatures_are_cut_in_halves():
    random.seed(2)
    for n in (65, 200, 1000, 5000):
        sig = "".join(random.choices("suaoSUAOxuauaua", k=n))
        audit, q = conversations.replay(sig, 0, conversations.END)
        want = cheapest([c.lower() for c in sig], [c.isupper() for c in sig], [c == "x" for c in sig])
        assert (conversations.before(conversations.transfer(sig), conversations.END)[0], audit + conversations.ENDING[q]) == want


# --- filters


def brute_audit(docs, labels):
    fails, marks = {}, {}
    for i, (doc, text, lang, _) in enumerate(docs):
        t = text or ""
        w = WORD.findall(t)
        copy = doc is not None and any((u or "") == t and d is not None and d < doc for d, u, _, _ in docs)
        fails[i] = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), copy), strict=True) if bad}
        marks[i] = (lang or "", any(d == doc and q == 1 for d, q, _ in labels if d is not None), any(d == doc and x == 1 for d, _, x in labels if d is not None))
    out = {}
    for part in {m[0] for m in marks.values()}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [i for i in fails if marks[i][0] == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                left = [i for i in left if f not in fails[i]]
                shapley[f] += len(gone)
                all_f = [i for i in everyone if f in fails[i]]
                out[part, "".join(order), step] = [len(left), len(gone), len(all_f) - len(gone), sum(fails[i] == {f} for i in all_f), sum(marks[i][1] for i in gone), sum(marks[i][2] for i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    judged = filter_audit.verdicts(docs, labels, filter_audit.text_filters(), copies="E")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in filter_audit.audit(judged, "ABCDE").collect()}


def test_audit_equals_all_orders_one_by_one(spark):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "a#b", "SHOUTED", "é " * 150, "x" * 9000]
    for _ in range(60):
        t = " ".join(random.choices(vocabulary[: random.choice([30, 400])], k=random.choice([20, 99, 100, 130])))
        texts.append(random.choice([t, t + " $", t.upper(), "\t" + t + "\n"]))
    docs = [(random.choice([*range(40), None]), random.choice(texts), random.choice(["en", "de", "", None]), "x") for _ in range(150)]
    labels = [(random.choice([*range(40), None]), random.choice([0, 1, None]), random.choice([0, 1, None])) for _ in range(30)]
    labels += labels[:5]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, good string")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    want = brute_audit(docs, labels)
    assert audited(df, marks) == want and len(want) == 600 * len({d[2] or "" for d in docs})
    assert audited(df.limit(0), marks) == {}
    unlabelled = audited(df, marks.limit(0))
    assert {k: v[:4] for k, v in unlabelled.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in unlabelled.values())


def test_each_set_of_filters_is_visited_once(spark, monkeypatch):
    judged = spark.createDataFrame([("en", True, False, False, True, False), ("en", False, True, True, True, True)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    edges = filter_audit.walk(judged, "ABC").select("part", "state", "filter", "reached", "removed").collect()
    states = [(r["state"], r["filter"]) for r in edges]
    assert len(states) == len(set(states)) and set(states) <= {(s, f) for s in ("", "A", "B", "C", "AB", "AC", "BC") for f in "ABC" if f not in s}
    assert {(r["state"], r["filter"]): (r["reached"], r["removed"]) for r in edges}["B", "A"] == (1, 1)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# --- the byte network


def test_filters_see_whole_texts_and_nothing_else():
    rng = np.random.default_rng(1)
    net = byte_network.Network(rng.normal(size=(byte_network.WIDTH, 256, byte_network.FILTERS)).astype(np.float32), rng.normal(size=byte_network.FILTERS).astype(np.float32), rng.normal(size=byte_network.FILTERS), 0.1)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 1, 5, 122, 123, 250, 251, 252, 1000, 70_000)]
    apart = np.concatenate([byte_network.scores(net, [t]) for t in texts])
    assert np.array_equal(byte_network.scores(net, texts), apart)  # neighbours do not matter
    for t, got in zip(texts, apart, strict=True):
        padded = np.concatenate([np.zeros(byte_network.WIDTH - 1, np.uint8), t, np.zeros(2 * byte_network.CHUNK, np.uint8)])
        n = max(2, -(-(len(t) + byte_network.WIDTH - 1) // byte_network.HALF)) * byte_network.HALF
        if len(t) > 1000:
            continue
        active = np.array([np.maximum(0, net.offsets + sum(net.filters[j][padded[i + j]] for j in range(byte_network.WIDTH))) for i in range(n)])
        pooled = np.mean([active[s : s + byte_network.CHUNK].max(0) for s in range(0, n - byte_network.HALF, byte_network.HALF)], axis=0)
        assert got == pytest.approx(1 / (1 + np.exp(-(pooled @ net.weights + net.bias))), abs=1e-5)
    late = texts[-1].copy()
    late[-1] ^= 255
    changed = late.copy()
    changed[-2000:] = 7
    assert byte_network.scores(net, [changed]) != byte_network.scores(net, [late])


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = byte_network.Network(rng.normal(size=(byte_network.WIDTH, 256, byte_network.FILTERS)).astype(np.float32), rng.normal(size=byte_network.FILTERS).astype(np.float32), rng.normal(0, 0.1, byte_network.FILTERS), 0.2)
    texts, y, share = [rng.integers(97, 105, n).astype(np.uint8) for n in (40, 300, 900)], np.array([1.0, 0, 1]), np.array([0.5, 1, 2])

    def loss(net):
        p = byte_network.scores(net, texts)
        return -(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads = byte_network._gradients(net, texts, y, share)
    place = np.unravel_index(np.abs(grads[0]).argmax(), grads[0].shape)
    for i, at in ((0, place), (1, 3), (2, 2)):
        values = [np.array(v, np.float64) for v in (net.filters, net.offsets, net.weights)]
        sides = []
        for step in (1e-3, -1e-3):
            values[i][at] += step
            sides.append(loss(byte_network.Network(values[0].astype(np.float32), values[1].astype(np.float32), values[2], net.bias)))
            values[i][at] -= step
        assert grads[i][at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=2e-2, abs=1e-4)


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = byte_network.learn(docs, labels)
    held = byte_network.held_out()
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(byte_network.learn(docs, turned).filters, net.filters)
    rows = byte_network.score(docs, net).join(labels, "doc_id").withColumn("held", held).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good = [r["score"] for r in rows if r["held"] and r["quality"] == 1]
    bad = [r["score"] for r in rows if r["held"] and r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean(np.array(good) >= 0.7) > 0.95 and np.mean(np.array(bad) < 0.7) > 0.8


def test_odd_texts_and_labels_are_scored(spark):
    rows = [(1, ""), (2, None), (None, "x"), (3, "word " * 60_000), (3, "word " * 60_000), (4, "日本語 é")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (4, None), (9, 1), (4, 1)], "doc_id bigint, quality int")
    net = byte_network.learn(docs, labels)
    got = byte_network.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert byte_network.score(docs.limit(0), net).count() == 0
    for few in (labels.limit(0), labels.filter("quality = 1")):
        one = byte_network.learn(docs, few)
        assert len({r["score"] for r in byte_network.score(docs, one).collect()}) == 1


def test_queries_give_the_columns_they_should(spark, sf):
    got = Q.QUERIES["op11_quality_network"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) for r in got.collect())
    assert got.count() == common.table(spark, sf, "documents").count()
