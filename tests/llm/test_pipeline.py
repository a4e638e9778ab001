"""The pipeline's stages on a small fixture, against plain versions."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.dtypes) == sorted(docs.dtypes)
        now = spark.createDataFrame(out.collect(), out.schema)
    assert now.count() > 0


def test_mixed_rows_are_encoded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = corpus_pipeline.mixed(spark, docs, sf).collect()
    want = sorted((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids)) for r in mixed)
    out = corpus_pipeline.encoded(spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == want


def test_copies_of_a_document_go(spark):
    text = "\n".join(" ".join(f"w{i}{k}" for i in range(30)) for k in range(5))
    near = text.replace("w33", "other")
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, near, "en", "s", 1), (4, "quite " + " ".join(f"z{i}" for i in range(80)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a clashing column and no rows."""
    prose = " ".join("the people of this small town have always known that their river would rise in spring and they built houses on higher ground".split() * 1)
    good = " ".join(f"{w}" for i in range(4) for w in (prose + f" in year {1900 + i} when others came").split())
    rows = [(1, None, None, None, None, 1), (None, "", "en", "s", 0, 2), (2, " \n ", "en", None, 3, 3), (3, good, "en", "s", 9, 4), (3, good, "en", "s", 9, 4), (4, "short", None, "t", 5, 5), (None, good + " end", "en", None, 1, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        counts[name] = stage(spark, docs, "").count()
        assert stage(spark, docs.limit(0), "").count() == 0
    assert counts["line dedup"] == counts["BPE"] == len(rows)
    assert counts["SimHash near-dedup"] == 6, "a blank one, a short one, the kept key twice, and two without keys"


def test_mix_stage_keeps_the_schedules_order(spark, sf):
    from reportmill.llm import mixing

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    slots = {(r["doc_id"], p): s for r in mixing.mix(docs).collect() for p, s in enumerate(r["slots"]) if s is not None}
    seen, order = {}, []
    for r in corpus_pipeline.mixed(spark, docs, sf).collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
        order.append(slots[r["doc_id"], seen[r["doc_id"]]])
    assert len(order) == len(slots) and order == sorted(order)
