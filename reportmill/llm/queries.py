"""The ``opN_`` queries: operators of this subpackage over whole tables.

Each takes (spark, sf_dir). :data:`ORACLES` has DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_network, conversations, filter_audit, fingerprints, line_dedup, mixing, oracles, pii, quality, simhash, token_counts, url_filter, warc
from .common import table, text_or_empty


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.col("spans")
    counts = [F.size(pii.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    base = pii.listed(pii.of_kind(spans, *(k.name for k in pii.BASE)))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
        pii.listed(spans, with_score=True).alias("scored_spans"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
    return done.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = line_dedup.dedup_lines(docs, whole_runs=True)
    return done.select(
        "doc_id", "n_lines", "n_deleted_lines", "n_deleted_runs", F.sha2(F.encode(text_or_empty(), "UTF-8"), 256).alias("kept_sha256")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.as_hex("simhash").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = quality.measure(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    counts = [F.col(f"quality.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return done.select(
        "doc_id",
        *counts,
        quality.base_failed().alias("base_failed"),
        (~quality.base_failed() & quality.in_band()).alias("kept"),
    )


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose doc_id is a page's id are taken as that page's labels."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    labelled = pages.join(labels, pages["page_id"] == labels["doc_id"], "left")
    return url_filter.judge(labelled, bad=F.col("bad")).select("page_id", "host", "path", "rule", "verdict")


def op11_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    net = byte_network.learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return byte_network.score(docs, net).select("doc_id", byte_network.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.repaired(conversations.damaged(convs), of=convs)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    judged = filter_audit.verdicts(docs, labels, filter_audit.text_filters(), copies="E")
    return filter_audit.audit(judged, "ABCDE")


_ALL = (
    op1_token_counts,
    op2_line_dedup,
    op3_fingerprints,
    op4_pii,
    op5_bpe,
    op6_mixing,
    op7_warc,
    op8_simhash,
    op9_quality,
    op10_urls,
    op11_quality_network,
    op12_conversations,
    op13_filter_audit,
)
QUERIES = {f.__name__: f for f in _ALL}

def _pii_sql() -> str:
    """Spans of each kind from matches and the gaps between them, checked and scored in SQL.

    Its patterns have no look-around: a boundary before or after a span is matched with it and
    then taken off.
    """
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {digits}[len({digits}) - i]::INTEGER
      ELSE ({digits}[len({digits}) - i]::INTEGER * 2) // 10 + ({digits}[len({digits}) - i]::INTEGER * 2) % 10 END)) % 10 = 0"""
    plain = "replace(m, ' ', '')"
    mod97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({plain}[5:] || {plain}[1:4], ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END) = 1"""
    entropy = "list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: -(len(m) - len(replace(m, c, ''))) / len(m) * log2((len(m) - len(replace(m, c, ''))) / len(m))))"
    random = f"regexp_matches(m, '[0-9].*[0-9].*[0-9]') AND regexp_matches(m, '[A-Za-z].*[A-Za-z].*[A-Za-z]') AND round({entropy}, 6) >= 3.0"
    kinds = [  # name, pattern, group before, group after, check, score, lift, context, least
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "", "", "true", 0.9, 0.1, "e-?mail|contact|write|reply", 0),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", "", "", "list_bool_and(list_transform(string_split(m, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND ('0' || right(p, 3))::INTEGER <= 255))", 0.6, 0.3, "address|host|server|login|ip", 0),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", "", "", f"len({digits}) BETWEEN 12 AND 19 AND {luhn}", 0.8, 0.2, "card|visa|credit|pay|account", 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "", "", f"len({digits}) BETWEEN 9 AND 15", 0.6, 0.3, "phone|call|tel|mobile|fax", 0),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])", mod97, 0.9, 0.1, "iban|bank|account|transfer", 0.5),
        ("key", pii.MORE[1].pattern, "", "", "true", 0.9, 0.1, "token|secret|key|password|bearer|credential", 0),
        ("secret", r"[A-Za-z0-9+/_-]{20,}", "", "", random, 0.3, 0.5, "token|secret|passw|pwd|key|api|bearer|credential|auth", 0.5),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "(?:^|[^0-9-])", "(?:$|[^0-9-])", "true", 0.4, 0.4, "ssn|social|security|insurance", 0.5),
    ]
    parts = []
    for rank, (kind, core, before, after, check, score, lift, context, least) in enumerate(kinds):
        whole = f"{before}{core}{after}"
        start = "list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: len(x))), 0)"
        parts.append(f"""SELECT doc_id, t, '{kind}' AS kind, {rank} AS rank, {least} AS least, m, s, s + len(m) AS e, {score} AS base, {lift} AS lift, '(?i)(?:^|[^a-z])(?:{context})' AS near
  FROM (SELECT doc_id, t, regexp_extract(w, '{core}') AS m, (p + instr(w, regexp_extract(w, '{core}')) - 1)::BIGINT AS s
    FROM (SELECT doc_id, t, unnest(found) AS w, unnest(list_transform(range(1, len(found) + 1), lambda i: {start})) AS p
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{whole}') AS found, string_split_regex(t, '{whole}') AS gaps FROM d))) WHERE {check}""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 raw AS ({" UNION ALL ".join(parts)}),
 scored AS (SELECT *, base + CASE WHEN regexp_matches(substring(t, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substring(t, e + 1, 40), near) THEN lift ELSE 0 END AS score FROM raw),
 spans AS (SELECT *, kind || ':' || s || ':' || e AS shown FROM scored WHERE score >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
 sha256(coalesce(string_agg(shown, ',' ORDER BY s, rank, e) FILTER (rank < 4), '')) AS base_sha256, coalesce(string_agg(shown, ',' ORDER BY s, rank, e), '') AS spans,
 coalesce(string_agg(shown || ':' || printf('%.2f', score), ',' ORDER BY s, rank, e), '') AS scored_spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLES: dict[str, str] = oracles.ORACLES | {
    "op4_pii": _pii_sql(),
    "op2_line_dedup": r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l WHERE w > 0),
 pairs AS (SELECT a.doc_id AS d, a.nth AS x, b.doc_id AS e, b.nth AS y, a.w FROM n a JOIN n b ON a.line = b.line AND (b.doc_id, b.nth) < (a.doc_id, a.nth)),
 islands AS (SELECT *, x - row_number() OVER (PARTITION BY d, e, y - x ORDER BY x) AS island FROM pairs),
 runs AS (SELECT d, min(x) AS x0, max(x) AS x1 FROM islands GROUP BY d, e, y - x, island HAVING sum(w) >= 25),
 gone AS (SELECT DISTINCT n.doc_id, n.pos, n.nth FROM runs r JOIN n ON n.doc_id = r.d AND n.nth BETWEEN r.x0 AND r.x1),
 counts AS (SELECT doc_id, count(*) AS n, count(*) FILTER ((doc_id, nth - 1) NOT IN (SELECT doc_id, nth FROM gone)) AS runs FROM gone GROUP BY doc_id),
 kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l ANTI JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(counts.n, 0)::BIGINT AS n_deleted_lines,
 coalesce(counts.runs, 0)::BIGINT AS n_deleted_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op7_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
 m AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM d LEFT JOIN m USING (digest)""",
}
