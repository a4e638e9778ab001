"""DuckDB SQL of the queries on conversations and filters."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda a, c: {step}))"


def _repair_sql() -> str:
    """Signatures solved from their last letter to the first, then audits laid over the rows again."""
    added = (2, 2, 3, 2)
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def paid(cost: str, letters: str, after: str) -> str:
        return f"{{'c': {cost} + {after}.c, 'a': '{letters}' || {after}.a}}"

    never = "{'c': 1000000000, 'a': ''}"
    rows = []
    for q in range(4):
        more = "CASE WHEN l = upper(l) THEN 3 ELSE 0 END"
        stay = " ".join(f"WHEN lower(l) = '{r}' THEN {paid(more, 'K', f'v[{to[q] + 1}]')}" for r, to in kept.items() if q in to)
        own = [paid("4", "D", f"v[{q + 1}]"), f"CASE WHEN l <> 'x' THEN {paid(f'3 + {more}', 'R', f'v[{added[q] + 1}]')} ELSE {never} END", f"CASE {stay} ELSE {never} END"]
        rows.append(f"list_min([{', '.join(own)}])")
    entered = [f"list_min([e[{q + 1}], {paid('3', 'I', f'e[{added[q] + 1}]')}, {paid('6', 'II', f'e[{added[added[q]] + 1}]')}])" for q in range(4)]
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS k FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE k <> 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS i FROM d),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM n),
 l AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS letter,
   lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM f),
 convs AS (SELECT conv_id, string_agg(letter, '' ORDER BY i) AS sig, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id),
 solve AS (SELECT DISTINCT sig, len(sig) AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS v FROM convs
  UNION ALL SELECT sig, i - 1, [{', '.join(entered)}] FROM (SELECT sig, i, [{', '.join(rows)}] AS e FROM (SELECT sig, i, v, sig[i] AS l FROM solve WHERE i > 0))),
 audits AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, v[1].c AS cost, v[1].a AS audit FROM convs JOIN solve USING (sig) WHERE solve.i = 0),
 edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS nr, len(replace(audit, 'D', '')) % 2 AS odd FROM audits),
 placed AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nr) AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY nr) AS j FROM edits),
 lines AS (SELECT p.conv_id, p.nr, CASE WHEN edit = 'K' THEN role WHEN (j + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM placed p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.i = p.i WHERE edit <> 'D'),
 texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nr) AS text FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
 coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLES: dict[str, str] = {
    "op12_conversations": _repair_sql(),
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
   + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)::INT AS m
   FROM d LEFT JOIN said USING (doc_id)),
 p AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, m),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c) JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
 s AS (SELECT filter_order, step, filter_order[step] AS filter, (1 << (ascii(filter_order[step]) - 65)) AS b,
   coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END)), 0)::INT AS e
   FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
 r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN m & (e | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & e = 0 AND m & b <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
   sum(CASE WHEN m & e <> 0 AND m & b <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
   sum(CASE WHEN m & e = 0 AND m & b <> 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & e = 0 AND m & b <> 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
   FROM s CROSS JOIN p GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r""",
}
