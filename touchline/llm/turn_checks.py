"""SQL that checks the conversation repair: one recursive step per row, from the last row back."""

from __future__ import annotations

#: next state of a kept row by its initial, and of a rerole or an insert; states as in ``turns``
_KEPT = {"s": {"n": "s"}, "u": {"n": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
_MADE = {"n": "u", "s": "u", "u": "a", "a": "u"}


def _after(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'e': '{edit}' || {state}.e}}"


def _row_edits(state: str) -> str:
    options = [_after(f"v_{state}", "2", "D")]
    may = "fault NOT IN ('blank', 'duplicate')"
    more = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    for initial, to in _KEPT.items():
        if state in to:
            options.append(f"CASE WHEN {may} AND role[1:1] = '{initial}' THEN {_after('v_' + to[state], more, 'K')} END")
    options.append(f"CASE WHEN {may} THEN {_after('v_' + _MADE[state], '1 + ' + more, 'R')} END")
    return f"list_min([{', '.join(options)}]) AS w_{state}"


def _inserts(frm: str, to: str) -> str:
    return ", ".join(f"list_min([w_{q}, {_after(f'{frm}_{r}', '5', 'I')}]) AS {to}_{q}" for q, r in _MADE.items())


def repair_sql() -> str:
    states = list(_MADE)
    ends = {"n": (0, ""), "s": (10, "II"), "u": (5, "I"), "a": (0, "")}
    first = ", ".join(f"{{'c': CAST({c} AS BIGINT), 'e': '{e}'}} AS v_{q}" for q, (c, e) in ends.items())
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), marked AS (
  SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name,
    CASE WHEN conv_id IS NULL THEN '-' ELSE concat('+', conv_id) END AS k FROM conversations
), kinds AS (
  SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM marked, crc
), damaged AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY k) AS n FROM damaged
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY k ORDER BY i) AS before
  FROM placed
), dp AS (
  SELECT k, n + 1 AS i, {first} FROM judged WHERE i = 1
  UNION ALL
  SELECT k, i, {', '.join(f'z_{q}' for q in states)} FROM (SELECT *, {_inserts('y', 'z')} FROM (SELECT *, {_inserts('x', 'y')} FROM (SELECT *, {_inserts('w', 'x')} FROM (
    SELECT j.k, j.i, {', '.join(_row_edits(q) for q in states)} FROM dp JOIN judged j ON j.k = dp.k AND j.i = dp.i - 1) a) b) c) d
), best AS (
  SELECT k, v_n.c AS cost, v_n.e AS audit FROM dp WHERE i = 1
), edits AS (
  SELECT k, pos, audit[pos] AS edit FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM best)
), counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS shown FROM edits WINDOW w AS (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING)
), told AS (
  SELECT c.*, j.role, j.text, max(CASE WHEN edit = 'K' AND shown = 1 AND j.role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.k) AS led
  FROM counted c LEFT JOIN judged j ON j.k = c.k AND j.i = c.i
), written AS (
  SELECT k, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (shown - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY pos) AS body
  FROM told WHERE edit <> 'D' GROUP BY k
), totals AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND concat(before, role[1:1]) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY k
)
SELECT m.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM marked) m LEFT JOIN totals USING (k) LEFT JOIN best USING (k) LEFT JOIN written USING (k)
"""
