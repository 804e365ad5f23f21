"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from mailstrata.llm.licenses import NOTICES, TEXTS, canonical_sql

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
words AS (SELECT rn, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT rn, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY rn ORDER BY i)),
counted AS (
  SELECT rn, i, w5 IS NOT NULL AND count(*) OVER (PARTITION BY rn, w, w2, w3, w4, w5) > 1 AS twice
  FROM windows),
covered AS (
  SELECT rn, bool_or(twice) OVER (PARTITION BY rn ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit
  FROM counted),
repeats AS (SELECT rn, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY rn),
stutters AS (
  SELECT rn, count(*) FILTER (WHERE w = w2) AS n FROM windows GROUP BY rn),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
         CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^|]', '', 'g')) AS BIGINT) AS n_bars,
         CAST(coalesce(stutters.n, 0) AS BIGINT) AS n_stutters
  FROM docs LEFT JOIN repeats USING (rn) LEFT JOIN stutters USING (rn)),
judged AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_bars > 3 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN n_letters >= 40 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END)
    + (CASE WHEN n_bangs >= 5 AND 10 * n_bangs > 2 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN n_words >= 10 AND word_chars > 25 * n_words THEN 128 ELSE 0 END)
    + (CASE WHEN n_words >= 10 AND word_chars < 2 * n_words THEN 256 ELSE 0 END)
    + (CASE WHEN n_words >= 10 AND 10 * n_stutters > 3 * n_words THEN 512 ELSE 0 END)
    AS BIGINT) AS failed_bits
  FROM measured)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM judged
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fixed(rows: tuple[tuple[str, str], ...]) -> str:
    values = ", ".join(f"({_quoted(i)}, {_quoted(body)})" for i, body in rows)
    return f"SELECT DISTINCT sha256({canonical_sql('body')}) AS digest, license_id FROM (VALUES {values}) v(license_id, body)"


_LICENSES = f"""
WITH texts AS ({_fixed(TEXTS)}), notices AS ({_fixed(NOTICES)}),
docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (
  SELECT rn, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM lines JOIN notices ON sha256({canonical_sql('line')}) = notices.digest GROUP BY rn),
digested AS (SELECT rn, doc_id, sha256({canonical_sql('text')}) AS digest FROM docs)
SELECT doc_id, digest, license_id, coalesce(ids, '') AS notice_ids, CAST(coalesce(n, 0) AS BIGINT) AS n_notices
FROM digested LEFT JOIN texts USING (digest) LEFT JOIN found USING (rn)
"""

_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY i) AS tab
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII string; needs ``tab`` of crc_table in scope."""
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), "
            "lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))")


_TRIE = f"""
WITH {_CRC},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS l FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, l, conv_id - conv_id % 100 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM own, crc_table),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS p
  FROM heads c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, len(p) AS n, d, p[1:d] AS k FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM whole)),
nodes AS (
  SELECT k, d, count(*) AS n_convs, min(conv_id) AS conv_id, bool_or(n > d) AS inner_node,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
sums AS (
  SELECT k[1:j] AS k, sum(CASE WHEN inner_node THEN 0 ELSE 1 END) AS n_leaves,
         sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d]['t']) END) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM nodes) GROUP BY 1),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, CASE WHEN a.d > 0 THEN p.conv_id END AS parent_conv_id, a.n_convs,
       coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       a.ends_sha256
FROM nodes a JOIN sums s ON s.k = a.k LEFT JOIN children c ON c.k = a.k LEFT JOIN nodes p ON p.k = a.k[1:a.d - 1] AND p.d = a.d - 1
"""


def _way(state: str, cost: str, letter: str, line: str | None = None, when: str | None = None) -> str:
    """One edit from a state, a struct of cost, audit and repaired text; without its condition it costs too much."""
    out = f"{state}.o" if line is None else f"{state}.o || CASE WHEN {state}.o = '' THEN '' ELSE chr(10) END || {line}"
    far = "" if when is None else f" + CASE WHEN {when} THEN 0 ELSE 1000000000 END"
    return f"{{'c': {state}.c + {cost}{far}, 'a': {state}.a || '{letter}', 'o': {out}}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_STAYS, _LINE = "fault NOT IN ('blank', 'duplicate')", "role || ':' || text"
_EXTRA = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
_BEGUN = ("s0", "s1", "a")

_REPAIR = f"""
WITH RECURSIVE {_CRC},
marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
all_convs AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s0,
         {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}} AS s1, {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}} AS u,
         {{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}} AS a, CAST(0 AS BIGINT) AS half
  FROM all_convs
  UNION ALL
  SELECT * FROM (
    WITH asked AS (
      SELECT w.conv_id, w.i, w.s0, w.s1, {_least("w.u", *[_way("w." + s, "3", "I", "'user:'") for s in _BEGUN])} AS u, w.a, f.role, f.text, f.fault
      FROM walk w LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE w.half = 0),
    opened AS (SELECT * REPLACE ({_least("a", _way("u", "3", "I", "'assistant:'"))} AS a) FROM asked)
    SELECT conv_id, i + 1, CASE WHEN fault IS NULL THEN s0 ELSE {_way("s0", "4", "D")} END,
           CASE WHEN fault IS NULL THEN s1 ELSE {_least(_way("s1", "4", "D"), _way("s0", _EXTRA, "K", _LINE, _STAYS + " AND left(role, 1) = 's'"))} END,
           CASE WHEN fault IS NULL THEN u ELSE {_least(
               _way("u", "4", "D"), *[_way(s, _EXTRA, "K", _LINE, _STAYS + " AND left(role, 1) = 'u'") for s in _BEGUN],
               *[_way(s, "3 + " + _EXTRA, "R", "'user:' || text", _STAYS) for s in _BEGUN])} END,
           CASE WHEN fault IS NULL THEN a ELSE {_least(
               _way("a", "4", "D"), _way("u", _EXTRA, "K", _LINE, _STAYS + " AND left(role, 1) = 'a'"),
               _way("u", "3 + " + _EXTRA, "R", "'assistant:' || text", _STAYS))} END,
           CASE WHEN fault IS NULL THEN 1 ELSE 0 END
    FROM opened)),
ended AS (SELECT conv_id, {_least("s0", "a")} AS best FROM walk WHERE half = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.c AS cost, e.best.a AS audit,
       sha256(e.best.o) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES: dict[str, str] = {"op12_conversation_repair": _REPAIR, "op13_prefix_trie": _TRIE,
    "op1_license_scan": _LICENSES, "op3_quality_rules": _QUALITY}
