"""Expected results in plain SQL over the driver tables.

The corpus oracles never parse mail: they state from the source columns what the rendered messages were
built to contain.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# --- functions over driver tables -----------------------------------------------------------

ORACLES["content_fingerprint"] = """
SELECT doc_id, sha256(text) AS sha256,
       'PS-MSG-' || upper(substr(sha256(text), 1, 12)) AS evidence_id
FROM documents"""

ORACLES["payload_hashes"] = """
SELECT page_id, strlen(html) AS size_bytes, sha256(html) AS sha256, md5(html) AS md5 FROM pages"""

ORACLES["address_domains"] = r"""
WITH found AS (
  SELECT doc_id,
         regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS a
  FROM documents),
flat AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS address FROM found),
split AS (SELECT *, lower(split_part(address, '@', 2)) AS domain FROM flat)
SELECT doc_id, pos, address, domain,
       CASE WHEN contains(domain, '.') THEN regexp_extract(domain, '([^.]*\.[^.]*)$', 1)
            ELSE domain END AS org_domain
FROM split"""

ORACLES["private_ip_ranges"] = r"""
WITH found AS (
  SELECT doc_id, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS a FROM documents),
flat AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS base FROM found),
moved AS (
  SELECT doc_id, pos, 0 AS variant, base AS literal FROM flat
  UNION ALL SELECT doc_id, pos, 1, '10.' || regexp_replace(base, '^[0-9]+\.', '') FROM flat
  UNION ALL SELECT doc_id, pos, 2,
    '172.31.' || regexp_replace(base, '^[0-9]+\.[0-9]+\.', '') FROM flat
  UNION ALL SELECT doc_id, pos, 3,
    '100.128.' || regexp_replace(base, '^[0-9]+\.[0-9]+\.', '') FROM flat),
num AS (
  SELECT *, split_part(literal, '.', 1)::BIGINT AS a, split_part(literal, '.', 2)::BIGINT AS b,
         split_part(literal, '.', 3)::BIGINT AS c, split_part(literal, '.', 4)::BIGINT AS d,
         regexp_matches(literal,
           '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$')
           AS ok
  FROM moved),
net AS (
  SELECT *, CASE WHEN NOT ok THEN NULL
    WHEN a = 10 THEN '10.0.0.0/8' WHEN a = 127 THEN '127.0.0.0/8'
    WHEN a = 172 AND b BETWEEN 16 AND 31 THEN '172.16.0.0/12'
    WHEN a = 192 AND b = 168 THEN '192.168.0.0/16'
    WHEN a = 169 AND b = 254 THEN '169.254.0.0/16'
    WHEN a = 100 AND b BETWEEN 64 AND 127 THEN '100.64.0.0/10' END AS network
  FROM num)
SELECT doc_id, pos, variant, literal,
       CASE WHEN ok THEN format('{:02x}{:02x}{:02x}{:02x}', a, b, c, d) END AS ip_hex,
       network IS NOT NULL AS is_private, network
FROM net"""

_PAGE = r"""
page AS (
  SELECT page_id, url,
         regexp_extract(url, '^(https?)://', 1) AS scheme,
         lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
         regexp_extract(url, '#(.*)$', 1) AS fragment,
         regexp_extract(url, '^([^#]*)', 1) AS url_key
  FROM pages)"""

ORACLES["url_decompose"] = rf"""
WITH {_PAGE}
SELECT page_id, scheme, host, NULL::INT AS port, path, fragment, FALSE AS host_is_ip,
       regexp_extract(host, '([^.]*\.[^.]*)$', 1) AS registered_domain,
       len(string_split(host, '.')) - 2 AS subdomain_depth,
       regexp_extract(host, '([^.]*)$', 1) AS tld, FALSE AS nonstandard_port,
       FALSE AS shortener, FALSE AS punycode, NULL::VARCHAR AS userinfo
FROM page"""

ORACLES["url_query_params"] = rf"""
WITH {_PAGE},
flat AS (
  SELECT page_id, generate_subscripts(string_split(query, '&'), 1) - 1 AS pos,
         unnest(string_split(query, '&')) AS p
  FROM page WHERE query <> '')
SELECT page_id, pos, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS name,
       url_decode(replace(split_part(p, '=', 2), '+', ' ')) AS value
FROM flat"""

ORACLES["url_dedup"] = rf"""
WITH {_PAGE}
SELECT url_key, count(*) AS pages, min(page_id) AS first_page, arg_min(url, page_id) AS first_url
FROM page GROUP BY url_key"""

ORACLES["url_defang"] = r"""
WITH shown AS (
  SELECT page_id, url,
         replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]') AS defanged FROM pages)
SELECT page_id, defanged, url AS restored, FALSE AS plain_looks_defanged,
       TRUE AS shown_looks_defanged, defanged AS twice
FROM shown"""

ORACLES["defang_free_text"] = r"""
WITH shown AS (
  SELECT page_id, replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]') AS low,
         replace(upper(url), '.', '[.]') AS up
  FROM pages)
SELECT page_id, 'Go to ' || low || ' or <' || up || '> etc.' AS shown FROM shown"""

ORACLES["display_truncation"] = """
SELECT doc_id, CASE WHEN length(text) > 200
  THEN left(text, 200) || '… [' || (length(text) - 200) || ' more chars, see --json]'
  ELSE text END AS shown
FROM documents"""

ORACLES["html_link_structure"] = r"""
WITH a AS (
  SELECT page_id,
         regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS targets,
         regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts
  FROM pages),
flat AS (
  SELECT page_id, generate_subscripts(targets, 1) - 1 AS pos, unnest(targets) AS value,
         unnest(texts) AS shown FROM a)
SELECT page_id, pos, 'html-href' AS kind, 'a' AS tag, 'href' AS attr, value,
       trim(first_value(shown) OVER (PARTITION BY page_id, value ORDER BY pos)) AS anchor_text
FROM flat"""

ORACLES["page_identification"] = r"""
SELECT page_id, 'text' AS category,
       CASE WHEN regexp_matches(html, '(?i)^\s*(<html|<!doctype html)') THEN 'html'
            ELSE 'text' END AS label
FROM pages"""

ORACLES["document_identification"] = r"""
WITH sample AS (
  SELECT doc_id, text,
         length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'))
           AS printable,
         length(text) AS chars
  FROM documents)
SELECT doc_id, CASE
  WHEN text = '' THEN 'empty'
  WHEN starts_with(text, 'MZ') THEN 'windows-pe'
  WHEN starts_with(text, '%PDF-') THEN 'pdf'
  WHEN starts_with(text, 'GIF87a') OR starts_with(text, 'GIF89a') THEN 'gif'
  WHEN starts_with(text, 'BM') THEN 'bmp'
  WHEN starts_with(text, '{\rtf') THEN 'rtf'
  WHEN starts_with(text, '<?xml') THEN 'xml'
  WHEN starts_with(text, '#!/') THEN 'script'
  WHEN regexp_matches(text, '(?i)^[ \t\n\r\x0b\f]*(<html|<!doctype html)') THEN 'html'
  WHEN NOT contains(text, chr(0)) AND printable >= 0.9 * chars THEN 'text'
  ELSE 'unknown' END AS label
FROM sample"""

# --- relay corpus ---------------------------------------------------------------------------

_HOP = """
hop AS (
  SELECT event_id, user_id, event_id // 4096 AS block, event_type AS kind,
         'm1/' || user_id || '/' || (event_id // 4096) || '.eml' AS source_path,
         row_number() OVER (PARTITION BY user_id, event_id // 4096 ORDER BY event_id) - 1
           AS position,
         date_trunc('second', ts)::TIMESTAMP
           + to_seconds((event_id * 37) % 7200 - 3600) AS hop_ts,
         'h' || (event_id % 97) || '.example.com' AS from_host,
         CASE event_type
           WHEN 'signup' THEN '10.0.' || (user_id % 256) || '.' || (event_id % 256)
           WHEN 'view' THEN '2001:db8::' || format('{:x}', event_id % 65535 + 1)
           WHEN 'purchase' THEN '203.0.113.' || (event_id % 256) END AS from_ip
  FROM events),
timed AS (
  SELECT *, CASE WHEN kind <> 'error'
    THEN strftime(hop_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS timestamp_utc
  FROM hop),
chain AS (SELECT DISTINCT user_id AS u, block AS b, source_path FROM hop)"""

ORACLES["header_table"] = rf"""
WITH {_HOP}, received AS (
  SELECT source_path, 'received' AS name,
    'from ' || from_host || CASE kind
      WHEN 'signup' THEN ' ([' || from_ip || '])'
      WHEN 'purchase' THEN ' ([' || from_ip || '])'
      WHEN 'view' THEN ' ([IPv6:2001:DB8:0:0:0:0:0:' || format('{{:x}}', event_id % 65535 + 1)
        || '])' ELSE '' END
    || ' by mx' || (event_id % 7) || '.example.net with ESMTPS id q' || event_id
    || CASE WHEN kind <> 'error'
       THEN '; ' || strftime(hop_ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' ELSE '' END AS value
  FROM hop)
SELECT * FROM received
UNION ALL SELECT source_path, 'return-path', '<bounce-' || u || '@example.org>' FROM chain
UNION ALL SELECT source_path, 'from', 'User ' || u || ' <u' || u || '@example.org>' FROM chain
UNION ALL SELECT source_path, 'to', 'one@example.com, Two Words <two@example.com>' FROM chain
UNION ALL SELECT source_path, 'subject', 'chain ' || u || '-' || b FROM chain
UNION ALL SELECT source_path, 'message-id', '<m' || u || '.' || b || '@example.org>' FROM chain
UNION ALL SELECT source_path, 'date', 'Tue, 02 Jan 2024 ' || format('{{:02d}}', u % 24) || ':15:00 '
  || CASE WHEN u % 2 = 0 THEN '+0200' ELSE 'EST' END FROM chain WHERE u % 11 <> 0
UNION ALL SELECT source_path, 'x-originating-ip', '[198.51.100.' || (u % 256) || ']'
  FROM chain WHERE u % 3 = 0
UNION ALL SELECT source_path, 'list-id', '<list' || (u % 10) || '.example.org>'
  FROM chain WHERE u % 5 = 0
UNION ALL SELECT source_path, 'x-mailer', 'Sample Mailer' FROM chain WHERE u % 7 = 0
UNION ALL SELECT source_path, 'mime-version', '1.0' FROM chain
UNION ALL SELECT source_path, 'content-type', 'Text/Plain; charset=utf-8' FROM chain"""

ORACLES["routing_projection"] = rf"""
WITH {_HOP}
SELECT source_path, '<m' || u || '.' || b || '@example.org>' AS message_id,
  CASE WHEN u % 3 = 0 THEN '[198.51.100.' || (u % 256) || ']' END AS x_originating_ip,
  NULL::VARCHAR AS x_sender_ip,
  CASE WHEN u % 7 = 0 THEN 'Sample Mailer' END AS x_mailer,
  NULL::VARCHAR AS user_agent, '1.0' AS mime_version, 'text/plain' AS top_content_type,
  'bounce-' || u || '@example.org' AS return_path,
  CASE WHEN u % 5 = 0 THEN '<list' || (u % 10) || '.example.org>' END AS list_id,
  CASE WHEN u % 5 = 0 THEN 1 ELSE 0 END AS list_headers,
  CASE WHEN u % 11 <> 0 THEN 'Tue, 02 Jan 2024 ' || format('{{:02d}}', u % 24) || ':15:00 '
    || CASE WHEN u % 2 = 0 THEN '+0200' ELSE 'EST' END END AS date_original,
  CASE WHEN u % 11 <> 0 THEN strftime(TIMESTAMP '2024-01-02 00:15:00' + to_hours(
    (u % 24 + CASE WHEN u % 2 = 0 THEN -2 ELSE 5 END)::INT), '%Y-%m-%dT%H:%M:%S') || '+00:00' END
    AS date_utc,
  u % 11 <> 0 AS date_valid
FROM chain"""

ORACLES["received_hops"] = rf"""
WITH {_HOP}
SELECT source_path, position, from_host, from_ip,
       'mx' || (event_id % 7) || '.example.net' AS by_host, NULL::VARCHAR AS by_ip,
       'ESMTPS' AS with_protocol, 'q' || event_id AS hop_id, timestamp_utc,
       timestamp_utc IS NOT NULL AS timestamp_valid
FROM timed"""

ORACLES["hop_counts"] = rf"""
WITH {_HOP}
SELECT source_path, 'hop-count' AS code, count(*)::VARCHAR AS hops FROM hop GROUP BY source_path"""

ORACLES["hop_missing_timestamp"] = rf"""
WITH {_HOP}
SELECT source_path, position::VARCHAR AS hop FROM hop WHERE kind = 'error'"""

ORACLES["private_ip_hops"] = rf"""
WITH {_HOP}
SELECT source_path, position::VARCHAR AS hop, 'from' AS clause, from_ip AS ip
FROM hop WHERE kind = 'signup'"""

ORACLES["unverifiable_from"] = rf"""
WITH {_HOP}
SELECT source_path, position::VARCHAR AS hop, from_host FROM hop WHERE kind IN ('click', 'error')"""

ORACLES["hop_inversion"] = rf"""
WITH {_HOP},
pair AS (
  SELECT *, lag(timestamp_utc) OVER (PARTITION BY source_path ORDER BY position) AS before
  FROM timed)
SELECT source_path, position::VARCHAR AS hop, timestamp_utc AS hop_timestamp,
       (position - 1)::VARCHAR AS previous_hop, before AS previous_timestamp
FROM pair WHERE timestamp_utc < before"""

ORACLES["originating_ip_claims"] = rf"""
WITH {_HOP}
SELECT source_path, 'x-originating-ip' AS header, '[198.51.100.' || (u % 256) || ']' AS value
FROM chain WHERE u % 3 = 0"""

ORACLES["received_warnings"] = rf"""
WITH {_HOP}
SELECT source_path, 'received-no-timestamp' AS code, count(*) AS n
FROM hop WHERE kind = 'error' GROUP BY source_path"""

_HEADER_CODES = """
  SELECT source_path, 'hop-count' AS code FROM chain
  UNION ALL SELECT source_path, 'missing-timestamp' FROM hop WHERE kind = 'error'
  UNION ALL SELECT source_path, 'private-ip-hop' FROM hop WHERE kind = 'signup'
  UNION ALL SELECT source_path, 'unverifiable-from' FROM hop WHERE kind IN ('click', 'error')
  UNION ALL SELECT source_path, 'originating-ip-claim' FROM chain WHERE u % 3 = 0
  UNION ALL SELECT source_path, 'timestamp-inversion' FROM (
    SELECT *, lag(timestamp_utc) OVER (PARTITION BY source_path ORDER BY position) AS before
    FROM timed) WHERE timestamp_utc < before"""

# --- authentication corpus ------------------------------------------------------------------

_CLAIM = """
base AS (
  SELECT o_orderkey AS k, 'm2/' || o_orderkey || '.eml' AS source_path,
         'c' || (o_custkey % 50) || '.example.net' AS domain,
         ['pass', 'fail', 'softfail', 'none', 'neutral'][left(o_orderpriority, 1)::INT] AS spf,
         CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'neutral' END AS rspf,
         o_orderkey % 5 < 2 AS signed, o_orderkey % 17 = 0 AS silent, o_orderkey % 19 AS noise
  FROM orders),
claim AS (
  SELECT *, CASE k % 3 WHEN 0 THEN domain WHEN 1 THEN 'mail.' || domain
            ELSE 'relay.example.org' END AS envelope,
         k % 4 = 0 AS second
  FROM base WHERE NOT silent),
result AS (
  SELECT source_path, 0 AS ordinal, 'mx.example.com' AS authserv_id, 'spf' AS method,
         spf AS result, CASE WHEN k % 7 = 0 THEN 'a;b (c)' END AS reason, envelope AS domain
  FROM claim
  UNION ALL SELECT source_path, 1, 'mx.example.com', 'dkim',
    CASE WHEN signed THEN 'pass' ELSE 'none' END, NULL, CASE WHEN signed THEN domain END FROM claim
  UNION ALL SELECT source_path, 2, 'mx.example.com', 'dmarc',
    CASE WHEN spf = 'pass' THEN 'pass' ELSE 'fail' END, NULL, domain FROM claim
  UNION ALL SELECT source_path, 3, 'gw.example.org', 'spf', 'fail', NULL, envelope
    FROM claim WHERE second),
signature AS (
  SELECT source_path, k, 0 AS ordinal, domain AS d, 'sel' || (k % 4) || 'b' AS s,
         'rsa-sha256' AS a, 'relaxed/relaxed' AS c, 'Ym9keQ==' AS bh, 'from:to:subject' AS h,
         'c2ln' || k AS b, 2 AS other_tags
  FROM claim WHERE signed
  UNION ALL
  SELECT source_path, k, CASE WHEN signed THEN 1 ELSE 0 END, NULL, NULL, 'b', NULL, NULL, '', NULL, 0
  FROM claim WHERE noise = 3)"""

ORACLES["auth_results"] = f"""
WITH {_CLAIM}
SELECT source_path, ordinal, authserv_id, method, result, TRUE AS known_result, reason,
       1 AS properties, domain, domain AS display_domain
FROM result"""

ORACLES["dkim_signatures"] = f"""
WITH {_CLAIM}
SELECT source_path, ordinal, d, s, a, c, bh, h, b, other_tags,
       FALSE AS cryptographically_verified
FROM signature"""

ORACLES["received_spf"] = f"""
WITH {_CLAIM}
SELECT source_path, 0 AS ordinal, rspf AS result,
       'mx.example.com: order ' || k || ' (checked)' AS detail
FROM claim"""

ORACLES["auth_warnings"] = f"""
WITH {_CLAIM},
code(noise, code) AS (VALUES
  (1, 'auth-results-no-clauses'), (2, 'auth-results-clause-no-equals'),
  (2, 'auth-results-bad-method'), (2, 'auth-results-missing-result'),
  (3, 'dkim-tag-no-equals'), (3, 'dkim-tag-empty-name'), (3, 'dkim-missing-d'),
  (4, 'dkim-no-tags'), (5, 'received-spf-empty'),
  (6, 'received-spf-unbalanced-paren'), (6, 'received-spf-no-result'))
SELECT source_path, code FROM claim JOIN code USING (noise)"""

ORACLES["from_domains"] = f"""
WITH {_CLAIM}
SELECT source_path, domain AS from_domain FROM base"""

ORACLES["auth_method_results"] = f"""
WITH {_CLAIM}
SELECT source_path, method || '-' || result AS code, authserv_id, domain FROM result"""

ORACLES["auth_conflicts"] = f"""
WITH {_CLAIM}
SELECT source_path, 'spf' AS method,
       '{{"fail":["gw.example.org"],"' || spf || '":["mx.example.com"]}}' AS results
FROM claim WHERE second AND spf <> 'fail'"""

_DKIM_PRESENCE = """
  SELECT source_path, 'dkim-signature-present' AS code, d FROM signature
  UNION ALL SELECT source_path, 'dkim-signature-absent', NULL FROM base
  WHERE silent OR NOT (signed OR noise = 3)"""

ORACLES["dkim_presence"] = f"WITH {_CLAIM}\n{_DKIM_PRESENCE}"

_ALIGNMENT = """
  SELECT source_path, 'spf-alignment-' || CASE k % 3 WHEN 0 THEN 'aligned'
           WHEN 1 THEN 'relaxed-aligned' ELSE 'unaligned' END AS code,
         envelope AS domain, domain AS from_domain
  FROM claim
  UNION ALL SELECT source_path, 'dkim-alignment-aligned', domain, domain FROM claim WHERE signed"""

ORACLES["auth_alignment"] = f"WITH {_CLAIM}\n{_ALIGNMENT}"

_DISAGREEMENT = """
  SELECT source_path, rspf AS received_spf,
         CASE WHEN second AND spf <> 'fail' THEN '["fail","' || spf || '"]'
              ELSE '["' || spf || '"]' END AS auth_results_spf
  FROM claim WHERE rspf <> spf AND NOT (second AND rspf = 'fail')"""

ORACLES["spf_disagreement"] = f"WITH {_CLAIM}\n{_DISAGREEMENT}"

ORACLES["auth_absent"] = f"""
WITH {_CLAIM}
SELECT source_path FROM base WHERE silent"""

_AUTH_CODES = f"""
  SELECT source_path, 'no-auth-headers' AS code FROM base WHERE silent
  UNION ALL SELECT source_path, method || '-' || result FROM result
  UNION ALL SELECT source_path, 'conflicting-auth-results' FROM claim
    WHERE second AND spf <> 'fail'
  UNION ALL SELECT source_path, code FROM ({_DKIM_PRESENCE})
  UNION ALL SELECT source_path, code FROM ({_ALIGNMENT})
  UNION ALL SELECT source_path, 'received-spf-' || rspf FROM claim
  UNION ALL SELECT source_path, 'spf-claim-disagreement' FROM ({_DISAGREEMENT})"""

# --- URL corpus -----------------------------------------------------------------------------

_SIGHTING = """
sighting AS (
  SELECT page_id AS k, 0 AS ord, 'body-text' AS kind, '0.0' AS detail, url AS candidate,
         FALSE AS defanged_in_source, url, regexp_extract(url, '^([^#]*)', 1) AS url_key
  FROM pages
  UNION ALL SELECT page_id, 1, 'body-text', '0.0', url, FALSE, url,
    regexp_extract(url, '^([^#]*)', 1) FROM pages
  UNION ALL SELECT page_id, 2, 'body-text', '0.0',
    replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]'), TRUE, url,
    regexp_extract(url, '^([^#]*)', 1) FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, 3, 'body-text', '0.0', u, FALSE, u, u FROM (
    SELECT page_id, 'http://192.0.2.' || (page_id % 256) || ':8080/x' AS u FROM pages
    WHERE page_id % 3 = 0)
  UNION ALL SELECT page_id, 4, 'body-text', '0.0', u, FALSE, u, u FROM (
    SELECT page_id, 'https://bit.ly/' || page_id AS u FROM pages WHERE page_id % 5 = 0)
  UNION ALL SELECT page_id, 5, 'body-text', '0.0', u, FALSE, u, u FROM (
    SELECT page_id, 'https://a.b.c.d.example.com/' || page_id AS u FROM pages
    WHERE page_id % 7 = 0)
  UNION ALL SELECT page_id, 6, 'body-text', '0.0', 'http://user:pw@xn--bcher-kva.example:99999/' || t,
    FALSE, 'http://user:pw@xn--bcher-kva.example:99999/' || t, 'http://xn--bcher-kva.example/' || t
    FROM (SELECT page_id, page_id || '?a=1&b=2&c=&d=x+y&e=%2F&e=z' AS t FROM pages
          WHERE page_id % 11 = 0)
  UNION ALL SELECT page_id, 8, 'html-href', '0.1 <a href>', url, FALSE, url,
    regexp_extract(url, '^([^#]*)', 1) FROM pages
  UNION ALL SELECT page_id, 9, 'html-src', '0.1 <img src>', 'https://img.example.net/p.png', FALSE,
    'https://img.example.net/p.png', 'https://img.example.net/p.png' FROM pages
  UNION ALL SELECT page_id, 10, 'html-text', '0.1', u, FALSE, u, regexp_extract(u, '^([^#]*)', 1)
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url
                 ELSE 'https://www.shown.example/' || page_id END AS u FROM pages)
  UNION ALL SELECT page_id, 11, 'header', 'List-Unsubscribe', u, FALSE, u, u FROM (
    SELECT page_id, 'http' || CASE WHEN page_id % 4 = 0 THEN '' ELSE 's' END || '://lists.example.org/u?id=' || page_id AS u
    FROM pages)),
merged AS (
  SELECT 'm3/' || k || '.eml' AS source_path, k, url_key, arg_min(url, ord) AS url,
         count(DISTINCT kind || '|' || detail || '|' || defanged_in_source) AS sources,
         count(*) AS sightings, max(defanged_in_source) AS defanged,
         k % 2 = 1 AND bool_or(kind = 'html-href') AS mismatch
  FROM sighting GROUP BY k, url_key),
hosts AS (
  SELECT *, lower(regexp_extract(url, '^https?://([^/?#@]*@)?([^/?#:]+)', 2)) AS host FROM merged)"""

ORACLES["url_sightings"] = f"""
WITH {_SIGHTING}
SELECT 'm3/' || k || '.eml' AS source_path, kind, detail, candidate, defanged_in_source, url_key
FROM sighting"""

ORACLES["url_unparseable"] = """
SELECT 'm3/' || page_id || '.eml' AS source_path, 'url-unparseable' AS code,
       'https://[bad' AS detail
FROM pages WHERE page_id % 13 = 0"""

ORACLES["url_inventory"] = f"""
WITH {_SIGHTING}
SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY url) AS position, url,
       sources, sightings
FROM merged"""

ORACLES["url_hosts"] = rf"""
WITH {_SIGHTING}
SELECT source_path, host,
       CASE WHEN host = 'xn--bcher-kva.example' THEN 'bücher.example' ELSE host END AS host_unicode,
       starts_with(host, 'xn--') AS punycode, host = 'bit.ly' AS shortener,
       starts_with(host, '192.0.2.') AS host_is_ip, contains(url, ':99999') AS invalid_port,
       CASE WHEN contains(url, ':8080/') THEN 8080 END AS port,
       CASE WHEN contains(url, 'user:pw@') THEN 'user:pw' END AS userinfo,
       CASE WHEN starts_with(host, '192.0.2.') THEN 0
            ELSE len(string_split(host, '.')) - 2 END AS subdomain_depth,
       CASE WHEN contains(url_key, '?') THEN len(string_split(url_key, '&')) ELSE 0 END AS params
FROM hosts"""

_URL_CODES = """
  SELECT source_path, 'http-scheme' AS code, url FROM hosts WHERE starts_with(url, 'http:')
  UNION ALL SELECT source_path, unnest(['ip-literal-host', 'nonstandard-port']), url FROM hosts
    WHERE starts_with(host, '192.0.2.')
  UNION ALL SELECT source_path, unnest(['userinfo-present', 'punycode-host', 'invalid-port',
    'many-query-params']), url FROM hosts WHERE host = 'xn--bcher-kva.example'
  UNION ALL SELECT source_path, 'shortened-url', url FROM hosts WHERE host = 'bit.ly'
  UNION ALL SELECT source_path, 'deep-subdomain', url FROM hosts WHERE host = 'a.b.c.d.example.com'
  UNION ALL SELECT source_path, 'defanged-in-source', url FROM hosts WHERE defanged
  UNION ALL SELECT source_path, 'display-href-mismatch', url FROM hosts WHERE mismatch"""

ORACLES["url_observations"] = f"WITH {_SIGHTING}\n{_URL_CODES}"

ORACLES["display_href_mismatch"] = f"""
WITH {_SIGHTING}
SELECT source_path, url AS href, 'https://www.shown.example/' || k AS display_text
FROM merged WHERE mismatch"""

ORACLES["url_counts"] = f"""
WITH {_SIGHTING}
SELECT source_path, 'url-count' AS code, count(*)::VARCHAR AS url_count
FROM merged GROUP BY source_path"""

ORACLES["page_url_rollup"] = rf"""
WITH {_PAGE},
coded AS (
  SELECT regexp_extract(host, '([^.]*\.[^.]*)$', 1) AS registered_domain, 'url' AS code, url_key
  FROM page
  UNION ALL SELECT regexp_extract(host, '([^.]*\.[^.]*)$', 1), 'http-scheme', url_key
  FROM page WHERE scheme = 'http'
  UNION ALL SELECT regexp_extract(host, '([^.]*\.[^.]*)$', 1), 'many-query-params', url_key
  FROM page WHERE query <> '' AND len(string_split(query, '&')) >= 5
  UNION ALL SELECT regexp_extract(host, '([^.]*\.[^.]*)$', 1), 'deep-subdomain', url_key
  FROM page WHERE len(string_split(host, '.')) >= 6)
SELECT registered_domain, code, count(*) AS pages, count(DISTINCT url_key) AS urls
FROM coded GROUP BY registered_domain, code"""

# --- attachment corpus ----------------------------------------------------------------------

_ZIP_HEX = (
    "504B0304140000000000000021000000000000000000000000000A000000726561646D652E747874"
    "504B03041400000000000000210000000000000000000000000008000000746F6F6C2E657865"
    "504B01021403140000000000000021000000000000000000000000000A0000000000000000000000800100000000"
    "726561646D652E747874"
    "504B0102140314000000000000002100000000000000000000000000080000000000000000000000800128000000"
    "746F6F6C2E657865504B050600000000020002006E0000004E0000000000"
)
_CARRIED = f"""
kind(n, hex, category, label) AS (VALUES
  (0, '4D5A900003000000', 'executable', 'windows-pe'),
  (1, '7F454C4602010100', 'executable', 'elf'),
  (2, '255044462D312E37', 'document', 'pdf'),
  (3, 'D0CF11E0A1B11AE1', 'document', 'ole'),
  (4, '{_ZIP_HEX}', 'archive', 'zip'),
  (5, '1F8B0800000000000003', 'archive', 'gzip'),
  (6, '526172211A070000', 'archive', 'rar'),
  (7, '89504E470D0A1A0A', 'image', 'png'),
  (8, 'FFD8FFE000104A46', 'image', 'jpeg'),
  (9, '474946383961', 'image', 'gif'),
  (10, '3C68746D6C3E3C2F68746D6C3E', 'text', 'html'),
  (11, '706C61696E20746578742C20686572652E', 'text', 'text'),
  (12, '0001020304050607', 'unknown', 'unknown'),
  (13, '', 'empty', 'empty')),
named AS (
  SELECT p_partkey AS k, 'm4/' || p_partkey || '.eml' AS source_path, hex, category, label,
         length(hex) // 2 AS size_bytes,
         ['application/octet-stream', 'application/pdf', 'text/plain', 'image/png'][p_partkey % 4 + 1]
           AS mime_claim,
         CASE WHEN p_size % 10 <> 0 THEN 'f' || p_partkey
           || ['.pdf', '.pdf.EXE', '.docm', '.png', '.txt', ''][p_size % 6 + 1] END AS own_name,
         CASE WHEN p_size % 10 = 0 THEN '.1'
              ELSE ['.pdf', '.exe', '.docm', '.png', '.txt', ''][p_size % 6 + 1] END AS extension
  FROM part JOIN kind ON p_partkey % 14 = n),
carried AS (
  SELECT *, coalesce(own_name, 'unnamed-attachment-0.1') AS filename FROM named)"""

ORACLES["message_parts"] = f"""
WITH {_CARRIED}
SELECT source_path, '0' AS part_index, NULL AS parent_index, 0 AS depth, 0 AS ordinal,
       'multipart/mixed' AS content_type, TRUE AS is_container, NULL AS filename,
       NULL AS disposition, length('part ' || k) + size_bytes AS size_bytes,
       FALSE AS is_attachment FROM carried
UNION ALL SELECT source_path, '0.0', '0', 1, 1, 'multipart/alternative', TRUE, NULL, NULL,
       length('part ' || k), FALSE FROM carried
UNION ALL SELECT source_path, '0.0.0', '0.0', 2, 2, 'text/plain', FALSE, NULL, NULL,
       length('part ' || k), FALSE FROM carried
UNION ALL SELECT source_path, '0.1', '0', 1, 3, mime_claim, FALSE, own_name, 'attachment',
       size_bytes, TRUE FROM carried"""

ORACLES["attachment_inventory"] = f"""
WITH {_CARRIED}
SELECT source_path, '0.1' AS part_index, filename, mime_claim, size_bytes,
       sha256(unhex(hex)) AS sha256
FROM carried"""

ORACLES["message_addresses"] = f"""
WITH {_HOP}
SELECT source_path, 'from' AS role, 0 AS ordinal, 'User ' || u AS display_name,
       'u' || u || '@example.org' AS addr, 'User ' || u || ' <u' || u || '@example.org>' AS raw
FROM chain
UNION ALL SELECT source_path, 'to', 0, '', 'one@example.com', 'one@example.com' FROM chain
UNION ALL SELECT source_path, 'to', 1, 'Two Words', 'two@example.com',
  'Two Words <two@example.com>' FROM chain
UNION ALL SELECT source_path, 'return-path', 0, '', 'bounce-' || u || '@example.org',
  '<bounce-' || u || '@example.org>' FROM chain"""

ORACLES["message_texts"] = f"""
WITH {_CARRIED}
SELECT source_path, 'Teil ' || k || ' ü' AS subject, 'Jürgen' AS from_name,
       'a@example.org' AS from_addr,
       CASE WHEN k % 3 <> 0 THEN '2024-01-01T09:00:00+00:00' END AS date_utc
FROM carried"""

ORACLES["missing_headers"] = f"""
WITH {_HOP}
SELECT source_path, 'no date header' AS detail FROM chain WHERE u % 11 = 0"""

_REJECT = """
rejected AS (
  SELECT 'm5/' || c_custkey || '.eml' AS source_path,
    CASE WHEN c_custkey % 100 = 1 THEN 'too-many-parts'
         WHEN c_custkey % 100 = 3 THEN 'mime-too-deep'
         WHEN c_custkey % 500 = 5 THEN 'header-too-large' END AS reason,
    c_custkey % 100 = 4 AS defective
  FROM customer)"""

ORACLES["message_rejects"] = f"""
WITH {_REJECT}
SELECT source_path, reason, CASE reason WHEN 'too-many-parts' THEN 200 WHEN 'mime-too-deep' THEN 16
       ELSE 1048576 END AS "limit"
FROM rejected WHERE reason IS NOT NULL"""

ORACLES["message_overview"] = f"""
WITH {_CARRIED}
SELECT source_path,
       CASE WHEN k % 3 <> 0 THEN '2024-01-01T09:00:00+00:00' ELSE '<missing>' END AS date,
       'Jürgen <a@example.org>' AS "from", 'part' || k || '@example.com' AS "to",
       'Teil ' || k || ' ü' AS subject, 4 AS parts, 'multipart/mixed' AS content_type,
       1 AS attachments, filename AS files, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS warnings,
       CASE WHEN k % 3 = 0 THEN 'missing-header' END AS first_warning
FROM carried"""

ORACLES["attachment_identification"] = f"""
WITH {_CARRIED}
SELECT source_path, '0.1' AS part_index, filename, mime_claim, size_bytes,
       md5(unhex(hex)) AS md5, category, label, extension,
       CASE extension WHEN '' THEN 0 WHEN '.exe' THEN 2 ELSE 1 END AS extensions
FROM carried"""

_AGREEMENT = """
accepts(extension, label) AS (VALUES
  ('.pdf', 'pdf'), ('.exe', 'windows-pe'), ('.exe', 'elf'), ('.exe', 'script'), ('.docm', 'zip'),
  ('.docm', 'ole'), ('.png', 'png'), ('.txt', 'text'), ('.txt', 'xml'), ('.txt', 'script')),
agreed AS (
  SELECT *, label NOT IN ('unknown', 'empty')
           AND extension IN ('.pdf', '.exe', '.docm', '.png', '.txt')
           AND (extension, label) NOT IN (SELECT (extension, label) FROM accepts)
           AS extension_mismatch,
         label NOT IN ('unknown', 'empty') AND mime_claim <> 'application/octet-stream'
           AND (mime_claim, label) NOT IN (('application/pdf', 'pdf'), ('text/plain', 'text'),
                                           ('image/png', 'png')) AS mime_mismatch
  FROM carried)"""

_ATTACHMENT_CODES = """
  SELECT source_path, 'double-extension' AS code FROM agreed WHERE extension = '.exe'
  UNION ALL SELECT source_path, 'extension-type-mismatch' FROM agreed WHERE extension_mismatch
  UNION ALL SELECT source_path, 'declared-mime-mismatch' FROM agreed WHERE mime_mismatch
  UNION ALL SELECT source_path, 'empty-attachment' FROM agreed WHERE label = 'empty'
  UNION ALL SELECT source_path, 'executable-content' FROM agreed WHERE label IN ('windows-pe', 'elf')
  UNION ALL SELECT source_path, 'macro-capable-format' FROM agreed
    WHERE extension = '.docm' AND label IN ('zip', 'ole')
  UNION ALL SELECT source_path, 'oversized-attachment' FROM agreed WHERE size_bytes >= 200"""

ORACLES["attachment_observations"] = f"""
WITH {_CARRIED}, {_AGREEMENT}
SELECT source_path, code, '0.1' AS subject FROM ({_ATTACHMENT_CODES})"""

ORACLES["extension_mismatch"] = f"""
WITH {_CARRIED}, {_AGREEMENT}
SELECT source_path, extension, label, mime_claim, extension_mismatch, mime_mismatch
FROM agreed WHERE extension_mismatch OR mime_mismatch"""

ORACLES["container_entries"] = f"""
WITH {_CARRIED}, member(ordinal, name) AS (VALUES (0, 'readme.txt'), (1, 'tool.exe'))
SELECT source_path, '0.1' AS part_index, filename, '0' AS container_path, 0 AS level, ordinal,
       'member' AS entry_kind, name, 0 AS size_bytes, FALSE AS encrypted, FALSE AS nested_archive
FROM carried, member WHERE label = 'zip'"""

ORACLES["container_observations"] = f"""
WITH {_CARRIED}
SELECT source_path, 'archive-member-executable' AS code, '0.1' AS subject
FROM carried WHERE label = 'zip'"""

ORACLES["container_warnings"] = f"""
WITH {_CARRIED}
SELECT source_path, 'ole-unreadable' AS code, '0.1' AS part FROM carried WHERE label = 'ole'"""

ORACLES["attachment_counts"] = f"""
WITH {_CARRIED}
SELECT source_path, 'attachment-count' AS code, 'count=1' AS text FROM carried"""

# --- assembly -------------------------------------------------------------------------------

ORACLES["message_status"] = f"""
WITH {_HOP}, {_REJECT}
SELECT c.source_path, CASE WHEN c.u % 11 = 0 OR e.source_path IS NOT NULL THEN 'warnings'
       ELSE 'ok' END AS status
FROM chain c LEFT JOIN (SELECT DISTINCT source_path FROM hop WHERE kind = 'error') e
  ON c.source_path = e.source_path
UNION ALL
SELECT source_path, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN defective THEN 'warnings'
       ELSE 'ok' END
FROM rejected"""

ORACLES["observation_rollup"] = f"""
WITH {_HOP}, {_CLAIM}, {_SIGHTING}, {_CARRIED}, {_AGREEMENT},
seen AS (
  SELECT 'headers' AS area, source_path, code FROM ({_HEADER_CODES})
  UNION ALL SELECT 'authentication', source_path, code FROM ({_AUTH_CODES})
  UNION ALL SELECT 'urls', source_path, code FROM ({_URL_CODES})
  UNION ALL SELECT DISTINCT 'urls', source_path, 'url-count' FROM merged
  UNION ALL SELECT 'attachments', source_path, code FROM ({_ATTACHMENT_CODES}))
SELECT area, code, count(*) AS observations, count(DISTINCT source_path) AS messages
FROM seen GROUP BY area, code"""

_KEYS = {
    "keys": "attachments,attachments_detail,authentication,cc,date,evidence_id,from,headers,message_id,mime_tree,"
            "parser_warnings,provenance,reply_to,return_path,sha256,size_bytes,source_path,subject,to,urls",
    "mime_tree_keys": "children,content_type,filename,index,is_attachment,sha256,size_bytes",
    "headers_keys": "date,evidence_id,list_headers,message_id,mime_version,observations,parser_warnings,provenance,received,"
                    "return_path,sha256,source_path,top_content_type,user_agent,x_mailer,x_originating_ip,x_sender_ip",
    "authentication_keys": "auth_results,dkim_signatures,evidence_id,from_domain,observations,parser_warnings,provenance,"
                           "received_spf,sha256,source_path",
    "urls_keys": "evidence_id,observations,parser_warnings,provenance,sha256,source_path,url_count,urls",
    "attachments_detail_keys": "attachments,evidence_id,observations,parser_warnings,provenance,sha256,source_path",
}

ORACLES["message_documents"] = f"""
WITH {_SIGHTING},
observed AS (SELECT source_path, count(*) AS n FROM ({_URL_CODES}) GROUP BY source_path),
listed AS (
  SELECT source_path, any_value(k) AS k, count(*) AS n, string_agg(url || ' ' || sources, ',' ORDER BY url) AS urls
  FROM merged GROUP BY source_path)
SELECT l.source_path, {", ".join(f"'{v}' AS {k}" for k, v in _KEYS.items())},
       'page ' || k AS subject, '2024-01-01T00:00:00+00:00' AS date_utc, 'a@example.org' AS from_addr, '0' AS root,
       '0.0 text/plain,0.1 text/html' AS nodes, 0 AS warnings, 0 AS hops,
       '<http' || CASE WHEN k % 4 = 0 THEN '' ELSE 's' END || '://lists.example.org/u?id=' || k || '>' AS unsubscribe,
       'hop-count,no-received-headers' AS header_codes, 'no-auth-headers,dkim-signature-absent' AS auth_codes,
       'example.org' AS from_domain, l.n AS url_count, l.urls, 1 + coalesce(o.n, 0) AS url_observations,
       CASE WHEN k % 13 = 0 THEN 'url-unparseable https://[bad' ELSE '' END AS url_warnings, 0 AS attachments,
       'no-attachments' AS attachment_codes
FROM listed l LEFT JOIN observed o USING (source_path)"""
