"""DuckDB twins of the queries. Those over the simulated crawl follow from its rules, not
from parsing: what a tag was made to say is what the query must find."""

from __future__ import annotations

import ipaddress
import re

from .. import fixed
from . import simulate as sim

_ROLES = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(path), '{n}')''' for n in needles)} THEN '{role}'" for role, needles in fixed.ROLE_PATHS) + " WHEN lower(path) IN ('/', '', '/index.html') THEN 'home'"
_EXPECTED = "CASE role " + " ".join(f"WHEN '{r}' THEN [{', '.join(repr(t) for t in sorted(ts))}]" for r, ts in fixed.ROLE_TYPES.items()) + " ELSE [] END"
_POINTS = "CASE status WHEN 'pass' THEN CAST(weight AS DOUBLE) WHEN 'warn' THEN weight * 0.5 ELSE 0.0 END"
_CATALOG = "(VALUES " + ", ".join(f"({i}, '{c[0]}', '{c[1]}', {c[3]})" for i, c in enumerate(fixed.CATALOG)) + ") AS k(ord, check_id, category, weight)"
_BLOCKED = " OR ".join(f"n BETWEEN {int(ipaddress.ip_network(b).network_address)} AND {int(ipaddress.ip_network(b).broadcast_address)}" for b in fixed.BLOCKED_V4)
_PRICES = "(VALUES " + ", ".join(f"({i}, '{p}', {a}, {b})" for i, (p, a, b) in enumerate(fixed.PRICES)) + ") AS t(ord, prefix, input_rate, output_rate)"
_DE = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"

#: What the simulation put into each page.
_P = r"""
p AS (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         page_id % 4 AS m4, page_id % 5 AS m5, page_id % 6 AS m6, page_id % 8 AS m8, page_id % 9 AS m9, page_id % 11 AS m11, page_id % 3 AS m3, page_id % 2 AS m2,
         trim(""" + _DE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r""") AS title, length(html) AS html_chars, html
  FROM pages
), s AS (
  SELECT site_id, arg_min(url, page_id) AS start_url, min(page_id) AS first_id FROM p GROUP BY site_id
)"""
_L = """
l AS (
  SELECT p.*, ord, lens, CASE WHEN ord = 0 THEN CASE WHEN page_id % 41 = 40 THEN 'down' ELSE 'same' END
         WHEN (page_id * 31 + ord * 17) % 100 < 8 THEN 'waf' WHEN (page_id * 31 + ord * 17) % 100 < 12 THEN 'challenge'
         WHEN (page_id * 31 + ord * 17) % 100 < 16 THEN 'half' WHEN (page_id * 31 + ord * 17) % 100 < 18 THEN 'timeout' ELSE 'same' END AS kind
  FROM p CROSS JOIN (VALUES """ + ", ".join(f"({i}, '{b}')" for i, b in enumerate(("browser", *fixed.DEFAULT_BOTS))) + """) AS v(ord, lens)
)"""


def _check(check_id: str, agg: str, status: str, confidence: str = "'high'", ctes: str = _P) -> str:
    weight = next(c[3] for c in fixed.CATALOG if c[0] == check_id)
    return f"WITH {ctes}, a AS ({agg}), v AS (SELECT site_id, {status} AS status, {confidence} AS confidence, {weight} AS weight FROM a) SELECT site_id, '{check_id}' AS check_id, status, weight, {_POINTS} AS points, confidence FROM v"


_H1 = "1 + CAST(m8 = 3 AS INT)"
_LD_TYPES = "CASE CASE WHEN page_id % 41 = 40 THEN 0 ELSE m4 END WHEN 1 THEN ['Article'] WHEN 3 THEN ['Organization', 'WebSite'] ELSE CAST([] AS VARCHAR[]) END"
_ROLE_CTE = _P + f""", r0 AS (SELECT *, {_LD_TYPES} AS types FROM p), r AS (
  SELECT *, {_ROLES} WHEN list_contains(types, 'Article') THEN 'article' WHEN contains(lower(title), 'pricing') OR contains(lower(title), 'plans') OR contains(lower(title), 'buy') THEN 'product'
  WHEN contains(lower(title), 'faq') OR contains(lower(title), 'questions') THEN 'faq' ELSE 'article' END AS role FROM r0
), t AS (SELECT *, list_sort(list_filter({_EXPECTED}, lambda x: NOT list_contains(types, x))) AS missing FROM r)"""
_TITLE_ODD = "CAST(title <> '' AND length(title) NOT BETWEEN 10 AND 70 AS INT)"
_GENERIC = r"CAST(lower(title) IN ('home','index','untitled','page') OR trim(regexp_extract(lower(title), '^(.*?)\s*(?:[|\x{2013}\x{2014}-]|$)', 1)) IN ('home','index','untitled','page') AS INT)"

_TRIALS = """
t AS (
  SELECT source AS site_id, 'p' || (doc_id % 3) AS url, doc_id AS q_id, trial, doc_id % 4 <> 0 AS has_span, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS span_hit,
         CASE WHEN (doc_id * 7 + trial * 3) % 10 < 5 THEN 'correct' WHEN (doc_id * 7 + trial * 3) % 10 = 5 THEN 'partially_correct' WHEN (doc_id * 7 + trial * 3) % 10 < 8 THEN 'incorrect' ELSE 'abstained' END AS verdict,
         (doc_id + trial) % 17 = 0 AS failed
  FROM documents CROSS JOIN (VALUES (0), (1), (2)) AS v(trial)
), b AS (
  SELECT site_id, url, trial, count(*) AS n, sum(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END)::DOUBLE AS points,
         count(*) FILTER (NOT failed AND verdict = 'abstained') AS abstained, count(*) FILTER (NOT failed AND verdict = 'incorrect') AS wrong,
         count(*) FILTER (has_span AND span_hit) AS hits, count(*) FILTER (has_span) AS spans, count(DISTINCT q_id) AS questions
  FROM t GROUP BY ALL
), sc AS (SELECT *, round(100.0 * points / n, 4) AS score FROM b),
q AS (
  SELECT site_id, url, q_id, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(DISTINCT verdict) AS kinds, bool_or(span_hit) AS span_hit FROM t GROUP BY ALL
)"""


def _pooled(by: str) -> str:
    return f"""
g AS (
  SELECT {by}, sum(n) AS n, sum(points) AS points, sum(abstained) AS abstained, sum(wrong) AS wrong, sum(hits) AS hits, sum(spans) AS spans, coalesce(stddev_samp(score), 0) AS sd,
         max(questions) AS questions, count(DISTINCT url) AS pages, count(DISTINCT trial) AS trials
  FROM sc GROUP BY {by}
), e AS (
  SELECT *, points / n AS rate, 1.96 * sqrt(greatest(points / n * (1 - points / n), 0) / n) AS half FROM g
)"""


_METRICS = """round(100 * rate, 4) AS mean, round(sd, 4) AS per_trial_stddev, round(100 * greatest(0, rate - half), 2) AS ci_low, round(100 * least(1, rate + half), 2) AS ci_high,
  CAST(n AS BIGINT) AS question_trials, round(abstained / n, 4) AS abstention_rate, round(wrong / n, 4) AS hallucination_rate"""

_WORDS = r"list_distinct(list_filter(string_split(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), ' '), lambda x: x <> ''))"
_LINES = "ln AS (SELECT source AS page, doc_id, text FROM documents)"
_ASKS = "ak AS (SELECT 'src' || (item_id % 20) AS page, item_id AS q_id, text AS question FROM benchmark)"
_REC = f"""
r AS (
  SELECT doc_id, source || '/' || (doc_id // 2000) AS site_id, check_id, category, weight,
         CASE (doc_id // 20) % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'skip' WHEN 4 THEN 'error' ELSE 'pass' END AS status
  FROM documents JOIN {_CATALOG} ON doc_id % 20 = ord
), rp AS (SELECT *, {_POINTS} AS points FROM r)"""
_CATS = """
c AS (
  SELECT site_id, category, round(coalesce(sum(points) FILTER (status <> 'skip'), 0), 2) AS points, round(CAST(coalesce(sum(weight) FILTER (status <> 'skip'), 0) AS DOUBLE), 2) AS max
  FROM rp WHERE category IN ('access', 'rendering', 'discovery') GROUP BY ALL
)"""
_SENT = r"string_split(regexp_replace(block, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_CHUNKS = rf"""
bl AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS block FROM documents
), fold AS (
  SELECT doc_id, block, list_reduce(list_transform({_SENT}, lambda x: {{'out': CAST([] AS INT[]), 'cur': CAST(length(x) AS INT), 'size': CAST(greatest(1, length(x) // 4) AS INT)}}),
    lambda a, x: CASE WHEN a.size + x.size > 400 THEN {{'out': list_append(a.out, a.cur), 'cur': x.cur, 'size': x.size}} ELSE {{'out': a.out, 'cur': a.cur + 1 + x.cur, 'size': a.size + x.size}} END) AS f
  FROM bl WHERE block <> ''
), ck AS (
  SELECT doc_id, CASE WHEN greatest(1, length(block) // 4) > 400 THEN list_append(f.out, f.cur) ELSE [CAST(length(block) AS INT)] END AS lens FROM fold
)"""

ORACLE_SQL: dict[str, str] = {
    "page_structure": r"SELECT page_id, trim(" + _DE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r") AS title, regexp_extract(html, '(?is)<html[^>]* lang=\"([^\"]*)\"', 1) AS lang, "
    r"CAST(len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS BIGINT) AS n_headings, trim(" + _DE.format(r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + r") AS first_heading, "
    r"CAST(length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS BIGINT) AS stripped_chars, contains(html, '<main') AS has_main FROM pages",
    "heading_outline": f"WITH {_P} SELECT page_id, CASE m8 WHEN 1 THEN '1,3' WHEN 2 THEN '1,2' WHEN 3 THEN '1,1' WHEN 4 THEN '1,2,5' WHEN 5 THEN '1,2' ELSE '1' END AS levels, CAST(m8 IN (1, 4) AS BIGINT) AS skipped, CAST(m8 = 2 AS BIGINT) AS empty FROM p",
    "page_tags": f"""WITH {_P} SELECT page_id, CASE m4 WHEN 0 THEN NULL WHEN 1 THEN 'Short.' ELSE 'A description of this café page that is long enough to be read as a summary.' END AS description,
  CASE m11 WHEN 3 THEN 'noindex, nofollow' WHEN 5 THEN 'nosnippet' END AS robots, CASE WHEN m2 = 0 THEN 'I' END AS og_image,
  CASE m5 WHEN 0 THEN NULL WHEN 1 THEN 'https://other.example.org/x' WHEN 2 THEN '/page' WHEN 3 THEN url || '/' ELSE url END AS canonical,
  CAST(m5 <> 0 AS BIGINT) + CAST(page_id % 35 = 14 AS BIGINT) AS canonical_count, CASE m6 WHEN 1 THEN '2024-02-31x' WHEN 2 THEN '2024-02-28' END AS time, CAST(m4 <> 0 AS BIGINT) AS ld_blocks,
  m9 NOT IN (4, 5) AS valid_lang FROM p""",
    "structured_data": f"WITH {_P} SELECT page_id, CAST(m4 <> 0 AS BIGINT) AS blocks, CAST(CASE m4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS parsed, CASE m4 WHEN 1 THEN 'Article' WHEN 3 THEN 'Organization,WebSite,WebPage' ELSE '' END AS types, CAST(m4 = 2 AS BIGINT) AS errors FROM p",
    "props_items": """SELECT click_id, CAST(CASE WHEN props IS NULL THEN 0 ELSE 2 END AS BIGINT) AS blocks, CAST(CASE WHEN j IS NULL THEN 0 WHEN g THEN 1 + json_array_length(j, '$.items') ELSE 2 END AS BIGINT) AS parsed, CAST(CASE WHEN props IS NULL OR j IS NOT NULL THEN 0 ELSE 2 END AS BIGINT) AS errors,
  CAST(CASE WHEN j IS NULL THEN 0 WHEN g THEN len(list_filter(CAST(json_extract(j, '$.items') AS JSON[]), lambda x: json_exists(x, '$.sku'))) + CAST(json_exists(j, '$.tags') AS INT) ELSE 2 * CAST(json_exists(j, '$.tags') AS INT) END AS BIGINT) AS with_keys,
  json_extract_string(j, '$.tags[0]') AS first_tag, CASE WHEN g THEN json_extract_string(j, '$.items[0].sku') END AS first_sku
FROM (SELECT *, coalesce(json_type(j, '$.items') = 'ARRAY', false) AS g FROM (SELECT *, CASE WHEN json_valid(props) THEN props END AS j FROM clicks))""",
    "marker_flags": "SELECT page_id, CASE page_id % 13 WHEN 1 THEN 'react_root' WHEN 2 THEN 'next' ELSE '' END AS frameworks, CASE page_id % 13 WHEN 1 THEN 'root_div_only' ELSE '' END AS shells, page_id % 13 = 1 OR page_id % 13 = 2 AND page_id % 2 = 0 AS shell FROM pages",
    "parsed_pages": f"WITH {_P} SELECT page_id, title, CASE m9 WHEN 4 THEN 'x_' || regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) WHEN 5 THEN NULL ELSE regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) END AS lang, CAST(CASE WHEN m8 IN (1, 2, 3, 5) THEN 2 WHEN m8 = 4 THEN 3 ELSE 1 END AS BIGINT) AS n_headings, CAST(m5 <> 0 AS BIGINT) + CAST(page_id % 35 = 14 AS BIGINT) AS canonical_count, CASE m4 WHEN 0 THEN NULL WHEN 1 THEN 'Short.' ELSE 'A description of this café page that is long enough to be read as a summary.' END AS description, CAST(m4 <> 0 AS BIGINT) AS ld_blocks FROM p",
    "url_parts": f"WITH {_P} SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, site_id AS host, path, string_split(trim(path, '/'), '/')[1] AS segment, 'https://' || regexp_replace(url, '^https?://', '') AS normal, url LIKE 'http://ththre.example.com/%' AS same_origin, {_ROLES} ELSE 'article' END AS role FROM p",
    "cache_keys": "SELECT page_id, sha256('fetch' || chr(0) || url || chr(0)) AS key FROM pages",
    "lens_fetches": f"WITH {_P}, {_L} SELECT lens, CAST(CASE kind WHEN 'waf' THEN 403 WHEN 'down' THEN 503 WHEN 'timeout' THEN NULL ELSE 200 END AS INT) AS status, CASE WHEN kind = 'challenge' THEN 'challenge' WHEN kind IN ('waf', 'down') THEN 'waf' END AS blocked_by, CASE WHEN kind = 'challenge' THEN 'cloudflare' END AS challenge_marker, count(*) AS n, count(*) FILTER (kind IN ('waf', 'down', 'timeout')) AS errors FROM l GROUP BY ALL",
    "lens_plan": "SELECT lens, count(*) AS fetches FROM pages CROSS JOIN (VALUES ('browser'), " + ", ".join(f"('{b}')" for b in fixed.DEFAULT_BOTS) + ") AS v(lens) GROUP BY lens",
    "parity_by_bot": f"WITH {_P}, {_L} SELECT lens AS bot, count(*) AS pages, count(*) FILTER (kind IN ('waf', 'timeout')) AS other_status FROM l WHERE ord > 0 AND page_id % 41 <> 40 GROUP BY lens",
    "robots_posture": f"WITH {_P} SELECT site_id, CASE length(site_id) % 5 WHEN 1 THEN 'partial' WHEN 2 THEN CASE WHEN spath = '/' OR spath = '' OR regexp_matches(spath, '^/.*/1') THEN 'allowed' ELSE 'blocked' END WHEN 3 THEN 'partial' ELSE 'allowed' END AS posture FROM (SELECT *, regexp_extract(start_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS spath FROM s)",
    "robots_verdicts": f"""WITH {_P}, a AS (SELECT DISTINCT site_id, CASE WHEN path = '' THEN '/' ELSE path END AS path FROM p)
SELECT site_id, bot, path, length(site_id) % 5 < 4 AS robots_present, CASE length(site_id) % 5
  WHEN 1 THEN CASE WHEN bot IN ('GPTBot', 'CCBot') OR path LIKE '/private%' THEN 'blocked' ELSE 'allowed' END
  WHEN 2 THEN CASE WHEN path = '/' OR regexp_matches(path, '^/.*/1') THEN 'allowed' ELSE 'blocked' END
  WHEN 3 THEN CASE WHEN bot = 'ClaudeBot' THEN 'allowed' ELSE 'blocked' END ELSE 'allowed' END AS verdict
FROM a CROSS JOIN (VALUES {", ".join(f"('{b}')" for b in fixed.DEFAULT_BOTS)}) AS v(bot)""",
    "sitemap_files": """SELECT page_id, page_id % 5 <> 4 AS usable, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || ' 2024-05-01' || chr(10) || url || '#2' ELSE '' END AS entries,
  CASE page_id % 5 WHEN 2 THEN url || '/a.xml' || chr(10) || url || '/b.xml' ELSE '' END AS children, CAST(page_id % 5 = 3 AS INT) AS errors FROM pages""",
    "statuses_by_bot": f"WITH {_P}, {_L} SELECT site_id, lens, arg_min_null(CAST(CASE kind WHEN 'waf' THEN 403 WHEN 'down' THEN 503 WHEN 'timeout' THEN NULL ELSE 200 END AS INT), page_id) AS status FROM l GROUP BY ALL",
    "sitemap_report": f"""WITH {_P}, e AS (SELECT p.*, start_url, regexp_extract(url, '^([a-z]+):', 1) = regexp_extract(start_url, '^([a-z]+):', 1) AS own FROM p JOIN s USING (site_id) WHERE page_id % 7 <> 6),
g AS (SELECT site_id, count(*) FILTER (own) AS url_count, count(*) FILTER (NOT own) AS other, count(*) FILTER (page_id % 10 IN (2, 3, 5)) AS stale, bool_or(own AND rtrim(url, '/') = rtrim(start_url, '/')) AS inc FROM e GROUP BY site_id)
SELECT site_id, url_count IS NOT NULL AS found, coalesce(url_count, 0) AS url_count, CAST(coalesce(other, 0) > 0 AS BIGINT) + CAST(coalesce(stale, 0) > 0 AS BIGINT) AS parse_errors, coalesce(inc, false) AS includes_start_url, coalesce(stale, 0) AS stale FROM s LEFT JOIN g USING (site_id)""",
    "sitemap_sample": f"""WITH {_P}, o AS (SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY page_id) - 1 AS rn, count(*) OVER (PARTITION BY site_id) AS n FROM p JOIN s USING (site_id) WHERE page_id % 7 <> 6 AND rtrim(url, '/') <> rtrim(start_url, '/'))
SELECT site_id, CAST(rn // greatest(1, n // 3) + 1 AS INT) AS ord, url FROM o WHERE rn % greatest(1, n // 3) = 0 AND rn // greatest(1, n // 3) < 3
UNION ALL SELECT DISTINCT site_id, 0, start_url FROM p JOIN s USING (site_id) WHERE page_id % 7 <> 6""",
    "sitemap_candidates": f"""WITH {_P}, c AS (
  SELECT site_id, 0 AS src, 0 AS pos, 'http://' || site_id || '/sitemap.xml' AS url FROM s WHERE start_url LIKE 'http://%' UNION ALL SELECT site_id, 0, 2, 'http://' || site_id || '/news.xml' FROM s WHERE start_url LIKE 'http://%'
  UNION ALL SELECT site_id, 1, i, regexp_extract(start_url, '^([a-z]+://[^/]*)', 1) || f FROM s CROSS JOIN (VALUES (0, '/sitemap.xml'), (1, '/sitemap_index.xml'), (2, '/sitemap-index.xml')) AS v(i, f)
), f AS (SELECT site_id, url, min((src, pos)) AS o FROM c GROUP BY ALL) SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY o) - 1 AS INT) AS ord, url FROM f""",
    "date_values": "SELECT page_id, CASE page_id % 10 WHEN 1 THEN TIMESTAMP '2024-05-01' WHEN 2 THEN TIMESTAMP '2099-01-01' WHEN 4 THEN TIMESTAMP '2024-05-01 08:00:00' WHEN 5 THEN TIMESTAMP '1970-01-01' END AS parsed, page_id % 10 IN (2, 3, 5) AS stale FROM pages WHERE page_id % 7 <> 6",
    "blocked_addresses": rf"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}\b')) AS ip FROM documents), g AS (SELECT ip, count(*) AS n_, min(doc_id) AS first_doc FROM a GROUP BY ip),
p AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS o FROM g), q AS (SELECT *, CASE WHEN list_max(o) < 256 THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS n FROM p) SELECT ip, n_ AS n, first_doc, n IS NULL OR {_BLOCKED} AS blocked FROM (SELECT ip, n_, first_doc, n FROM q)""",
    "role_types": f"WITH {_ROLE_CTE} SELECT url, role, array_to_string(list_sort(types), ',') AS types, array_to_string(missing, ',') AS missing FROM t",
    "author_signals": f"WITH {_P} SELECT url, CASE WHEN page_id % 41 = 40 THEN NULL WHEN m4 = 1 THEN 'jsonld:author.name' WHEN m4 = 3 THEN 'jsonld:publisher' WHEN m8 = 5 THEN 'visible:heading' END AS source, CASE WHEN page_id % 41 = 40 THEN NULL WHEN m4 = 1 THEN 'Ann' WHEN m4 = 3 THEN 'Acme' WHEN m8 = 5 THEN 'About the author' END AS value FROM p",
    "page_dates": f"WITH {_P} SELECT url, CASE WHEN page_id % 41 = 40 THEN 0 ELSE CAST(m4 = 1 AS BIGINT) + CAST(m6 IN (1, 2, 3, 4) AS BIGINT) END AS dates, CAST(m6 IN (1, 4) AND page_id % 41 <> 40 AS BIGINT) AS unparseable FROM p",
    "category_scores": f"WITH {_REC}, {_CATS} SELECT * FROM c",
    "overall_scores": f"WITH {_REC}, {_CATS} SELECT site_id, coalesce(round(100.0 * sum(points) / nullif(sum(max), 0), 1), 0.0) AS overall, coalesce(round(100.0 * sum(points) / nullif(sum(max), 0), 1), 0.0) < 60 AS fails FROM c GROUP BY site_id",
    "status_counts": f"WITH {_REC} SELECT site_id, category, " + ", ".join(f"count(*) FILTER (status = '{x}') AS n_{x}" for x in fixed.STATUSES) + " FROM r WHERE weight = 0 GROUP BY ALL",
    "top_findings": f"WITH {_REC}, o AS (SELECT site_id, check_id, weight, max(status) AS status FROM r GROUP BY ALL), w AS (SELECT o.*, row_number() OVER (PARTITION BY site_id ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, o.weight DESC, k.ord) AS rank FROM o JOIN {_CATALOG} USING (check_id) WHERE status IN ('fail', 'error', 'warn')) SELECT site_id, check_id, status, CAST(rank AS INT) AS rank FROM w WHERE rank <= 8",
    "calibration": f"WITH {_REC}, o AS (SELECT site_id, check_id, max(status) AS status FROM r GROUP BY ALL) SELECT check_id, count(*) AS compared, count(*) FILTER (status <> 'warn') AS different, count(*) FILTER (status = 'fail' AND length(site_id) % 2 = 0) AS false_alarms, CAST(0 AS BIGINT) AS absent FROM o GROUP BY check_id",
    "llms_sections": f"WITH {_P}, e AS (SELECT p.site_id, rtrim(url, '/') = rtrim(start_url, '/') AS st, string_split(trim(path, '/'), '/')[1] AS seg FROM p JOIN s USING (site_id) WHERE page_id % 41 <> 40), g AS (SELECT site_id, CASE WHEN st THEN 0 WHEN seg = '' THEN 1 ELSE 2 END AS r, CASE WHEN st THEN '' ELSE seg END AS sec, count(*) AS pages FROM e GROUP BY ALL) SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY r, sec) AS INT) AS ord, pages FROM g",
    "generated_robots": f"WITH {_P} SELECT site_id, CAST({len(fixed.TRAINING_AGENTS)} AS BIGINT) AS denied, true AS allows FROM s",
    "generated_json_ld": f"WITH {_P} SELECT site_id, CASE WHEN length(site_id) % 2 = 0 THEN site_id END AS name, start_url AS url, CASE WHEN length(site_id) % 2 = 0 THEN '' ELSE 'name' END AS missing FROM s",
    "jaccard_docs_benchmark": f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), j AS (SELECT item_id, len(list_intersect(d.w, b.w)) AS n, len(d.w) + len(b.w) AS m FROM d CROSS JOIN b) SELECT item_id AS b, count(*) AS pairs, round(sum(n / (m - n)), 4) AS total, round(max(n / (m - n)), 6) AS best FROM j WHERE n > 0 GROUP BY item_id",
    "question_dedupe": "WITH q AS (SELECT conv_id, turn, text AS question, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS k FROM conversations WHERE role = 'user') SELECT conv_id, turn, question FROM q WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) = 1",
    "question_filter": r"WITH q AS (SELECT doc_id, trim(text) AS question, repeat('a', CAST(doc_id % 12 AS INT)) AS answer, trim(CASE WHEN doc_id % 3 = 0 THEN 'not there at all' ELSE text END) AS span, text FROM documents) SELECT doc_id, span <> '' AND contains(regexp_replace(lower(text), '\s+', ' ', 'g'), substr(regexp_replace(lower(span), '\s+', ' ', 'g'), 1, 80)) AS has_span FROM q WHERE length(question) >= 8 AND length(answer) >= 8 AND trim(regexp_replace(lower(question), '[^a-z0-9 ]', '', 'g')) <> ''",
    "generation_budget": "SELECT doc_id, CAST(least(2000 + 50 * 90 + floor(length(text) / 4 * 3.0), 32000) AS BIGINT) AS budget, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents",
    "chunk_docs": f"WITH {_CHUNKS} SELECT doc_id, CAST(len(lens) AS BIGINT) AS chunks, CAST(list_sum(list_transform(lens, lambda x: greatest(1, x // 4))) AS BIGINT) AS tokens, CAST(list_max(lens) AS BIGINT) AS longest FROM ck",
    "prepared_docs": f"WITH {_CHUNKS} SELECT CASE WHEN len(lens) >= 3 THEN 'chunked' ELSE 'whole_page' END AS mode, count(*) AS docs, CAST(sum(CASE WHEN len(lens) >= 3 THEN len(lens) ELSE 1 END) AS BIGINT) AS chunks FROM ck GROUP BY 1",
    "lexical_top_k": f"WITH {_LINES}, {_ASKS}, w AS (SELECT q_id, doc_id, {_WORDS.format('question')} AS q, {_WORDS.format('ln.text')} AS t FROM ak JOIN ln USING (page)), z AS (SELECT q_id, doc_id, coalesce(len(list_intersect(q, t)) / nullif(sqrt(len(q) * len(t)), 0), 0) AS score FROM w), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM z) SELECT q_id, rank, doc_id, round(score, 9) AS score FROM r WHERE rank <= 5",
    "lexical_top_k_corpus": f"WITH {_LINES}, {_ASKS}, w AS (SELECT q_id, ln.page, doc_id, {_WORDS.format('question')} AS q, {_WORDS.format('ln.text')} AS t FROM ak CROSS JOIN ln), z AS (SELECT q_id, page, doc_id, len(list_intersect(q, t)) / sqrt(len(q) * len(t)) AS score FROM w WHERE len(list_intersect(q, t)) > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, page, doc_id) AS INT) AS rank FROM z) SELECT q_id, rank, page, doc_id, round(score, 9) AS score FROM r WHERE rank <= 5",
    "vector_top_k": "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT q.vec_id AS q_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c USING (label)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, vec_id) AS INT) AS rank FROM z) SELECT q_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "eval_trials": f"WITH {_TRIALS} SELECT site_id, url, trial, n, points, abstained, wrong, hits, spans, score FROM sc",
    "eval_pages": f"WITH {_TRIALS}, {_pooled('site_id, url')} SELECT site_id, url, {_METRICS}, round(hits / nullif(spans, 0), 4) AS context_recall, questions, trials FROM e",
    "eval_sites": f"WITH {_TRIALS}, {_pooled('site_id')}, cl AS (SELECT site_id, round(avg(x), 4) AS coverage_loss FROM (SELECT site_id, url, round(avg(CAST(correct = 0 AS DOUBLE)), 4) AS x FROM q GROUP BY ALL) GROUP BY site_id) SELECT site_id, {_METRICS}, round(coalesce(hits / nullif(spans, 0), 0), 4) AS context_recall, round(coalesce(hits / nullif(spans, 0), 0) - rate, 4) AS retrieval_gap, questions, pages, trials, coverage_loss FROM e JOIN cl USING (site_id)",
    "eval_failures": f"WITH {_TRIALS} SELECT site_id, CASE WHEN NOT span_hit THEN 'content_not_in_crawler_view' WHEN incorrect > 0 OR kinds > 1 THEN 'answerer_error' ELSE 'content_ambiguous' END AS likely_cause, count(*) AS n FROM q WHERE correct < 2 GROUP BY ALL",
    "eval_gate": f"WITH {_TRIALS}, {_pooled('site_id')}, m AS (SELECT site_id, {_METRICS} FROM e), x AS (SELECT *, length(site_id) = 4 AS low, (ci_high - ci_low) / 2 > 8 AS wide FROM m) SELECT site_id, CASE WHEN low OR wide THEN false ELSE mean < 60 END AS fails, low OR wide AS noted FROM x",
    "ci95_by_lang": "WITH a AS (SELECT lang, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, n, round(greatest(0, rate - 1.96 * sqrt(rate * (1 - rate) / n)), 6) AS low, round(least(1, rate + 1.96 * sqrt(rate * (1 - rate) / n)), 6) AS high, CASE WHEN n < 50 THEN 'small' WHEN n < 200 THEN 'some' ELSE 'many' END AS size FROM a",
    "cost_estimate": """WITH d AS (SELECT source, doc_id % 7 AS chunks, greatest(1, length(text) // 4) AS page FROM documents), e AS (SELECT *, least(page, 120000) + 700 AS gen, 150 * (least(chunks * 400, page) + 260) AS ans FROM d)
SELECT source, count(*) AS pages, count(*) * 150 AS answer_calls, count(*) * 150 AS judge_calls, count(*) AS embed_calls, count(*) AS generation_calls, CAST(sum(gen + ans + 30000) AS BIGINT) AS input_tokens, count(*) * 30000 AS output_tokens, CAST(sum(chunks * 200) AS BIGINT) AS embed_tokens,
  round(sum(round(ans / 1e6 * 0.15 + 18000 / 1e6 * 0.6, 6) + round(30000 / 1e6 * 0.15 + 6000 / 1e6 * 0.6, 6) + round(gen / 1e6 * 0.15 + 6000 / 1e6 * 0.6, 6)), 3) AS cost_usd,
  round(sum(round(ans / 1e6 * 0.15 + 18000 / 1e6 * 0.6, 6) + round(30000 / 1e6 * 0.15 + 6000 / 1e6 * 0.6, 6) + round(gen / 1e6 * 0.15 + 6000 / 1e6 * 0.6, 6)), 6) > 0.5 AS exceeds FROM e GROUP BY source""",
    "price_lookup": f"WITH m AS (SELECT ['gpt-4o-mini', 'openai/gpt-4o-2024', 'glm-5.3-flashx', 'groq/llama-3.3-70b-versatile', 'unknown-1', 'text-embedding-3-small', 'nvidia/nemotron-3-embed-1b', 'CLAUDE-SONNET-4'][CAST(regexp_extract(source, '[0-9]+$') AS INT) % 8 + 1] AS model, source, count(*) AS docs, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY source), h AS (SELECT model, arg_min((prefix, input_rate, output_rate), ord) AS p FROM (SELECT DISTINCT model FROM m) JOIN {_PRICES} ON starts_with(lower(string_split(model, '/')[-1]), prefix) GROUP BY model) SELECT source, model, docs, tokens, coalesce(round(tokens / 1e6 * CAST(p[2] AS DOUBLE), 6), 0) AS cost_usd, p[1] AS prefix, CAST(p[2] AS DOUBLE) AS input_rate, CAST(p[3] AS DOUBLE) AS output_rate, contains(lower(model), 'text-embedding') OR contains(lower(model), '-embed') AS embedding FROM m LEFT JOIN h USING (model)",
    "parsed_answers": r"SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN 'quoted' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS answer, turn % 4 = 2 AS abstained, CASE turn % 4 WHEN 1 THEN '[1]' ELSE '' END AS quoted FROM conversations",
    "parsed_verdicts": "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partially_correct' WHEN 2 THEN 'incorrect' WHEN 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'abstained' ELSE 'incorrect' END ELSE 'abstained' END AS verdict FROM conversations",
    "check_acc001": _check("ACC-001", "SELECT *, length(site_id) % 5 AS m, regexp_extract(start_url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS spath FROM s", "CASE WHEN m IN (1, 3) OR m = 2 AND NOT (spath IN ('', '/') OR regexp_matches(spath, '^/.*/1')) THEN 'warn' ELSE 'pass' END"),
    "check_acc003": _check("ACC-003", "SELECT site_id, count(*) FILTER (kind IN ('waf', 'down', 'challenge')) AS bad, bool_or(kind = 'down' AND url = start_url AND ord = 0) AS st FROM l JOIN s USING (site_id) GROUP BY site_id", "CASE WHEN bad = 0 THEN 'pass' WHEN st THEN 'fail' ELSE 'warn' END", ctes=_P + ", " + _L),
    "check_dis001": _check("DIS-001", "SELECT s.site_id, count(page_id) AS n, count(page_id) FILTER (regexp_extract(url, '^([a-z]+):', 1) <> regexp_extract(start_url, '^([a-z]+):', 1) OR page_id % 10 IN (2, 3, 5)) AS bad, coalesce(bool_or(rtrim(url, '/') = rtrim(start_url, '/')), false) AS inc FROM s LEFT JOIN (SELECT * FROM p WHERE page_id % 7 <> 6) p USING (site_id) GROUP BY s.site_id", "CASE WHEN n = 0 THEN 'fail' WHEN bad > 0 OR NOT inc THEN 'warn' ELSE 'pass' END"),
    "check_dis002": _check("DIS-002", "SELECT site_id, arg_min(m11, page_id) AS first, count(*) FILTER (m11 IN (3, 5)) AS marked, count(*) FILTER (m11 IN (3, 5) AND page_id % 7 <> 6 AND regexp_extract(url, '^([a-z]+):', 1) = regexp_extract(start_url, '^([a-z]+):', 1)) AS con FROM up JOIN s USING (site_id) GROUP BY site_id", "CASE WHEN first = 3 THEN 'fail' WHEN con > 0 THEN 'warn' WHEN marked = 0 THEN 'pass' ELSE 'warn' END", ctes=_P + ", up AS (SELECT * REPLACE (CASE WHEN page_id % 41 = 40 THEN 0 ELSE m11 END AS m11) FROM p)"),
    "check_dis003": _check("DIS-003", "SELECT site_id, length(site_id) % 4 AS m FROM s", "CASE m WHEN 0 THEN 'pass' WHEN 3 THEN 'fail' ELSE 'warn' END"),
    "check_site001": _check("SITE-001", "SELECT site_id, page_id AS i, start_url FROM s JOIN p USING (site_id) WHERE p.page_id = s.first_id", "CASE WHEN start_url NOT LIKE 'https:%' THEN 'fail' WHEN i % 50 = 0 THEN 'fail' WHEN i % 2 = 1 THEN 'warn' WHEN i % 25 = 0 THEN 'warn' ELSE 'pass' END".replace("page_id", "i"), ctes=_P.replace("min(page_id) AS first_id", "min(page_id) AS first_id")),
}

# Structure checks: pages that the browser could not fetch have no tags.
_UP = _P + ", u AS (SELECT *, page_id % 41 = 40 AS down FROM p)"
_AGG = "SELECT site_id, count(*) AS pages, {} FROM u GROUP BY site_id"
ORACLE_SQL |= {
    "check_str001": _check("STR-001", "SELECT site_id, sum(k) AS pages, sum(k) FILTER (t = '') AS missing, sum(o + g) + count(*) FILTER (t <> '' AND k > 1) AS odd FROM (SELECT site_id, CASE WHEN down THEN '' ELSE title END AS t, count(*) AS k, sum(CASE WHEN down THEN 0 ELSE " + _TITLE_ODD + " END) AS o, sum(CASE WHEN down THEN 0 ELSE " + _GENERIC + " END) AS g FROM u GROUP BY ALL) GROUP BY site_id", "CASE WHEN coalesce(missing, 0) = pages THEN 'fail' WHEN coalesce(missing, 0) + odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_str002": _check("STR-002", _AGG.format("count(*) FILTER (down OR m4 = 0) AS missing, count(*) FILTER (NOT down AND m4 = 1) AS odd"), "CASE WHEN missing = pages THEN 'fail' WHEN missing + odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_str003": _check("STR-003", _AGG.format("count(*) FILTER (down OR m5 = 0) AS missing, count(*) FILTER (NOT down AND m5 <> 0 AND (m5 IN (1, 2) OR page_id % 35 = 14)) AS odd"), "CASE WHEN missing = pages THEN 'fail' WHEN missing + odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_str004": _check("STR-004", _AGG.format("count(*) FILTER (down) AS none, count(*) FILTER (NOT down AND m8 = 3) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_str005": _check("STR-005", _AGG.format("count(*) FILTER (down) AS none, count(*) FILTER (NOT down AND m8 IN (1, 2, 4)) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_str006": _check("STR-006", _AGG.format("count(*) FILTER (down OR m9 = 5) AS none, count(*) FILTER (NOT down AND m9 = 4) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN none + odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_sd001": _check("SD-001", _AGG.format("count(*) FILTER (down OR m4 = 0) AS none, count(*) FILTER (NOT down AND m4 = 2) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_sd003": _check("SD-003", _AGG.format("count(*) FILTER (down OR m3 = 0 AND m2 = 1) AS none, count(*) FILTER (down OR m3 <> 1 OR m2 = 1) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_tru001": _check("TRU-001", _AGG.format("count(*) FILTER (down OR m4 <> 1 AND m6 IN (0, 5)) AS none"), "CASE WHEN none = pages THEN 'fail' ELSE 'warn' END", ctes=_UP),
    "check_tru002": _check("TRU-002", _AGG.format("count(*) FILTER (down OR NOT (m4 IN (1, 3) OR m8 = 5)) AS none, count(*) FILTER (NOT down AND m4 = 3) AS odd"), "CASE WHEN none = pages THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_UP),
    "check_sd002": _check("SD-002", "SELECT t.site_id, count(*) AS pages, count(*) FILTER (down OR len(types) = 0) AS none, bool_or(url = start_url AND path IN ('', '/', '/index.html') AND (down OR NOT list_contains(types, 'Organization'))) AS home, count(*) FILTER (down OR len(missing) > 0) AS odd FROM (SELECT *, page_id % 41 = 40 AS down FROM t) t JOIN s USING (site_id) GROUP BY t.site_id", "CASE WHEN none = pages THEN 'fail' WHEN home THEN 'fail' WHEN odd > 0 THEN 'warn' ELSE 'pass' END", ctes=_ROLE_CTE),
}

ORACLE_SQL |= {
    "span_recall": f"""WITH {_LINES}, {_ASKS}, a AS (SELECT *, CASE WHEN q_id % 5 < 4 THEN question ELSE '' END AS span FROM ak),
w AS (SELECT q_id, doc_id, span, ln.text, {_WORDS.format('question')} AS q, {_WORDS.format('ln.text')} AS t FROM a JOIN ln USING (page)),
r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY coalesce(len(list_intersect(q, t)) / nullif(sqrt(len(q) * len(t)), 0), 0) DESC, doc_id) <= 5),
k AS (SELECT *, substr(trim(regexp_replace(lower(span), '\\s+', ' ', 'g')), 1, 120) AS needle, regexp_replace(lower(text), '\\s+', ' ', 'g') AS hay FROM r)
SELECT q_id, bool_or(span <> '') AS has_span, bool_or(needle <> '' AND (contains(hay, needle) OR contains(hay, array_to_string(string_split(trim(needle), ' ')[1:12], ' ')))) AS span_hit FROM k GROUP BY q_id""",
    "check_acc002": _check("ACC-002", "SELECT site_id, max(share) AS worst FROM (SELECT site_id, lens, round(count(*) FILTER (kind <> 'same') / count(*), 4) AS share FROM l WHERE ord > 0 AND page_id % 41 <> 40 GROUP BY ALL) RIGHT JOIN s USING (site_id) GROUP BY site_id", "CASE WHEN worst IS NULL THEN 'skip' WHEN worst > 0.5 THEN 'fail' WHEN worst > 0 THEN 'warn' ELSE 'pass' END", ctes=_P + ", " + _L),
}


# Main text in SQL, by rules for the pages at hand: links lie in their navigation alone, so
# without it, the advertisement and the footer every block stays. Marks stand for tags.


def _re(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def _bare(x: str) -> str:
    """Without comments, scripts, styles, the head, and a tag that is cut off."""
    x = _re(f"coalesce({x}, '')", r"<[^<>]*\z")
    for start, end in (("<!--", "-->"), *((rf"<{t}\b", f"</{t}>") for t in ("script", "style", "head"))):
        x = _re(x, rf"(?is){start}.*?(?:{end}|\z)")
    return x


def _marked(x: str) -> str:
    """Lines by chr(10), blocks by chr(1), levels of headings after chr(6), article between chr(2) and chr(3),
    links between chr(4) and chr(5); entities resolved."""
    x = _re(_re(x, r"\s+", "' '"), "(?i)<br[^>]*>", "chr(10)")
    x = _re(_re(x, r"(?i)<a\b[^>]*>", "chr(4)"), "(?i)</a>", "chr(5)")
    x = _re(_re(x, "(?i)<h([1-6])[^>]*>", r"chr(1) || chr(6) || '\1'"), "(?i)<article[^>]*>", "chr(1) || chr(2)")
    x = _re(_re(x, "(?i)</article>", "chr(1) || chr(3)"), r"(?i)</?(?:p|div|li|ul|body|html|h[1-6])\b[^>]*>", "chr(1)")
    x = _re(x, "<[^>]*>")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "\xa9"), ("&middot;", "\xb7"), ("&nbsp;", " ")):
        x = f"replace({x}, '{code}', '{char}')"
    return _re(x, "&amp;?", "'&'")


def _lines(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '[\x02-\x05]|\x06[1-6]', '', 'g'), chr(10)), lambda v: trim(regexp_replace(v, ' +', ' ', 'g'))), lambda v: v <> '')"


def _main(table: str, cols: str, x: str) -> str:
    """``cols`` of ``table`` with text, mode and html_chars of ``x``."""
    bare = _bare(x)
    for start, end in (("<nav>", "</nav>"), ('<div class="ad">', "</div>"), ("<footer>", "</footer>")):
        bare = _re(bare, rf"(?is){start}.*?(?:{end}|\z)", "chr(1)") if start[1] != "d" else _re(bare, rf"(?is){start}.*?(?:{end}|\z)", "'<p>'")
    level = r"regexp_extract(v, '\x06([1-6])', 1)"
    one = f"CASE WHEN {level} = '' THEN array_to_string({_lines('v')}, chr(10)) WHEN len({_lines('v')}) > 0 THEN repeat('#', CAST({level} AS INT)) || ' ' || array_to_string({_lines('v')}, ' ') ELSE '' END"
    return f"""SELECT *, CASE WHEN text = '' THEN 'none' ELSE 'recall' END AS mode FROM (
  SELECT * EXCLUDE (marked), array_to_string(list_filter(list_transform(string_split(marked, chr(1)), lambda v: {one}), lambda v: v <> ''), chr(10)) AS text
  FROM (SELECT {cols}, length(coalesce({x}, '')) AS html_chars, {_marked(bare)} AS marked FROM {table}))"""


_PLAIN = """replace(replace(replace(html, 'nav>', 'div>'), ' class="ad"', ''), 'footer>', 'div>')"""
_NEAR = "last_value(CASE WHEN kind IN ('long', 'links') THEN kind END IGNORE NULLS) OVER (PARTITION BY page_id{} ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {}, first_value(CASE WHEN kind IN ('long', 'links') THEN kind END IGNORE NULLS) OVER (PARTITION BY page_id{} ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS {}"
_NEXT = "coalesce(CASE WHEN kind = 'heading' THEN first_value({0} IGNORE NULLS) OVER (PARTITION BY page_id{1} ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE {0} END, {2}) AS {3}"
_MAIN_BLOCKS = f"""WITH m AS (SELECT page_id, string_split({_marked(_bare(_PLAIN))}, chr(1)) AS pieces FROM pages),
u AS (SELECT page_id, unnest(pieces) AS v, generate_subscripts(pieces, 1) AS i FROM m),
t AS (SELECT page_id, i, v, {_lines('v')} AS ls, regexp_extract(v, '\\x06([1-6])', 1) AS lv, sum(CASE WHEN contains(v, chr(2)) THEN 1 WHEN contains(v, chr(3)) THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS zone FROM u),
b AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS block, zone, CASE WHEN lv = '' THEN 0 ELSE CAST(lv AS INT) END AS level, CASE WHEN lv = '' THEN array_to_string(ls, chr(10)) ELSE array_to_string(ls, ' ') END AS text,
  CAST(length(regexp_replace(array_to_string(regexp_extract_all(v, '\\x04([^\\x05]*)', 1), ''), '\\s', '', 'g')) AS INT) AS link_chars FROM t WHERE len(ls) > 0),
k AS (SELECT *, CASE WHEN level > 0 THEN 'heading' WHEN 3 * link_chars > length(regexp_replace(text, '\\s', '', 'g')) THEN 'links' WHEN length(text) < 70 THEN 'short' ELSE 'long' END AS kind FROM b),
n AS (SELECT *, {_NEAR.format("", "ba", "", "aa")}, {_NEAR.format(", zone", "bz", ", zone", "az")} FROM k),
f AS (SELECT *, CASE WHEN zone = 1 AND coalesce(bz, az) IS NOT NULL THEN list_filter([bz, az], lambda x: x IS NOT NULL) ELSE list_filter([ba, aa], lambda x: x IS NOT NULL) END AS near FROM n),
r AS (SELECT *, CASE kind WHEN 'long' THEN true WHEN 'links' THEN false WHEN 'short' THEN NOT list_contains(near, 'links') OR (near <> ['links', 'links'] AND link_chars = 0) END AS rk,
  CASE WHEN kind = 'long' THEN true WHEN kind = 'links' THEN false WHEN kind = 'short' THEN coalesce(bz, az) IS NOT NULL AND coalesce(bz, 'long') = 'long' AND coalesce(az, 'long') = 'long' END AS pk FROM f)
SELECT page_id, block, level, kind, CAST(length(text) AS INT) AS chars, link_chars, md5(text) AS text_md5, {_NEXT.format("rk", "", "true", "recall")}, zone = 1 AND {_NEXT.format("pk", ", zone", "false", "precision").replace(" AS precision", "")} AS precision FROM r"""
_DUCK = lambda e: re.sub(r"pmod\(([^,()]+), (\d+)\)", r"((\1) % \2)", e)
_HTML = f"CASE WHEN contains(html, '</body>') THEN replace(replace({_DUCK(sim.LANG)}, '</head>', {_DUCK(sim.HEAD)}), '</body>', {_DUCK(sim.BODY)}) ELSE replace({_DUCK(sim.LANG)}, '</head>', {_DUCK(sim.HEAD)}) || {_DUCK(sim.BODY)} END"
_SIM = f"""{_P}, x0 AS (SELECT page_id, url, site_id, {_HTML} AS h FROM p), x AS (
  SELECT *, CASE WHEN page_id % 41 = 40 THEN NULL ELSE h END AS shown, CASE WHEN page_id % 3 = 0 THEN replace(h, '</article>', '<p>' || repeat('Rendered words of this page. ', CAST(100 * (page_id % 4) AS INT)) || '</p></article>') END AS ren FROM x0
), nv AS ({_main("x", "page_id, url, site_id, shown", "shown")}), rv AS ({_main("x", "page_id, url", "ren")})"""
_LOW = "contains(lower(coalesce(shown, '')), '"
_SHELL = "(" + " OR ".join(f"{_LOW}{n.lower().replace(chr(39), chr(39) * 2)}')" for ns in fixed.SHELL_MARKERS.values() for n in ns) + ")"
_SIMILAR = "CASE WHEN len(a) + len(b) = 0 THEN NULL ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END"

ORACLE_SQL |= {
    "main_text": f"WITH m AS ({_main('pages', 'page_id', 'html')}) SELECT page_id, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5, mode, CASE WHEN html_chars > 0 THEN round(length(text) / html_chars, 5) ELSE 0.0 END AS ratio FROM m",
    "main_blocks": _MAIN_BLOCKS,
    "check_ren001": _check("REN-001", f"SELECT site_id, count(*) AS pages, bool_or(rch > 0) AS compared, count(*) FILTER (rch >= 400) AS usable, avg(round(ch / rch, 4)) FILTER (rch >= 400) AS mr, count(*) FILTER (ch < 300) AS empty, count(*) FILTER (ch < 1200) AS small, bool_or({_SHELL}) AS sh FROM (SELECT nv.site_id, nv.shown, length(nv.text) AS ch, CASE WHEN nv.page_id % 3 = 0 THEN length(rv.text) ELSE 0 END AS rch FROM nv JOIN rv USING (page_id)) GROUP BY site_id",
        "CASE WHEN compared AND usable = 0 THEN 'skip' WHEN compared AND mr >= 0.8 THEN 'pass' WHEN compared AND mr >= 0.4 THEN 'warn' WHEN compared THEN 'fail' WHEN empty > 0 AND sh THEN 'fail' WHEN sh OR small > 0 THEN 'warn' ELSE 'pass' END",
        "CASE WHEN compared THEN 'high' WHEN empty > 0 AND sh THEN 'high' WHEN sh THEN 'low' ELSE 'medium' END", ctes=_SIM),
    "check_ren002": _check("REN-002", "SELECT site_id, count(*) FILTER (length(text) < 100) AS thin, count(*) FILTER (length(text) >= 100 AND length(text) < 300 OR html_chars > 20000 AND length(text) / html_chars < 0.01) AS weak FROM nv GROUP BY site_id", "CASE WHEN thin > 0 THEN 'fail' WHEN weak > 0 THEN 'warn' ELSE 'pass' END", ctes=_SIM),
    "parity_rows": f"""WITH {_SIM}, {_L}, hv AS ({_main("(SELECT page_id, substr(h, 1, CAST(length(h) // 2 AS INT)) AS hh FROM x)", "page_id, hh", "hh")}),
w AS (SELECT nv.page_id, nv.url, nv.shown, {_WORDS.format("nv.text")} AS a, hv.hh, {_WORDS.format("hv.text")} AS half FROM nv JOIN hv USING (page_id)),
r AS (SELECT w.url, l.lens AS bot, l.kind, shown, a, CASE l.kind WHEN 'same' THEN a WHEN 'half' THEN half WHEN 'challenge' THEN ['wait'] ELSE CAST([] AS VARCHAR[]) END AS b, CASE l.kind WHEN 'same' THEN strlen(shown) WHEN 'half' THEN strlen(hh) WHEN 'challenge' THEN {len(sim.CHALLENGE)} ELSE 0 END AS bytes FROM w JOIN l USING (page_id) WHERE l.ord > 0 AND w.page_id % 41 <> 40),
z AS (SELECT *, {_SIMILAR} AS similarity FROM r)
SELECT url, bot, kind NOT IN ('waf', 'timeout') AS status_match, round(bytes / strlen(shown), 4) AS size_ratio, similarity, kind IN ('waf', 'timeout') OR coalesce(similarity < 0.9, false) OR bytes = 0 AS diverged FROM z""",
}


def _scored(categories: tuple[str, ...]) -> str:
    """Rows of the scored checks of some categories."""
    parts = (f"SELECT '{c}' AS category, * FROM ({ORACLE_SQL['check_' + i.lower().replace('-', '')]})" for i, c, _, w in fixed.CATALOG if w and c in categories)
    return " UNION ALL ".join(parts)


_BY_CATEGORY = "g AS (SELECT site_id, category, round(coalesce(sum(points) FILTER (status <> 'skip'), 0), 2) AS points, round(CAST(coalesce(sum(weight) FILTER (status <> 'skip'), 0) AS DOUBLE), 2) AS max FROM r GROUP BY ALL), o AS (SELECT site_id, coalesce(round(100.0 * sum(points) / nullif(sum(max), 0), 1), 0.0) AS overall FROM g GROUP BY site_id)"
ORACLE_SQL |= {
    "scores": f"WITH r AS ({_scored(fixed.SCORED_CATEGORIES)}), {_BY_CATEGORY} SELECT site_id, category, points, max, overall FROM g JOIN o USING (site_id)",
    "site_reports": f"WITH r AS ({_scored(('access', 'rendering'))}), {_BY_CATEGORY} SELECT site_id, overall, '1.0.0' AS version FROM o",
}


# The evaluation, from texts to metrics: chunks by a fold over sentences, the two best by words.
_EVAL = rf"""
d AS (SELECT source AS site_id, doc_id AS q_id, text, substr(text, 1, 60) AS question, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 100, 80) END AS span FROM documents WHERE trim(text) <> ''),
bl AS (SELECT q_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS block FROM d),
fo AS (
  SELECT q_id, block, list_reduce(list_transform({_SENT}, lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': x, 'size': CAST(greatest(1, length(x) // 4) AS INT)}}),
    lambda a, x: CASE WHEN a.size + x.size > 400 THEN {{'out': list_append(a.out, a.cur), 'cur': x.cur, 'size': x.size}} ELSE {{'out': a.out, 'cur': a.cur || ' ' || x.cur, 'size': a.size + x.size}} END) AS f
  FROM bl WHERE block <> ''
), cl AS (SELECT q_id, CASE WHEN greatest(1, length(block) // 4) > 400 THEN list_append(f.out, f.cur) ELSE [block] END AS parts FROM fo),
cc AS (SELECT q_id, CASE WHEN len(parts) >= 3 THEN parts ELSE [regexp_replace(d.text, '^\s+|\s+$', '', 'g')] END AS parts, len(parts) >= 3 AS chunked FROM cl JOIN d USING (q_id)),
ck AS (SELECT q_id, unnest(parts) AS text, unnest(range(len(parts))) AS idx FROM cc),
w AS (SELECT q_id, idx, ck.text, {_WORDS.format("question")} AS q, {_WORDS.format("ck.text")} AS t FROM ck JOIN d USING (q_id)),
z AS (SELECT *, coalesce(len(list_intersect(q, t)) / nullif(sqrt(len(q) * len(t)), 0), 0) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, idx) AS rank FROM z QUALIFY rank <= 2),
pr AS (SELECT q_id, sum(length('[' || rank || '] (relevance ' || printf('%.3f', score) || ')' || chr(10) || r.text)) + 2 * (count(*) - 1) + length(any_value(question)) + length({{prompt}}) AS prompt_chars,
  bool_or(span <> '' AND (contains(regexp_replace(lower(r.text), '\s+', ' ', 'g'), substr(trim(regexp_replace(lower(span), '\s+', ' ', 'g')), 1, 120)) OR contains(regexp_replace(lower(r.text), '\s+', ' ', 'g'), array_to_string(string_split(trim(substr(trim(regexp_replace(lower(span), '\s+', ' ', 'g')), 1, 120)), ' ')[1:12], ' '))) AND trim(regexp_replace(span, '\s+', ' ', 'g')) <> '') AS span_hit
  FROM r JOIN d USING (q_id) GROUP BY q_id),
o AS (
  SELECT d.site_id, 'd' || q_id AS url, q_id, trial, span <> '' AS has_span, span_hit, prompt_chars, h IN (7, 8) AS failed, CASE WHEN h < 6 THEN 'yes' WHEN h = 9 THEN '' ELSE 'NOT_FOUND' END AS answer, h >= 6 AS abstained, CASE WHEN h < 6 THEN '[1]' ELSE '' END AS quoted,
         CASE WHEN h IN (6, 7, 8) OR j = 4 THEN 'abstained' WHEN j = 0 THEN 'correct' WHEN j = 1 THEN 'partially_correct' WHEN j = 2 THEN 'incorrect' WHEN h = 9 THEN 'abstained' ELSE 'incorrect' END AS verdict
  FROM (SELECT *, (q_id * 7 + trial * 3) % 10 AS h, (q_id + trial) % 5 AS j FROM d CROSS JOIN (VALUES (0), (1), (2)) AS v(trial)) d JOIN pr USING (q_id)
)""".replace("{prompt}", "'" + (fixed.ANSWER_PROMPT.replace("{context}", "").replace("{question}", "")) + "'")
_OUTCOMES = """
b AS (
  SELECT site_id, url, trial, count(*) AS n, sum(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END)::DOUBLE AS points, count(*) FILTER (NOT failed AND verdict = 'abstained') AS abstained,
         count(*) FILTER (NOT failed AND verdict = 'incorrect') AS wrong, count(*) FILTER (has_span AND span_hit) AS hits, count(*) FILTER (has_span) AS spans, count(DISTINCT q_id) AS questions
  FROM o GROUP BY ALL
), sc AS (SELECT *, round(100.0 * points / n, 4) AS score FROM b),
q AS (SELECT site_id, q_id, count(*) FILTER (verdict = 'correct') AS correct FROM o GROUP BY ALL)"""
ORACLE_SQL |= {
    "eval_outcomes": f"WITH {_EVAL} SELECT q_id, trial, answer, abstained, quoted, verdict, has_span, span_hit, failed, CAST(prompt_chars AS BIGINT) AS prompt_chars FROM o",
    "eval_answers": f"""WITH {_EVAL}, {_OUTCOMES}, {_pooled('site_id')}, cv AS (SELECT site_id, round(avg(round(CAST(correct = 0 AS DOUBLE), 4)), 4) AS coverage_loss, least(100, count(*) FILTER (correct < 2)) AS n_failures FROM q GROUP BY site_id),
sh AS (SELECT site_id, count(*) AS chunk_count, CASE WHEN bool_or(NOT chunked) THEN 'whole_page' ELSE 'chunked' END AS mode FROM ck JOIN cc USING (q_id) JOIN d USING (q_id) GROUP BY site_id), ts AS (SELECT site_id, md5(string_agg(CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY url, trial)) AS per_trial FROM sc GROUP BY site_id),
fq AS (SELECT o.site_id, 'd' || q_id AS url, q_id, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(DISTINCT verdict) AS kinds, bool_or(span_hit) AS hit, string_agg(verdict, ',' ORDER BY trial) AS said FROM o GROUP BY ALL),
fl AS (SELECT f.site_id, row_number() OVER (PARTITION BY f.site_id ORDER BY url, q_id) AS i, concat_ws('|', url, question, substr(text, 61, 40), said, CAST(hit AS VARCHAR), CASE WHEN NOT hit THEN 'content_not_in_crawler_view' WHEN incorrect > 0 OR kinds > 1 THEN 'answerer_error' ELSE 'content_ambiguous' END) AS line FROM fq f JOIN d USING (q_id) WHERE correct < 2),
fs AS (SELECT site_id, md5(string_agg(line, chr(10) ORDER BY i)) AS failures FROM fl WHERE i <= 100 GROUP BY site_id)
SELECT site_id, {_METRICS}, round(coalesce(hits / nullif(spans, 0), 0), 4) AS context_recall, round(coalesce(hits / nullif(spans, 0), 0) - rate, 4) AS retrieval_gap, coverage_loss, pages, trials, chunk_count, mode, n_failures, per_trial, failures
FROM e JOIN cv USING (site_id) JOIN sh USING (site_id) JOIN ts USING (site_id) LEFT JOIN fs USING (site_id)""",
}

_PURPOSES = "(VALUES " + ", ".join(f"('{b[0]}', '{b[3]}')" for b in fixed.BOTS if b[0] in fixed.DEFAULT_BOTS) + ") AS v(bot, purpose)"
ORACLE_SQL |= {
    "access_evidence": f"""WITH {_SIM}, {_L}, sp AS (SELECT site_id, first_id, length(site_id) % 5 AS m, coalesce(nullif(regexp_extract(start_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS spath FROM s),
vb AS (SELECT site_id, bot, purpose FROM sp CROSS JOIN {_PURPOSES} WHERE CASE m WHEN 1 THEN bot IN ('GPTBot', 'CCBot') OR spath LIKE '/private%' WHEN 2 THEN NOT (spath = '/' OR regexp_matches(spath, '^/.*/1')) WHEN 3 THEN bot <> 'ClaudeBot' ELSE false END),
bl AS (SELECT site_id, string_agg(bot, ',' ORDER BY bot) AS blocked, string_agg(purpose || ':' || bot, ',' ORDER BY purpose, bot) AS by_purpose FROM vb GROUP BY site_id),
rn AS (SELECT nv.site_id, nv.page_id, nv.url, length(nv.text) AS ch, CASE WHEN nv.page_id % 3 = 0 THEN length(rv.text) ELSE 0 END AS rch FROM nv JOIN rv USING (page_id)),
ra AS (SELECT site_id, arg_min(url, (round(ch / rch, 4), page_id)) FILTER (rch >= 400) AS worst_page, count(*) FILTER (ch < 1200) AS small, list_sort(list(ch))[count(*) // 2 + 1] AS median_chars, count(*) FILTER (ch < 100) AS thin FROM rn GROUP BY site_id),
ab AS (SELECT site_id, count(*) FILTER (kind IN ('waf', 'down', 'challenge')) AS blocked_responses, count(*) AS responses FROM l GROUP BY site_id)
SELECT site_id, coalesce(blocked, '') AS blocked, coalesce(by_purpose, '') AS by_purpose, CASE WHEN first_id % 2 = 0 THEN CAST(63072000 AS BIGINT) END AS hsts_max_age, CAST(CASE WHEN first_id % 50 = 0 OR first_id % 25 = 0 THEN 2 WHEN first_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS hops,
  worst_page, small, CAST(median_chars AS BIGINT) AS median_chars, thin, blocked_responses, responses FROM sp LEFT JOIN bl USING (site_id) JOIN ra USING (site_id) JOIN ab USING (site_id)""",
    "structure_evidence": f"WITH {_UP} SELECT site_id, count(*) AS pages, " + ", ".join(f"count(*) FILTER ({cond}) AS {name}" for name, cond in (
        ("description_missing", "down OR m4 = 0"), ("description_out", "NOT down AND m4 = 1"), ("canonical_absent", "down OR m5 = 0"), ("canonical_odd", "NOT down AND m5 <> 0 AND (m5 IN (1, 2) OR page_id % 35 = 14)"),
        ("h1_none", "down"), ("h1_multiple", "NOT down AND m8 = 3"), ("h1_empty", "false"), ("headings_none", "down"), ("headings_bad", "NOT down AND m8 IN (1, 2, 4)"), ("headings_worse", "false"), ("lang_absent", "down OR m9 = 5"), ("lang_invalid", "NOT down AND m9 = 4"),
        ("ld_none", "down OR m4 = 0"), ("ld_unparsed", "NOT down AND m4 = 2"), ("ld_untyped", "false"), ("og_none", "down OR m3 = 0 AND m2 = 1"), ("og_problems", "down OR m3 <> 1 OR m2 = 1"))) + " FROM u GROUP BY site_id",
}

# Chunks of documents with headings (see queries.headed), 60 tokens, an overlap of 12 at most: a fold over blocks.
_SIZE = "CAST(greatest(1, length({}) // 4) AS INT)"
_NO_OUT = "CAST([] AS STRUCT(path VARCHAR, text VARCHAR, tokens INT)[])"
_PUT = "[{{'path': a.path, 'text': array_to_string(a.held, chr(10) || chr(10)), 'tokens': {}}}]"
_WIDE = _PUT.format(_SIZE.format("array_to_string(a.held, chr(10) || chr(10))"))
_FIT = "list_max(list_filter(range(len(a.held) + 1), lambda m: coalesce(list_sum(list_transform(a.held[len(a.held) - m + 1:], lambda y: greatest(1, length(y) // 4))), 0) <= 12))"
_TAIL = f"a.held[len(a.held) - {_FIT} + 1:]"
ORACLE_SQL["chunk_rows"] = rf"""
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
lb AS (SELECT doc_id, i, trim(raw, ' ' || chr(9) || chr(13)) AS line, CASE WHEN doc_id % 3 <> 0 THEN (i + 1) // 7 ELSE 0 END AS g FROM ln WHERE doc_id % 3 = 0 OR i % 7 <> 6),
bk AS (SELECT doc_id, g, string_agg(line, chr(10) ORDER BY i) AS block FROM lb WHERE line <> '' GROUP BY ALL),
bp AS (SELECT *, {_SIZE.format("block")} AS n, CASE WHEN g = 0 THEN '' ELSE array_to_string(list_transform(range(g - (g - 1) % 3, g + 1), lambda k: 'Part ' || (7 * k - 1)), ' > ') END AS path FROM bk),
pk AS (
  SELECT *, CASE WHEN n > 60 THEN list_reduce(list_transform({_SENT}, lambda x: {{'out': CAST([] AS VARCHAR[]), 'cur': x, 'size': {_SIZE.format("x")}}}),
    lambda a, x: CASE WHEN a.size + x.size > 60 THEN {{'out': list_append(a.out, a.cur), 'cur': x.cur, 'size': x.size}} ELSE {{'out': a.out, 'cur': a.cur || ' ' || x.cur, 'size': a.size + x.size}} END) END AS f
  FROM bp
), el AS (
  SELECT doc_id, list_concat([{{'out': {_NO_OUT}, 'held': CAST([] AS VARCHAR[]), 'total': CAST(0 AS INT), 'path': '', 'pieces': CAST([] AS VARCHAR[])}}],
    list({{'out': {_NO_OUT}, 'held': [block], 'total': n, 'path': path, 'pieces': CASE WHEN n > 60 THEN list_append(f.out, f.cur) ELSE CAST([] AS VARCHAR[]) END}} ORDER BY g)) AS els
  FROM pk GROUP BY doc_id
), fo AS (
  SELECT doc_id, list_reduce(els, lambda a, x: CASE
    WHEN x.total > 60 THEN {{'out': list_concat(a.out, CASE WHEN len(a.held) > 0 THEN {_PUT.format(_SIZE.format("array_to_string(a.held, ' ')"))} ELSE {_NO_OUT} END, list_transform(x.pieces, lambda y: {{'path': x.path, 'text': y, 'tokens': {_SIZE.format("y")}}})),
      'held': CAST([] AS VARCHAR[]), 'total': CAST(0 AS INT), 'path': x.path, 'pieces': CAST([] AS VARCHAR[])}}
    WHEN len(a.held) > 0 AND a.total + x.total > 60 THEN {{'out': list_concat(a.out, {_WIDE}), 'held': list_concat({_TAIL}, x.held), 'total': CAST({_SIZE.format(f"array_to_string({_TAIL}, ' ')")} + x.total AS INT), 'path': x.path, 'pieces': CAST([] AS VARCHAR[])}}
    ELSE {{'out': a.out, 'held': list_concat(a.held, x.held), 'total': CAST(a.total + x.total AS INT), 'path': x.path, 'pieces': CAST([] AS VARCHAR[])}} END) AS a
  FROM el
), oc AS (SELECT doc_id, CASE WHEN len(a.held) > 0 THEN list_concat(a.out, {_WIDE}) ELSE a.out END AS cs FROM fo),
ch AS (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM oc)
SELECT doc_id, CAST(i AS INT) AS chunk_idx, c.path AS heading_path, c.tokens AS tokens, CAST(length(c.text) AS BIGINT) AS chars, md5(c.text) AS md5 FROM ch"""
