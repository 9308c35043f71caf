"""The registered queries as plain SQL for another engine (DuckDB dialect).

Each text is one statement: the CTEs of the derived tables it needs, then the query.
"""

from __future__ import annotations

import re

from leafmeter.limits import BOT_PATTERNS, BROWSER_WORDS, CLIENT_PREFIXES, KEY_PREFIX
from leafmeter.operators.hits import REPORT_FOOTER
from leafmeter.sources.fixtures import HOST, NOW, SALT, UPLOAD_AGENTS, USER_AGENTS, YEAR_2024

CUTOFF = NOW - 7_776_000
TODAY = NOW // 86_400
FIRST_DAY = TODAY - 29


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def slug(page: str) -> str:
    return f"substr(sha256('slug:' || ({page})), 1, 12)"


def key_letter(index: str) -> str:
    return f"('{KEY_PREFIX}' || repeat(chr((65 + ({index}) % 5)::INT), 43))"


def key_hash(index: str) -> str:
    return f"sha256{key_letter(index)}"


def salted(prefix: str, number: str) -> str:
    return f"sha256('{SALT}:{prefix}' || ({number}))"


def object_key(s: str, v: str) -> str:
    return f"(CASE WHEN {v} <= 1 THEN 'shares/' || {s} || '.html' ELSE 'shares/' || {s} || '/v' || ({v}) || '.html' END)"


def bytes_of(value: str) -> str:
    return f"octet_length(encode({value}))"


def is_bot(ua: str) -> str:
    return f"coalesce(regexp_matches({ua}, '(?i){'|'.join(BOT_PATTERNS)}'), false)"


_IP6 = r"\[[0-9A-Fa-f:.]+\]"
_PORT = r"(?::([0-9]*))?"


def written(raw: str) -> str:
    """The stored form of a raw referrer, through a list of parts bound once."""
    url = f"regexp_replace(regexp_replace({raw}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\n\\r]', '', 'g')"
    web = r"^(?:[^@]*@)*(" + _IP6 + r"|[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]+)" + _PORT + "$"
    other = r"^(?:[^@]*@)*(" + _IP6 + r"|[^\x00\x20#/:<>?@\[\\\]^|]*)" + _PORT + "$"
    return f"""(SELECT CASE
        WHEN raw IS NULL OR raw = '' THEN NULL
        WHEN scheme = '' THEN 'other'
        WHEN scheme IN ('http','https','ws','wss','ftp') THEN
            CASE WHEN NOT regexp_matches(web_auth, '{web}') OR coalesce(try_cast(nullif(regexp_extract(web_auth, '{web}', 2), '') AS HUGEINT), 0) > 65535 THEN 'other'
                 ELSE nullif(left(regexp_replace(lower(regexp_extract(web_auth, '{web}', 1)), '^www\\.', ''), 253), '') END
        WHEN scheme = 'file' THEN nullif(nullif(lower(file_auth), 'localhost'), '')
        WHEN NOT regexp_matches(auth, '{other}') THEN 'other'
        ELSE nullif(left(regexp_replace(regexp_extract(auth, '{other}', 1), '^www\\.', ''), 253), '') END
      FROM (SELECT raw, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
                   regexp_extract(url, '^[^:]*:[/\\\\]*([^/\\\\?#]*)', 1) AS web_auth,
                   regexp_extract(url, '^[^:]*:[/\\\\]{{2}}([^/\\\\?#]*)', 1) AS file_auth,
                   regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS auth
            FROM (SELECT {raw} AS raw, {url} AS url)))"""


def label(stored: str) -> str:
    host = "^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*$"
    return f"""(CASE WHEN {stored} IS NULL OR {stored} = '' THEN 'direct' WHEN {stored} = 'other' THEN 'other'
        WHEN regexp_matches({stored}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN coalesce({written(stored)}, 'direct')
        WHEN regexp_matches({stored}, '{host}') THEN left({stored}, 253) ELSE 'other' END)"""


def channel(ua: str) -> str:
    prefixes = " ".join(f"WHEN starts_with({ua}, {text(p)}) THEN {text(c)}" for p, c in CLIENT_PREFIXES)
    return f"""(CASE WHEN {ua} IS NULL OR {ua} = '' THEN 'other' {prefixes}
        WHEN regexp_matches({ua}, {text(BROWSER_WORDS)}) THEN 'web' ELSE 'other' END)"""


def cursor(created: str, s: str) -> str:
    return f"rtrim(translate(to_base64(encode({created} || ':' || {s})), '+/', '-_'), '=')"


def iso(seconds: str) -> str:
    return f"strftime(make_timestamp(({seconds}) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"


def day_text(day: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST({day} AS INTEGER), '%Y-%m-%d')"


GOOD_BEARER = f"'^Bearer\\s+{KEY_PREFIX}[A-Za-z0-9_-]{{43}}$'"
C0 = f"({NOW} - ((page_id * 7919) % 200) * 86400 - (page_id % 86400))"

CTE: dict[str, str] = {}
CTE["np"] = "SELECT count(*) AS n FROM pages"
CTE["fx_events"] = "SELECT event_id AS i, user_id AS u, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events"
CTE["fx_shares"] = f"""SELECT page_id, {slug('page_id')} AS slug,
    CASE WHEN page_id % 10 = 0 THEN 'deleted' WHEN page_id % 10 = 1 THEN 'pending' ELSE 'committed' END AS status,
    sha256('tok-' || page_id) AS edit_token_hash,
    CASE WHEN page_id % 10 = 1 THEN {NOW} - (page_id % 40) * 20 ELSE {C0} END AS created_at,
    {salted('10.0.0.', 'page_id % 50')} AS sender_ip_hash,
    {bytes_of('html')} AS content_size,
    ['mcp', 'skill', 'curl', 'other', 'web', 'web'][page_id % 6 + 1] AS client,
    1 + page_id % 14 AS latest_version,
    CASE WHEN page_id % 2 = 0 THEN greatest(1, page_id % 14 - 8) ELSE 1 END AS versions_pruned_below,
    CASE WHEN page_id % 10 <> 1 THEN {C0} END AS committed_at,
    CASE WHEN page_id % 10 = 0 THEN {C0} + 3600 END AS deleted_at,
    CASE WHEN page_id % 3 = 0 THEN {key_hash('page_id // 3')} END AS owner_key_hash,
    CASE WHEN page_id % 3 = 0 THEN {C0} + 60 END AS owner_claimed_at,
    CAST(NULL AS VARCHAR) AS vault_ciphertext, CAST(NULL AS BIGINT) AS vault_updated_at,
    CAST(CASE WHEN page_id % 17 = 0 THEN {NOW} - CASE WHEN page_id % 2 = 0 THEN 600 ELSE 60 END END AS BIGINT) AS orphan_since
    FROM pages"""
SHARE_COLS = (
    "slug, status, edit_token_hash, created_at, sender_ip_hash, content_size, client, latest_version, "
    "versions_pruned_below, committed_at, deleted_at, owner_key_hash, owner_claimed_at, vault_ciphertext, "
    "vault_updated_at, orphan_since"
)
CTE["fx_base"] = f"""SELECT e.i, e.u, e.sec,
    {slug("(e.i * 31 + e.i // 7) % ((SELECT n FROM np) * 9 // 10)")} AS slug,
    {texts(USER_AGENTS)}[e.i % 12 + 1] AS ua,
    CASE WHEN e.i % 7 = 1 THEN 'not a url at all' WHEN e.i % 7 <> 0 THEN p.url END AS referer,
    CASE WHEN e.i % 13 = 0 THEN NULL WHEN e.i % 29 = 0 THEN '' ELSE n.n_name END AS country,
    CASE WHEN e.i % 3 = 0 THEN NULL WHEN e.i % 11 = 0 THEN '' ELSE 'City' || (e.i % 23) END AS city
    FROM fx_events e JOIN pages p ON p.page_id = (e.i * 17) % (SELECT n FROM np)
    JOIN nation n ON n.n_nationkey = e.u % 25"""
CTE["fx_views"] = f"""SELECT i AS id, slug, sec - (i % 5) * 2592000 AS viewed_at, {salted('203.0.113.', 'u % 256')} AS ip_hash,
    CAST({is_bot('ua')} AS BIGINT) AS is_bot, ua,
    CASE WHEN i % 5 <= 2 THEN {written('referer')} ELSE referer END AS referrer, country, city FROM fx_base"""
CTE["fx_hits"] = f"""SELECT i AS hit_id,
    CASE WHEN i % 97 = 0 THEN 'BAD!' WHEN i % 89 = 0 THEN 'nosuchslug00' ELSE slug END AS slug, sec,
    CASE WHEN i % 101 = 0 THEN '' WHEN i % 4 <> 0 THEN '203.0.113.' || (u % 256) END AS cf_ip,
    CASE WHEN i % 8 <> 0 THEN ' 198.51.100.7 , 10.0.0.1' END AS xff, ua, referer, country, city FROM fx_base"""
CTE["fx_objects"] = f"""
    SELECT {object_key('slug', 'v')} AS key, content_size + v AS size, created_at + v * 60 AS uploaded
    FROM (SELECT *, unnest(generate_series(versions_pruned_below, latest_version)) AS v FROM fx_shares WHERE status <> 'pending')
    WHERE page_id % 23 <> 2 OR v <> latest_version
    UNION ALL SELECT {object_key('slug', '(latest_version + 1)')}, 7, orphan_since FROM fx_shares WHERE status <> 'pending' AND orphan_since IS NOT NULL
    UNION ALL SELECT 'shares/' || slug || '/notes.txt', 10, created_at FROM fx_shares WHERE status <> 'pending' AND page_id % 9 = 0
    UNION ALL SELECT 'shares/' || slug || '/v007.html', 10, created_at FROM fx_shares WHERE status <> 'pending' AND page_id % 19 = 0
    UNION ALL SELECT 'shares/ghost' || page_id || '/v2.html', 5, {NOW} FROM pages WHERE page_id % 37 = 0"""
CTE["inv"] = r"""SELECT *, version IS NOT NULL AS recognised FROM (
    SELECT CASE WHEN regexp_matches(key, '^shares/[^/]+\.html$') THEN regexp_extract(key, '^shares/([^/]+)\.html$', 1)
                WHEN regexp_matches(key, '^shares/[^/]+/') THEN regexp_extract(key, '^shares/([^/]+)/', 1) END AS slug,
           CASE WHEN regexp_matches(key, '^shares/[^/]+\.html$') THEN 1
                WHEN try_cast(regexp_extract(key, '/v([1-9][0-9]*)\.html$', 1) AS BIGINT) BETWEEN 2 AND 9007199254740991
                THEN try_cast(regexp_extract(key, '/v([1-9][0-9]*)\.html$', 1) AS BIGINT) END AS version,
           key, size, uploaded FROM fx_objects)"""
CTE["fx_contents"] = f"""SELECT {object_key('slug', 'latest_version')} AS key, html
    FROM fx_shares JOIN pages USING (page_id) WHERE page_id % 23 <> 2 AND status <> 'pending'"""
CTE["fx_claims"] = f"""SELECT request_id, request_id AS ts, {key_hash('request_id')} AS owner_key_hash,
    CASE WHEN request_id % 60 = 11 THEN flatten([tokens, tokens, tokens, tokens, tokens, tokens, tokens, tokens]) ELSE tokens END AS tokens
    FROM (SELECT c_custkey // 7 AS request_id, list(CASE WHEN (c_custkey // 7) % 40 = 7 AND c_custkey % 7 = 3 THEN ''
            ELSE 'tok-' || (c_custkey % ((SELECT n FROM np) * 5 // 4)) END ORDER BY c_custkey % 7) AS tokens
          FROM customer GROUP BY 1)"""
CTE["fx_reports_raw"] = f"""SELECT o_orderkey AS request_id, {slug('o_custkey % ((SELECT n FROM np) + 5)')} AS slug,
    CASE WHEN o_orderkey % 50 = 0 THEN ' ' || chr(9) || ' ' WHEN o_orderkey % 51 = 0 THEN repeat('x', 2001)
         WHEN o_orderkey % 77 = 0 THEN NULL ELSE '  ' || o_orderpriority || ' ' END AS reason,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a@b.test' END AS email, o_orderkey % 53 <> 0 AS email_is_text,
    {salted('192.0.2.', 'o_orderkey % 37')} AS reporter_ip_hash, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders"""
CTE["fx_reports"] = f"""SELECT page_id AS id, {slug('page_id')} AS slug, 'spam' AS reason,
    {salted('192.0.2.', 'page_id % 37')} AS reporter_ip_hash, CAST({YEAR_2024} AS BIGINT) AS reported_at, 'open' AS status,
    CAST(NULL AS VARCHAR) AS reporter_email FROM pages WHERE page_id % 8 = 0"""
CTE["fx_uploads"] = f"""SELECT i AS attempt_id, '10.1.0.' || u AS ip, (sec - {YEAR_2024}) // 1000 AS ts,
    CASE i % 10 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'text/plain'
        WHEN 3 THEN 'image/png' WHEN 4 THEN NULL ELSE 'text/html' END AS content_type,
    CASE WHEN i % 41 = 0 THEN 'Bearer nope' WHEN i % 5 = 1 THEN 'Bearer ' || {key_letter('i')} END AS bearer,
    {texts(UPLOAD_AGENTS)}[i % 14 + 1] AS ua,
    CASE WHEN i % 31 = 0 THEN '' WHEN i % 70 = 0 THEN NULL WHEN i % 9 = 0 THEN d.text
        WHEN i % 4999 = 5 THEN repeat('<p>0123456789</p>', 70000) ELSE p.html END AS html
    FROM fx_events JOIN pages p ON p.page_id = i % (SELECT n FROM np)
    LEFT JOIN documents d ON i % 9 = 0 AND d.doc_id = i % (SELECT count(*) FROM documents)"""
CTE["fx_api"] = f"""SELECT i AS request_id, {salted('10.2.0.', 'u % 23')} AS ip_hash, CASE WHEN i % 6 <> 0 THEN {key_hash('u')} END AS key_hash,
    (sec - {YEAR_2024}) // 10000 AS ts, ['list', 'claim', 'write'][i % 3 + 1] AS route, i % 53 = 0 AS limiter_error FROM fx_events"""
CTE["fx_access"] = f"""SELECT i AS request_id, sec AS ts,
    ['versions', 'raw', 'restore', 'delete', 'edit', 'list', 'claim'][i % 7 + 1] AS route, {slug('pg')} AS slug,
    CASE WHEN i % 43 = 0 THEN 'Bearer nope' WHEN i % 5 = 1 OR i % 11 = 0 THEN 'Bearer ' || {key_letter('pg // 3 + 1')}
        WHEN i % 5 = 0 THEN 'Bearer ' || {key_letter('pg // 3')} END AS bearer,
    CASE WHEN i % 5 = 2 OR i % 11 = 0 THEN 'tok-' || pg WHEN i % 5 = 3 THEN 'tok-wrong' END AS token,
    ['1', '2', '5', '9', '0', 'x', '007', '99999999999999999999'][(i // 7) % 8 + 1] AS version,
    CASE WHEN i % 31 = 0 THEN NULL WHEN i % 29 = 0 THEN 1000001 ELSE 1000 END AS size
    FROM (SELECT *, (i * 13) % ((SELECT n FROM np) + 10) AS pg FROM fx_events)"""
CTE["fx_ops"] = f"""SELECT conv_id * 1000 + turn AS op_id, {slug('conv_id % greatest(1, (SELECT n FROM np) // 10)')} AS slug, turn + conv_id % 4 AS ts,
    CASE WHEN role = 'system' OR (role = 'assistant' AND conv_id % 3 = 1) THEN 'restore' ELSE 'edit' END AS op,
    CASE WHEN role = 'system' THEN turn + 1 WHEN role = 'assistant' AND conv_id % 3 = 1 THEN (conv_id * 7 + turn * 5) % 20 END AS arg,
    CASE WHEN NOT (role = 'system' OR (role = 'assistant' AND conv_id % 3 = 1)) THEN {bytes_of('text')} END AS size
    FROM conversations"""
CTE["fx_saves"] = f"""SELECT page_id % 6 AS device, {slug('page_id')} AS slug, 'https://old.test/' || {slug('page_id')} AS share_url, {C0} AS created_at,
    CASE WHEN page_id % 8 = 0 THEN '' WHEN page_id % 2 = 0 THEN 'Title ' || page_id END AS title, seq
    FROM (SELECT page_id, page_id AS seq FROM pages WHERE page_id % 4 <> 3
          UNION ALL SELECT page_id, page_id + (SELECT n FROM np) FROM pages WHERE page_id % 4 <> 3 AND page_id % 5 = 0)"""
CTE["fx_recent"] = f"""SELECT CASE WHEN i % 3 = 0 THEN 0 ELSE 1 + i % 40 END AS device, {slug('i % (8 * (SELECT n FROM np))')} AS slug, i AS seq FROM fx_events"""
CTE["fx_local"] = "SELECT DISTINCT device, slug, share_url, created_at, title FROM fx_saves"
CTE["fx_remote"] = f"""SELECT (page_id // 3) % 5 AS device, {slug('page_id')} AS slug, 'https://{HOST}/' || {slug('page_id')} AS share_url, {C0} AS created_at
    FROM pages WHERE page_id % 3 = 0 AND page_id % 10 NOT IN (0, 1)"""
CTE["fx_cursors"] = f"""SELECT page_id AS request_id, {key_hash('page_id // 3')} AS owner_key_hash,
    CASE WHEN page_id % 7 = 0 THEN {cursor(C0, slug('page_id'))}
         WHEN page_id % 7 = 1 THEN ['++', 'bm9jb2xvbg', 'YWJjOnNsdWc=', 'MTIzOg', 'a', 'OmFiYw==', 'MS41OmFiYw'][(page_id // 7) % 7 + 1]
         WHEN page_id % 7 = 5 THEN to_base64(encode({C0} || ':' || {slug('page_id')})) END AS cursor,
    CASE page_id % 7 WHEN 2 THEN 0 WHEN 3 THEN 101 WHEN 4 THEN NULL ELSE page_id % 9 + 1 END AS lim FROM pages"""
CTE["fx_bad_shares"] = f"""SELECT {SHARE_COLS} FROM fx_shares UNION ALL SELECT {SHARE_COLS} FROM fx_shares WHERE orphan_since IS NOT NULL
    UNION ALL SELECT {SHARE_COLS} FROM (SELECT * REPLACE ('odd' || slug AS slug, 'odd' AS status, NULL AS sender_ip_hash) FROM fx_shares WHERE latest_version = 5)"""
CTE["fx_bad_views"] = """SELECT * FROM fx_views UNION ALL SELECT * REPLACE ('missingslug0' AS slug) FROM fx_views WHERE id % 100 = 3
    UNION ALL SELECT * REPLACE (NULL AS viewed_at) FROM fx_views WHERE id % 100 = 4"""
CTE["fx_bad_reports"] = """SELECT * FROM fx_reports UNION ALL SELECT * REPLACE ('closed' AS status) FROM fx_reports WHERE id % 16 = 0
    UNION ALL SELECT * REPLACE ('missingslug0' AS slug) FROM fx_reports WHERE id % 24 = 0"""
CTE["fx_flags"] = f"SELECT {slug('page_id')} AS slug, page_id % 13 <> 0 AS listing_complete, page_id % 11 <> 0 AS delete_ok FROM pages"

# ---- steps shared by several queries

CTE["enriched"] = f"""SELECT hit_id AS id, slug, sec AS viewed_at,
    sha256('{SALT}:' || coalesce(cf_ip, trim(split_part(xff, ',', 1)), '0.0.0.0')) AS ip_hash,
    CAST({is_bot('ua')} AS BIGINT) AS is_bot, ua, {written('referer')} AS referrer, country, city
    FROM fx_hits WHERE regexp_matches(slug, '^[a-z0-9]{{8,16}}$') AND slug IN (SELECT slug FROM fx_shares WHERE status = 'committed')"""
CTE["counts"] = """SELECT s.slug, s.created_at,
    count(v.id) FILTER (WHERE is_bot = 0) AS views, count(DISTINCT CASE WHEN is_bot = 0 THEN ip_hash END) AS unique_viewers,
    count(v.id) FILTER (WHERE is_bot = 1) AS bot_views, max(CASE WHEN is_bot = 0 THEN viewed_at END) AS last_viewed,
    s.status = 'deleted' AS deleted
    FROM fx_shares s LEFT JOIN fx_views v ON v.slug = s.slug GROUP BY s.slug, s.created_at, s.status"""
CTE["recent"] = f"SELECT * FROM fx_views WHERE is_bot = 0 AND viewed_at >= {CUTOFF}"
CTE["ref_top"] = """SELECT * FROM (SELECT slug, referrer, count(*) AS n,
    row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, referrer ASC NULLS FIRST) AS place FROM recent GROUP BY 1, 2) WHERE place <= 5"""
CTE["ref_fold"] = f"SELECT slug, {label('referrer')} AS source, n FROM ref_top"
CTE["ref"] = """SELECT slug, source, CAST(sum(n) AS BIGINT) AS views,
    row_number() OVER (PARTITION BY slug ORDER BY sum(n) DESC, source) AS rank
    FROM (SELECT * FROM ref_fold UNION ALL
          SELECT t.slug, 'other', t.n - k.n FROM (SELECT slug, count(*) AS n FROM recent GROUP BY 1) t
          JOIN (SELECT slug, sum(n) AS n FROM ref_fold GROUP BY 1) k USING (slug) WHERE t.n > k.n)
    GROUP BY 1, 2"""
CTE["loc_top"] = """SELECT *, CASE WHEN coalesce(country, '') = '' THEN 'unknown' WHEN coalesce(city, '') = '' THEN country
        ELSE city || ', ' || country END AS label
    FROM (SELECT slug, country, city, count(*) AS n,
        row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, country ASC NULLS FIRST, city ASC NULLS FIRST) AS place
        FROM recent GROUP BY 1, 2, 3) WHERE place <= 8"""
CTE["loc"] = """SELECT slug, first(nullif(country, '') ORDER BY place) AS country, first(nullif(city, '') ORDER BY place) AS city, label,
    CAST(sum(n) AS BIGINT) AS views, row_number() OVER (PARTITION BY slug ORDER BY sum(n) DESC, label) AS rank
    FROM (SELECT slug, country, city, label, n, place FROM loc_top UNION ALL
          SELECT t.slug, NULL, NULL, 'other', t.n - k.n, 9 FROM (SELECT slug, count(*) AS n FROM recent GROUP BY 1) t
          JOIN (SELECT slug, sum(n) AS n FROM loc_top GROUP BY 1) k USING (slug) WHERE t.n > k.n)
    GROUP BY slug, label"""
CTE["trend"] = f"""SELECT s.slug, {day_text('d.day')} AS date, d.day, count(v.id) AS views
    FROM fx_shares s CROSS JOIN (SELECT unnest(generate_series({FIRST_DAY}, {TODAY})) AS day) d
    LEFT JOIN fx_views v ON v.slug = s.slug AND v.is_bot = 0 AND v.viewed_at // 86400 = d.day GROUP BY 1, 2, 3"""
CTE["docs"] = f"""SELECT c.slug, {iso('c.created_at')} AS createdAt, c.views, c.unique_viewers AS uniqueViewers, c.bot_views AS botViews,
    {iso('c.last_viewed')} AS lastViewedAt,
    coalesce((SELECT list({{'source': source, 'views': views}} ORDER BY rank) FROM ref r WHERE r.slug = c.slug), []) AS referrers,
    coalesce((SELECT list({{'country': country, 'city': city, 'label': label, 'views': views}} ORDER BY rank) FROM loc l WHERE l.slug = c.slug), []) AS locations,
    (SELECT list({{'date': date, 'views': views}} ORDER BY date) FROM trend t WHERE t.slug = c.slug) AS "dailyViews", c.deleted
    FROM counts c"""
CTE["owned"] = "SELECT owner_key_hash, created_at, slug FROM fx_shares WHERE status = 'committed' AND owner_key_hash IS NOT NULL"
CTE["up_checked"] = f"""SELECT attempt_id, sha256('{SALT}:' || ip) AS ip_hash, ts,
    CASE WHEN bearer IS NOT NULL AND NOT regexp_matches(bearer, {GOOD_BEARER}) THEN 401
         WHEN coalesce(content_type, '') LIKE '%application/json%' AND coalesce(html, '') = '' THEN 400
         WHEN NOT (coalesce(content_type, '') LIKE '%application/json%' OR coalesce(content_type, '') LIKE '%text/html%' OR coalesce(content_type, '') LIKE '%text/plain%') THEN 415
         WHEN coalesce(html, '') = '' THEN 400 WHEN {bytes_of('html')} > 1000000 THEN 413
         WHEN NOT regexp_matches(left(html, 4096), '<[A-Za-z0-9_]') THEN 415 ELSE 201 END AS verdict,
    {bytes_of('html')} AS size, {channel('ua')} AS client,
    CASE WHEN bearer IS NOT NULL THEN sha256(regexp_replace(bearer, '^Bearer\\s+', '')) END AS owner FROM fx_uploads"""
CTE["up_cand"] = "SELECT ip_hash, ts, min(attempt_id) AS id FROM up_checked WHERE verdict = 201 GROUP BY 1, 2"
CTE["up_taken"] = """SELECT ip_hash, ts, arg_min(id, ts) AS id FROM (SELECT ip_hash, min(ts) AS ts, arg_min(id, ts) AS id FROM up_cand GROUP BY 1) GROUP BY 1, 2
    UNION ALL
    SELECT c.ip_hash, min(c.ts), arg_min(c.id, c.ts) FROM up_taken t JOIN up_cand c ON c.ip_hash = t.ip_hash AND c.ts >= t.ts + 30 GROUP BY c.ip_hash"""
CTE["admitted"] = """SELECT attempt_id, ip_hash, ts, CAST(code AS BIGINT) AS code,
    CASE WHEN code = 201 THEN size END AS content_size, CASE WHEN code = 201 THEN client END AS client,
    CASE WHEN code = 201 THEN owner END AS owner_key_hash
    FROM (SELECT u.*, CASE WHEN EXISTS (SELECT 1 FROM up_taken t WHERE t.ip_hash = u.ip_hash AND t.ts > u.ts - 30
            AND (t.ts < u.ts OR (t.ts = u.ts AND t.id < u.attempt_id))) THEN 429 ELSE verdict END AS code FROM up_checked u)"""
CTE["api_one"] = """SELECT *, CASE WHEN NOT limiter_error THEN
      row_number() OVER (PARTITION BY ip_hash, ts // 60, route = 'write', limiter_error ORDER BY ts, request_id) <= CASE WHEN route = 'write' THEN 30 ELSE 60 END
      END AS ip_ok FROM fx_api"""
CTE["api_two"] = """SELECT *, CASE WHEN route <> 'write' AND coalesce(ip_ok, false) AND key_hash IS NOT NULL THEN
      row_number() OVER (PARTITION BY key_hash, ts // 60, route <> 'write' AND coalesce(ip_ok, false) ORDER BY ts, request_id) <= 30 END AS key_ok FROM api_one"""
CTE["claim_bad"] = "SELECT request_id FROM fx_claims WHERE len(tokens) > 50 OR list_contains(tokens, '')"
CTE["claim_rows"] = """SELECT request_id, ts, owner_key_hash AS caller, pos - 1 AS pos, sha256(tokens[pos]) AS h
    FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS pos FROM fx_claims WHERE request_id NOT IN (SELECT request_id FROM claim_bad))"""
CTE["claim_first"] = "SELECT h, arg_min(caller, request_id) AS caller, min(request_id) AS request_id FROM claim_rows GROUP BY 1"
CTE["claimed"] = """SELECT r.request_id, r.caller AS owner_key_hash, r.pos,
    CASE WHEN s.slug IS NULL THEN 'not-found'
         WHEN s.owner_key_hash = r.caller THEN 'already-yours'
         WHEN s.owner_key_hash IS NOT NULL THEN 'owned-by-other'
         WHEN f.request_id = r.request_id THEN 'claimed'
         WHEN f.caller = r.caller THEN 'already-yours' ELSE 'owned-by-other' END AS outcome,
    CASE WHEN coalesce(s.owner_key_hash, f.caller) = r.caller THEN s.slug END AS slug
    FROM claim_rows r JOIN claim_first f USING (h) LEFT JOIN fx_shares s ON s.edit_token_hash = r.h AND s.status = 'committed'
    UNION ALL SELECT request_id, NULL, NULL, 'bad-request', NULL FROM claim_bad"""
CTE["judged"] = f"""SELECT request_id, route, CAST(CASE
    WHEN route IN ('list', 'claim') THEN CASE WHEN kh IS NULL THEN 401 ELSE 200 END
    WHEN route = 'edit' THEN CASE WHEN size IS NULL OR th IS NULL THEN 400 WHEN size > 1000000 THEN 413
        WHEN status IS NULL OR status = 'deleted' THEN 404 WHEN status = 'pending' THEN 409 WHEN th <> edit_token_hash THEN 403 ELSE 200 END
    WHEN bearer IS NOT NULL AND kh IS NULL THEN 401
    WHEN route IN ('raw', 'restore') AND wanted IS NULL THEN 404
    WHEN kh IS NULL AND th IS NULL THEN 400
    WHEN status IS NULL THEN 404
    WHEN status = 'deleted' THEN CASE WHEN route = 'delete' THEN 200 ELSE 410 END
    WHEN status = 'pending' AND route <> 'delete' THEN 409
    WHEN kh IS NOT NULL AND (owner_key_hash IS NULL OR kh <> owner_key_hash) THEN 403
    WHEN kh IS NULL AND th <> edit_token_hash THEN 403
    WHEN route IN ('versions', 'delete') THEN 200
    WHEN wanted > latest_version THEN 404
    WHEN route = 'restore' AND wanted = latest_version THEN 400
    WHEN NOT EXISTS (SELECT 1 FROM fx_objects o WHERE o.key = {object_key('x.slug', 'x.wanted')}) THEN 404
    ELSE 200 END AS BIGINT) AS code
    FROM (SELECT a.*, s.status, s.owner_key_hash, s.edit_token_hash, s.latest_version,
            CASE WHEN regexp_matches(a.bearer, {GOOD_BEARER}) THEN sha256(regexp_replace(a.bearer, '^Bearer\\s+', '')) END AS kh,
            sha256(a.token) AS th,
            CASE WHEN regexp_matches(a.version, '^[0-9]+$') AND try_cast(a.version AS BIGINT) BETWEEN 1 AND 9007199254740991
                 THEN try_cast(a.version AS BIGINT) END AS wanted
          FROM fx_access a LEFT JOIN fx_shares s ON s.slug = a.slug) x"""
_TRIES = ["CASE WHEN i % 11 = 0 THEN i % (SELECT n FROM np) WHEN i % 7 < 3 THEN 1000000 + i // 50 ELSE 2000000 + i END",
          "i // 50 + 1000001", "i // 300 + 3000000", "i // 300 + 3000001", "i // 1000 + 4000000"]
CTE["fx_grants"] = " UNION ALL ".join(f"SELECT i AS attempt_id, {t} AS turn, {slug(x)} AS slug FROM fx_events" for t, x in enumerate(_TRIES))
# Forty rounds of asking, more than are ever needed here.
CTE["asking"] = """SELECT attempt_id, ts, 0 AS turn, 0 AS round FROM admitted WHERE code = 201
    UNION ALL SELECT attempt_id, ts, CASE WHEN slug IS NOT NULL AND (taken OR place > 1) THEN turn + 1 ELSE turn END, round + 1
    FROM (SELECT a.*, g.slug, s.slug IS NOT NULL AS taken, row_number() OVER (PARTITION BY g.slug ORDER BY a.ts, a.attempt_id) AS place
          FROM asking a LEFT JOIN fx_grants g ON g.attempt_id = a.attempt_id AND g.turn = a.turn LEFT JOIN fx_shares s ON s.slug = g.slug)
    WHERE round < 40"""
CTE["rep"] = """SELECT *, row_number() OVER (PARTITION BY slug, reporter_ip_hash, fault = 0 ORDER BY ts, request_id) AS nth,
    EXISTS (SELECT 1 FROM fx_reports e WHERE e.slug = r.slug AND e.reporter_ip_hash = r.reporter_ip_hash) AS old
    FROM (SELECT *, regexp_replace(reason, '^\\s+|\\s+$', '', 'g') AS trimmed,
        CASE WHEN coalesce(regexp_replace(reason, '^\\s+|\\s+$', '', 'g'), '') = '' THEN 400 WHEN length(reason) > 2000 THEN 413
             WHEN NOT email_is_text THEN 400 WHEN slug NOT IN (SELECT slug FROM fx_shares) THEN 404 ELSE 0 END AS fault
        FROM fx_reports_raw) r"""
CTE["rep_new"] = """SELECT request_id AS id, slug, trimmed AS reason, reporter_ip_hash, ts AS reported_at, 'open' AS status, email AS reporter_email
    FROM rep WHERE fault = 0 AND nth = 1 AND NOT old"""
CTE["eligible"] = f"""SELECT *, CASE WHEN status = 'deleted' THEN latest_version + 1 ELSE latest_version - 9 END AS keep_from FROM fx_shares
    WHERE (status = 'committed' AND latest_version - versions_pruned_below >= 10) OR (status = 'deleted' AND versions_pruned_below <= latest_version)
       OR orphan_since < {NOW - 300}"""
CTE["eligible_kept"] = f"SELECT * FROM eligible WHERE NOT (status = 'pending' AND created_at < {NOW - 300})"


def plan_of(taken: str) -> str:
    return f"""SELECT t.slug, o.key, CASE WHEN o.version < t.keep_from THEN 'old_version' WHEN o.uploaded < {NOW - 300} THEN 'orphan' ELSE 'held_back' END AS why, true AS present
    FROM {taken} t JOIN inv o ON o.slug = t.slug AND o.version >= 2 AND (o.version < t.keep_from OR o.version > t.latest_version)
    UNION ALL SELECT slug, 'shares/' || slug || '.html', 'first_version',
        EXISTS (SELECT 1 FROM fx_objects o WHERE o.key = 'shares/' || t.slug || '.html') FROM {taken} t WHERE keep_from > 1"""


CTE["plan"] = plan_of("eligible")
CTE["plan_kept"] = plan_of("eligible_kept")
CTE["outcome"] = """SELECT e.*, f.listing_complete AS complete,
        EXISTS (SELECT 1 FROM plan p WHERE p.slug = e.slug AND p.why = 'held_back') AS held,
        NOT f.delete_ok AND EXISTS (SELECT 1 FROM plan p WHERE p.slug = e.slug AND p.why <> 'held_back') AS failed
    FROM eligible e JOIN fx_flags f ON f.slug = e.slug"""
CTE["markers"] = """SELECT slug,
    CASE WHEN failed THEN versions_pruned_below WHEN status = 'deleted' AND complete AND NOT held THEN latest_version + 1
         WHEN status <> 'deleted' AND complete THEN greatest(1, keep_from) ELSE versions_pruned_below END AS versions_pruned_below,
    CASE WHEN complete AND NOT held AND NOT failed THEN NULL ELSE orphan_since END AS orphan_since
    FROM outcome"""
CTE["due"] = f"""SELECT v.*, (ua IS NOT NULL OR referrer IS NOT NULL OR country IS NOT NULL OR city IS NOT NULL)
    AND (viewed_at < {CUTOFF} OR slug IN (SELECT slug FROM fx_shares WHERE status = 'deleted')) AS due FROM fx_views v"""
CTE["kept_shares"] = f"SELECT * FROM fx_shares WHERE NOT (status = 'pending' AND created_at < {NOW - 300})"
CTE["stale"] = f"SELECT slug, created_at FROM fx_shares WHERE status = 'pending' AND created_at < {NOW - 300}"
CTE["dels"] = """SELECT a.slug, min(a.ts) AS dts FROM fx_access a JOIN judged j USING (request_id)
    JOIN fx_shares s ON s.slug = a.slug WHERE a.route = 'delete' AND j.code = 200 AND s.status <> 'deleted' GROUP BY 1"""

# Edits and restores replayed one by one per share; ``made`` lists the versions the log wrote.
CTE["op_list"] = """SELECT o.*, s.status, s.latest_version, row_number() OVER (PARTITION BY o.slug ORDER BY ts, op_id) AS k
    FROM fx_ops o LEFT JOIN fx_shares s ON s.slug = o.slug"""
CTE["obj_of"] = "SELECT slug, map(list(version), list(size)) AS have FROM inv WHERE recognised GROUP BY slug"
CTE["replay"] = """SELECT slug, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS op_id, CAST(NULL AS BIGINT) AS code, CAST(NULL AS BIGINT) AS new_version,
        CAST(NULL AS BIGINT) AS restored_from, CAST(NULL AS BIGINT) AS content_size, latest_version AS latest,
        coalesce(have, MAP([]::BIGINT[], []::BIGINT[])) AS have
    FROM (SELECT DISTINCT slug, coalesce(latest_version, 0) AS latest_version FROM op_list) d LEFT JOIN obj_of USING (slug)
    UNION ALL
    SELECT slug, k, op_id, code, CASE WHEN code = 200 THEN nv END, CASE WHEN code = 200 AND op = 'restore' THEN arg END,
        CASE WHEN code = 200 THEN bytes END, CASE WHEN code = 200 THEN nv ELSE latest END,
        CASE WHEN code = 200 THEN map_concat(have, MAP([nv], [bytes])) ELSE have END
    FROM (SELECT *, CAST(CASE WHEN status IS NULL THEN 404 WHEN status = 'deleted' THEN CASE WHEN op = 'edit' THEN 404 ELSE 410 END
                WHEN status = 'pending' THEN 409
                WHEN op = 'restore' AND (arg < 1 OR arg > latest) THEN 404 WHEN op = 'restore' AND arg = latest THEN 400
                WHEN op = 'restore' AND bytes IS NULL THEN 404 WHEN nv IS NULL THEN 409 ELSE 200 END AS BIGINT) AS code
          FROM (SELECT r.slug, o.k, o.op_id, o.op, o.arg, o.status, r.latest, r.have,
                  list_filter([r.latest + 1, r.latest + 2, r.latest + 3], lambda x: NOT list_contains(map_keys(r.have), x))[1] AS nv,
                  CASE WHEN o.op = 'edit' THEN o.size ELSE r.have[o.arg] END AS bytes
                FROM replay r JOIN op_list o ON o.slug = r.slug AND o.k = r.k + 1))"""
RECURSIVE = {"up_taken", "replay", "asking"}

DAILY = f"SELECT slug, {day_text('viewed_at // 86400')} AS date, count(*) AS views FROM fx_views WHERE is_bot = 0 GROUP BY 1, 2"

SQL: dict[str, str] = {
    "a1_load_views": "SELECT *, viewed_at // 86400 AS day FROM fx_views",
    "a1_load_shares": f"SELECT {SHARE_COLS} FROM fx_shares",
    "a1_load_reports": "SELECT * FROM fx_reports",
    "a1_load_objects": "SELECT * FROM fx_objects",
    "a3_evolve_shares": f"""SELECT slug, status, edit_token_hash, created_at, sender_ip_hash, content_size, 'other' AS client,
        CAST(1 AS BIGINT) AS latest_version, CAST(1 AS BIGINT) AS versions_pruned_below, committed_at, deleted_at,
        CAST(NULL AS VARCHAR) AS owner_key_hash, CAST(NULL AS BIGINT) AS owner_claimed_at, CAST(NULL AS VARCHAR) AS vault_ciphertext,
        CAST(NULL AS BIGINT) AS vault_updated_at, CAST(NULL AS BIGINT) AS orphan_since FROM fx_shares""",
    "a3_evolve_views": """SELECT id, slug, viewed_at, ip_hash, CASE WHEN id % 2 = 0 THEN 0 ELSE is_bot END AS is_bot, ua, referrer,
        CASE WHEN id % 2 = 1 THEN country END AS country, CASE WHEN id % 2 = 1 THEN city END AS city FROM fx_views""",
    "a4_append_views": "SELECT *, viewed_at // 86400 AS day FROM enriched",
    "a5_object_inventory": "SELECT * FROM inv",
    "b1_enrich_hits": "SELECT * FROM enriched",
    "b2_bot_pattern_hits": f"""SELECT p.pattern, count(v.ua) AS views, count(DISTINCT v.ua) AS uas
        FROM (SELECT unnest({texts(BOT_PATTERNS)}) AS pattern) p LEFT JOIN fx_views v ON regexp_matches(v.ua, '(?i)' || p.pattern) GROUP BY 1""",
    "b2_bot_flag_agreement": f"SELECT CAST(0 AS BIGINT) AS stored, CAST({is_bot('ua')} AS BIGINT) AS recomputed, count(*) AS n FROM fx_views GROUP BY 1, 2",
    "b3_referrer_normalize": f"SELECT hit_id, referer, {written('referer')} AS referrer FROM fx_hits",
    "b4_referrer_shape_audit": f"""SELECT slug, CASE WHEN coalesce(referrer, '') = '' THEN 'null' WHEN referrer = 'other' THEN 'other'
        WHEN regexp_matches(referrer, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'url'
        WHEN regexp_matches(referrer, '^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)*$') THEN 'host' ELSE 'junk' END AS shape,
        {label('referrer')} AS label, count(*) AS n FROM fx_views GROUP BY 1, 2, 3""",
    "b5_resolve_requests": f"""SELECT h.hit_id AS request_id,
        CAST(CASE WHEN s.slug IS NULL OR NOT regexp_matches(h.slug, '^[a-z0-9]{{8,16}}$') THEN 404 WHEN o.key IS NULL THEN 500 ELSE 200 END AS BIGINT) AS code,
        CASE WHEN s.slug IS NOT NULL AND o.key IS NOT NULL THEN s.latest_version END AS version,
        s.slug IS NOT NULL AND regexp_matches(h.slug, '^[a-z0-9]{{8,16}}$') AS recorded
        FROM fx_hits h LEFT JOIN fx_shares s ON s.slug = h.slug AND s.status = 'committed'
        LEFT JOIN fx_objects o ON o.key = {object_key('s.slug', 's.latest_version')}""",
    "b6_render_pages": f"""SELECT slug, version, CASE WHEN NOT contains(html, '</body>') THEN html || foot
        ELSE left(html, cut) || foot || substr(html, cut + 1) END AS html
        FROM (SELECT s.slug, s.latest_version AS version, c.html, length(c.html) - length(string_split(c.html, '</body>')[-1]) - 7 AS cut,
              replace({text(REPORT_FOOTER)}, '{{url}}', 'https://{HOST}/report?slug=' || s.slug) AS foot
              FROM fx_shares s JOIN fx_contents c ON c.key = {object_key('s.slug', 's.latest_version')} WHERE s.status = 'committed')""",
    "b7_client_channel": f"SELECT attempt_id, ua, {channel('ua')} AS client FROM fx_uploads",
    "c1_share_counts": "SELECT * FROM counts",
    "c2_referrer_breakdown": "SELECT * FROM ref",
    "c3_location_breakdown": "SELECT * FROM loc",
    "c4_daily_trend": "SELECT slug, date, views FROM trend",
    "c5_trend_profile": """SELECT slug, date, views, CAST(floor(100.0 * views / peak + 0.5) AS BIGINT) AS pct, peak, last7 FROM
        (SELECT *, max(views) OVER (PARTITION BY slug) AS peak, CAST(sum(CASE WHEN day > """ + str(TODAY - 7) + """ THEN views ELSE 0 END) OVER (PARTITION BY slug) AS BIGINT) AS last7 FROM trend) WHERE peak > 0""",
    "c6_share_stats_doc": "SELECT slug, CAST(to_json(docs) AS VARCHAR) AS document FROM docs",
    "c1_counts_with_top_source": "SELECT c.*, r.source AS top_source, r.views AS top_source_views FROM counts c LEFT JOIN ref r ON r.slug = c.slug AND r.rank = 1",
    "d1_channel_reach": "SELECT client, count(*) AS n, count(DISTINCT sender_ip_hash) AS unique_ips FROM fx_shares WHERE status = 'committed' GROUP BY 1 ORDER BY n DESC, client",
    "d2_view_totals": "SELECT count(*) AS total_views, count(DISTINCT slug) AS shares_with_views, count(DISTINCT ip_hash) AS unique_viewer_ips FROM fx_views",
    "d3_daily_activity": f"SELECT {day_text('viewed_at // 86400')} AS day, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM fx_views WHERE is_bot = 0 GROUP BY 1",
    "e1_merge_share_lists": """SELECT coalesce(r.device, l.device) AS device, coalesce(r.slug, l.slug) AS slug, coalesce(r.share_url, l.share_url) AS share_url,
        coalesce(r.created_at, l.created_at) AS created_at, nullif(l.title, '') AS title, l.slug IS NOT NULL AS local, r.slug IS NOT NULL AS synced
        FROM fx_remote r FULL JOIN fx_local l ON r.device = l.device AND r.slug = l.slug""",
    "e2_unsynced_local": "SELECT device, slug FROM fx_local l WHERE NOT EXISTS (SELECT 1 FROM fx_remote r WHERE r.device = l.device AND r.slug = l.slug)",
    "e2_unsynced_counts": "SELECT device, count(*) AS n FROM fx_local l WHERE NOT EXISTS (SELECT 1 FROM fx_remote r WHERE r.device = l.device AND r.slug = l.slug) GROUP BY 1",
    "g1_admit_uploads": "SELECT * FROM admitted",
    "g1_new_shares": """SELECT g.slug, CASE WHEN attempt_id % 17 <> 0 THEN 'committed' ELSE 'pending' END AS status, sha256('new-token-' || attempt_id) AS edit_token_hash,
        ts AS created_at, ip_hash AS sender_ip_hash, content_size, client, CAST(1 AS BIGINT) AS latest_version, CAST(1 AS BIGINT) AS versions_pruned_below,
        CASE WHEN attempt_id % 17 <> 0 THEN ts END AS committed_at, CAST(NULL AS BIGINT) AS deleted_at, owner_key_hash,
        CASE WHEN owner_key_hash IS NOT NULL THEN ts END AS owner_claimed_at, CAST(NULL AS VARCHAR) AS vault_ciphertext,
        CAST(NULL AS BIGINT) AS vault_updated_at, CAST(NULL AS BIGINT) AS orphan_since
        FROM (SELECT attempt_id, turn FROM asking WHERE round = 40) JOIN fx_grants g USING (attempt_id, turn) JOIN admitted USING (attempt_id)""",
    "g2_upload_limiter_summary": f"""SELECT ip_hash, {day_text('ts // 86400')} AS day, count(*) FILTER (WHERE code = 201) AS accepted,
        count(*) FILTER (WHERE code = 429) AS limited, count(*) FILTER (WHERE code NOT IN (201, 429)) AS invalid FROM admitted GROUP BY 1, 2""",
    "g3_fixed_window_limits": "SELECT request_id, ip_ok, key_ok, CAST(CASE WHEN NOT coalesce(ip_ok, true) OR NOT coalesce(key_ok, true) THEN 429 ELSE 200 END AS BIGINT) AS code FROM api_two",
    "g4_claim_shares": "SELECT * FROM claimed",
    "g4_claimed_owners": """SELECT s.slug, r.caller AS owner_key_hash, max(r.ts) AS owner_claimed_at FROM claim_rows r JOIN claim_first f USING (h)
        JOIN fx_shares s ON s.edit_token_hash = r.h AND s.status = 'committed' WHERE r.caller = coalesce(s.owner_key_hash, f.caller) GROUP BY 1, 2""",
    "g5_claim_tally": """SELECT owner_key_hash, count(*) FILTER (WHERE outcome = 'claimed') AS claimed, count(*) FILTER (WHERE outcome = 'already-yours') AS already_yours,
        count(*) FILTER (WHERE outcome = 'owned-by-other') AS owned_by_other, count(*) FILTER (WHERE outcome = 'not-found') AS not_found,
        count(*) FILTER (WHERE outcome IN ('claimed', 'already-yours')) AS added, (count(*) + 49) // 50 AS calls FROM claimed WHERE outcome <> 'bad-request' GROUP BY 1""",
    "g6_audit_access": "SELECT * FROM judged",
    "g6_access_counts": "SELECT route, code, count(*) AS n FROM judged GROUP BY 1, 2",
    "g7_intake_reports": "SELECT request_id, CAST(CASE WHEN fault = 0 THEN 200 ELSE fault END AS BIGINT) AS code, fault = 0 AND (nth > 1 OR old) AS deduped FROM rep",
    "g7_new_reports": "SELECT * FROM rep_new",
    "h1_version_listing": """SELECT slug, version, uploaded AS created_at, size, version = latest_version AS live FROM
        (SELECT i.*, s.latest_version, row_number() OVER (PARTITION BY i.slug ORDER BY i.version DESC, i.key) AS place
         FROM inv i JOIN fx_shares s ON s.slug = i.slug WHERE i.recognised AND i.version <= s.latest_version) WHERE place <= 10""",
    "h2_storage_audit": f"""SELECT i.slug, i.key, CASE WHEN NOT recognised THEN 'unrecognised' WHEN s.slug IS NULL THEN 'no_such_share' WHEN s.status = 'deleted' THEN 'of_deleted_share'
        WHEN version > latest_version THEN 'orphan' WHEN version = latest_version THEN 'live' ELSE 'history' END AS class
        FROM inv i LEFT JOIN fx_shares s ON s.slug = i.slug
        UNION ALL SELECT slug, {object_key('slug', 'latest_version')}, 'missing_live' FROM fx_shares s WHERE status = 'committed'
            AND NOT EXISTS (SELECT 1 FROM fx_objects o WHERE o.key = {object_key('s.slug', 's.latest_version')})""",
    "h3_apply_version_log": "SELECT op_id, slug, code, new_version, restored_from, content_size FROM replay WHERE k > 0",
    "h3_versions_after": """SELECT s.slug, coalesce(l.v, s.latest_version) AS latest_version, coalesce(l.b, s.content_size) AS content_size FROM fx_shares s
        LEFT JOIN (SELECT slug, max(new_version) AS v, arg_max(content_size, new_version) AS b FROM replay WHERE new_version IS NOT NULL GROUP BY 1) l ON l.slug = s.slug""",
    "h4_sweep_plan": "SELECT * FROM plan",
    "h4_sweep_counts": "SELECT (SELECT count(*) FROM eligible) AS taken, CAST(0 AS BIGINT) AS skipped, (SELECT count(*) FROM plan WHERE why <> 'held_back') AS pruned",
    "h5_sweep_markers": "SELECT * FROM markers",
    "f1_anonymize_views": """SELECT id, slug, viewed_at, ip_hash, is_bot, CASE WHEN NOT due THEN ua END AS ua, CASE WHEN NOT due THEN referrer END AS referrer,
        CASE WHEN NOT due THEN country END AS country, CASE WHEN NOT due THEN city END AS city, due AS changed FROM due""",
    "f1_anonymize_log": """SELECT id, slug, viewed_at, ip_hash, is_bot, CASE WHEN NOT due THEN ua END AS ua, CASE WHEN NOT due THEN referrer END AS referrer,
        CASE WHEN NOT due THEN country END AS country, CASE WHEN NOT due THEN city END AS city, viewed_at // 86400 AS day FROM due""",
    "f2_purged_shares": f"SELECT {SHARE_COLS} FROM kept_shares",
    "f2_purged_views": "SELECT * FROM fx_views WHERE slug NOT IN (SELECT slug FROM stale)",
    "f2_purged_keys": "SELECT 'shares/' || slug || '.html' AS key FROM stale",
    "f3_deleted_shares": """SELECT s.slug, CASE WHEN d.slug IS NOT NULL THEN 'deleted' ELSE s.status END AS status, coalesce(d.dts, s.deleted_at) AS deleted_at
        FROM fx_shares s LEFT JOIN dels d ON d.slug = s.slug""",
    "f3_deleted_views": """SELECT v.id, v.slug, viewed_at, ip_hash, is_bot, CASE WHEN d.slug IS NULL THEN ua END AS ua, CASE WHEN d.slug IS NULL THEN referrer END AS referrer,
        CASE WHEN d.slug IS NULL THEN country END AS country, CASE WHEN d.slug IS NULL THEN city END AS city FROM fx_views v LEFT JOIN dels d ON d.slug = v.slug""",
    "f3_deleted_keys": "SELECT slug, 'shares/' || slug || '.html' AS key FROM dels UNION ALL SELECT d.slug, o.key FROM dels d JOIN fx_objects o ON starts_with(o.key, 'shares/' || d.slug || '/')",
    "f4_maintenance_counters": f"""SELECT 'pending_cleaned' AS counter, count(*) AS n FROM stale
        UNION ALL SELECT 'anonymised', count(*) FROM due WHERE due AND slug NOT IN (SELECT slug FROM stale)
        UNION ALL SELECT 'pruned', count(*) FROM plan_kept WHERE why <> 'held_back' AND slug IN (SELECT slug FROM fx_flags WHERE delete_ok)
        UNION ALL SELECT 'skipped', count(*) FROM outcome WHERE (NOT complete OR held OR failed) AND slug IN (SELECT slug FROM kept_shares)""",
    "f4_maintenance_shares": """SELECT s.* EXCLUDE (page_id, versions_pruned_below, orphan_since), coalesce(m.versions_pruned_below, s.versions_pruned_below) AS versions_pruned_below,
        CASE WHEN m.slug IS NOT NULL THEN m.orphan_since ELSE s.orphan_since END AS orphan_since FROM kept_shares s LEFT JOIN markers m ON m.slug = s.slug""",
    "f5_retention_ledger": f"""SELECT {day_text('viewed_at // 86400')} AS day, count(*) AS rows, count(*) FILTER (WHERE raw) AS raw, count(*) FILTER (WHERE raw AND viewed_at < {CUTOFF}) AS overdue,
        count(*) FILTER (WHERE raw AND slug IN (SELECT slug FROM fx_shares WHERE status = 'deleted')) AS deleted_raw
        FROM (SELECT *, ua IS NOT NULL OR referrer IS NOT NULL OR country IS NOT NULL OR city IS NOT NULL AS raw FROM fx_views) GROUP BY 1""",
    "f5_ledger_after_run": f"""SELECT {day_text('viewed_at // 86400')} AS day, count(*) AS rows, count(*) FILTER (WHERE raw AND NOT due) AS raw, CAST(0 AS BIGINT) AS overdue, CAST(0 AS BIGINT) AS deleted_raw
        FROM (SELECT *, ua IS NOT NULL OR referrer IS NOT NULL OR country IS NOT NULL OR city IS NOT NULL AS raw FROM due WHERE slug NOT IN (SELECT slug FROM stale)) GROUP BY 1""",
    "s2_stream_daily_views": DAILY,
    "s3_stream_counters": "SELECT slug, count(*) FILTER (WHERE is_bot = 0) AS views, count(*) FILTER (WHERE is_bot = 1) AS bot_views, max(viewed_at) FILTER (WHERE is_bot = 0) AS last_viewed FROM fx_views GROUP BY 1",
    "s4_stream_unique_viewers": "SELECT slug, count(DISTINCT ip_hash) AS unique_viewers FROM fx_views WHERE is_bot = 0 GROUP BY 1",
    "s7_stream_stale_uploads": "SELECT * FROM stale",
    "s8_stream_write_limits": "SELECT ip_hash, ts // 60 * 60 AS window_start, count(*) AS n, count(*) > 30 AS over FROM fx_api WHERE route = 'write' GROUP BY 1, 2",
}
for _name, _size in (("e3_recent_per_device", 200), ("e3_recent_per_browser", 50)):
    SQL[_name] = f"""SELECT * FROM (SELECT device, slug, row_number() OVER (PARTITION BY device ORDER BY max(seq) DESC) AS pos
        FROM fx_recent GROUP BY 1, 2) WHERE pos <= {_size}"""
for _name, _size in (("e4_owner_pages", 50), ("e4_owner_pages_of_7", 7)):
    SQL[_name] = f"""SELECT owner_key_hash, (pos - 1) // {_size} + 1 AS page, pos, slug, created_at, 'https://{HOST}/' || slug AS share_url,
        CASE WHEN pos % {_size} = 0 AND pos < size THEN {cursor('created_at', 'slug')} END AS next_cursor
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_key_hash ORDER BY created_at DESC, slug DESC) AS pos,
              count(*) OVER (PARTITION BY owner_key_hash) AS size FROM owned)"""
SQL["e5_owner_seek"] = f"""WITH RECURSIVE_PLACEHOLDER asked AS (
    SELECT request_id, owner_key_hash, coalesce(lim, 50) AS lim, cursor IS NOT NULL AS seeks,
        CASE WHEN strpos(plain, ':') > 0 AND substr(plain, strpos(plain, ':') + 1) <> '' THEN
            CASE WHEN trim(left(plain, strpos(plain, ':') - 1)) = '' THEN 0.0 ELSE try_cast(left(plain, strpos(plain, ':') - 1) AS DOUBLE) END END AS sec,
        substr(plain, strpos(plain, ':') + 1) AS after_slug
    FROM (SELECT *, CASE WHEN length(rtrim(std, '=')) % 4 <> 1 AND regexp_matches(std, '^[A-Za-z0-9+/]*={{0,2}}$')
              THEN TRY(decode(from_base64(rpad(rtrim(std, '='), CAST(ceil(length(rtrim(std, '=')) / 4.0) * 4 AS INTEGER), '=')))) END AS plain
          FROM (SELECT *, translate(cursor, '-_', '+/') AS std FROM fx_cursors))),
    checked AS (SELECT *, lim BETWEEN 1 AND 100 AND (NOT seeks OR coalesce(sec = floor(sec), false)) AS good FROM asked),
    found AS (SELECT c.request_id, c.lim, o.slug, o.created_at, row_number() OVER (PARTITION BY c.request_id ORDER BY o.created_at DESC, o.slug DESC) AS pos,
        count(*) OVER (PARTITION BY c.request_id) AS total
        FROM checked c JOIN owned o ON o.owner_key_hash = c.owner_key_hash
        WHERE c.good AND (NOT c.seeks OR o.created_at < c.sec OR (o.created_at = c.sec AND o.slug < c.after_slug)))
    SELECT c.request_id, CASE WHEN c.good THEN 'ok' ELSE 'bad_request' END AS status, f.pos, f.slug,
        CASE WHEN f.pos = f.lim AND f.total > f.lim THEN {cursor('f.created_at', 'f.slug')} END AS next_cursor
    FROM checked c LEFT JOIN found f ON f.request_id = c.request_id AND f.pos <= f.lim""".replace("RECURSIVE_PLACEHOLDER ", "")
_ROW_RULES = {
    "shares": "slug status edit_token_hash created_at sender_ip_hash content_size client latest_version versions_pruned_below",
    "views": "id slug viewed_at ip_hash is_bot",
    "reports": "id slug reason reporter_ip_hash reported_at status",
}
for _name, _prefix in (("a2_contract_violations", "fx_bad_"), ("a2_contract_kept", "fx_")):
    _parts = [
        f"SELECT '{t}.null.{c}' AS rule, count(*) AS n FROM {_prefix}{t} WHERE {c} IS NULL"
        for t, cols in _ROW_RULES.items()
        for c in cols.split()
    ]
    _parts += [
        f"SELECT 'shares.status', count(*) FROM {_prefix}shares WHERE status NOT IN ('pending', 'committed', 'deleted')",
        f"SELECT 'reports.status', count(*) FROM {_prefix}reports WHERE status NOT IN ('open', 'actioned', 'dismissed')",
        f"SELECT 'shares.duplicate.slug', count(*) FROM (SELECT slug FROM {_prefix}shares GROUP BY 1 HAVING count(*) > 1)",
        f"SELECT 'reports.duplicate.slug_reporter', count(*) FROM (SELECT 1 FROM {_prefix}reports GROUP BY slug, reporter_ip_hash HAVING count(*) > 1)",
        f"SELECT 'views.unknown_slug', count(*) FROM {_prefix}views WHERE slug NOT IN (SELECT slug FROM {_prefix}shares)",
        f"SELECT 'reports.unknown_slug', count(*) FROM {_prefix}reports WHERE slug NOT IN (SELECT slug FROM {_prefix}shares)",
    ]
    SQL[_name] = f"SELECT rule, n FROM ({' UNION ALL '.join(_parts)}) WHERE n > 0"
SQL["a4_merged_days"] = SQL["a1_load_views"]
SQL["c1_rolled_counts"] = "SELECT * EXCLUDE (unique_viewers), TRUE AS viewers_near FROM counts"
for _name, _whole in (
    ("c2_rolled_referrers", "c2_referrer_breakdown"), ("c3_rolled_locations", "c3_location_breakdown"),
    ("c4_rolled_trend", "c4_daily_trend"), ("f5_rolled_ledger", "f5_retention_ledger"),
):
    SQL[_name] = SQL[_whole]
SQL["f1_log_after_all_writers"] = SQL["f1_anonymize_log"]
SQL["f2_stored_purge"] = SQL["a1_load_views"].replace("FROM fx_views", "FROM fx_views WHERE slug NOT IN (SELECT slug FROM stale)")
SQL["f3_stored_deletes"] = SQL["f3_deleted_shares"]
SQL["f4_stored_shares"] = SQL["f4_maintenance_shares"]
SQL["f4_stored_ledger"] = SQL["f5_ledger_after_run"]
SQL["b6_render_stored"] = SQL["b6_render_pages"]
SQL["s1_stream_enrich"] = SQL["a4_append_views"]
SQL["s5_stream_upload_limiter"] = SQL["g1_admit_uploads"]
SQL["s6_stream_reports"] = SQL["g7_new_reports"]


def _needed(body: str) -> list[str]:
    """CTEs a text uses, in order of definition."""
    names: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & CTE.keys() - names:
            names.add(name)
            todo.append(CTE[name])
    return [name for name in CTE if name in names]


def oracle(name: str) -> str:
    body = SQL[name]
    ctes = _needed(body)
    heads = ",\n".join(f"{c} AS ({CTE[c]})" for c in ctes)
    if body.startswith("WITH "):
        body = ", " + body[len("WITH "):]
    recursive = "RECURSIVE " if RECURSIVE & set(ctes) else ""
    return f"WITH {recursive}{heads}\n{body}"


def all_oracles() -> dict[str, str]:
    return {name: oracle(name) for name in SQL}
