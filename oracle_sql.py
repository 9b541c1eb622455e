"""DuckDB statements equal to the Spark jobs of ``queries()``.

The views region ... conversations are registered by the checker. Derived fixture views
(captures, link_graph, robots, sitemaps, mail) are inlined as CTEs. The small helpers below
write the same string semantics as ``pagemill.functions.text`` in DuckDB's dialect.
"""

from __future__ import annotations

from pagemill.functions.text import INLINE_WS, LINE_BREAK, WS

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+\\z')}, '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, {q(WS + '+\\z')}, '')"


def splitlines(x: str) -> str:
    body = f"regexp_replace({x}, {q('(?:' + LINE_BREAK + ')\\z')}, '')"
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split_regex({body}, {q(LINE_BREAK)}) END)"


def rstrip_lines(x: str) -> str:
    return f"regexp_replace({x}, {q(INLINE_WS + '+(\\n|\\z)')}, '\\1', 'g')"


def postprocess(x: str) -> str:
    s = f"replace(replace({x}, '[code]', '```' || {NL}), '[/code]', {NL} || '```')"
    s = f"regexp_replace({s}, {q(LINE_BREAK)}, {NL}, 'g')"
    s = rstrip_lines(s)
    s = f"regexp_replace({s}, {q('^\\n+|\\n+\\z')}, '', 'g')"
    s = f"regexp_replace({s}, {q('\\n{3,}')}, {NL} || {NL}, 'g')"
    return f"({s} || {NL})"


ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- step 0: lines

_OCC = f"""
occ AS (
  SELECT doc_id, unnest(arr) AS raw, generate_subscripts(arr, 1) AS pos
  FROM (SELECT doc_id, {splitlines('text')} AS arr FROM documents)
),
k AS (SELECT doc_id, pos, {rstrip('raw')} AS line, {strip('raw')} AS key FROM occ),
freq AS (SELECT key, count(*) AS n FROM k WHERE key <> '' GROUP BY key)
"""

ORACLE["a1_line_freq"] = f"WITH {_OCC} SELECT key AS line, n FROM freq"

ORACLE["a2_boilerplate"] = f"""
WITH {_OCC},
drop_ AS (
  SELECT key FROM freq
  WHERE n > 3 AND NOT (length(key) <= 60 AND (lower(key) IN ('overview', 'introduction', 'summary', 'contents',
        'table of contents') OR starts_with(key, '# ') OR starts_with(key, '## ')))
),
kept AS (
  SELECT k.doc_id, string_agg(k.line, {NL} ORDER BY k.pos) AS body
  FROM k LEFT JOIN drop_ USING (key) WHERE drop_.key IS NULL GROUP BY k.doc_id
)
SELECT d.doc_id, {postprocess("coalesce(kept.body, '')")} AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

# ---------------------------------------------------------------- step 1: URLs

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
PARAMS = r"^((?:.*/)?[^/;]*);([^/]*)$"


def hostname_sql(netloc: str) -> str:
    hi = f"regexp_extract({netloc}, '([^@]*)$', 1)"
    h = f"(CASE WHEN contains({hi}, '[') THEN regexp_extract({hi}, '\\[([^\\]]*)', 1) ELSE regexp_extract({hi}, '^([^:]*)', 1) END)"
    return f"(lower(regexp_extract({h}, '^([^%]*)', 1)) || regexp_extract({h}, '(%.*)$', 1))"


def parts_ctes(src: str, cols: str, url: str, p: str) -> str:
    """CTEs {p}1..{p}5 adding scheme, netloc, path, params, query, host to ``src``."""
    c = f"regexp_replace(regexp_replace({url}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"
    return f"""
{p}1 AS (SELECT {cols}, {c} AS {p}c FROM {src}),
{p}2 AS (SELECT *, regexp_extract({p}c, {q(SCHEME)}, 1) AS {p}s0 FROM {p}1),
{p}3 AS (SELECT *, lower({p}s0) AS {p}scheme,
           CASE WHEN {p}s0 = '' THEN {p}c ELSE substr({p}c, length({p}s0) + 2) END AS {p}r FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN starts_with({p}r, '//') THEN regexp_extract({p}r, '^//([^/?#]*)', 1) ELSE '' END AS {p}netloc,
           regexp_extract(CASE WHEN starts_with({p}r, '//') THEN regexp_extract({p}r, '^//[^/?#]*(.*)$', 1) ELSE {p}r END,
                          '^([^#]*)', 1) AS {p}a FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN contains({p}a, '?') THEN regexp_extract({p}a, '^[^?]*\\?(.*)$', 1) ELSE '' END AS {p}query,
           regexp_extract({p}a, '^([^?]*)', 1) AS {p}pp, {hostname_sql(p + 'netloc')} AS {p}host FROM {p}4),
{p}6 AS (SELECT *, CASE WHEN regexp_matches({p}pp, {q(PARAMS)}) THEN regexp_extract({p}pp, {q(PARAMS)}, 1) ELSE {p}pp END AS {p}path,
           CASE WHEN regexp_matches({p}pp, {q(PARAMS)}) THEN regexp_extract({p}pp, {q(PARAMS)}, 2) ELSE '' END AS {p}params
         FROM {p}5)"""


def norm_ctes(src: str, key: str, url: str, out: str, p: str = "n") -> str:
    """CTEs ending in ``{p}_out(key, {out})``: U1 over ``src``."""
    d = f"regexp_extract(regexp_replace(regexp_replace({url}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', ''), '^([^#]*)', 1)"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return f"""
{p}0 AS (SELECT {key}, {url} AS {p}src,
           CASE WHEN regexp_matches({d}, {q(SCHEME)}) THEN {d} ELSE 'https://' || {d} END AS {p}u FROM {src}),
{parts_ctes(p + '0', f'{key}, {p}src, {p}u', p + 'u', p)},
{p}q0 AS (SELECT {key}, unnest(string_split({p}query, '&')) AS f FROM {p}6),
{p}q1 AS (SELECT {key}, {dec("regexp_extract(f, '^([^=]*)', 1)")} AS k,
             {dec("CASE WHEN contains(f, '=') THEN regexp_extract(f, '^[^=]*=(.*)$', 1) ELSE '' END")} AS v
          FROM {p}q0 WHERE f <> ''),
{p}q2 AS (SELECT {key}, string_agg({enc('k')} || '=' || {enc('v')}, '&' ORDER BY k, v) AS q FROM {p}q1
          WHERE NOT (starts_with(lower(k), 'utm_') OR lower(k) IN ('gclid', 'fbclid', 'mc_cid', 'mc_eid', 'ref', 'source'))
          GROUP BY {key}),
{p}7 AS (SELECT {p}6.*, coalesce({p}q2.q, '') AS {p}qq,
           regexp_replace(CASE WHEN {p}path = '' THEN '/' ELSE {p}path END, '/+', '/', 'g') AS {p}p1
         FROM {p}6 LEFT JOIN {p}q2 USING ({key})),
{p}8 AS (SELECT *, (CASE WHEN {p}p1 <> '/' AND ends_with({p}p1, '/') THEN regexp_replace({p}p1, '/+$', '') ELSE {p}p1 END)
             || CASE WHEN {p}params <> '' THEN ';' || {p}params ELSE '' END AS {p}p3 FROM {p}7),
{p}_out AS (SELECT {key}, CASE WHEN {p}src IS NULL OR {p}src = '' OR {p}scheme NOT IN ('http', 'https') THEN '' ELSE
           {p}scheme || ':' ||
           CASE WHEN {p}netloc <> '' THEN '//' || {p}netloc ||
                  CASE WHEN {p}p3 <> '' AND NOT starts_with({p}p3, '/') THEN '/' || {p}p3 ELSE {p}p3 END
                WHEN starts_with({p}p3, '//') THEN '//' || {p}p3
                WHEN {p}p3 = '' OR starts_with({p}p3, '/') THEN '//' || {p}p3
                ELSE {p}p3 END
           || CASE WHEN {p}qq <> '' THEN '?' || {p}qq ELSE '' END END AS {out}
         FROM {p}8)"""


def root_sql(host: str) -> str:
    return f"regexp_extract(lower({host}), '(?:[^.]*\\.)?[^.]*$', 0)"


def slug_sql(x: str, empty: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif({s}, ''), '{empty}')"


def ipv4_blocked_sql(h: str) -> str:
    o = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
    pat = f"^{o}\\.{o}\\.{o}\\.{o}$"
    v = " + ".join(f"TRY_CAST(regexp_extract({h}, {q(pat)}, {i}) AS BIGINT) * {m}" for i, m in
                   ((1, 1 << 24), (2, 1 << 16), (3, 1 << 8), (4, 1)))
    from pagemill.functions.urls import _IPV4_EXCEPTIONS, _IPV4_PRIVATE, _ip_int

    ranges = " OR ".join(f"({v}) BETWEEN {_ip_int(a)} AND {_ip_int(b)}" for a, b in _IPV4_PRIVATE)
    exc = ", ".join(str(_ip_int(x)) for x in _IPV4_EXCEPTIONS)
    return f"(regexp_matches({h}, {q(pat)}) AND ({ranges}) AND ({v}) NOT IN ({exc}))"


def blocked_host_sql(h: str) -> str:
    return f"(lower({h}) IN ('localhost', '127.0.0.1', '::1') OR coalesce({ipv4_blocked_sql(f'lower({h})')}, false))"


ORACLE["u1_norm_url"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')}
SELECT p.page_id, p.url, n.norm_url FROM pages p JOIN n_out n USING (page_id)
"""

ORACLE["x2_first_url"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')}
SELECT n.norm_url, min(p.page_id) AS first_page_id, arg_min(p.url, p.page_id) AS first_url, count(*) AS n_copies
FROM pages p JOIN n_out n USING (page_id) GROUP BY n.norm_url
"""

ORACLE["u4_root_domain"] = f"""
WITH {parts_ctes('pages', 'page_id, url', 'url', 'p')}
SELECT page_id, phost AS host, {root_sql('phost')} AS root_domain FROM p6
"""

ORACLE["u5_host_path"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')}
SELECT page_id, norm_url, hhost AS host,
       CASE WHEN hpath = '' THEN '/' ELSE hpath END || CASE WHEN hquery <> '' THEN '?' || hquery ELSE '' END AS path
FROM h6
"""

ORACLE["u6_public_url"] = f"""
WITH base AS (SELECT page_id, CASE WHEN regexp_matches(regexp_replace(regexp_replace(url, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', ''),
                                    {q(SCHEME)}) THEN url ELSE 'https://' || url END AS u FROM pages),
{parts_ctes('base', 'page_id, u', 'u', 'p')},
r AS (SELECT *, CASE WHEN pscheme NOT IN ('http', 'https') THEN 'Only http(s) URLs are allowed.'
                     WHEN phost = 'localhost' OR coalesce({ipv4_blocked_sql('phost')}, false) THEN 'Target host is not allowed.'
                     ELSE '' END AS reject_reason FROM p6)
SELECT page_id, CASE WHEN reject_reason = '' THEN pscheme || '://' || pnetloc || ppath
                     || CASE WHEN pparams <> '' THEN ';' || pparams ELSE '' END
                     || CASE WHEN pquery <> '' THEN '?' || pquery ELSE '' END
                     || CASE WHEN contains(u, '#') THEN '#' || regexp_extract(u, '#(.*)$', 1) ELSE '' END END AS safe_url,
       reject_reason
FROM r
"""

ORACLE["u7_slug"] = f"SELECT page_id, {slug_sql('url', 'page')} AS slug, {slug_sql(chr(39) + '!!' + chr(39), 'document')} AS empty_slug FROM pages"

ORACLE["p2_blocked_url"] = f"""
WITH {parts_ctes('pages', 'page_id, url', 'url', 'p')}
SELECT page_id, {blocked_host_sql('phost')} AS blocked_host,
       (pscheme NOT IN ('http', 'https') OR {blocked_host_sql('phost')}) AS blocked_url FROM p6
"""

_SEEDED = f"""
{norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
roots AS (SELECT page_id, norm_url, hscheme, hhost, {root_sql('hhost')} AS root FROM h6),
seeds AS (SELECT root, arg_min(norm_url, page_id) AS seed_url FROM roots GROUP BY root),
{parts_ctes('seeds', 'root, seed_url', 'seed_url', 's')},
seeded AS (SELECT r.*, s6.seed_url, s6.shost AS start_host FROM roots r JOIN s6 USING (root))
"""

ORACLE["p3_internal"] = f"""
WITH {_SEEDED}
SELECT page_id, seed_url,
  CASE WHEN hscheme NOT IN ('', 'http', 'https') THEN false WHEN {blocked_host_sql('hhost')} THEN false
       WHEN hhost = '' THEN true WHEN hhost = lower(start_host) THEN true WHEN hhost = root THEN true ELSE false END AS internal,
  CASE WHEN hscheme NOT IN ('', 'http', 'https') THEN false WHEN {blocked_host_sql('hhost')} THEN false
       WHEN hhost = '' THEN true WHEN hhost = lower(start_host) THEN true WHEN hhost = root THEN true
       WHEN ends_with(hhost, '.' || root) THEN true ELSE false END AS internal_sub
FROM seeded
"""

ORACLE["p4_p5_filters"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
{parts_ctes('pages', 'page_id', 'url', 'r')}
SELECT h6.page_id,
  starts_with(CASE WHEN hpath = '' THEN '/' ELSE hpath END || CASE WHEN hquery <> '' THEN '?' || hquery ELSE '' END, '/en/')
  OR starts_with(CASE WHEN hpath = '' THEN '/' ELSE hpath END || CASE WHEN hquery <> '' THEN '?' || hquery ELSE '' END, '/de/')
    AS prefix_ok,
  list_bool_or(list_transform(['.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico', '.css', '.js', '.pdf', '.zip', '.tar', '.gz',
                               '.rar', '.mp4', '.mp3', '.wav'], lambda e: ends_with(lower(rpath), e))) AS ignored_ext
FROM h6 JOIN r6 USING (page_id)
"""

# ---------------------------------------------------------------- derived views (FIXTURES.md section 2)

CAPTURES = """
captures AS (
SELECT p.page_id, p.url, CAST(a.attempt AS INTEGER) AS attempt,
 CAST(CASE WHEN p.page_id % 10 = 0 AND a.attempt = 0 THEN 503 WHEN p.page_id % 10 = 1 THEN 404 WHEN p.page_id % 10 = 2 THEN 403
      WHEN p.page_id % 10 = 3 THEN 429 WHEN p.page_id % 10 = 4 AND a.attempt < 2 THEN NULL ELSE 200 END AS INTEGER) AS status,
 CASE WHEN p.page_id % 10 = 5 THEN 'application/pdf' WHEN p.page_id % 10 = 4 AND a.attempt < 2 THEN '' ELSE 'text/html; charset=utf-8' END AS content_type,
 CASE WHEN p.page_id % 10 = 4 AND a.attempt < 2 THEN 'timeout' ELSE '' END AS failure,
 CASE WHEN p.page_id % 25 = 7 THEN regexp_extract(p.url, '^(https?://[^/?#]+)', 1) || '/' ELSE p.url END AS final_url,
 CAST(length(p.html) AS BIGINT) AS chars, CAST(50 + (p.page_id * 37 + a.attempt * 11) % 400 AS BIGINT) AS elapsed_ms
FROM pages p CROSS JOIN (VALUES (0),(1),(2)) a(attempt)
WHERE a.attempt = 0 OR (p.page_id % 10 = 0 AND a.attempt = 1) OR p.page_id % 10 IN (3, 4))
"""

ROBOTS = """
robots AS (
SELECT host, CASE k WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /de/' || chr(10) || 'Disallow: /fr/' || chr(10) || 'Allow: /fr/'
 WHEN 1 THEN 'User-agent: somebot' || chr(10) || 'Disallow: /' || chr(10) || '# note' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /es/'
 WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow:' ELSE '' END AS content
FROM (SELECT host, min(page_id) % 4 AS k FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) x GROUP BY host) y)
"""

SITEMAPS = """
sitemaps AS (
SELECT host, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url>', '' ORDER BY page_id) || '</urlset>' AS content
FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) x GROUP BY host)
"""

MAIL = """
mail AS (
SELECT conv_id, 'mail-' || CAST(conv_id AS VARCHAR) || '.mbox' AS filename, string_agg('From x@example.com' || chr(10) || 'From: ' || role || '@example.com' || chr(10) || 'To: kb@example.com' || chr(10) || 'Subject: Turn ' || CAST(turn AS VARCHAR) || chr(10) || chr(10) || replace(text, chr(10) || 'From ', chr(10) || '>From ') || chr(10), chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id)
"""

LINK_GRAPH = """
link_graph AS (
SELECT p.page_id AS src, CAST(t.pos AS INTEGER) AS pos, (p.page_id * 7 + t.pos * t.pos * 3 + 1) % n.n AS dst
FROM pages p CROSS JOIN (VALUES (0),(1),(2),(3),(4)) t(pos) CROSS JOIN (SELECT count(*) AS n FROM pages) n)
"""

# ---------------------------------------------------------------- step 3: robots

RULES = f"""
{ROBOTS},
rl0 AS (SELECT host, unnest(arr) AS raw, generate_subscripts(arr, 1) AS n FROM (SELECT host, {splitlines('content')} AS arr FROM robots)),
rl1 AS (SELECT host, n, {strip('raw')} AS line FROM rl0),
rl2 AS (SELECT host, n, line,
          CASE WHEN starts_with(lower(line), 'user-agent:') THEN 'user-agent' WHEN starts_with(lower(line), 'disallow:') THEN 'disallow'
               WHEN starts_with(lower(line), 'allow:') THEN 'allow' ELSE 'other' END AS field,
          {strip("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value
        FROM rl1 WHERE line <> '' AND NOT starts_with(line, '#')),
rl3 AS (SELECT *, coalesce(last(CASE WHEN field = 'user-agent' THEN lower(value) = '*' END IGNORE NULLS)
                   OVER (PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS relevant FROM rl2),
rl4 AS (SELECT host, n, CASE WHEN field = 'disallow' AND value = '' THEN '/' ELSE value END AS rule,
               CASE WHEN field = 'disallow' THEN 1 ELSE -1 END AS d
        FROM rl3 WHERE relevant AND field IN ('disallow', 'allow')),
rl5 AS (SELECT *, sum(d) OVER (PARTITION BY host, rule ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM rl4),
rules AS (SELECT host, rule, CAST(sum(d) - least(0, min(s)) AS INTEGER) AS copies FROM rl5 GROUP BY host, rule HAVING sum(d) - least(0, min(s)) > 0)
"""

ORACLE["w1_robots_rules"] = f"WITH {RULES} SELECT host, rule, copies FROM rules"

_DISALLOWED = f"""
{RULES},
{norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
dis AS (SELECT page_id, norm_url, EXISTS (SELECT 1 FROM rules r WHERE r.host = h6.hhost AND
          (r.rule = '/' OR starts_with(CASE WHEN h6.hpath = '' THEN '/' ELSE h6.hpath END, r.rule))) AS disallowed FROM h6)
"""

ORACLE["j1_robots_disallowed"] = f"WITH {_DISALLOWED} SELECT page_id, norm_url, disallowed FROM dis"

_DECIDED = f"""
{_DISALLOWED},
seeds AS (SELECT {root_sql('hhost')} AS root, arg_min(norm_url, page_id) AS seed_url FROM h6 GROUP BY 1),
{parts_ctes('seeds', 'root, seed_url', 'seed_url', 's')},
dec AS (
  SELECT h6.page_id, h6.norm_url, dis.disallowed,
    list_bool_or(list_transform(['.png', '.jpg', '.jpeg', '.gif', '.svg', '.ico', '.css', '.js', '.pdf', '.zip', '.tar', '.gz',
                 '.rar', '.mp4', '.mp3', '.wav'], lambda e: ends_with(lower(h6.hpath), e))) AS ignored_ext,
    CASE WHEN h6.hscheme NOT IN ('', 'http', 'https') THEN false WHEN {blocked_host_sql('h6.hhost')} THEN false
         WHEN h6.hhost = '' THEN true WHEN h6.hhost = lower(s6.shost) THEN true WHEN h6.hhost = s6.root THEN true ELSE false END AS internal,
    (h6.hscheme NOT IN ('http', 'https') OR {blocked_host_sql('h6.hhost')}) AS blocked_url
  FROM h6 JOIN dis USING (page_id) JOIN s6 ON s6.root = {root_sql('h6.hhost')})
"""

ORACLE["p7_url_decision"] = f"""
WITH {_DECIDED}
SELECT page_id, norm_url, reason = 'ok' AS allowed, reason FROM (
  SELECT page_id, norm_url, CASE WHEN ignored_ext THEN 'ignored-extension' WHEN NOT internal THEN 'external'
                                 WHEN disallowed THEN 'robots-disallowed' ELSE 'ok' END AS reason FROM dec)
"""

ORACLE["p9_can_visit"] = f"""
WITH {_DECIDED}
SELECT page_id, NOT blocked_url AND NOT ignored_ext AND internal AND NOT disallowed AS can_visit,
  CASE WHEN blocked_url THEN 'blocked-host' WHEN disallowed THEN 'robots-disallowed' ELSE '' END AS error_reason,
  (NOT blocked_url AND disallowed) AS has_diagnostic
FROM dec
"""

# ---------------------------------------------------------------- step 4: fetch log

_CLASSIFIED = f"""
{CAPTURES},
cls AS (SELECT *,
  CASE WHEN failure = 'timeout' THEN 'timeout' WHEN failure <> '' THEN 'http-error'
       WHEN status >= 400 THEN CASE WHEN status IN (401, 403, 429) THEN 'blocked' ELSE 'http-error' END
       WHEN NOT (contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml+xml')) THEN 'non-html'
       ELSE 'ok' END AS reason,
  coalesce((status IN (408, 425, 429, 500, 502, 503, 504) OR failure <> '') AND attempt < 2, false) AS retryable
FROM captures),
last_ AS (SELECT page_id, arg_max(attempt, attempt) AS attempt, arg_max(status, attempt) AS status, arg_max(reason, attempt) AS reason,
                 arg_max(url, attempt) AS url, arg_max(final_url, attempt) AS final_url, arg_max(content_type, attempt) AS content_type,
                 arg_max(chars, attempt) AS chars, arg_max(elapsed_ms, attempt) AS elapsed_ms, count(*) AS attempts
          FROM cls GROUP BY page_id),
diag AS (SELECT page_id, url, CASE WHEN reason = 'timeout' THEN url ELSE final_url END AS final_url,
                coalesce(CAST(status AS VARCHAR), '') AS status, CASE WHEN reason = 'timeout' THEN '' ELSE content_type END AS content_type,
                CAST(CASE WHEN reason = 'timeout' THEN 0 ELSE chars END AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS extracted_chars,
                elapsed_ms, reason, 'http' AS renderer, '' AS error FROM last_)
"""

ORACLE["f1_outcome"] = f"""
WITH {_CLASSIFIED}
SELECT page_id, attempt, contains(lower(coalesce(content_type, '')), 'text/html') OR contains(lower(coalesce(content_type, '')), 'application/xhtml+xml') AS is_html,
       reason, retryable FROM cls
"""

ORACLE["f3_backoff"] = f"""
WITH {_CLASSIFIED}
SELECT page_id, url, attempt + 1 AS next_attempt, 0.5 * pow(2.0, attempt) AS delay_s FROM cls WHERE retryable
"""

ORACLE["w3_last_attempt"] = f"""
WITH {_CLASSIFIED},
chk AS (SELECT page_id, bool_and(CASE WHEN attempt < mx THEN retryable ELSE true END) AS consistent
        FROM (SELECT *, max(attempt) OVER (PARTITION BY page_id) AS mx FROM cls) GROUP BY page_id)
SELECT page_id, attempt, status, reason, attempts, consistent FROM last_ JOIN chk USING (page_id)
"""

ORACLE["f5_diagnostics"] = f"WITH {_CLASSIFIED} SELECT * FROM diag"

ORACLE["f6_errors"] = f"""
WITH {_CLASSIFIED}
SELECT page_id, url, reason, CASE WHEN reason = 'timeout' THEN '' ELSE status END AS status FROM diag WHERE reason <> 'ok'
"""

ORACLE["a9_by_reason"] = f"""
WITH {_CLASSIFIED}
SELECT reason, renderer, count(*) AS n, sum(elapsed_ms) AS total_elapsed_ms, max(elapsed_ms) AS max_elapsed_ms FROM diag GROUP BY ALL
"""

_RENDERED = f"""
{_CLASSIFIED},
rendered AS (
  SELECT page_id, attempt, 'http' AS renderer, reason, CASE WHEN page_id % 7 = 0 THEN 100 ELSE chars END AS chars FROM cls
  UNION ALL
  SELECT page_id, attempt, 'browser', CASE WHEN page_id % 15 = 0 THEN 'http-error' ELSE 'ok' END, chars FROM cls WHERE attempt = 0 AND page_id % 3 = 0)
"""

ORACLE["f4_variant"] = f"""
WITH {_RENDERED},
p AS (SELECT *, CASE WHEN renderer = 'http' AND chars >= 600 THEN 3 WHEN renderer = 'browser' THEN 2 ELSE 1 END AS prio FROM rendered WHERE reason = 'ok')
SELECT page_id, attempt, renderer, reason, chars FROM p
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY prio DESC, attempt DESC) = 1
"""

ORACLE["f4_browser_variant"] = f"""
WITH {_RENDERED}
SELECT page_id, attempt, renderer, reason, chars FROM rendered WHERE renderer = 'browser' AND reason = 'ok'
"""

ORACLE["w2_latest_diag"] = f"""
WITH {_CLASSIFIED},
u AS (SELECT url AS any_url, * FROM diag UNION ALL SELECT final_url, * FROM diag WHERE final_url <> url)
SELECT any_url, page_id, reason FROM u QUALIFY row_number() OVER (PARTITION BY any_url ORDER BY page_id DESC) = 1
"""

# ---------------------------------------------------------------- steps 2 + 5: HTML (regular markup of the fixture)


def unescape_sql(x: str) -> str:
    s = f"replace(replace(replace({x}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183))"
    return f"regexp_replace({s}, '&amp;?', '&', 'g')"


ORACLE["h3_title"] = f"""
SELECT page_id, {strip(unescape_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title FROM pages
"""

ORACLE["h4_main_text"] = f"""
WITH a AS (SELECT page_id, unnest(string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1), '<[^>]*>')) AS raw,
                  generate_subscripts(string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1), '<[^>]*>'), 1) AS k
           FROM pages),
s AS (SELECT page_id, k, {strip(unescape_sql('raw'))} AS s FROM a)
SELECT page_id, string_agg(s, ' ' ORDER BY k) AS main_text FROM s WHERE s <> '' GROUP BY page_id
"""

ORACLE["g1_links"] = f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
                  CAST(generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS INTEGER) AS pos FROM pages),
j AS (SELECT page_id, pos, {unescape_sql('href')} AS href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {unescape_sql('href')} AS absu FROM a),
{norm_ctes('j', 'page_id, pos', 'absu', 'dst_url')}
SELECT j.page_id, j.pos, j.href, n.dst_url FROM j JOIN n_out n USING (page_id, pos)
"""

# ---------------------------------------------------------------- step 8: exports over SQL-expressible records

RECORDS = f"""
t3 AS ({ORACLE['h3_title'].strip()}),
m4 AS ({ORACLE['h4_main_text'].strip()}),
{norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
recs AS (
  SELECT CAST(h6.page_id AS BIGINT) AS ord, h6.norm_url AS url, hhost AS host,
         CASE WHEN hpath = '' THEN '/' ELSE hpath END || CASE WHEN hquery <> '' THEN '?' || hquery ELSE '' END AS path,
         coalesce(nullif(t3.title, ''), h6.norm_url) AS title, coalesce(m4.main_text, '') || chr(10) AS markdown
  FROM h6 LEFT JOIN t3 USING (page_id) LEFT JOIN m4 USING (page_id))
"""


def _nz(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


FILES = f"""
files AS (SELECT *, coalesce(host, '') || '__' || {slug_sql(_nz('title', 'path', 'url'), 'page')} || '.md' AS filename FROM recs)
"""

ORACLE["s11_files"] = f"WITH {RECORDS}, {FILES} SELECT filename, coalesce(markdown, '') AS content FROM files"

ORACLE["s15_preview"] = f"WITH {RECORDS}, {FILES} SELECT ord AS id, url, host, path, title, filename AS suggested_filename FROM files"

ORACLE["p12_search"] = f"""
WITH {RECORDS}, {FILES}
SELECT ord AS id, url, host, path, title, filename AS suggested_filename, coalesce(nullif(host, ''), 'Unknown host') AS host_label
FROM files WHERE contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(path, ''), coalesce(url, ''))), 'the')
"""

ORACLE["x3_hosts"] = f"WITH {RECORDS} SELECT DISTINCT coalesce(nullif(host, ''), 'Unknown host') AS host FROM recs"

ORACLE["a6_pages_per_host"] = f"""
WITH {RECORDS} SELECT coalesce(nullif(host, ''), 'Unknown host') AS host, count(*) AS pages, min(ord) AS first_ord FROM recs GROUP BY 1
"""

_SEL = f"""
{RECORDS},
sel AS (SELECT *, contains(lower(concat_ws(' ', coalesce(title, ''), coalesce(path, ''), coalesce(url, ''))), 'the') AS selected FROM recs)
"""

ORACLE["a8_selection"] = f"""
WITH {_SEL}
SELECT coalesce(nullif(host, ''), 'Unknown host') AS host, count(*) AS total, count_if(selected) AS selected,
       bool_and(selected) AS all_selected, bool_or(selected) AS some_selected FROM sel GROUP BY 1
UNION ALL
SELECT NULL AS host, count(*), count_if(selected), bool_and(selected), bool_or(selected) FROM sel
"""

ORACLE["s16_selected"] = f"""
WITH {_SEL}
SELECT coalesce(host, '') || '__' || {slug_sql(_nz('title', 'path', 'url'), 'page')} || '.md' AS filename, coalesce(markdown, '') AS content
FROM sel WHERE url IN (SELECT url FROM sel WHERE selected)
"""

ORACLE["a4_run_summary"] = f"""
WITH {RECORDS}, {_CLASSIFIED},
errs AS (SELECT count(*) AS errors_count FROM diag WHERE reason <> 'ok')
SELECT count(*) AS pages_count, CAST(coalesce(sum(length(markdown)), 0) AS BIGINT) AS total_chars,
       count_if(length({strip('markdown')}) < 200) AS thin_pages_count, (SELECT errors_count FROM errs) AS errors_count,
       CAST(0 AS BIGINT) AS skipped_links, false AS timed_out,
       count(*) > 0 AND coalesce(sum(length(markdown)), 0) >= 500 AS accepted, count(*) > 0 AS preview_ok
FROM recs
"""

ORACLE["s10_grouped"] = f"""
WITH {RECORDS},
f AS (SELECT coalesce(host, '') AS h, min(ord) AS first FROM recs GROUP BY 1),
r AS (SELECT recs.*, f.h, f.first, ord = f.first AS is_first, (SELECT min(ord) FROM recs) AS top FROM recs JOIN f ON coalesce(recs.host, '') = f.h)
SELECT first AS host_rank, ord,
  CASE WHEN ord = top THEN '# ' || h || chr(10) || chr(10) WHEN is_first THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# ' || h || chr(10) || chr(10)
       ELSE chr(10) || chr(10) END
  || '## ' || coalesce({_nz('title', 'path', 'url')}, 'Page') || chr(10) || chr(10) || coalesce(markdown, '') || chr(10) AS text
FROM r
"""

ORACLE["s12_index"] = f"""
WITH {RECORDS}, {FILES},
r AS (SELECT *, coalesce(host, '') AS h FROM files)
SELECT 0 AS k, '' AS host, CAST(-2 AS BIGINT) AS ord, '# Index' AS line
UNION ALL SELECT 0, '', CAST(-1 AS BIGINT), ''
UNION ALL SELECT DISTINCT 1, h, CAST(-1 AS BIGINT), '## ' || h FROM r
UNION ALL SELECT 1, h, ord, '- [' || {_nz('title', 'path', 'url', 'filename')} || '](' || filename || ')' FROM r WHERE coalesce(filename, '') <> ''
UNION ALL SELECT DISTINCT 1, h, CAST(4611686018427387904 AS BIGINT), '' FROM r
"""

ORACLE["a7_combined"] = f"""
WITH {RECORDS}, {_CLASSIFIED},
errs AS (SELECT page_id AS seq, url, reason, CASE WHEN reason = 'timeout' THEN '' ELSE status END AS status FROM diag WHERE reason <> 'ok'),
first20 AS (SELECT * FROM errs ORDER BY seq LIMIT 20),
head AS (SELECT '<!-- Crawl summary:' || chr(10) || 'Total pages: ' || (SELECT count(*) FROM recs) || chr(10) || 'Skipped links: 0' || chr(10)
               || 'Errors: ' || (SELECT count(*) FROM errs) || chr(10)
               || coalesce((SELECT string_agg('  - ' || url || ' (' || reason || CASE WHEN coalesce(status, '') <> '' THEN ' ' || status ELSE '' END || ')', chr(10) ORDER BY seq) FROM first20) || chr(10), '')
               || '-->' AS text),
hh AS (SELECT recs.*, coalesce(nullif(host, ''), 'unknown host') AS h FROM recs),
f AS (SELECT h, min(ord) AS first FROM hh GROUP BY h),
r AS (SELECT hh.*, ord = f.first AS is_first, (SELECT min(h) FROM hh) AS top FROM hh JOIN f USING (h)),
sec AS (SELECT *, '## ' || {_nz('title', 'path', 'url')} || chr(10) || chr(10) || {rstrip("coalesce(markdown, '')")} || chr(10) AS s FROM r)
SELECT 0 AS section, '' AS host, CAST(0 AS BIGINT) AS ord, text FROM head
UNION ALL
SELECT 1, h, ord, CASE WHEN is_first THEN (CASE WHEN h = top THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END)
                                     || '# ' || h || chr(10) || chr(10) || s ELSE chr(10) || chr(10) || s END FROM sec
UNION ALL
SELECT 2, '', CAST(0 AS BIGINT), chr(10) FROM (SELECT count(*) AS c FROM recs) WHERE c = 0
"""


def _blocks(document: str, text: str) -> str:
    """Blocks of 64 KiB of the UTF-8 bytes of each ``text`` (one row per document), with their checksums."""
    return f"""
SELECT document, CAST(k AS BIGINT) AS block, CAST(length(b) // 2 AS BIGINT) AS bytes, sha256(unhex(b)) AS sha256
FROM (SELECT document, k, substr(x, 131072 * k + 1, 131072) AS b
      FROM (SELECT *, unnest(range(1 + length(x) // 131072)) AS k FROM (SELECT {document} AS document, hex(encode({text})) AS x FROM whole)))
WHERE b <> ''
"""


ORACLE["s9_written"] = f"""
WITH parts AS ({ORACLE["a7_combined"]}),
{RECORDS},
whole AS (SELECT string_agg(text, '' ORDER BY section, host, ord) AS body FROM parts),
named AS (SELECT {slug_sql('min(host)', 'output')} || '__20240102_030405.md' AS name FROM recs)
""" + _blocks("(SELECT name FROM named)", "body")

# ---------------------------------------------------------------- step 6: crawl + sitemaps

ORACLE["g2_bfs"] = f"""
WITH RECURSIVE {LINK_GRAPH},
r(node, depth) AS (SELECT (SELECT min(page_id) FROM pages), 0
                   UNION SELECT e.dst, r.depth + 1 FROM r JOIN link_graph e ON e.src = r.node WHERE r.depth < 40)
SELECT node AS page_id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node
"""


def crawl_ctes(levels: int, max_pages: int | None = None) -> str:
    """The crawl level by level: lvK (nodes), eK (links of the level above) and dK (their decisions)."""
    out = [f"{LINK_GRAPH}, lv0 AS MATERIALIZED (SELECT min(page_id) AS node, 0 AS depth, 0::BIGINT AS ord, NULL::BIGINT AS parent, NULL::INTEGER AS pos FROM pages)"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM lv{j}" for j in range(k))
        total = f"(SELECT count(*) FROM ({seen}))"
        cut = f"WHERE ord < {max_pages}" if max_pages else ""
        out.append(f"e{k} AS MATERIALIZED (SELECT g.src, g.pos, g.dst, p.ord AS parent, g.dst IN ({seen}) AS seen FROM lv{k - 1} p JOIN link_graph g ON g.src = p.node)")
        out.append(
            f"lv{k} AS MATERIALIZED (SELECT * FROM (SELECT dst AS node, {k} AS depth, {total} + row_number() OVER (ORDER BY parent, pos) - 1 AS ord, parent, pos "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY parent, pos) AS rn FROM e{k} WHERE NOT seen) WHERE rn = 1) {cut})"
        )
        over = (
            f"WHEN {total} + (SELECT count(*) FROM lv{k}) >= {max_pages} AND (SELECT count(*) FROM lv{k} WHERE (lv{k}.parent, lv{k}.pos) > (e{k}.parent, e{k}.pos)) = 0 THEN 'budget' "
            if max_pages else ""
        )
        out.append(
            f"d{k} AS (SELECT src, e{k}.pos, dst, {k} AS depth, CASE WHEN lv{k}.node IS NOT NULL THEN 'admitted' {over}ELSE 'seen' END AS decision "
            f"FROM e{k} LEFT JOIN lv{k} ON lv{k}.parent = e{k}.parent AND lv{k}.pos = e{k}.pos)"
        )
    return ",\n".join(out)


def _all(name: str, levels: range) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in levels)


LEVELS = 14  # more than the link graph has at the checked size; deeper levels would be empty
_ORDER = "SELECT node AS page_id, CAST(depth AS INTEGER) AS depth, ord, parent, pos FROM"
ORACLE["g2_crawl_order"] = f"WITH {crawl_ctes(LEVELS)} {_ORDER} ({_all('lv', range(LEVELS + 1))})"
ORACLE["g3_decisions"] = f"WITH {crawl_ctes(LEVELS)} {_all('d', range(1, LEVELS + 1))}"
ORACLE["a10_skipped"] = f"WITH {crawl_ctes(LEVELS)} SELECT decision, count(*) AS n FROM ({_all('d', range(1, LEVELS + 1))}) GROUP BY decision"
ORACLE["g4_budget_order"] = f"WITH {crawl_ctes(4, 100)} {_ORDER} ({_all('lv', range(5))})"
ORACLE["g4_budget_decisions"] = f"""WITH {crawl_ctes(4, 100)}
{_all('d', range(1, 5))} UNION ALL
SELECT g.src, g.pos, g.dst, 5 AS depth, 'depth' AS decision FROM lv4 p JOIN link_graph g ON g.src = p.node"""

_SM = f"""
{SITEMAPS},
e AS (SELECT host, unnest(regexp_extract_all(content, '<loc>([^<]*)</loc>', 1)) AS raw,
             CAST(generate_subscripts(regexp_extract_all(content, '<loc>([^<]*)</loc>', 1), 1) - 1 AS INTEGER) AS pos FROM sitemaps),
e2 AS (SELECT host, 'url' AS kind, pos, {strip("replace(raw, '&amp;', '&')")} AS loc FROM e)
"""

ORACLE["s2_sitemap_urls"] = f"""
WITH {_SM}, {norm_ctes('e2', 'host, pos', 'loc', 'norm_url')}
SELECT e2.host, e2.kind, e2.pos, e2.loc, n.norm_url FROM e2 JOIN n_out n USING (host, pos)
"""

# ---------------------------------------------------------------- step 7: import (text files are SQL-expressible)


def t1_sql(x: str, final_newline: bool = True) -> str:
    s = f"regexp_replace({x}, {q(chr(10) + '{3,}')}, {NL} || {NL}, 'g')"
    s = f"regexp_replace(regexp_replace({s}, {q('(?:' + LINE_BREAK + ')\\z')}, ''), {q(LINE_BREAK)}, {NL}, 'g')"
    s = strip(rstrip_lines(s))
    if final_newline:
        s = f"({s} || {NL})"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {s} END)"


ORACLE["t1_normalize"] = f"SELECT doc_id, {t1_sql('text')} AS t1, {t1_sql('text', False)} AS t3, CAST(length({strip('text')}) AS INTEGER) AS t4 FROM documents"

_TXT = """
f AS (SELECT doc_id, '/import/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS path, text FROM documents)
"""

ORACLE["s4_text_import"] = f"""
WITH {_TXT}
SELECT CAST(doc_id AS BIGINT) * 2147483648 AS doc_no, regexp_extract(path, '([^/]*)$', 1) AS source, regexp_extract(path, '([^/]*)$', 1) AS title,
       {t1_sql('text')} AS body_markdown, 'text' AS type FROM f
"""

ORACLE["s13_import_combined"] = f"""
WITH {_TXT}
SELECT CAST(doc_id AS BIGINT) * 2147483648 AS doc_no,
       '# ' || regexp_extract(path, '([^/]*)$', 1) || chr(10) || chr(10) || {strip(t1_sql('text'))} || chr(10) AS text FROM f
"""

ORACLE["s13_written"] = f"""
WITH parts AS ({ORACLE["s13_import_combined"]}),
joined AS (SELECT string_agg(text, chr(10) ORDER BY doc_no) AS body FROM parts),
whole AS (SELECT {t1_sql("body")} AS body FROM joined)
""" + _blocks("'imported.md'", "body")

_BUNDLE = f"""
{_TXT},
bundle AS (SELECT CAST(doc_id AS BIGINT) * 2147483648 AS doc_no, row_number() OVER (ORDER BY doc_id) AS i,
                  {slug_sql("regexp_extract(path, '([^/]*)$', 1)", 'document')} || '.md' AS filename, {t1_sql('text')} AS content,
                  regexp_extract(path, '([^/]*)$', 1) AS title FROM f)
"""

ORACLE["s14_import_bundle"] = f"WITH {_BUNDLE} SELECT doc_no, i, filename, content FROM bundle"

ORACLE["s14_index"] = f"""
WITH {_BUNDLE}
SELECT i, '- [' || title || '](' || filename || ')' AS line FROM bundle UNION ALL SELECT -1, '# Imported documents' UNION ALL SELECT 0, ''
"""

# the sitemap of a host lists its pages in page order, so P8 of an entry is that of its page
ORACLE["g5_sitemap_enqueue"] = f"""
WITH {_DECIDED},
entries AS (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS pos
            FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages))
SELECT host, norm_url, min(pos) AS pos, 0 AS depth FROM entries JOIN dec USING (page_id)
WHERE norm_url <> '' AND NOT ignored_ext AND NOT disallowed AND NOT blocked_url GROUP BY ALL
"""

# ---------------------------------------------------------------- many sites at once, sitemap indexes


def site_ctes(levels: int, lv0: str, max_pages: int | None = None) -> str:
    """Crawls by site over ``edges(site, src, pos, dst, ok)``: lvK (nodes of a level), eK (its links), dK (their decisions)."""
    out = [f"lv0 AS MATERIALIZED ({lv0})"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT site, node FROM lv{j}" for j in range(k))
        cut = f"WHERE ord < {max_pages}" if max_pages else ""
        out.append(f"seen{k} AS MATERIALIZED ({seen})")
        out.append(f"used{k} AS MATERIALIZED (SELECT site, count(*) AS used FROM seen{k} GROUP BY site)")
        out.append(
            f"e{k} AS MATERIALIZED (SELECT g.site, g.src, g.pos, g.dst, g.ok, p.ord AS parent, s.node IS NOT NULL AS seen FROM lv{k - 1} p "
            f"JOIN edges g ON g.site = p.site AND g.src = p.node LEFT JOIN seen{k} s ON s.site = g.site AND s.node = g.dst)"
        )
        out.append(
            f"lv{k} AS MATERIALIZED (SELECT * FROM (SELECT site, dst AS node, {k} AS depth, used + row_number() OVER (PARTITION BY site ORDER BY parent, pos) - 1 AS ord, parent, pos "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY site, dst ORDER BY parent, pos) AS rn FROM e{k} WHERE NOT seen AND ok) JOIN used{k} USING (site) WHERE rn = 1) {cut})"
        )
        over = (
            f"WHEN used + coalesce(c.n, 0) >= {max_pages} AND (c.n IS NULL OR e{k}.parent > c.parent OR (e{k}.parent = c.parent AND e{k}.pos > c.pos)) THEN 'budget' "
            if max_pages else ""
        )
        out.append(
            f"d{k} AS (SELECT e{k}.site, src, e{k}.pos, dst, {k} AS depth, CASE WHEN lv{k}.node IS NOT NULL THEN 'admitted' {over}WHEN seen THEN 'seen' WHEN NOT ok THEN 'rules' ELSE 'seen' END AS decision "
            f"FROM e{k} JOIN used{k} USING (site) LEFT JOIN lv{k} ON lv{k}.site = e{k}.site AND lv{k}.parent = e{k}.parent AND lv{k}.pos = e{k}.pos "
            f"LEFT JOIN (SELECT site, count(*) AS n, max(parent) AS parent, arg_max(pos, parent * 1000 + pos) AS pos FROM lv{k} GROUP BY site) c ON c.site = e{k}.site)"
        )
    return ",\n".join(out)


_FILES = """
files AS (
  SELECT site, 'https://' || site || '/' || f AS file FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site FROM pages),
    (VALUES ('sitemap.xml'), ('maps/a.xml'), ('maps/b.xml'), ('maps/urls-0.xml'), ('maps/urls-1.xml')) v(f)),
edges AS (
  SELECT site, 'https://' || site || '/' || p AS src, pos, 'https://' || site || '/' || c AS dst, true AS ok FROM (SELECT DISTINCT site FROM files),
    (VALUES ('sitemap.xml', 0, 'maps/a.xml'), ('sitemap.xml', 1, 'maps/b.xml'), ('sitemap.xml', 2, 'missing.xml'),
            ('maps/a.xml', 0, 'maps/urls-0.xml'), ('maps/a.xml', 1, 'sitemap.xml'), ('maps/a.xml', 2, 'maps/urls-1.xml')) v(p, pos, c))
"""
_START_FILE = "SELECT site, file AS node, 0 AS depth, 0::BIGINT AS ord, NULL::BIGINT AS parent, NULL::INTEGER AS pos FROM files WHERE file LIKE '%/sitemap.xml'"
ORACLE["g5_sitemap_files"] = f"""
WITH {_FILES}, {site_ctes(4, _START_FILE)}
SELECT lv.site, node AS file, CAST(depth AS INTEGER) AS depth, ord AS file_ord, f.file IS NOT NULL AS found
FROM ({_all('lv', range(5))}) lv LEFT JOIN files f ON f.file = lv.node
"""

_LISTED = f"""
{_DECIDED},
pg AS (
  SELECT dec.*, h6.hhost, regexp_extract(pages.url, '^https?://([^/?#]+)', 1) AS site FROM dec JOIN h6 USING (page_id) JOIN pages USING (page_id) WHERE dec.norm_url <> ''),
listed AS (
  SELECT *, CASE page_id % 9 WHEN 2 THEN 2 WHEN 0 THEN 4 ELSE 5 END AS file_ord, row_number() OVER (PARTITION BY site, page_id % 9 ORDER BY page_id) - 1 AS pos
  FROM pg WHERE page_id % 9 < 3)
"""
ORACLE["g5_sitemap_file_limit"] = f"WITH {_LISTED} SELECT site, CAST(file_ord AS BIGINT) AS file_ord, CAST(pos AS INTEGER) AS pos, norm_url AS url FROM listed WHERE file_ord < 5"

_QUEUE = f"""
{_LISTED},
queue AS (
  SELECT site, node, row_number() OVER (PARTITION BY site ORDER BY min(place)) - 1 AS ord FROM (
    SELECT site, arg_min(norm_url, page_id) AS node, -1 AS place FROM pg GROUP BY site
    UNION ALL SELECT site, norm_url, file_ord::BIGINT * 1000000000 + pos FROM listed WHERE NOT ignored_ext AND NOT disallowed AND NOT blocked_url) GROUP BY site, node)
"""
ORACLE["x1_site_queue"] = f"WITH {_QUEUE} SELECT site, node, ord FROM queue"

_SITE_EDGES = f"""
{_QUEUE},
placed AS (SELECT page_id, site, norm_url, hhost, ignored_ext, disallowed, blocked_url, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS r, count(*) OVER (PARTITION BY site) AS n FROM pg),
edges AS MATERIALIZED (
  SELECT site, src, pos, min(e).dst AS dst, min(e).ok AS ok FROM (
    SELECT a.site, a.norm_url AS src, t.pos, {{'dst': b.norm_url, 'ok': NOT b.ignored_ext AND NOT b.disallowed AND NOT b.blocked_url
        AND (b.hhost = '' OR b.hhost = lower(a.site) OR b.hhost = {root_sql('a.site')})}} AS e
    FROM placed a CROSS JOIN (VALUES (0), (1), (2)) t(pos)
    JOIN placed b ON CASE WHEN t.pos < 2 THEN b.site = a.site AND b.r = (2 * a.r + t.pos + 1) % a.n ELSE b.page_id = (a.page_id * 7 + 1) % (SELECT count(*) FROM pages) END)
  GROUP BY site, src, pos)
"""
_START_QUEUE = "SELECT site, node, 0 AS depth, ord, NULL::BIGINT AS parent, NULL::INTEGER AS pos FROM queue"
SITE_LEVELS = 12  # more than any site has at the checked size
ORACLE["g2_many_sites"] = f"WITH {_SITE_EDGES}, {site_ctes(SITE_LEVELS, _START_QUEUE)} SELECT site, node, CAST(depth AS INTEGER) AS depth, ord FROM ({_all('lv', range(SITE_LEVELS + 1))})"
ORACLE["g4_site_budgets"] = f"""
WITH {_SITE_EDGES}, {site_ctes(2, _START_QUEUE, 8)}
SELECT * FROM ({_all('d', range(1, 3))})
UNION ALL SELECT p.site, g.src, g.pos, g.dst, 3 AS depth, 'depth' AS decision FROM lv2 p JOIN edges g ON g.site = p.site AND g.src = p.node
"""

# ---------------------------------------------------------------- allowed hosts, many rules for a host

ORACLE["j7_allowed_hosts"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
allowed AS (
  SELECT {root_sql('hhost')} AS a FROM h6 WHERE page_id % 3 = 0 AND hhost <> ''
  UNION SELECT 'shop' || c_custkey || '.example' FROM customer UNION SELECT '.b' UNION SELECT lower(hhost) FROM h6 WHERE page_id % 7 = 1 AND hhost <> '')
SELECT page_id, hhost AS host, EXISTS (SELECT 1 FROM allowed WHERE lower(hhost) = a OR ends_with(lower(hhost), '.' || a)) AS allowed FROM h6
"""

ORACLE["p6_rule_index"] = f"""
WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')},
{parts_ctes('n_out', 'page_id, norm_url', 'norm_url', 'h')},
p AS (SELECT page_id, hhost, CASE WHEN hpath = '' THEN '/' ELSE hpath END AS path FROM h6),
r AS (SELECT DISTINCT hhost, substr(path, 1, CAST(2 + page_id % 13 AS INTEGER)) AS rule FROM p WHERE page_id % 4 = 1
      UNION SELECT DISTINCT hhost, '/none/' || o_orderkey FROM p, orders WHERE page_id = 0)
SELECT page_id, (SELECT max(rule) FROM r WHERE r.hhost = p.hhost AND starts_with(path, rule)) AS longest_rule FROM p
"""

# ---------------------------------------------------------------- step 9: streams (equal to the batch answers)

ORACLE["st1_url_dedupe_stream"] = f"WITH {norm_ctes('pages', 'page_id', 'url', 'norm_url')} SELECT DISTINCT norm_url FROM n_out WHERE norm_url <> ''"

ORACLE["st2_outcome_counts_stream"] = f"""
WITH {_CLASSIFIED},
{parts_ctes('cls', 'reason', 'url', 'c')}
SELECT chost AS host, reason, count(*) AS n FROM c6 GROUP BY ALL
"""

# ---------------------------------------------------------------- S8, J5

ORACLE["s8_url_list"] = f"""
WITH base AS (SELECT page_id, {strip('url')} AS u0 FROM pages),
b2 AS (SELECT page_id, CASE WHEN regexp_matches(regexp_replace(regexp_replace(u0, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', ''),
                                    {q(SCHEME)}) THEN u0 ELSE 'https://' || u0 END AS u, u0 FROM base WHERE u0 <> ''),
{parts_ctes('b2', 'page_id, u, u0', 'u', 'p')},
r AS (SELECT *, CASE WHEN pscheme NOT IN ('http', 'https') THEN 'Only http(s) URLs are allowed.'
                     WHEN phost = 'localhost' OR coalesce({ipv4_blocked_sql('phost')}, false) THEN 'Target host is not allowed.'
                     ELSE '' END AS reject_reason,
             pscheme || '://' || pnetloc || ppath || CASE WHEN pparams <> '' THEN ';' || pparams ELSE '' END
             || CASE WHEN pquery <> '' THEN '?' || pquery ELSE '' END
             || CASE WHEN contains(u, '#') THEN '#' || regexp_extract(u, '#(.*)$', 1) ELSE '' END AS safe FROM p6)
SELECT safe AS url, min(page_id) AS pos, '' AS reject_reason FROM r WHERE reject_reason = '' GROUP BY safe
UNION ALL SELECT u0 AS url, page_id AS pos, reject_reason FROM r WHERE reject_reason <> ''
"""

ORACLE["j5_diag_extracted"] = f"""
WITH {RECORDS}, {_CLASSIFIED}
SELECT d.page_id, d.final_url, CASE WHEN d.reason = 'ok' THEN coalesce(CAST(length({strip('recs.markdown')}) AS BIGINT), d.extracted_chars)
                                    ELSE d.extracted_chars END AS extracted_chars
FROM diag d LEFT JOIN recs ON recs.ord = d.page_id
"""

ORACLE["u9_canonical"] = """
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/c/' || (page_id % 40)::VARCHAR || '?b=1' AS canonical_url FROM pages WHERE page_id % 2 = 0
"""

# ---------------------------------------------------------------- F6 over a visit, F7

ORACLE["f6_visit_errors"] = f"""
WITH {_DECIDED}, {_CLASSIFIED},
v AS (SELECT page_id, norm_url, CASE WHEN blocked_url THEN 'blocked-host' WHEN disallowed THEN 'robots-disallowed' ELSE '' END AS e FROM dec)
SELECT page_id, norm_url AS url, e AS reason, '' AS status FROM v WHERE e <> ''
UNION ALL
SELECT page_id, url, reason, CASE WHEN reason = 'timeout' THEN '' ELSE status END FROM diag JOIN v USING (page_id) WHERE e = '' AND reason <> 'ok'
"""

_RUNS = f"""
{_CLASSIFIED},
runs AS (SELECT (page_id + 1) % 5 AS run, count(*) FILTER (reason = 'ok') AS pages_count, count(*) FILTER (reason <> 'ok') AS errors_count,
                CAST(coalesce(sum(bytes) FILTER (reason = 'ok'), 0) AS BIGINT) AS total_chars, max(elapsed_ms) AS max_elapsed_ms
         FROM diag GROUP BY 1)
"""

ORACLE["f7_run_snapshots"] = f"WITH {_RUNS} SELECT * FROM runs"

ORACLE["f7_last_run_errors"] = f"""
WITH {_RUNS}
SELECT (d.page_id + 1) % 5 AS run, d.page_id, d.url, d.reason, CASE WHEN d.reason = 'timeout' THEN '' ELSE d.status END AS status,
       r.pages_count, r.errors_count, r.total_chars
FROM diag d JOIN runs r ON r.run = (d.page_id + 1) % 5 WHERE d.reason <> 'ok' AND r.run = (SELECT max(run) FROM runs)
"""
