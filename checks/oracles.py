"""DuckDB SQL for each registered query, over the driver's views."""

from __future__ import annotations

from checks.derived import CORPUS, RENDERER, SERVER

ORIGIN = "regexp_extract(url, '^(https?://[^/]+/)', 1)"


def text(x: str) -> str:
    for entity, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{entity};', '{char}')"
    return f"replace({x}, '&amp', '&')"


def host(x: str) -> str:
    return f"regexp_extract({x}, '^https?://([^/]+)', 1)"


def canon(x: str) -> str:
    u = f"split_part({x}, '#', 1)"
    query = f"array_to_string(list_sort(string_split(split_part({u}, '?', 2), '&')), '&')"
    return f"(split_part({u}, '?', 1) || CASE WHEN contains({u}, '?') THEN '?' || {query} ELSE '' END)"


A = """'<a href="([^"]*)">([^<]*)</a>'"""

# Every link with its place in the page; the test links have no dots or escapes.
LINKS = f"""
links AS (
  SELECT page_id, page_url, pos - 1 AS pos, {ORIGIN.replace("url", "page_url")} || substr(hrefs[pos], 2) AS url, texts[pos] AS text
  FROM (SELECT page_id, url AS page_url, regexp_extract_all(html, {A}, 1) AS hrefs, regexp_extract_all(html, {A}, 2) AS texts,
               unnest(range(1, 1 + len(regexp_extract_all(html, {A})))) AS pos FROM pages))"""

DOCS = f"""
docs AS (
  SELECT link, first_id,
    CASE WHEN first_id % 13 = 5 THEN NULL WHEN first_id % 11 = 3 THEN '' ELSE link END AS key,
    CASE WHEN first_id % 3 = 0 THEN '' ELSE 'dep-' || {host("link")} END AS depart
  FROM (SELECT {ORIGIN} AS link, min(page_id) AS first_id FROM pages GROUP BY 1)),
sites AS (SELECT * FROM docs WHERE key <> '')"""

BOUND = f"""{DOCS},
bound AS (
  SELECT s.link AS site_key, p.page_id, p.url, s.first_id, s.depart,
    regexp_extract_all(p.html, {A}, 2) AS nav, regexp_extract_all(p.html, {A}, 1) AS hrefs,
    {text("regexp_extract(p.html, '<h1>([^<]*)</h1>', 1)")} AS title,
    {text("regexp_extract(p.html, '<footer>([^<]*)', 1)")} AS footer
  FROM pages p JOIN sites s ON {ORIGIN.replace("url", "p.url")} = s.link),
content AS (SELECT * FROM bound WHERE len(nav) >= 5 AND first_id % 5 <> 0),
items AS (
  SELECT *, nav[1] AS section, nav[6] AS date,
    concat_ws(',', CASE WHEN depart = '' THEN 'depart' END, CASE WHEN coalesce(nav[1], '') = '' THEN 'section' END,
      CASE WHEN title = '' THEN 'title' END, CASE WHEN coalesce(nav[6], '') = '' THEN 'date' END) AS reason
  FROM content),
envelopes AS (
  SELECT site_key, page_id, depart AS mkey, section AS "subKey", title, url AS link, date, footer,
    '{{"mkey":' || to_json(depart) || ',"subKey":' || to_json(section) || ',"data":{{"title":' || to_json(title) || ',"link":'
      || to_json(url) || ',"date":' || to_json(date) || ',"footer":' || to_json(footer) || '}}}}' AS body
  FROM items WHERE reason = '')"""

N = "(SELECT count(*) FROM pages)"
# Depth bound of the recursive searches; it grows with the corpus and is well
# above the depth of its last page.
DEEP = f"(SELECT CAST(4 * log2(count(*)) + 12 AS INT) FROM pages)"
NEXT = "CASE WHEN {i} % 3 = 0 AND {i} % 30 < 27 THEN {i} + 3 WHEN {i} % 60 = 27 THEN {i} - 27 END"
STATUS = f"""
CASE WHEN i >= {N} THEN 'missing' {{error}} ELSE 'ok' END AS status, i < {N} AND i % 5 = 0 AS is_content"""


def url_of(i: str) -> str:
    return f"'{CORPUS}' || {i}"


def search(seed: int, children: str, expand: str) -> str:
    return f"""
    WITH RECURSIVE r(i, d) AS (
      SELECT CAST({seed} AS BIGINT), 0
      UNION
      SELECT t.j, r.d + 1 FROM r JOIN LATERAL (SELECT unnest([{children}]) AS j) t ON TRUE
      WHERE r.i < {N} AND {expand} AND t.j IS NOT NULL AND r.d < {DEEP}),
    reached AS (SELECT i, min(d) AS depth FROM r GROUP BY i)"""


FULL = search(0, f"2*r.i+1, 2*r.i+2, r.i//3, {NEXT.format(i='r.i')}", "r.i % 17 <> 16")
ERROR = "WHEN i % 17 = 16 THEN 'error'"

CHAIN = f"""
WITH RECURSIVE c(start, step, i) AS (
  SELECT page_id, 0, page_id FROM pages WHERE page_id % 15 = 0
  UNION ALL
  SELECT c.start, c.step + 1, t.j FROM c JOIN LATERAL (SELECT {NEXT.format(i='c.i')} AS j) t ON TRUE
  WHERE t.j < {N} AND c.step < 9),
chain AS (SELECT start, min(step) AS step, i FROM c GROUP BY start, i)"""

UNIQUE = f"{LINKS}, unique_links AS (SELECT page_id, page_url, min(pos) AS pos, url FROM links GROUP BY ALL)"
SITE_URLS = f"""{LINKS}, {DOCS.strip()},
site_urls AS (SELECT s.link AS site_key, l.page_id, l.url FROM
  (SELECT page_id, page_url, url, text FROM links GROUP BY ALL) l JOIN sites s ON {ORIGIN.replace("url", "l.page_url")} = s.link)"""


def by_domain_list(allow: bool) -> str:
    h = host("p.url")
    return f"""WITH domains AS (SELECT DISTINCT regexp_replace({host("url")}, '^[^.]+[.]([^.]+[.][^.]+[.][^.]+)$', '\\1') AS domain
        FROM pages WHERE page_id % 7 = 0)
      SELECT page_id, url FROM pages p WHERE {'' if allow else 'NOT'} EXISTS (
        SELECT 1 FROM domains d WHERE {h} = d.domain OR ends_with({h}, '.' || d.domain))"""


def scoped(deny: bool) -> str:
    hit = "(starts_with(url, site_key || 'en/') OR starts_with(url, site_key || 'de/'))"
    return f"WITH {BOUND} SELECT site_key, page_id, url FROM bound WHERE {'NOT ' if deny else ''}{hit}"


# All sites in one run: (site, URL as reached, depth). Links lead to higher ids, so it ends.
SITES_RUN = f"""
WITH RECURSIVE {LINKS}, {DOCS.strip()},
run AS (SELECT link AS site, first_id, CASE WHEN first_id % 2 = 0 THEN 'full' ELSE 'leaf' END AS mode FROM sites WHERE first_id % 5 <> 4),
stored AS (SELECT page_id, {canon("url")} AS key, len(regexp_extract_all(html, {A})) >= 5 AS listed FROM pages),
targets AS (
  SELECT s.key AS src, l.url AS dst FROM links l JOIN stored s USING (page_id)
  UNION SELECT a.key, b.key FROM stored a JOIN stored b ON b.page_id = a.page_id + 1 OR b.page_id = 2 * a.page_id + 1),
r(site, mode, first_id, url, d) AS (
  SELECT site, mode, first_id, p.url, 0 FROM run JOIN pages p ON p.page_id = run.first_id
  UNION
  SELECT r.site, r.mode, r.first_id, t.dst, r.d + 1 FROM r JOIN stored s ON s.key = {canon("r.url")} JOIN targets t ON t.src = s.key
  WHERE CASE WHEN r.mode = 'full' THEN starts_with(t.dst, r.site) ELSE r.d < 3 AND NOT (s.listed AND r.first_id % 5 <> 0) END),
reached AS (SELECT site, first_id, url, min(d) AS depth FROM r GROUP BY ALL)
SELECT site AS site_key, url, depth, CASE WHEN s.key IS NULL THEN 'missing' ELSE 'ok' END AS status,
  coalesce(s.listed AND first_id % 5 <> 0, false) AS is_content
FROM reached LEFT JOIN stored s ON s.key = {canon("url")}"""

# Chains of ten; in every other block of thirty ids they close a cycle, cut before its smallest URL.
RANKS = f"""
WITH c AS (SELECT page_id, page_id // 30 AS block, (page_id % 30) // 3 AS k, {url_of("page_id")} AS url FROM pages WHERE page_id % 3 = 0),
b AS (SELECT *, count(*) OVER w AS n, min(url) OVER w AS low, arg_min(k, url) OVER w AS first_k FROM c WINDOW w AS (PARTITION BY block)),
m AS (SELECT *, n = 10 AND block % 2 = 0 AS closed FROM b WHERE n > 1)
SELECT 'c' AS site_key, CASE WHEN closed THEN low ELSE {url_of("(30 * block)")} END AS head,
  CASE WHEN closed THEN (k - first_k + 10) % 10 ELSE k END AS rank, url FROM m"""


def registry() -> dict[str, str]:
    return {
        "site_catalog": f"WITH {DOCS} SELECT key, link FROM docs WHERE key IS DISTINCT FROM ''",
        "site_quarantine": f"""WITH {DOCS} SELECT CAST(NULL AS VARCHAR) AS site_key, link AS url, 'catalog' AS stage,
            'key is missing' AS reason FROM docs WHERE key IS NULL""",
        "site_lookup": f"""WITH {DOCS}, one AS (SELECT link FROM sites WHERE first_id = 0)
            SELECT link AS site_key, unnest(['title', 'section', 'date', 'footer', 'next0', 'next1']) AS name,
              unnest(['//h1/text()', '//nav/ul/li[1]/a/text()', '//nav/ul/li[6]/a/text()', '//footer/text()',
                '//a[@class=''next'']', '//nav/ul/li[6]/a']) AS xpath FROM one""",
        "seed_urls": f"""WITH {DOCS} SELECT link AS site_key, link AS url FROM sites
            UNION SELECT {ORIGIN}, url FROM pages WHERE contains(url, '?page=')""",
        "page_scope_deny": scoped(True),
        "page_scope_allow": scoped(False),
        "error_pages": f"""SELECT page_id, {ORIGIN} || CASE page_id % 11 WHEN 0 THEN 'a/../../../../b' WHEN 1 THEN 'a/../../../b'
            ELSE 'a' END AS url, page_id % 11 = 0 OR page_id % 7 IN (0, 2) AS bad FROM pages""",
        "robots_filter": f"""SELECT page_id, {ORIGIN} || CASE page_id % 5 WHEN 0 THEN 'robots.txt' WHEN 1 THEN 'robots.txt?x'
            ELSE 'r' END AS url, CASE WHEN page_id % 5 = 0 THEN 404 END AS http_status FROM pages""",
        "fetch_manifest": f"""SELECT {url_of("(2*page_id+1)")} AS url,
            '{RENDERER}?url=' || {url_of("(2*page_id+1)")} || '&timeout=10&wait=0.5' AS request_url
            FROM pages WHERE 2*page_id+1 >= {N}""",
        "fetch_result": """SELECT url, CASE WHEN page_id % 3 > 0 THEN CAST(200 + page_id % 3 AS INT) END AS http_status,
            CASE WHEN page_id % 3 > 0 THEN CAST(page_id % 3 AS VARCHAR) END AS header_n,
            CAST(1 AS INT) AS n_cookies, CAST(length(html) AS INT) AS n_chars FROM pages""",
        "fetch_status": f"""WITH t AS (SELECT 'http://' || {host("url")} || '/p' || page_id AS url, page_id,
              regexp_extract(html, '<title>([^<]*)</title>', 1) AS content FROM pages)
            SELECT url, CASE WHEN page_id % 4 > 1 THEN 200 ELSE 500 END AS status_code,
              CASE WHEN page_id % 4 > 1 THEN content ELSE 'FAIL to load the address:' || url END AS body FROM t""",
        "extract_links": f"WITH {LINKS} SELECT page_id, CAST(pos AS INT) AS pos, url, text FROM links",
        "link_attrs": f"""WITH t AS (SELECT page_id, {ORIGIN} AS o, CASE WHEN page_id % 2 = 0 THEN 'b' || page_id || '/' ELSE '' END AS b FROM pages)
            SELECT page_id, 0 AS pos, o || b || 'x?y=1&z=2' AS url, 'café & tea' AS text, true AS nofollow FROM t
            UNION ALL SELECT page_id, 1, o || 'zone', '', false FROM t
            UNION ALL SELECT page_id, 4, o || 'up', 'up', false FROM t""",
        "link_filters": f"""WITH {UNIQUE}, r AS (SELECT page_id, url, text FROM links GROUP BY ALL)
            SELECT page_id, url FROM r WHERE (regexp_matches(url, '/[a-m][0-9A-Za-z_]*$') OR regexp_matches(url, '/[n-s]'))
              AND NOT contains(url, '/de') AND regexp_matches(url, '^https?://([^/]+[.])?example[.](com|org)/')
              AND NOT regexp_matches(url, '^https?://([^/]+[.])?(spam-farm|theron)[.]example[.]org/')""",
        "url_filters": """SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^[^?#]*[.]html([?#]|$)')
            AND NOT regexp_matches(url, '^https?://([^/]+[.])?example[.]net/')""",
        "allow_domain_list": by_domain_list(True),
        "deny_domain_list": by_domain_list(False),
        "link_regions": f"""WITH {LINKS}, again AS (SELECT page_id, 0 AS pos, url, text FROM links WHERE pos = 1
              UNION ALL SELECT page_id, pos + CASE WHEN n >= 2 THEN 1 ELSE 0 END, url, text
              FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM links))
            SELECT page_id, CAST(min(pos) AS INT) AS pos, url, text FROM again GROUP BY page_id, url, text""",
        "canonical_urls": f"SELECT page_id, {canon('url')} AS url FROM pages",
        "unique_links": f"WITH {UNIQUE} SELECT page_id, CAST(pos AS INT) AS pos, url FROM unique_links",
        "content_pages": f"WITH {BOUND} SELECT site_key, page_id, url FROM content",
        "next_page": f"""WITH {BOUND} SELECT site_key, page_id, '//nav/ul/li[6]/a' AS xpath, site_key || substr(hrefs[6], 2) AS next_url
            FROM bound WHERE first_id % 7 IN (0, 1) AND len(hrefs) >= 6""",
        "item_fields": f"""WITH {BOUND}, v AS (
              SELECT site_key, page_id, unnest(['section', 'title', 'link', 'date', 'footer']) AS name,
                unnest([section, title, url, date, footer]) AS value FROM items)
            SELECT site_key, page_id, name, 0 AS pos, value FROM v WHERE coalesce(value, '') <> ''""",
        "item_envelopes": f"WITH {BOUND} SELECT * FROM envelopes",
        "item_quarantine": f"WITH {BOUND} SELECT site_key, page_id, url, 'item' AS stage, reason FROM items WHERE reason <> ''",
        "item_outbox": f"""WITH {BOUND} SELECT page_id, '{SERVER}/api/1.0' AS endpoint, 'application/json' AS content_type,
            CAST(length(body) AS INT) AS n_chars FROM envelopes""",
        "item_sink_roundtrip": f'WITH {BOUND} SELECT mkey, "subKey", title, link, date FROM envelopes',
        "crawl_log_roundtrip": f"""SELECT {ORIGIN} AS site_key, url FROM pages
            UNION ALL SELECT {ORIGIN}, url FROM pages WHERE contains(url, '#')""",
        "crawl_full": f"""{FULL} SELECT 'c' AS site_key, {url_of("i")} AS url, depth, {STATUS.format(error=ERROR)} FROM reached""",
        "crawl_items": f"""{FULL} SELECT 'c' AS site_key, page_id, {url_of("i")} AS url,
            {text("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS title
            FROM reached JOIN pages ON page_id = i WHERE i % 5 = 0 AND i % 17 <> 16""",
        "crawl_leaf_stop": f"""{search(1, "2*r.i+1, 2*r.i+2, r.i//3, CASE WHEN r.i % 3 = 0 THEN " + NEXT.format(i="r.i") + " END", "r.i % 5 <> 0")}
            SELECT 'c' AS site_key, {url_of("i")} AS url, depth, {STATUS.format(error="")} FROM reached""",
        "crawl_clicks": f"""{search(1, "2*r.i+1, 2*r.i+2", "r.i % 5 <> 0")}
            SELECT 'c' AS site_key, {url_of("i")} AS url, depth, {STATUS.format(error="")} FROM reached""",
        "pagination_chain": f"""{CHAIN} SELECT 'c' AS site_key, {url_of("start")} AS start, CAST(step AS INT) AS step, {url_of("i")} AS url FROM chain""",
        "listing_router": f"""{CHAIN}, l AS (SELECT DISTINCT t.j AS i FROM (SELECT DISTINCT i FROM chain) p
              JOIN LATERAL (SELECT unnest([2*p.i+1, 2*p.i+2, p.i//3, {NEXT.format(i="p.i")}]) AS j) t ON TRUE WHERE t.j IS NOT NULL)
            SELECT 'c' AS site_key, {url_of("i")} AS url, CASE WHEN i >= {N} THEN 'missing' WHEN i % 5 = 0 THEN 'emit' ELSE 'frontier' END AS route
            FROM l WHERE i >= {N} OR i % 17 <> 16""",
        "stream_links": f"""WITH {LINKS} SELECT page_id, CAST(min(pos) AS INT) AS pos, url, text, false AS nofollow
            FROM links GROUP BY page_id, url, text""",
        "stream_first_seen": f"WITH {SITE_URLS} SELECT DISTINCT site_key, url FROM site_urls",
        "stream_visits": f"WITH {SITE_URLS} SELECT site_key, url, count(*) AS visits, count(*) > 1 AS repeated FROM site_urls GROUP BY 1, 2",
        "stream_items": f"""WITH {BOUND} SELECT 'items' AS part, page_id, body AS detail FROM envelopes
            UNION ALL SELECT 'outbox', page_id, '{SERVER}/api/1.0' FROM envelopes
            UNION ALL SELECT 'quarantine', page_id, reason FROM items WHERE reason <> ''""",
        "bind_large_catalog": f"""WITH {BOUND} SELECT site_key, url, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n,
            len(nav) >= 5 AND first_id % 5 <> 0 AS is_content FROM bound""",
        "crawl_repeated_pages": f"""{FULL} SELECT 'c' AS site_key, {url_of("i")} AS url, depth, {STATUS.format(error=ERROR)} FROM reached""",
        "crawl_sites": SITES_RUN,
        "chain_ranks": RANKS,
        "next_page_base": f"""WITH {BOUND} SELECT site_key, page_id, 'https://base.example/' || substr(hrefs[6], 2) AS next_url
            FROM bound WHERE first_id % 7 IN (0, 1) AND len(hrefs) >= 6""",
        "decoded_bodies": "SELECT page_id, CASE WHEN page_id % 4 < 3 THEN md5(html) END AS digest FROM pages",
        "item_sink_rerun": f'WITH {BOUND} SELECT mkey, "subKey", title, link, date FROM envelopes',
        "stream_repeats": f"""WITH {SITE_URLS} SELECT site_key, url, count(*) AS visits, 1::BIGINT AS firsts, count(*) > 1 AS repeated
            FROM site_urls GROUP BY 1, 2""",
        "stream_items_once": f"""WITH {BOUND} SELECT site_key, page_id, body FROM envelopes
            WHERE page_id IN (SELECT min(page_id) FROM pages GROUP BY {canon("url")})""",
    }
