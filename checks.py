"""Shared inputs of the registered queries and their SQL counterparts.

The given pages have no status, description, date, robots file or links to one another. `AUGMENTED` adds them with
one expression that both engines read alike.
"""

from __future__ import annotations

N = "cast(page_id as string)"
DAY = "lpad(cast(1 + page_id % 28 as string), 2, '0')"

HEAD_TAGS = f"""concat('<meta charset="utf-8"><meta name="description" content="  about ', {N}, '  ">',
  '<link rel="canonical" href="/c/', {N}, '?v=1#f">',
  case page_id % 5
    when 0 then concat('<meta property="article:published_time" content="2024-03-', {DAY}, 'T10:00:00+09:00">')
    when 1 then concat('<meta property="article:published_time" content=""><meta name="pubdate" content="2024-03-', {DAY}, '">')
    when 2 then concat('<meta name="sailthru.date" content="2024-03-', {DAY}, 'T10:00:00">')
    else '' end)"""

ARTICLE_TAGS = f"""concat(
  case when page_id % 5 = 4 then concat('<time datetime="2024-03-', {DAY}, 'T10:00:00.25Z">t</time>') else '' end,
  '<h2> Sub ', {N}, ' </h2><h3></h3><a href="#x">a</a><a href="JavaScript:v(0)">b</a><a href="mailto:a@b.c">c</a>',
  '<a href="../up/', {N}, '?q=1#z">d</a></article>')"""

STATUS = "case when url like '%.html' then 404 when url like '%utm_source=feed' then 503 else 200 end"

AUGMENTED = f"""select page_id, url, {STATUS} as status,
  replace(replace(html, '<meta charset="utf-8">', {HEAD_TAGS}), '</article>', {ARTICLE_TAGS}) as html
  from pages"""

# pages captured under a second URL with the same content: before the first in order for even ids, behind it else
RECAPTURED = "select page_id, concat(case page_id % 2 when 0 then 'a' else 'z' end, url) as url, html from pages"
# pages captured again under their URL with other content
CHANGED = "select page_id, url, replace(html, '</article>', ' again</article>') as html from pages"

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

# one robots file per host, its kind by the length of the host name; kind 0 has no rule
ROBOTS = f"""select host, case length(host) % 4
    when 0 then concat('User-agent: *', chr(10), 'Disallow:')
    when 1 then concat('User-agent: *', chr(10), 'Disallow: /fr/')
    when 2 then concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'Allow: /en/')
    else concat('User-agent: otherbot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /*.html$')
  end as body from (select distinct {HOST} as host from pages) h"""

# link graph over the page ids: N // 4 -> N, N -> N // 2 and back links to page 0
GRAPH = """select page_id, cast(floor(page_id / 4) as bigint) as parent, cast(floor(page_id / 2) as bigint) as half, url from pages"""

EXCLUDED = ["example.org", "farm.example.net"]
AD_PATTERNS = [r"/(?P<word>[Tt]he)", "q=1", "%C3%BC", "/[[:upper:]][[:lower:]]$"]
# the same for a regular expression engine without the named group
AD_PATTERNS_SQL = [r"/([Tt]he)", "q=1", "%C3%BC", "/[[:upper:]][[:lower:]]$"]
OTHER_PATTERNS = [rf"/banner{n}/(\d+|x)[a-z]*\.gif$" for n in range(5_000)] + ["(?i)/SPONSORED-[0-9]", "[.](exe|msi)$"]
LIMITS = {"url": 60, "html_source": 20_000, "main_content": 8_000, "title": 70, "language": 0}
EMBED_DIM = 64
VECTOR_DIM = 8
OPEN_ELEMENTS = 600
KNN_K = 5
LISTS = 16
MAX_DEPTH = 3
STATUSES = [200, 404, 503]
CAP = 40
DELAY_MS = 1000
DELAY_S = 30

# the augmented pages with links to pages N // 4 and N // 2 of their own host (the page before them there, by id)
CRAWL_PAGES = f"""select a.page_id, a.url, a.status, replace(a.html, '</article>', concat(
    case when p.url is null then '' else concat('<a href="', p.url, '">up</a>') end,
    case when h.url is null then '' else concat('<a href="', h.url, '">next</a>') end, '</article>')) as html
  from aug a
  left join pages p on p.page_id = cast(floor(a.page_id / 4) as bigint)
  left join same_host h on h.page_id = a.page_id"""
# for every page the next page of its host
SAME_HOST = f"""select page_id, lead(url) over (partition by {HOST} order by page_id) as url from pages"""
CRAWL_SEEDS = f"select url from (select url, row_number() over (partition by {HOST} order by page_id) as rn from pages) s where rn = 1"
