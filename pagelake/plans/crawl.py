"""Queries over the link graph, sitemaps, robots rules and redirects of the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import urls as u
from pagelake.operators import crawl
from pagelake.operators.shared import numbered, written
from pagelake.plans.registry import query, table
from pagelake.plans.urls import PARTS

#: Pages that one sitemap lists; an index lists the sitemaps of an origin.
SITEMAP = 1000
#: Robots rules of every https origin; others have none.
ROBOTS = "User-agent: *\nDisallow: /en/1\nDisallow: /de\n"
PAGES, DEPTH, ATTEMPTS = 20, 2, 25


def _pages(spark, d):
    """One page per normalised URL, the first: ``page_id, url, html, origin, site``."""
    p = table(spark, d, "pages")
    first = p.select("page_id", u.normalize(F.col("url")).alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"))
    rows = first.join(p.select("page_id", "html"), "page_id")
    origin = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)  # the URL is in normal form
    return written(rows.select("page_id", "url", "html", origin.alias("origin"), u.site_host(F.col("url")).alias("site")), "pages")


def _bodies(pages):
    """The pages, and for each origin sitemaps of 1,000 pages under an index."""
    rows = numbered(pages.select("origin", "page_id", "url"), ["origin"], [F.col("page_id")], "n").withColumn("map", F.floor(F.col("n") / SITEMAP))
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    joined = lambda key, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, x.alias("x")))), lambda r: r["x"]), "\n")
    maps = rows.groupBy("origin", "map").agg(joined("n", loc(F.col("url"))).alias("body"))
    at = F.concat("origin", F.lit("/sitemap-"), F.col("map").cast("string"), F.lit(".xml"))
    index = maps.groupBy("origin").agg(joined("map", loc(at)).alias("body")).select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit("application/xml").alias("media_type"), "body")
    maps = maps.select(at.alias("url"), F.lit("text/xml").alias("media_type"), "body")
    return pages.select("url", F.lit("text/html").alias("media_type"), F.col("html").alias("body")).unionByName(maps).unionByName(index)


#: One page per URL, links and sitemaps as rows of (src, pos, dst).
_GRAPH = f"""{PARTS},
one AS (SELECT norm AS url, min(page_id) AS page_id FROM u GROUP BY norm),
body AS (SELECT page_id, one.url, html, regexp_extract(one.url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(one.url, '^[a-z]+://(?:www\\.)?([^/?#:]*)', 1) AS site FROM one JOIN pages p USING (page_id)),
hrefs AS (SELECT url AS src, origin, unnest(x) AS href, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM body)),
plain AS (SELECT src, origin, pos, regexp_replace(regexp_replace(replace(replace(replace(replace(href, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '#.*$', ''), '\\?$', '') AS p FROM hrefs),
a_links AS (SELECT src, pos, origin || CASE WHEN p IN ('', '/.', '/..') THEN '/' ELSE p END AS dst FROM plain),
placed AS (SELECT origin, url, row_number() OVER (PARTITION BY origin ORDER BY page_id) - 1 AS n FROM body),
map_links AS (
  SELECT origin || '/sitemap-' || n // {SITEMAP} || '.xml' AS src, n % {SITEMAP} AS pos, url AS dst FROM placed
  UNION ALL SELECT DISTINCT origin || '/sitemap.xml', n // {SITEMAP}, origin || '/sitemap-' || n // {SITEMAP} || '.xml' FROM placed)"""
_SITE = "regexp_extract({0}, '^[a-z]+://(?:www\\.)?([^/?#:]*)', 1)"


@query("reachable", f"""WITH RECURSIVE {_GRAPH}, edges AS (SELECT src, dst FROM a_links UNION SELECT src, dst FROM map_links UNION SELECT url, origin || '/sitemap.xml' FROM body),
  starts AS (SELECT arg_min(url, page_id) AS url FROM body GROUP BY site),
  r(start, node, depth) AS (SELECT url, url, 0 FROM starts UNION SELECT start, dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM r GROUP BY start, node""")
def reachable(spark, d):
    """What lies within four steps of each site's first page, over links and sitemaps."""
    p = _pages(spark, d)
    edges = crawl.links_of(_bodies(p)).select("src", "dst").union(p.select("url", F.concat("origin", F.lit("/sitemap.xml"))))
    return crawl.reachable(edges, p.groupBy("site").agg(F.min_by("url", "page_id").alias("start")).select("start"), 4)


@query("frontier_admit", f"""WITH {_GRAPH}, found AS (SELECT *, 'https://seen.example/' || pos % 3 AS other FROM a_links)
  SELECT src AS root, CASE WHEN pos % 6 = 4 THEN other ELSE dst END AS url, CASE WHEN pos % 6 = 4 OR pos % 6 = 1 THEN 'seen' WHEN pos % 6 = 3 THEN 'depth_blocked' WHEN pos % 6 = 4 THEN 'domain_blocked' WHEN pos % 6 = 5 THEN 'domain_blocked' ELSE 'admitted' END AS label
  FROM found f WHERE pos % 6 <> 2 AND NOT (pos % 6 <> 1 AND EXISTS (SELECT 1 FROM found g WHERE g.src = f.src AND g.pos % 6 = 1 AND g.dst = f.dst))""")
def frontier_admit(spark, d):
    """Links of every page, written in other ways: hosts in capitals, default ports; some are no URLs or lead elsewhere."""
    rows = _pages(spark, d).select("url", F.posexplode(crawl.page_links("url", "html")).alias("pos", "l")).select("url", "pos", F.col("l.url").alias("dst"))
    k = F.col("pos") % 6
    other = F.concat(F.lit("HTTPS://Seen.Example:443/"), (F.col("pos") % 3).cast("string"))
    shout = F.concat(F.upper(F.regexp_extract("dst", "^([a-z]+://[^/]*)", 1)), F.regexp_extract("dst", "^[a-z]+://[^/]*(.*)$", 1), F.lit("#x"))
    url = F.when(k == 2, "mailto:me").when(k == 4, other).otherwise(shout)
    found = rows.select(F.col("url").alias("root"), url.alias("url"), F.when(k == 3, 9).otherwise(1).alias("depth"), (k != 5).alias("same_site"), "pos", "dst")
    seen = found.where("pos % 6 = 1").select("root", F.col("dst").alias("url")).union(rows.where("pos % 6 = 4").select("url", F.concat(F.lit("https://seen.example/"), (F.col("pos") % 3).cast("string"))))
    doubled = found.where("pos % 6 <> 1").join(seen.select(F.col("root").alias("_r"), F.col("url").alias("_d")).distinct(), (F.col("root") == F.col("_r")) & (crawl.urls.normalize(F.col("dst")) == F.col("_d")), "left_anti")
    return crawl.frontier_admit(doubled.union(found.where("pos % 6 = 1")).drop("pos", "dst"), seen, 2).select("root", "url", "label")


def _crawled(spark, d):
    """Crawls of 20 targets and 2 steps from the first page of every site.

    A crawl follows the page's links, the sitemap of its origin and two search results, the
    last pages of the site. Robots rules keep some of the https targets out.
    """
    p = _pages(spark, d)
    bodies = _bodies(p)
    roots = p.groupBy("site").agg(F.min_by("url", "page_id").alias("root"), F.min_by("origin", "page_id").alias("origin"), F.max(F.struct("page_id", "url")).alias("last"))
    before = p.join(roots.select("site", F.col("last.page_id").alias("_last")), "site").where("page_id < _last").groupBy("site").agg(F.max_by("url", "page_id").alias("other"))
    roots = roots.join(before, "site", "left")
    seed = lambda url, depth, pos, kind: roots.select("root", url.alias("url"), F.lit(depth).alias("depth"), F.lit(pos).alias("pos"), F.lit(kind).alias("relation")).where("url IS NOT NULL")
    seeds = seed(F.concat("origin", F.lit("/sitemap.xml")), 0, -1, "sitemap_file").union(seed(F.col("last.url"), 1, 10**9, "search")).union(seed(F.col("other"), 1, 10**9 + 1, "search"))
    robots = p.select("origin").distinct().select("origin", F.when(F.startswith("origin", F.lit("https:")), 200).otherwise(404).alias("status"), F.lit(ROBOTS).alias("body"))
    return crawl.crawl(roots.select("root"), crawl.links_of(bodies), bodies.select("url"), pages=PAGES, depth=DEPTH, seeds=seeds, attempts=ATTEMPTS, used=1, robots=robots)


def _crawl_sql() -> str:
    """The queue in SQL, a wave per step: seeds and links, of equal ones the first, in order."""
    out = f"""{_GRAPH},
links AS (
  SELECT src, pos, dst, 'internal' AS relation, 3 + starts_with(dst, 'http:')::INTEGER + (NOT regexp_matches(dst, '^[a-z]+://m\\.'))::INTEGER + (NOT regexp_matches(dst, '/amp/*$'))::INTEGER AS variants FROM a_links
  UNION ALL SELECT src, pos, dst, 'sitemap', 0 FROM map_links),
stored AS (SELECT url FROM body UNION SELECT src FROM map_links),
sites AS (SELECT arg_min(url, page_id) AS root, arg_min(origin, page_id) AS origin, list(url ORDER BY page_id DESC)[1:2] AS last FROM body GROUP BY site),
seeds AS (SELECT root, origin || '/sitemap.xml' AS url, 0 AS depth, -1 AS pos, 'sitemap_file' AS relation FROM sites UNION ALL SELECT root, unnest(last), 1, 1000000000 - 1 + generate_subscripts(last, 1), 'search' FROM sites),
w0 AS (SELECT root, root AS url, 0::BIGINT AS ord, 0 AS depth, NULL::VARCHAR AS parent, 'root' AS relation FROM sites)"""
    allowed = "NOT regexp_matches(url, '^https://[^/]*/(en/1|de)')"
    fetched = f"ord < {PAGES} AND {allowed} AND url IN (SELECT url FROM stored)"
    for i in range(1, 6):
        seen = " UNION ALL ".join(f"SELECT root, url FROM w{j}" for j in range(i))
        seeded = f" UNION ALL SELECT s.root, s.url, s.depth, s.root, 0, s.pos, s.relation, 0 FROM seeds s JOIN (SELECT * FROM w0 WHERE {fetched}) w ON s.root = w.root" if i == 1 else ""
        out += f""",
c{i} AS MATERIALIZED (SELECT *, CASE WHEN depth > {DEPTH} THEN 'depth_blocked' WHEN {_SITE.format('url')} <> {_SITE.format('root')} THEN 'domain_blocked' ELSE 'admitted' END AS label FROM (
  SELECT w.root, l.dst AS url, w.depth + 1 AS depth, w.url AS parent, w.ord AS o, l.pos AS p, l.relation, l.variants FROM (SELECT * FROM w{i - 1} WHERE {fetched}) w JOIN links l ON w.url = l.src{seeded}) x
  WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.root = x.root AND s.url = x.url)),
f{i} AS MATERIALIZED (SELECT * FROM (SELECT *, min(CASE WHEN label = 'admitted' THEN o::HUGEINT * 10000000000 + p END) OVER (PARTITION BY root, url) AS first FROM c{i}) WHERE first IS NULL OR o::HUGEINT * 10000000000 + p <= first),
w{i} AS MATERIALIZED (SELECT f.root, f.url, t.top + row_number() OVER (PARTITION BY f.root ORDER BY o, p) AS ord, f.depth, f.parent, f.relation FROM f{i} f JOIN (SELECT root, max(ord) AS top FROM w{i - 1} GROUP BY root) t USING (root) WHERE label = 'admitted')"""
    union = lambda x, first: " UNION ALL ".join(f"SELECT * FROM {x}{i}" for i in range(first, 6))
    return f"""WITH {out}, queue AS (SELECT * REPLACE (CASE WHEN relation = 'sitemap_file' THEN 'sitemap' ELSE relation END AS relation), {fetched} AS fetched, {allowed} AS robots_allowed FROM ({union('w', 0)})), found AS ({union('f', 1)}),
targets AS (SELECT * FROM queue WHERE ord < {PAGES}),
report AS (SELECT t.root, count(*) AS targets, count_if(fetched)::BIGINT AS fetched, count_if(NOT fetched)::BIGINT AS failed, max(depth) AS max_depth, (SELECT count(*) FROM queue q WHERE q.root = t.root AND q.ord >= {PAGES}) AS omitted FROM targets t GROUP BY t.root)"""


_REPORT = f"{_crawl_sql()} SELECT * FROM report"


@query("bounded_crawl", f"{_crawl_sql()} SELECT root, ord, url, depth, parent, relation, fetched, robots_allowed FROM targets")
def bounded_crawl(spark, d):
    return _crawled(spark, d).targets


@query("crawl_report", _REPORT)
def crawl_report(spark, d):
    return crawl.crawl_report(_crawled(spark, d))


_KINDS = [(name, f"coalesce(count_if(label = 'admitted' AND relation = '{n}'), 0)" if n != "variants" else "coalesce(sum(CASE WHEN label = 'admitted' THEN variants END), 0)") for n, name in crawl.RELATIONS.items()]


@query("crawl_outcomes", f"""{_crawl_sql()}, per AS (SELECT w0.root, f.* EXCLUDE (root) FROM w0 LEFT JOIN found f ON w0.root = f.root)
  {' UNION ALL '.join(f"SELECT root, '{name}' AS capability_id, CASE WHEN {c} > 0 THEN 'OBSERVED' ELSE 'NOT_APPLICABLE' END AS status, {c}::BIGINT AS n FROM per GROUP BY root" for name, c in _KINDS)}
  UNION ALL SELECT root, 'depth_limited_crawl', 'APPLIED', coalesce(count_if(label = 'depth_blocked'), 0)::BIGINT FROM per GROUP BY root UNION ALL SELECT root, 'domain_limited_crawl', 'APPLIED', coalesce(count_if(label = 'domain_blocked'), 0)::BIGINT FROM per GROUP BY root
  UNION ALL SELECT root, 'robots_discovery', 'APPLIED', count_if(NOT robots_allowed)::BIGINT FROM targets GROUP BY root UNION ALL SELECT root, 'official_domain_discovery', 'OBSERVED', 1 FROM w0""")
def crawl_outcomes(spark, d):
    return crawl.crawl_outcomes(_crawled(spark, d))


#: Every page but each seventh is moved: on its own site for each third, else to the next page; each eleventh to itself.
_MOVED = """moved AS (SELECT norm AS src, min(CASE WHEN page_id % 11 = 0 THEN regexp_extract(norm, '^[a-z]+://[^/?#]*(.*)$', 1) WHEN page_id % 3 = 0 THEN '/moved/' || page_id ELSE next END) AS location
  FROM (SELECT *, lead(norm) OVER (ORDER BY page_id) AS next FROM u) WHERE page_id % 7 <> 0 AND next IS NOT NULL GROUP BY norm),
steps AS (SELECT src, CASE WHEN starts_with(location, '/') THEN regexp_extract(src, '^[a-z]+://[^/?#]*') || location ELSE location END AS l FROM moved)"""


@query("redirect_chains", f"""WITH RECURSIVE {PARTS}, {_MOVED},
  r(start, cur, path) AS (SELECT DISTINCT norm, norm, [norm] FROM u UNION ALL SELECT start, l, list_append(path, l) FROM r JOIN steps ON src = cur WHERE NOT list_contains(path, l) AND NOT (starts_with(cur, 'https:') AND starts_with(l, 'http:')) AND len(path) <= 3),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC) AS k FROM r) WHERE k = 1)
  SELECT start, cur AS final, len(path)::INTEGER - 1 AS hops, CASE WHEN l IS NULL THEN 'ok' WHEN list_contains(path, l) THEN 'loop' WHEN starts_with(cur, 'https:') AND starts_with(l, 'http:') THEN 'downgrade' ELSE 'budget_exhausted' END AS verdict FROM last LEFT JOIN steps ON src = cur""")
def redirect_chains(spark, d):
    """Pages that are moved, by locations that are relative or lead to the next page; 3 hops."""
    p = table(spark, d, "pages").select("page_id", u.normalize(F.col("url")).alias("url"))
    after = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    own = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    location = F.when(F.col("page_id") % 11 == 0, own).when(F.col("page_id") % 3 == 0, F.concat(F.lit("/moved/"), F.col("page_id").cast("string"))).otherwise(F.col("next"))
    moved = p.join(after, "page_id").where("page_id % 7 <> 0").select(F.col("url").alias("src"), F.lit(302).alias("status"), location.alias("location"))
    starts = p.select("url", F.lit("GET").alias("method")).distinct()
    return crawl.redirect_chains(starts, moved, 3).select("start", "final", "hops", "verdict")
