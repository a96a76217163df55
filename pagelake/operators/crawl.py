"""Crawls and redirects replayed over stored snapshots, a wave per step."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.functions import urls
from pagelake.operators.content import HTML_TYPES, join_link, page_links, sitemap_locs
from pagelake.operators.policy import robots_filter
from pagelake.operators.shared import join_counted, numbered, shared_path, written


def frontier_admit(found: DataFrame, seen: DataFrame, max_depth: int, *, normal: bool = False) -> DataFrame:
    """Label links ``root, url, depth, same_site``: seen, domain_blocked, depth_blocked or admitted.

    URLs are normalised first, those of ``seen`` too, and links that are no accepted URL
    leave; with ``normal``, or where URLs are numbers, they are taken as they are. A seen
    URL is dropped before the site and the depth are looked at. Blocked ones are not
    marked seen.
    """
    if not normal and dict(found.dtypes)["url"] == "string":
        found, seen = (x.withColumn("url", urls.normalize(F.col("url"))).where("url IS NOT NULL") for x in (found, seen))
    known = seen.select(F.col("root").alias("_r"), F.col("url").alias("_u")).distinct()
    joined = found.join(known, (F.col("root") == F.col("_r")) & (F.col("url") == F.col("_u")), "left")
    label = F.when(F.col("_u").isNotNull(), "seen").when(F.col("depth") > max_depth, "depth_blocked").when(~F.col("same_site"), "domain_blocked").otherwise("admitted")
    return joined.withColumn("label", label).drop("_r", "_u")


class Crawl(NamedTuple):
    """What a crawl gives.

    ``targets``: ``root, ord, url, depth, parent, relation, fetched, robots_allowed`` in the
    order of a queue; ``rest``: ``root, url`` of the queue left; ``counters``: per root the
    links taken by relation, their variants, those blocked by site and by depth, and the
    targets that robots rules kept out.
    """

    targets: DataFrame
    rest: DataFrame
    counters: DataFrame


#: Links of one source that are one row of the adjacency table.
LINKS = 1000
#: Media types of sitemaps.
XML_TYPES = ("application/xml", "text/xml")


def links_of(bodies: DataFrame, *, url: str = "url", media_type: str = "media_type", body: str = "body") -> DataFrame:
    """``src, pos, dst, relation, n_variants``: links of stored HTML and locations of stored XML, in order.

    Both ends are normalised; what is no accepted URL leaves, a page's other links stay. A
    body that is neither HTML nor XML by its type or the end of its URL has no links.
    """
    rows = bodies.select(urls.normalize(F.col(url)).alias("src"), F.coalesce(media_type, F.lit("")).alias("_m"), F.col(body).alias("_body"))
    is_html, is_xml = F.col("_m").isin(*HTML_TYPES), F.col("_m").isin(*XML_TYPES) | F.endswith("src", F.lit(".xml"))
    pages = rows.where(is_html).select("src", F.posexplode(page_links("src", "_body")).alias("pos", "l")).select("src", "pos", urls.normalize(F.col("l.url")).alias("dst"), "l.relation")
    pages = written(pages, "page-links").where("src IS NOT NULL AND dst IS NOT NULL").withColumn("n_variants", F.size(urls.variant_list(F.col("dst"))) - 1)
    maps = sitemap_locs(rows.where(~is_html & is_xml), "src", "_body", "src").select("src", "pos", F.col("loc").alias("dst"), F.lit("sitemap").alias("relation"), F.lit(0).alias("n_variants"))
    return written(pages.unionByName(maps.where("src IS NOT NULL")), "links")


def _adjacency(links: DataFrame, name: str) -> DataFrame:
    """Links by source in rows of up to ``LINKS`` places, in buckets by ``key``, so that no wave shuffles them again."""
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws(" ", F.floor(F.col("pos") / LINKS), "src")
    out = F.struct("pos", "dst", "relation", "n_variants", *[c for c in ("same_site", "site") if c in links.columns])
    rows = links.select(key.alias("key"), out.alias("l")).repartition(n, "key").groupBy("key").agg(F.collect_list("l").alias("links"))
    rows.write.bucketBy(n, "key").sortBy("key").option("path", shared_path(links.sparkSession, "links")).saveAsTable(name)
    return links.sparkSession.table(name)


def crawl(
    roots: DataFrame, links: DataFrame, stored: DataFrame, *, pages: int, depth: int, seeds: DataFrame | None = None, attempts: int | None = None, used: int = 0, robots: DataFrame | None = None, agent: str = "*"
) -> Crawl:
    """Breadth-first crawl of many roots over stored pages.

    ``links``: ``src, pos, dst`` and, if known, ``relation``, ``n_variants`` and ``same_site``
    (``links_of`` makes them from pages); ``stored``: ``url`` of pages that a fetch would
    give; ``seeds``: ``root, url, depth, pos, relation`` and maybe ``same_site``, which
    queue up with the links of a fetched root by ``pos`` (a sitemap has depth 0, the
    relation ``sitemap_file`` and comes first, found pages have depth 1 and come last);
    ``robots``: ``origin, status, body``. URLs are in normal form, or numbers. Without
    ``same_site`` two URLs are of one site if their hosts agree but for a ``www.``.

    A wave is what the wave before has put into the queue; its order is (parent's
    place, position of the link) and the first finder wins, which is the order of a
    queue. Failed fetches, those that robots rules forbid too, count against the limit on
    pages, which is ``pages`` or what the attempts leave, if that is less. Every wave is
    written once; places are numbered by range partitions, so no root is one task. A
    page with very many links is joined in blocks of ``LINKS``, and a page that very many
    roots fetch at once is broadcast; the links lie in buckets and are not shuffled by waves.
    """
    spark, most = roots.sparkSession, pages if attempts is None else min(pages, 1 + max(0, attempts - used))
    key = dict(roots.dtypes)["root"]
    by_host = "same_site" not in links.columns
    site = lambda c: urls.site_host(F.col(c).cast("string"))
    if by_host:
        links = links.withColumn("site", site("dst"))
    links = links.select("src", "pos", "dst", "site" if by_host else "same_site", *[(F.col(n) if n in links.columns else F.lit(v)).alias(n) for n, v in (("relation", "internal"), ("n_variants", 0))])
    name = f"pagelake_links_{uuid.uuid4().hex}"
    table = _adjacency(links, name)
    blocks = links.groupBy(F.col("src").alias("url")).agg(F.floor(F.max("pos") / LINKS).cast("int").alias("_last"))
    known = written(stored.select("url").distinct().withColumn("_ok", F.lit(True)).join(blocks, "url", "left"), "stored")
    if seeds is not None and "same_site" not in seeds.columns:
        seeds = seeds.withColumn("same_site", site("url") == site("root"))
    wave = roots.select("root", F.col("root").alias("url"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("depth"), F.lit(None).cast(key).alias("parent"), F.lit("root").alias("relation"))
    seen = wave.select("root", "url")
    targets, rests, counts = [], [], []
    while True:
        taken = wave.where(F.col("ord") < most).join(known, "url", "left")
        taken = taken.withColumn("robots_allowed", F.lit(True)) if robots is None else robots_filter(taken, robots, agent=agent, normal=True)
        taken = written(taken.withColumn("fetched", F.col("_ok").isNotNull() & F.col("robots_allowed")), "crawled")
        targets.append(taken.select("root", "ord", "url", "depth", "parent", F.when(F.col("relation") == "sitemap_file", "sitemap").otherwise(F.col("relation")).alias("relation"), "fetched", "robots_allowed"))
        fetched = taken.where("fetched").select("root", "ord", "url", "depth", "_last")
        asked = fetched.where("_last IS NOT NULL").select("root", "ord", "url", "depth", F.explode(F.sequence(F.lit(0), "_last")).alias("_block")).withColumn("key", F.concat_ws(" ", "_block", "url")).drop("_block")
        places = asked.groupBy("key").agg(F.count("*").alias("_n"))
        rows = written(places.join(table, "key"), "links")
        found = join_counted(asked, rows, "key", "_n", rows.agg(F.sum("_n")).first()[0] or 0, hot=200).select("root", "ord", "url", "depth", F.explode("links").alias("l"))
        same = F.col("l.site") == site("root") if by_host else F.col("l.same_site")
        found = found.select("root", F.col("l.dst").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("parent"), F.struct("ord", F.col("l.pos").cast("int").alias("pos")).alias("at"), same.alias("same_site"), "l.relation", "l.n_variants")
        if len(targets) == 1 and seeds is not None:
            more = seeds.join(fetched.select("root"), "root").select("root", "url", "depth", F.col("root").alias("parent"), F.struct(F.lit(0).cast("long").alias("ord"), F.col("pos").cast("int").alias("pos")).alias("at"), "same_site", "relation", F.lit(0).alias("n_variants"))
            found = found.unionByName(more)
        labelled = frontier_admit(found, seen, depth, normal=True).where("label <> 'seen'")
        first = F.min(F.when(F.col("label") == "admitted", F.col("at"))).over(Window.partitionBy("root", "url"))
        labelled = written(labelled.withColumn("first", first).where("first IS NULL OR at <= first"), "found")  # later ones have been seen
        counts.append(labelled)
        top = wave.groupBy("root").agg(F.max("ord").alias("top"))
        new = numbered(labelled.where("label = 'admitted'").dropDuplicates(["root", "url"]), ["root"], [F.col("at")], "k").join(top, "root")
        wave = new.select("root", "url", (F.col("top") + F.col("k") + 1).alias("ord"), "depth", "parent", "relation")
        wave = written(wave, "wave")
        rests.append(wave.where(F.col("ord") >= most).select("root", "url"))
        seen = seen.unionByName(wave.select("root", "url"))
        if wave.where(F.col("ord") < most).isEmpty():
            spark.sql(f"DROP TABLE {name}")
            return Crawl(_union(targets), _union(rests), _counted(_union(counts), _union(targets), roots))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


#: Relations of links, with the capability that each is evidence of.
RELATIONS = {
    "sitemap": "sitemap_discovery", "internal": "internal_link_discovery", "related": "related_link_discovery", "pagination": "pagination_discovery", "next": "next_page_discovery",
    "category": "category_tag_discovery", "variants": "candidate_url_expansion", "search": "search_provider_discovery",
}


def _counted(found: DataFrame, targets: DataFrame, roots: DataFrame) -> DataFrame:
    ok = F.col("label") == "admitted"
    names = [n for n in RELATIONS if n != "variants"]
    sums = found.groupBy("root").agg(
        *[F.count_if(ok & (F.col("relation") == n)).alias(n) for n in names], F.sum(F.when(ok, F.col("n_variants")).otherwise(0)).cast("long").alias("variants"),
        F.count_if(F.col("label") == "domain_blocked").alias("domain_blocked"), F.count_if(F.col("label") == "depth_blocked").alias("depth_blocked"),
    )
    kept_out = targets.groupBy("root").agg(F.count_if(~F.col("robots_allowed")).alias("robots_blocked"))
    return roots.select("root").distinct().join(sums, "root", "left").join(kept_out, "root", "left").fillna(0)


def crawl_report(done: Crawl) -> DataFrame:
    """Per root: targets, fetched, failed, deepest, and omitted, the size of the queue left."""
    found = done.targets.groupBy("root").agg(F.count("*").alias("targets"), F.count_if("fetched").alias("fetched"), F.count_if(~F.col("fetched")).alias("failed"), F.max("depth").alias("max_depth"))
    left = done.rest.groupBy("root").agg(F.count("*").alias("omitted"))
    return found.join(left, "root", "left").withColumn("omitted", F.coalesce("omitted", F.lit(0)).cast("long"))


def crawl_outcomes(done: Crawl) -> DataFrame:
    """Twelve outcome rows per root: ``root, capability_id, status, n``.

    Kinds of links are observed or not applicable, with their number; the limits on
    depth and site were applied, with the links they kept out, and so were robots rules, with
    the targets; the root's own site was observed.
    """
    seen = lambda c: F.when(c > 0, "OBSERVED").otherwise("NOT_APPLICABLE")
    rows = [(name, seen(F.col(n)), F.col(n)) for n, name in RELATIONS.items()]
    rows += [("depth_limited_crawl", F.lit("APPLIED"), F.col("depth_blocked")), ("domain_limited_crawl", F.lit("APPLIED"), F.col("domain_blocked"))]
    rows += [("robots_discovery", F.lit("APPLIED"), F.col("robots_blocked")), ("official_domain_discovery", F.lit("OBSERVED"), F.lit(1))]
    all_ = F.array(*[F.struct(F.lit(name).alias("capability_id"), s.alias("status"), n.cast("long").alias("n")) for name, s, n in rows])
    return done.counters.select("root", F.explode(all_).alias("o")).select("root", "o.*")


def redirect_chains(starts: DataFrame, redirects: DataFrame, hops: int = 8) -> DataFrame:
    """Follow ``src, status, location``: ``start, method, final, hops, verdict``.

    Verdicts: ok, loop, downgrade, missing_location, replay_blocked (a body would
    be sent again) and budget_exhausted. A relative location is joined to the URL that
    sent it. A source with several redirects follows the smallest (status, location). Each hop is one join of the chains that are still
    open, written at its end; places that many chains have reached are broadcast.
    """
    step = redirects.groupBy(F.col("src").alias("_s")).agg(F.min(F.struct(F.col("status").alias("_c"), F.col("location").alias("_l"))).alias("x")).select("_s", "x.*")
    rows = starts.select(F.col("url").alias("start"), F.col("method"), F.col("url").alias("at"), F.array("url").alias("path"))
    done = []
    for _ in range(hops + 1):
        places = rows.groupBy("at").agg(F.count("*").alias("_n"))
        joined = join_counted(rows, places.join(step, F.col("at") == F.col("_s"), "left"), "at", "_n", rows.count())
        relative = ~F.col("_l").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
        joined = joined.withColumn("_l", F.when(relative, join_link(F.when(relative, F.col("at")), F.when(relative, F.col("_l")))).otherwise(F.col("_l")))
        to_get = (F.col("_c") == 303) | (F.col("_c").isin(301, 302) & (F.col("method") == "POST"))
        verdict = (
            F.when(F.col("_s").isNull(), "ok").when(F.col("_l").isNull(), "missing_location")
            .when(F.array_contains("path", F.col("_l")), "loop").when(F.startswith("at", F.lit("https:")) & F.startswith("_l", F.lit("http:")), "downgrade")
            .when(~to_get & F.col("method").isin("POST", "PUT", "PATCH"), "replay_blocked").when(F.size("path") > hops, "budget_exhausted")
        )
        rows = written(joined.withColumn("verdict", verdict).withColumn("method", F.when(F.col("verdict").isNull() & to_get, "GET").otherwise(F.col("method"))).drop("_n", "_s", "_c"), "hop")
        done.append(rows.where("verdict IS NOT NULL").select("start", "method", F.col("at").alias("final"), (F.size("path") - 1).alias("hops"), "verdict"))
        rows = rows.where("verdict IS NULL").select("start", "method", F.col("_l").alias("at"), F.concat("path", F.array("_l")).alias("path"))
        if rows.isEmpty():
            break
    return _union(done)


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Smallest depth of every node within ``depth`` steps (``src, dst``) of each start: ``start, node, depth``.

    A wave per step holds the nodes that no earlier one has, each once; waves are written.
    """
    wave = written(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    found, steps = wave, edges.select("src", "dst").distinct()
    for k in range(1, depth + 1):
        new = wave.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        wave = written(new.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)), "reached")
        found = found.unionByName(wave)
    return found
