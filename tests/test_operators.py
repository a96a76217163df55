"""Payloads, files, crawls and redirects against small cases and brute force."""

import io
import os
import random
import tarfile
import zipfile
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from pagelake.operators import content, crawl, ledger, payloads, policy, runs, shared
from pagelake.sources import files
from pagelake.streaming import events


@pytest.mark.parametrize(
    "capability,body,want",
    [
        ("json_endpoint", '{"a/b":1,"c":[1,2,3]}', ("json", "json", ["json:/a~1b", "json:/c"], 1)),
        ("rest", "[1,2,3,4]", ("api_response", "json", ["json:/0", "json:/1"], 2)),
        ("graphql", '{"x":1}', None),
        ("github_api", "[]", ("api_response", "json", ["json:/"], 0)),
        ("github_api", '{"no":1}', None),
        ("rss", '<rss version="2.0"><channel><item/><item/><item/></channel></rss>', ("feed", "rss", ["item:1", "item:2"], 1)),
        ("rss", "<rss><channel/></rss>", None),
        ("atom", "<feed/>", None),
        ("atom", f'<feed xmlns="{payloads.ATOM}"><entry/></feed>', ("feed", "atom", ["entry:1"], 0)),
        ("sitemap_xml", "<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>", ("sitemap", "sitemap_xml", ["sitemap:1"], 0)),
        ("xml_endpoint", '<!DOCTYPE r [<!ENTITY e "x">]><r>&e;</r>', None),
        ("openapi_discovery", "openapi: 3.0.0\npaths:\n  /a: {}\n", ("openapi", "openapi", ["path:/a"], 0)),
        ("openapi_discovery", "openapi: 3.0.0\npaths: &x {}\ny: *x\n", None),
        ("openapi_discovery", "openapi: 3.0.0\nopenapi: 3.0.1\npaths: {}\n", None),
        ("json_endpoint", "[" * 70 + "]" * 70, None),
        ("json_endpoint", None, None),
    ],
)
def test_payloads(spark, capability, body, want):
    rows = spark.createDataFrame([(capability, body, "")], "capability string, body string, media_type string")
    got = payloads.payload_normalize(rows, maximum_records=2).first()
    if want is None:
        assert got.error and got.representation is None
    else:
        assert (got.representation, got.format, got.locators, got.omitted_records) == want


def test_truncation_counts_every_level():
    assert payloads.truncate({"a": [1, 2, 3, 4], "b": ["a", "b", "c"]}, 2) == ({"a": [1, 2], "b": ["a", "b"]}, 3)


def box(names, kind="zip"):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in names:
                z.writestr(n, c)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for n, c in names:
                info = tarfile.TarInfo(n)
                info.size = len(c)
                t.addfile(info, io.BytesIO(c))
    return out.getvalue()


def test_archives(spark):
    cases = {
        "good": box([("folder/file.txt", b"hi"), ("b.txt", b"")]), "tar": box([("x/y.txt", b"abc")], "tar"), "escape": box([("../escape.txt", b"x")]), "bomb": box([("z.txt", b"0" * 1_000_000)]),
        "nested": box([("a.zip", b"PK")]), "junk": b"not an archive",
    }
    rows = files.archive_members(spark.createDataFrame(list(cases.items()), "path string, content binary")).collect()
    got = {(r.path, r.member, r.size, r.error) for r in rows}
    assert ("good", "folder/file.txt", 2, None) in got and ("tar", "x/y.txt", 3, None) in got
    errors = {p: e for p, m, _, e in got if m is None}
    assert set(errors) == {"escape", "bomb", "nested", "junk"} and "traversal" in errors["escape"] and "ratio" in errors["bomb"]


def test_csv_and_routes(spark):
    df = spark.createDataFrame([("a.csv", b"\xef\xbb\xbfa,b\n1,\"2\n3\"\nx\n")], "path string, content binary")
    assert [(r.locator, r.cells) for r in files.csv_rows(df).collect()] == [("row:1", ["a", "b"]), ("row:2", ["1", "2\n3"]), ("row:3", ["x"])]
    df = spark.createDataFrame([("https://x/a.txt", b"%PDF-1.7"), ("https://x/a.epub", b"PK\x03\x04"), ("https://x/a.csv", b"1"), ("https://x/a", b"")], "path string, content binary")
    assert [r[0] for r in df.select(files.format_route(F.col("path"), F.col("content"))).collect()] == ["pdf", "epub", "csv", "plain_text_file"]


def queue_crawl(root, edges, stored, pages, depth, seeds=()):
    """A plain queue: the crawl's definition. Targets, the queue left, and counts of links."""
    seen, queue, out, counts = {root}, deque([(root, 0, None, "root")]), [], Counter()

    def put(url, level, parent, relation, same):
        if url in seen:
            return
        if level > depth or not same:
            counts["depth_blocked" if level > depth else "domain_blocked"] += 1
            return
        counts[relation] += 1
        seen.add(url)
        queue.append((url, level, parent, relation))

    while queue and len(out) < pages:
        url, level, parent, relation = queue.popleft()
        ok = url in stored
        out.append((url, level, parent, "sitemap" if relation == "sitemap_file" else relation, ok))
        found = [(dst, level + 1, url, kind, same) for dst, same, kind in edges.get(url, [])] if ok else []
        if url == root and ok:
            found = [s for s in seeds if s[1] == 0] + found + [s for s in seeds if s[1] == 1]
        for x in found:
            put(*x)
    return out, len(queue), counts


@pytest.mark.parametrize("pages,depth,attempts", [(1, 3, None), (4, 3, None), (7, 4, 5), (9, 2, 30), (40, 3, 20)])
def test_crawl_equals_a_queue(spark, pages, depth, attempts):
    rng = random.Random(pages)
    kinds = ["internal", "next", "related"]
    edges = {i: [(rng.randrange(40), rng.random() < 0.8, rng.choice(kinds)) for _ in range(rng.randrange(6))] for i in range(-40, 40)}
    stored = {i for i in range(-40, 40) if i % 6 != 5}
    seeds = {i: [(-1 - i, 0, i, "sitemap_file", True), (rng.randrange(40), 1, i, "search", rng.random() < 0.8)] for i in range(40)}
    links = spark.createDataFrame([(i, k, *x) for i, xs in edges.items() for k, x in enumerate(xs)], "src long, pos int, dst long, same_site boolean, relation string")
    roots, pool = spark.createDataFrame([(i,) for i in range(40)], "root long"), spark.createDataFrame([(i,) for i in stored], "url long")
    rows = spark.createDataFrame([(i, u, lv, 1000 if lv else -1, kind, same) for i, xs in seeds.items() for u, lv, _, kind, same in xs], "root long, url long, depth int, pos int, relation string, same_site boolean")
    done = crawl.crawl(roots, links, pool, pages=pages, depth=depth, seeds=rows, attempts=attempts, used=2)
    most = pages if attempts is None else min(pages, attempts - 1)
    want = {i: queue_crawl(i, edges, stored, most, depth, seeds[i]) for i in range(40)}
    got = {}
    for r in done.targets.collect():
        got.setdefault(r.root, []).append((r.ord, (r.url, r.depth, r.parent, r.relation, r.fetched)))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: out for k, (out, _, _) in want.items()}
    report = {r.root: (r.targets, r.fetched, r.failed, r.max_depth, r.omitted) for r in crawl.crawl_report(done).collect()}
    assert report == {k: (len(o), sum(x[4] for x in o), sum(not x[4] for x in o), max(x[1] for x in o), left) for k, (o, left, _) in want.items()}
    counters = {r.root: Counter({n: r[n] for n in (*kinds, "search", "depth_blocked", "domain_blocked") if r[n]}) for r in done.counters.collect()}
    assert counters == {k: Counter({n: c for n, c in counts.items() if n != "sitemap_file"}) for k, (_, _, counts) in want.items()}
    outcomes = crawl.crawl_outcomes(done).collect()
    assert len(outcomes) == 12 * 40 and {r.status for r in outcomes} == {"APPLIED", "OBSERVED", "NOT_APPLICABLE"}


def test_crawl_of_pages_with_hubs_sitemaps_and_robots(spark, monkeypatch):
    """Pages, sitemaps and robots rules as a plain queue sees them; hubs are joined in blocks of three links."""
    monkeypatch.setattr(crawl, "LINKS", 3)
    rng = random.Random(5)
    names = [f"https://{h}a.example/p{i}" for i in range(12) for h in ("", "www.", "other.")]
    link = lambda x: f'<a href="{x.replace("https://a", "HTTPS://A") if rng.random() < 0.5 else x}#f">x</a>'
    pages = {n: [rng.choice([*names, "mailto:x", "/p3", "p4", "https://a.example/private/x", "https://[::1"]) for _ in range(rng.choice([0, 2, 15]))] for n in names[:30]}
    bodies = [(n, "text/html", "".join(map(link, xs))) for n, xs in pages.items()]
    bodies += [("https://a.example/sitemap.xml", "text/xml", "<urlset><loc> https://a.example/p9 </loc><loc>/p8</loc><loc>bad:x</loc></urlset>"), ("https://a.example/private/x", "text/html", link("/p11")), ("https://a.example/x.png", "image/png", link("/p11")), ("mailto:x", "text/html", "")]
    df = spark.createDataFrame(bodies, "url string, media_type string, body string")
    links = crawl.links_of(df)
    norm = lambda base, x: None if x in ("mailto:x", "https://[::1") else {"/p3": base.rsplit("/", 1)[0] + "/p3", "p4": base.rsplit("/", 1)[0] + "/p4"}.get(x, x)
    edges = {n: [norm(n, x) for x in xs] for n, xs in pages.items()} | {"https://a.example/sitemap.xml": ["https://a.example/p9", "https://a.example/p8"], "https://a.example/private/x": ["https://a.example/p11"]}
    assert {(r.src, r.pos): r.dst for r in links.collect()} == {(n, k): x for n, xs in edges.items() for k, x in ((k, x) for k, x in enumerate([y for y in xs] if "sitemap" in n or "private" in n else [z for z in pages_kept(pages[n])]) if norm(n, x)) for x in [norm(n, x)]}
    site = lambda x: x.split("/")[2].removeprefix("www.")
    roots = ["https://a.example/p0", "https://www.a.example/p1", "https://other.a.example/p2"]
    stored = {n for n, m, _ in bodies if n != "mailto:x" and "private" not in n}
    robots = spark.createDataFrame([("https://a.example", 200, "User-agent: *\nDisallow: /private\n")], "origin string, status int, body string")
    seeds = {r: [("https://a.example/sitemap.xml", 0, r, "sitemap_file", site(r) == "a.example")] for r in roots}
    rows = spark.createDataFrame([(r, xs[0][0], 0, -1, "sitemap_file") for r, xs in seeds.items()], "root string, url string, depth int, pos int, relation string")
    done = crawl.crawl(spark.createDataFrame([(r,) for r in roots], "root string"), links, df.select(crawl.urls.normalize(F.col("url")).alias("url")).where("url IS NOT NULL"), pages=25, depth=3, seeds=rows, robots=robots)
    kept_out = 0
    for r in roots:
        want, left, counts = queue_crawl(r, {n: [(x, site(x) == site(r), "sitemap" if "sitemap" in n else "internal") for x in xs if x] for n, xs in edges.items()}, stored, 25, 3, seeds[r])
        got = sorted((x.ord, (x.url, x.depth, x.parent, x.relation, x.fetched)) for x in done.targets.where(F.col("root") == r).collect())
        assert [x for _, x in got] == want
        assert done.rest.where(F.col("root") == r).count() == left
        blocked = done.counters.where(F.col("root") == r).first()
        assert (blocked.robots_blocked, blocked.domain_blocked, blocked.depth_blocked) == (sum("private" in x[0] for x in want), counts["domain_blocked"], counts["depth_blocked"])
        kept_out += blocked.robots_blocked
    assert kept_out
    assert spark.catalog.listTables() == []


def pages_kept(links):
    """Links that a parser takes: those of http and https, the broken one too."""
    return [x for x in links if x != "mailto:x" and x != "https://[::1"]


def test_redirect_verdicts(spark):
    steps = [("https://a/", 302, "https://b/"), ("https://b/", 301, "http://c/"), ("https://l/", 302, "https://m/"), ("https://m/", 302, "https://l/"), ("https://n/", 302, None), ("https://p/", 307, "https://q/"), ("https://r/", 303, "https://q/")]
    starts = [("https://a/", "GET"), ("https://l/", "GET"), ("https://n/", "GET"), ("https://p/", "POST"), ("https://r/", "POST"), ("https://z/", "GET")]
    got = crawl.redirect_chains(spark.createDataFrame(starts, "url string, method string"), spark.createDataFrame(steps, "src string, status int, location string"), 8)
    assert {r.start: (r.verdict, r.method, r.final) for r in got.collect()} == {
        "https://a/": ("downgrade", "GET", "https://b/"), "https://l/": ("loop", "GET", "https://m/"), "https://n/": ("missing_location", "GET", "https://n/"),
        "https://p/": ("replay_blocked", "POST", "https://p/"), "https://r/": ("ok", "GET", "https://q/"), "https://z/": ("ok", "GET", "https://z/"),
    }


def test_redaction():
    payload = {"token": "x", "input_tokens": 5, "nested": [{"Api-Key": "k", "url": "https://u:p@h/?token=1&q=2"}], "note": "see https://h/?x=1.", "my_auth": 1, "body": "b"}
    want = {"token": "[REDACTED]", "input_tokens": 5, "nested": [{"Api-Key": "[REDACTED]", "url": "https://h/?token=%5BREDACTED%5D&q=2"}], "note": payload["note"], "my_auth": "[REDACTED]", "body": "[REDACTED]"}
    assert ledger.redact(payload, "", False) == want
    assert ledger.redact(payload, "", True)["note"] == "see https://h/?x=%5BREDACTED%5D."


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.org/private/x",), ("https://a.org/ok",), ("https://b.org/private/x",), ("https://c.org/",)], "url string")
    robots = spark.createDataFrame([("https://a.org", 200, "User-agent: *\nDisallow: /private"), ("https://b.org", 404, "User-agent: *\nDisallow: /")], "origin string, status int, body string")
    assert {r.url: r.robots_allowed for r in policy.robots_filter(urls, robots).collect()} == {"https://a.org/private/x": False, "https://a.org/ok": True, "https://b.org/private/x": True, "https://c.org/": True}


def test_content_store(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "body binary")
    path = f"file://{tmp_path}/cas"
    content.cas_append(path, rows, "body")
    content.cas_append(path, rows.union(spark.createDataFrame([(b"c",)], "body binary")), "body")
    assert sorted(bytes(r.body) for r in content.content_store(spark, path).read().collect()) == [b"a", b"b", b"c"]


def test_key_conflicts(spark):
    df = spark.createDataFrame([("a", ["x"]), ("a", ["y"]), ("b", ["x", "a"])], "id string, names array<string>")
    assert {tuple(r) for r in runs.key_conflicts(df, "id", "names").collect()} == {("a", "duplicate id"), ("x", "duplicate alias"), ("a", "alias is an id")}


def test_navigation_and_links(spark):
    page = '<link rel="canonical" href="/c"><meta property="og:url" content="https://o/"><meta http-equiv="refresh" content="3; URL=\'r.html\'"><script>window.location.href = "/s"</script><a rel="next" href="2">x</a><a class="related" href="//h/x">y</a><a href="mailto:a@b">z</a>'
    row = spark.createDataFrame([("https://e.org/a/b", page)], "url string, html string").select(content.page_navigation("url", "html").alias("n"), content.page_links("url", "html").alias("l")).first()
    assert tuple(row.n) == ("https://e.org/c", "https://o/", "https://e.org/a/r.html", "https://e.org/s")
    assert [tuple(x) for x in row.l] == [("https://e.org/c", "internal"), ("https://e.org/a/2", "next"), ("https://h/x", "related")]


FLAGS = ("accepted", "failed", "policy", "auth", "not_found", "budget", "artifacts", "dependency")


@pytest.mark.parametrize(
    "flags,status",
    [
        ("accepted", "SUCCEEDED"), ("accepted policy not_found", "SUCCEEDED"), ("accepted failed", "PARTIAL"), ("accepted auth", "PARTIAL"), ("accepted budget", "PARTIAL"), ("accepted dependency", "PARTIAL"),
        ("policy auth", "BLOCKED_BY_POLICY"), ("auth not_found", "AUTH_REQUIRED"), ("not_found budget", "NOT_FOUND"), ("budget artifacts", "BUDGET_EXHAUSTED"), ("artifacts", "LOW_QUALITY"),
        ("artifacts failed", "PARTIAL"), ("artifacts dependency", "PARTIAL"), ("dependency failed", "DEPENDENCY_MISSING"), ("failed", "FAILED"), ("", "FAILED"),
    ],
)
def test_run_status(spark, flags, status):
    schema = "run_id long, " + ", ".join(f"{f} boolean" for f in FLAGS)
    rows = [(1, *[f == x for f in FLAGS]) for x in flags.split() or [""]] + [(1, *[None] * len(FLAGS))]
    assert [r.status for r in runs.run_status(spark.createDataFrame(rows, schema)).collect()] == [status]


def test_a_bundle_is_packed_by_document_and_line(spark):
    docs = spark.createDataFrame([(10, "the license"), (9, "x\nlicense " + "y" * 40), (8, "nothing")], "doc_id long, text string")
    got = runs.context_bundle(docs, "license", 14).collect()
    assert [(r.locator, r.confidence, r.fallback_reason) for r in got] == [("9:2", 0.35, None)]
    notes = spark.createDataFrame([("n1", "license terms", 0.2), ("n2", "license terms, too", 0.9), ("n3", "other", 1.0)], "locator string, excerpt string, score double")
    got = runs.context_bundle(docs, "what license terms?", 500, sources=notes).collect()
    assert {r.locator for r in got} == {"n1", "n2", "9:2", "10:1"} and {r.fallback_reason for r in got} == {"simplified query after retrieval miss"}
    assert {r.confidence for r in got} == {1.0}
    got = runs.context_bundle(docs, "license terms", 500, sources=notes).collect()
    assert {r.fallback_reason for r in got} == {None}


def test_eligibility(spark):
    rows = spark.createDataFrame([("a", True, True, []), ("b", False, False, ["x", "y"])], "capability_id string, allowed boolean, available boolean, dependencies array<string>")
    got = {r.capability_id: (r.eligible, r.reasons) for r in ledger.eligibility(rows).collect()}
    assert got["a"] == (True, ["capability is registered, allowed, and available"])
    assert got["b"] == (False, ["capability is denied by the request policy", "capability implementation is unavailable", "dependencies: x, y"])


def test_dependencies_that_are_missing(spark):
    needed = spark.createDataFrame([("pdf", "PDF reading", "documents"), ("ocr", "OCR", "media")], "capability_id string, feature string, extra string")
    got = runs.dependency_rows(needed, spark.createDataFrame([("media",)], "extra string")).collect()
    assert [tuple(r) for r in got] == [("pdf", "FAILED", "dependency_missing", "install the extra documents to enable PDF reading")]


def test_rows_without_a_digest_stay(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "k long, d string")
    want = {1: None, 2: 1, 3: None, 4: None, 5: None}
    assert {r.k: r.duplicate_of for r in content.first_with_digest(rows, "d", "k", "k").collect()} == want
    monkeypatch.setattr(shared.join_counted, "__kwdefaults__", {"few": 1, "hot": 2})
    assert {r.k: r.duplicate_of for r in content.first_with_digest(rows, "d", "k", "k").collect()} == want


def test_links_after_a_bad_one(spark):
    page = '<a href="http://[bad">x</a><a href="/good">y</a><link rel="canonical" href="http://[bad"><link rel="canonical" href="/c">'
    row = spark.createDataFrame([("https://e.org/a", page)], "url string, html string").select(content.page_links("url", "html").alias("l"), content.page_navigation("url", "html").alias("n")).first()
    assert [x.url for x in row.l] == ["https://e.org/good", "https://e.org/c"] and row.n.canonical == "https://e.org/c"


def test_bad_files_give_error_rows(spark, monkeypatch):
    long = b"a,b\nx,\"" + b"y" * 200_000 + b"\"\n"
    got = files.csv_rows(spark.createDataFrame([("long", long), ("none", None)], "path string, content binary")).collect()
    assert [(r.path, r.locator, r.error) for r in got] == [("long", "row:1", None), ("long", "row:2", None), ("none", "row:1", "no content")]
    locked = bytearray(box([("a.html", b"<p>x</p>")]))
    for at in (locked.find(b"PK\x03\x04") + 6, locked.find(b"PK\x01\x02") + 8):
        locked[at] |= 1  # says that the member is encrypted
    cases = {"locked": bytes(locked), "junk": b"no zip", "none": None, "bomb": box([("a.html", b"0" * 1_000_000)]), "good": box([("a.html", b"<p>x</p>"), ("../b.html", b"y")])}
    rows = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "path string, content binary")
    epub = {}
    for r in files.epub_members(rows).collect():
        epub.setdefault(r.path, []).append((r.locator, r.text, r.error and r.error.split(",")[0]))
    assert epub["good"] == [("member:a.html", " x ", None)] and all(epub[k][0][0] is None and epub[k][0][2] for k in ("locked", "junk", "none", "bomb"))
    found = {r.path: (r.member, r.error is not None) for r in files.archive_members(rows).collect()}
    assert all(found[k] == (None, True) for k in cases)


@pytest.mark.parametrize("capability,body", [("xml_endpoint", "<r>" + "x" * 300 + "</r>"), ("openapi_discovery", "openapi: 3.0.0\npaths: {}\nx: " + "y" * 300), ("json_endpoint", '"' + "x" * 300 + '"')])
def test_size_limits(monkeypatch, capability, body):
    monkeypatch.setattr(payloads, "MAX_BYTES", 200)
    with pytest.raises(ValueError, match="size limit"):
        payloads.normalize(capability, body.encode(), "", 10)


def test_yaml_is_counted_before_it_is_built(monkeypatch):
    monkeypatch.setattr(payloads, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="node or nesting limit"):
        payloads.normalize("openapi_discovery", ("openapi: 3.0.0\npaths:\n" + "".join(f"  /{i}: 1\n" for i in range(30))).encode(), "", 10)


def test_answers_belong_to_their_hosts():
    ok = payloads.normalize("crossref_openalex_api", b'{"message":1}', "", 10, "https://api.crossref.org/works")
    assert ok["format"] == "json"
    for capability, body, source in (("crossref_openalex_api", b'{"results":1}', "https://api.crossref.org/works"), ("crossref_openalex_api", b'{"message":1}', "https://api.openalex.org/works"), ("arxiv_api", f'<feed xmlns="{payloads.ATOM}"/>'.encode(), "https://arxiv.example/")):
        with pytest.raises(ValueError):
            payloads.normalize(capability, body, "", 10, source)
    rss = payloads.normalize("rss", b'<rss version="2.0"><channel><title> T </title><link>l</link><item><title>i</title></item></channel></rss>', "", 10)
    assert (rss["data"]["title"], rss["data"]["link"], rss["data"]["description"]) == ("T", "l", None)


def test_later_readers_run_for_the_rest_only(spark, tmp_path):
    path = str(tmp_path)

    @F.udf("string")
    def second(k):
        open(f"{path}/{k}", "w").close()
        return "y" * 100 if k % 3 == 0 else ""

    rows = spark.range(30).withColumnRenamed("id", "k")
    readers = {"first": F.when(F.col("k") % 2 == 0, F.repeat(F.lit("x"), 100)).otherwise(""), "second": second("k")}
    got = {r.k: r.reader for r in content.first_accepted(rows, readers, "k").collect()}
    assert got == {k: "first" if k % 2 == 0 else "second" if k % 3 == 0 else None for k in range(30)}
    assert {int(x) for x in os.listdir(path)} == {k for k in range(30) if k % 2}


def test_sitemap_locations_are_joined(spark):
    rows = spark.createDataFrame([("https://e.org/s/map.xml", "<loc> a.html </loc><loc>/b</loc><loc>ftp://x/</loc><LOC>HTTP://F.org</LOC>")], "url string, body string")
    assert [r.loc for r in content.sitemap_locs(rows, "url", "body").orderBy("pos").collect()] == ["https://e.org/s/a.html", "https://e.org/b", "http://f.org/"]


def test_running_sums_and_pacing_over_many_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(50), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, k int, n int").repartition(7)
    got = {r.k: (r.total, r.place) for r in shared.accumulated(df, ["g"], [F.col("o"), F.col("k")], {"total": F.col("n"), "place": F.lit(1)}).collect()}
    want, run = {}, Counter()
    for g, o, k, n in sorted(rows, key=lambda r: (r[1], r[2])):
        run[g, "n"] += n
        run[g, "c"] += 1
        want[k] = (run[g, "n"], run[g, "c"])
    assert got == want
    slots = {r.k: r.slot_ms for r in policy.host_pacing(df, host="g", at_ms="o", key="k", interval_ms=3).collect()}
    last = {}
    for g, o, k, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        last[g] = max(o, last[g] + 3) if g in last else o
        assert slots[k] == last[g]


def test_an_id_both_allowed_and_denied_is_an_error(spark):
    rows = spark.range(1).select(policy.permitted(F.lit("a"), F.array(F.lit("a")), F.array(F.lit("a"))))
    with pytest.raises(Exception, match="both allowed and denied"):
        rows.collect()


def test_cache_scopes(spark):
    row = spark.range(1).select(content.authentication_scope(F.lit(None).cast("string")).alias("a"), content.authentication_scope(F.lit("r")).alias("b")).first()
    assert row.a == "public" and row.b.startswith("auth:sha256:") and "r" != row.b
    with pytest.raises(Exception, match="cannot be blank"):
        spark.range(1).select(content.authentication_scope(F.lit("  "))).collect()


def test_a_tail_ends_for_good(spark, tmp_path):
    """Events that arrive after a run's end, in a later file, are not shown."""
    path, schema = f"file://{tmp_path}/log", "run_id long, sequence long, event_type string"
    out = [(1, 1, "A"), (1, 2, "FINISHED"), (2, 1, "A")], [(1, 3, "LATE"), (2, 2, "B")]
    marks, table = f"file://{tmp_path}/marks", f"file://{tmp_path}/out"
    for rows in out:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = events.until_finished(events.tail(spark, path, spark.createDataFrame([], schema).schema))
        stream.writeStream.option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).format("parquet").option("path", table).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(table).collect()} == {(1, 1, "A"), (1, 2, "FINISHED"), (2, 1, "A"), (2, 2, "B")}


def test_tables_can_be_cleared(spark):
    df = shared.written(spark.range(3), "t")
    assert df.count() == 3
    path = df.inputFiles()[0]
    assert f"/pagelake/{spark.sparkContext.applicationId}/t-" in path
