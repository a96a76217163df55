"""Queries over pages and texts: extraction, quality, storage."""

from __future__ import annotations

from html import entities

from pyspark.sql import functions as F

from pagelake.functions import html, quality as q, urls as u
from pagelake.operators import content, policy
from pagelake.operators.shared import numbered
from pagelake.plans.registry import query, table
from pagelake.plans.urls import PARTS

SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def sql_text(x: str) -> str:
    """Visible text; the entities that the pages use."""
    dropped = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "noscript"))
    out = rf"regexp_replace(regexp_replace({x}, '(?is){dropped}', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return sql_squeeze(out)


ARTICLE = r"coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), html)"


def _sql_quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: What HTML takes for a reference.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that HTML knows without a semicolon too, the longest first, as a reference may begin with one.
_BARE = "|".join(sorted((n for n in entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NAMED = "MAP {" + ", ".join(f"{_sql_quoted('&' + n)}: {_sql_quoted(c)}" for n, c in sorted(entities.html5.items())) + "}"
#: Numbers that HTML reads as characters of windows-1252, and the other controls and noncharacters, which it drops.
_CP1252 = {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}
_CP1252_MAP = "MAP {" + ", ".join(f"{k}: {_sql_quoted(c)}" for k, c in _CP1252.items()) + "}"
_DROPPED = "n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534"


def sql_unescape(x: str) -> str:
    """All references of HTML, each once: numbers, names, and names that HTML knows without a semicolon at the start of others."""
    digits = "CASE WHEN lower(s[3:3]) = 'x' THEN '0x' || ltrim(regexp_extract(s, '^&#[xX]([0-9a-fA-F]+)', 1), '0') ELSE ltrim(regexp_extract(s, '^&#([0-9]+)', 1), '0') END"
    n = f"CASE WHEN ({digits}) IN ('', '0x') THEN 0 ELSE coalesce(TRY_CAST(({digits}) AS BIGINT), 1114112) END"
    number = f"list_transform([{n}], lambda n: CASE WHEN map_contains({_CP1252_MAP}, n) THEN {_CP1252_MAP}[n] WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {_DROPPED} THEN '' ELSE chr(n::INTEGER) END)[1]"
    bare = f"regexp_extract(s, '^&({_BARE})')"
    named = f"coalesce({_NAMED}[s], {_NAMED}[{bare}] || substr(s, length({bare}) + 1), s)"
    one = f"CASE WHEN s[1:1] <> '&' OR length(s) < 2 THEN s WHEN s[2:2] = '#' THEN {number} ELSE {named} END"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(regexp_extract_all({x}, '{_REFERENCE}|[^&]+|&'), lambda s: {one}), '') ELSE {x} END"


def _sql_letters(tag: str) -> str:
    """A tag's name in capitals or not, of ASCII only."""
    return "".join(f"[{c}{c.upper()}]" for c in tag)


def sql_visible(source: str) -> str:
    """``page_id, text`` of markup ``m`` in ``source``: scripts and styles out, tags as spaces, entities, single spaces."""
    dropped = "|".join(rf"<{t}\b[^>]*>.*?</{t}[\s\x0B]*>" for t in map(_sql_letters, ("script", "style", "noscript")))
    bare = f"regexp_replace(regexp_replace(coalesce(m, ''), '(?s){dropped}', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    return f"SELECT page_id, {sql_squeeze(sql_unescape('b'))} AS text FROM (SELECT page_id, {bare} AS b FROM ({source}))"


def sql_main() -> str:
    """``page_id, m``: inside of the longest main or article element, the first of equals, else all."""
    found = "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in map(_sql_letters, ("main", "article")))
    inner = f"list_transform(regexp_extract_all(html, '(?s){found}'), lambda e: regexp_extract(e, '(?s)^<[^>]*>(.*)</[A-Za-z]+>$', 1))"
    return f"SELECT page_id, CASE WHEN len(x) > 0 THEN list_filter(x, lambda e: length(e) = list_max(list_transform(x, lambda y: length(y))))[1] ELSE html END AS m FROM (SELECT page_id, html, {inner} AS x FROM pages)"


def sql_state(x: str) -> str:
    cases = "".join(f" WHEN regexp_matches({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({p})([^\\p{{L}}\\p{{N}}_]|$)'){f' AND length({x}) < {q.SHORT}' if short else ''} THEN '{n}'" for n, p, short, _ in q.STATES)
    return f"CASE WHEN {x} = '' THEN 'EMPTY'{cases} ELSE 'OK' END"


def sql_language(x: str) -> str:
    """Marker words only: the tables have Latin scripts."""
    words = f"list_transform(regexp_extract_all({x}, '{q.WORD}'), lambda w: lower(w))"
    count = {k: f"len(list_filter({words}, lambda w: w IN ({', '.join(repr(m) for m in v)})))" for k, v in q.MARKERS.items()}
    best = f"greatest({', '.join(count.values())})"
    return f"CASE WHEN {best} < 2 THEN NULL " + " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in count.items()) + " END"


def pages(spark, d):
    return table(spark, d, "pages")


def _assessed(df, text):
    return q.with_quality(df, text)


@query("page_quality", f"""WITH {PARTS}, t AS (SELECT p.page_id, {sql_text(ARTICLE)} AS t FROM pages p),
  s AS (SELECT *, {sql_state('t')} AS page_state, least(1.0::DOUBLE, length(t) / 1000.0::DOUBLE) AS share FROM t)
  SELECT page_id, regexp_replace(u.host, '^www\\.', '') AS site_host, page_state, {sql_language('t')} AS language,
         round(CASE WHEN page_state = 'OK' THEN share ELSE least(0.2::DOUBLE, share) END, 4) AS score, page_state = 'OK' AND share >= 0.05 AS accepted
  FROM s JOIN u USING (page_id)""")
def page_quality(spark, d):
    """Flagship: article text of every page, its state, language and score."""
    rows = _assessed(pages(spark, d), html.main_article(F.col("html")))
    return rows.select("page_id", u.site_host(F.col("url")).alias("site_host"), "page_state", "language", "score", "accepted")


@query("page_scan", f"""WITH t AS (SELECT *, {sql_squeeze('html')} AS t FROM pages), s AS (SELECT *, {sql_state('t')} AS raw_state, least(1.0::DOUBLE, length(t) / 1000.0::DOUBLE) AS share FROM t)
  SELECT page_id, url, 200 AS status, 'text/html' AS media_type, sha256(html) AS sha256, octet_length(encode(html)) AS size, raw_state, round(CASE WHEN raw_state = 'OK' THEN share ELSE least(0.2::DOUBLE, share) END, 4) AS raw_score FROM s""")
def page_scan(spark, d):
    return content.page_scan(pages(spark, d))


#: Media types by page, the same in SQL.
MEDIA = ("text/html", "application/xhtml+xml", "image/png", "application/json")
_MEDIA = "[" + ", ".join(f"'{m}'" for m in MEDIA) + "][page_id % 4 + 1]"


def with_media(spark, d):
    return pages(spark, d).withColumn("media_type", F.element_at(F.array(*map(F.lit, MEDIA)), (F.col("page_id") % 4 + 1).cast("int")))


@query("raw_html", f"SELECT page_id, html, {_MEDIA} IN ('text/html', 'application/xhtml+xml') AS is_html FROM pages")
def raw_html(spark, d):
    return content.raw_html(with_media(spark, d), "html", "media_type").select("page_id", "html", "is_html")


def _reader(name: str, text, sql: str) -> None:
    def run(spark, d):
        return pages(spark, d).select("page_id", text(F.col("html")).alias("text"))

    query(name, sql_visible(sql))(run)


_ALL = "SELECT page_id, html AS m FROM pages"
_reader("clean_text", html.clean_text, _ALL)
_reader("boilerplate_removal", html.clean_text, _ALL)
_reader("main_article", html.main_article, sql_main())
_reader("newspaper_style", html.main_article, sql_main())
_reader("mercury_style", html.main_article, sql_main())


@query("page_navigation", "SELECT page_id, 'https://example.com/c/' || page_id AS canonical, 'https://example.com/o' AS opengraph, 'https://example.com/r' AS refresh, 'https://example.com/s' AS script FROM pages")
def page_navigation(spark, d):
    """Pages with the four kinds of marks put before their markup."""
    marks = F.concat(F.lit('<link rel="canonical" href="/c/'), F.col("page_id").cast("string"), F.lit('"><meta property="og:url" content="/o"><meta http-equiv="refresh" content="0; url=/r"><script>window.location = "/s";</script>'))
    found = content.page_navigation(F.lit("https://example.com/a"), F.concat(marks, F.col("html")))
    return pages(spark, d).select("page_id", found.alias("n")).select("page_id", "n.*")


@query("page_links", f"""WITH {PARTS}, l AS (SELECT page_id, unnest(x) AS href, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS x FROM pages))
  SELECT page_id, (i - 1)::INTEGER AS pos, s || '://' || n || href AS url, 'internal' AS relation FROM l JOIN u USING (page_id)""")
def page_links(spark, d):
    rows = pages(spark, d).select("page_id", F.posexplode(content.page_links("url", "html")).alias("pos", "l"))
    return rows.select("page_id", "pos", "l.url", "l.relation")


#: Pages in one sitemap.
SITEMAP = 1000


@query("sitemap_locs", f"""WITH {PARTS} SELECT site_host, map, (row_number() OVER (PARTITION BY site_host, map ORDER BY page_id) - 1)::INTEGER AS pos,
  CASE WHEN page_id % 3 = 0 THEN 'https://' || site_host || '/p/' || page_id ELSE norm END AS loc
  FROM (SELECT *, (row_number() OVER (PARTITION BY site_host ORDER BY page_id) - 1) // {SITEMAP} AS map FROM (SELECT *, regexp_replace(host, '^www\\.', '') AS site_host FROM u))""")
def sitemap_locs(spark, d):
    """Sitemaps of 1,000 pages of a site each, every third page by a relative location, read back."""
    loc = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/p/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    rows = pages(spark, d).select(u.site_host(F.col("url")).alias("site_host"), "page_id", F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc></url>")).alias("x"))
    rows = numbered(rows, ["site_host"], [F.col("page_id")], "n").withColumn("map", F.floor(F.col("n") / SITEMAP))
    maps = rows.groupBy("site_host", "map").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda x: x["x"]), "\n").alias("body"))
    maps = maps.withColumn("url", F.concat(F.lit("https://"), "site_host", F.lit("/sitemap.xml")))
    return content.sitemap_locs(maps, "url", "body", "site_host", "map")


@query("first_accepted_reader", f"WITH t AS (SELECT page_id, {sql_text(ARTICLE)} AS a, {sql_text('html')} AS b FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 AND {sql_state('a')} = 'OK' AND length(a) >= 50 THEN 'main_article' WHEN {sql_state('b')} = 'OK' AND length(b) >= 50 THEN 'clean_text' END AS reader FROM t")
def first_accepted_reader(spark, d):
    """Odd pages have no usable article."""
    readers = {"main_article": F.when(F.col("page_id") % 2 == 0, html.main_article(F.col("html"))).otherwise(""), "clean_text": html.clean_text(F.col("html"))}
    return content.first_accepted(pages(spark, d), readers, "page_id").select("page_id", "reader")


MARKS = ("", "Verify you are human with this CAPTCHA. ", "Access denied due to unusual traffic. ", "Subscribe to continue reading. ", "Sign in and enter your password. ", "404 not found. ", "")
_MARKED = "marked AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 6 THEN '' ELSE [" + ", ".join(f"'{m}'" for m in MARKS) + f"][doc_id % 7 + 1] || {sql_squeeze('text')} END AS t FROM documents), m AS (SELECT doc_id, lang, trim(t) AS t FROM marked)"


def marked(spark, d):
    """Documents with a state's marker before the text, by id; every seventh is empty."""
    rows = table(spark, d, "documents")
    text = F.concat(F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % 7 + 1).cast("int")), F.col("text"))
    return rows.select("doc_id", "lang", "source", q.squeeze(F.when(F.col("doc_id") % 7 == 6, "").otherwise(text)).alias("t"))


@query("page_state", f"WITH {_MARKED} SELECT doc_id, {sql_state('t')} AS page_state FROM m")
def page_state(spark, d):
    return marked(spark, d).select("doc_id", q.page_state(F.col("t")).alias("page_state"))


@query("detect_language", f"WITH t AS (SELECT doc_id, {sql_squeeze('text')} AS t FROM documents) SELECT doc_id, {sql_language('t')} AS language FROM t")
def detect_language(spark, d):
    return table(spark, d, "documents").select("doc_id", q.language(q.squeeze(F.col("text"))).alias("language"))


_Q = f"{_MARKED}, s AS (SELECT *, {sql_state('t')} AS base, {sql_language('t')} AS found, least(1.0::DOUBLE, length(t) / 1000.0::DOUBLE) AS share FROM m), w AS (SELECT *, CASE WHEN base = 'OK' AND found IS NOT NULL AND found <> lang THEN 'WRONG_LANGUAGE' ELSE base END AS state FROM s)"


def _judged(spark, d):
    return q.with_quality(marked(spark, d), F.col("t"), F.col("lang"))


@query("wrong_language", f"WITH {_Q} SELECT doc_id, state AS page_state FROM w")
def wrong_language(spark, d):
    return _judged(spark, d).select("doc_id", "page_state")


@query("quality_score", f"WITH {_Q} SELECT doc_id, round(CASE WHEN state = 'OK' THEN share ELSE least(0.2::DOUBLE, share) END, 4) AS score, state = 'OK' AND share >= 0.05 AS accepted FROM w")
def quality_score(spark, d):
    return _judged(spark, d).select("doc_id", "score", "accepted")


_REASON = " ".join(f"WHEN '{n}' THEN '{r}'" for n, _, _, r in q.STATES)


@query("quality_reasons", f"""WITH {_Q} SELECT doc_id, array_to_string(list_filter([CASE state WHEN 'EMPTY' THEN 'no usable text' {_REASON} END,
  CASE WHEN state = 'WRONG_LANGUAGE' THEN 'detected language ' || found || ' does not match requested ' || lang END,
  CASE WHEN state = 'OK' AND share < 0.05 THEN 'content is below the minimum useful-text threshold' END,
  CASE WHEN found IS NULL THEN 'text was too ambiguous for deterministic language detection' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM w""")
def quality_reasons(spark, d):
    return _judged(spark, d).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


@query("artifact_role", f"WITH {_Q} SELECT doc_id, CASE WHEN state = 'OK' AND share >= 0.05 THEN 'primary' ELSE 'checked-only' END AS role FROM w")
def artifact_role(spark, d):
    return _judged(spark, d).select("doc_id", q.role(F.col("accepted")).alias("role"))


@query("detector_outcomes", f"""WITH {_Q}, f AS (SELECT w.*, d.text, min(w.doc_id) OVER (PARTITION BY d.text) AS lead FROM w JOIN documents d USING (doc_id))
  SELECT doc_id, o.capability_id, o.status FROM (SELECT doc_id, unnest([{', '.join(f"{{'capability_id': '{n}', 'status': CASE WHEN state = '{s}' THEN 'OBSERVED' ELSE 'NOT_APPLICABLE' END}}" for n, s in content.DETECTORS)},
  {{'capability_id': 'duplicate_detection', 'status': CASE WHEN lead <> doc_id THEN 'OBSERVED' ELSE 'NOT_APPLICABLE' END}}, {{'capability_id': 'content_quality_validation', 'status': 'APPLIED'}}]) AS o FROM f)""")
def detector_outcomes(spark, d):
    firsts = content.first_with_digest(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "sha", "doc_id", "doc_id")
    return content.detector_outcomes(_judged(spark, d).join(firsts.select("doc_id", "duplicate_of"), "doc_id"), "doc_id")


@query("binary_quality", "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'OK' ELSE 'EMPTY' END AS page_state, CASE WHEN doc_id % 5 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM documents")
def binary_quality(spark, d):
    size = F.when(F.col("doc_id") % 5 > 0, F.octet_length("text")).otherwise(0)
    return table(spark, d, "documents").select("doc_id", q.binary_state(size).alias("page_state"), F.when(size > 0, 1.0).otherwise(0.0).alias("score"))


@query("raw_quality", f"WITH t AS (SELECT page_id, {_MEDIA} AS media, {sql_squeeze('html')} AS t, octet_length(encode(html)) AS size FROM pages) SELECT page_id, CASE WHEN media <> 'image/png' THEN {sql_state('t')} WHEN size > 0 THEN 'OK' ELSE 'EMPTY' END AS state FROM t")
def raw_quality(spark, d):
    return with_media(spark, d).select("page_id", q.raw_state(F.col("html"), F.col("media_type")).alias("state"))


@query("exact_duplicate", "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY text), doc_id) AS duplicate_of FROM documents")
def exact_duplicate(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return content.first_with_digest(rows, "sha", "doc_id", "doc_id").select("doc_id", "duplicate_of")


def fetch_log(spark, d):
    """A log derived from pages: protocol, encoding, redirects and status by id."""
    k = F.col("page_id")
    marks = F.concat(F.when(k % 5 == 0, '<link rel="canonical" href="/c">').otherwise(""), F.when(k % 5 == 1, '<meta property="og:url" content="/o">').otherwise(""), F.when(k % 3 == 0, '<meta http-equiv="refresh" content="0; url=/r">').otherwise(""), F.when(k % 7 == 0, '<script>location = "/s";</script>').otherwise(""))
    return with_media(spark, d).select(
        "page_id", "url", "media_type", content.page_navigation("url", F.concat(marks, F.col("html"))).alias("navigation"), F.element_at(F.array(*map(F.lit, ["HTTP/1.1", "HTTP/2", "HTTP/3"])), (k % 3 + 1).cast("int")).alias("http_version"), F.when(k % 2 == 0, "Chunked").alias("transfer_encoding"),
        F.when(k % 4 == 0, F.array(F.lit(301), F.lit(307))).otherwise(F.array().cast("array<int>")).alias("redirect_statuses"),
        F.element_at(F.array(*map(F.lit, [200, 404, 401, 401, 403, 503])), (k % 6 + 1).cast("int")).alias("status"),
        F.when(k % 6 == 3, 'Bearer error="invalid_token"').when(k % 6 == 2, "Basic").alias("challenge"),
    )


def _yes(c: str, word: str = "OBSERVED") -> str:
    return f"CASE WHEN {c} THEN '{word}' ELSE 'NOT_APPLICABLE' END"


_RESPONSE = [("connectivity_check", "'APPLIED'"), ("tls_certificate_check", _yes("s = 'https'", "APPLIED")), ("content_type_probe", "'OBSERVED'"), ("file_size_probe", "'OBSERVED'"), ("streaming_response", "'APPLIED'"), ("chunked_response", _yes("page_id % 2 = 0")), ("http_1_1", _yes("page_id % 3 = 0")), ("http_2", _yes("page_id % 3 = 1")), ("http_3", _yes("page_id % 3 = 2")), *((f"redirect_{s}", _yes("page_id % 4 = 0") if s in (301, 307) else "'NOT_APPLICABLE'") for s in (301, 302, 303, 307, 308)), ("redirect_chain", _yes("page_id % 4 = 0")), ("redirect_loop_detection", "'APPLIED'"), ("source_hash_comparison", "'OBSERVED'")]


_HTML_RESPONSE = [("raw_html", "'APPLIED'"), ("meta_refresh_redirect", _yes("page_id % 3 = 0")), ("javascript_redirect", _yes("page_id % 7 = 0")), ("canonical_redirect", _yes("page_id % 5 = 0")), ("opengraph_url_redirect", _yes("page_id % 5 = 1"))]


@query("response_outcomes", f"WITH {PARTS} SELECT page_id, o.c AS capability_id, o.s AS status FROM (SELECT page_id, unnest([{', '.join(f"{{'c': '{n}', 's': {x}}}" for n, x in _RESPONSE)}]) AS o FROM u) UNION ALL SELECT page_id, o.c, o.s FROM (SELECT page_id, unnest([{', '.join(f"{{'c': '{n}', 's': {x}}}" for n, x in _HTML_RESPONSE)}]) AS o FROM u WHERE page_id % 4 < 2)")
def response_outcomes(spark, d):
    return content.response_outcomes(fetch_log(spark, d), "page_id")


@query("status_failure_class", "SELECT page_id, ['ok', 'not_found', 'auth_required', 'auth_expired', 'auth_required', 'failed'][page_id % 6 + 1] AS class FROM pages")
def status_failure_class(spark, d):
    return fetch_log(spark, d).select("page_id", content.failure_class(F.col("status"), F.col("challenge")).alias("class"))


@query("source_hash", f"WITH {PARTS} SELECT DISTINCT norm AS normalized, CASE page_id % 4 WHEN 0 THEN 'gone' WHEN 1 THEN 'changed' WHEN 2 THEN 'new' ELSE 'same' END AS change FROM (SELECT page_id, norm || '#' || page_id AS x, 'https://example.com/' || page_id AS norm FROM u)")
def source_hash(spark, d):
    """Two snapshots: by id, pages go, change, come or stay."""
    rows = pages(spark, d).select("page_id", F.concat(F.lit("https://EXAMPLE.com/"), F.col("page_id").cast("string")).alias("url"), F.sha2("html", 256).alias("sha"))
    after = rows.where("page_id % 4 <> 0").withColumn("sha", F.when(F.col("page_id") % 4 == 1, F.reverse("sha")).otherwise(F.col("sha")))
    return content.snapshot_changes(rows.where("page_id % 4 <> 2"), after, "url", "sha")


@query("cache_freshness", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1997-01-01'")
def cache_freshness(spark, d):
    """Orders as cache records; every fifth never expires."""
    rows = table(spark, d, "orders").withColumn("expires_at", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return content.fresh(rows, "expires_at", F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("cache_key", f"""WITH {PARTS} SELECT page_id, sha256('{{"authentication_scope":"' || CASE WHEN page_id % 3 = 0 THEN 'auth:sha256:' || sha256('{content.SCOPE_DOMAIN}' || chr(0) || 'ref' || page_id % 2) ELSE 'public' END || '","language":"' || CASE WHEN page_id % 2 = 0 THEN 'en' ELSE '' END ||
  '","parser_version":"1","policy_profile":"default","representation":"html","url":"' || norm || '","vary":[["accept","text/html"]]}}') AS key FROM u""")
def cache_key(spark, d):
    """All seven parts of each page's key; every third page was fetched with one of two references."""
    k, u_ = F.col("page_id"), u.normalize(F.col("url"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("ref"), (k % 2).cast("string")))
    key = content.cache_key(url=u_, representation=F.lit("html"), policy_profile=F.lit("default"), parser_version=F.lit("1"), authentication_ref=ref, language=F.when(k % 2 == 0, "en"), vary=F.array(F.array(F.lit("accept"), F.lit("text/html"))))
    return pages(spark, d).select("page_id", key.alias("key"))


@query("needs_ocr", f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {sql_squeeze('text')} END AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND t = '' THEN 'NEEDS_OCR' ELSE {sql_state('t')} END AS state FROM t")
def needs_ocr(spark, d):
    """Every third document is a PDF, every fourth is an image without text."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("docx").alias("form"))
    return rows.select("doc_id", q.ocr_state(F.col("text"), F.col("form")).alias("state"))


@query("cas_put", "SELECT DISTINCT sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) AS prefix, octet_length(encode(text)) AS size FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def cas_put(spark, d):
    """A store with every third document gets the others."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body"))
    store = content.cas_put(None, docs.where("doc_id % 3 = 0"), "body")
    return content.cas_put(store, docs, "body").select("sha256", "prefix", "size")


@query("cas_get_verify", """SELECT 'cas://sha256/' || sha256(text) AS uri, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE octet_length(encode(text)) END AS size,
  CASE WHEN doc_id % 3 = 0 THEN 'not_found' WHEN octet_length(encode(text)) > 40000 THEN 'too_large' WHEN doc_id % 5 = 0 THEN 'digest_mismatch' END AS error FROM (SELECT doc_id, doc_id || ' ' || text AS text FROM documents)""")
def cas_get_verify(spark, d):
    """A store without every third document, in which every fifth body has changed."""
    docs = table(spark, d, "documents").select("doc_id", F.encode(F.concat_ws(" ", "doc_id", "text"), "UTF-8").alias("body"))
    store = content.cas_put(None, docs.where("doc_id % 3 <> 0"), "body")
    changed = F.regexp_extract(F.col("body").cast("string"), r"^(\d+)", 1).cast("long") % 5 == 0
    store = store.withColumn("body", F.when(changed, F.encode(F.reverse(F.col("body").cast("string")), "UTF-8")).otherwise(F.col("body")))
    return content.cas_get(store, docs.select(content.cas_uri(content.sha256(F.col("body"))).alias("uri")), 40000)


@query("best_alternative", f"""WITH t AS (SELECT page_id, {sql_text('html')} AS t, {sql_squeeze('html')} AS raw FROM pages), s AS (SELECT *, page_id % 2 = 0 AND {sql_state('t')} = 'OK' AND length(t) >= 50 AS usable, {sql_state('raw')} = 'OK' AND length(raw) >= 50 AS raw_ok FROM t)
  SELECT page_id, CASE WHEN NOT usable AND page_id % 5 <> 0 AND page_id % 3 = 0 AND raw_ok THEN 'https://www.alt.example/' || page_id END AS alternative FROM s""")
def best_alternative(spark, d):
    """Odd pages show nothing, every fifth was fetched with a login; of a third the www form is in the store."""
    k = F.col("page_id")
    rows = pages(spark, d).select("page_id", F.concat(F.lit("https://alt.example/"), k.cast("string")).alias("url"), "html")
    text = F.when(k % 2 == 0, html.clean_text(F.col("html"))).otherwise("")
    judged = rows.withColumn("t", text).select("page_id", "url", q.accepted(q.page_state(F.col("t")), q.completeness(F.col("t"))).alias("usable"), policy.shareable(F.col("url"), k % 5 == 0, F.lit(True)).alias("shareable"))
    cands = rows.select("page_id", F.posexplode(u.variant_list(F.col("url"))).alias("ord", "candidate")).where("ord > 0")
    raw = q.squeeze(F.col("html"))
    known = rows.where("page_id % 3 = 0").select(F.concat(F.lit("https://www.alt.example/"), k.cast("string")).alias("normalized"), q.accepted(q.page_state(raw), q.completeness(raw)).alias("raw_ok"))
    return content.best_alternative(judged, cands, known).select("page_id", "alternative")
