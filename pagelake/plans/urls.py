"""Queries over URLs: parsing, cleaning, variants, policy."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from pagelake.functions import addresses
from pagelake.functions import urls as u
from pagelake.operators import policy, rules
from pagelake.plans.registry import query, table

#: The split of ``functions.urls`` in DuckDB, over pages.
PARTS = rf"""
p AS (
  SELECT page_id, url, lower(regexp_extract(trim(url), '{u.SPLIT}', 1)) AS s, regexp_extract(trim(url), '{u.SPLIT}', 2) AS n,
         regexp_extract(trim(url), '{u.SPLIT}', 3) AS path, regexp_extract(trim(url), '{u.SPLIT}', 4) AS q
  FROM pages),
h AS (
  SELECT *, lower(regexp_replace(regexp_replace(n, '^.*@', ''), ':[0-9]*$', '')) AS host, regexp_extract(n, ':([0-9]+)$', 1) AS port FROM p),
u AS (
  SELECT *, s || '://' || regexp_replace(host, '\.+$', '')
         || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END
         || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS norm
  FROM h)"""


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def _query(expr: str) -> str:
    """A '?' and what the expression gives, or nothing."""
    return f"CASE WHEN {expr} = '' THEN '' ELSE '?' || {expr} END"


#: Hosts with other letters, odd ports and empty users, by page.
_ODD_HOSTS = ("Bücher.Example.:0080", "@Straße.example", "faß.example:443", "x.example:8080", "例え.example:")
_ODD = "[" + ", ".join(["'xn--bcher-kva.example'", "'strasse.example'", "'fass.example'", "'x.example'", "'xn--r8jz45g.example'"]) + "][page_id % 5 + 1]"
_ODD_PORT = "CASE page_id % 5 WHEN 0 THEN CASE WHEN s = 'http' THEN '' ELSE ':80' END WHEN 2 THEN CASE WHEN s = 'https' THEN '' ELSE ':443' END WHEN 3 THEN ':8080' ELSE '' END"


@query("url_normalize", f"WITH {PARTS} SELECT page_id, CASE WHEN page_id % 4 = 0 THEN s || '://' || {_ODD} || {_ODD_PORT} || CASE WHEN path = '' THEN '/' ELSE path END || {_query('q')} ELSE norm END AS normalized FROM u")
def url_normalize(spark, d):
    """Every fourth URL gets a host with other letters, an empty user or an odd way to write a port."""
    odd = F.element_at(F.array(*map(F.lit, _ODD_HOSTS)), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.regexp_extract("url", "^([a-zA-Z]+://)", 1), odd, F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*(.*)$", 1))).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", u.normalize(url).alias("normalized"))


_BAD_HOSTS = {5: ("a.example:abc", "Port could not be cast to integer value as ''abc''"), 6: ("a.example:99999", "Port out of range 0-65535"), 7: ("u:p@a.example", "credentials in URLs are forbidden; use authentication_ref"), 8: ("a..example", "label empty or too long")}


@query("url_validate", f"""WITH {PARTS} SELECT page_id, reason IS NULL AS valid, reason FROM (SELECT page_id,
  CASE WHEN page_id % 4 = 0 THEN 'only http and https URL targets are accepted' WHEN page_id % 3 = 0 THEN 'target must include a hostname' {' '.join(f"WHEN page_id % 10 = {k} THEN '{x}'" for k, (_, x) in _BAD_HOSTS.items())} END AS reason FROM u)""")
def url_validate(spark, d):
    """Every fourth URL gets another scheme, every third loses its host, others get a bad one."""
    k, host = F.col("page_id"), F.lit(None).cast("string")
    for n, (bad, _) in _BAD_HOSTS.items():
        host = F.when(F.col("page_id") % 10 == n, bad).otherwise(host)
    host = F.when(k % 3 == 0, "").otherwise(host)
    url = F.when(host.isNotNull(), F.concat(F.regexp_extract("url", "^([a-zA-Z]+://)", 1), host, F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*(.*)$", 1))).otherwise(F.col("url"))
    url = F.when(k % 4 == 0, F.regexp_replace(url, "^[a-z]+:", "ftp:")).otherwise(url)
    return pages(spark, d).select("page_id", u.problem(url).isNull().alias("valid"), u.problem(url).alias("reason"))


_KEPT = "list_filter(string_split(q, '&'), lambda x: contains(x, '=') AND regexp_extract(x, '^[^=]*=(.*)$', 1) <> '')"
_HIDDEN = "regexp_extract(x, '^([^=]*)', 1) || '=%5BREDACTED%5D'"
_SENSITIVE = ", ".join(f"'{k}'" for k in u.SENSITIVE_KEYS)
_PORT = "CASE WHEN port = '' THEN '' ELSE ':' || port END"


@query("url_sanitize", f"""WITH {PARTS}, c AS (SELECT *, array_to_string(list_transform({_KEPT}, lambda x: CASE WHEN lower(regexp_extract(x, '^([^=]*)', 1)) IN ({_SENSITIVE}) THEN {_HIDDEN} ELSE x END), '&') AS k FROM (SELECT page_id, s, host, port, path, CASE WHEN q = '' THEN '' ELSE q || '&' END || 'token=abc&page=2&empty=' AS q FROM h))
  SELECT page_id, s || '://' || host || {_PORT} || path || {_query('k')} AS sanitized FROM c""")
def url_sanitize(spark, d):
    """Each URL gets a secret, a plain and an empty parameter."""
    bare = F.regexp_replace("url", "#.*$", "")
    url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("token=abc&page=2&empty="))
    return pages(spark, d).select("page_id", u.sanitize(url).alias("sanitized"))


@query("url_redact_all", f"""WITH {PARTS}, c AS (SELECT *, array_to_string(list_transform({_KEPT}, lambda x: {_HIDDEN}), '&') AS k FROM h)
  SELECT page_id, s || '://' || host || {_PORT} || path || {_query('k')} AS sanitized FROM c""")
def url_redact_all(spark, d):
    return pages(spark, d).select("page_id", u.sanitize(F.col("url"), all_values=True).alias("sanitized"))


@query("text_url_redact", f"""WITH {PARTS}, c AS (SELECT *, array_to_string(list_transform({_KEPT}, lambda x: {_HIDDEN}), '&') AS k FROM h), x AS (SELECT page_id, s || '://' || host || {_PORT} || path || {_query('k')} AS x FROM c)
  SELECT page_id, p.html || ' see (' || x || '), ' || x || '; or ' || x || '. ' || p.html AS clean FROM pages p JOIN x USING (page_id)""")
def text_url_redact(spark, d):
    """Each page's URL, three times between its markup, which has links without a host."""
    text = F.concat("html", F.lit(" see ("), "url", F.lit("), "), "url", F.lit("; or "), "url", F.lit(". "), "html")
    return table(spark, d, "pages").select("page_id", u.sanitize_text(text).alias("clean"))


@query("url_origin", f"WITH {PARTS} SELECT page_id, s || '://' || host || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END AS origin FROM u")
def url_origin(spark, d):
    return pages(spark, d).select("page_id", u.origin(F.col("url")).alias("origin"))


@query("site_host", f"WITH {PARTS} SELECT page_id, regexp_replace(host, '^www\\.', '') AS site_host FROM u")
def site_host(spark, d):
    return pages(spark, d).select("page_id", u.site_host(F.col("url")).alias("site_host"))


_TRACK = ", ".join(f"'{k}'" for k in u.TRACKING_KEYS)
_CLEAN = f"array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ({_TRACK}) AND NOT starts_with(lower(x), 'utm_')), '&')"


@query("url_clean_query", f"WITH {PARTS}, c AS (SELECT *, {_CLEAN} AS k FROM h) SELECT page_id, s || '://' || n || path || {_query('k')} AS cleaned FROM c")
def url_clean_query(spark, d):
    return pages(spark, d).select("page_id", u.clean_query(F.col("url")).alias("cleaned"))


_Q = _query("q")
_V = f"""WITH {PARTS}, c AS (
  SELECT page_id, s, host, norm, n, q, {_CLEAN} AS k, CASE WHEN path = '' THEN '/' ELSE path END AS path, regexp_replace(path, '/+$', '') AS short,
         regexp_replace(host, '^www\\.', '') AS bare, {_PORT} AS colon
  FROM (SELECT * REPLACE (regexp_replace(host, '\\.+$', '') AS host, CASE WHEN (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE port END AS port) FROM u)),
v AS (
  SELECT page_id, s, norm, unnest([
    {{'ord': 1, 'variant': 'http_to_https', 'candidate': CASE WHEN s = 'http' THEN 'https://' || host || colon || path || {_Q} END}},
    {{'ord': 2, 'variant': 'https_to_http', 'candidate': NULL}},
    {{'ord': 3, 'variant': 'www_to_non_www', 'candidate': CASE WHEN starts_with(host, 'www.') THEN s || '://' || bare || colon || path || {_Q} END}},
    {{'ord': 4, 'variant': 'non_www_to_www', 'candidate': CASE WHEN NOT starts_with(host, 'www.') THEN s || '://www.' || host || colon || path || {_Q} END}},
    {{'ord': 5, 'variant': 'trailing_slash', 'candidate': CASE WHEN NOT path LIKE '%/' THEN s || '://' || host || colon || path || '/' || {_Q} END}},
    {{'ord': 6, 'variant': 'remove_trailing_slash', 'candidate': CASE WHEN path LIKE '%/' AND path <> '/' THEN s || '://' || host || colon || CASE WHEN short = '' THEN '/' ELSE short END || {_Q} END}},
    {{'ord': 7, 'variant': 'clean_query_parameters', 'candidate': CASE WHEN k <> q THEN s || '://' || host || colon || path || {_query('k')} END}},
    {{'ord': 8, 'variant': 'canonical_url_variant', 'candidate': 'https://canonical.example/' || page_id}},
    {{'ord': 9, 'variant': 'mobile_variant', 'candidate': CASE WHEN NOT starts_with(host, 'm.') THEN s || '://m.' || bare || colon || path || {_Q} END}},
    {{'ord': 10, 'variant': 'amp_variant', 'candidate': CASE WHEN NOT short LIKE '%/amp' THEN s || '://' || host || colon || short || '/amp' || {_Q} END}},
    {{'ord': 11, 'variant': 'print_variant', 'candidate': s || '://' || host || colon || path || '?' || CASE WHEN q = '' THEN '' ELSE q || '&' END || 'output=1'}},
    {{'ord': 12, 'variant': 'language_variant', 'candidate': s || '://' || host || colon || '/en' || path || {_Q}}},
    {{'ord': 13, 'variant': 'region_variant', 'candidate': s || '://' || host || colon || path || '?' || CASE WHEN q = '' THEN '' ELSE q || '&' END || 'region=AU'}}], recursive := true)
  FROM c)"""


def _hints() -> dict:
    return {"language": F.lit("EN"), "region": F.lit("AU"), "canonical": F.concat(F.lit("https://Canonical.example:443/"), F.col("page_id").cast("string"))}


@query("url_variants", f"{_V} SELECT page_id, variant, candidate FROM v")
def url_variants(spark, d):
    rows = pages(spark, d).withColumn("url", u.normalize(F.col("url")))
    return rows.select("page_id", F.explode(u.variants(F.col("url"), **_hints())).alias("v")).select("page_id", "v.*")


@query("variant_outcomes", f"{_V} SELECT page_id, variant AS capability_id, CASE WHEN variant = 'https_to_http' THEN 'BLOCKED' WHEN candidate IS NOT NULL THEN 'OBSERVED' ELSE 'NOT_APPLICABLE' END AS status FROM v UNION ALL SELECT page_id, 'candidate_url_expansion', 'APPLIED' FROM c")
def variant_outcomes(spark, d):
    rows = pages(spark, d).withColumn("url", u.normalize(F.col("url")))
    return rows.select("page_id", F.explode(u.variant_outcomes(u.variants(F.col("url"), **_hints()))).alias("o")).select("page_id", "o.*")


@query("url_variant_list", f"{_V}, l AS (SELECT page_id, 0 AS ord, norm AS url FROM c UNION ALL SELECT page_id, ord, candidate FROM v WHERE candidate IS NOT NULL), f AS (SELECT page_id, url, min(ord) AS ord FROM l GROUP BY page_id, url) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord)::INTEGER AS place, url FROM f")
def url_variant_list(spark, d):
    rows = pages(spark, d).withColumn("url", u.normalize(F.col("url")))
    found = rows.select("page_id", F.posexplode(u.variant_list(F.col("url"), **_hints())).alias("place", "url"))
    return found.withColumn("place", F.col("place") + 1)


@query("downgrade_guard", f"WITH {PARTS} SELECT page_id, s = 'https' AND page_id % 2 = 0 AS downgrade FROM u")
def downgrade_guard(spark, d):
    target = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?", "http")).otherwise(F.col("url"))
    return pages(spark, d).select("page_id", u.downgrades(F.col("url"), target).alias("downgrade"))


_ENDS = [".pdf", ".mp4", ".zip", ".json", ".html", ""]


def _with_suffix():
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS) + 1).cast("int"))
    return F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/file"), end)


@query("target_family", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'document' WHEN page_id % 7 = 0 AND page_id % 6 NOT IN (0, 1) THEN 'archive' ELSE ['document', 'media', 'archive', 'api', 'web', 'web'][page_id % 6 + 1] END AS family FROM pages")
def target_family(spark, d):
    wanted = F.when(F.col("page_id") % 5 == 0, F.array(F.lit("tables"))).when(F.col("page_id") % 7 == 0, F.array(F.lit("archive"))).otherwise(F.array().cast("array<string>"))
    return pages(spark, d).select("page_id", u.family(_with_suffix(), wanted).alias("family"))


@query("suffix_handler", "SELECT page_id, ['pdf', NULL, NULL, 'json_endpoint', NULL, NULL][page_id % 6 + 1] AS handler FROM pages")
def suffix_handler(spark, d):
    return pages(spark, d).select("page_id", u.handler(_with_suffix()).alias("handler"))


@query("named_api_detect", "SELECT page_id, ['github_api', NULL, 'arxiv_api', 'crossref_openalex_api', NULL][page_id % 5 + 1] AS api FROM pages")
def named_api_detect(spark, d):
    """The pages' own paths and queries under the address of an API, or under one like it."""
    bases = ["https://api.github.com", "https://api.github.com.attacker.example", "http://export.arxiv.org/api/query", "https://api.crossref.org/works", "http://api.crossref.org/works"]
    url = F.concat(F.element_at(F.array(*map(F.lit, bases)), (F.col("page_id") % 5 + 1).cast("int")), u.path(F.col("url")), F.lit("?"), u.query(F.col("url")))
    return pages(spark, d).select("page_id", u.named_api(url).alias("api"))


@query("rule_lookups", f"""WITH {PARTS}, bad AS (SELECT DISTINCT host FROM u WHERE contains(url, 'utm_source')), x AS (SELECT *, host IN (SELECT host FROM bad) AS listed FROM u)
  SELECT page_id, CASE WHEN page_id % 3 = 0 AND s = 'https' THEN 'github_api' END AS api, listed FROM x""")
def rule_lookups(spark, d):
    """Route table and deny list as lookups of every page; every third path is asked of a known host, and hosts with tracked links are listed."""
    rows = pages(spark, d).withColumn("host", u.host(F.col("url")))
    listed = rows.where(F.contains("url", F.lit("utm_source"))).select("host").distinct().withColumn("listed", F.lit(True))
    asked = F.when(F.col("page_id") % 3 == 0, F.concat(u.scheme(F.col("url")), F.lit("://api.github.com"), u.path(F.col("url")))).otherwise(F.col("url"))
    return rows.join(listed, "host", "left").select("page_id", u.named_api(asked).alias("api"), F.coalesce("listed", F.lit(False)).alias("listed"))


@query("destination_policy", f"""WITH {PARTS}
  SELECT page_id, CASE k WHEN 0 THEN 'ssrf_private_ip_check' WHEN 1 THEN 'malware_phishing_check' WHEN 2 THEN 'ssrf_private_ip_check' WHEN 3 THEN 'url_validation' ELSE 'url_validation' END AS policy_id, k > 3 AS allowed,
         CASE k WHEN 0 THEN 'local and metadata hostnames are blocked' WHEN 1 THEN 'destination is present in the configured malware/phishing deny-list' WHEN 2 THEN 'destination port 8080 is not allowed' WHEN 3 THEN 'credentials in URLs are forbidden; use authentication_ref' ELSE 'valid HTTP(S) target' END AS reason
  FROM (SELECT page_id, page_id % 6 AS k FROM u)""")
def destination_policy(spark, d):
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.lit("http://localhost/x")).when(k == 1, F.lit("https://bad.example/")).when(k == 2, F.lit("https://good.example:8080/")).when(k == 3, F.lit("https://me:pw@good.example/")).otherwise(F.col("url"))
    rows = pages(spark, d).withColumn("target", url)
    denied = rows.where(k == 1).select(F.lit("bad.example").alias("host"))
    return policy.destination_policy(rows, "target", denied=denied).select("page_id", "policy_id", "allowed", "reason")


_V4 = r"regexp_extract_all(text, '[0-9]+(?:\.[0-9]+){3}')"
_IN_4 = " OR ".join(f"a BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in map(ipaddress.ip_network, (*addresses.PRIVATE_4, *addresses.SHARED_4, *addresses.MULTICAST_4)))


@query("address_policy", rf"""WITH found AS (SELECT doc_id AS host, unnest({_V4}) AS t FROM documents), p AS (SELECT host, list_transform(string_split(t, '.'), lambda x: try_cast(x AS BIGINT)) AS o, t FROM found),
  n AS (SELECT host, CASE WHEN regexp_matches(t, '^{addresses.IPV4}$') THEN ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] END AS a FROM p),
  hosts AS (SELECT host, bool_and(a IS NOT NULL AND NOT ({_IN_4})) AS ok FROM n GROUP BY host)
  SELECT doc_id AS host, coalesce(ok, false) AS allowed, CASE WHEN ok IS NULL THEN 'hostname did not resolve' WHEN ok THEN 'all resolved addresses are public' ELSE 'destination resolved to a non-public address' END AS reason FROM documents LEFT JOIN hosts ON doc_id = host""")
def address_policy(spark, d):
    """Documents as hosts, with the addresses in their texts."""
    docs = table(spark, d, "documents")
    found = docs.select(F.col("doc_id").alias("host"), F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+){3}"), F.lit(0))).alias("address"))
    return policy.address_policy(docs.select(F.col("doc_id").alias("host")), found)


@query("address_blocks", rf"""WITH found AS (SELECT doc_id, unnest({_V4}) AS t FROM documents), p AS (SELECT *, list_transform(string_split(t, '.'), lambda x: try_cast(x AS BIGINT)) AS o FROM found WHERE regexp_matches(t, '^{addresses.IPV4}$'))
  SELECT DISTINCT doc_id, t AS address, CASE WHEN o[1] % 7 = 0 AND o[2] % 2 = 0 THEN o[1] || '.' || o[2] || '.0.0/16' WHEN o[1] % 7 = 0 OR o[1] % 5 = 0 THEN o[1] || '.0.0.0/8' END AS block FROM p""")
def address_blocks(spark, d):
    """Addresses in texts, with the longest of the networks that list them: of some first bytes all, of others every second /16 too."""
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[0-9]+(?:\.[0-9]+){{3}}"), F.lit(0))).alias("address")).distinct().where(F.col("address").rlike(f"^{addresses.IPV4}$"))
    byte = spark.range(256).select(F.col("id").alias("x"))
    wide = byte.where("x % 7 = 0 OR x % 5 = 0").select(F.format_string("%d.0.0.0/8", "x").alias("block"))
    narrow = byte.where("x % 7 = 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(254), F.lit(2)))).select(F.format_string("%d.%d.0.0/16", "x", "y").alias("block"))
    return addresses.listed_in(found, wide.union(narrow))


@query("decision_rows", f"""WITH {PARTS} SELECT page_id, policy_id, true AS allowed, s || '://' || host || {_PORT} || path AS destination
  FROM h, (VALUES ('url_validation'), ('dns_resolution_check'), ('ssrf_private_ip_check'), ('malware_phishing_check')) v(policy_id)""")
def decision_rows(spark, d):
    rows = pages(spark, d).withColumn("url", F.regexp_replace("url", "[?#].*$", ""))
    return policy.decision_rows(rows, "url", "page_id").select("page_id", "policy_id", "allowed", "destination")


@query("robots_filter", f"WITH {PARTS} SELECT page_id, NOT (page_id % 2 = 0 AND page_id % 6 <> 4) AS robots_allowed FROM u")
def robots_filter(spark, d):
    """Every origin allows all but /private, and there only /private/open; other pages keep their path."""
    path = F.when(F.col("page_id") % 6 == 4, "/private/open/ü?x=1").when(F.col("page_id") % 2 == 0, "/private/x").otherwise(u.path(F.col("url")))
    rows = pages(spark, d).withColumn("url", F.concat(u.origin(F.col("url")), path))
    robots = rows.select(u.origin(F.col("url")).alias("origin")).distinct().select("origin", F.lit(200).alias("status"), F.lit("User-agent: *\nAllow: /private/open\nDisallow: /private\n").alias("body"))
    return policy.robots_filter(rows, robots).select("page_id", "robots_allowed")


@query("sharing_filter", f"WITH {PARTS} SELECT page_id FROM u WHERE page_id % 2 <> 0 AND page_id % 3 <> 0 AND NOT contains(url, '#')")
def sharing_filter(spark, d):
    """Pages that an outside service may be sent: not those behind a login, with a secret in their URL, or with an URL that cleaning changes."""
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.when(F.contains("url", F.lit("?")), "&token=1").otherwise("?token=1")).otherwise(""))
    return pages(spark, d).where(policy.shareable(url, F.col("page_id") % 2 == 0, F.lit(True))).select("page_id")


@query("mutation_gate", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'allowed' ELSE 'blocked' END WHEN 2 THEN 'error' ELSE CASE WHEN event_id % 3 = 0 THEN 'allowed' ELSE 'blocked' END END AS verdict FROM events""")
def mutation_gate(spark, d):
    k = F.col("event_id") % 4
    method = F.element_at(F.array(*map(F.lit, ["GET", "post", "BREW", "GET"])), (k + 1).cast("int"))
    kind = F.when(k == 3, "mutation").otherwise("query")
    return table(spark, d, "events").select("event_id", policy.mutation_verdict(method, kind, F.col("event_id") % 3 == 0).alias("verdict"))


@query("allow_deny_filter", "SELECT event_id FROM events WHERE event_type <> 'purchase' AND (user_id % 2 = 0 OR event_type IN ('click', 'view', 'signup'))")
def allow_deny_filter(spark, d):
    """Purchases are denied; odd users allow clicks and views; signing up is always allowed."""
    allow = F.when(F.col("user_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("click"), F.lit("view")))
    return table(spark, d, "events").where(policy.permitted(F.col("event_type"), allow, F.array(F.lit("purchase")), ("signup",))).select("event_id")


_PACED = """WITH RECURSIVE e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, t AS slot_ms FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, greatest(e.t, r.slot_ms + 60000) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, slot_ms FROM r"""


@query("host_pacing", _PACED)
def host_pacing(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return policy.host_pacing(rows, host="user_id", at_ms="t", key="event_id", interval_ms=60000).select("event_id", "user_id", "slot_ms")


_RULES = """all_rules AS (SELECT 'site:' || host AS rule, host, '/' AS prefix, s = 'http' AS http FROM u WHERE contains(url, 'utm_source')
  UNION SELECT 'part:' || path, host, regexp_extract(path, '^/[^/]*', 0), s = 'http' FROM u WHERE q <> '' AND path LIKE '/%'
  UNION SELECT 'page:' || path, host, regexp_replace(path, '/$', ''), s = 'http' FROM u WHERE path LIKE '/%/'),
rules AS (SELECT rule, host, prefix, bool_or(http) AS http FROM all_rules GROUP BY ALL)"""


def _page_rules(spark, d):
    """Rules from the pages: sites with tracked links, sections with asked pages, and folders; rules of plain HTTP pages hold for it too."""
    rows = pages(spark, d).select("url", u.host(F.col("url")).alias("host"), u.path(F.col("url")).alias("path"), u.query(F.col("url")).alias("q"), (u.scheme(F.col("url")) == "http").alias("http"))
    site = rows.where(F.contains("url", F.lit("utm_source"))).select(F.concat(F.lit("site:"), "host").alias("rule"), "host", F.lit("/").alias("prefix"), "http")
    part = rows.where("q <> '' AND path LIKE '/%'").select(F.concat(F.lit("part:"), "path").alias("rule"), "host", F.regexp_extract("path", "^/[^/]*", 0).alias("prefix"), "http")
    page = rows.where("path LIKE '/%/'").select(F.concat(F.lit("page:"), "path").alias("rule"), "host", F.regexp_replace("path", "/$", "").alias("prefix"), "http")
    return site.union(part).union(page).groupBy("rule", "host", "prefix").agg(F.bool_or("http").alias("http"))


@query("rule_table", f"""WITH {PARTS}, {_RULES}, fit AS (SELECT page_id, rule, prefix, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN prefix = '/' THEN 0 ELSE length(prefix) END DESC, rule) AS k
    FROM u JOIN rules r ON r.host = u.host AND (prefix = '/' OR path = prefix OR starts_with(path, prefix || '/')) AND (s = 'https' OR r.http) WHERE port = '')
  SELECT pages.page_id, rule, prefix AS rule_prefix FROM pages LEFT JOIN fit ON pages.page_id = fit.page_id AND k = 1""")
def rule_table(spark, d):
    """Every page with the longest rule that fits it, of a table that grows with the pages."""
    return rules.match_rules(pages(spark, d), _page_rules(spark, d)).select("page_id", "rule", "rule_prefix")
