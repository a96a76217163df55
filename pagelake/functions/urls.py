"""URL functions as columns: one regular expression splits, the rest is string work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path, query, fragment
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

#: Fixed values.
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "auth", "code", "key", "password", "signature", "sig", "token")
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
LANGUAGE_TAG = r"^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"
URL_IN_TEXT = r"(?i)https?://[^\s<>\"']+"
VARIANTS = (
    "http_to_https", "https_to_http", "www_to_non_www", "non_www_to_www", "trailing_slash", "remove_trailing_slash", "clean_query_parameters",
    "canonical_url_variant", "mobile_variant", "amp_variant", "print_variant", "language_variant", "region_variant",
)
DOCUMENT_SUFFIXES = (".csv", ".docx", ".epub", ".pdf", ".pptx", ".txt", ".xls", ".xlsx")
MEDIA_SUFFIXES = (".aac", ".flac", ".gif", ".jpeg", ".jpg", ".m4a", ".mp3", ".mp4", ".png", ".wav", ".webm")
ARCHIVE_SUFFIXES = (".7z", ".bz2", ".gz", ".rar", ".tar", ".tgz", ".zip")
API_SUFFIXES = (".json", ".xml")
HANDLERS = {".csv": "csv", ".docx": "docx", ".epub": "dataset_file", ".pdf": "pdf", ".pptx": "pptx", ".txt": "txt", ".xls": "dataset_file", ".xlsx": "xlsx", ".xml": "xml_endpoint", ".json": "json_endpoint"}
#: capability, host, path prefix; the first match counts.
NAMED_APIS = (
    ("github_api", "api.github.com", "/"),
    ("semantic_scholar_api", "api.semanticscholar.org", "/graph/v1"),
    ("semantic_scholar_api", "api.semanticscholar.org", "/recommendations/v1"),
    ("semantic_scholar_api", "api.semanticscholar.org", "/datasets/v1"),
    ("arxiv_api", "export.arxiv.org", "/api/query"),
    ("openreview_api", "api.openreview.net", "/"),
    ("openreview_api", "api2.openreview.net", "/"),
    *(("crossref_openalex_api", "api.crossref.org", f"/{x}") for x in ("works", "journals", "members", "funders", "prefixes", "types", "licenses")),
    *(("crossref_openalex_api", "api.openalex.org", f"/{x}") for x in ("works", "authors", "sources", "institutions", "topics", "publishers", "funders", "concepts", "autocomplete", "text")),
)


def part(url: Column, group: int) -> Column:
    """Group 1 to 5 of ``SPLIT``; empty where the URL has none."""
    return F.regexp_extract(F.trim(url), SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host_port(url: Column) -> Column:
    """Authority without user information."""
    return F.regexp_replace(part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(host_port(url), r"^(\[[^\]]*\]|[^:]*)", 1))


def _port_text(url: Column) -> Column:
    """What follows the host's colon, or empty."""
    return F.regexp_extract(host_port(url), r"^(?:\[[^\]]*\]|(?:[^:\[][^:]*)?):(.*)$", 1)


def port(url: Column) -> Column:
    """Explicit port as a string without leading zeros, or empty."""
    return F.regexp_extract(_port_text(url), r"^0*(\d+)$", 1)


def has_user(url: Column) -> Column:
    """True if a user or a password is given; both may be empty."""
    return part(url, 2).rlike("@") & ~part(url, 2).rlike("^:?@[^@]*$")


@F.pandas_udf(T.StringType())
def idna_host(host: pd.Series) -> pd.Series:
    """ASCII form of a host with other letters; null where there is none."""

    def one(x: str) -> str | None:
        try:
            return x.encode("idna").decode("ascii").lower()
        except UnicodeError:
            return None

    return host.map(one, na_action="ignore")


def ascii_host(url: Column) -> Column:
    """The host in ASCII; only hosts with other letters go through Python. Null where there is no such form."""
    name = host(url)
    foreign = name.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, idna_host(F.when(foreign, name))).otherwise(name)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def build(scheme_: Column, netloc: Column, path_: Column, query_: Column) -> Column:
    return F.concat(scheme_, F.lit("://"), netloc, path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(""))


def problem(url: Column) -> Column:
    """First reason for which a URL is not accepted, or null."""
    return (
        F.when(F.coalesce(F.trim(url), F.lit("")) == "", "target cannot be empty")
        .when(~scheme(url).isin("http", "https"), "only http and https URL targets are accepted")
        .when(has_user(url), "credentials in URLs are forbidden; use authentication_ref")
        .when(host(url) == "", "target must include a hostname")
        .when(host(url).rlike(r"^\.|\.\.|[^.]{64}"), "label empty or too long")
        .when((_port_text(url) != "") & (port(url) == ""), F.concat(F.lit("Port could not be cast to integer value as '"), _port_text(url), F.lit("'")))
        .when((F.length(port(url)) > 5) | (port(url).try_cast("int") > 65535), "Port out of range 0-65535")
    )


def _shown_port(url: Column) -> Column:
    default = ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443"))
    return F.when((port(url) == "") | default, "").otherwise(F.concat(F.lit(":"), port(url)))


def normalize(url: Column) -> Column:
    """Canonical form of an accepted URL, else null; the host is in ASCII."""
    name = F.regexp_replace(ascii_host(url), r"\.+$", "")
    whole = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(problem(url).isNull(), build(scheme(url), F.concat(name, _shown_port(url)), whole, query(url)))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _key(p: Column) -> Column:
    return _decode(F.regexp_extract(p, "^([^=]*)", 1))


def _value(p: Column) -> Column:
    return _decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1))


def _pair(p: Column, value: Column | None = None) -> Column:
    return F.concat(_encode(_key(p)), F.lit("="), _encode(_value(p) if value is None else value))


def sanitize(url: Column, *, all_values: bool = False) -> Column:
    """Without user and fragment; values of sensitive keys (or all) are hidden, blank ones dropped."""
    hidden = F.lit("[REDACTED]")
    value = lambda p: hidden if all_values else F.when(F.lower(_key(p)).isin(*SENSITIVE_KEYS), hidden).otherwise(_value(p))
    kept = F.filter(F.split(query(url), "&"), lambda p: _value(p) != "")
    netloc = F.concat(host(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""))
    return build(scheme(url), netloc, path(url), F.array_join(F.transform(kept, lambda p: _pair(p, value(p))), "&"))


def sanitize_text(text: Column) -> Column:
    """Hide all query values of the URLs in a text; closing punctuation stays.

    URLs are cut out, treated and put back between the stretches around them.
    """
    found = F.regexp_extract_all(text, F.lit(f"({URL_IN_TEXT})"), F.lit(1))
    around = F.split(text, URL_IN_TEXT, -1)
    bare = lambda u: F.regexp_extract(u, r"^(.*?)([.,;)\]}]*)$", 1)
    tail = lambda u: F.regexp_extract(u, r"^(.*?)([.,;)\]}]*)$", 2)
    clean = F.transform(found, lambda u: F.concat(sanitize(bare(u), all_values=True), tail(u)))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.transform(around, lambda x, i: F.concat(x, F.coalesce(F.get(clean, i), F.lit("")))), ""))


def origin(url: Column) -> Column:
    """scheme://host[:port] without a default port; null for other schemes or with a user."""
    ok = scheme(url).isin("http", "https") & ~has_user(url) & (host(url) != "")
    return F.when(ok, F.concat(scheme(url), F.lit("://"), host(url), _shown_port(url)))


def site_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _split_query(url: Column) -> Column:
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def clean_query(url: Column) -> Column:
    """Without tracking parameters and fragment."""
    key = lambda p: F.lower(_key(p))
    kept = F.filter(_split_query(url), lambda p: ~key(p).isin(*TRACKING_KEYS) & ~F.startswith(key(p), F.lit(TRACKING_PREFIX)))
    return build(part(url, 1), part(url, 2), path(url), F.array_join(F.transform(kept, lambda p: _pair(p)), "&"))


def variants(url: Column, *, language: Column | None = None, region: Column | None = None, canonical: Column | None = None) -> Column:
    """Array of (variant, candidate) in the order of ``VARIANTS``; null where one does not apply.

    ``url`` must be normalised.
    """
    none = F.lit(None).cast("string")
    s, h, n, p, q = scheme(url), host(url), part(url, 2), path(url), query(url)
    colon = F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise("")
    bare = F.regexp_replace(h, r"^www\.", "")
    short = F.regexp_replace(p, "/+$", "")
    pairs = F.transform(_split_query(url), lambda p: _pair(p))
    with_ = lambda *extra: F.array_join(F.concat(pairs, F.array(*extra)), "&")
    clean = clean_query(url)
    lang = none if language is None else F.when(language.rlike(LANGUAGE_TAG), build(s, n, F.concat(F.lit("/"), F.lower(language), p), q))
    area = none if region is None else F.when(region != "", build(s, n, p, with_(F.concat(F.lit("region="), _encode(region)))))
    found = [
        F.when(s == "http", build(F.lit("https"), n, p, q)),
        none,
        F.when(F.startswith(h, F.lit("www.")), build(s, F.concat(bare, colon), p, q)),
        F.when(~F.startswith(h, F.lit("www.")), build(s, F.concat(F.lit("www."), h, colon), p, q)),
        F.when(~F.endswith(p, F.lit("/")), build(s, n, F.concat(p, F.lit("/")), q)),
        F.when(F.endswith(p, F.lit("/")) & (p != "/"), build(s, n, F.when(short == "", "/").otherwise(short), q)),
        F.when(clean != url, clean),
        none if canonical is None else normalize(canonical),
        F.when(~F.startswith(h, F.lit("m.")), build(s, F.concat(F.lit("m."), bare, colon), p, q)),
        F.when(~F.endswith(short, F.lit("/amp")), build(s, n, F.concat(short, F.lit("/amp")), q)),
        build(s, n, p, with_(F.lit("output=1"))),
        lang,
        area,
    ]
    safe = [F.when(~downgrades(url, c), c) for c in found]
    return F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("candidate")) for v, c in zip(VARIANTS, safe)])


def variant_outcomes(found: Column) -> Column:
    """Rows (capability_id, status) of an array of ``variants``: each kind, and the expansion itself.

    Candidates that leave HTTPS are blocked whatever the URL.
    """
    status = lambda v: F.when(v["variant"] == "https_to_http", "BLOCKED").when(v["candidate"].isNotNull(), "OBSERVED").otherwise("NOT_APPLICABLE")
    each = F.transform(found, lambda v: F.struct(v["variant"].alias("capability_id"), status(v).alias("status")))
    return F.concat(each, F.array(F.struct(F.lit("candidate_url_expansion").alias("capability_id"), F.lit("APPLIED").alias("status"))))


def variant_list(url: Column, **how: Column) -> Column:
    """The URL, then its candidates, each once."""
    return F.array_distinct(F.array_compact(F.concat(F.array(url), F.transform(variants(url, **how), lambda x: x["candidate"]))))


def downgrades(before: Column, after: Column) -> Column:
    return F.coalesce((scheme(before) == "https") & (scheme(after) == "http"), F.lit(False))


def suffix(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"[^/.](\.[^./]+)$", 1)


def handler(url: Column) -> Column:
    """Reader of a target by its suffix, or null."""
    chosen = F.lit(None).cast("string")
    for end, name in HANDLERS.items():
        chosen = F.when(suffix(url) == end, name).otherwise(chosen)
    return chosen


def named_api(url: Column) -> Column:
    """Known API of an URL, or null; rules are tried in order."""
    at = F.when(path(url) == "", "/").otherwise(path(url))
    https = (scheme(url) == "https") & port(url).isin("", "443")
    http = (scheme(url) == "http") & port(url).isin("", "80")
    found = []
    for name, where, prefix in NAMED_APIS:
        fits = F.lit(True) if prefix == "/" else (at == prefix) | F.startswith(at, F.lit(prefix + "/"))
        allowed = (https | http) if name == "arxiv_api" else https
        found.append(F.when((F.regexp_replace(host(url), r"\.+$", "") == where) & fits & allowed & ~has_user(url), name))
    return F.coalesce(*found)


def family(url: Column, outputs: Column) -> Column:
    """api, document, media, archive or web, from what is asked for and the suffix."""
    wants = lambda *x: F.arrays_overlap(outputs, F.array(*map(F.lit, x)))
    apis = ("rest", "graphql", "json_endpoint", "xml_endpoint", "rss", "atom", "sitemap_xml", "openapi_discovery", "github_api", "semantic_scholar_api", "arxiv_api", "openreview_api", "crossref_openalex_api")
    return (
        F.when(wants(*apis) | named_api(url).isNotNull(), "api")
        .when(suffix(url).isin(*DOCUMENT_SUFFIXES) | wants("document", "tables", "ocr", "slides"), "document")
        .when(suffix(url).isin(*MEDIA_SUFFIXES) | wants("audio", "frames", "image", "subtitles", "transcript", "video"), "media")
        .when(suffix(url).isin(*ARCHIVE_SUFFIXES) | wants("archive"), "archive")
        .when(suffix(url).isin(*API_SUFFIXES) | wants("json", "xml", "feed"), "api")
        .otherwise("web")
    )
