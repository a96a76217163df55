"""Content-addressed storage, duplicates, snapshots and per-page outcome rows."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
import itertools
import re
import uuid
from urllib.parse import urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pagelake.functions import html, quality, urls
from pagelake.operators.batches import BatchTable
from pagelake.operators.shared import join_counted, slices, written


#: Fixed values.
HTML_TYPES = ("text/html", "application/xhtml+xml")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def cas_uri(digest: Column) -> Column:
    return F.concat(F.lit("cas://sha256/"), digest)


def page_scan(pages: DataFrame) -> DataFrame:
    """Snapshot rows: media type, digest, size and the quality of the markup itself.

    ``media_type`` and ``status`` are the snapshot's, where it has them.
    """
    kind = F.coalesce(F.col("media_type"), F.lit("text/html")) if "media_type" in pages.columns else F.lit("text/html")
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    raw = quality.with_quality(pages, F.col("html"))
    return raw.select(
        "page_id", "url", status.cast("int").alias("status"), kind.alias("media_type"), sha256(F.encode("html", "UTF-8")).alias("sha256"), F.octet_length("html").cast("long").alias("size"),
        F.col("page_state").alias("raw_state"), F.col("score").alias("raw_score"),
    )


def cas_put(store: DataFrame | None, content: DataFrame, body: str) -> DataFrame:
    """Rows to append to a store: ``sha256, prefix, size, body`` of contents it lacks, each once.

    The digest is computed first and only it is compared; equal contents meet in a
    partial aggregate, so copies are dropped before the shuffle.
    """
    rows = content.select(sha256(F.col(body)).alias("sha256"), F.col(body).alias("body"))
    new = rows.groupBy("sha256").agg(F.first("body").alias("body"))
    if store is not None:
        new = new.join(store.select("sha256"), "sha256", "left_anti")
    prefix = F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2))
    return new.select("sha256", prefix.alias("prefix"), F.octet_length("body").cast("long").alias("size"), "body")


def content_store(spark: SparkSession, path: str) -> BatchTable:
    """A store of contents: ``sha256, prefix, size, body``."""
    return BatchTable(spark, path, "sha256 string, prefix string, size long, body binary")


def cas_append(store_path: str, content: DataFrame, body: str, batch: str | None = None) -> None:
    """Append new contents to a store, once per ``batch``; only shards with digests like theirs are read.

    Bodies are bytes or texts, which are stored in UTF-8.
    """
    store, batch = content_store(content.sparkSession, store_path), batch or uuid.uuid4().hex
    if any(m["batch"] == batch for m in store.manifests()):
        return
    digests = content.select(sha256(F.col(body)).alias("sha256"))
    new = cas_put(store.read(store.touched(digests, "sha256")), content, body)
    store.append(batch, new.withColumn("body", F.col("body").cast("binary")), "sha256")


def cas_get(store: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Contents by URI with a check of size and digest: ``uri, size, error``."""
    digest = F.regexp_extract("uri", "^cas://sha256/([0-9a-f]{64})$", 1)
    found = wanted.withColumn("sha256", digest).join(store.select("sha256", "size", "body"), "sha256", "left")
    error = F.when(F.col("body").isNull(), "not_found").when(F.col("size") > limit, "too_large").when(sha256(F.col("body")) != F.col("sha256"), "digest_mismatch")
    return found.select("uri", "size", error.alias("error"))


def first_with_digest(df: DataFrame, digest: str, order: str, key: str) -> DataFrame:
    """Add ``duplicate_of``: the first row of the same digest, null for that row.

    The first key per digest is a partial aggregate; no group is gathered, and a
    digest that many rows share is broadcast. Rows without a digest are no duplicates.
    """
    lead = df.groupBy(digest).agg(F.min_by(key, order).alias("_lead"), F.count("*").alias("_n"))
    copy = F.when((F.col("_lead") != F.col(key)) & F.col(digest).isNotNull(), F.col("_lead"))
    return join_counted(df, lead, digest, "_n", df.count()).withColumn("duplicate_of", copy).drop("_lead", "_n")


#: Detector and the state it reports.
DETECTORS = (
    ("paywall_detection", "PAYWALL"), ("captcha_detection", "CAPTCHA"), ("bot_block_detection", "BOT_BLOCK"), ("login_wall_detection", "LOGIN"),
    ("empty_page_detection", "EMPTY"), ("error_page_detection", "ERROR"), ("wrong_language_detection", "WRONG_LANGUAGE"),
)


def detector_outcomes(df: DataFrame, *keys: str) -> DataFrame:
    """Nine outcome rows per assessment (needs ``page_state`` and ``duplicate_of``)."""
    seen = lambda c: F.when(c, "OBSERVED").otherwise("NOT_APPLICABLE")
    rows = [(n, seen(F.col("page_state") == s)) for n, s in DETECTORS]
    rows += [("duplicate_detection", seen(F.col("duplicate_of").isNotNull())), ("content_quality_validation", F.lit("APPLIED"))]
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("capability_id"), s.alias("status")) for n, s in rows])).alias("o")).select(*keys, "o.*")


def response_outcomes(log: DataFrame, *keys: str) -> DataFrame:
    """Outcome rows of a fetch log: ``url, http_version, transfer_encoding, redirect_statuses, media_type`` and
    ``navigation`` (see ``page_navigation``).

    HTML gives five more: its raw form and where the page says that it leads.
    """
    navigation = (("meta_refresh_redirect", "refresh"), ("javascript_redirect", "script"), ("canonical_redirect", "canonical"), ("opengraph_url_redirect", "opengraph"))
    is_html = F.col("media_type").isin(*HTML_TYPES)
    yes = lambda c, word="OBSERVED": F.when(c, word).otherwise("NOT_APPLICABLE")
    version = F.regexp_replace(F.upper("http_version"), "HTTP/", "")
    rows = [
        ("connectivity_check", F.lit("APPLIED")), ("tls_certificate_check", yes(urls.scheme(F.col("url")) == "https", "APPLIED")),
        ("content_type_probe", F.lit("OBSERVED")), ("file_size_probe", F.lit("OBSERVED")), ("streaming_response", F.lit("APPLIED")),
        ("chunked_response", yes(F.contains(F.lower(F.coalesce("transfer_encoding", F.lit(""))), F.lit("chunked")))),
        *((n, yes(version == v)) for n, v in (("http_1_1", "1.1"), ("http_2", "2"), ("http_3", "3"))),
        *((f"redirect_{s}", yes(F.array_contains("redirect_statuses", s))) for s in (301, 302, 303, 307, 308)),
        ("redirect_chain", yes(F.size("redirect_statuses") > 0)), ("redirect_loop_detection", F.lit("APPLIED")), ("source_hash_comparison", F.lit("OBSERVED")),
    ]
    pages = [("raw_html", F.lit("APPLIED")), *((n, yes(F.coalesce(F.col(f"navigation.{f}"), F.lit("")) != "")) for n, f in navigation)]
    listed = [F.array(*[F.struct(F.lit(n).alias("capability_id"), s.alias("status")) for n, s in x]) for x in (rows, pages)]
    all_ = F.when(is_html, F.concat(*listed)).otherwise(listed[0])
    return log.select(*keys, F.explode(all_).alias("o")).select(*keys, "o.*")


def failure_class(status: Column, challenge: Column) -> Column:
    """Class of a response by status and the challenge header."""
    bearer = challenge.rlike(r"(?i)^\s*bearer(\s|$)")
    expired = challenge.rlike(r"(?i)\berror\s*=\s*\"?(invalid_token|expired_token)\"?") | (challenge.rlike(r"(?i)\berror_description\s*=") & challenge.rlike(r"(?i)\b(expired|expiration)\b"))
    return (
        F.when(status.isin(404, 410), "not_found")
        .when((status == 401) & F.coalesce(bearer & expired, F.lit(False)), "auth_expired")
        .when(status.isin(401, 403), "auth_required")
        .when(status >= 400, "failed")
        .otherwise("ok")
    )


def snapshot_changes(before: DataFrame, after: DataFrame, url: str, digest: str) -> DataFrame:
    """Full outer comparison by normalised URL, one row each: new, changed, same or gone.

    Of several URLs of one form in a snapshot the smallest digest counts; a page without a
    digest is there all the same. URLs that are not accepted have no form and are left out.
    """

    def pages(x: DataFrame, name: str) -> DataFrame:
        rows = x.select(urls.normalize(F.col(url)).alias("normalized"), F.col(digest).alias("_d")).where("normalized IS NOT NULL")
        return rows.groupBy("normalized").agg(F.struct(F.min("_d").alias("digest")).alias(name))

    both = pages(before, "_before").join(pages(after, "_after"), "normalized", "full")
    same = F.col("_before.digest").eqNullSafe(F.col("_after.digest"))
    kind = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select("normalized", kind.alias("change"))


#: Keeps digests of references apart from all other digests.
SCOPE_DOMAIN = "pagelake-authentication-scope-v1"


def authentication_scope(reference: Column) -> Column:
    """``public``, or a digest of the reference, so that caches are apart and the reference is not stored.

    A blank reference is an input error.
    """
    digest = F.sha2(F.concat(F.lit(SCOPE_DOMAIN), F.chr(F.lit(0)), reference), 256)
    blank = F.raise_error(F.lit("authentication reference cannot be blank"))
    return F.when(reference.isNull(), "public").when(F.trim(reference) == "", blank.cast("string")).otherwise(F.concat(F.lit("auth:sha256:"), digest))


def cache_key(*, url: Column, representation: Column, policy_profile: Column, parser_version: Column, authentication_ref: Column | None = None, language: Column | None = None, vary: Column | None = None) -> Column:
    """Digest of the seven parts as sorted compact JSON; ``vary`` is an array of (name, value) arrays."""
    scope = authentication_scope(F.lit(None).cast("string") if authentication_ref is None else authentication_ref)
    parts = {
        "url": url, "representation": representation, "authentication_scope": scope, "policy_profile": policy_profile, "parser_version": parser_version,
        "language": F.lit("") if language is None else F.coalesce(language, F.lit("")), "vary": F.array().cast("array<array<string>>") if vary is None else vary,
    }
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def fresh(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Records that have not expired at a given time; those without an expiry stay fresh."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > as_of))


def raw_html(df: DataFrame, body: str, media_type: str) -> DataFrame:
    """Bodies as they are, other media too, with ``is_html``."""
    return df.withColumn("is_html", F.coalesce(F.col(media_type).isin(*HTML_TYPES), F.lit(False)))


class _Links(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links = base, []
        self.seen: dict[str, str] = {}
        self.script = False

    def handle_starttag(self, tag, attrs):
        values = {k.lower(): v or "" for k, v in attrs}
        rel, css = set(values.get("rel", "").lower().split()), set(values.get("class", "").lower().split())
        if tag == "script":
            self.script = True
        if tag in ("a", "link") and values.get("href"):
            kinds = (("next", "next" in rel), ("pagination", rel & {"prev", "previous"} or "pagination" in css), ("related", "related" in rel | css), ("category", (rel | css) & {"tag", "category"}))
            kind = next((k for k, hit in kinds if hit), "internal")
            target = absolute(self.base, values["href"].strip())
            if target and urlsplit(target).scheme in ("http", "https"):
                self.links.append((target, kind))
        if tag == "link" and "canonical" in rel:
            self.note("canonical", values.get("href"))
        if tag == "meta" and values.get("property", "").lower() == "og:url":
            self.note("opengraph", values.get("content"))
        if tag == "meta" and values.get("http-equiv", "").lower() == "refresh":
            found = re.search(r"(?i)(?:^|;)\s*url\s*=\s*['\"]?([^'\";]+)", values.get("content", ""))
            self.note("refresh", found and found.group(1).strip())

    def handle_endtag(self, tag):
        self.script = self.script and tag != "script"

    def handle_data(self, data):
        found = self.script and re.search(r"(?i)(?:window\.)?location(?:\.href)?\s*=\s*['\"]([^'\"]+)['\"]", data)
        if found:
            self.note("script", found.group(1))

    def note(self, name, target):
        joined = absolute(self.base, target.strip()) if target else None
        if joined:
            self.seen.setdefault(name, joined)


def absolute(base: str, link: str) -> str | None:
    """A link joined to its page; null if that is no URL."""
    try:
        joined = urljoin(base, link)
        urlsplit(joined)
        return joined
    except ValueError:
        return None


def _parsed(base, markup) -> _Links:
    parser = _Links(base or "")
    parser.feed(markup or "")
    return parser


@F.pandas_udf(T.StringType())
def join_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """``absolute`` as a column function."""
    return pd.Series([None if x is None else absolute(b or "", x) for b, x in zip(base, link)], dtype=object)


_LINK = pa.struct([("url", pa.string()), ("relation", pa.string())])


@F.arrow_udf(T.ArrayType(T.StructType().add("url", "string").add("relation", "string")))
def page_links(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Links of a page in order, absolute, with their relation."""
    for base, markup in batches:
        for part in slices(pa.RecordBatch.from_arrays([base, markup], ["base", "markup"]), "markup"):
            found = [_parsed(b, m).links for b, m in zip(*(c.to_pylist() for c in part.columns))]
            flat, ends = [x for links in found for x in links], itertools.accumulate(map(len, found), initial=0)
            links = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], fields=list(_LINK))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), links)


@F.pandas_udf(T.StructType().add("canonical", "string").add("opengraph", "string").add("refresh", "string").add("script", "string"))
def page_navigation(base: pd.Series, markup: pd.Series) -> pd.DataFrame:
    """Where a page says that it lives or leads; observed, never followed."""
    seen = [_parsed(b, m).seen for b, m in zip(base, markup)]
    return pd.DataFrame({k: pd.Series([x.get(k) for x in seen], dtype=object) for k in ("canonical", "opengraph", "refresh", "script")})


def sitemap_locs(df: DataFrame, url: str, body: str, *keys: str) -> DataFrame:
    """Accepted locations of a sitemap text, joined to the URL of its page and normalised, in order."""
    found = df.select(*keys, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(body), F.lit(html.LOC), F.lit(1))).alias("pos", "_loc"))
    relative = ~F.lower(F.trim("_loc")).rlike("^https?://")
    joined = F.when(relative, join_link(F.when(relative, F.col("_base")), F.when(relative, F.trim("_loc")))).otherwise(F.trim("_loc"))
    return found.withColumn("_loc", joined).select(*keys, "pos", urls.normalize(F.col("_loc")).alias("loc")).where("loc IS NOT NULL")


def first_accepted(df: DataFrame, readers: dict[str, Column], *keys: str) -> DataFrame:
    """First reader whose text is accepted, and the text; both null where none is.

    A reader runs for the rows that no reader before it has settled. Its texts are
    written, so neither it nor the ones before run again.
    """
    rest, settled = df, None
    for i, (name, text) in enumerate(readers.items()):
        made = rest.withColumn("_text", text).withColumn("_state", quality.page_state(F.col("_text")))
        made = written(made.withColumn("_ok", quality.accepted(F.col("_state"), quality.completeness(F.col("_text")))), f"reader-{i}")
        done = made.where("_ok").select(*keys, F.lit(name).alias("reader"), F.col("_text").alias("text"))
        settled = done if settled is None else settled.unionByName(done)
        rest = made.where("NOT _ok").drop("_text", "_state", "_ok")
    none = F.lit(None).cast("string")
    return settled.unionByName(rest.select(*keys, none.alias("reader"), none.alias("text")))


def best_alternative(pages: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """For each page in need of one the first candidate (``page_id, ord, candidate``) whose stored markup is accepted.

    ``pages``: ``page_id, url, usable`` (its visible text is accepted), ``shareable``. Usable
    pages and those that may not be sent elsewhere get none, and no page itself.
    ``known``: ``normalized, raw_ok``. A shuffle by URL joins them; the winner per
    page is an aggregate.
    """
    needy = pages.where("NOT usable AND shareable").select("page_id", F.col("url").alias("_own"))
    asked = candidates.join(needy, "page_id").where("candidate <> _own")
    hits = asked.join(known.where("raw_ok"), F.col("candidate") == F.col("normalized")).groupBy("page_id").agg(F.min_by("candidate", "ord").alias("alternative"))
    return pages.join(hits, "page_id", "left")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, as a partial aggregate; rows without ``order`` count only where a key has no other."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    last = df.groupBy(*keys).agg(F.max_by(rest, F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))).alias("_l"))
    return last.select(*keys, "_l.*").select(*df.columns)
