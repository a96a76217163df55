"""Destination rules, robots, pacing and request gates over tables."""

from __future__ import annotations

from urllib import parse, robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from pagelake.functions import addresses as addresses_, urls
from pagelake.operators.shared import earlier_parts, join_split, on_parts, ranged, written

#: Fixed values.
LOCAL_HOSTS = ("localhost", "localhost.localdomain", "metadata.google.internal")
PORTS = ("80", "443")
SAFE_METHODS = ("GET", "HEAD", "OPTIONS")
METHODS = ("GET", "HEAD", "OPTIONS", "POST", "PUT", "PATCH", "DELETE")


def destination_policy(df: DataFrame, url: str, *, previous: str | None = None, allow_http: bool = True, denied: DataFrame | None = None) -> DataFrame:
    """Add ``normalized, policy_id, allowed, reason``; the first failing rule counts.

    ``denied`` has a column ``host``; it is joined, not collected.
    """
    df = df.withColumn("normalized", urls.normalize(F.col(url)))
    listed = F.lit(False)
    if denied is not None:
        df = df.join(denied.select(F.col("host").alias("_denied")).distinct(), urls.host(F.col("normalized")) == F.col("_denied"), "left")
        listed = F.col("_denied").isNotNull()
    at, name = F.col("normalized"), urls.host(F.col("normalized"))
    number = F.when(urls.port(at) != "", urls.port(at)).when(urls.scheme(at) == "https", "443").otherwise("80")
    checks = [
        (urls.problem(F.col(url)).isNotNull() | at.isNull(), "url_validation", F.coalesce(urls.problem(F.col(url)), F.lit("invalid host"))),
        (urls.downgrades(F.col(previous), at) if previous else F.lit(False), "redirect_security", F.lit("HTTPS downgrade redirects are forbidden")),
        ((urls.scheme(at) == "http") & F.lit(not allow_http), "url_validation", F.lit("public HTTP is disabled by the selected policy")),
        (name.isin(*LOCAL_HOSTS) | F.endswith(name, F.lit(".localhost")), "ssrf_private_ip_check", F.lit("local and metadata hostnames are blocked")),
        (listed, "malware_phishing_check", F.lit("destination is present in the configured malware/phishing deny-list")),
        (~number.isin(*PORTS), "ssrf_private_ip_check", F.concat(F.lit("destination port "), number, F.lit(" is not allowed"))),
    ]
    first = F.coalesce(*[F.when(bad, F.struct(F.lit(p).alias("policy_id"), r.alias("reason"))) for bad, p, r in checks])
    out = df.withColumn("_first", first)
    return out.withColumns({"policy_id": F.coalesce("_first.policy_id", F.lit("url_validation")), "allowed": F.col("_first").isNull(), "reason": F.coalesce("_first.reason", F.lit("valid HTTP(S) target"))}).drop("_first", "_denied")


def address_policy(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per host: ``allowed`` if it has addresses and all are public, and the reason."""
    seen = addresses.groupBy("host").agg(F.bool_and(addresses_.is_public(F.col("address"))).alias("public"))
    reason = F.when(F.col("public").isNull(), "hostname did not resolve").when(~F.col("public"), "destination resolved to a non-public address").otherwise("all resolved addresses are public")
    return hosts.join(seen, "host", "left").select(*hosts.columns, F.coalesce("public", F.lit(False)).alias("allowed"), reason.alias("reason"))


#: The four decisions of an accepted target.
ACCEPTED = (
    ("url_validation", "valid HTTP(S) target"),
    ("dns_resolution_check", "hostname resolved"),
    ("ssrf_private_ip_check", "all resolved addresses are public"),
    ("malware_phishing_check", "destination is not in the configured threat deny-list"),
)


def decision_rows(df: DataFrame, url: str, *keys: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy_id"), F.lit(True).alias("allowed"), F.lit(r).alias("reason")) for p, r in ACCEPTED]))
    return df.select(*keys, urls.sanitize(F.col(url)).alias("destination"), rows.alias("d")).select(*keys, "d.*", "destination")


_RULES = T.ArrayType(T.StructType().add("path", "string").add("allowed", "boolean"))


def _robots_rules(agent: str):
    @F.pandas_udf(_RULES)
    def rules(body: pd.Series) -> pd.Series:
        """The rules of a robots text that hold for the agent, in order; null if all is disallowed."""

        def one(text: str) -> list[dict] | None:
            parser = robotparser.RobotFileParser()
            parser.parse(text.splitlines())
            entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
            return [{"path": line.path, "allowed": line.allowance} for line in entry.rulelines] if entry else []

        return body.map(one, na_action="ignore")

    return rules


@F.pandas_udf(T.StringType())
def _robots_path(url: pd.Series) -> pd.Series:
    """What robots rules are compared with: path, parameters and query, quoted alike."""

    def one(x: str) -> str:
        parts = parse.urlparse(parse.unquote(x))
        return parse.quote(parse.urlunparse(("", "", parts.path, parts.params, parts.query, parts.fragment))) or "/"

    return url.map(one, na_action="ignore")


def robots_filter(targets: DataFrame, robots: DataFrame, *, url: str = "url", agent: str = "*", order: str | None = None, normal: bool = False) -> DataFrame:
    """Add ``robots_allowed``: the first rule of the origin that fits decides; no rule or another status allows.

    Each robots text is parsed once to a table of rules by origin. The rules reach
    the URLs by a join that deals the URLs of large sites over tasks, with a copy of the
    rules for each, so no site is one task and no list of rules is broadcast.
    Of several answers of an origin the last by ``order`` counts, without it the
    greatest (status, body). ``normal``: the URLs are in normal form.
    """
    by = F.struct(F.col(order).alias("_by"), "status", "body") if order else F.struct("status", "body")
    robots = robots.groupBy("origin").agg(F.max(by).alias("_r")).select("origin", "_r.status", "_r.body")
    rules = robots.where("status = 200").select(F.col("origin").alias("_origin"), _robots_rules(agent)("body").alias("_rules"))
    rows = written(targets.withColumns({"_origin": F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0) if normal else urls.origin(F.col(url)), "_path": _robots_path(F.col(url))}), "robots").withColumn("_origin", F.coalesce("_origin", F.lit("")))
    sizes = rows.groupBy("_origin").agg(F.count("*").alias("_n"))
    joined = join_split(rows, sizes.join(rules, "_origin", "left"), "_origin", "_n", rows.count())
    fits = F.filter("_rules", lambda r: (r["path"] == "*") | F.startswith(F.col("_path"), r["path"]))
    return joined.withColumn("robots_allowed", F.coalesce(F.get(fits, 0)["allowed"], F.lit(True))).drop("_origin", "_path", "_rules", "_n")


def shareable(url: Column, authenticated: Column, public: Column) -> Column:
    """May be sent to an outside service."""
    return public & ~authenticated & (urls.sanitize(url) == url)


def mutation_verdict(method: Column, operation: Column, approved: Column) -> Column:
    """allowed, blocked or error for a request."""
    m = F.upper(method)
    return F.when(~m.isin(*METHODS), "error").when((~m.isin(*SAFE_METHODS) | (operation == "mutation")) & ~approved, "blocked").otherwise("allowed")


def permitted(capability: Column, allow: Column, deny: Column, always: tuple[str, ...] = ()) -> Column:
    """Deny wins; a non-empty allow list restricts all but ``always``.

    An id that is both allowed and denied is an input error, which ends the job.
    """
    free = capability.isin(*always) if always else F.lit(False)
    both = F.array_intersect(allow, deny)
    bad = F.raise_error(F.concat(F.lit("both allowed and denied: "), F.array_join(both, ", "))).cast("boolean")
    return F.when(F.size(both) > 0, bad).otherwise(~F.array_contains(deny, capability) & ((F.size(allow) == 0) | F.array_contains(allow, capability) | free))


def host_pacing(df: DataFrame, *, host: str, at_ms: str, key: str, interval_ms: int) -> DataFrame:
    """Add ``slot_ms``, the earliest start with ``interval_ms`` between starts on a host.

    slot k = k * interval + max over j <= k of (t_j - j * interval). Places and the
    running maximum are made per range partition, so a host is not one task; one row
    per partition and host joins them.
    """
    rows = ranged(df, [host], [F.col(at_ms), F.col(key)]).withColumn("_late", F.col(at_ms) - F.col("_k") * interval_ms)
    before = earlier_parts([host])
    parts = rows.groupBy(host, "_part").agg(F.count("*").alias("_n"), F.max("_late").alias("_m"))
    parts = parts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.withColumn("_most", F.max(F.col("_m") - F.col("_first") * interval_ms).over(before)).select(host, "_part", "_first", "_most")
    here = F.max("_late").over(Window.partitionBy(host, "_part").orderBy("_k"))
    rows = on_parts(rows.withColumn("_here", here), parts, [host])
    best = F.greatest(F.col("_here") - F.col("_first") * interval_ms, F.col("_most"))
    return rows.select(*df.columns, ((F.col("_first") + F.col("_k")) * interval_ms + best).alias("slot_ms"))
