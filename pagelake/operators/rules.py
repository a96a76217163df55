"""Tables of rules by host and path prefix, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.operators.shared import join_split, written

#: A rule table up to so many bytes and path depths goes to every task; a larger one is shuffled.
HELD_BYTES, HELD_DEPTHS = 8 << 20, 12


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/")))


def _index(rules: DataFrame, order: str | None) -> DataFrame:
    """``_key, _d, _r``: the first rule of each scheme, host and prefix, under that text, with the slashes of the prefix."""
    place = F.when(F.col("prefix") == "/", "").otherwise(F.col("prefix"))
    plain = F.coalesce(F.col("http"), F.lit(False)) if "http" in rules.columns else F.lit(False)
    schemes = F.explode(F.when(plain, F.array(F.lit("https"), F.lit("http"))).otherwise(F.array(F.lit("https"))))
    name = F.regexp_replace(F.lower("host"), r"\.+$", "")
    first = F.struct(F.col(order or "rule").alias("by"), F.col("rule").alias("rule"), F.col("prefix").alias("prefix"))
    rows = rules.where("rule IS NOT NULL AND host IS NOT NULL").select(schemes.alias("_s"), name.alias("_h"), place.alias("_p"), first.alias("_r")).where("_p = '' OR _p LIKE '/%'")
    return rows.groupBy(F.concat("_s", F.lit("://"), "_h", "_p").alias("_key"), _slashes(F.col("_p")).alias("_d")).agg(F.min("_r").alias("_r"))


def _asked(d: int | Column) -> Column:
    """The key of a URL's first ``d`` path segments, or null if it has fewer."""
    n = F.lit(d) if isinstance(d, int) else d
    return F.when(_slashes(F.col("_path")) >= n, F.concat("_base", F.substring_index("_path", "/", d + 1) if isinstance(d, int) else F.call_function("substring_index", F.col("_path"), F.lit("/"), n + 1)))


def match_rules(targets: DataFrame, rules: DataFrame, *, url: str = "url", order: str | None = None, held_bytes: int = HELD_BYTES, held_depths: int = HELD_DEPTHS) -> DataFrame:
    """Add ``rule, rule_prefix`` of the rule that fits a URL: the longest prefix, or with ``order`` the first by that column.

    ``rules``: ``rule, host, prefix``, and ``http`` if plain HTTP is fine too. A prefix fits
    whole path segments (``/a`` fits ``/a`` and ``/a/b``, not ``/ab``), ``/`` or an empty one
    the whole host. URLs with a user, or a port other than their scheme's, fit none. Of equal
    hosts and prefixes the first by ``order``, or the least name, counts; rules without a
    name or host, and prefixes that begin with another letter, fit nothing. Null and broken
    URLs, and all URLs if there are no rules, get nulls. Columns named ``rule`` or
    ``rule_prefix`` are replaced; others stay.

    A URL looks the table up once for each depth that its prefixes have, by equal keys.
    A small table goes to every task, and no row is shuffled. A larger one is shuffled: each
    distinct URL gives a key per depth, keys that are no rule leave before the join, and the
    keys of large sites are dealt over tasks. Of a very long path only the depths that
    rules have become keys.
    """
    targets = targets.drop("rule", "rule_prefix")
    kept = targets.columns
    index = written(_index(rules, order), "rules")
    size, depths = index.agg(F.sum(F.length("_key") + F.length("_r.rule") + F.length("_r.prefix") + 64), F.array_sort(F.collect_set("_d"))).first()
    at = F.when(urls.path(F.col(url)) == "", "/").otherwise(urls.path(F.col(url)))
    scheme, port = urls.scheme(F.col(url)), urls.port(F.col(url))
    usual = ((scheme == "https") & port.isin("", "443")) | ((scheme == "http") & port.isin("", "80"))
    base = F.when(usual & ~urls.has_user(F.col(url)), F.concat(scheme, F.lit("://"), F.regexp_replace(urls.host(F.col(url)), r"\.+$", "")))
    rows = targets.withColumns({"_base": base, "_path": at})
    best = (lambda found: F.array_min(found)) if order else (lambda found: F.get(found, 0))
    if (size or 0) <= held_bytes and len(depths) <= held_depths:
        for d in depths:
            some = index.where(F.col("_d") == d).select(F.col("_key").alias("_k"), F.col("_r").alias(f"_r{d}"))
            rows = rows.join(F.broadcast(some), _asked(d) == F.col("_k"), "left").drop("_k")
        found = F.array_compact(F.array(*[F.col(f"_r{d}") for d in reversed(depths)])) if depths else F.lit(None).cast("array<struct<rule:string,prefix:string>>")
        return rows.withColumn("_r", best(found)).select(*kept, F.col("_r.rule").alias("rule"), F.col("_r.prefix").alias("rule_prefix"))
    rows = written(rows.withColumn("_at", F.concat("_base", "_path")), "asked")
    sizes = written(rows.groupBy("_at", "_base", "_path").agg(F.count("*").alias("_n")), "urls")
    keys = sizes.where("_at IS NOT NULL").select("_at", "_base", "_path", F.explode(F.array(*map(F.lit, depths))).alias("_d"))
    keys = keys.select("_at", "_d", _asked(F.col("_d")).alias("_key")).where("_key IS NOT NULL")
    listed = written(keys.groupBy("_key").agg(F.count("*").alias("_m")).join(index.select("_key", "_r"), "_key"), "listed")
    total = listed.agg(F.sum("_m")).first()[0] or 0
    hits = join_split(keys, listed, "_key", "_m", total)
    last = F.min("_r") if order else F.max_by("_r", "_d")
    hits = hits.groupBy("_at").agg(last.alias("_r"))
    places = sizes.groupBy("_at").agg(F.sum("_n").alias("_n")).join(hits, "_at", "left")
    joined = join_split(rows, places, "_at", "_n", rows.count())
    return joined.select(*kept, F.col("_r.rule").alias("rule"), F.col("_r.prefix").alias("rule_prefix"))
