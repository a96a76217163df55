"""Joins, aggregates and windows over run tables: artifacts, attempts, outcomes, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.operators.shared import accumulated, numbered


def artifact_source(artifacts: DataFrame, resources: DataFrame, order: str) -> DataFrame:
    """Each artifact with the latest resource of its ``resource_id``.

    The latest resource per id is a partial aggregate before the join.
    """
    columns = [c for c in resources.columns if c != "resource_id"]
    last = resources.groupBy("resource_id").agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return artifacts.join(last, "resource_id").select(*artifacts.columns, "_r.*")


def acquired_only(artifacts: DataFrame, attempts: DataFrame, capabilities: tuple[str, ...], key: str = "artifact_id") -> DataFrame:
    """Artifacts that a succeeded attempt of one of the capabilities lists."""
    got = attempts.where((F.col("status") == "SUCCEEDED") & F.col("capability_id").isin(*capabilities)).select(F.explode("artifact_ids").alias(key))
    return artifacts.join(got, key, "left_semi")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def run_trace(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with their events in order; runs without events stay."""
    return runs.join(events, "run_id", "left").orderBy("run_id", "sequence")


def coverage_report(df: DataFrame, group: str, status: str, available: tuple[str, ...]) -> DataFrame:
    """Per group: total, available, gaps, closed and counts by status, from a partial aggregate by (group, status).

    The missing keys themselves are rows: ``coverage_gaps``.
    """
    ok = F.coalesce(F.col(status).isin(*available), F.lit(False))
    per = df.groupBy(group, status).agg(F.count("*").alias("n"))
    gaps = F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0))
    return per.groupBy(group).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("available"),
        gaps.alias("gaps"),
        (gaps == 0).alias("closed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(status, F.lit("")), "n")))).alias("by_status"),
    )


def coverage_gaps(df: DataFrame, group: str, key: str, status: str, available: tuple[str, ...]) -> DataFrame:
    """The keys that are not available, a row each, with their group and status."""
    return df.where(~F.coalesce(F.col(status).isin(*available), F.lit(False))).select(group, key, status)


def category_counts(df: DataFrame, category: str) -> DataFrame:
    """Rows per category and, under a null category, of all."""
    return df.rollup(category).agg(F.count("*").alias("n"))


def budget_remaining(runs: DataFrame, attempts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """What each run has left of its limits, not below 0 (deadline: 0.001).

    ``attempts`` has a map ``consumed_budget`` (such as deadline, redirects, bytes,
    decompressed_bytes); of the limit ``attempts`` every row uses one.
    """
    spent = lambda k: F.count("*").cast("double") if k == "attempts" else F.sum(F.coalesce(F.try_element_at("consumed_budget", F.lit(k)), F.lit(0.0)))
    used = attempts.groupBy("run_id").agg(*[spent(k).alias(f"_{k}") for k in limits])
    left = [F.greatest(F.lit(0.001 if k == "deadline" else 0.0), F.lit(float(v)) - F.coalesce(F.col(f"_{k}"), F.lit(0.0))).alias(k) for k, v in limits.items()]
    return runs.select("run_id").join(used, "run_id", "left").select("run_id", *left)


#: What stopped a run that has nothing accepted, the first that holds.
STOPPED = (("policy", "BLOCKED_BY_POLICY"), ("auth", "AUTH_REQUIRED"), ("not_found", "NOT_FOUND"), ("budget", "BUDGET_EXHAUSTED"))


def run_status(attempts: DataFrame) -> DataFrame:
    """Status of each run from flags of its attempts (all boolean columns).

    Something accepted is a success, in part if anything went wrong besides. Without
    it the first cause of ``STOPPED`` is the status; artifacts that were not accepted
    are of low quality, or a partial result if a step failed or was missing.
    """
    flags = ("accepted", "failed", "policy", "auth", "not_found", "budget", "artifacts", "dependency")
    has = attempts.groupBy("run_id").agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])
    hurt = F.col("failed") | F.col("dependency")
    full, low = (F.when(c, "PARTIAL").otherwise(name) for c, name in ((hurt | F.col("budget") | F.col("auth"), "SUCCEEDED"), (hurt, "LOW_QUALITY")))
    stopped = F.coalesce(*[F.when(F.col(f), name) for f, name in STOPPED])
    rest = F.when(F.col("artifacts"), low).when(F.col("dependency"), "DEPENDENCY_MISSING").otherwise("FAILED")
    return has.select("run_id", F.when(F.col("accepted"), full).otherwise(F.coalesce(stopped, rest)).alias("status"))


def dependency_rows(needed: DataFrame, installed: DataFrame) -> DataFrame:
    """Attempts that fail because the reader of a capability is not there: ``capability_id, status, failure_code, warning``.

    ``needed``: ``capability_id, feature, extra``; ``installed``: ``extra``. The job goes on.
    """
    gone = needed.join(installed.select("extra").distinct(), "extra", "left_anti")
    warning = F.concat(F.lit("install the extra "), "extra", F.lit(" to enable "), "feature")
    return gone.select("capability_id", F.lit("FAILED").alias("status"), F.lit("dependency_missing").alias("failure_code"), warning.alias("warning"))


def crawl_counters(candidates: DataFrame) -> DataFrame:
    """Links by relation, and those blocked by site or depth."""
    kinds = ("next", "pagination", "related", "category", "internal", "sitemap", "search", "variants")
    return candidates.agg(*[F.count_if(F.col("relation") == k).alias(k) for k in kinds], F.count_if("domain_blocked").alias("domain_blocked"), F.count_if("depth_blocked").alias("depth_blocked"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def token_truncate(text: Column, tokens: Column | int) -> Column:
    """The beginning of a text that a budget of tokens pays for, four code points each; none for a budget below 1."""
    n = F.greatest(F.lit(0), (tokens if isinstance(tokens, Column) else F.lit(tokens)).cast("long") * 4)
    return F.left(text, F.least(n, F.lit((1 << 31) - 1)).cast("int"))


def key_conflicts(df: DataFrame, key: str, aliases: str) -> DataFrame:
    """Ids and aliases that are used twice: ``value, problem``."""
    ids = df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))
    names = df.select(F.explode(aliases).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    twice = [x.where("n > 1").select("value", F.lit(p).alias("problem")) for x, p in ((ids, "duplicate id"), (names, "duplicate alias"))]
    both = ids.select("value").intersect(names.select("value")).withColumn("problem", F.lit("alias is an id"))
    return twice[0].union(twice[1]).union(both)


def latest_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last non-null ``value`` per key, as a partial aggregate."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def budget_cutoff(df: DataFrame, keys: list[str], order: list[str], cost: str, limit: float) -> DataFrame:
    """Add ``used`` before each row and ``runs``: true while it is below ``limit``. No key is one task."""
    spent = accumulated(df, keys, [F.col(c) for c in order], {"used": F.coalesce(F.col(cost), F.lit(0))}, before=True)
    return spent.withColumn("runs", F.col("used") < limit)


def context_pack(sources: DataFrame, keys: list[str], cost: str, score: str, order: str, limit: int) -> DataFrame:
    """The best-scored rows of each key whose costs fit ``limit``; ties by ``order``. No key is one task."""
    return accumulated(sources, keys, [F.desc(score), F.col(order)], {"total": F.col(cost)}).where(F.col("total") <= limit)


def score_order(df: DataFrame, keys: list[str], score: str, order: str, out: str = "place") -> DataFrame:
    """Add the place from 1 of each row of a key, the best score first; ties by ``order``. No key is one task."""
    return numbered(df, keys, [F.desc(score), F.col(order)], out).withColumn(out, F.col(out) + 1)


def first_seen(df: DataFrame, value: str, key: str) -> DataFrame:
    """The smallest ``key`` of each distinct ``value``, one row per value; only digests of the values are grouped.

    The values themselves are fetched for the first rows, by key and digest, so a key that
    several values share gives no more rows. A null value is a value; its smallest key
    counts like any other, and null keys only where a value has no other.
    """
    rows = df.select(value, key, F.sha2(value, 256).alias("_digest"))
    lead = rows.groupBy(F.col("_digest").alias("_d")).agg(F.min(key).alias("_k"))
    first = rows.join(lead, F.col("_digest").eqNullSafe(F.col("_d")) & F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    return first.dropDuplicates(["_digest"]).select(value, key)


def text_budget_use(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Estimated tokens of all texts of a key."""
    return df.groupBy(*keys).agg(F.sum(token_estimate(F.col(text))).alias("tokens"))


def seed_union(*lists: DataFrame, host: str | None = None, most: int | None = None) -> DataFrame:
    """Seeds ``url, ord, place`` of several lists of ``url``; the first place that names an URL wins.

    ``ord`` is the list and ``place`` the place in it: its column ``place``, or the order of
    its rows where it has none. With ``host`` only URLs of that site stay, with ``most`` the
    first min(20, most) by list and place.
    """
    placed = [x.select("url", F.lit(i).alias("ord"), F.col("place").cast("long").alias("place") if "place" in x.columns else F.monotonically_increasing_id().alias("place")) for i, x in enumerate(lists)]
    rows = placed[0]
    for more in placed[1:]:
        rows = rows.unionByName(more)
    if host is not None:
        rows = rows.where(urls.site_host(F.col("url")) == host)
    rows = rows.groupBy("url").agg(F.min(F.struct("ord", "place")).alias("_at")).select("url", "_at.*")
    return rows if most is None else rows.orderBy("ord", "place", "url").limit(min(20, most))


def requested_intersection(requested: Column, known: Column) -> Column:
    """What is both asked for and known, sorted."""
    return F.array_sort(F.array_intersect(requested, known))


def two_way_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys that only one side has: ``key, side``."""
    sides = left.select(key, F.lit(1).alias("_s")).union(right.select(key, F.lit(2)))
    found = sides.groupBy(key).agg(F.min("_s").alias("low"), F.max("_s").alias("high")).where("low = high")
    return found.select(key, F.when(F.col("low") == 1, "only_left").otherwise("only_right").alias("side"))


def merge_sources(*sources: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Union of sources; of rows with equal keys the best score stays, the first on ties.

    A row without a score stays only where no row of its keys has one.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(score).isNull().alias("none"), (-F.col(score)).alias("low"), F.col(order))).alias("_b"))
    return best.select(*keys, "_b.*")


def record_cap(array: Column, n: int) -> tuple[Column, Column]:
    """First n elements and the number left out."""
    return F.slice(array, 1, n), F.greatest(F.lit(0), F.size(array) - n)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key in both tables, as a partial aggregate."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


#: Words that are no query terms.
IGNORED = ("about", "from", "have", "into", "that", "the", "this", "what", "when", "where", "which", "with")


def query_terms(question: Column) -> Column:
    """Identifier-like words of three letters or more, in order."""
    found = F.regexp_extract_all(question, F.lit("([A-Za-z_][A-Za-z0-9_-]{2,})"), F.lit(1))
    return F.filter(found, lambda w: ~F.lower(w).isin(*IGNORED))


def budget_split(asked: Column) -> Column:
    """Parts of a token budget: total, first, second, rest."""
    total = F.least(F.coalesce(F.when(asked > 0, asked), F.lit(4000)), F.lit(8000))
    a = F.least(F.lit(1200), total)
    b = F.least(F.lit(1200), total - a)
    return F.struct(total.alias("total"), a.alias("first"), b.alias("second"), (total - a - b).alias("rest"))


def exact_search(docs: DataFrame, terms: list[str], *, lines: int = 12, score: float = 0.7) -> DataFrame:
    """First ``lines`` lines (by document and line) that hold one of up to 8 terms: ``doc_id, line, locator, excerpt, score``."""
    pattern = "(?i)" + "|".join(rf"\Q{t}\E" for t in terms[:8])
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "excerpt")).where(F.col("excerpt").rlike(pattern))
    top = rows.orderBy("doc_id", "line").limit(lines)
    return top.select("doc_id", "line", F.concat_ws(":", "doc_id", F.col("line") + 1).alias("locator"), "excerpt", F.lit(score).alias("score"))


def scored_search(sources: DataFrame, question: str) -> DataFrame:
    """Rows of ``sources`` (``locator, excerpt, score``) whose excerpt holds the question, whatever the case."""
    return sources.where(F.contains(F.lower("excerpt"), F.lit(question.lower())))


def context_bundle(docs: DataFrame, question: str, budget: int, *, sources: DataFrame | None = None) -> DataFrame:
    """What answers a question within a budget: ``locator, excerpt, cost, confidence, fallback_reason``.

    Scored sources that match come first, by score; if none does, they are searched
    again for the first six query terms. Exact matches in the documents follow, by
    document and line; of rows alike in locator and excerpt the first stays. The longest
    beginning that fits is returned.
    """
    plain = docs.sparkSession.range(1).select(query_terms(F.lit(question)).alias("t")).first()["t"]  # the question's own words
    reason, rows = None, exact_search(docs, plain).select(F.lit(1).alias("_kind"), (-F.col("score")).alias("_low"), "doc_id", "line", "locator", "excerpt", "score")
    if sources is not None:
        found = scored_search(sources, question)
        simple = " ".join(plain[:6])
        if simple and simple != question and found.isEmpty():
            found, reason = scored_search(sources, simple), "simplified query after retrieval miss"
        none = [F.lit(0).cast(dict(rows.dtypes)[c]).alias(c) for c in ("doc_id", "line")]
        rows = found.select(F.lit(0).alias("_kind"), (-F.col("score")).alias("_low"), *none, "locator", "excerpt", "score").unionByName(rows)
    order = ["_kind", "_low", "doc_id", "line", "locator"]
    rows = rows.groupBy("locator", "excerpt").agg(F.min(F.struct(*[F.col(c).alias(f"o{c}") for c in order[:4]])).alias("x")).select("locator", "excerpt", "x.*")
    rows = rows.withColumn("cost", token_estimate(F.col("excerpt")))
    packed = accumulated(rows, [], [F.col(f"o{c}") for c in order[:4]] + [F.col("locator"), F.col("excerpt")], {"total": F.col("cost")}).where(F.col("total") <= budget)
    n = packed.agg(F.least(F.lit(1.0), F.count("*") * 0.35).alias("confidence"))
    return packed.crossJoin(F.broadcast(n)).select("locator", "excerpt", "cost", "confidence", F.lit(reason).cast("string").alias("fallback_reason"))
