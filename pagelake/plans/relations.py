"""Queries with joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import content, runs, search
from pagelake.operators.shared import numbered
from pagelake.functions import urls
from pagelake.plans.registry import query, table
from pagelake.plans.urls import PARTS


def t(spark, d, name):
    return table(spark, d, name)


@query("artifact_source", "SELECT o_orderkey AS artifact_id, o_custkey AS resource_id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def artifact_source(spark, d):
    """Orders as artifacts of customers, of which each has an older record too."""
    arts = t(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("resource_id"))
    new = t(spark, d, "customer").select(F.col("c_custkey").alias("resource_id"), F.col("c_name").alias("name"), F.lit(2).alias("seq"))
    old = new.withColumn("name", F.lit("old")).withColumn("seq", F.lit(1))
    return runs.artifact_source(arts, new.union(old), "seq").select("artifact_id", "resource_id", "name")


@query("acquired_only", "SELECT o_orderkey AS artifact_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'N'))")
def acquired_only(spark, d):
    arts = t(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"))
    tries = t(spark, d, "lineitem").select(F.array("l_orderkey").alias("artifact_ids"), F.when(F.col("l_linestatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"), F.col("l_returnflag").alias("capability_id"))
    return runs.acquired_only(arts, tries, ("A", "N"))


@query("unseen", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)")
def unseen(spark, d):
    """Customers without a large finished order."""
    seen = t(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return runs.unseen(t(spark, d, "customer").select("c_custkey"), seen, "c_custkey")


@query("run_trace", "SELECT c_custkey AS run_id, event_id AS sequence, event_type FROM customer LEFT JOIN events ON user_id = c_custkey")
def run_trace(spark, d):
    rs = t(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return runs.run_trace(rs, t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("sequence"), "event_type"))


@query("coverage_report", """SELECT source, count(*) AS total, count_if(lang IN ('en', 'fr'))::BIGINT AS available, count_if(lang NOT IN ('en', 'fr'))::BIGINT AS gaps, count_if(lang NOT IN ('en', 'fr')) = 0 AS closed,
  string_agg(DISTINCT lang, ',' ORDER BY lang) AS statuses FROM documents GROUP BY source""")
def coverage_report(spark, d):
    """Documents by source; English and French count as available."""
    found = runs.coverage_report(t(spark, d, "documents"), "source", "lang", ("en", "fr"))
    return found.select("source", "total", "available", "gaps", "closed", F.array_join(F.map_keys("by_status"), ",").alias("statuses"))


@query("coverage_gaps", "SELECT source, doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def coverage_gaps(spark, d):
    return runs.coverage_gaps(t(spark, d, "documents"), "source", "doc_id", "lang", ("en", "fr"))


@query("category_counts", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)")
def category_counts(spark, d):
    return runs.category_counts(t(spark, d, "customer").withColumnRenamed("c_mktsegment", "category"), "category")


@query("budget_remaining", """SELECT o_orderkey AS run_id, greatest(0.001::DOUBLE, 30.0::DOUBLE - coalesce(sum(l_linenumber), 0)) AS deadline, greatest(0.0::DOUBLE, 4.0::DOUBLE - count(l_orderkey)) AS attempts,
  greatest(0.0::DOUBLE, 3.0::DOUBLE - coalesce(sum(l_linenumber % 2), 0)) AS redirects, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(sum(l_quantity), 0)) AS bytes, greatest(0.0::DOUBLE, 120.0::DOUBLE - coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0)) AS decompressed_bytes
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def budget_remaining(spark, d):
    """Orders as runs, their items as attempts; items that are not open have not been unpacked."""
    number, quantity = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    spent = F.map_concat(F.create_map(F.lit("deadline"), number, F.lit("bytes"), quantity, F.lit("redirects"), number % 2), F.when(F.col("l_linestatus") == "O", F.create_map(F.lit("decompressed_bytes"), quantity)).otherwise(F.create_map().cast("map<string,double>")))
    tries = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), spent.alias("consumed_budget"))
    return runs.budget_remaining(t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id")), tries, {"deadline": 30.0, "attempts": 4.0, "redirects": 3.0, "bytes": 100.0, "decompressed_bytes": 120.0})


#: Flags of an item as an attempt; the same conditions in SQL and in Spark.
_FLAGS = {
    "accepted": "l_returnflag = 'A' AND l_quantity > 25", "failed": "l_linestatus = 'O' AND l_linenumber > 4", "policy": "l_quantity > 49", "auth": "l_discount > 0.09", "not_found": "l_tax > 0.07",
    "budget": "l_linenumber = 6", "artifacts": "l_returnflag = 'N'", "dependency": "l_partkey % 7 = 0",
}


@query("run_status", f"""WITH f AS (SELECT l_orderkey AS run_id, {', '.join(f'bool_or({c}) AS {n}' for n, c in _FLAGS.items())} FROM lineitem GROUP BY 1)
  SELECT run_id, 'SUCCEEDED' AS status FROM f WHERE accepted AND NOT (failed OR dependency OR budget OR auth)
  UNION ALL SELECT run_id, 'PARTIAL' FROM f WHERE accepted AND (failed OR dependency OR budget OR auth)
  UNION ALL SELECT run_id, 'BLOCKED_BY_POLICY' FROM f WHERE NOT accepted AND policy
  UNION ALL SELECT run_id, 'AUTH_REQUIRED' FROM f WHERE NOT accepted AND NOT policy AND auth
  UNION ALL SELECT run_id, 'NOT_FOUND' FROM f WHERE NOT (accepted OR policy OR auth) AND not_found
  UNION ALL SELECT run_id, 'BUDGET_EXHAUSTED' FROM f WHERE NOT (accepted OR policy OR auth OR not_found) AND budget
  UNION ALL SELECT run_id, CASE WHEN failed OR dependency THEN 'PARTIAL' ELSE 'LOW_QUALITY' END FROM f WHERE NOT (accepted OR policy OR auth OR not_found OR budget) AND artifacts
  UNION ALL SELECT run_id, CASE WHEN dependency THEN 'DEPENDENCY_MISSING' ELSE 'FAILED' END FROM f WHERE NOT (accepted OR policy OR auth OR not_found OR budget OR artifacts)""")
def run_status(spark, d):
    return runs.run_status(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), *[F.expr(c).alias(n) for n, c in _FLAGS.items()]))


@query("dependency_missing", "SELECT DISTINCT event_type AS capability_id, 'FAILED' AS status, 'dependency_missing' AS failure_code, 'install the extra ' || left(event_type, 1) || ' to enable ' || event_type AS warning FROM events WHERE event_type NOT IN ('click', 'view')")
def dependency_missing(spark, d):
    """Event types as capabilities; the extras of two of them are installed."""
    needed = t(spark, d, "events").select(F.col("event_type").alias("capability_id"), F.col("event_type").alias("feature"), F.left("event_type", F.lit(1)).alias("extra")).distinct()
    return runs.dependency_rows(needed, needed.where("capability_id IN ('click', 'view')").select("extra"))


@query("crawl_counters", "SELECT count_if(k = 0)::BIGINT AS next, count_if(k = 1)::BIGINT AS pagination, count_if(k = 2)::BIGINT AS related, count_if(k = 3)::BIGINT AS category, count_if(k = 4)::BIGINT AS internal, count_if(k = 5)::BIGINT AS sitemap, count_if(k = 6)::BIGINT AS search, count_if(k = 7)::BIGINT AS variants, count_if(page_id % 2 = 0)::BIGINT AS domain_blocked, count_if(page_id % 3 = 0)::BIGINT AS depth_blocked FROM (SELECT page_id, page_id % 8 AS k FROM pages)")
def crawl_counters(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["next", "pagination", "related", "category", "internal", "sitemap", "search", "variants"])), (F.col("page_id") % 8 + 1).cast("int"))
    return runs.crawl_counters(t(spark, d, "pages").select(kind.alias("relation"), (F.col("page_id") % 2 == 0).alias("domain_blocked"), (F.col("page_id") % 3 == 0).alias("depth_blocked")))


@query("text_budget_use", "SELECT source, sum(greatest(1, (length(text) + 3) // 4))::BIGINT AS tokens FROM documents GROUP BY source")
def text_budget_use(spark, d):
    return runs.text_budget_use(t(spark, d, "documents"), ["source"], "text")


@query("alias_uniqueness", "SELECT doc_id AS value, 'duplicate id' AS problem FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'alias is an id' FROM documents WHERE doc_id >= 5 UNION ALL SELECT doc_id + 5, 'duplicate alias' FROM documents WHERE doc_id % 4 = 0")
def alias_uniqueness(spark, d):
    """Ids, every tenth twice; the id plus 5 as an alias, of every fourth in two rows."""
    ids = t(spark, d, "documents").select("doc_id")
    none, names = F.array().cast("array<bigint>"), F.array(F.col("doc_id") + 5)
    rows = ids.withColumn("aliases", names).unionByName(ids.where("doc_id % 10 = 0").withColumn("aliases", none))
    more = ids.where("doc_id % 4 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), names.alias("aliases"))
    return runs.key_conflicts(rows.unionByName(more), "doc_id", "aliases")


@query("latest_artifact", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def latest_artifact(spark, d):
    rows = t(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("user_id", "event_id")
    return content.latest(rows, ["user_id"], "event_id")


@query("latest_outcome", "SELECT user_id, arg_max(event_type, event_id) AS candidate FROM events WHERE value > 50 GROUP BY user_id")
def latest_outcome(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("candidate"))
    return runs.latest_of(rows, ["user_id"], "event_id", "candidate")


@query("first_seen", "SELECT text, min(doc_id // 3) AS batch FROM documents GROUP BY text")
def first_seen(spark, d):
    """The first batch of three documents that has each text; a batch may be the first of several texts."""
    return runs.first_seen(t(spark, d, "documents").select("text", F.floor(F.col("doc_id") / 3).alias("batch")), "text", "batch")


@query("budget_cutoff", "SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER w, 0)::DOUBLE AS used, coalesce(sum(l_quantity) OVER w, 0) < 60 AS runs FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def budget_cutoff(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = t(spark, d, "lineitem").select("l_orderkey", *order)
    return runs.budget_cutoff(rows, ["l_orderkey"], order, "l_quantity", 60).select("l_orderkey", "l_linenumber", F.col("used").cast("double").alias("used"), "runs")


@query("context_pack", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(greatest(1, (length(text) + 3) // 4)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000")
def context_pack(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", "n_chars", runs.token_estimate(F.col("text")).alias("cost"))
    return runs.context_pack(rows, ["source"], "cost", "n_chars", "doc_id", 20000).select("source", "doc_id")


@query("locator_numbering", "SELECT doc_id, 'line:' || i AS locator, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def locator_numbering(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", F.concat(F.lit("line:"), (F.col("i") + 1).cast("string")).alias("locator"), "line")


@query("event_order", "SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS place FROM events")
def event_order(spark, d):
    """All events by run and sequence, with their place in the run."""
    rows = t(spark, d, "events").select("user_id", "event_id", "event_type")
    return numbered(rows, ["user_id"], [F.col("event_id")], "place").withColumn("place", F.col("place").cast("int")).orderBy("user_id", "event_id")


@query("score_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS place FROM documents")
def score_order(spark, d):
    rows = t(spark, d, "documents").select("source", "doc_id", "n_chars")
    return runs.score_order(rows, ["source"], "n_chars", "doc_id").select("doc_id", F.col("place").cast("int").alias("place"))


@query("first_n", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS head FROM documents")
def first_n(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("head"))


@query("record_cap", "SELECT doc_id, least(10, len(string_split(text, ' ')))::INTEGER AS kept, greatest(0, len(string_split(text, ' ')) - 10)::INTEGER AS omitted FROM documents")
def record_cap(spark, d):
    kept, omitted = runs.record_cap(F.split("text", " "), 10)
    return t(spark, d, "documents").select("doc_id", F.size(kept).alias("kept"), omitted.alias("omitted"))


@query("seed_union", f"""WITH {PARTS}, lists AS (SELECT norm AS url, 0 AS ord, -page_id AS place FROM u WHERE page_id % 2 = 0 UNION ALL SELECT norm, 1, page_id FROM u)
  SELECT url, min((ord, place))[1] AS ord, min((ord, place))[2] AS place FROM lists GROUP BY url""")
def seed_union(spark, d):
    """Every other page from the last to the first, then all pages; the first list that names an URL wins."""
    p = t(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))
    first = p.where("page_id % 2 = 0").select("url", (-F.col("page_id")).alias("place"))
    return runs.seed_union(first, p.select("url", F.col("page_id").alias("place")))


@query("source_union", "SELECT text AS excerpt, max(score) AS score FROM (SELECT text, CASE WHEN doc_id % 3 > 0 THEN 0.5::DOUBLE END AS score FROM documents UNION ALL SELECT text, 0.7::DOUBLE FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def source_union(spark, d):
    """Two lists of texts, some without a score; digests of the texts are compared and shuffled."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    a, b = keyed.withColumn("score", F.when(F.col("doc_id") % 3 > 0, F.lit(0.5))), keyed.where("doc_id % 2 = 0").withColumn("score", F.lit(0.7))
    best = runs.merge_sources(a, b, keys=["digest"], score="score", order="doc_id")
    return docs.join(best, "doc_id").select(F.col("text").alias("excerpt"), "score")


@query("merge_sources", "SELECT DISTINCT source || ':' || lang AS locator, max(n_chars) OVER (PARTITION BY source, lang) AS score FROM documents")
def merge_sources(spark, d):
    rows = t(spark, d, "documents").select(F.concat_ws(":", "source", "lang").alias("locator"), F.col("n_chars").alias("score"), "doc_id")
    return runs.merge_sources(rows, keys=["locator"], score="score", order="doc_id").select("locator", "score")


@query("requested_intersection", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE '' END AS known FROM orders")
def requested_intersection(spark, d):
    known = runs.requested_intersection(F.array("o_orderstatus", "o_orderpriority"), F.array(F.lit("O"), F.lit("X")))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(known, ",").alias("known"))


@query("two_way_difference", "SELECT c_custkey AS k, 'only_left' AS side FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000) UNION ALL SELECT DISTINCT o_custkey, 'only_right' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000 AND o_custkey % 3 = 0")
def two_way_difference(spark, d):
    """Two thirds of the customers against those with a large finished order."""
    left = t(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    right = t(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(F.col("o_custkey").alias("k"))
    return runs.two_way_difference(left, right, "k")


@query("run_upsert", "SELECT user_id AS run_id, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id")
def run_upsert(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    return runs.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "run_id", "seq")


@query("query_terms", "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]{2,}'), lambda w: lower(w) NOT IN (" + ", ".join(repr(w) for w in runs.IGNORED) + ")), ' ') AS terms FROM documents")
def query_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(runs.query_terms(F.col("text")), " ").alias("terms"))


@query("token_estimate", "SELECT doc_id, greatest(1, (length(text) + 3) // 4)::BIGINT AS tokens, left(text, 40) AS head FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", runs.token_estimate(F.col("text")).alias("tokens"), F.left("text", F.lit(40)).alias("head"))


@query("token_truncate", "SELECT doc_id, left(text, greatest(0, n_chars // 6 - 3) * 4) AS head FROM documents")
def token_truncate(spark, d):
    """Every document cut to a budget of about two thirds of its tokens; the shortest get none."""
    return t(spark, d, "documents").select("doc_id", runs.token_truncate(F.col("text"), F.floor(F.col("n_chars") / 6) - 3).alias("head"))


_LINES = "SELECT doc_id, i, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE regexp_matches(line, '(?i)license|version') ORDER BY doc_id, i LIMIT 12"


@query("exact_search", f"SELECT doc_id || ':' || i AS locator, line AS excerpt, 0.7::DOUBLE AS score FROM ({_LINES})")
def exact_search(spark, d):
    return runs.exact_search(t(spark, d, "documents"), ["license", "version"]).select("locator", "excerpt", "score")


_ASKED = """WITH q AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_-]{2,}'), lambda w: lower(w) NOT IN (""" + ", ".join(repr(w) for w in runs.IGNORED) + """))[1:8] AS terms FROM benchmark),
  asked AS (SELECT DISTINCT item_id, lower(unnest(terms)) AS term FROM q),
  lines AS (SELECT doc_id, i, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
  terms AS (SELECT DISTINCT term FROM asked),
  hits AS (SELECT * FROM (SELECT term, doc_id, i, line, row_number() OVER (PARTITION BY term ORDER BY doc_id, i) AS k FROM terms JOIN lines ON contains(low, term)) WHERE k <= 12),
  found AS (SELECT DISTINCT item_id, doc_id, i, line FROM asked JOIN hits USING (term)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, i) AS place FROM found)
  SELECT item_id AS question_id, place::INTEGER AS place, doc_id || ':' || i AS locator, line AS excerpt FROM placed WHERE place <= 12"""


@query("search_questions", _ASKED)
def search_questions(spark, d):
    """The first lines of the documents for each benchmark text as a question."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return search.search_questions(t(spark, d, "documents"), asked).select("question_id", "place", "locator", "excerpt")


@query("budget_split", "SELECT o_orderkey, least(CASE WHEN k > 0 THEN k ELSE 4000 END, 8000)::INTEGER AS total, greatest(0, least(CASE WHEN k > 0 THEN k ELSE 4000 END, 8000) - 2400)::INTEGER AS rest FROM (SELECT o_orderkey, (o_orderkey % 10) * 1000 AS k FROM orders)")
def budget_split(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", runs.budget_split(((F.col("o_orderkey") % 10) * 1000).cast("int")).alias("b"))
    return rows.select("o_orderkey", "b.total", "b.rest")


@query("context_bundle", f"""WITH s AS (SELECT 'source:' || source AS locator, lang || ' license version' AS excerpt, max(n_chars) AS score FROM documents GROUP BY source, lang),
  f AS (SELECT locator, excerpt, 0 AS kind, -score::DOUBLE AS low, 0 AS doc_id, 0 AS i FROM s UNION ALL SELECT doc_id || ':' || i, line, 1, -0.7, doc_id, i FROM ({_LINES})),
  p AS (SELECT *, greatest(1, (length(excerpt) + 3) // 4)::BIGINT AS cost, sum(greatest(1, (length(excerpt) + 3) // 4)) OVER (ORDER BY kind, low, doc_id, i, locator, excerpt ROWS UNBOUNDED PRECEDING) AS total FROM f)
  SELECT locator, excerpt, cost, least(1.0::DOUBLE, count(*) OVER () * 0.35::DOUBLE) AS confidence, 'simplified query after retrieval miss' AS fallback_reason FROM p WHERE total <= 250""")
def context_bundle(spark, d):
    """Scored notes of the sources, one for each language, found only when the question is cut to its terms, then lines of the documents."""
    notes = t(spark, d, "documents").groupBy("source", "lang").agg(F.max("n_chars").cast("double").alias("score")).select(F.concat(F.lit("source:"), "source").alias("locator"), F.concat("lang", F.lit(" license version")).alias("excerpt"), "score")
    notes = notes.unionByName(notes.withColumn("score", F.col("score") - 1))  # each is found twice
    return runs.context_bundle(t(spark, d, "documents"), "what is the license version?", 250, sources=notes)
