"""Queries over the event ledger, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.operators import crawl, ledger
from pagelake.operators.shared import numbered, shared_path
from pagelake.plans.crawl import _REPORT, _crawled
from pagelake.plans.pages import sql_language, sql_squeeze, sql_state
from pagelake.plans.registry import query, table
from pagelake.streaming import events as streams


def events(spark, d):
    return table(spark, d, "events")


def _secrets(spark, d):
    """A payload per event: an id, a token, a metric and an URL with a token."""
    return events(spark, d).select("event_id", F.to_json(F.struct("event_id", F.lit("x").alias("token"), F.lit(5).alias("input_tokens"), F.concat(F.lit("https://example.com/p?token="), F.col("event_id").cast("string"), F.lit("&q=1")).alias("url"))).alias("payload"))


_CLEAN = """'{"event_id":' || event_id || ',"input_tokens":5,"token":"[REDACTED]","url":"https://example.com/p?token=%5BREDACTED%5D&q=1"}'"""


@query("payload_redact", f"SELECT event_id, {_CLEAN} AS payload FROM events")
def payload_redact(spark, d):
    return _secrets(spark, d).select("event_id", ledger.payload_redact("payload", F.lit(False)).alias("payload"))


@query("output_redact", """SELECT event_id, '{"event_id":' || event_id || ',"input_tokens":5,"token":"x","url":"https://example.com/p?token=%5BREDACTED%5D&q=' || CASE WHEN event_id % 2 = 0 THEN '%5BREDACTED%5D' ELSE '1' END || '"}' AS payload FROM events""")
def output_redact(spark, d):
    return _secrets(spark, d).select("event_id", ledger.output_redact("payload", F.col("event_id") % 2 == 0).alias("payload"))


@query("event_append", f"SELECT event_id, event_type || '-' || event_id % 10 AS seen, {_CLEAN} AS payload, (SELECT count(*) FROM events WHERE event_id % 3 = 0) + row_number() OVER (ORDER BY event_id) AS sequence FROM events WHERE event_id % 3 <> 0")
def event_append(spark, d):
    """Events come up to three times with other contents, of which the first stays; a third is in the ledger. The folder is read back."""
    rows, path = _secrets(spark, d).join(events(spark, d).select("event_id", F.concat_ws("-", "event_type", F.col("event_id") % 10).alias("seen")), "event_id"), shared_path(spark, "ledger")
    later = lambda n: rows.where(F.col("event_id") % 10 == 3 * n).withColumn("seen", F.concat("seen", F.lit("x" * n)))
    ledger.append_events(path, rows.where("event_id % 3 = 0"))
    ledger.append_events(path, later(2).union(later(1)).union(rows).union(later(3)))
    return ledger.event_ledger(spark, path, rows).read().select("event_id", "seen", "payload", "sequence").where("event_id % 3 <> 0")


@query("run_snapshot", "SELECT user_id AS run_id, arg_max(event_type, event_id) AS state, max(event_id) AS seq FROM events GROUP BY user_id")
def run_snapshot(spark, d):
    return ledger.run_snapshot(events(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("state"), F.col("event_id").alias("seq")))


def _log(spark, d):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events(spark, d).select("event_id", F.col("user_id").alias("run_id"), "event_type", before.alias("b"), F.to_json(F.struct(F.concat(F.lit("a"), (F.col("event_id") % 50).cast("string")).alias("artifact_id"))).alias("payload"))
    return rows.withColumn("parents", F.array_compact(F.array("b")))


@query("runtime_graph", """SELECT user_id::VARCHAR AS source, event_id::VARCHAR AS target, 'EMITTED' AS type FROM events
  UNION ALL SELECT b::VARCHAR, event_id::VARCHAR, 'PRECEDES' FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL
  UNION ALL SELECT event_id::VARCHAR, 'artifact_id:a' || event_id % 50, 'REFERENCES_ARTIFACT_ID' FROM events""")
def runtime_graph(spark, d):
    return ledger.runtime_graph(_log(spark, d))[1]


@query("graph_sink", """SELECT DISTINCT user_id::VARCHAR AS id, 'FetchRun' AS type FROM events UNION ALL SELECT event_id::VARCHAR, 'ProvenanceEvent' FROM events UNION ALL SELECT DISTINCT 'artifact_id:a' || event_id % 50, 'Artifact' FROM events""")
def graph_sink(spark, d):
    """The graph written as JSON, its nodes read back."""
    path = shared_path(spark, "graph")
    ledger.graph_sink(*ledger.runtime_graph(_log(spark, d)), path)
    return spark.read.schema("id string, type string").json(f"{path}/nodes")


@query("crawl_report_sink", _REPORT)
def crawl_report_sink(spark, d):
    path = shared_path(spark, "report")
    ledger.crawl_report_sink(crawl.crawl_report(_crawled(spark, d)), path)
    return spark.read.schema("root string, targets long, fetched long, failed long, max_depth int, omitted long").json(path)


@query("lineage_edges", "SELECT event_id AS child, b AS parent FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL")
def lineage_edges(spark, d):
    return ledger.lineage_edges(_log(spark, d).withColumnRenamed("event_id", "artifact_id"))


_PARENTS = """e AS (SELECT event_id, user_id, lag(event_id) OVER w AS b1, lag(event_id, 3) OVER w AS b3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  edges AS (SELECT event_id AS child, b1 AS parent FROM e WHERE b1 IS NOT NULL UNION SELECT event_id, b3 FROM e WHERE b3 IS NOT NULL AND event_id % 2 = 0 UNION SELECT -1 - user_id, event_id FROM events)"""


@query("lineage_origins", f"WITH RECURSIVE {_PARENTS}, r(artifact_id, at_, steps) AS (SELECT child, parent, 1 FROM edges UNION SELECT artifact_id, parent, steps + 1 FROM r JOIN edges ON at_ = child) SELECT artifact_id, at_ AS origin, min(steps)::BIGINT AS steps FROM r WHERE at_ NOT IN (SELECT child FROM edges) GROUP BY artifact_id, at_")
def lineage_origins(spark, d):
    """Where events go back to: each follows the one before, some the third before too, and a report per user follows all."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, d).select("event_id", "user_id", F.lag("event_id").over(w).alias("b1"), F.lag("event_id", 3).over(w).alias("b3"))
    own = e.select(F.col("event_id").alias("artifact_id"), F.array_compact(F.array("b1", F.when(F.col("event_id") % 2 == 0, F.col("b3")))).alias("parents"))
    made = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("artifact_id"), F.col("event_id").alias("seq"), F.lit("raw").alias("representation"))
    reports = e.select(F.col("user_id").alias("run_id")).distinct().select("run_id", (-1 - F.col("run_id")).alias("artifact_id"), F.lit((1 << 63) - 1).alias("seq"), F.lit("crawl_report").alias("representation"))
    return ledger.lineage_origins(ledger.lineage_edges(own).union(ledger.report_edges(made.union(reports))))


@query("eligibility", f"""SELECT o_orderkey AS capability_id, o_orderstatus <> 'F' AND o_totalprice > 100000 AS eligible,
  concat_ws('; ', CASE WHEN o_orderstatus = 'F' THEN '{ledger.DENIED}' END, CASE WHEN o_totalprice <= 100000 THEN '{ledger.UNAVAILABLE}' END, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 100000 THEN '{ledger.ELIGIBLE}' END,
  CASE WHEN o_custkey % 2 = 0 THEN 'dependencies: ' || o_orderpriority || ', c' || o_custkey END) AS reasons FROM orders""")
def eligibility(spark, d):
    needs = F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderpriority", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    rules = table(spark, d, "orders").select(F.col("o_orderkey").alias("capability_id"), (F.col("o_orderstatus") != "F").alias("allowed"), (F.col("o_totalprice") > 100000).alias("available"), needs.alias("dependencies"))
    return ledger.eligibility(rules).select("capability_id", "eligible", F.array_join("reasons", "; ").alias("reasons"))


def _folder(df, name):
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


@query("event_tail", "SELECT user_id AS run_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events e WHERE event_id <= coalesce((SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id AND event_type = 'purchase'), event_id)")
def event_tail(spark, d):
    """Users as runs that end at their first purchase; events come in any order, some twice, and leave in sequence."""
    rows = numbered(events(spark, d).select(F.col("user_id").alias("run_id"), "event_id", "event_type"), ["run_id"], [F.col("event_id")], "sequence").withColumn("sequence", F.col("sequence") + 1)
    rows = rows.union(rows.where("event_id % 10 = 0")).orderBy(F.xxhash64("event_id"))
    stream = streams.until_finished(streams.tail(spark, _folder(rows, "log"), rows.schema), "purchase")
    return streams.run_to_table(stream, "tail")


@query("idempotent_events", "SELECT event_id, user_id FROM events")
def idempotent_events(spark, d):
    rows = events(spark, d).select("event_id", "user_id")
    twice = rows.union(rows.where("event_id % 10 = 0"))
    return streams.run_to_table(streams.idempotent(streams.tail(spark, _folder(twice, "log"), twice.schema)), "once")


_STATE = "CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'FINISHED' ELSE 'OTHER' END"


@query("run_state_stream", f"""WITH s AS (SELECT user_id AS run_id, {_STATE} AS state, event_id AS seq, list_position(['QUEUED', 'RUNNING', 'FINISHED'], {_STATE}) AS rank FROM events),
  f AS (SELECT run_id, rank, any_value(state) AS state, min(seq) AS seq FROM s WHERE state <> 'OTHER' GROUP BY run_id, rank) SELECT run_id, state, seq, state = 'FINISHED' AS notify FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.run_id = f.run_id AND g.rank > f.rank AND g.seq < f.seq)""")
def run_state_stream(spark, d):
    """Users as runs: signed up, clicking, and finished by a purchase; each step is told once."""
    rows = events(spark, d).select(F.col("user_id").alias("run_id"), F.expr(_STATE).alias("state"), F.col("event_id").alias("seq"))
    return streams.run_to_table(streams.run_states(streams.tail(spark, _folder(rows, "log"), rows.schema)), "states")


@query("streaming_quality", f"""WITH t AS (SELECT doc_id, {sql_squeeze('text')} AS t FROM documents), s AS (SELECT *, {sql_state('t')} AS page_state, least(1.0::DOUBLE, length(t) / 1000.0::DOUBLE) AS share FROM t)
  SELECT doc_id, page_state, {sql_language('t')} AS language, round(CASE WHEN page_state = 'OK' THEN share ELSE least(0.2::DOUBLE, share) END, 4) AS score, page_state = 'OK' AND share >= 0.05 AS accepted FROM s""")
def streaming_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = streams.page_states(streams.tail(spark, _folder(docs, "texts"), docs.schema), "text")
    return streams.run_to_table(found.select("doc_id", "page_state", "language", "score", "accepted"), "quality")


@query("streaming_cas", "SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def streaming_cas(spark, d):
    docs = table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("body"))
    return streams.store_arrivals(streams.tail(spark, _folder(docs, "texts"), docs.schema), "body").select("sha256", "size")
