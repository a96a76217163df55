"""Queries over payloads, files and archives derived from the given tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from pagelake.operators import payloads as p
from pagelake.operators import trees
from pagelake.operators.shared import numbered, shared_path
from pagelake.plans.registry import query, table
from pagelake.sources import files


def events(spark, d):
    return table(spark, d, "events")


_BAD = ['{"a":1,"a":2}', '{"a":NaN}', '[1,2] x', '{"a":1e999}']


@query("json_strict", "SELECT event_id, event_id % 8 > 3 AS ok, ['duplicate JSON object keys are forbidden', 'non-finite JSON numbers are forbidden', 'malformed JSON', 'non-finite numbers are forbidden', NULL, NULL, NULL, NULL][event_id % 8 + 1] AS error FROM events")
def json_strict(spark, d):
    """Half of the property texts are replaced by four kinds of bad JSON."""
    body = F.coalesce(F.get(F.array(*map(F.lit, _BAD)), (F.col("event_id") % 8).cast("int")), F.col("props"))
    return events(spark, d).select("event_id", p.json_strict(body).alias("v")).select("event_id", "v.ok", "v.error")


def _list(spark, d):
    n = (F.col("event_id") % 20 + 1).cast("int")
    return events(spark, d).select("event_id", n.alias("n"), F.to_json(F.named_struct(F.lit("data"), F.sequence(F.lit(1), n), F.lit("k"), F.sequence(F.lit(1), n))).alias("body"))


def _normal(spark, d, rows, capability, media="application/json", n=p.MAX_RECORDS, source=None):
    rows = rows.withColumn("capability", F.lit(capability)).withColumn("media_type", F.lit(media))
    return p.payload_normalize(rows, maximum_records=n, source_url=source)


@query("json_truncate", "SELECT event_id, 2 * greatest(0, event_id % 20 + 1 - 5)::BIGINT AS omitted_records FROM events")
def json_truncate(spark, d):
    return _normal(spark, d, _list(spark, d), "json_endpoint", n=5).select("event_id", "omitted_records")


@query("json_locators", "SELECT doc_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['json:/a~1b~0', 'json:/' || lang, 'json:/' || source] ELSE list_transform(range(0, len(string_split(text, ' '))), lambda i: 'json:/' || i) END, ',') AS locators FROM documents")
def json_locators(spark, d):
    """Documents as objects with their own language and source as keys, or as lists of their words."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('":1'))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"a/b~":2,'), quoted(F.col("lang")), F.lit(","), quoted(F.col("source")), F.lit("}"))).otherwise(F.to_json(F.split("text", " ")))
    return table(spark, d, "documents").select("doc_id", F.array_join(p.json_locators(body, 1 << 30), ",").alias("locators"))


_KEYS = {"graphql": ("graphql", "errors"), "github": ("github_api", "login"), "semantic_scholar": ("semantic_scholar_api", "paperId"), "openreview": ("openreview_api", "notes"), "crossref_openalex": ("crossref", "message")}


def _envelope(name: str, kind: str, key: str) -> None:
    def run(spark, d):
        key_of = F.when(F.col("event_type") == "click", key).otherwise(F.col("event_type"))
        body = F.to_json(F.struct(F.col("value"), F.map_from_arrays(F.array(key_of), F.array("props")).alias("m")))
        body = F.when(F.col("user_id") % 5 == 0, F.col("props")).otherwise(F.get_json_object(body, "$.m"))
        return events(spark, d).select("event_id", p.has_envelope(body, kind).alias("ok"))

    query(f"{name}_envelope", "SELECT event_id, user_id % 5 <> 0 AND event_type = 'click' AS ok FROM events")(run)


for _n, (_kind, _key) in _KEYS.items():
    _envelope(_n, _kind, _key)


@query("crossref_openalex_host", "SELECT event_id, CASE WHEN (event_type = 'click') = (user_id % 2 = 0) THEN 'json' END AS format FROM events")
def crossref_openalex_host(spark, d):
    """Clicks come from one host, others from the other; even users get the first one's keys."""
    rows = events(spark, d).select(
        "event_id", F.when(F.col("event_type") == "click", "https://api.crossref.org/works").otherwise("https://api.openalex.org/works").alias("source"),
        F.concat(F.lit('{"'), F.when(F.col("user_id") % 2 == 0, "message-type").otherwise("results"), F.lit('":'), "props", F.lit("}")).alias("body"),
    )
    return _normal(spark, d, rows, "crossref_openalex_api", source="source").select("event_id", "format")


@query("rest_json", "SELECT event_id, 'api_response' AS representation, 'json' AS format, 'json:/k' AS locators FROM events")
def rest_json(spark, d):
    rows = events(spark, d).select("event_id", F.col("props").alias("body"))
    return _normal(spark, d, rows, "rest").select("event_id", "representation", "format", F.array_join("locators", ",").alias("locators"))


def _xml(spark, d):
    body = F.concat(F.lit("<r><user>"), F.col("user_id").cast("string"), F.lit("</user><kind>"), "event_type", F.lit("</kind></r>"))
    return events(spark, d).select("event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('<!DOCTYPE r [<!ENTITY e "x">]>'), body)).when(F.col("event_id") % 4 == 1, F.concat(body, F.lit("<"))).otherwise(body).alias("body"))


@query("xml_strict", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'malformed_api_payload: ValueError' WHEN 1 THEN 'malformed_api_payload: ParseError' END AS error FROM events")
def xml_strict(spark, d):
    return _normal(spark, d, _xml(spark, d), "xml_endpoint", "text/xml").select("event_id", "error")


@query("xml_tree", """SELECT event_id, CASE WHEN event_id % 4 > 1 THEN '{"attributes":{},"children":[{"attributes":{},"children":[],"tag":"user","text":"' || user_id || '"},{"attributes":{},"children":[],"tag":"kind","text":"' || event_type || '"}],"tag":"r","text":""}' END AS data FROM events""")
def xml_tree(spark, d):
    """Half of the documents are malformed and have no tree."""
    return _normal(spark, d, _xml(spark, d), "rest", "text/xml").select("event_id", "data")


@query("element_rows", """WITH e AS (SELECT * FROM events WHERE event_id % 4 > 1)
  SELECT event_id, '/r[0]' AS path, 0 AS position, 'r' AS tag, '' AS text FROM e
  UNION ALL SELECT event_id, '/r[0]/user[0]', 0, 'user', user_id::VARCHAR FROM e UNION ALL SELECT event_id, '/r[0]/kind[1]', 1, 'kind', event_type FROM e""")
def element_rows(spark, d):
    """The elements of the well-formed half of the documents."""
    return trees.element_rows(_normal(spark, d, _xml(spark, d), "xml_endpoint", "text/xml"), "event_id").drop("attributes")


def _turns(spark, d):
    """Turns of conversations as nested JSON: role and turn, then the lines with their words."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n"), F.split(x, " ").alias("words")))
    body = F.to_json(F.struct(F.struct("role", "turn").alias("meta"), lines.alias("lines")))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


_LINES = "l AS (SELECT conv_id, turn, role, i, string_split(text, chr(10))[i + 1] AS line FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)), w AS (SELECT *, unnest(range(len(string_split(line, ' ')))) AS j FROM l)"
_TURN = "SELECT conv_id, turn, '/meta/role' AS path, '\"' || role || '\"' AS value, false AS omitted FROM conversations UNION ALL SELECT conv_id, turn, '/meta/turn', turn::VARCHAR, false FROM conversations"


@query("json_rows", f"""WITH {_LINES} {_TURN}
  UNION ALL SELECT conv_id, turn, '/lines/' || i || '/n', length(line)::VARCHAR, false FROM l
  UNION ALL SELECT conv_id, turn, '/lines/' || i || '/words/' || j, '"' || string_split(line, ' ')[j + 1] || '"', false FROM w""")
def json_rows(spark, d):
    """Every leaf of the turns."""
    return trees.json_rows(_turns(spark, d), "body", "conv_id", "turn")


@query("json_rows_capped", f"""WITH {_LINES}, x AS ({_TURN}
  UNION ALL SELECT conv_id, turn, '/lines/' || i || '/n', length(line)::VARCHAR, false FROM l WHERE i < 2
  UNION ALL SELECT conv_id, turn, '/lines/' || i || '/words/' || j, '', j >= 2 FROM w WHERE i < 2
  UNION ALL SELECT conv_id, turn, '/lines/' || i, NULL, true FROM l WHERE i >= 2)
  SELECT conv_id, turn, count_if(NOT omitted) AS leaves, count_if(omitted) AS omitted FROM x GROUP BY conv_id, turn""")
def json_rows_capped(spark, d):
    """Lists cut to two elements at every level: leaves that stay and elements left out."""
    rows = trees.json_rows(_turns(spark, d), "body", "conv_id", "turn", most=2)
    return rows.groupBy("conv_id", "turn").agg(F.count_if(~F.col("omitted")).alias("leaves"), F.count_if("omitted").alias("omitted"))


#: Items of one feed body: far below the limits on records, nodes and bytes.
RUN = 1000

def _feed(spark, d, head, item, tail):
    """Feeds of RUN consecutive events of a user with an item per event, in event order."""
    rows = events(spark, d).select("user_id", "event_id", item.alias("x"))
    rows = numbered(rows, ["user_id"], [F.col("event_id")], "pos").select("user_id", F.floor(F.col("pos") / RUN).alias("run"), F.struct("pos", "x").alias("x"))
    body = F.concat(F.lit(head) if isinstance(head, str) else F.first(head), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["x"]), ""), F.lit(tail))
    return rows.groupBy("user_id", "run").agg(body.alias("body"))


def _items(df):
    """Records of the normalised documents as rows, at their places among the user's events."""
    kind = "struct<records:array<struct<title:string,link:string,id:string,summary:string,loc:string,lastmod:string>>>"
    rows = df.select("user_id", "run", F.posexplode(F.from_json("data", kind)["records"]).alias("at", "r"))
    return rows.select("user_id", (F.col("run") * RUN + F.col("at")).cast("int").alias("pos"), "r.*")


_E = "FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS pos FROM events)"


def _rss(spark, d):
    item = F.concat(F.lit("<item><title>"), "event_type", F.lit("</title><link>https://e.org/"), F.col("event_id").cast("string"), F.lit("</link><guid>"), F.col("event_id").cast("string"), F.lit("</guid></item>"))
    user = F.col("user_id").cast("string")
    head = F.concat(F.lit('<rss version="2.0"><channel><title>Feed of '), user, F.lit("</title><link>https://e.org/u/"), user, F.lit("</link><description> All events </description>"))
    return _feed(spark, d, head, item, "</channel></rss>")


@query("rss_items", f"SELECT user_id, pos, event_type AS title, 'https://e.org/' || event_id AS link, event_id::VARCHAR AS id {_E}")
def rss_items(spark, d):
    return _items(_normal(spark, d, _rss(spark, d), "rss", "text/xml")).select("user_id", "pos", "title", "link", "id")


def _atom(spark, d):
    item = F.concat(F.lit("<entry><title>"), "event_type", F.lit('</title><link rel="self" href="no"/><link href="https://e.org/'), F.col("event_id").cast("string"), F.lit('"/><summary> s </summary></entry>'))
    return _feed(spark, d, f'<feed xmlns="{p.ATOM}">', item, "</feed>")


@query("atom_entries", f"SELECT user_id, pos, event_type AS title, 'https://e.org/' || event_id AS link, 's' AS summary {_E}")
def atom_entries(spark, d):
    return _items(_normal(spark, d, _atom(spark, d), "atom", "text/xml")).select("user_id", "pos", "title", "link", "summary")


@query("arxiv_entries", "SELECT user_id, 'api_response' AS representation, CASE WHEN user_id % 4 <> 0 THEN count(*) END::INTEGER AS entries FROM events WHERE user_id % 4 <> 0 GROUP BY user_id UNION ALL SELECT DISTINCT user_id, NULL, NULL FROM events WHERE user_id % 4 = 0")
def arxiv_entries(spark, d):
    """Every fourth user's feeds don't come from arXiv."""
    feeds = _atom(spark, d).withColumn("source", F.when(F.col("user_id") % 4 == 0, "https://arxiv.example/api/query").otherwise("https://export.arxiv.org/api/query"))
    rows = _normal(spark, d, feeds, "arxiv_api", "text/xml", source="source")
    return rows.groupBy("user_id").agg(F.max("representation").alias("representation"), F.sum(F.size("locators")).cast("int").alias("entries"))


@query("rss_channel", "SELECT user_id, 'Feed of ' || user_id AS title, 'https://e.org/u/' || user_id AS link, 'All events' AS description, count(*) AS items FROM events GROUP BY user_id")
def rss_channel(spark, d):
    kind = "struct<title:string,link:string,description:string,records:array<struct<title:string>>>"
    rows = _normal(spark, d, _rss(spark, d), "rss", "text/xml").select("user_id", F.from_json("data", kind).alias("c"))
    return rows.groupBy("user_id").agg(*[F.max(f"c.{x}").alias(x) for x in ("title", "link", "description")], F.sum(F.size("c.records")).cast("long").alias("items"))


@query("feed_record", f"SELECT user_id, pos, event_type AS title, event_id::VARCHAR AS id, NULL::VARCHAR AS summary {_E}")
def feed_record(spark, d):
    return _items(_normal(spark, d, _rss(spark, d), "rss", "text/xml")).select("user_id", "pos", "title", "id", "summary")


@query("sitemap_records", f"SELECT user_id, pos, 'https://e.org/' || event_id AS loc, '2024' AS lastmod {_E}")
def sitemap_records(spark, d):
    item = F.concat(F.lit("<url><loc>https://e.org/"), F.col("event_id").cast("string"), F.lit("</loc><lastmod>2024</lastmod></url>"))
    rows = _feed(spark, d, "<urlset>", item, "</urlset>")
    return _items(_normal(spark, d, rows, "sitemap_xml", "text/xml")).select("user_id", "pos", "loc", "lastmod")


@query("openapi_paths", f"SELECT user_id, 'path:/e/' || event_id AS locator {_E}")
def openapi_paths(spark, d):
    item = F.concat(F.lit("  /e/"), F.col("event_id").cast("string"), F.lit(":\n    get: {}\n"))
    rows = _feed(spark, d, "openapi: 3.0.0\npaths:\n", item, "")
    return _normal(spark, d, rows, "openapi_discovery", "text/yaml").select("user_id", F.explode("locators").alias("locator"))


@query("openapi_operations", f"SELECT user_id, '/e/' || event_id AS path, unnest(CASE event_id % 3 WHEN 0 THEN ['get'] WHEN 1 THEN ['get', 'post'] ELSE [] END) AS method {_E}")
def openapi_operations(spark, d):
    """Descriptions whose paths have one operation, two or none beside what is no operation."""
    kinds = F.element_at(F.array(*map(F.lit, ("    get: {}\n", "    post: {x: [1]}\n    get:\n      tags: [a]\n", "    x-get: {}\n"))), (F.col("event_id") % 3 + 1).cast("int"))
    item = F.concat(F.lit("  /e/"), F.col("event_id").cast("string"), F.lit(":\n    parameters: []\n"), kinds)
    rows = _feed(spark, d, "openapi: 3.0.0\npaths:\n", item, "")
    return p.openapi_operations(_normal(spark, d, rows, "openapi_discovery", "text/yaml"), "user_id").select("user_id", "path", "method")


@query("payload_sniff", "SELECT page_id, page_id % 3 <> 2 AS xml FROM pages")
def payload_sniff(spark, d):
    """Pages as they are, their quoted markup under an XML type, and their URLs."""
    k = F.col("page_id") % 3
    body = F.when(k == 0, F.concat(F.lit(" "), "html")).when(k == 1, F.concat(F.lit('"'), "html")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", p.looks_like_xml(body, F.when(k == 1, "application/Atom+XML; charset=x").otherwise("text/plain")).alias("xml"))


@query("payload_envelope", """SELECT event_id, '{"authority_url":"https://a.org/","capability":"rest","data":' || to_json(event_type) || ',"format":"json","omitted_records":0,"schema_version":"1.0","source_url":"https://a.org/' || event_id || '"}' AS document FROM events""")
def payload_envelope(spark, d):
    doc = p.envelope(F.lit("rest"), F.lit("https://a.org/"), F.concat(F.lit("https://a.org/"), F.col("event_id").cast("string")), F.lit("json"), F.col("event_type"), F.lit(0))
    return events(spark, d).select("event_id", doc.alias("document"))


@query("format_outcome", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'xml_endpoint' ELSE 'rest' END AS capability_id, 'APPLIED' AS status FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'json_endpoint' ELSE 'xml_endpoint' END, 'OBSERVED' FROM events WHERE event_id % 3 <> 1")
def format_outcome(spark, d):
    """Events' own properties as JSON, and their types as XML under two capabilities; the format is what the payload is found to be."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.col("props")).otherwise(F.concat(F.lit("<e>"), "event_type", F.lit("</e>")))
    rows = events(spark, d).select("event_id", F.when(k == 1, "xml_endpoint").otherwise("rest").alias("capability"), body.alias("body"), F.lit("").alias("media_type"))
    found = p.payload_normalize(rows).where("error IS NULL").select("event_id", F.when(k == 1, "xml_endpoint").otherwise("rest").alias("capability"), "format")
    return p.format_outcomes(found, "event_id")


@query("payload_normalize", "SELECT event_id, ['api_response', 'api_response', 'graphql', NULL][event_id % 4 + 1] AS representation, ['json', 'xml', 'json', NULL][event_id % 4 + 1] AS format, event_id % 4 <> 3 AS ok FROM events")
def payload_normalize(spark, d):
    k = F.col("event_id") % 4
    rows = events(spark, d).select("event_id", F.when(k < 2, "rest").otherwise("graphql").alias("capability"), F.when(k == 1, "<r/>").when(k == 2, '{"data":{}}').otherwise(F.col("props")).alias("body"), F.lit("").alias("media_type"))
    return p.payload_normalize(rows).select("event_id", "representation", "format", F.col("error").isNull().alias("ok"))


# ---- files


def _files(spark, d, content):
    return table(spark, d, "documents").select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(content, "UTF-8").alias("content"))


@query("text_blocks", "SELECT '/f/' || doc_id || '.txt' AS path, 'line:1' AS locator, text FROM documents")
def text_blocks(spark, d):
    return files.text_blocks(_files(spark, d, F.col("text")))


_CSV = "SELECT '/f/' || doc_id || '.txt' AS path, 'row:1' AS locator, 'id,lang' AS cells FROM documents UNION ALL SELECT '/f/' || doc_id || '.txt', 'row:2', doc_id || ',' || lang FROM documents"


@query("csv_rows", _CSV)
def csv_rows(spark, d):
    body = F.concat(F.lit("﻿id,lang\n"), F.col("doc_id").cast("string"), F.lit(',"'), "lang", F.lit('"\n'))
    return files.csv_rows(_files(spark, d, body)).where("error IS NULL").select("path", "locator", F.array_join("cells", ",").alias("cells"))


@query("format_route", "SELECT '/f/' || doc_id || '.txt' AS path, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'plain_text_file' END AS format FROM documents")
def format_route(spark, d):
    k = F.col("doc_id") % 3
    rows = _files(spark, d, F.concat(F.when(k == 0, "%PDF-1.7 ").when(k == 1, "PK\x03\x04").otherwise("x"), "text"))
    return rows.select("path", files.format_route(F.col("path"), F.col("content")).alias("format"))


@query("blocks_to_text", "SELECT doc_id, string_agg(line, chr(10) ORDER BY i DESC) AS text, count(*) AS blocks FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) GROUP BY doc_id")
def blocks_to_text(spark, d):
    """Lines of every document as blocks, put together from the last to the first."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    rows = rows.withColumn("back", -F.col("i")).withColumn("locator", F.concat(F.lit("line:"), F.col("i").cast("string"))).withColumn("cells", F.lit(None).cast("array<string>"))
    return files.blocks_to_text(rows, "doc_id", "back").select("doc_id", "text", F.size("locators").cast("long").alias("blocks"))


def _zipped(spark, d, suffix):
    """Zip files of about ten documents each, written inside tasks."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            for key, text in sorted(zip(pdf["doc_id"], pdf["text"])):
                z.writestr(f"{'../' if pdf['g'].iloc[0] % 10 == 0 else ''}d/{key}{suffix}", text)
        content = box.getvalue()[:-30] if pdf["g"].iloc[0] % 10 == 1 else box.getvalue()  # every tenth is cut off
        return pd.DataFrame({"path": [f"/z/{pdf['g'].iloc[0]}.zip"], "content": [content]})

    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("text"), (F.col("doc_id") / 10).cast("long").alias("g"))
    return rows.groupBy("g").applyInPandas(pack, "path string, content binary")


_BROKEN_ZIPS = "SELECT DISTINCT '/z/' || doc_id // 10 || '.zip' AS path FROM documents WHERE doc_id // 10 % 10 = 1"


@query("epub_members", f"SELECT '/z/' || doc_id // 10 || '.zip' AS path, 'member:d/' || doc_id || '.xhtml' AS locator, ' ' || regexp_replace(text, '(?s)<[^>]+>', ' ', 'g') || ' ' AS text, NULL::VARCHAR AS error FROM documents WHERE doc_id // 10 % 10 > 1 UNION ALL SELECT path, NULL, NULL, 'File is not a zip file' FROM ({_BROKEN_ZIPS})")
def epub_members(spark, d):
    return files.epub_members(_zipped(spark, d, ".xhtml"))


@query("archive_members", f"SELECT '/z/' || doc_id // 10 || '.zip' AS path, 'd/' || doc_id || '.txt' AS member, octet_length(encode('<p>' || text || '</p>')) AS size, sha256('<p>' || text || '</p>') AS sha256, NULL::VARCHAR AS error FROM documents WHERE doc_id // 10 % 10 > 1 UNION ALL SELECT DISTINCT '/z/' || doc_id // 10 || '.zip', NULL, NULL, NULL, 'archive path traversal detected' FROM documents WHERE doc_id // 10 % 10 = 0 UNION ALL SELECT path, NULL, NULL, NULL, 'unsupported or malformed archive' FROM ({_BROKEN_ZIPS})")
def archive_members(spark, d):
    return files.archive_members(_zipped(spark, d, ".txt")).drop("content")


@query("canonical_json_sink", """SELECT '{"c_acctbal":' || c_acctbal || ',"c_key":' || c_custkey || ',"c_name":"' || c_name || '","parts":[{"a":' || c_acctbal / 8 || ',"z":null},null],"tags":{"a":{"k":' || c_nationkey || ',"m":"' || c_mktsegment || '"},"s":null}}' AS json FROM customer""")
def canonical_json_sink(spark, d):
    """Customers written as canonical JSON lines and read back as text."""
    part = F.struct(F.lit(None).cast("string").alias("z"), (F.col("c_acctbal") / 8).alias("a"))
    inner = F.struct(F.col("c_mktsegment").alias("m"), F.col("c_nationkey").alias("k"))
    tags = F.map_from_arrays(F.array(F.lit("s"), F.lit("a")), F.array(F.lit(None).cast("struct<m:string,k:int>"), inner.cast("struct<m:string,k:int>")))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("c_key"), "c_name", "c_acctbal", F.array(part, F.lit(None)).alias("parts"), tags.alias("tags"))
    path = shared_path(spark, "canonical")
    files.write_canonical_json(rows, path, "c_custkey")
    return spark.read.text(path).select(F.col("value").alias("json"))
