"""Python operators hold pieces of a batch, and YAML is parsed by libyaml."""

import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F

from pagelake.functions import quality
from pagelake.operators import content, payloads, shared
from pagelake.sources import files


def test_slices_are_whole_and_small():
    bodies = ["x" * n for n in (0, 700, 700, 5000, 10, 10)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "body": pa.array(bodies, pa.string())})
    parts = list(shared.slices(batch, "body", 1500))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert [p.num_rows for p in parts] == [2, 1, 1, 3]
    assert list(shared.slices(batch.slice(0, 0), "body")) == []


def test_bodies_larger_than_a_slice(spark, monkeypatch):
    """Rows stay together over pieces, bodies that are null or broken too."""
    size = shared.SLICE_BYTES // 3 * 2
    rows = spark.range(7, numPartitions=1).select("id", F.when(F.col("id") == 3, None).otherwise(F.concat(F.lit('<a href="/'), F.col("id").cast("string"), F.lit('">'), F.repeat(F.lit("x"), F.lit(size)))).alias("html"))
    links = {r.id: [x.url for x in r.l] for r in rows.select("id", content.page_links(F.lit("https://a.org/"), "html").alias("l")).collect()}
    assert links == {i: [f"https://a.org/{i}"] if i != 3 else [] for i in range(7)}
    body = F.when(F.col("id") == 2, "[").when(F.col("id") != 3, F.concat(F.lit('{"'), F.col("id").cast("string"), F.lit('":"'), F.repeat(F.lit("x"), F.lit(size)), F.lit('"}')))
    made = payloads.payload_normalize(rows.select("id", body.alias("body"), F.lit("json_endpoint").alias("capability"), F.lit(None).cast("string").alias("media_type"))).drop("body", "data").collect()
    assert {r.id: (r.locators, r.omitted_records) for r in made} == {i: ([f"json:/{i}"], 0) if i not in (2, 3) else (None, None) for i in range(7)}
    broken = files.epub_members(rows.select(F.col("id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))).collect()
    assert sorted((r.path, r.text, r.error) for r in broken) == [(str(i), None, "File is not a zip file") for i in range(7)]


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no libyaml")
def test_yaml_is_parsed_by_libyaml(monkeypatch):
    def slow(self):
        raise AssertionError("the scanner in Python is many times slower")

    monkeypatch.setattr(yaml.scanner.Scanner, "fetch_more_tokens", slow)
    assert payloads.parse_openapi(b"openapi: 3.0.0\npaths:\n  /e/1:\n    get: {}\n")["paths"] == {"/e/1": {"get": {}}}
    for bad in (b"openapi: 3.0.0\npaths: {a: &x 1, b: *x}", b"openapi: 3.0.0\npaths: {a: 1, a: 2}", b"openapi: 3.0.0\npaths: " + b"[" * 70 + b"]" * 70):
        with pytest.raises(ValueError):
            payloads.parse_openapi(bad)


def test_ocr_state_squeezes_once(spark):
    """A text's white space is squeezed, and the text lowered, once per row."""
    rows = spark.createDataFrame([(" ", "pdf"), ("Sign in ", "docx"), ("some\x1f words", "pdf")], "text string, form string").select(quality.ocr_state(F.col("text"), F.col("form")).alias("s"))
    assert [r.s for r in rows.collect()] == ["NEEDS_OCR", "LOGIN", "OK"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("lower(") == 1
