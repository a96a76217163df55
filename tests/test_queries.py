"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pagelake import plans
from pagelake.plans import registry

plans.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(df, columns):
    def cell(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return ""
        if hasattr(v, "item"):
            v = v.item()
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, row)) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert canon(got, columns) == canon(want, columns)


FEEDS = ("rss_items", "rss_channel", "atom_entries", "arxiv_entries", "feed_record", "sitemap_records", "openapi_paths")


@pytest.fixture(scope="session")
def hot(spark, tmp_path_factory):
    """Events of which one user has more than the limits on records and nodes of a body."""
    path = str(tmp_path_factory.mktemp("hot"))
    spark.range(34500).selectExpr("id AS event_id", "CASE WHEN id % 69 = 0 THEN id % 50 ELSE 3 END AS user_id", "concat('t', id % 7) AS event_type").repartition(3).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", FEEDS)
def test_feeds_of_a_hot_user(spark, hot, name):
    got, want = registry.QUERIES[name](spark, hot[0]).toPandas(), hot[1].sql(registry.ORACLE_SQL[name]).df()
    assert canon(got, sorted(want.columns)) == canon(want, sorted(want.columns))


READERS = ("boilerplate_removal", "clean_text", "main_article", "mercury_style", "newspaper_style")
ODD_PAGES = (
    "<title>cut&&&amp</title> a&lt b &ampsand &notit; &notin; &copy2", "&#8212;&#x41;&#65 &#128;&#0;&#55296;&#1114112;&#1;|&#x7f; &bogus; &amp;lt;", "<article></article><p>all</p>", None, "",
    "<main>short</main><article>a <i>longer</i> one</article>", "<ARTICLE class=x>one</article><article>two</Article> rest", "<SCRIPT>x</script\x0b>a<style>b</style\n>c<noscript>d</noscript>", "<article>open <main>in</main>", "a\x0b\x1c\x1f\u0085 b", "\x1ca\x1f",
)


@pytest.mark.parametrize("name", READERS)
def test_readers_on_odd_pages(spark, tmp_path, name):
    """References without a semicolon, several elements, none, and white space of all kinds."""
    pd.DataFrame({"page_id": range(len(ODD_PAGES)), "url": "https://a.org/", "html": ODD_PAGES}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert canon(got, ["page_id", "text"]) == canon(want, ["page_id", "text"])
    text = dict(zip(got["page_id"], got["text"]))
    assert text[0] == "cut&&& a< b &sand ¬it; ∉ ©2"


def test_token_estimate_has_heads(spark):
    """The start of each text, of which the estimate is."""
    rows = registry.QUERIES["token_estimate"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    assert rows.where("head <=> left(text, 40)").count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
