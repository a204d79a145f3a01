"""Every query that has SQL gives the same rows in DuckDB; the others run."""

import pytest

import __spark_entry__ as entry
from corpusflow.queries.compare import connect, difference
from corpusflow.queries.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    assert difference(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_crawl_has_every_page_and_followed_links(spark, tmp_path):
    pages = [(i, f"http://a.example/{i}", f'<a href="/to{i}">x</a>') for i in range(1200)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.url, r.depth) for r in QUERIES["src03_crawl"](spark, str(tmp_path)).collect()}
    assert got == {(f"http://a.example/{i}", 0) for i in range(1200)} | {(f"http://a.example/to{i}", 1) for i in range(1200)}


def test_retrieve_asks_every_item(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id")
    asked = {r.query_id for r in QUERIES["ret04_retrieve"](spark, SF).select("query_id").distinct().collect()}
    assert max(asked) >= 5 and asked <= {r.item_id for r in items.collect()}
