import duckdb
import pytest

from satchel.plans import QUERIES, SQL

PAGE = "<html><head><title>t</title></head><body><nav>menu</nav><article><p>{0}</article><footer>end</footer>"
PAGES = [
    (1, "http://a.example.com/x", PAGE.format("short") + "</body></html>"),
    (2, "http://a.example.com/x", PAGE.format("cut off")),  # the same address, and no end
    (3, "http://b.example.com/y", PAGE.format("long " * 60)),  # no end, but an article
    (5, "http://c.example.com/", "<html><body><div>" + "word " * 60 + "</div><article><p>cut off</article>"),
    (4, "http://b.example.com/z", PAGE.format("other") + "</body></html>"),
]


@pytest.mark.parametrize("name", ["r25_block_text", "r26_site_rules", "a18_extraction_health", "s09_page_corpus"])
def test_pages_that_break_off_or_share_an_address(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, c.sql(SQL[name]).fetchall()))
