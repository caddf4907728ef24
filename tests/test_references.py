"""Character references without their semicolon: a browser's rule by default, kept as written on demand; the query goes by its SQL."""

import duckdb

import __spark_entry__
from quillstone.operators import parse

PAGES = [(0, "http://a/0", "<html><title>T&amp</title><body>a &amp; b&amp<p>x&lty &copy;</p></body></html>"), (1, "http://a/1", "<html><title>T &amp;amp; U&am</title><body>R&ampD a && b</body></html>")]


def test_references_without_a_semicolon():
    assert parse.parse_html("<title>A&amp</title><body>x &copy=1 &amp; &notit; &#65;&#66 &bogus; &</body>", closed_only=True) == {
        "content": "x &copy=1 & &notit; A&#66 &bogus; &", "title": "A&amp", "language": "en", "images": [],
    }
    assert parse.parse_html("<title>A&amp</title><body>x &copy=1</body>")["content"] == "x ©=1"
    assert parse.parse_html("<body><img src='a?x=1&copy=2&amp;b=3'></body>", closed_only=True)["images"][0]["src"] == "a?x=1&copy=2&b=3"


def test_main_text_equals_its_sql(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["html_main_text"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["html_main_text"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
