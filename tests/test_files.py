"""Folders: listed once, each file opened by the scan of its type alone."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import parse
from quillstone.sources import files

LIMIT = "spark.sql.sources.binaryFile.maxLength"


def named(df):
    return {r.path.rsplit("/", 1)[1]: r for r in df.collect()}


@pytest.fixture
def folder(tmp_path):
    bodies = {
        "a.txt": "t" * 200, "B.HTML": "<body>up</body>", "c.md": "# T\n\nb", "d.pdf": "%PDF" + "x" * 300, "e.png": "p" * 300, "f.bin": "z" * 300, "page": "<html><body>bare</body>", "notes": "plain", "x y.txt": "blank",
        "ü%20.txt": "odd", "File:Foo.html": "no", ".git/g.txt": "no", "sub/h.html": "<body>h</body>", "w.xml": "<mediawiki>" + "x" * 300,
    }
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    return tmp_path


@pytest.fixture
def unreadable(spark):
    """Files of more bytes than a limit fail the scan that opens them."""

    def limit(n):
        spark.conf.set(LIMIT, n)

    yield limit
    spark.conf.unset(LIMIT)


def test_discovery_opens_files_without_an_extension_only(spark, folder, unreadable):
    unreadable(50)
    found = {n: r.type for n, r in named(files.discover(spark, str(folder))).items()}
    assert found == {"a.txt": "text", "B.HTML": "html", "c.md": "markdown", "d.pdf": "pdf", "e.png": "image", "page": "html", "x y.txt": "text", "ü%20.txt": "text", "h.html": "html", "w.xml": "mediawiki"}
    unreadable(10)
    with pytest.raises(Exception, match="max length"):  # the bare files are opened
        files.discover(spark, str(folder)).collect()


def test_files_that_are_too_long_to_be_sniffed(spark, folder, unreadable, monkeypatch):
    monkeypatch.setattr(files, "SNIFFED_MOST", 10)
    unreadable(10)
    assert "page" not in named(files.discover(spark, str(folder)))


def test_parsing_opens_what_the_types_need(spark, folder, unreadable):
    unreadable(250)  # the PDF, the image, the export and the unknown type are longer
    got = named(files.parse_files(spark, str(folder)))
    assert set(got) == {"a.txt", "B.HTML", "c.md", "d.pdf", "e.png", "page", "x y.txt", "ü%20.txt", "h.html"}
    assert (got["B.HTML"].content_text, got["page"].content_text, got["x y.txt"].content_text, got["ü%20.txt"].content_text, got["h.html"].content_text) == ("up", "bare", "blank", "odd", "h")
    assert got["d.pdf"].pages == [] and got["e.png"].images[0].src.endswith("/e.png") and got["e.png"].page_title == "E"
    pages = lambda path, content: F.struct(F.lit("").alias("title"), F.array(F.struct(F.lit(1).alias("page"), F.length(content).cast("string").alias("text"))).alias("pages"))
    with pytest.raises(Exception, match="max length"):  # with an extractor it is opened
        files.parse_files(spark, str(folder), pages).collect()
    unreadable(1 << 20)
    assert named(files.parse_files(spark, str(folder), pages))["d.pdf"].content_text == "304"


def test_each_file_is_read_by_one_scan(spark, folder):
    """The files that the scans of a plan list, by their own counts."""
    df = files.parse_files(spark, str(folder))
    assert len(named(df)) == 9
    scans, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        if "binaryFile" in p.nodeName() or "Scan" in p.nodeName():
            scans.append(p)
        todo += [p.children().apply(i) for i in range(p.children().size())]
    counts = [s.metrics().get("numFiles").get().value() for s in scans if s.metrics().contains("numFiles")]
    assert len(counts) == 5


def test_pdf_metadata(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("%PDF")
    extract = lambda path, content: F.struct(
        F.lit("").alias("title"), F.array(F.struct(F.lit(1).alias("page"), F.lit("text").alias("text"))).alias("pages"),
        F.create_map(F.lit("Title"), F.lit("A long report"), F.lit("Author"), F.lit("Somebody"), F.lit("Subject"), F.lit(None).cast("string")).alias("metadata"),
    )
    row = files.parse_files(spark, str(tmp_path), extract).first()
    assert row.metadata == {"Title": "A long report", "Author": "Somebody"} and row.page_title == "A long report"
    assert files.parse_files(spark, str(tmp_path)).first().metadata == {}


def test_cells_of_wiki_tables():
    table = '{| class="x"\n! scope="col" | Head !! Two\n|-\n| style="x" | a|b || plain || c | \n| [[Page|label]] || x = 1|y|z\n|}'
    assert parse.plain_wikitext(table).split("\n") == ["Head", "Two", "a|b", "plain", "label", "y|z"]
