"""Pages of a clustered table: each reads its own files, and together they are the table."""

import pytest
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.sources import store


@pytest.fixture
def table(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.CATALOG)
    rows = spark.range(1000).select(F.format_string("d%05d", "id").alias("doc_id"), F.concat(F.lit("kb "), (F.col("id") % 3).cast("string")).alias("kb_id"))
    t.commit(rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CATALOG if f.name not in rows.columns]))
    return t


def ids(rows):
    return [r.doc_id for r in rows]


def files_of(df):
    return len(df.inputFiles())


def test_pages_are_the_table(spark, table):
    for clustered in (False, True):
        if clustered:
            assert table.cluster("doc_id", 50) == 2
        pages = list(table.pages(130, "doc_id"))
        assert [len(p) for p in pages] == [130] * 7 + [90] and ids(r for p in pages for r in p) == [f"d{i:05}" for i in range(1000)]
        assert ids(r for p in table.pages(100, "doc_id", ["kb 1"]) for r in p) == [f"d{i:05}" for i in range(1000) if i % 3 == 1]
    assert table.read().count() == 1000 and set(table.folders()) == {"kb 0", "kb 1", "kb 2"}


def test_a_page_reads_its_own_files(spark, table):
    table.cluster("doc_id", 50)
    every = files_of(table.read())
    assert every >= 20
    for after in (None, "d00100", "d00777", "d00989"):
        page = table.scroll(after, 30, "doc_id")
        first = 0 if after is None else int(after[1:]) + 1
        assert ids(page.collect()) == [f"d{i:05}" for i in range(first, min(first + 30, 1000))] and files_of(page) <= 7
    assert table.scroll("d00999", 30, "doc_id").count() == 0 and files_of(table.scroll("d00500", 10, "doc_id", ["kb 2"])) <= 2


def test_partitions_written_since(spark, table):
    """A partition that is not clustered is read whole, beside the others' ranges."""
    table.cluster("doc_id", 50)
    table.patch(F.col("kb_id") == "kb 1", {"status": F.lit("x")})
    assert ids(r for p in table.pages(170, "doc_id") for r in p) == [f"d{i:05}" for i in range(1000)]
    assert table.scroll("d00010", 3, "doc_id").select("status").collect() == [(None,), (None,), ("x",)]


def test_partitions_with_odd_names(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t #1", schemas.CATALOG)
    rows = spark.range(300).select(F.format_string("d%05d", "id").alias("doc_id"), F.element_at(F.array(*map(F.lit, ("a/b", "50%", "x=y"))), (F.col("id") % 3 + 1).cast("int")).alias("kb_id"))
    t.commit(rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CATALOG if f.name not in rows.columns]))
    t.cluster("doc_id", 30)
    assert ids(r for p in t.pages(70, "doc_id") for r in p) == [f"d{i:05}" for i in range(300)]
    assert files_of(t.scroll("d00100", 10, "doc_id", ["50%"])) <= 2 < files_of(t.read(["50%"]))


def test_no_rows(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t", schemas.CATALOG)
    assert list(t.pages(10, "doc_id")) == []
    t.cluster("doc_id")
    assert list(t.pages(10, "doc_id")) == [] and t.version() == 1
