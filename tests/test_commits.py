"""Several writers of one table: who is first, who applies its change anew, and who is refused."""

import threading

import pytest
from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.sources import store

ROWS = "doc_id string, kb_id string, content_hash string, collection_name string, status string, source_paths array<string>, user_metadata map<string,string>, chunk_count long"


def record(spark, *rows):
    return spark.createDataFrame([(d, kb, h, "c", status, None, None, None) for d, kb, h, status in rows], ROWS)


def held(table):
    return sorted((r.doc_id, r.kb_id, r.status) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return store.Table(spark, f"file://{tmp_path}/t", schemas.CATALOG)


def at_once(*works):
    """All works in threads that start together; what each raised."""
    gate, raised = threading.Barrier(len(works)), [None] * len(works)

    def run(i):
        gate.wait()
        try:
            works[i]()
        except Exception as e:  # handed to the test
            raised[i] = e

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(works))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return raised


def test_writers_of_other_partitions_all_land(spark, table):
    assert at_once(*[lambda i=i: table.upsert(record(spark, (f"d{i}", f"kb{i}", "h", "new")), "doc_id") for i in range(6)]) == [None] * 6
    assert held(table) == [(f"d{i}", f"kb{i}", "new") for i in range(6)] and table.version() == 6


def test_a_changed_partition_refuses(spark, table):
    table.upsert(record(spark, ("a", "k", "h1", "one"), ("b", "l", "h2", "one")), "doc_id")
    base = table.snapshot()
    table.patch(F.col("doc_id") == "a", {"status": F.lit("two")})
    with pytest.raises(store.Conflict):
        table.commit(record(spark, ("a", "k", "h1", "lost")), ["k"], base)
    table.commit(record(spark, ("b", "l", "h2", "three")), ["l"], base)  # disjoint: applied to the newer version
    assert held(table) == [("a", "k", "two"), ("b", "l", "three")]
    with pytest.raises(store.Conflict):
        table.commit(record(spark, ("c", "m", "h3", "x")), None, base)  # the whole table was to be replaced
    with pytest.raises(store.Conflict):
        table.drop_partition("k", base)


def test_a_key_that_another_writer_put_elsewhere_refuses(spark, table):
    table.upsert(record(spark, ("a", "k", "h1", "one")), "doc_id")
    base = table.snapshot()
    table.upsert(record(spark, ("new", "l", "h2", "first")), "doc_id")
    with pytest.raises(store.Conflict):
        table.upsert(record(spark, ("new", "m", "h2", "second")), "doc_id", base=base)
    table.upsert(record(spark, ("new", "m", "h2", "second")), "doc_id")
    assert held(table) == [("a", "k", "one"), ("new", "m", "second")]


def test_patches_of_one_partition_are_all_kept(spark, table):
    table.upsert(record(spark, *[(f"d{i}", "k", f"h{i}", "pending") for i in range(4)]), "doc_id")
    catalog = store.DocumentCatalog(table)
    assert at_once(*[lambda i=i: catalog.finalize(f"d{i}", i) for i in range(4)]) == [None] * 4
    assert sorted((r.doc_id, r.status, r.chunk_count) for r in table.read().collect()) == [(f"d{i}", "completed", i) for i in range(4)]


def test_one_of_equal_records_is_created(spark, table):
    catalog = store.DocumentCatalog(table)
    raised = at_once(*[lambda i=i: catalog.create(record(spark, (f"d{i}", "k", "same", "pending"))) for i in range(3)])
    assert sorted(type(e).__name__ for e in raised) == ["FileExistsError", "FileExistsError", "NoneType"] and table.read().count() == 1


def test_seeding_at_once(spark, tmp_path):
    tables = [store.Table(spark, f"file://{tmp_path}/{n}", s, p) for n, s, p in (("k", schemas.KNOWLEDGE_BASES, None), ("a", schemas.CHUNKS, "kb_id"), ("b", schemas.CATALOG, "kb_id"))]
    bases = store.KnowledgeBases(*tables)
    assert at_once(*[lambda i=i: bases.seed(f"t{i}") for i in range(4)]) == [None] * 4
    assert [r.kb_id for r in bases.list().collect()] == ["default"]


@pytest.mark.parametrize("step", ["_claim", "_rename"])
def test_a_writer_that_dies_leaves_the_version_before(spark, table, monkeypatch, step):
    table.upsert(record(spark, ("a", "k", "h", "one")), "doc_id")

    def dies(*_):
        raise SystemError("killed")

    with monkeypatch.context() as m:
        m.setattr(store.Table, step, dies)
        with pytest.raises(SystemError):
            table.upsert(record(spark, ("a", "k", "h", "two"), ("b", "k", "h2", "two")), "doc_id")
    assert table.version() == 1 and held(table) == [("a", "k", "one")]
    table.upsert(record(spark, ("c", "k", "h3", "three")), "doc_id")
    assert table.version() == 2 and held(table) == [("a", "k", "one"), ("c", "k", "three")]


def test_readers_never_see_a_part(spark, table):
    """While versions follow each other each read has the rows of one version."""
    table.commit(record(spark, *[(f"d{i}", f"k{i}", "h", "0") for i in range(3)]))
    seen, over = [], threading.Event()

    def read():
        while not over.is_set():
            seen.append({r.status for r in table.read().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 4):
        table.commit(record(spark, *[(f"d{i}", f"k{i}", "h", str(n)) for i in range(3)]))
    over.set()
    reader.join()
    assert seen and all(len(s) == 1 for s in seen)


def test_names_of_partitions(spark, table):
    odd = ["a b", "x=y", "p/q", "50%", "ü", ""]
    table.upsert(record(spark, *[(f"d{i}", kb, "h", "one") for i, kb in enumerate(odd)]), "doc_id")
    assert set(table.folders()) == set(odd)
    assert table.patch(F.col("kb_id") == "p/q", {"status": F.lit("two")}) == 1
    assert [r[2] for r in held(table)] == ["one", "one", "two", "one", "one", "one"]
    table.drop_partition("x=y")
    assert table.read().count() == 5 and table.read(["50%"]).count() == 1


def test_the_rename_of_other_file_systems(spark, table):
    """Where there are no hard links: the file system's own rename, which does not overwrite."""
    table.clear()
    fs, path = table._fs()
    for name in ("mine", "yours"):
        fs.create(path(f"{table.path}/current/_{name}"), False).close()
    assert table._rename_without_links(f"{table.path}/current/_mine", f"{table.path}/current/7") and not table._rename_without_links(f"{table.path}/current/_yours", f"{table.path}/current/7")
    assert table.version() == 7


def test_a_catalogue_file_of_any_state(spark, tmp_path):
    path = tmp_path / "catalog.json"
    assert store.catalog_file(spark, str(path)).count() == 0
    for body in ("", "{", "[1, 2]", '{"records": 5}', '{"other": []}', '{"records": [{"doc_id": "a"', "null"):
        path.write_text(body)
        assert store.catalog_file(spark, str(path)).count() == 0, body
    path.write_text('{"records": [{"doc_id": "a", "kb_id": "k", "content_hash": "h", "ingestion_status": "completed", "source_paths": ["x", "y"], "user_metadata": {"t": "1"}, "more": 1},\n {"doc_id": "b", "collection_name": "c"}, {"kb_id": "z"}]}')
    rows = {r.doc_id: r.asDict() for r in store.catalog_file(spark, str(path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"] == {"doc_id": "a", "kb_id": "k", "content_hash": "h", "collection_name": "chunks", "status": "completed", "source_paths": ["x", "y"], "user_metadata": {"t": "1"}, "chunk_count": None}
    assert rows["b"]["collection_name"] == "c" and rows["b"]["status"] is None
    table = store.Table(spark, f"file://{tmp_path}/t", schemas.CATALOG)
    store.DocumentCatalog(table).create(store.catalog_file(spark, str(path)))
    assert table.read().count() == 2
