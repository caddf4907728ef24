"""The engine's operators on small fixtures, with the results that their definitions fix."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone import registry, schemas
from quillstone.functions import filters, text
from quillstone.operators import answers, catalog, chunk, context, dedup, jobs, parse, retrieve
from quillstone.sources import files, store

META = "user_metadata map<string,string>"


@pytest.fixture(scope="module")
def boards(spark):
    rows = [
        ("1", "doc1.md", "kb", [1.0, 0.0], "Aura SOM uses 2.8W power", "Aura Specs", "/d/doc1.md", "doc1.md", {"board": "aura", "tenant": "acme"}),
        ("2", "doc2.md", "kb", [0.8, 0.6], "Bora SOM uses 3.5W power", "Bora Specs", "/d/doc2.md", "doc2.md", {"board": "bora", "tenant": "acme"}),
        ("3", "doc3.md", "other", [0.6, 0.8], "Acme top secret board uses 1.0W power", "Secret Specs", "/d/doc3.md", "doc3.md", {"board": "secret", "tenant": "globex"}),
    ]
    schema = f"chunk_id string, doc_id string, kb_id string, embedding array<float>, text string, page_title string, source_path string, filename string, {META}, content_size long, ingestion_status string, created_at string, content_hash string"
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)


@pytest.fixture(scope="module")
def query(spark):
    return spark.createDataFrame([(1, [1.0, 0.0], "aura power")], "query_id int, query_vector array<float>, question string")


def one(df, column):
    return sorted(r[column] for r in df.collect())


def test_hard_filters(boards, query):
    find = lambda f: one(retrieve.search(query, boards, 10, f, mode="hard"), "chunk_id")
    assert find(None) == ["1", "2", "3"]
    assert find([{"field": "tenant", "value": "acme"}]) == ["1", "2"]
    assert find([{"field": "tenant", "value": "acme"}, {"field": "user_metadata.board", "value": "aura"}]) == ["1"]
    assert find([{"field": "tenant", "value": "globex"}]) == ["3"]
    assert find([{"field": "tenant", "operator": "neq", "value": "acme"}]) == ["3"]
    assert find([{"field": "missing", "operator": "neq", "value": "x"}]) == ["1", "2", "3"]
    assert find([{"field": "board", "operator": "contains", "value": "or"}]) == ["2"]
    assert find([{"field": "board", "operator": "in", "value": 3}]) == ["1", "2", "3"]  # left out
    assert find([{"field": "board", "operator": "nonsense", "value": 3}]) == ["1", "2", "3"]


def test_soft_mode_adds_the_boost(boards, query):
    rows = {r.chunk_id: r for r in retrieve.search(query, boards, 10, [{"field": "board", "value": "secret"}]).collect()}
    assert rows["3"]._score == pytest.approx(0.7) and rows["3"]._match_reasons == ["semantic", "metadata:board"]
    assert rows["1"]._score == pytest.approx(1.0) and rows["1"]._match_reasons == ["semantic"]
    only = {r.chunk_id: r for r in retrieve.search(query, boards, 1, [{"field": "board", "value": "bora"}]).collect()}
    assert set(only) == {"1"}  # 1.0 beats 0.8 + 0.1
    kb = {r.chunk_id: r._score for r in retrieve.search(query, boards, 10, None, ["other"]).collect()}
    assert len(kb) == 3 and kb["3"] == pytest.approx(0.6)
    assert set(one(retrieve.search(query, boards, 10, None, ["other"], strict_kb=True), "chunk_id")) == {"3"}


def test_zero_vectors_are_not_recalled(spark, query):
    c = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 1.0]), ("c", None)], "chunk_id string, embedding array<float>")
    assert one(retrieve.cosine_recall(query, c, 5), "chunk_id") == ["b"]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, doc_id string, source_path string, text string, question string, _score double")


def test_diversity(spark):
    rows = [(1, i, str(i), "noisy" if i != 6 else "relevant", None, f"t{i}", "q", 1.0 - i / 100) for i in range(1, 21)] + [(1, 30 + i, f"n{i}", "", None, "x", "q", 0.1) for i in range(5)]
    kept = retrieve.diversity(hits(spark, rows)).collect()
    assert sorted(r.chunk_id for r in kept) == sorted(["1", "2", "3", "6"] + [f"n{i}" for i in range(5)])
    assert retrieve.diversity(hits(spark, rows), 0).count() == 25
    assert retrieve.fetch_k(10) == 50 and retrieve.fetch_k(1) == 50


def test_hybrid(spark):
    reranked = hits(spark, [(1, i + 1, f"r{i}", "d", None, f"text{i}", "q", 1.0) for i in range(6)])
    vector = hits(spark, [(1, 1, "v0", "d", None, "text0", "q", 1.0), (1, 2, "v1", "d", None, "new", "q", 1.0), (1, 3, "v2", "d", None, "late", "q", 1.0)])
    pick = lambda m, n: [r.chunk_id for r in sorted(retrieve.hybrid(reranked, vector, m, n).collect(), key=lambda r: (r.source, r.pos))]
    assert pick(4, 2) == ["r0", "r1", "r2", "r3", "v1"]
    assert pick(0, 2) == ["v0", "v1"] and pick(3, 0) == ["r0", "r1", "r2"] and pick(0, 0) == []


def test_rerank_merges_batches_and_falls_back(spark):
    h = hits(spark, [(1, i + 1, str(i), "d", None, str(i), "q", 0.5) for i in range(6)])
    table = {"0": 0.70, "1": 0.95, "2": 0.1, "3": 0.60, "4": 0.2, "5": 0.90}
    scorer = lambda q, t: F.create_map(*[F.lit(x) for p in table.items() for x in p])[t]
    best = sorted(retrieve.rerank(h, 3, scorer, batch=3).collect(), key=lambda r: r.rank)
    assert [(r.chunk_id, r._score) for r in best] == [("1", 0.95), ("5", 0.90), ("0", 0.70)]
    none = retrieve.rerank(h, 3, lambda q, t: F.lit(None).cast("double"))
    assert [(r.chunk_id, r._score) for r in sorted(none.collect(), key=lambda r: r.rank)] == [("0", 0.5), ("1", 0.5), ("2", 0.5)]


def test_metrics(spark):
    h = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, item string, rank int")
    e = spark.createDataFrame([(1, "b"), (3, "z")], "query_id int, item string")
    got = {r.query_id: (r.recall, r.precision) for r in retrieve.metrics(h, e, 2).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0), 3: (0, 0.0)}


def test_catalogue(boards):
    assert one(catalog.metadata_keys(boards), "key") == ["board", "tenant"]
    assert [(r.value, r.documents) for r in catalog.metadata_values(boards, "user_metadata.tenant").collect()] == [("acme", 2), ("globex", 1)]
    assert catalog.metadata_values(boards, "language").count() == 0
    assert one(catalog.list_documents(boards, {"tenant": "acme"}), "doc_id") == ["doc1.md", "doc2.md"]
    assert one(catalog.discover(boards, "DOC?.md"), "doc_id") == ["doc1.md", "doc2.md", "doc3.md"]
    assert one(catalog.discover(boards, "DOC?.md", case_sensitive=True), "doc_id") == []
    assert one(catalog.discover(boards, "doc*", ["other"]), "doc_id") == ["doc3.md"]


@pytest.mark.parametrize(
    ("value", "most", "overlap"),
    [("Line 1\nLine 2. Sentence 1. Sentence 2. Word1 Word2 Word3", 10, 0), ("This is a very long sentence that should be split with some overlap.", 20, 5), ("x" * 95, 20, 5), ("long " * 20 + "end", 50, 200)],
)
def test_pieces_fit(value, most, overlap):
    got = chunk.split_text(value, most, overlap)
    assert len(got) > 1 and all(0 < len(p) <= most for p in got)


def test_pieces_of_odd_texts():
    assert chunk.split_text("   ", 10) == [""] and chunk.split_text("a" * 10, 10) == ["a" * 10]
    assert len(chunk.split_text("word " * 50_000, 50, 5)) > 5000
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("ab \n.é😀") for _ in range(rng.randrange(120)))
        assert all(len(p) <= 12 for p in chunk.split_text(t, 12, 4))


def test_chunk_rows(spark):
    d = spark.createDataFrame([("a", "Short.\n\n" + "long " * 20 + "end\n\n \n\nLast"), ("b", ""), ("c", None)], "id string, body string")
    rows = sorted(chunk.text_chunks(d, "id", "body", 50).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].text == "Short." and rows[-1].text == "Last" and {r.id for r in rows} == {"a"}


def test_image_text(spark):
    image = F.struct(*[F.lit(v).alias(n) for n, v in (("src", "a.png"), ("alt", "A"), ("caption", ""), ("surrounding_text", "near"), ("vlm_description", ""))])
    assert spark.range(1).select(chunk.image_text(image)).first()[0] == "Image: a.png\nAlt text: A\nContext: near"


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    slug = lambda s: f(text.slugify(F.lit(s)))
    assert [slug(s) for s in ("Engineering", "Engineering Docs", "Q1 / 2026 -- Reports!", "  -hello-  ", "a" * 200, "", "?!")] == ["engineering", "engineering-docs", "q1-2026-reports", "hello", "a" * 64, None, None]
    assert f(text.stem_title(F.lit("/x/my-cool_file.v2.md"))) == "My Cool File.V2" and f(text.stem_title(F.lit("a-b c1d x.y"))) == "A B C1D X"
    assert f(text.normalize(F.lit(" a \t b\n \n \nc "))) == "a b\n\nc"
    assert f(text.token_estimate(F.lit(""))) == 1 and f(text.sanitize_question(F.lit(" \"it's\" "))) == "its"
    assert f(text.pdf_safe(F.lit("“a”… 漢"))) == '"a"... ?'


def test_metadata_limits(spark):
    f = lambda m: spark.createDataFrame([(m,)], f"m map<string,string>").select(filters.metadata_errors(F.col("m"))).first()[0]  # noqa: E731, F541
    assert f({"a": "x" * 300}) == ["long_value"] and f({str(i): "v" for i in range(25)}) == ["too_many_keys"] and f({str(i): "x" * 255 for i in range(20)}) == ["too_large"]
    assert f({"author": "a"}) == [] and f({}) == [] and f(None) == []


def test_html():
    page = "<html lang='en-US'><head><title> My T </title></head><body><nav>n</nav><div id='content'><p>One</p><script>x</script><p>Two</p><figure><img src=a.png alt=A><figcaption>Cap</figcaption></figure><img src=logo.png></div><footer>f</footer></body></html>"
    got = parse.parse_html(page)
    assert got["content"] == "One\nTwo\nCap" and got["title"] == "My T" and got["language"] == "en"
    assert [(i["src"], i["alt"], i["caption"]) for i in got["images"]] == [("a.png", "A", "Cap")]
    assert parse.parse_html("<main>M</main><div id=mw-content-text>W</div>")["content"] == "W"
    assert parse.parse_html("<div class='x mw-parser-output'>P</div>")["content"] == "P" and parse.parse_html("plain")["content"] is None
    assert parse.parse_html("<html xml:lang='DE'><body>b<!-- c --></body>") == {"content": "b", "title": "", "language": "de", "images": []}


def test_markdown(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    md = F.lit("Intro text\n# Heading 1\nContent 1\n## Empty\n### H3\nContent 2")
    assert [(s.heading, s.content) for s in f(parse.markdown_sections(md))] == [("", "Intro text"), ("Heading 1", "Content 1"), ("H3", "Content 2")]
    assert f(parse.markdown_text(md)) == "Intro text\n\n## Heading 1\n\nContent 1\n\n## H3\n\nContent 2"
    assert f(parse.markdown_title(F.lit("no head"), F.lit("my-cool-file.md"))) == "My Cool File" and f(parse.markdown_title(md, F.lit("x"))) == "Heading 1"


def test_wikitext(spark):
    f = lambda s: spark.createDataFrame([(s,)], "t string").select(parse.wikitext(F.col("t"))).first()[0]
    cases = {
        "== Head ==\ntext": "Head\ntext", "'''bold''' ''it''": "bold it", "[[A|B]] [[C]]": "B C", "a{{x|{{y}}}}b": "ab", "a<ref>z</ref>b<ref name=q/>c": "abc", "[[Category:X]]t": "t",
        "[[File:a.png|thumb]]t": "t", "[http://x.y label] [http://z]": "label", "__NOTOC__t": "t", "a\n\n\n\nb": "a\n\nb", "x <b>y</b>": "x y",
    }
    assert {k: f(k) for k in cases} == cases
    assert f("before\n{| class=w\n! h1 !! h2\n|-\n| style=s | a || b\n|}\nafter") == "before\nh1\nh2\na\nb\nafter"


def test_wiki_export(spark, tmp_path):
    page = lambda i, ns, texts: f"<page><title>P{i}</title><ns>{ns}</ns><id>{i}</id>{''.join(f'<revision><id>{k}</id><timestamp>t{k}</timestamp><text xml:space=\"preserve\">{t}</text></revision>' for k, t in enumerate(texts))}</page>"
    (tmp_path / "w.xml").write_text("<mediawiki xmlns=\"http://x/\">" + page(42, 0, ["old", "[[File:db_schema.png]] new"]) + page(43, 1, ["talk"]) + page(44, 6, ["file"]) + "</mediawiki>")
    rows = {r.page_id: r for r in files.read_wiki_export(spark, str(tmp_path / "w.xml")).collect()}
    assert set(rows) == {42, 44} and rows[42].text.endswith("new") and rows[42].timestamp == "t1"


def test_files(spark, tmp_path):
    for name, body in (("a.html", "x"), ("b", "<!DOCTYPE html>"), ("c.md", "# T"), ("d.bin", "z")):
        (tmp_path / name).write_text(body)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "e.txt").write_text("q")
    assert sorted((r.path.rsplit("/", 1)[1], r.type) for r in files.discover(spark, str(tmp_path)).collect()) == [("a.html", "html"), ("b", "html"), ("c.md", "markdown")]
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(files.skipped(F.lit("s3://b/Talk:x.md"))) and f(files.skipped(F.lit("/a/node_modules/x.md"))) and not f(files.skipped(F.lit("/a/Talk.md")))
    url = lambda p: f(files.canonical_url(F.lit(p), "/m", "https://w.org"))
    assert [url(p) for p in ("/m/w.org/index.html", "/m/w.org/about.html", "/m/w.org/other/page.htm", "/else/x.html")] == ["https://w.org", "https://w.org/about", "https://w.org/other/page", ""]
    meta = lambda **m: F.create_map(*[F.lit(x) for p in m.items() for x in (p[0].replace("_", ":"), p[1])])
    scanned = lambda **m: f(files.scanned_pdf(F.lit("application/pdf"), meta(**m)))
    assert scanned(pdf_totalChars="0") and not scanned(pdf_totalChars="12000") and scanned(pdf_charsPerPage="3, 4") and not scanned(pdf_charsPerPage="3, x")
    assert f(files.mime_type(F.lit("a.md"))) == "text/markdown" and f(files.mime_type(F.lit("a.zz"), F.lit("image/png"))) == "image/png"


def test_store(spark, tmp_path, boards):
    table = store.Table(spark, f"file://{tmp_path}/t")
    full = boards.withColumns({n: F.lit(None).cast(t) for n, t in (("source_paths", "array<string>"), ("section_path", "string"), ("chunk_index", "int"), ("chunk_type", "string"), ("language", "string"), ("image_path", "string"), ("ingestion_timestamp", "string"), ("content_hash_algorithm", "string"), ("metadata_updated_at", "string"))})
    assert table.read().count() == 0
    table.commit(full)
    table.commit(store.delete_metadata(table.read(), {"tenant": "acme"}))
    assert one(table.read(), "doc_id") == ["doc3.md"]
    assert store.delete_metadata(full, {}).count() == 3
    small = store.Table(spark, f"file://{tmp_path}/k", schemas.KNOWLEDGE_BASES, None)
    cat = store.Table(spark, f"file://{tmp_path}/c", schemas.CATALOG)
    kbs = store.KnowledgeBases(small, table, cat)
    kbs.seed("t")
    kbs.seed("t")
    kbs.create("other", "Other", "t")
    with pytest.raises(FileExistsError):
        kbs.create("other", "Other", "t")
    with pytest.raises(ValueError):
        kbs.delete("default")
    with pytest.raises(LookupError):
        kbs.delete("nope")
    assert kbs.delete("other") == 1 and [r.kb_id for r in kbs.list().collect()] == ["default"] and table.read().count() == 0


def test_budget_skips_and_truncates(spark):
    rows = [(1, 1, "T", "a" * 60), (1, 2, "T", "b" * 60), (1, 3, "T", "c" * 30), (1, 4, "U", "d"), (1, 5, "V", "e"), (2, 1, "T", "f" * 5000)]
    got = context.budget(spark.createDataFrame(rows, "query_id int, rank int, page_title string, text string"), titles=2, chars=3000).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    assert next(r.text for r in got if r.query_id == 2) == "f" * 2000 + " [TRUNCATED]"
    long = [(1, 1, "T", "a" * 2500), (1, 2, "T", "b" * 900), (1, 3, "T", "c" * 300)]
    kept = context.budget(spark.createDataFrame(long, "query_id int, rank int, page_title string, text string"), chars=3000).collect()
    assert {r["rank"] for r in kept} == {1, 3}


def test_prompt_and_citations(spark):
    rows = [(1, 1, "A", "/x/a.md", "one", {"k": "1"}), (1, 2, "B", "/x/b.md", "two", None), (1, 3, "A", "/x/a.md", "one", {"k": "2"}), (1, 4, "A", "/y/a.md", "three", None)]
    h = spark.createDataFrame(rows, f"query_id int, rank int, page_title string, source_path string, text string, {META}").withColumn("filename", F.lit(None).cast("string"))
    prompt = context.prompts(context.group_sources(h)).first().prompt
    assert "one\n\n---\n\nthree" in prompt and "- k: 2" in prompt and prompt.index("[A]") < prompt.index("[B]") and "do not have sufficient evidence" in prompt
    c = {r.name: r for r in context.citations(h).collect()}
    assert c["a.md"].documents == ["one", "three"] and c["a.md"].paths == ["/x/a.md", "/y/a.md"] and c["b.md"].position == 2
    assert context.citations(h, most=1).count() == 1 and {len(r.paths) for r in context.citations(h, per_citation=1).collect()} == {1}


def test_grounding(spark):
    rows = [(1, "power rated board [Specs]"), (2, "power [Document 9]"), (3, "I cannot answer that"), (4, "totally different things [Specs]"), (5, "a b c")]
    a = spark.createDataFrame(rows, "query_id int, answer string").withColumns({"titles": F.array(F.lit("Specs")), "context": F.lit("power rated for the board specs"), "chunks": F.lit(2)})
    got = {r.query_id: r for r in context.grounding(a).collect()}
    assert [got[i].grounded for i in range(1, 6)] == [True, False, True, False, False]
    assert got[2].citations_found == ["Document 9"] and got[2].warnings == ["invalid citations"] and got[5].overlap_score == 0.0


def test_marks():
    got = answers.mark_sources("First. Second part [Specs.PDF] and [none]. New\nline [specs]", ["Specs.pdf"])
    assert got["compat"] == "First. Second part [1] and [none]. New\nline [1]" and got["clean"] == "First. Second part  and [none]. New\nline "
    assert [got["clean"][r["start"] : r["stop"]] for r in got["refs"]] == ["Second part ", "New\nline "]
    assert answers.mark_sources("x [the specs.pdf file]", ["Specs.pdf"], fuzzy=True)["refs"] and not answers.mark_sources("x [the specs.pdf file]", ["Specs.pdf"])["refs"]


def test_jobs(spark):
    runs = {"done": ["start", "stage:a", "stage:b", "complete", "fail"], "early": ["complete", "stage:a"], "cancel": ["start", "cancel", "complete", "cancel", "cancelled"], "failed": ["start", "cancel", "fail", "cancel"]}
    rows = [(j, i, *(e.split(":") + [None])[:2]) for j, es in runs.items() for i, e in enumerate(es)]
    got = {r.job_id: r for r in jobs.job_states(spark.createDataFrame(rows, "job_id string, seq int, event string, stage string")).collect()}
    assert {k: r.status for k, r in got.items()} == {"done": "COMPLETED", "early": "PENDING", "cancel": "CANCELLED", "failed": "FAILED"}
    assert got["done"].stages_completed == ["a"] and got["done"].current_stage == "b"


def test_streams(spark, tmp_path):
    from quillstone.streaming import ingest

    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", "same"), ("b.txt", "same"), ("c.txt", "other")):
        (tmp_path / "in" / name).write_text(body)
    seen = []
    ingest.ingest(ingest.new_files(spark, str(tmp_path / "in"), "kb"), lambda df: seen.extend(r.doc_id for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 2 == len(set(seen))
    rows = [("j", 0, "start", None), ("j", 1, "stage", "a"), ("j", 2, "stage", "b"), ("k", 0, "complete", None)]
    spark.createDataFrame(rows, "job_id string, seq int, event string, stage string").write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("job_id string, seq int, event string, stage string").parquet(str(tmp_path / "events"))
    q = ingest.job_state_stream(events).writeStream.format("memory").queryName("job_rows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.job_id: r for r in spark.table("job_rows").collect()}
    assert got["j"].status == "RUNNING" and got["j"].current_stage == "b" and got["j"].stages_completed == "a" and got["k"].status == "PENDING"


def test_registry():
    registry.register("of a test", "low", 1)
    registry.register("of a test", "high", 5)
    registry.register("of a test", "later", 5)
    assert registry.get("of a test") == "later" and registry.resolve("of a test", "x") == "later" and registry.resolve("no such", "x") == "x"
    with pytest.raises(KeyError):
        registry.get("nothing")


def test_store_writes_the_partitions_that_it_touches(spark, tmp_path, boards):
    columns = {n: F.lit(None).cast(t) for n, t in (("source_paths", "array<string>"), ("section_path", "string"), ("chunk_index", "int"), ("chunk_type", "string"), ("language", "string"), ("image_path", "string"), ("ingestion_timestamp", "string"), ("content_hash_algorithm", "string"), ("metadata_updated_at", "string"))}
    table = store.chunk_table(spark, f"file://{tmp_path}/t", len(boards.first().embedding))
    full = boards.withColumns(columns)
    two = full.withColumn("kb_id", F.when(F.col("doc_id") == "doc3.md", "b").otherwise("a"))
    table.upsert(two)
    before = table.folders()
    assert set(before) == {"a", "b"} and table.read().count() == 3 and table.read(["b"]).count() == 1
    assert table.patch(F.col("doc_id") == "doc3.md", {"page_title": F.lit("new")}) == 1 and table.patch(F.lit(False), {"page_title": F.lit("x")}) == 0
    assert table.folders()["a"] == before["a"] and table.folders()["b"] != before["b"]
    table.upsert(two.where("kb_id = 'b'").withColumn("kb_id", F.lit("c")))  # the same chunk in another base: the old one goes
    assert {r.kb_id for r in table.read().collect()} == {"a", "c"} and table.read().count() == 3
    table.delete(F.col("kb_id") == "a")
    assert table.read().count() == 1
    with pytest.raises(ValueError):
        store.chunk_table(spark, f"file://{tmp_path}/t", 999)
    table.clear()
    assert table.read().count() == 0


def test_document_catalog(spark, tmp_path, boards):
    catalog_ = store.DocumentCatalog(store.Table(spark, f"file://{tmp_path}/c", schemas.CATALOG))
    rows = spark.createDataFrame([("d1", "k", "h1", "c", "pending", ["a"], {"x": "1"}, None), ("d2", "k", "h2", "c", "pending", ["b"], None, None), ("d3", "l", "h1", "c", "pending", None, None, None)], schemas.CATALOG)
    catalog_.create(rows)
    with pytest.raises(FileExistsError):
        catalog_.create(rows.limit(1))
    catalog_.finalize("d1", 5)
    assert {r.doc_id: (r.status, r.chunk_count) for r in catalog_.table.read().collect()} == {"d1": ("completed", 5), "d2": ("pending", None), "d3": ("pending", None)}
    with pytest.raises(LookupError):
        catalog_.update("none", status=F.lit("x"))
    chunks = store.Table(spark, f"file://{tmp_path}/t")
    assert not store.remove_document(chunks, catalog_, "d1") and catalog_.table.read().where("doc_id = 'd1'").isEmpty()
    assert catalog_.delete_kb("k") == 1 and catalog_.delete_kb("nope") == 0 and catalog_.table.read().count() == 1


def test_knowledge_base_update(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/k", schemas.KNOWLEDGE_BASES, None)
    kbs = store.KnowledgeBases(t, store.Table(spark, f"file://{tmp_path}/a"), store.Table(spark, f"file://{tmp_path}/b", schemas.CATALOG))
    kbs.create("kb", "Name", "t0")
    kbs.update("kb", "t1", name=" Other ", settings_json='{"a": 1}')
    assert kbs.list().first().asDict() == {"kb_id": "kb", "name": "Other", "description": "", "created_at": "t0", "updated_at": "t1", "settings_json": '{"a": 1}'}
    for wrong in ({"name": " "}, {"settings_json": "[1]"}):
        with pytest.raises(ValueError):
            kbs.update("kb", "t2", **wrong)
    with pytest.raises(LookupError):
        kbs.update("none", "t2")


def test_wiki_brackets_nest():
    plain = parse.plain_wikitext
    assert plain("a {{x|{{y}}|[[z]]}}b [[A|''B'' [[c]]]] [[File:x.png|thumb|see [[y]]]] [https://e.org the site] [https://e.org] {{open") == "a b B c the site {{open"
    assert plain("== Head ==\n{| class=x\n! a !! b\n|-\n| style=y | 1 || 2\n|}\nend__TOC__<ref>no</ref><!-- c -->") == "Head\na\nb\n1\n2\nend"


def test_request_metadata():
    assert filters.query_metadata({"metadata.a": "1", "q": "x"}, '{"a": "0", "b": "2"}') == {"a": "1", "b": "2"} and filters.query_metadata({}) is None
    for parameters, given in (({}, "{"), ({}, "[1]"), ({}, '{"a": 1}'), ({"metadata.a": "x" * 257}, None)):
        with pytest.raises(ValueError):
            filters.query_metadata(parameters, given)


def test_remote_embedder(spark):
    from quillstone.operators import ingest

    def call(texts):
        if "down" in texts:
            raise ConnectionError
        if len(texts) > 1 and "odd" in texts:
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    embed = lambda texts, batch: [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1).select(ingest.remote_embedder(call, 2, batch)(F.col("text")).alias("v")).collect()]
    assert embed(["a", "odd", "bcd"], 2) == [[1.0, 1.0], [3.0, 1.0], [3.0, 1.0]]
    assert embed(["a", "b", "down", "c"], 2) == [[1.0, 1.0], [1.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_parse_files(spark, tmp_path):
    from quillstone import capabilities

    for name, body in (("a.txt", "plain"), ("b.md", "# T\n\nbody"), ("c.html", "<html lang='fr'><head><title>H</title></head><body><p>in</p></body></html>"), ("d.pdf", "%PDF"), ("e.png", "x"), (".git/f.txt", "no"), ("page", "<!doctype html><body>bare</body>")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    pages = lambda path, content: F.struct(F.lit("").alias("title"), F.array(F.struct(F.lit(1).alias("page"), F.lit(" one ").alias("text")), F.struct(F.lit(2).alias("page"), F.lit(" ").alias("text"))).alias("pages"))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.parse_files(spark, str(tmp_path), pages).collect()}
    assert set(got) == {"a.txt", "b.md", "c.html", "d.pdf", "e.png", "page"}
    assert (got["c.html"].page_title, got["c.html"].content_text, got["c.html"].language) == ("H", "in", "fr") and got["b.md"].page_title == "T" and got["b.md"].content_text == "## T\n\nbody"
    assert [p.text for p in got["d.pdf"].pages] == ["one"] and got["e.png"].images[0].src.endswith("e.png") and got["page"].content_text == "bare"
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(files.discover(spark, str(tmp_path)), ("pdf", "image"), 2).collect()] == ["a.txt", "b.md"]
    elements = capabilities.parser_of("unknown")(files.parse_files(spark, str(tmp_path), pages))
    assert {r.path.rsplit("/", 1)[1]: r.page for r in elements.where("element_type = 'text' AND page IS NOT NULL").collect()} == {"d.pdf": 1}
    assert {"chunker", "retriever", "parser:default", "renderer:markdown", "embedder"} <= set(registry.names()) and capabilities.load_extensions("json, no_such_module_here") == ["json"]


def test_artifact_files(spark, tmp_path):
    from quillstone.operators import artifacts

    store_ = artifacts.Artifacts(spark, f"file://{tmp_path}/art")
    rows = spark.createDataFrame([("Body",)], "content string").select(artifacts.markdown(F.lit("T"), F.col("content")).alias("content"))
    store_.store("a1", rows)
    assert store_.get("a1") == "# T\n\nBody\n" and store_.get("none") is None and store_.delete("a1") and store_.get("a1") is None


def test_queries_in_blocks(spark, boards, query, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], "q") for i in range(40)] + [(99, [1.0, 2.0], "q")], "query_id long, query_vector array<float>, question string")
    chunks = spark.createDataFrame([(str(i), [float(i % 5), float(i % 4), 1.0]) for i in range(60)] + [("odd", [1.0, 1.0]), ("none", None), ("zero", [0.0, 0.0, 0.0])], "chunk_id string, embedding array<float>").repartition(3)
    whole = sorted(map(str, retrieve.cosine_recall(rows, chunks, 5).collect()))
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 200)
    assert sorted(map(str, retrieve.cosine_recall(rows, chunks, 5).collect())) == whole
    assert len(whole) == 40 * 5 + 1 and not any("zero" in r for r in whole) and sum("odd" in r for r in whole) == 1
