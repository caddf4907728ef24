"""Registered queries of ingestion, artifacts and request helpers, over whole tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.functions import filters, text
from quillstone.operators import answers, artifacts, context, dedup, ingest, parse, retrieve
from quillstone.plans import derive
from quillstone.plans.catalogue import _HITS, _STRIP, _hits, _split_sql, joined_map, query
from quillstone.schemas import CATALOG, CHUNKS
from quillstone.sources import files, store
from quillstone.sources.shared import numbered, shared_dir

NOW = "2024-01-01T00:00:00+00:00"
_PLACE = "('0x' || substr(md5(w), 1, 8))::BIGINT % 64"


@query(f"""WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM benchmark), c AS (
  SELECT item_id, {_PLACE} AS place, count(*)::DOUBLE AS n FROM w WHERE w <> '' GROUP BY ALL)
SELECT item_id, place, round((n / sqrt(sum(n * n) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 5) AS value FROM c""")
def embed_texts(spark, d):
    rows = derive.table(spark, d, "benchmark").select("item_id", F.posexplode(text.hashed_embedding(F.col("text"))).alias("place", "v"))
    return rows.where("v > 0").select("item_id", F.col("place").cast("long").alias("place"), F.round(F.col("v").cast("double"), 5).alias("value"))


@query(f"""WITH {derive.DOCUMENTS}, p AS ({_split_sql(2000, 200)})
SELECT docs.doc_id, p.chunk_id, p.chunk_index, p.text, docs.source_path, docs.doc_id || '.txt' AS filename, docs.kb_id, docs.language, 'sha256' AS algorithm, 'completed' AS status,
       concat_ws(';', 'lang=' || m_lang, 'quality=' || m_quality, 'source=' || m_source, 'toxic=' || m_toxic) AS metadata
FROM p JOIN docs ON docs.doc_id = p.doc_id::VARCHAR""")
def chunk_payload(spark, d):
    docs = derive.documents(spark, d).withColumn("canonical_doc_id", F.col("doc_id")).withColumn("content_hash", text.content_hash(F.col("text"))).withColumnRenamed("text", "content_text")
    c = ingest.document_chunks(docs, NOW)
    return c.select("doc_id", "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "source_path", "filename", "kb_id", "language", F.col("content_hash_algorithm").alias("algorithm"), F.col("ingestion_status").alias("status"), joined_map(F.col("user_metadata")).alias("metadata"))


_TURNS = "turns AS (SELECT conv_id, turn, role, {strip} AS t FROM conversations)".format(strip=_STRIP.format("regexp_replace(text, '[\\r\\n]+', ' ', 'g')"))


def _turns(spark, d):
    return derive.table(spark, d, "conversations").select("conv_id", "turn", "role", text.strip(F.regexp_replace("text", r"[\r\n]+", " ")).alias("t"))


@query(f"""WITH {_TURNS}, s AS (SELECT 'c' || conv_id || '#s' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS doc_id, 'c' || conv_id AS source, role, t AS text FROM turns WHERE t <> ''),
p AS ({_split_sql(2000, 200, "s")}) SELECT source AS doc_id, chunk_id, role AS section_path, p.text FROM p JOIN s ON s.doc_id = p.doc_id""")
def markdown_ingest(spark, d):
    """Conversations as Markdown, a heading a turn."""
    kept = _turns(spark, d).where("t <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "t"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["t"])), "\n")
    docs = kept.groupBy("conv_id").agg(body.alias("content_text")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_path"), F.lit("Talk").alias("page_title"), "content_text")
    return ingest.ingest_markdown(docs, NOW).select("doc_id", "chunk_id", "section_path", "text")


@query(f"""WITH {_TURNS}, s AS (SELECT 'c' || conv_id || '#p' || turn AS doc_id, 'c' || conv_id AS source_path, turn, t AS text FROM turns WHERE t <> ''),
p AS ({_split_sql(2000, 200, "s")}) SELECT p.doc_id, chunk_id, 'Page ' || turn AS section_path, source_path, p.text FROM p JOIN s ON s.doc_id = p.doc_id""")
def pdf_page_ingest(spark, d):
    """Conversations as documents in pages, a turn a page."""
    kept = _turns(spark, d).where("t <> ''")
    docs = kept.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("int").alias("page"), F.col("t").alias("text"))).alias("pages"))
    docs = docs.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source_path"), F.lit("Talk").alias("page_title"), "pages")
    return ingest.ingest_pdf_pages(docs, NOW).select("doc_id", "chunk_id", "section_path", "source_path", "text")


_SAYS = _STRIP.format("regexp_replace(role || ' says ' || regexp_replace(t, '[\\[\\]{}<>|=_'']', ' ', 'g'), '[ \t]+', ' ', 'g')")


@query(f"""WITH {_TURNS}, s AS (SELECT 'dump.xml#' || (conv_id * 1000 + turn) AS doc_id, role, {_SAYS} AS text FROM turns WHERE t <> ''),
p AS ({_split_sql(2000, 200, "s")}) SELECT p.doc_id, chunk_id, role AS page_title, p.text FROM p JOIN s ON s.doc_id = p.doc_id""")
def wiki_ingest(spark, d):
    """Turns as wiki pages with bold text, a link, a template and a comment; a turn's own marks become blanks."""
    kept = _turns(spark, d).where("t <> ''").withColumn("t", F.regexp_replace("t", r"[\[\]{}<>|=_']", " "))
    markup = F.concat(F.lit("{{box|a={{b}}}}'''"), F.col("role"), F.lit("''' [[Verb|says]] "), F.col("t"), F.lit("<!-- end -->[[Category:Talk]]"))
    pages = kept.select(F.lit("dump.xml").alias("source_path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), F.col("role").alias("title"), markup.alias("text"))
    return ingest.ingest_wiki(pages, NOW).select("doc_id", "chunk_id", "page_title", "text")


@query(f"""WITH {_TURNS}, s AS (SELECT 'c' || conv_id || '/' || turn || '.txt' AS doc_id, turn, t AS text FROM turns WHERE t <> ''),
p AS ({_split_sql(2000, 200, "s")}) SELECT p.doc_id, chunk_id, turn || '.txt' AS filename, 'default' AS kb_id, '{NOW}' AS ingestion_timestamp, p.text FROM p JOIN s ON s.doc_id = p.doc_id""")
def text_ingest(spark, d):
    kept = _turns(spark, d)  # empty ones are left out by the guard
    docs = kept.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("source_path"), F.lit("Turn").alias("page_title"), F.col("t").alias("content_text"))
    return ingest.ingest_texts(docs, NOW).select("doc_id", "chunk_id", "filename", "kb_id", "ingestion_timestamp", "text")


@query("""SELECT 'img/' || p_partkey AS doc_id, md5('img/' || p_partkey || '_img_0') AS chunk_id, 'Image: ' || p_partkey || '.png' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Description: seen /files/' || p_partkey || '.png'
  ELSE 'File: /files/' || p_partkey || '.png' END AS text, '/files/' || p_partkey || '.png' AS image_path FROM part""")
def image_ingest(spark, d):
    number = F.col("p_partkey").cast("string")
    images = derive.table(spark, d, "part").select(F.concat(F.lit("/files/"), number, F.lit(".png")).alias("file_path"), F.concat(F.lit("img/"), number).alias("source_path"), F.lit("Part").alias("page_title"))
    even = lambda path: F.when(F.regexp_extract(path, r"(\d)\.png$", 1).isin("0", "2", "4", "6", "8"), F.concat(F.lit("seen "), path)).otherwise("")
    # the describer of this query sees paths alone, that of a document's images their structs
    rows = ingest.ingest_images(images, NOW, even)
    return rows.select("doc_id", "chunk_id", "text", "image_path")


@query(f"WITH {derive.CHUNKS} SELECT chunk_id, CASE WHEN label = 0 THEN '2020' ELSE '{NOW}' END AS ingestion_timestamp FROM chunks")
def raw_chunk_ingest(spark, d):
    c = derive.chunks(spark, d).withColumn("ingestion_timestamp", F.when(F.try_element_at("user_metadata", F.lit("label")) == "0", F.lit("2020")))
    return ingest.ingest_chunks(c, NOW).select("chunk_id", "ingestion_timestamp")


@query("""SELECT page_id, i.n::BIGINT AS ordinal, CASE i.n WHEN 0 THEN 'heading' WHEN 1 THEN 'text' WHEN 2 THEN 'table' ELSE 'image' END AS element_type, CASE WHEN i.n = 0 THEN '' ELSE 'Top' END AS heading_path,
CASE i.n WHEN 2 THEN url END AS table_markdown, CASE i.n WHEN 3 THEN url END AS image_path FROM pages, (VALUES (0), (1), (2), (3)) i(n) WHERE url <> ''""")
def structural_elements(spark, d):
    """Four labelled items and a blank one of each page."""
    labels = F.array(*map(F.lit, ("title", "code", "table", "figure", "paragraph")))
    top = F.array(F.struct(F.lit("title").alias("label"), F.lit("Top").alias("text")), F.struct(F.lit("group").alias("label"), F.lit("no").alias("text")))
    items = derive.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.posexplode(labels).alias("ordinal", "label"))
    items = items.withColumn("text", F.when(F.col("ordinal") == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("path"), F.lit(" ")))).withColumn("ancestors", F.when(F.col("ordinal") > 0, top))
    e = parse.structural_elements(items.withColumn("image_uri", F.col("path")))
    return e.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), "element_type", F.array_join("heading_path", "/").alias("heading_path"), "table_markdown", "image_path")


@query("""SELECT page_id, 0::BIGINT AS ordinal, 'text' AS element_type, url AS text, NULL::INT AS page FROM pages WHERE page_id % 2 = 0 UNION ALL
SELECT page_id, n - 1, 'text', 'p' || n, n::INT FROM pages, (VALUES (1::BIGINT), (2::BIGINT)) v(n) WHERE page_id % 2 = 1 UNION ALL
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT, 'image', 'alt', NULL FROM pages""")
def default_elements(spark, d):
    odd, page = F.col("page_id") % 2 == 1, lambda n: F.struct(F.lit(n).alias("page"), F.lit(f"p{n}").alias("text"))
    image = F.struct(F.lit("i.png").alias("src"), F.lit("").alias("alt"), F.lit("alt").alias("caption"), F.lit("").alias("surrounding_text"))
    parsed = derive.table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("url").alias("content_text"), F.when(odd, F.array(page(1), page(2))).alias("pages"), F.array(image).alias("images"))
    return parse.default_elements(parsed).select(F.col("path").alias("page_id"), F.col("ordinal").cast("long").alias("ordinal"), "element_type", "text", "page")


_TITLE = "regexp_extract(left(text, 500), '(?m)^[A-Z][A-Za-z0-9 :—–/-]{5,80}$')"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Given title' WHEN trim({_TITLE}) <> '' THEN trim({_TITLE}) ELSE 'My File ' || doc_id END AS title FROM documents""")
def pdf_titles(spark, d):
    given = F.when(F.col("doc_id") % 3 == 0, "Given title").when(F.col("doc_id") % 3 == 1, "/tmp/x.pdf").otherwise("abc")
    path = F.concat(F.lit("/a/my_file-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return derive.table(spark, d, "documents").select("doc_id", parse.pdf_title(given, F.col("text"), path).alias("title"))


_MARKED = "text || ' – — ‘a’ “b” • … ™ © ® Ж'"


@query("SELECT doc_id, regexp_replace(" + "".join("replace(" for _ in text.PLAIN_MARKS) + _MARKED + "".join(f", '{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in text.PLAIN_MARKS.items()) + ", '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM documents")
def pdf_clean_text(spark, d):
    return derive.table(spark, d, "documents").select("doc_id", text.pdf_safe(F.concat(F.col("text"), F.lit(" – — ‘a’ “b” • … ™ © ® Ж"))).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'application/pdf' WHEN regexp_matches(url, '\\.html?$') THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, page_id % 10 = 0 AS is_scanned, page_id % 10 = 0 AS needs_ocr FROM pages")
def detect_files(spark, d):
    """The type that a detector gives every fifth page, else that of the name; half of the former have hardly a character a page."""
    pages = derive.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    pages = pages.withColumn("path", F.when(F.col("path").rlike(r"\.html?$"), F.col("path")).otherwise(F.concat(F.col("path"), F.lit(".bin"))))
    seen = F.when(F.col("page_id") % 5 == 0, F.struct(F.lit("application/pdf").alias("content_type"), F.lit("en").alias("language"), F.create_map(F.lit("pdf:charsPerPage"), F.when(F.col("page_id") % 10 == 0, "3,0").otherwise("900,20")).alias("metadata")))
    found = files.detect(pages, lambda _: seen)
    return found.select("page_id", "content_type", "is_scanned", files.needs_ocr(True, F.col("content_type"), F.col("is_scanned")).alias("needs_ocr"))


@query(f"WITH {derive.DOCUMENTS} SELECT doc_id FROM docs WHERE source_path LIKE '/src3/%' AND doc_id NOT LIKE '1%'")
def filter_array_match(spark, d):
    """Any element matches; an empty array does not exist."""
    docs = derive.documents(spark, d).withColumn("source_paths", F.when(F.startswith("doc_id", F.lit("1")), F.array().cast("array<string>")).otherwise(F.array("source_path", F.lit("/copy"), F.concat(F.lit("/by/"), F.try_element_at("user_metadata", F.lit("source"))))))
    p = filters.compile_filters([{"field": "source_paths", "value": "/by/src3"}, {"field": "source_paths", "operator": "exists"}, {"field": "source_paths", "operator": "in", "value": ["/copy", "/x"]}])
    return docs.where(p).select("doc_id")


@query(f"""WITH {_HITS}, t AS (SELECT query_id, 'F' || (doc_id % 2) AS name, page_title, lang, '/a/' || page_title || '.txt' AS path, rank FROM hits),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, name, path ORDER BY rank) AS n FROM t), e AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY rank) AS k FROM f WHERE n = 1)
SELECT query_id, name, string_agg(path || ':' || name || ':' || lang || '=' || page_title, ',' ORDER BY rank) AS metadata FROM e WHERE k <= 2 GROUP BY ALL""")
def citation_metadata(spark, d):
    hits = _hits(spark, d).withColumn("filename", F.concat(F.lit("F"), (F.col("doc_id") % 2).cast("string")))
    entry = F.transform("metadata", lambda e: F.concat_ws(":", e["source"], e["title"], joined_map(e["user_metadata"])))
    return context.citations(hits, per_citation=2).select("query_id", "name", F.array_join(entry, ",").alias("metadata"))


@query(f"""WITH {_HITS}, t AS (SELECT query_id, page_title || '.txt' AS name, text, min(rank) AS rank FROM hits GROUP BY ALL),
g AS (SELECT query_id, name, min(rank) AS first, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS doc FROM t GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS k FROM g)
SELECT query_id, md5(string_agg(CASE WHEN length(doc) > 2000 THEN left(doc, 2000) || '...' ELSE doc END, '|' ORDER BY k)) AS documents, chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || k || '] ' || name || chr(10), '' ORDER BY k) AS sources
FROM n GROUP BY query_id""")
def source_list(spark, d):
    s = context.source_list(context.citations(_hits(spark, d).withColumn("filename", F.lit(""))))
    return s.select("query_id", F.md5(F.array_join("documents", "|").cast("binary")).alias("documents"), "sources")


@query(f"""WITH {derive.DOCUMENTS}, {derive.UPLOADS}
SELECT kb_id AS job_id, count(*)::BIGINT AS pages, count(*) FILTER (status = 'accepted')::BIGINT AS new_pages, count(*) FILTER (status <> 'accepted')::BIGINT AS known_pages FROM uploads GROUP BY kb_id""")
def import_counts(spark, d):
    old, incoming = derive.upload_history(spark, d)
    return ingest.import_counts(dedup.upload_status(incoming, old, "seq").select(F.col("kb_id").alias("job_id"), "status"))


@query("SELECT event_id AS request_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_profiles(spark, d):
    return artifacts.latest_profiles(derive.table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("timestamp"))).select("request_id")


@query("""WITH j AS (SELECT o_custkey AS artifact_id, min(o_orderkey) AS job_id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey)
SELECT c_custkey AS artifact_id, job_id, o_orderstatus AS status FROM customer LEFT JOIN j ON c_custkey = artifact_id LEFT JOIN orders ON o_orderkey = job_id""")
def artifact_jobs(spark, d):
    source = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("artifact:"), F.col("o_custkey").cast("string"))).otherwise("upload")
    jobs = derive.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), source.alias("source"))
    made = artifacts.artifact_jobs(derive.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("artifact_id")), jobs)
    return made.select(F.col("artifact_id").cast("long").alias("artifact_id"), "job_id", "status")


@query("SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = e.user_id AND c.event_type = 'error')")
def cancel_points(spark, d):
    e = derive.table(spark, d, "events")
    jobs = e.where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.lit("CANCELLING").alias("status")).distinct()
    return artifacts.cancel_points(e.select(F.col("user_id").alias("job_id"), "event_id"), jobs).select(F.col("job_id").alias("user_id"), "event_id")


@query(f"""WITH {derive.SCORED}, {derive.recall_sql("top", 20)}, p AS (SELECT query_id, source_path, min(rank) AS first, arg_min(page_title, rank) AS t FROM top GROUP BY ALL)
SELECT query_id, '# Documents' || chr(10) || chr(10) || string_agg('- ' || t || ' (' || source_path || ')', chr(10) ORDER BY first) || chr(10) AS file FROM p GROUP BY query_id""")
def markdown_artifact(spark, d):
    chunks = derive.chunks(spark, d)
    hits = retrieve.payload(retrieve.cosine_recall(derive.questions(spark, d), chunks, 20), chunks, "source_path", "page_title")
    return artifacts.document_list(hits).select("query_id", artifacts.markdown(F.lit("Documents"), F.col("content")).alias("file"))


@query("""SELECT conv_id, turn, NOT regexp_full_match(text, ' *') AS has_content, starts_with(text, '### Task:') AS bypass FROM conversations""")
def request_guards(spark, d):
    c = derive.table(spark, d, "conversations")
    return c.select("conv_id", "turn", filters.has_content(F.col("text"), F.array().cast("array<string>")).alias("has_content"), filters.asks_for_task(F.col("text")).alias("bypass"))


@query("SELECT o_orderkey, starts_with(CASE WHEN o_orderkey % 3 = 0 THEN 'v2_' || o_orderstatus ELSE o_orderstatus END, 'v2_') AS current FROM orders")
def current_jobs(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("v2_"), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    return derive.table(spark, d, "orders").select("o_orderkey", filters.current_jobs(kind).alias("current"))


@query("SELECT url AS path, row_number() OVER (ORDER BY url, page_id)::BIGINT AS place FROM pages WHERE regexp_matches(url, '\\.html?$')")
def sorted_listing(spark, d):
    """Files in order of path, PDFs left out; the limit is not set."""
    pages = derive.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), files.classify(F.col("url")).alias("type")).where(F.col("path").rlike(r"\.html?$"))
    return numbered(files.listing(pages, ("pdf",)), "place", "path", "page_id").select("path", "place")


@query("""SELECT doc_id, kb_id, CASE WHEN doc_id::BIGINT % 4 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN doc_id::BIGINT % 4 = 0 THEN 7::BIGINT END AS chunk_count
FROM (SELECT doc_id::VARCHAR AS doc_id, 'kb' || (substr(source, 4)::INT % 4) AS kb_id FROM documents) WHERE kb_id <> 'kb2'""")
def catalog_records(spark, d):
    """The records that inserts, a finalisation and the removal of a knowledge base leave."""
    records = store.DocumentCatalog(store.Table(spark, f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", CATALOG))
    rows = derive.documents(spark, d).select("doc_id", "kb_id", F.lit("pending").alias("status"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG if f.name not in ("doc_id", "kb_id", "status", "content_hash")], text.content_hash(F.concat("doc_id", F.lit(":"), "text")).alias("content_hash"))
    records.create(rows)
    records.table.patch(F.col("doc_id").cast("long") % 4 == 0, {"status": F.lit("completed"), "chunk_count": F.lit(7).cast("long")})
    records.delete_kb("kb2")
    return records.table.read().select("doc_id", "kb_id", "status", "chunk_count")


@query(f"WITH {derive.CHUNKS} SELECT chunk_id, kb_id, CASE kb_id WHEN 'kb0' THEN 'first' WHEN 'kb2' THEN 'second' ELSE page_title END AS page_title FROM chunks WHERE kb_id <> 'kb3'")
def concurrent_commits(spark, d):
    """What two writers and a removal leave that all began with one version and touch partitions of their own."""
    table = store.Table(spark, f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}")
    c = derive.chunks(spark, d)
    table.commit(c.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNKS if f.name not in c.columns]))
    base = table.snapshot()
    for kb, title in (("kb0", "first"), ("kb2", "second")):
        table.commit(table.read([kb], base).withColumn("page_title", F.lit(title)), [kb], base)
    table.drop_partition("kb3", base)
    return table.read().select("chunk_id", "kb_id", "page_title")


@query(f"WITH {derive.CHUNKS} SELECT chunk_id, doc_id, text FROM chunks WHERE chunk_id > '2' ORDER BY chunk_id LIMIT 1000")
def chunk_scroll(spark, d):
    """The page of 1,000 chunks after a cursor, from a clustered table."""
    table = store.Table(spark, f"{shared_dir(spark)}/scroll-{uuid.uuid4().hex}")
    c = derive.chunks(spark, d)
    table.commit(c.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNKS if f.name not in c.columns]))
    table.cluster(rows_per_file=10_000)
    return table.scroll("2", 1000).select("chunk_id", "doc_id", "text")


@query("""WITH t AS (SELECT conv_id, turn, role, translate(text, '[]', '()') AS t FROM conversations),
c AS (SELECT *, CASE WHEN contains(t, '.') THEN length(t) - strpos(reverse(t), '.') + 1 WHEN contains(t, chr(10)) THEN length(t) - strpos(reverse(t), chr(10)) + 1 ELSE 0 END AS cut FROM t),
s AS (SELECT *, substr(t || ' ', cut + 1) AS rest FROM c)
SELECT conv_id, turn, sha256(t || '  and more') AS clean, sha256(t || ' [1] and more') AS compat, (cut + length(rest) - length(regexp_replace(rest, '^\\s+', '')))::VARCHAR || '-' || (length(t) + 1) || ':0' AS refs FROM s""")
def turn_marks(spark, d):
    """A mark after the whole text of each turn: its reference begins with the turn's last sentence."""
    said = F.concat(F.translate("text", "[]", "()"), F.lit(" ["), F.upper("role"), F.lit("] and more"))
    marks = answers.source_marks()(said, F.array(F.concat("role", F.lit(".md"))), F.array().cast("array<array<string>>"))
    refs = F.array_join(F.transform("m.refs", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["stop"].cast("string"), F.lit(":"), r["citation"].cast("string"))), ";")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return derive.table(spark, d, "conversations").select("conv_id", "turn", marks.alias("m")).select("conv_id", "turn", digest("m.clean").alias("clean"), digest("m.compat").alias("compat"), refs.alias("refs"))
