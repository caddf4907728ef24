"""From parsed documents to rows of the chunk store: the payload of each chunk, and the paths of ingestion by format. All are projections over the chunk builder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone import registry
from quillstone.functions.filters import has_content
from quillstone.functions.text import basename, hashed_embedding
from quillstone.operators.chunk import MOST, OVERLAP, image_chunks, text_chunks
from quillstone.operators.parse import markdown_sections, wikitext
from quillstone.operators.remote import ATTEMPTS, PAUSE, attempt, called
from quillstone.schemas import CHUNKS, DEFAULT_KB
from quillstone.sources.files import classify, image_magic

_IMAGES = "array<struct<src:string,alt:string,caption:string,surrounding_text:string,vlm_description:string>>"
EMBED_BATCH = 100


def _column(docs: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in docs.columns else default


def no_description(image: Column) -> Column:
    """The describer where there is no vision model: nothing."""
    return F.lit("")


def own_description(image: Column) -> Column:
    """The describer of images that have theirs by now (with_descriptions)."""
    return image["vlm_description"]


def document_chunks(docs: DataFrame, now: str, most: int = MOST, overlap: int = OVERLAP, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """docs (canonical_doc_id, content_text, and what they have of the payload's columns, images) to chunks with the whole payload but for the vector: text chunks, then those of images.

    Documents without text and images give none. The text chunks are those of the registered chunker. describe: an image's struct to its description (without one, the registered describer); where that is empty its
    surroundings stand for it.
    """
    describe = describe or registry.resolve("vlm_describer", no_description)
    none = lambda kind="string": F.lit(None).cast(kind)
    canonical = F.col("canonical_doc_id")
    path = _column(docs, "source_path", canonical)
    paths = _column(docs, "source_paths", F.array(path))
    paths = F.when(F.size(paths) > 0, paths).otherwise(F.array(path))
    digest = _column(docs, "content_hash", none())
    images = F.col("images") if "images" in docs.columns else none(_IMAGES)
    field = lambda i, n: F.coalesce(i[n], F.lit(""))
    told = F.transform(images, lambda i: F.struct(*[field(i, n).alias(n) for n in ("src", "alt", "caption", "surrounding_text")], F.coalesce(describe(i), F.lit("")).alias("vlm_description")))
    rows = docs.select(
        canonical.alias("canonical_doc_id"), _column(docs, "content_text", F.lit("")).alias("content_text"), F.coalesce(told, F.array().cast(_IMAGES)).alias("images"), _column(docs, "doc_id", canonical).alias("doc_id"),
        F.get(paths, F.lit(0)).alias("source_path"), paths.alias("source_paths"), _column(docs, "page_title", F.lit("")).alias("page_title"), _column(docs, "section_path", F.lit("")).alias("section_path"),
        _column(docs, "language", F.lit("en")).alias("language"), F.lit(now).alias("ingestion_timestamp"), _column(docs, "kb_id", F.lit(DEFAULT_KB)).alias("kb_id"), _column(docs, "filename", basename(path)).alias("filename"),
        _column(docs, "content_size", none("long")).cast("long").alias("content_size"), _column(docs, "ingestion_status", F.lit("completed")).alias("ingestion_status"), _column(docs, "created_at", none()).alias("created_at"),
        _column(docs, "user_metadata", none("map<string,string>")).alias("user_metadata"), digest.alias("content_hash"), F.when(digest.isNotNull(), F.lit("sha256")).alias("content_hash_algorithm"), none().alias("metadata_updated_at"),
    ).where(has_content(F.col("content_text"), F.col("images")))
    texts = registry.resolve("chunker", text_chunks)(rows.drop("images"), "canonical_doc_id", "content_text", most, overlap).withColumn("image_path", none())
    pictures = image_chunks(rows.drop("content_text"), "canonical_doc_id")
    names = [n for n in CHUNKS.fieldNames() if n != "embedding"]
    return texts.select(*names).unionByName(pictures.select(*names))


def embedded(chunks: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """chunks with their vectors, in the store's columns. embedder: a column function of the text; without one, the registered one."""
    return chunks.withColumn("embedding", (embedder or registry.resolve("embedder", hashed_embedding))(F.col("text"))).select(*CHUNKS.fieldNames())


def remote_embedder(
    call: Callable[[list[str]], list[list[float]]], dim: int, batch: int = EMBED_BATCH, attempts: int = ATTEMPTS, pause: float = PAUSE, again: tuple[type[BaseException], ...] = (TimeoutError,),
) -> Callable[[Column], Column]:
    """An embedder of a remote model that takes a list of texts; each distinct text of an Arrow batch is sent once. A batch that fails with one of ``again`` is sent anew after ``pause`` * 2**n seconds; one that fails
    for good goes text by text, and a text that fails is an error. When the model can't be reached (ConnectionError), what is left of the Arrow batch gets zeros, which no search finds."""

    def vectors(texts: list[str]) -> Iterator[list[float]]:
        for at in range(0, len(texts), batch):
            some = texts[at : at + batch]
            try:
                try:
                    yield from attempt(call, some, attempts, pause, again)
                except ConnectionError:
                    raise
                except Exception:  # whatever the model refuses a batch for
                    for text in some:
                        yield attempt(call, [text], attempts, pause, again)[0]
            except ConnectionError:
                yield from ([0.0] * dim for _ in texts[at:])
                return

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            wanted = [t or "" for t in texts.to_pylist()]
            distinct = list(dict.fromkeys(wanted))
            known = dict(zip(distinct, vectors(distinct), strict=False))
            yield pa.array([known[t] for t in wanted], pa.list_(pa.float32()))

    return run


def described(found: DataFrame, call: Callable[[bytes], str], **limits) -> DataFrame:
    """found (path, content: files) to (path, description): what ``call`` says of each distinct picture. Empty where it fails, for a path of another type, and for content that is no picture. limits: as of remote.called."""
    picture = F.col("content").isNotNull() & (classify(F.col("path")) == "image") & image_magic(F.col("content"))
    return called(found, F.when(picture, F.col("content")), call, "description", **limits).select("path", "description")


def with_descriptions(docs: DataFrame, descriptions: DataFrame, key: str = "canonical_doc_id") -> DataFrame:
    """docs (``key``, images array<struct<src,...>>) whose images have as vlm_description that of their src, empty without one; descriptions (path, description), one a path. key tells the documents apart."""
    one = docs.select(key, F.posexplode("images").alias("place", "image")).join(descriptions.select(F.col("path").alias("src_of_image"), "description"), F.col("image.src") == F.col("src_of_image"), "left")
    image = F.struct(*[F.col(f"image.{n}").alias(n) for n in ("src", "alt", "caption", "surrounding_text")], F.coalesce("description", F.lit("")).alias("vlm_description"))
    told = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", image.alias("image")))).alias("told"))
    out = docs.drop("images").join(told, key, "left").withColumn("images", F.coalesce(F.transform("told", lambda t: t["image"]), F.array().cast(_IMAGES)))
    return out.drop("told").select(*docs.columns)


def ingest_texts(docs: DataFrame, now: str) -> DataFrame:
    """docs (source_path, page_title, content_text, ...): plain text or the content of HTML, one document a path."""
    return document_chunks(docs.withColumn("canonical_doc_id", F.col("source_path")), now)


def ingest_markdown(docs: DataFrame, now: str) -> DataFrame:
    """docs (source_path, page_title, content_text: Markdown): chunked by section, section_path its heading. The section's number is part of the canonical id, so that no section overwrites another."""
    parts = docs.select("*", F.posexplode(markdown_sections(F.col("content_text"))).alias("section", "s")).drop("content_text")
    parts = parts.withColumn("content_text", F.col("s.content")).withColumn("section_path", F.col("s.heading")).withColumn("doc_id", F.col("source_path"))
    return document_chunks(parts.withColumn("canonical_doc_id", F.concat_ws("#s", "source_path", F.col("section").cast("string"))).drop("s", "section"), now)


def ingest_pdf_pages(docs: DataFrame, now: str) -> DataFrame:
    """docs (source_path, page_title, pages array<struct<page,text>>): a document a page, section Page N."""
    parts = docs.select("*", F.explode("pages").alias("p")).drop("pages")
    parts = parts.withColumn("content_text", F.col("p.text")).withColumn("section_path", F.concat(F.lit("Page "), F.col("p.page").cast("string")))
    return document_chunks(parts.withColumn("canonical_doc_id", F.concat(F.col("source_path"), F.lit("#p"), F.col("p.page").cast("string"))).drop("p"), now)


def ingest_wiki(pages: DataFrame, now: str, convert: bool = True) -> DataFrame:
    """pages (source_path, page_id, title, text: wiki markup): a document a page."""
    body = wikitext(F.col("text")) if convert else F.col("text")
    docs = pages.withColumn("content_text", body).withColumn("page_title", F.col("title")).drop("text", "title")
    return document_chunks(docs.withColumn("canonical_doc_id", F.concat_ws("#", "source_path", F.col("page_id").cast("string"))).drop("page_id"), now)


def ingest_images(images: DataFrame, now: str, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """images (file_path, source_path, page_title): one chunk each, with the image's description, else its path."""
    told = F.coalesce((describe or registry.resolve("vlm_describer", no_description))(F.col("file_path")), F.lit(""))
    last = F.when(told != "", F.concat(F.lit("Description: "), told)).otherwise(F.concat(F.lit("File: "), F.col("file_path")))
    rows = document_chunks(images.withColumn("canonical_doc_id", F.col("source_path")).withColumn("images", F.array(F.struct(F.col("file_path").alias("src"), *[F.lit("").alias(n) for n in ("alt", "caption", "surrounding_text")]))), now)
    text = images.select(F.col("source_path").alias("doc_id"), F.concat(F.lit("Image: "), basename(F.col("file_path")), F.lit("\n"), last).alias("told")).distinct()
    return rows.join(text, "doc_id").withColumn("text", F.col("told")).drop("told")


def ingest_chunks(chunks: DataFrame, now: str) -> DataFrame:
    """Ready chunks: only a missing ingestion_timestamp is filled in."""
    return chunks.withColumn("ingestion_timestamp", _column(chunks, "ingestion_timestamp", F.lit(now)))


def import_counts(results: DataFrame) -> DataFrame:
    """results (job_id, status) of an import's pages: pages that came through, new ones, and known ones."""
    new, known = F.col("status") == "accepted", F.col("status").isin("already_exists", "metadata_updated")
    return results.groupBy("job_id").agg(F.count_if(new | known).alias("pages"), F.count_if(new).alias("new_pages"), F.count_if(known).alias("known_pages"))
