"""Finding and reading input files. Listing, sniffing and reading are Spark scans of binary files; nothing is opened on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import registry
from quillstone.functions.text import basename, stem_title, strip
from quillstone.operators.parse import asset_key, html_fields, markdown_text, markdown_title, pdf_title

#: Extensions by type, MIME types by extension, what a walk passes over.
TYPES = {
    "html": ("html", "htm", "xhtml"), "pdf": ("pdf",), "markdown": ("md", "markdown"), "text": ("txt", "text", "log"), "image": ("png", "jpg", "jpeg", "gif", "webp"), "mediawiki": ("xml",),
}
MIME = {"txt": "text/plain", "text": "text/plain", "log": "text/plain", "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown"}
SKIPPED_DIRS = (".git", "__pycache__", "resources", "node_modules")
SKIPPED_NAMES = ("File:", "Special:", "Category:", "Talk:", "Template:")
UNKNOWN = "application/octet-stream"
#: Bytes of a file that its type is told by, and of a file without an extension that is opened for them, at most.
SNIFFED, SNIFFED_MOST = 1024, 64 << 20


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(basename(path), "?", 1), r"\.([^.]+)$", 1))


def classify(path: Column, head: Column | None = None) -> Column:
    """The type by extension; without one by content; null if unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for kind, names in TYPES.items():
        out = out.when(extension(path).isin(*names), F.lit(kind))
    return out if head is None else out.when((extension(path) == "") & looks_like_html(head), F.lit("html"))


def _head(content: Column) -> Column:
    return F.lower(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"))


def looks_like_html(content: Column) -> Column:
    return F.contains(_head(content), F.lit("<html")) | F.contains(_head(content), F.lit("<!doctype"))


def looks_like_wiki_export(content: Column) -> Column:
    return F.contains(_head(content), F.lit("<mediawiki"))


def image_magic(content: Column) -> Column:
    h = F.hex(F.substring(content, 1, 12))
    return h.rlike("^(89504E470D0A1A0A|FFD8FF|474946383761|474946383961|52494646.{8}57454250)")


def mime_type(path: Column, hint: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    by_name = F.coalesce(F.try_element_at(known, extension(path)), F.lit(UNKNOWN))
    return by_name if hint is None else F.coalesce(F.nullif(hint, F.lit("")), by_name)


def scanned_pdf(mime: Column, metadata: Column) -> Column:
    """A PDF without characters, or with under ten a page on average; counts that can't be read don't make it one."""
    per_page = F.transform(F.split(F.try_element_at(metadata, F.lit("pdf:charsPerPage")), ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999")).cast("double"))
    readable = ~F.exists(per_page, lambda x: x.isNull())
    mean = F.aggregate(per_page, F.lit(0.0), lambda a, x: a + x) / F.size(per_page)
    none = F.try_element_at(metadata, F.lit("pdf:totalChars")).isin("0", "")
    return (mime == "application/pdf") & (F.coalesce(none, F.lit(False)) | F.coalesce(readable & (mean < 10), F.lit(False)))


def files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """The files below a path: path, modificationTime, length, content. A plan that does not ask for content opens none, and one with a filter on _metadata only those that it leaves."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found if content else found.drop("content")


def skipped(path: Column) -> Column:
    """Files of skipped directories, and pages of namespaces that hold no articles."""
    parts = F.split(path, "/")
    below = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED_DIRS))
    return below | basename(path).rlike("^(" + "|".join(SKIPPED_NAMES) + ")")


def _name_extension() -> Column:
    """The extension by the scan's own column: a filter on it drops files when they are listed, before any is opened."""
    return extension(F.col("_metadata.file_name"))


def _walked() -> Column:
    """What skipped() leaves, by the scan's own columns, so that no other file is opened."""
    below = "/(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"
    return ~F.col("_metadata.file_name").rlike("^(" + "|".join(SKIPPED_NAMES) + ")") & ~F.col("_metadata.file_path").rlike(below)


def of_type(found: DataFrame, kind: str) -> DataFrame:
    """The rows of files() that have a type; only files whose names have its extensions are opened, and for HTML those without an extension (of SNIFFED_MOST bytes at most), by whose content it is
    decided. Where the content is not asked for, none is opened."""
    names = _name_extension().isin(*TYPES[kind])
    if kind != "html":
        return found.where(names & _walked())
    bare = (_name_extension() == "") & (F.col("_metadata.file_size") <= SNIFFED_MOST)
    return found.where((names | bare) & _walked()).where(F.coalesce(classify(F.col("path"), F.col("content")) == kind, F.lit(False)))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, type) of the files below a path that are not skipped and have a known type. Only files without an extension are opened; one of more than SNIFFED_MOST bytes has no type."""
    every = files(spark, path)
    named = every.where((_name_extension() != "") & _walked()).select("path", "length", classify(F.col("path")).alias("type"))
    bare = of_type(every.where(_name_extension() == ""), "html").select("path", "length", F.lit("html").alias("type"))
    return named.unionByName(bare).where("type IS NOT NULL")


def listing(found: DataFrame, exclude: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """discover's rows in order of path, without some types, at most ``limit`` (0: all)."""
    found = found.where(~F.col("type").isin(*exclude)) if exclude else found
    found = found.orderBy("path")
    return found.limit(limit) if limit > 0 else found


_IMAGES = "array<struct<src:string,alt:string,caption:string,surrounding_text:string>>"
_PAGES, _METADATA = "array<struct<page:int,text:string>>", "map<string,string>"


def _parsed(path: Column, title: Column, text: Column, language: Column | None = None, images: Column | None = None, pages: Column | None = None, metadata: Column | None = None) -> list[Column]:
    none = lambda kind: F.lit(None).cast(kind)
    return [
        path.alias("path"), title.alias("page_title"), text.alias("content_text"), F.coalesce(language, F.lit("en")).alias("language") if language is not None else F.lit("en").alias("language"),
        (none(_IMAGES) if images is None else images).alias("images"), (none(_PAGES) if pages is None else pages).alias("pages"), (none(_METADATA) if metadata is None else metadata).alias("metadata"),
    ]


def parse_contents(found: DataFrame, kind: str, extract_pages=None) -> DataFrame:
    """found (path, content) of one type to (path, page_title, content_text, language, images, pages, metadata).

    extract_pages: a column function, path and content to struct<title:string,pages:array<struct<page,text>>,metadata:map<string,string>>, where metadata may be left out; without one a PDF has no pages.
    metadata has no null values; its Title stands for a title that is not given.
    """
    path = F.col("path")
    text = F.decode("content", "UTF-8") if "content" in found.columns else None
    if kind == "html":
        rows = found.select("path", registry.resolve("html_parser", html_fields)(text).alias("h"))
        title = F.coalesce(F.nullif("h.title", F.lit("")), stem_title(path))
        return rows.select(*_parsed(path, title, F.coalesce("h.content", F.lit("")), F.col("h.language"), F.col("h.images")))
    if kind == "markdown":
        return found.select(*_parsed(path, markdown_title(text, path), markdown_text(text)))
    if kind == "pdf":
        empty = F.struct(F.lit("").alias("title"), F.array().cast(_PAGES).alias("pages"))
        rows = found.select("path", (extract_pages(path, F.col("content")) if extract_pages else empty).alias("e"))
        pages = F.filter(F.transform("e.pages", lambda p: F.struct(p["page"].alias("page"), strip(p["text"]).alias("text"))), lambda p: p["text"] != "")
        given = F.map_filter("e.metadata", lambda k, v: v.isNotNull()) if "metadata" in rows.schema["e"].dataType.names else F.lit(None).cast(_METADATA)
        rows = rows.withColumn("metadata", F.coalesce(given, F.create_map().cast(_METADATA)))
        title = F.coalesce(F.nullif("e.title", F.lit("")), F.try_element_at("metadata", F.lit("Title")), F.lit(""))
        rows = rows.select("path", title.alias("title"), pages.alias("pages"), "metadata")
        head = F.coalesce(F.get("pages", F.lit(0))["text"], F.lit(""))
        return rows.select(*_parsed(path, pdf_title(F.col("title"), head, path), F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"), pages=F.col("pages"), metadata=F.col("metadata")))
    if kind == "image":
        image = F.array(F.struct(path.alias("src"), F.lit("").alias("alt"), F.lit("").alias("caption"), F.lit("").alias("surrounding_text"))).cast(_IMAGES)
        return found.select(*_parsed(path, stem_title(path), F.lit(""), images=image))
    return found.select(*_parsed(path, stem_title(path), F.coalesce(text, F.lit(""))))


def no_pages(path: Column, content: Column) -> Column:
    """The extractor where there is no PDF library: a document without title and pages."""
    return F.struct(F.lit("").alias("title"), F.array().cast(_PAGES).alias("pages"))


def no_layer(found: DataFrame) -> DataFrame:
    """The preprocessor where there is no recognition: files as they are."""
    return found


def parse_files(spark: SparkSession, path: str, extract_pages=None) -> DataFrame:
    """All files of known types below a path, parsed by their types (wiki exports have a reader of their own). The folder is listed once and each file opened by its type's scan alone; images, and PDFs where
    nothing extracts their pages, are not opened. extract_pages: without one, the registered extractor; the registered preprocessor gets the PDFs (path, content) before it."""
    every, out = files(spark, path), None
    extract_pages, layer = extract_pages or registry.resolve("pdf_extractor", no_pages), registry.resolve("ocr_preprocessor", no_layer)
    extract_pages = None if extract_pages is no_pages else extract_pages
    for kind in (k for k in TYPES if k != "mediawiki"):
        found = of_type(every, kind)
        found = found.select("path") if kind == "image" else found.select("path", "content") if kind != "pdf" or extract_pages else found.select("path", F.lit(None).cast("binary").alias("content"))
        part = parse_contents(layer(found) if kind == "pdf" and extract_pages else found, kind, extract_pages)
        out = part if out is None else out.unionByName(part)
    return out


def detect(found: DataFrame, detector=None) -> DataFrame:
    """found (path, ...) with content_type, language, metadata and is_scanned. detector: a column function, path to struct<content_type:string,language:string,metadata:map<string,string>>; where it
    gives nothing, or there is none, the type is that of the extension."""
    kind = "struct<content_type:string,language:string,metadata:map<string,string>>"
    rows = found.withColumn("detected", detector(F.col("path")) if detector else F.lit(None).cast(kind))
    rows = rows.withColumn("content_type", mime_type(F.col("path"), F.col("detected.content_type"))).withColumn("language", F.col("detected.language")).withColumn("metadata", F.col("detected.metadata")).drop("detected")
    return rows.withColumn("is_scanned", F.coalesce(scanned_pdf(F.col("content_type"), F.col("metadata")), F.lit(False)))


def needs_ocr(enabled: bool, content_type: Column, is_scanned: Column) -> Column:
    """Scanned PDFs, where recognition is enabled."""
    return F.lit(enabled) & F.coalesce(content_type == "application/pdf", F.lit(False)) & F.coalesce(is_scanned, F.lit(False))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_title, content_text) of plain text files."""
    text = F.decode("content", "UTF-8")
    return files(spark, path).select("path", stem_title(F.col("path")).alias("page_title"), text.alias("content_text"))


def read_wiki_export(spark: SparkSession, path: str, namespaces: tuple[int, ...] = (0, 6)) -> DataFrame:
    """(page_id, title, namespace, text, timestamp) of a MediaWiki export: the last revision of each page; split by page, so an export of any size is read in parallel."""
    schema = "id long, ns int, title string, revision array<struct<timestamp:string,text:struct<_VALUE:string>>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    last = F.try_element_at("revision", F.lit(-1))
    rows = pages.select(F.coalesce("id", F.lit(0)).alias("page_id"), "title", F.coalesce("ns", F.lit(0)).alias("namespace"), F.coalesce(last["text"]["_VALUE"], F.lit("")).alias("text"), last["timestamp"].alias("timestamp"))
    return rows.where(F.col("namespace").isin(*namespaces))


def asset_index(listing: DataFrame) -> DataFrame:
    """listing (root, walk, path): one path per lower-cased file name: the first of a root, of several roots the last."""
    key = asset_key(basename(F.col("path")))
    first = listing.withColumn("key", key).groupBy("root", "key").agg(F.min_by("path", "walk").alias("path"))
    return first.groupBy("key").agg(F.max_by("path", "root").alias("path"))


def canonical_url(path: Column, base_dir: str, base_url: str) -> Column:
    """The address of a mirrored page: the path below the base and its domain directory, without index.html or the extension; outside the base empty."""
    root = base_dir.rstrip("/") + "/"
    below = F.substr(path, F.lit(len(root) + 1))
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace(below, r"^[^/]+/", ""), r"(^|/)index\.html?$", ""), r"\.html?$", "")
    return F.when(F.startswith(path, F.lit(root)), F.when(page == "", F.lit(base_url.rstrip("/"))).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), page))).otherwise(F.lit(""))
