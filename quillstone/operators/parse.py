"""Parsing: HTML, Markdown and wiki text to plain text, elements to documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import stem_title, strip

#: Elements that are no content, and where content is looked for, in this order.
DROPPED = ("nav", "footer", "script", "style", "aside", "header")
SELECTORS = ("#content", "#mw-content-text", "main", ".mw-parser-output", "body")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MOST_CONTEXT = 200

HTML = "struct<content:string,title:string,language:string,images:array<struct<src:string,alt:string,caption:string,surrounding_text:string>>>"
_IMAGE = pa.struct([(n, pa.string()) for n in ("src", "alt", "caption", "surrounding_text")])
_HTML = pa.struct([("content", pa.string()), ("title", pa.string()), ("language", pa.string()), ("images", pa.list_(_IMAGE))])


class _Reader(HTMLParser):
    """Open elements as a stack. Kept texts stand in one list, of which an element has a stretch: what was added from its start to its end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.dropped = 0
        self.roots: dict[str, dict] = {}
        self.kept: list[str] = []
        self.title: list[str] | None = None
        self.in_title = False
        self.language = ""
        self.images: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html" and not self.language:
            self.language = a.get("lang") or a.get("xml:lang") or ""
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        node = {"tag": tag, "from": len(self.kept), "to": None, "caption": None}
        if tag in DROPPED and tag not in _VOID:
            self.dropped += 1
        if not self.dropped:
            classes = a.get("class", "").split()
            for s in SELECTORS:
                if s not in self.roots and (s == tag or s[0] == "#" and a.get("id") == s[1:] or s[0] == "." and s[1:] in classes):
                    self.roots[s] = node
            if tag == "img" and a.get("src") and not re.search("icon|logo", a["src"].lower()):
                figure = next((n for n in reversed(self.stack) if n["tag"] == "figure"), None)
                self.images.append({"src": a["src"], "alt": a.get("alt", ""), "figure": figure, "parent": self.stack[-1] if self.stack else None})
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i]["tag"] == tag), None)
        if at is not None:
            for node in self.stack[at:]:
                self.dropped -= node["tag"] in DROPPED
                node["to"] = len(self.kept)
                if node["tag"] == "figcaption":
                    figure = next((n for n in reversed(self.stack[:at]) if n["tag"] == "figure"), None)
                    if figure is not None:
                        figure["caption"] = "".join(self._texts(node)).strip()
            del self.stack[at:]

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is not None:
            self.title.append(data)
        if not self.dropped:
            self.kept.append(data)

    def _texts(self, node: dict) -> list[str]:
        return self.kept[node["from"] : node["to"]]

    def result(self) -> dict:
        found = next((self._texts(self.roots[s]) for s in SELECTORS if s in self.roots), None)
        images = [
            {"src": i["src"], "alt": i["alt"], "caption": (i["figure"] or {}).get("caption") or "", "surrounding_text": "".join(self._texts(i["parent"])).strip()[:_MOST_CONTEXT] if i["parent"] else ""}
            for i in self.images
        ]
        content = None
        if found is not None:
            content = re.sub(r"\n\s*\n", "\n\n", re.sub(r"[ \t]+", " ", "\n".join(found))).strip()
        return {"content": content, "title": "".join(self.title or []).strip(), "language": (self.language.split("-")[0] or "en").lower(), "images": images}


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _open_kept(html: str) -> str:
    """Marks that begin no reference with its semicolon become references of themselves."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", html)


def parse_html(html: str, closed_only: bool = False) -> dict:
    """content (null without any of the selectors), title, language (default en) and images of a page.

    A browser decodes some references without their semicolon too (``&amp`` and ``&copy=1``), and so does this; with ``closed_only`` they stay as they are written.
    """
    reader = _Reader()
    reader.feed(_open_kept(html) if closed_only else html)
    reader.close()
    return reader.result()


def html_fields(html: Column, closed_only: bool = False) -> Column:
    @F.arrow_udf(HTML)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([None if p is None else parse_html(p, closed_only) for p in pages.to_pylist()], _HTML)

    return run(html)


def html_title(html: Column) -> Column:
    """The stripped title, natively; as it is written (no character references)."""
    return strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))


def html_language(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?i)<html\b([^>]*)>", 1)
    named = lambda n: F.nullif(F.regexp_extract(tag, rf"(?i)(?<![:\w]){n}\s*=\s*[\"']?([^\"'\s>-]+)", 1), F.lit(""))
    return F.lower(F.coalesce(named("lang"), named("xml:lang"), F.lit("en")))


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, content>>: what stands before the first heading has the heading "". Sections without content are left out.

    Headings are made into marks, so that the split is native.
    """
    marked = F.regexp_replace(text, r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    section = lambda p, i: F.struct(
        F.when(i > 0, F.substring_index(p, "\u0002", 1)).otherwise(F.lit("")).alias("heading"), strip(F.when(i > 0, F.regexp_replace(p, "(?s)^[^\u0002]*\u0002", "")).otherwise(p)).alias("content")
    )
    return F.filter(F.transform(parts, section), lambda s: s["content"] != "")


def markdown_text(text: Column) -> Column:
    join = lambda s: F.when(s["heading"] == "", s["content"]).otherwise(F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), s["content"]))
    return F.array_join(F.transform(markdown_sections(text), join), "\n\n")


def markdown_title(text: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, r"(?m)^#[ \t]+(\S.*)$", 1)), F.lit("")), stem_title(path))


_MARKUP = re.compile(
    r"(?P<gone><!--.*?-->|<(?P<raw>nowiki|ref)\b[^>]*(?<!/)>.*?</(?P=raw)>|<[^<>]+>|__[A-Z]+__|'{2,5})"
    r"|(?P<open>\{\{|\[\[|\[(?=https?://))|(?P<shut>\}\}|\]\]|\])", re.S | re.I,
)
#: Links of these namespaces are no text.
_NO_TEXT = ("file:", "image:", "category:")


def _resolved(opener: str, inner: str) -> str:
    """What stays of a bracket's content: nothing of a template, the label of a link."""
    if opener == "{{":
        return ""
    if opener == "[":
        return inner.partition(" ")[2]
    return "" if inner.strip().lower().startswith(_NO_TEXT) else inner.partition("|")[2] or inner.rstrip("|")


def _without_markup(text: str) -> str:
    """Brackets of all kinds resolved from the inside out, by one pass with a stack; what never closes stays as it is."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    for m in _MARKUP.finditer(text):
        stack[-1][1].append(text[at : m.start()])
        at = m.end()
        if m["open"]:
            stack.append((m["open"], []))
        elif m["shut"]:
            opener, parts = stack[-1]
            if opener and m["shut"] == {"{{": "}}", "[[": "]]", "[": "]"}[opener]:
                stack.pop()
                stack[-1][1].append(_resolved(opener, "".join(parts)))
            else:
                parts.append(m["shut"])
    stack[-1][1].append(text[at:])
    while len(stack) > 1:
        opener, parts = stack.pop()
        stack[-1][1].append(opener + "".join(parts))
    return "".join(stack[0][1])


def plain_wikitext(text: str) -> str:
    """Plain text of wiki markup: markup first, then line by line; of a table its cells, one a line, without attributes."""
    out, table = [], False
    for line in _without_markup(text).split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            table = True
        elif table and bare.startswith("|}"):
            table = False
        elif table:
            if bare[:1] in ("|", "!") and not bare.startswith("|-"):
                cells = bare[1:].split("!!" if bare[0] == "!" else "||")
                out += [c for c in ((x.partition("|")[2] if "|" in x else x).strip() for x in cells) if c]
        else:
            marks = min(len(bare) - len(bare.lstrip("=")), len(bare) - len(bare.rstrip("=")), 6)
            out.append(bare[marks:-marks].strip() if marks and bare.strip("=") else line)
    text = re.sub(r"[ \t]{2,}", " ", "\n".join(out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def wikitext(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([None if p is None else plain_wikitext(p) for p in pages.to_pylist()], pa.string())

    return run(text)


def file_references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[\[(?:File|Image):([^|\]]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), strip))


def asset_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(strip(name), " ", "_"))


def pdf_title(metadata_title: Column, text: Column, path: Column) -> Column:
    """A meaningful title of the metadata, else the first line that looks like a heading near the start, else the file's name."""
    given = F.when((F.length(strip(metadata_title)) > 3) & ~F.startswith(metadata_title, F.lit("/")), strip(metadata_title))
    return F.coalesce(given, F.nullif(strip(F.regexp_extract(F.substring(text, 1, 500), r"(?m)^([A-Z][A-Za-z0-9 :—–/-]{5,80})$", 1)), F.lit("")), stem_title(path))


#: A structural parser's labels and the element types that they are; any other is text.
ELEMENT_TYPES = {
    "title": "heading", "section_header": "heading", "paragraph": "text", "text": "text", "table": "table", "picture": "image", "figure": "image", "caption": "text", "formula": "text",
    "list_item": "text", "page_header": "text", "page_footer": "text", "footnote": "text", "code": "text",
}


def structural_elements(items: DataFrame) -> DataFrame:
    """items (path, ordinal, label, text, ancestors array<struct<label,text>>, image_uri, ...) of any structural parser as canonical elements: typed by label, blank ones left out, the
    texts of ancestors that are headings as the path, tables with their text as Markdown. Other columns (page, bbox) stay."""
    types = F.create_map(*[F.lit(x) for pair in ELEMENT_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(types, F.col("label")), F.lit("text"))
    headings = F.filter("ancestors", lambda a: a["label"].isin("title", "section_header") & (F.coalesce(a["text"], F.lit("")) != ""))
    rows = items.withColumn("element_type", kind).withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    rows = rows.withColumn("heading_path", F.coalesce(F.transform(headings, lambda a: a["text"]), F.array().cast("array<string>")))
    of = lambda t, c: F.when(F.col("element_type") == t, F.col(c))
    return rows.withColumn("table_markdown", of("table", "text")).withColumn("image_path", of("image", "image_uri")).drop("label", "ancestors", "image_uri")


def default_elements(parsed: DataFrame) -> DataFrame:
    """parsed (path, content_text, pages array<struct<page,text>>, images array<struct<src,alt,caption,...>>) as canonical elements: the pages where there are any, else the whole text;
    then the images. (A document in pages is not given twice.)"""
    element = lambda kind, text, page, image: F.struct(F.lit(kind).alias("element_type"), text.alias("text"), page.cast("int").alias("page"), image.cast("string").alias("image_path"))
    full = lambda x: F.filter(x, lambda e: strip(F.coalesce(e["text"], F.lit(""))) != "")
    none = F.lit(None)
    pages = full(F.transform(F.coalesce("pages", F.array().cast("array<struct<page:int,text:string>>")), lambda p: element("text", p["text"], p["page"], none)))
    whole = full(F.array(element("text", F.col("content_text"), none, none)))
    label = lambda i: F.coalesce(F.nullif(i["alt"], F.lit("")), i["caption"], F.lit(""))
    images = F.transform("images", lambda i: element("image", label(i), none, i["src"]))
    every = F.concat(F.when(F.size(pages) > 0, pages).otherwise(whole), F.coalesce(images, F.slice(whole, 1, 0)))
    return parsed.select("path", F.posexplode(every).alias("ordinal", "e")).select("path", "ordinal", "e.*", F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("string").alias("table_markdown"))


def elements_to_documents(elements: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """elements (path, ordinal, element_type, text, heading_path, table_markdown, image_path) -> (path, page_title, content_text, images). titles (path, title): explicit ones, which go before
    the first heading.

    Headings get one # more than they have ancestors, at most four; tables their Markdown where there is any; images become contexts, not text.
    """
    mark = F.repeat(F.lit("#"), F.least(F.size(F.coalesce("heading_path", F.array().cast("array<string>"))) + 1, F.lit(4)))
    body = (
        F.when(F.col("element_type") == "heading", F.concat(mark, F.lit(" "), F.col("text")))
        .when(F.col("element_type") == "table", F.coalesce(F.nullif("table_markdown", F.lit("")), F.col("text")))
        .when(F.col("element_type") == "text", F.col("text"))
    )
    image = F.when(
        F.col("element_type") == "image",
        F.struct(F.coalesce("image_path", F.lit("")).alias("src"), F.lit("").alias("alt"), F.lit("").alias("caption"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("surrounding_text"), F.lit("").alias("vlm_description")),
    )
    rows = elements.select("path", F.struct("ordinal", F.nullif(body, F.lit("")).alias("body"), image.alias("image"), F.when(F.col("element_type") == "heading", F.col("text")).alias("heading")).alias("e"))
    docs = rows.groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("es"))
    of = lambda f: F.filter(F.transform("es", lambda e: e[f]), lambda x: x.isNotNull())
    explicit = F.lit(None).cast("string")
    if titles is not None:
        docs, explicit = docs.join(titles, "path", "left"), F.nullif("title", F.lit(""))
    return docs.select("path", F.coalesce(explicit, F.get(of("heading"), F.lit(0)), stem_title(F.col("path"))).alias("page_title"), F.array_join(of("body"), "\n\n").alias("content_text"), of("image").alias("images"))
