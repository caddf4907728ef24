"""From retrieved chunks to a prompt, and from an answer back to its sources. Everything is keyed by query_id and bounded by the hits of one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import basename, words_of

MOST_TITLES, MOST_CHARS, LEAST_CHARS, TRUNCATED = 25, 24000, 2000, " [TRUNCATED]"
SEPARATOR = "\n\n---\n\n"
OVERLAP = 0.4
#: Phrases of a refusal, and words of an answer that don't count as evidence.
REFUSALS = ("do not have sufficient evidence", "insufficient evidence", "cannot answer", "no relevant information")
STOP_WORDS = (
    "this that with from have been were they their which would could should about these those will your more also does than into some such only other very just each based "
    "answer question document according states mentioned"
).split()


def budget(hits: DataFrame, titles: int = MOST_TITLES, chars: int = MOST_CHARS) -> DataFrame:
    """hits (query_id, rank, page_title, text): those of the first ``titles`` titles, within ``chars`` characters a title.

    A chunk that would overflow its title's budget is left out (later, smaller ones may still fit), unless the title has under LEAST_CHARS so far: then
    its head is kept. Left-out chunks add nothing, so the budget is a fold over the hits of a title, not a running sum. titles <= 0: all as they are.
    """
    if titles <= 0:
        return hits
    title = F.coalesce("page_title", F.lit("Unknown Page"))
    h = hits.withColumn("page_title", title).withColumn("text", F.coalesce("text", F.lit("")))
    # titles are ranked before any text is gathered
    first = h.groupBy("query_id", "page_title").agg(F.min("rank").alias("first"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).where(F.col("n") <= titles)
    h = h.join(first.select("query_id", "page_title"), ["query_id", "page_title"], "left_semi")
    per = h.groupBy("query_id", "page_title").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    head = lambda p: F.concat(F.substring(p["text"], 1, LEAST_CHARS), F.lit(TRUNCATED))
    kept = lambda rank, text: F.array(F.struct(rank.alias("rank"), text.alias("text")))

    def step(acc: Column, p: Column) -> Column:
        fits = acc["used"] + F.length(p["text"]) <= chars
        text = F.when(fits, p["text"]).when(acc["used"] < LEAST_CHARS, head(p))
        return F.when(text.isNull(), acc).otherwise(F.struct((acc["used"] + F.length(text)).alias("used"), F.concat(acc["kept"], kept(p["rank"], text)).alias("kept")))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<rank:int,text:string>>").alias("kept"))
    per = per.withColumn("parts", F.transform("parts", lambda p: F.struct(p["rank"].cast("int").alias("rank"), p["text"].alias("text"))))
    rows = per.select("query_id", "page_title", F.explode(F.aggregate("parts", start, step, lambda acc: acc["kept"])).alias("k"))
    return rows.select("query_id", "page_title", F.col("k.rank").alias("rank"), F.col("k.text").alias("text"))


def in_order(value: Column) -> Column:
    """An aggregate: the values in order of rank, without repeats."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"]))


def group_sources(hits: DataFrame) -> DataFrame:
    """(query_id, page_title, position, url, texts, user_metadata): distinct texts in order, the url of the first, metadata joined with the later winning."""
    metas = F.array_sort(F.collect_list(F.struct("rank", F.map_entries("user_metadata").alias("m"))))
    empty = F.create_map().cast("map<string,string>")
    merged = F.aggregate(metas, empty, lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(F.map_zip_with(acc, F.map_from_entries(x["m"]), lambda _, a, b: F.coalesce(b, a))))
    title = F.coalesce("page_title", F.lit("Unknown Page"))
    return hits.withColumn("page_title", title).groupBy("query_id", "page_title").agg(
        F.min("rank").alias("position"), F.min_by("source_path", "rank").alias("url"), in_order(F.col("text")).alias("texts"), merged.alias("user_metadata")
    )


#: The sentence of a refusal, which REFUSALS must recognise, and the layout of a source in the prompt below.
INSTRUCTIONS = """Answer from the sources below and from nothing else. Read all of them first.
If they do not settle the question, say: "I do not have sufficient evidence in my knowledge base to answer this question."
Cite the source of every statement as [Source Title]. Answer in the language of the question."""


def prompts(sources: DataFrame) -> DataFrame:
    """(query_id, prompt) of group_sources' rows: instructions, the list of titles, and a block per source."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("user_metadata")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    block = F.concat(
        F.lit('\n<source id="'), F.col("page_title"), F.lit('">\nSource: '), F.col("page_title"), F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\n"),
        F.when(tags != "", F.concat(F.lit("Metadata tags:\n"), tags)).otherwise(""), F.array_join("texts", SEPARATOR), F.lit("\n</source>\n"),
    )
    rows = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("  - ["), F.col("page_title"), F.lit("]\n")).alias("name"), block.alias("block")))).alias("s"))
    of = lambda f: F.array_join(F.transform("s", lambda x: x[f]), "")
    return rows.select("query_id", F.concat(F.lit(INSTRUCTIONS + "\n\nSources:\n"), of("name"), F.lit("\nContext:\n"), of("block")).alias("prompt"))


def citations(hits: DataFrame, most: int = MOST_TITLES, per_citation: int = 0) -> DataFrame:
    """(query_id, name, position, documents, paths, metadata): hits grouped by file name (else the end of their path), in order of the first; one metadata entry (source, title,
    user_metadata of the path's first hit) per path, at most per_citation (0: all)."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.nullif(basename(F.col("source_path")), F.lit("")), F.lit("Unknown Source"))
    grouped = hits.withColumn("name", name).groupBy("query_id", "name").agg(F.min("rank").alias("position"), in_order(F.col("text")).alias("documents"), F.array_sort(F.collect_list(F.struct("rank", F.coalesce("source_path", F.lit("unknown")).alias("source"), F.map_entries("user_metadata").alias("m")))).alias("entries"))
    first = F.filter("entries", lambda e, i: ~F.exists(F.slice("entries", 1, i), lambda o: o["source"] == e["source"]))
    grouped = grouped.withColumn("entries", F.slice(first, 1, per_citation) if per_citation > 0 else first)
    entry = lambda e: F.struct(e["source"].alias("source"), F.col("name").alias("title"), F.map_from_entries(e["m"]).alias("user_metadata"))
    grouped = grouped.withColumn("paths", F.transform("entries", lambda e: e["source"])).withColumn("metadata", F.transform("entries", entry)).drop("entries")
    grouped = grouped.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    return grouped.where(F.col("position") <= most) if most > 0 else grouped


def is_refusal(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(REFUSALS))


def overlap(answer: Column, context: Column) -> Column:
    """The share of the answer's words (four letters or more, no stop words) that the context has; 0 without any."""
    said = F.array_except(words_of(answer), F.array(*map(F.lit, STOP_WORDS)))
    return F.when(F.size(said) > 0, F.size(F.array_intersect(said, words_of(context))) / F.size(said)).otherwise(F.lit(0.0))


def grounding(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, titles, context, chunks): adds citations_found, citations_valid, overlap_score, is_refusal, grounded, warnings."""
    brackets = F.regexp_extract_all(F.col("answer"), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    named = F.array_sort(F.array_distinct(F.filter(brackets, lambda b: F.array_contains(F.col("titles"), b))))
    numbers = F.transform(F.filter(brackets, lambda b: b.rlike(r"(?i)^Document\s+\d+")), lambda b: F.try_to_number(F.regexp_extract(b, r"(\d+)", 1), F.lit("999999999999999999")).cast("long"))
    legacy = F.array_sort(F.array_distinct(numbers))
    wrong = F.filter(legacy, lambda n: n.isNull() | (n < 1) | (n > F.col("chunks")))
    a = answers.withColumn("citations_found", F.concat(named, F.transform(legacy, lambda n: F.concat(F.lit("Document "), n.cast("string")))))
    a = a.withColumn("citations_valid", F.size(wrong) == 0).withColumn("is_refusal", is_refusal(F.col("answer"))).withColumn("overlap_exact", overlap(F.col("answer"), F.col("context")))
    cited, enough = F.size("citations_found") > 0, F.col("overlap_exact") >= OVERLAP
    grounded = (cited | F.col("is_refusal")) & F.col("citations_valid") & (enough | F.col("is_refusal"))
    found = F.array(F.when(~cited & ~F.col("is_refusal"), F.lit("no citations")), F.when(~F.col("citations_valid"), F.lit("invalid citations")), F.when(~enough & ~F.col("is_refusal"), F.lit("low overlap")))
    return a.withColumn("grounded", grounded).withColumn("warnings", F.filter(found, lambda x: x.isNotNull())).withColumn("overlap_score", F.round("overlap_exact", 3)).drop("overlap_exact")


SNIPPET = 2000


def source_list(cited: DataFrame, most: int = SNIPPET) -> DataFrame:
    """citations' rows to (query_id, documents, sources): each source's texts as one, cut to ``most`` characters (0: whole), and the list of names that follows a streamed answer."""
    text = F.array_join("documents", SEPARATOR)
    if most > 0:
        text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    rows = cited.select("query_id", F.struct("position", text.alias("text"), F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.coalesce("name", F.lit("Unknown")), F.lit("\n")).alias("line")).alias("s"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most as many as there are citations
    return rows.select("query_id", F.transform("s", lambda x: x["text"]).alias("documents"), F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform("s", lambda x: x["line"]), "")).alias("sources"))
