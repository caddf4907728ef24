"""Text functions as native columns; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s"


def strip(x: Column) -> Column:
    """Both ends without white space of any script."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize(x: Column) -> Column:
    """Runs of blanks to one, blank lines to one empty line, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?U)\n\s*\n", "\n\n"))


def paragraphs(x: Column) -> Column:
    """Non-empty stripped parts between empty lines."""
    return F.filter(F.transform(F.split(x, "\n\n"), strip), lambda p: p != "")


def title_case(x: Column) -> Column:
    """Every run of letters with an upper-case head and a lower-case rest."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def stem_title(path: Column) -> Column:
    return title_case(F.translate(stem(path), "_-", "  "))


def slugify(name: Column) -> Column:
    """Lower case, runs of other characters to a dash, dashes and underscores trimmed, at most 64; null where nothing valid is left."""
    s = F.regexp_replace(F.lower(strip(name)), r"[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, r"^[-_]+|[-_]+$", ""), 1, 64)
    return F.when(s.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}$"), s)


def truncate(x: Column, most: int) -> Column:
    return F.substring(x, 1, most) if most > 0 else x


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def sanitize_question(x: Column) -> Column:
    return strip(F.translate(x, "\"'", ""))


def words_of(x: Column, least: int = 4) -> Column:
    """Distinct lower-cased ASCII words of ``least`` letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(rf"(?<![\p{{L}}\p{{N}}_])([a-zA-Z]{{{least},}})(?![\p{{L}}\p{{N}}_])"), F.lit(1)), F.lower))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def doc_identity(kb_id: Column, digest: Column) -> Column:
    """doc_ and the first 32 digits of the hash of knowledge base and content."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws(":", kb_id, F.regexp_replace(digest, "^sha256:", "")).cast("binary"), 256), 1, 32))


def chunk_identity(canonical_id: Column, index: Column, image: bool = False) -> Column:
    return F.md5(F.concat(canonical_id, F.lit("_img_" if image else "_"), index.cast("string")).cast("binary"))


def glob_pattern(pattern: str, case_sensitive: bool = False) -> str:
    """A regular expression, unanchored, of a glob with * and ?."""
    import re

    body = re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".")
    return body if case_sensitive else f"(?i){body}"


#: What stands for a mark that Latin-1 lacks, or that a plain font does.
PLAIN_MARKS = {"\u2013": "-", "\u2014": "--", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2022": "*", "\u2026": "...", "\u2122": "(TM)", "\u00a9": "(C)", "\u00ae": "(R)"}


def pdf_safe(x: Column) -> Column:
    """Typographic marks as plain ones, what else Latin-1 lacks as a question mark."""
    for mark, plain in PLAIN_MARKS.items():
        x = F.replace(x, F.lit(mark), F.lit(plain))
    return F.regexp_replace(x, r"[^\x00-\xFF]", "?")


def hashed_embedding(x: Column, dim: int = 64) -> Column:
    """Words counted by the hash of each into ``dim`` places, at unit length; no words: zeros. A deterministic stand-in for a remote model."""
    words = F.filter(F.split(F.lower(x), r"[^a-z0-9]+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))
    counts = F.aggregate(place, F.array_repeat(F.lit(0.0), dim), lambda acc, p: F.transform(acc, lambda v, i: v + F.when(i == p, 1.0).otherwise(0.0)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    scale = lambda c, n: F.transform(c, lambda v: F.when(n > 0, v / n).otherwise(F.lit(0.0)).cast("float"))
    pair = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    return F.get(F.transform(pair, lambda p: scale(p["c"], p["n"])), F.lit(0))  # the counts are named once, so that they are counted once
