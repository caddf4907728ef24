"""Splitting documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import chunk_identity, paragraphs

MOST, OVERLAP = 2000, 200
#: Bytes of text that are split at once.
AT_ONCE = 1 << 20
SEPARATORS = ("\n", ". ", " ")


def split_text(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``most`` characters, each cut at the last line end, sentence end or blank that fits (in this order), else hard; the next piece begins ``overlap`` characters before.

    A separator whose cut makes no progress is passed over. Works by positions in the text, so any number of pieces costs neither stack nor copies.
    """
    overlap = min(overlap, most // 2)
    n, out = len(text), []

    def strip(a: int, z: int) -> tuple[int, int]:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        return a, z

    a, end = strip(0, n)
    if end - a <= most:
        return [text[a:end]]
    while end - a > most:
        after = None
        for sep in SEPARATORS:
            i = text.rfind(sep, a, a + most)
            if i > a and (right := strip(max(a, i - overlap), end)[0]) > a:
                left, after = strip(a, i), right
                break
        if after is None:
            left, after = strip(a, a + most), strip(a + most - overlap, end)[0]
            if after <= a or after >= end:
                out.append(text[left[0] : left[1]])
                return out
        out.append(text[left[0] : left[1]])
        a = after
    if a < end:
        out.append(text[a:end])
    return out


def _few(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most AT_ONCE bytes, or of one text."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, AT_ONCE + (ends[lo - 1] if lo else 0), "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def splitter(most: int = MOST, overlap: int = OVERLAP):
    """An Arrow UDF, text -> array of pieces; the split is sequential, so it is no native expression. Python strings are made of AT_ONCE bytes at a time."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in _few(texts):
                yield pa.array([None if t is None else split_text(t, most, overlap) for t in some.to_pylist()], pa.list_(pa.string()))

    return split


def text_chunks(docs: DataFrame, canonical_id: str, text: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """docs with chunk_index, text and chunk_id: a row per piece; the index runs over all paragraphs of a document.

    Long paragraphs go through the splitter one row each, so that a document of any length is spread over batches.
    """
    keep = [c for c in docs.columns if c != text]
    parts = docs.select(*keep, F.posexplode(paragraphs(F.col(text))).alias("__par", "__p"))
    split = splitter(most, overlap)
    short = parts.where(F.length("__p") <= most).withColumn("__pieces", F.array("__p"))
    long = parts.where(F.length("__p") > most).withColumn("__pieces", split("__p"))
    rows = short.unionByName(long).select(*keep, "__par", F.posexplode("__pieces").alias("__i", "text"))
    index = F.row_number().over(Window.partitionBy(canonical_id).orderBy("__par", "__i")) - 1
    return rows.withColumn("chunk_index", index).drop("__par", "__i").withColumn("chunk_id", chunk_identity(F.col(canonical_id), F.col("chunk_index"))).withColumn("chunk_type", F.lit("text"))


def image_text(image: Column) -> Column:
    """The text of an image's chunk: its source, alternative text and caption, then its description, or its surroundings."""
    full = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    last = F.coalesce(full("Description", image["vlm_description"]), full("Context", image["surrounding_text"]))
    parts = F.array(F.concat(F.lit("Image: "), image["src"]), full("Alt text", image["alt"]), full("Caption", image["caption"]), last)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")


def image_chunks(docs: DataFrame, canonical_id: str) -> DataFrame:
    """A row per image of the documents' array ``images``; their own numbering starts at 0."""
    rows = docs.select("*", F.posexplode("images").alias("chunk_index", "__image")).drop("images")
    rows = rows.withColumn("text", image_text(F.col("__image"))).withColumn("image_path", F.col("__image.src")).drop("__image")
    return rows.withColumn("chunk_id", chunk_identity(F.col(canonical_id), F.col("chunk_index"), image=True)).withColumn("chunk_type", F.lit("image"))
