"""Metadata filters, compiled to one predicate column that Catalyst can push down and prune by."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import glob_pattern
from quillstone.schemas import CORE_FIELDS, DEFAULT_KB

MOST_KEYS, MOST_VALUE, MOST_BYTES = 20, 256, 4096


def field(name: str) -> Column:
    """A core field, or a key of user_metadata (with or without that prefix)."""
    if name in CORE_FIELDS:
        return F.col(name)
    return F.try_element_at(F.col("user_metadata"), F.lit(name.removeprefix("user_metadata.")))


#: Payload fields that hold arrays: a value matches if any element does, and an empty array does not exist.
ARRAY_FIELDS = ("source_paths",)


def _array_condition(c: Column, op: str, value: Any) -> Column | None:
    no = F.lit(False)
    if op in ("eq", "neq"):
        same = F.coalesce(F.array_contains(c, value), no)
        return same if op == "eq" else ~same
    if op == "exists":
        return F.coalesce(F.size(c) > 0, no)
    if op == "contains":
        return F.coalesce(F.exists(c, lambda x: F.contains(x, F.lit(str(value)))), no)
    if op == "in" and isinstance(value, str | list | tuple):
        wanted = [value] if isinstance(value, str) else list(value)
        return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, wanted)).cast("array<string>")), no)
    return None


def condition(name: str, op: str = "eq", value: Any = None) -> Column | None:
    """None for an unknown operator, or a value that ``in`` can't take: such a condition is left out."""
    if name in ARRAY_FIELDS:
        return _array_condition(F.col(name), op, value)
    c = field(name)
    if op in ("eq", "neq"):
        same = F.coalesce(c == F.lit(value), F.lit(False))
        return same if op == "eq" else ~same
    if op == "exists":
        return c.isNotNull()
    if op == "contains":
        return F.coalesce(F.contains(c.cast("string"), F.lit(str(value))), F.lit(False))
    if op == "in" and isinstance(value, str | list | tuple):
        return F.coalesce(c.isin([value] if isinstance(value, str) else list(value)), F.lit(False))
    return None


def compile_filters(filters: Iterable[dict] | None, kb_ids: Iterable[str] | None = None) -> Column | None:
    """The conditions and the knowledge bases, all of which must hold; None where there are none."""
    parts = [condition(f["field"], f.get("operator", "eq"), f.get("value")) for f in filters or ()]
    parts = [p for p in parts if p is not None]
    if kb_ids:
        parts.append(F.col("kb_id").isin(list(kb_ids)))
    return functools.reduce(operator.and_, parts) if parts else None


def metadata_equals(wanted: dict[str, str]) -> Column | None:
    parts = [F.coalesce(F.try_element_at("user_metadata", F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()]
    return functools.reduce(operator.and_, parts) if parts else None


def discovery_scope(kb_ids: Iterable[str]) -> Column:
    ids = list(kb_ids)
    p = F.coalesce(F.col("kb_id").isin(ids), F.lit(False)) | F.coalesce(F.try_element_at("user_metadata", F.lit("kb_id")).isin(ids), F.lit(False))
    return p | F.coalesce(F.col("kb_id"), F.lit("")).eqNullSafe("") if DEFAULT_KB in ids else p


def glob(name: Column, pattern: str, case_sensitive: bool = False) -> Column:
    return F.coalesce(name.rlike(glob_pattern(pattern, case_sensitive)), F.lit(False))


def metadata_errors(metadata: Column) -> Column:
    """All rules that a map breaks, as an array of their names."""
    values = F.map_values(metadata)
    rules = (
        ("too_many_keys", F.size(metadata) > MOST_KEYS),
        ("null_value", F.exists(values, lambda v: v.isNull())),
        ("long_value", F.exists(values, lambda v: F.coalesce(F.length(v) > MOST_VALUE, F.lit(False)))),
        ("too_large", F.octet_length(F.to_json(metadata)) > MOST_BYTES),
    )
    found = F.array(*[F.when(c, F.lit(n)) for n, c in rules])
    return F.when(metadata.isNull(), F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.isNotNull()))


def matching(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.where(predicate)


def query_metadata(parameters: dict[str, str], given: str | None = None) -> dict[str, str] | None:
    """The metadata filter of a request: a JSON object, and every parameter metadata.<key>, which goes before it; None without any. ValueError names what is wrong."""
    import json

    try:
        found = json.loads(given) if given else {}
    except json.JSONDecodeError as error:
        raise ValueError("the metadata filter is not JSON") from error
    if not isinstance(found, dict):
        raise ValueError("the metadata filter is not an object")
    found |= {k.removeprefix("metadata."): v for k, v in parameters.items() if k.startswith("metadata.")}
    wrong = [k for k, v in found.items() if not isinstance(v, str) or len(v) > MOST_VALUE]
    if wrong or len(found) > MOST_KEYS or len(json.dumps(found).encode()) > MOST_BYTES:
        raise ValueError(f"metadata of {len(found)} keys; not a text of {MOST_VALUE} characters at most: {wrong}")
    return found or None


def has_content(text: Column, images: Column) -> Column:
    """Documents that have a text or an image to index."""
    return (F.coalesce(F.trim(text), F.lit("")) != "") | F.coalesce(F.size(images) > 0, F.lit(False))


def current_jobs(kind: Column) -> Column:
    """Jobs of the present interface, by the prefix of their type."""
    return F.coalesce(F.startswith(kind, F.lit("v2_")), F.lit(False))


def asks_for_task(question: Column) -> Column:
    """Questions that go to the model without retrieval."""
    return F.coalesce(F.startswith(question, F.lit("### Task:")), F.lit(False))
