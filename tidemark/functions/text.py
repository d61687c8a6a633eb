"""Identifiers, labels, lists and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F


def site_id(raw: Column, prefix: str = "USGS-") -> Column:
    """Identifier with exactly one canonical agency prefix."""
    bare = F.trim(raw)
    return F.concat(F.lit(prefix), F.regexp_replace(bare, f"(?i)^{prefix}", ""))


def ellipsis(label: Column, width: int = 30) -> Column:
    cut = F.concat(F.rtrim(F.substring(label, 1, width - 1)), F.lit("…"))
    return F.when(F.length(label) <= width, label).otherwise(cut)


def name_or_id(name: Column, entity_id: Column) -> Column:
    return F.coalesce(name, entity_id)


def no_null_list(items: Column, element: T.DataType) -> Column:
    """The list without null items; a missing list is an empty one."""
    empty = F.array().cast(T.ArrayType(element))
    return F.coalesce(F.filter(items, lambda x: x.isNotNull()), empty)


def payload_json(record: Column) -> Column:
    """Struct as JSON text, null fields written out."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def payload_field(payload: Column, path: str) -> Column:
    """One field of a JSON payload as text; null when the payload is not JSON."""
    return F.try_variant_get(F.try_parse_json(payload), path, "string")


def payload_is_json(payload: Column) -> Column:
    return F.try_parse_json(payload).isNotNull()
