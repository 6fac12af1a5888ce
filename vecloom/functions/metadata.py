"""Metadata as JSON objects: reading, writing and adding fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(values: Column) -> Column:
    """A map or struct as a JSON object; null is the empty one."""
    return F.coalesce(F.to_json(values), F.lit("{}"))


def decoded(metadata: Column) -> Column:
    """The fields of a JSON object as a map of variants; anything else reads as empty."""
    parsed = F.try_parse_json(metadata)
    fields = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.try_variant_get(parsed, "$", "map<string,variant>"))
    return F.coalesce(fields, F.try_variant_get(F.parse_json(F.lit("{}")), "$", "map<string,variant>"))


def put(metadata: Column, **fields: Column) -> Column:
    """The JSON object with these fields in place of those of the same names; what is no object is taken as empty."""
    new = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), _variant(value))])
    old = F.map_filter(decoded(metadata), lambda k, _: ~k.isin(*fields))
    return encoded(F.map_concat(old, new))


def _variant(value: Column) -> Column:
    return F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")
