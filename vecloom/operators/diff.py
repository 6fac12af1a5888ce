"""Field-by-field differences between two copies of a dataset."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    return dict(pairs)


def _parse(text: str) -> object:
    return json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=_no_constant, object_pairs_hook=_unique)


def _same(a: object, b: object) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and a == b


def same_json(a: str | None, b: str | None) -> bool:
    """Equal as JSON values if both texts parse (numbers by value, a number is no string, null is no absent key), else equal as texts."""
    if a is None or b is None or a == b:
        return a == b
    try:
        return _same(_parse(a), _parse(b))
    except (ValueError, RecursionError, ArithmeticError):
        return False


def _same_jsons(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_json(x, y) for x, y in zip(a, b, strict=True)], dtype="boolean")


@dataclass(frozen=True)
class Field:
    """A compared field: its name in the report, its SQL path, and how it is compared.

    ``kind``: ``value`` (null-safe equality), ``array`` (element by element, NaN equals NaN), ``map``
    (as sets of entries, null equals empty) or ``json`` (as JSON values if both sides parse).
    """

    name: str
    path: str
    kind: str = "value"


def _differs(field: Field, left: str, right: str) -> Column:
    """The generated comparison of one field of the structs ``left`` and ``right``."""
    a, b = f"{left}.`{field.name}`", f"{right}.`{field.name}`"
    if field.kind == "array":
        # size first: zip_with pads the shorter side
        return F.expr(f"not ({a} is null and {b} is null) and (({a} is null) or ({b} is null) or size({a}) <> size({b}) or exists(zip_with({a}, {b}, (x, y) -> x <=> y), same -> not same))")
    if field.kind == "json":
        compare = F.pandas_udf(_same_jsons, T.BooleanType())
        plain = F.expr(f"{a} <=> {b}")
        # rows whose texts agree never reach Python: they are passed as nulls
        return ~plain & ~compare(F.when(~plain, F.expr(a)), F.when(~plain, F.expr(b)))
    return F.expr(f"not ({a} <=> {b})")


def _captured(field: Field) -> Column:
    if field.kind == "map":
        return F.expr(f"array_sort(map_entries(case when cardinality({field.path}) > 0 then {field.path} end))").alias(field.name)
    return F.expr(field.path).alias(field.name)


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: Iterable[Field], *, left_name: str = "left", right_name: str = "right", left_latest: str | None = None, right_latest: str | None = None) -> DataFrame:
    """Differences of two copies as rows (key, field).

    Both sides are tagged, united and grouped once by ``key``; each group keeps one struct a side, and the
    structs are compared by generated expressions. ``field`` is ``missing_in_<left>``, ``missing_in_<right>``
    or the name of a field that differs.

    Several rows of a key on one side: the one greatest in ``left_latest``/``right_latest`` counts (nulls
    come first), then the one whose struct's hash is greatest, so repeated rows change nothing. The choice
    is a grouped maximum combined before the shuffle, so a key with a third of all rows is no hot task.
    Rows with a null key form one group, reported under the null key. Null, empty and very long values are
    ordinary values; an empty table makes every key of the other side missing. Further columns, whatever
    their names, are not read.
    """
    fields = list(fields)

    def side(df: DataFrame, number: int, latest: str | None) -> DataFrame:
        row = df.select(F.col(key).alias("k"), F.lit(number).alias("side"), (F.col(latest) if latest else F.lit(None)).cast("timestamp").alias("at"), F.struct(*[_captured(f) for f in fields]).alias("row"))
        return row.withColumn("turn", F.struct("at", F.xxhash64(*[F.col(f"row.`{f.name}`") for f in fields]).alias("tie")))

    both = side(left, 0, left_latest).unionByName(side(right, 1, right_latest))
    grouped = both.groupBy("k").agg(
        *[F.max_by(F.when(F.col("side") == n, F.col("row")), F.when(F.col("side") == n, F.col("turn"))).alias(name) for n, name in ((0, "l"), (1, "r"))],
        F.max(F.col("side") == 0).alias("in_l"),
        F.max(F.col("side") == 1).alias("in_r"),
    )
    found = F.when(~F.col("in_l"), F.array(F.lit(f"missing_in_{left_name}"))).when(~F.col("in_r"), F.array(F.lit(f"missing_in_{right_name}")))
    grouped = grouped.withColumns({f"d{i}": F.coalesce(_differs(f, "l", "r"), F.lit(False)) for i, f in enumerate(fields)})
    each = F.array_compact(F.array(*[F.when(F.col(f"d{i}"), F.lit(f.name)) for i, f in enumerate(fields)]))
    return grouped.select(F.col("k").alias(key), F.explode(F.coalesce(found, each)).alias("field"))


#: The fields of an item and how the two copies of it are compared.
ITEM_FIELDS = (
    Field("content_type", "content.type"),
    Field("content_data", "content.data"),
    Field("content_format", "content.format", "map"),
    Field("vector", "vector", "array"),
    Field("metadata", "metadata", "json"),
    Field("created_at", "created_at"),
    Field("expires_at", "expires_at"),
)


def item_diff(store: DataFrame, cache: DataFrame) -> DataFrame:
    """(id, field) for every difference between the store and its cached copy; of several cached rows the latest counts."""
    return table_diff(store, cache, "id", ITEM_FIELDS, left_name="store", right_name="cache", right_latest="cached_at")
