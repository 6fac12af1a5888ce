from __future__ import annotations

import math

import pytest

from tests.conftest import rows
from vecloom.operators.diff import Field, item_diff, same_json, table_diff

ITEM = "id string, content struct<type:string,data:string,format:map<string,string>>, vector array<float>, metadata string, created_at bigint, expires_at bigint"


def item(i, kind="text", data="a", fmt=None, vector=(1.0, 2.0), meta="{}", created=1, expires=2):
    return (i, (kind, data, fmt), None if vector is None else list(vector), meta, created, expires)


def diff(spark, store, cache):
    import datetime as dt

    cached = [(*r, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for r, t in cache]
    return rows(item_diff(spark.createDataFrame(store, ITEM), spark.createDataFrame(cached, ITEM + ", cached_at timestamp")))


def test_each_field(spark):
    store = [item(str(k)) for k in range(9)]
    cache = [(item("0"), 0), (item("1", kind=None), 0), (item("2", data="b"), 0), (item("3", fmt={"a": "b"}), 0), (item("4", vector=None), 0), (item("5", meta='{"a":1}'), 0), (item("6", created=None), 0), (item("7", expires=5), 0), (item("x"), 0)]
    assert diff(spark, store, cache) == [("1", "content_type"), ("2", "content_data"), ("3", "content_format"), ("4", "vector"), ("5", "metadata"), ("6", "created_at"), ("7", "expires_at"), ("8", "missing_in_cache"), ("x", "missing_in_store")]


def test_latest_cached_row_counts_and_repeats_change_nothing(spark):
    store = [item("a"), item("b"), item("a")]
    cache = [(item("a", data="old"), 0), (item("a"), 5), (item("a"), 5), (item("b"), 1), (item("b", data="new"), 2)]
    assert diff(spark, store, cache) == [("b", "content_data")]


def test_nan_zero_signs_lengths_and_empty_values(spark):
    nan = math.nan
    store = [item("a", vector=(nan, 0.0)), item("b", vector=(1.0,)), item("c", fmt={}), item("d", data=""), item("e", vector=()), item("f", data="x" * 300_000)]
    cache = [(item("a", vector=(nan, -0.0)), 0), (item("b", vector=(1.0, 1.0)), 0), (item("c", fmt=None), 0), (item("d", data=None), 0), (item("e", vector=None), 0), (item("f", data="x" * 300_000), 0)]
    assert diff(spark, store, cache) == [("b", "vector"), ("d", "content_data"), ("e", "vector")]


def test_null_keys_and_empty_tables(spark):
    assert diff(spark, [], []) == []
    assert diff(spark, [item("a")], []) == [("a", "missing_in_cache")]
    assert diff(spark, [item(None)], []) == [(None, "missing_in_cache")]
    assert diff(spark, [item(None)], [(item(None, data="z"), 0)]) == [(None, "content_data")]


def test_clashing_extra_columns(spark):
    left = spark.createDataFrame([(1, "a", "x")], "k int, v string, side string")
    right = spark.createDataFrame([(1, "b", 7)], "k int, v string, row int")
    assert rows(table_diff(left, right, "k", [Field("v", "v")])) == [(1, "v")]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a": 1, "b": 2}', '{"b":2,"a":1.0}', True),
        ('{"a": 1}', '{"a": "1"}', False),
        ('{"a": null}', "{}", False),
        ("[1, 2]", "[2, 1]", False),
        ("100", "1e2", True),
        ("true", "1", False),
        ("{broken", "{ broken", False),
        ("{broken", "{broken", True),
        (None, None, True),
        (None, "{}", False),
        ("NaN", " NaN", False),
        ("0.1", "0.10000000000000001", False),
    ],
)
def test_json_values(a, b, same):
    assert same_json(a, b) is same
