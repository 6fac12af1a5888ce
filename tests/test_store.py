from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tests.conftest import rows
from vecloom.config import StoreConfig
from vecloom.operators.items import ITEM_SCHEMA
from vecloom.operators.knn import knn
from vecloom.store import ItemStore


def item(i, x=0.0, created=1, kind="text"):
    return (i, (kind, f"data {i}", None), [x, 1.0], None, created, created + 5)


@pytest.fixture
def store(spark, tmp_path):
    s = ItemStore(spark, str(tmp_path), StoreConfig(dimension=2))
    s.set(spark.createDataFrame([item("a", 0.0), item("b", 1.0), item("c", 5.0)], ITEM_SCHEMA))
    return s


def test_empty_store(spark, tmp_path):
    s = ItemStore(spark, str(tmp_path), StoreConfig(dimension=2))
    assert s.size() == 0 and s.get(["a"]).count() == 0 and s.verify().count() == 0
    assert rows(s.delete(["a"])) == [("a", False, False)]
    with pytest.raises(ValueError):
        StoreConfig(dimension=0)


def test_set_get_update_delete(spark, store):
    assert store.size() == 3 and store.verify().count() == 0
    with pytest.raises(ValueError):
        store.set(spark.createDataFrame([item("d"), item("e", kind="invalid_type")], ITEM_SCHEMA))
    assert store.size() == 3
    store.set(spark.createDataFrame([item("b", 9.0, 7), item("d", 2.0)], ITEM_SCHEMA))
    assert [(r["id"], r["vector"][0]) for r in store.items().orderBy("id").collect()] == [("a", 0.0), ("b", 9.0), ("c", 5.0), ("d", 2.0)]
    assert rows(store.get(["a", "b", "zz"]).select("id", "source")) == [("a", "cache"), ("b", "cache")]
    assert rows(store.delete(["a", "zz"])) == [("a", True, True), ("zz", False, False)]
    assert store.size() == 3 and store.get(["a"]).count() == 0


def test_search_finds_itself_first(spark, store):
    q = spark.createDataFrame([("q", [1.0, 1.0])], "id string, vector array<float>")
    got = store.search(q, 2).orderBy("rank").collect()
    assert [(r["item_id"], r["index_type"]) for r in got] == [("b", "standard"), ("a", "standard")]
    store.delete(["b"])
    assert store.search(q, 1).first()["item_id"] == "a"


def test_verify_repair_and_read_through(spark, store):
    store.cached.replace(store.cached.read().filter("id <> 'a'"))
    assert rows(store.verify()) == [("a", "missing_in_cache")]
    assert rows(store.get(["a"]).select("id", "source")) == [("a", "store")]
    assert rows(store.get(["a"]).select("id", "source")) == [("a", "cache")]
    store.cached.replace(store.cached.read().filter("id = 'b'"))
    store.verify(repair=True)
    assert store.verify().count() == 0


def test_warming(spark, store):
    store.cached.replace(store.cached.read().filter("id <> 'c'"))
    now = dt.datetime(2024, 1, 2)
    log = spark.createDataFrame([(i, now, k) for i, k in enumerate(["c"] * 5 + ["b"] * 9 + ["a"] * 2)], "seq bigint, ts timestamp, item_key string")
    assert [r["item_key"] for r in store.warm(log).collect()] == ["c"]
    assert store.verify().count() == 0


def test_distance_as_a_function(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "id int, vector array<float>")
    far = knn(df, df.filter("id = 0"), 2, lambda q, x: -np.abs(q[:, None, :] - x[None, :, :]).sum(axis=2))
    assert [r["item_id"] for r in far.orderBy("rank").collect()] == [8, 7]
