"""Search over many queries, best-first search, result cache, metadata, hashes, tasks, quantizer choice and streams that end."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_operators import vectors
from tests.test_store import item, store  # noqa: F401
from vecloom import streaming
from vecloom.config import Quantizer
from vecloom.functions import keys, metadata
from vecloom.operators import cache, graph, knn, lsh, quantize, search, tasks
from vecloom.operators.items import ITEM_SCHEMA


@pytest.mark.parametrize("metric", ["l2sq", "cosine", "dot"])
def test_queries_beyond_a_block_stay_on_the_executors(spark, metric, monkeypatch):
    df = vectors(spark, 150).unionByName(spark.createDataFrame([(900 + i, [0.5] * 8) for i in range(60)] + [(990, [1.0]), (991, None), (None, [1.0] * 8)], "id int, vector array<float>"))
    whole = rows(knn.knn(df, df, 4, metric, skip_self=True))
    sent = []
    monkeypatch.setattr(knn, "block_of", lambda asked, block=knn.BLOCK: sent.append(len(asked.limit(block + 1).collect())))
    assert rows(knn.knn(df, df, 4, metric, skip_self=True, block=16)) == whole
    # no more than a block and one row were looked at on the driver
    assert sent == [17]
    x = {r["id"]: np.array(r["vector"], np.float64) for r in df.filter("id is not null and size(vector) = 8").collect()}
    near = {"l2sq": lambda a, b: ((a - b) ** 2).sum(), "cosine": lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)), "dot": lambda a, b: -(a @ b)}[metric]
    for q in (3, 77, 930):
        exact = sorted((round(near(x[q], x[i]), 9), i) for i in x if i != q)[:4]
        assert [r[1] for r in sorted(whole, key=lambda r: r[2]) if r[0] == q] == [i for _, i in exact]


def test_all_within_a_distance_in_blocks(spark):
    df = vectors(spark, 80)
    assert rows(knn.knn(df, df, None, "cosine", most_distance=0.5, block=9)) == rows(knn.knn(df, df, None, "cosine", most_distance=0.5))


def test_ties_hold_k_a_query():
    best = knn.Nearest(np.array([0]), np.ones((1, 4)), 3, "l2sq")
    for low in (5000, 3000, 0):
        best.add(np.arange(low, low + 2000), np.ones((2000, 4)))
    assert best.ids.tolist() == [0, 1, 2] and len(best.values) == 3


def test_scan_and_join_of_buckets_agree(spark, monkeypatch):
    df = vectors(spark, 120, 64)
    q = df.filter("id % 10 = 0")
    planes = lsh.Planes(4, 3)
    by_scan = [rows(f(df, q, 5)) for f in (lambda i, q, k: lsh.lsh_search(i, q, k, 0.0, planes), lambda i, q, k: lsh.lsh_rerank(i, q, k, planes), lambda i, q, k: search.optimistic_search(i, q, k, planes, 2))]
    pairs = {(r["query_id"], r["item_id"]) for r in lsh.candidates(df, q, planes).collect()}
    assert {(r[0], r[1]) for r in by_scan[0]} <= pairs
    monkeypatch.setattr(lsh, "block_of", lambda asked: None)
    rounded = lambda found: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found]
    by_join = [rows(f(df, q, 5)) for f in (lambda i, q, k: lsh.lsh_search(i, q, k, 0.0, planes), lambda i, q, k: lsh.lsh_rerank(i, q, k, planes), lambda i, q, k: search.optimistic_search(i, q, k, planes, 2))]
    assert [rounded(x) for x in by_scan] == [rounded(x) for x in by_join]
    limited = lsh.lsh_search(df, q, 5, 0.0, planes, bucket_limit=1)
    assert limited.count() <= 12 * 4


def test_stored_cells_and_joined_cells_give_the_same(spark, tmp_path, monkeypatch):
    df = vectors(spark, 200, 8)
    q = df.filter("id % 20 = 0")
    book = quantize.train(df, 6, 4)
    exact = rows(quantize.ivf_search(df, q, book, 5, 3))
    quantize.write_cells(df, book, str(tmp_path / "cells"))
    stored = quantize.stored_ivf_search(spark, str(tmp_path / "cells"), q, book, 5, 3)
    assert rows(stored.withColumn("distance", F.round("distance", 9))) == [(*r[:3], round(r[3], 9)) for r in exact]
    assert rows(quantize.ivf_search(df, q, book, 5, 6)) == rows(knn.knn(df, q, 5))
    monkeypatch.setattr(quantize, "block_of", lambda asked: None)
    assert [r[:3] for r in rows(quantize.ivf_search(df, q, book, 5, 3))] == [r[:3] for r in exact]
    assert quantize.ivf_search(df, q.limit(0), book, 5).count() == 0


def test_best_first_search(spark):
    df = vectors(spark, 60, 8)
    edges = graph.similarity_edges(df, 0.2, 5)
    x = {r["id"]: np.array(r["vector"], np.float64) for r in df.collect()}
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    cosine = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 9)
    got = graph.best_first(edges, df, df.filter("id % 30 = 7"), 6, 0).collect()
    for q in (7, 37):
        seen, visits = {0: cosine(x[q], x[0])}, []
        while len(visits) < 6 and set(seen) - set(visits):
            at = min(set(seen) - set(visits), key=lambda n: (-seen[n], n))
            visits.append(at)
            seen |= {n: cosine(x[q], x[n]) for n in near.get(at, ())}
        assert [r["item_id"] for r in sorted(got, key=lambda r: r["visit"]) if r["query_id"] == q] == visits
    assert graph.best_first(edges, df, df.filter("id % 30 = 7"), 6, 0, depth=2).count() == 4


def test_layered_index_is_kept(spark, tmp_path):
    df = vectors(spark, 300, 8)
    graph.layered_index(df, segment=100, dimension=8).write.parquet(str(tmp_path / "index"))
    q = df.filter("id % 50 = 0")
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() >= 3
    exact = rows(knn.knn(df, q, 5))
    got = graph.indexed_search(index, q, 5, beam=100, dimension=8)
    assert [r[:3] for r in rows(got)] == [r[:3] for r in exact]
    assert graph.indexed_search(index, q.limit(0), 5, dimension=8).count() == 0


def test_results_are_remembered_for_minutes(spark, store):
    q = spark.createDataFrame([("q", [1.0, 1.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    first = rows(store.search(q, 2))
    again = store.search(q.withColumn("vector", F.transform("vector", lambda x: x * 2)), 2).collect()
    assert {r["index_type"] for r in again if r["query_id"] == "q"} == {"cached"} and {r["index_type"] for r in again if r["query_id"] == "z"} == {"standard"}
    assert sorted((r["query_id"], r["item_id"]) for r in again if r["query_id"] == "q") == sorted((r[0], r[1]) for r in first if r[0] == "q")
    assert {r["index_type"] for r in store.search(q, 1).collect()} == {"standard"}
    store.set(spark.createDataFrame([item("n", 1.0)], ITEM_SCHEMA))
    assert {r["index_type"] for r in store.search(q, 2).collect()} == {"standard"}
    old = spark.createDataFrame([(r["key"], r["hits"], r["cached_at"] - dt.timedelta(minutes=6)) for r in store.results.read().collect()], store.results.schema)
    store.results.replace(old)
    assert {r["index_type"] for r in store.search(q, 2).collect()} == {"standard"}
    store.clear()
    assert store.cache().count() == 0 and store.results.read().count() == 0 and store.size() == 4


def test_large_entries_are_cached_compressed(spark, store):
    text = "long " * 1000
    row = ("big", ("text", text, None), [7.0, 1.0], None, 1, 6)
    store.set(spark.createDataFrame([row, item("s")], ITEM_SCHEMA))
    held = {r["id"]: r for r in store.cached.read().collect()}
    assert held["big"]["content"]["data"] is None and len(held["big"]["packed"]) < 200 and held["s"]["packed"] is None
    assert store.get(["big"]).first()["content"]["data"] == text and store.verify().count() == 0
    assert store.quantize("standard").count() == 5
    with pytest.raises(ValueError):
        store.quantize("none")


def test_metadata_is_put_into_objects(spark):
    given = ['{"a": 1, "index_type": "old", "n": {"x": [1, 2]}}', "{}", "broken", None, "[1]"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(given)], "id int, m string")
    got = [json.loads(r["p"]) for r in df.orderBy("id").select(metadata.put(F.col("m"), index_type=F.lit("ivf"), at=F.col("id")).alias("p")).collect()]
    assert got[0] == {"a": 1, "index_type": "ivf", "n": {"x": [1, 2]}, "at": 0}
    assert got[1:] == [{"index_type": "ivf", "at": i} for i in range(1, 5)]
    assert [r["e"] for r in spark.createDataFrame([({"k": "v"},), (None,)], "m map<string,string>").select(metadata.encoded(F.col("m")).alias("e")).collect()] == ['{"k":"v"}', "{}"]


def test_hash_of_vector_bytes(spark):
    given = [[1.0, -2.5], [], None, [3.0], [1.0, -2.5]]

    def fnv(v):
        h = 14695981039346656037
        for b in np.array(v, "<f4").tobytes():
            h = ((h ^ b) * 1099511628211) % 2**64
        return h - 2**64 if h >= 2**63 else h

    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "id int, v array<float>").coalesce(1)
    assert [r["h"] for r in df.orderBy("id").select(keys.fnv1a64(F.col("v")).alias("h")).collect()] == [None if v is None else fnv(v) for v in given]


def test_a_task_for_every_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None), (4, [])], "id int, vector array<float>")
    assert rows(tasks.per_vector(df, lambda x: x.sum(axis=1))) == [(1, 3.0), (2, 3.0), (3, None), (4, 0.0)]


def test_quantizers_by_kind(spark):
    df = vectors(spark, 60, 8)
    how = Quantizer(centroids=4, steps=3, parts=2)
    sizes = {"standard": 1, "optimistic": 1, "product": 2, "residual": 2}
    for kind in quantize.KINDS:
        got = quantize.encode(df, kind, quantize.trained(df, kind, how)).collect()
        assert len(got) == 60 and all(len(r["codes"]) == sizes[kind] and r["error"] >= 0 for r in got)
    for call in (lambda: quantize.encode(df, "other", None), lambda: quantize.trained(df, "other", how)):
        with pytest.raises(ValueError):
            call()
    book = quantize.first_rows(df, 4)
    assert quantize.change_rate(df, book, book).first()["rate"] == 0.0
    assert quantize.change_rate(df.limit(0), book, book).first()["rate"] is None


def test_result_keys_ignore_zero_vectors(spark):
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    hits = spark.createDataFrame([("a", "i", 1, 0.5), ("a", "j", 2, 0.6), ("z", "i", 1, 0.1)], "query_id string, item_id string, rank bigint, distance double")
    kept = cache.to_remember(hits, q, 1).withColumn("cached_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    now = cache.nanoseconds(F.lit("2024-01-01 00:05:00").cast("timestamp"))
    assert [(r["query_id"], len(r["hits"])) for r in cache.remembered(kept, q, 1, now).collect()] == [("a", 1)]
    assert cache.remembered(kept, q, 1, now + 1).count() == 0


LOG = "seq bigint, ts timestamp_ntz, item_key string, op string, latency_ms double, success boolean"


def test_streams_close_their_windows_and_drop_state(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for n in range(3):
        # days apart, so that earlier windows close while the log goes on
        data = [(n * 10 + i, start + dt.timedelta(days=40 * n, hours=i), f"k{i % 2}", "get", 1.0, True) for i in range(6)]
        spark.createDataFrame(data, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    for plan, name in ((streaming.windowed, "w"), (streaming.patterns, "p")):
        streaming.closed(spark, str(tmp_path / "log"), plan, str(tmp_path / name))
    windows = spark.read.parquet(str(tmp_path / "w"))
    assert windows.count() == 18 and windows.agg(F.sum("n")).first()[0] == 18
    patterns = spark.read.parquet(str(tmp_path / "p"))
    assert rows(patterns.select("item_key", "accesses")) == sorted([(f"k{i}", 3) for i in range(2)] * 3)
    # append mode writes a window once, when the watermark has passed it
    assert windows.select("op", "start").distinct().count() == 18


def test_ingest_judges_rows_alone(spark, tmp_path):
    def row(i, kind="text"):
        return (i, (kind, "d", None), [0.5] * 64, "{}", 1, 2)

    spark.createDataFrame([row("a"), row("a", "bad"), row(None), row("b")], ITEM_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    streaming.ingest(streaming.source(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == ["a", "b"]
