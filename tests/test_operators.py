from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vecloom.functions import keys, vector
from vecloom.operators import access, cache, graph, items, lsh, metrics, ordered, quantize, search
from vecloom.operators.knn import knn
from vecloom.runtime import components


def vectors(spark, n=60, d=8, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(d)]) for i in range(n)], "id int, vector array<float>")


def test_noise_order_is_distance_order_and_self_is_first(spark):
    base = [0.1 * i for i in range(8)]
    df = spark.createDataFrame([(n, [x + n / 100 for x in base]) for n in range(50)], "id int, vector array<float>")
    got = [r["item_id"] for r in knn(df, df.filter("id = 0"), 50).orderBy("rank").collect()]
    assert got == list(range(50))


def test_knn_ties_nulls_lengths_and_repeats(spark):
    df = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [1.0]), (4, None), (5, [1.0, 2.0]), (None, [1.0]), (1, [1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(9, [1.0]), (10, None)], "id int, vector array<float>")
    assert [r["item_id"] for r in knn(df, q, 3).orderBy("rank").collect()] == [1, 1, 2]
    assert knn(df, q.filter("id = 10"), 3).count() == 0
    assert knn(df.filter("id > 99"), q, 3).count() == 0
    with pytest.raises(ValueError):
        knn(df, q, 0)
    with pytest.raises(ValueError):
        knn(df, q, 1, "nearest")


def test_blocks_of_queries_change_nothing(spark):
    df = vectors(spark)
    assert rows(knn(df, df, 5, "cosine", block=7)) == rows(knn(df, df, 5, "cosine"))


def test_query_key_is_scale_invariant(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select((keys.query_key(F.col("a"), 10) == keys.query_key(F.col("b"), 10)).alias("same"), (keys.query_key(F.col("a"), 10) == keys.query_key(F.col("a"), 9)).alias("other"), keys.query_key(F.col("z"), 10).alias("zero")).first()
    assert (r["same"], r["other"], r["zero"]) == (True, False, None)


def test_fnv(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) % 2**32
        return h

    words = ["", "a", "foobar", "é", "test_key_17"]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    assert [r["h"] for r in df.select(keys.fnv1a32(F.col("k")).alias("h")).collect()] == [fnv(w) for w in words]


def test_zero_vectors(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(vector.cosine(F.col("a"), F.col("b")).alias("s"), vector.cosine_distance(F.col("a"), F.col("b")).alias("d"), vector.normalize(F.col("a")).alias("n"), vector.dot(F.col("a"), F.slice("b", 1, 1)).alias("short")).first()
    assert (r["s"], r["d"], r["n"], r["short"]) == (0.0, 1.0, [0.0, 0.0], 0.0)


def test_budget_keeps_the_newest_four_of_eight(spark):
    entries = spark.createDataFrame([(f"k{i}", 262144, i) for i in range(8)] + [("big", 2**20 + 1, 99)], "id string, bytes bigint, at bigint")
    assert [r[1] for r in rows(cache.within_budget(entries, 1 << 20, 1))] == ["k4", "k5", "k6", "k7"]


def test_lru_against_simulation(spark):
    rng = random.Random(3)
    log = [(i, rng.choice("abcdefghij")) for i in range(500)]
    held, hits = [], 0
    for _, k in log:
        hits += k in held
        held = [k, *[x for x in held if x != k]][:4]
    got = cache.hit_counts(spark.createDataFrame(log, "t int, k string"), F.lit(0), 4, "k", ("t",)).first()
    assert (got["accesses"], got["hits"]) == (500, hits)


def test_successors_cross_task_boundaries(spark):
    data = [(u, t, ((u or 3) * 7 + t) % 5) for u in (1, 1, 2, None) for t in range(300)]
    data = [(u, t + 1000 * i, k) for i, (u, t, k) in enumerate(data)]
    df = spark.createDataFrame(data, "u int, t int, k int")
    exp = []
    for u in {d[0] for d in data}:
        own = [k for _, _, k in sorted((d for d in data if d[0] == u), key=lambda d: d[1])]
        exp += [(u, a, b) for a, b in zip(own, own[1:], strict=False)]
    assert rows(ordered.successors(df, "u", ["t"], "k")) == sorted(exp, key=repr)
    assert ordered.successors(df.limit(0), "u", ["t"], "k").count() == 0


def test_running_total(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in range(400)]
    exp, sums = [], {}
    for g, i, v in data:
        sums[g] = sums.get(g, 0) + v
        exp.append((g, i, v, sums[g]))
    assert rows(ordered.running_total(spark.createDataFrame(data, "g string, i int, v bigint"), "g", ["i"], "v")) == sorted(exp, key=repr)


def test_ewma_folds(spark):
    rng = random.Random(7)
    data = [(rng.choice("xy"), i, rng.random() * 10) for i in range(300)]
    whole, trunc = {}, {}
    for g, _, v in data:
        whole[g] = v if g not in whole else 0.9 * whole[g] + 0.1 * v
        trunc[g] = (9 * trunc.get(g, 0) + int(v * 100)) // 10
    df = spark.createDataFrame(data, "g string, i int, v double")
    assert {r["g"]: round(r["ewma"], 9) for r in ordered.ewma(df, "g", ["i"], "v").collect()} == {g: round(x, 9) for g, x in whole.items()}
    assert {r["g"]: r["ewma"] for r in ordered.ewma_int(df.withColumn("w", F.floor(F.col("v") * 100)), "g", ["i"], "w").collect()} == trunc


def test_numbered_is_dense(spark):
    df = spark.range(1000).withColumn("x", F.hash("id"))
    got = items.numbered(df, ["x", "id"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(1000))
    assert [r["x"] for r in got] == sorted(r["x"] for r in got)


SCHEMA = items.ITEM_SCHEMA


def item(i, created=1, kind="text", vector=None):
    return (i, (kind, f"data {i}", None), vector or [0.5] * 64, "{}", created, created + 5)


def test_write_rejects_whole_batches(spark, tmp_path):
    path = str(tmp_path / "items")
    good = spark.createDataFrame([item("a"), item("b")], SCHEMA)
    bad = spark.createDataFrame([item("c"), item("d", kind="invalid_type"), item("e", vector=[1.0])], SCHEMA)
    assert items.unwritten(good, path).count() == 2
    assert items.write_batch(good, path) == 2
    with pytest.raises(ValueError):
        items.write_batch(bad, path)
    assert spark.read.parquet(path).count() == 2
    assert items.unwritten(bad.unionByName(good), path).count() == 3


def test_upsert_delete_last_write(spark):
    base = spark.createDataFrame([item("a"), item("b")], SCHEMA)
    updates = spark.createDataFrame([item("b", 3), item("b", 2), item("c", 9)], SCHEMA)
    assert [(r["id"], r["created_at"]) for r in items.upsert(base, updates).orderBy("id").collect()] == [("a", 1), ("b", 3), ("c", 9)]
    assert [r["id"] for r in items.delete(base, updates).collect()] == ["a"]
    assert items.upsert(base.limit(0), updates.limit(0)).count() == 0
    with pytest.raises(ValueError):
        items.by_id(base, "")
    assert items.by_ids(base, [f"k{i}" for i in range(2000)] + ["a"]).count() == 1


def test_read_through(spark):
    store = spark.createDataFrame([item("a"), item("b")], SCHEMA)
    cached = spark.createDataFrame([item("a", 7)], SCHEMA)
    asked = spark.createDataFrame([("a",), ("b",), ("x",), ("a",)], "id string")
    assert [(r["id"], r["source"]) for r in items.read_through(asked, cached, store).orderBy("id").collect()] == [("a", "cache"), ("b", "store"), ("x", "miss")]


def test_time_to_live_boundary(spark):
    at = dt.datetime(2024, 1, 1)
    ns = int(at.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**9
    df = spark.createDataFrame([("a", ns + 100, at), ("b", ns - 5, at), ("c", None, at)], "id string, expires_at bigint, cached_at timestamp")
    assert [r["id"] for r in cache.live(df, F.lit(ns + 99)).orderBy("id").collect()] == ["a", "b", "c"]
    assert [r["id"] for r in cache.live(df, F.lit(ns + 100)).orderBy("id").collect()] == ["b", "c"]


def test_gzip_round_trip(spark):
    df = spark.createDataFrame([(b"x" * 5000,), (b"short",), (None,), (b"",)], "d binary")
    got = df.select("d", cache.compressed(F.col("d")).alias("z")).select("d", "z", cache.inflated(F.col("z")).alias("back")).collect()
    assert all(r["d"] == r["back"] for r in got)
    assert len(got[0]["z"]) < 100 and bytes(got[1]["z"]) == b"short"


def test_quantizer_errors_fall(spark):
    df = vectors(spark, 200, 8)
    book = quantize.train(df, 8, 5)
    one, two = (quantize.rq_encode(df, quantize.rq_train(df, n, 8, 3)).agg(F.avg("error")).first()[0] for n in (1, 2))
    assert two < one
    assert quantize.assign(df, book).select("code").distinct().count() > 1
    assert quantize.assign(df.limit(0), book).count() == 0


def test_layered_search_recall(spark):
    df = vectors(spark, 400, 8)
    q = df.filter("id % 20 = 0")
    assert search.recall(graph.layered_search(df, q, 5), knn(df, q, 5)).agg(F.avg("recall")).first()[0] > 0.9


def test_probes_and_empty_queries(spark):
    got = spark.range(1).select(lsh.probe_list(F.lit(5).cast("bigint"), 3, 9).alias("p")).first()["p"]
    assert got == [5, 4, 7, 1]
    df = vectors(spark, 20, 64)
    assert lsh.lsh_search(df, df.limit(0), 3).count() == 0


def test_adaptive_choice():
    assert search.choose(5, 10**9, 2**40, 1e9) == "hnsw"
    assert search.choose(5000, 2 * 10**6, 2**31, 1.0) == "lsh"
    assert search.choose(5000, 2 * 10**6, 2**20, 500.0) == "quantization"
    assert search.choose(5000, 10, 2**40, 500.0) == "hnsw"


def test_modes_of_adaptive_search(spark):
    df = vectors(spark, 80, 64)
    q = df.filter("id < 3")
    stats = {"queries": 1, "rows": 80, "memory": 1, "latency_ms": 1.0}
    for mode in ("hnsw", "lsh", "quantization", "hybrid", "standard"):
        got = search.adaptive_search(df, q, 3, stats, quantize.first_rows(df, 4), mode)
        assert got.select("index_type").distinct().first()[0] == mode
        assert got.filter("rank = 1 and query_id = item_id").count() == 3


def test_histogram_and_counts_of_nulls(spark):
    df = spark.createDataFrame([("a", 0.0005), ("a", 0.02), ("a", None), ("b", 5.0)], "op string, v double")
    got = {(r["op"], r["le"]): (r["n"], r["total"]) for r in metrics.histogram(df, "op", F.col("v"), metrics.CACHE_BOUNDS).collect()}
    assert got["a", 0.001] == (1, 2) and got["a", 0.025] == (2, 2) and got["b", 1.0] == (0, 1)


def test_delivered_once_keeps_the_first(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, t, 1, "a", "GET", 1.0, True), (1, t, t + dt.timedelta(1), 1, "a", "get", 2.0, True)], "seq bigint, ts timestamp, ingested_at timestamp, user_id bigint, item_key string, op string, latency_ms double, success boolean")
    got = access.delivered_once(df).collect()
    assert len(got) == 1 and got[0]["op"] == "get" and got[0]["latency_ms"] == 1.0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    exp = sorted((n, find(n)) for e in edges for n in set(e) if e[0] != e[1])
    got = sorted((r["node"], r["component"]) for r in components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == sorted(set(exp))
