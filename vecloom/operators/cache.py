"""Cache contents and simulations."""

from __future__ import annotations

import gzip
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.keys import query_key, shard_of, time_to_live
from vecloom.functions.vector import cosine
from vecloom.operators.ordered import running_total


def nanoseconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def live(cache: DataFrame, now_ns: Column) -> DataFrame:
    """Entries younger than their time to live at ``now_ns``, with ``ttl_ns``."""
    cached = nanoseconds(F.col("cached_at"))
    return cache.withColumn("ttl_ns", time_to_live(F.col("expires_at"), cached)).filter(now_ns - cached < F.col("ttl_ns"))


def residency(log: DataFrame, capacity: int, shards: int = 16, key: str = "item_key", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(shard, key, place): what an LRU cache of ``capacity`` keys a shard holds at the end, most recent first.

    Last accesses are found first (combined before the shuffle), so ranking sees one row a key and stops at the capacity.
    """
    last = log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("last"))
    ranked = last.withColumn("shard", shard_of(F.col(key), shards)).withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("last"), key)))
    return ranked.filter(F.col("place") <= capacity).select("shard", key, F.col("place").cast("bigint").alias("place"))


def hit_counts(log: DataFrame, shard: Column, capacity: int, key: str, order: tuple[str, ...]) -> DataFrame:
    """(shard, accesses, hits) of LRU caches of ``capacity`` keys. A shard is a sorted stream through one simulated cache,
    so a task holds ``capacity`` keys, not a shard; more shards give more tasks."""
    rows = log.filter(F.col(key).isNotNull()).select(shard.cast("bigint").alias("shard"), *order, F.col(key).cast("string").alias("k")).repartition("shard").sortWithinPartitions("shard", *order, "k").select("shard", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[str, None] = OrderedDict()
        current, n, hits = None, 0, 0
        done: list[tuple[int, int, int]] = []
        for batch in batches:
            for s, k in zip(batch["shard"].to_pylist(), batch["k"].to_pylist(), strict=True):
                if s != current:
                    if current is not None:
                        done.append((current, n, hits))
                    current, n, hits = s, 0, 0
                    cache.clear()
                n += 1
                if k in cache:
                    hits += 1
                    cache.move_to_end(k)
                else:
                    cache[k] = None
                    if len(cache) > capacity:
                        cache.popitem(last=False)
        if current is not None:
            done.append((current, n, hits))
        yield pa.record_batch({name: pa.array([d[i] for d in done], pa.int64()) for i, name in enumerate(("shard", "accesses", "hits"))})

    return rows.mapInArrow(run, "shard bigint, accesses bigint, hits bigint")


def within_budget(entries: DataFrame, budget: int, shards: int = 4, key: str = "id") -> DataFrame:
    """(shard, key, bytes, total): the newest entries of each shard that together stay within ``budget`` bytes; entries larger
    than the budget are not admitted. ``entries`` has (key, bytes, at)."""
    admitted = entries.filter(F.col("bytes") <= budget).withColumn("shard", shard_of(F.col(key), shards)).withColumn("age", -F.col("at"))
    summed = running_total(admitted.select("shard", "age", key, "bytes"), "shard", ["age", key], "bytes")
    return summed.filter(F.col("total") <= budget).select("shard", key, "bytes", "total")


def _squeeze(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else gzip.compress(x, mtime=0) for x in data], dtype=object)


def _inflate(data: pd.Series) -> pd.Series:
    return pd.Series([gzip.decompress(x) if x is not None and x[:2] == b"\x1f\x8b" else x for x in data], dtype=object)


def compressed(data: Column, threshold: int = 1024) -> Column:
    """Bytes as the cache holds them: gzip above the threshold, as they are up to it."""
    squeeze = F.pandas_udf(_squeeze, T.BinaryType())
    large = F.octet_length(data) > threshold
    return F.when(large, squeeze(F.when(large, data))).otherwise(data)


def inflated(data: Column) -> Column:
    """What ``compressed`` held: gzip by its first two bytes, anything else unchanged."""
    return F.pandas_udf(_inflate, T.BinaryType())(data)


def remembered(results: DataFrame, queries: DataFrame, k: int, now: Column, minutes: int = 5) -> DataFrame:
    """(query_id, key, hits): cached results of the queries (id, vector), the latest of each key that is at most ``minutes`` old.

    ``results`` has (key, hits, cached_at); ``key`` is ``query_key``, so scaled vectors share results and limits do not. Zero
    vectors have no key and no results.
    """
    asked = queries.select(F.col("id").alias("query_id"), query_key(F.col("vector"), k).alias("key")).filter("key is not null")
    young = results.filter(now - nanoseconds(F.col("cached_at")) <= F.lit(minutes * 60 * 10**9))
    latest = young.groupBy("key").agg(F.max_by("hits", "cached_at").alias("hits"))
    return asked.join(latest, "key").select("query_id", "key", "hits")


def to_remember(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(key, hits): search results (query_id, item_id, rank, distance) as one row for each query key, ``k`` hits at most."""
    keyed = queries.select(F.col("id").alias("query_id"), query_key(F.col("vector"), k).alias("key")).filter("key is not null")
    packed = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "distance"))).alias("hits"))
    return keyed.join(packed, "query_id").groupBy("key").agg(F.min_by("hits", "query_id").alias("hits"))


def similar_queries(cached: DataFrame, asked: DataFrame, least: float = 0.95) -> DataFrame:
    """(query_id, cached_id, similarity): for every query asked the most similar cached one of similarity ``least`` or more."""
    from vecloom.operators.knn import knn

    near = knn(cached, asked, 1, "cosine", "id", "vector", 1.0 - least, True)
    return near.select("query_id", F.col("item_id").alias("cached_id"), (1.0 - F.col("distance")).alias("similarity"))


__all__ = ["compressed", "cosine", "hit_counts", "inflated", "live", "nanoseconds", "remembered", "residency", "similar_queries", "to_remember", "within_budget"]
