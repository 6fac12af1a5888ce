"""A store of vector items in Parquet with a cached copy beside it: the operators behind one interface.

A table is a folder of versions. Appends add files to the newest version; updates and deletes write the next one, which
counts once it is complete, so a failed job changes nothing and readers see whole versions.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.config import StoreConfig
from vecloom.operators import access, cache, graph, items, quantize, search
from vecloom.operators.diff import ITEM_FIELDS, table_diff
from vecloom.runtime import stage

#: Data above the threshold of the configuration is held as ``packed``, and null in ``content``.
CACHE_SCHEMA = items.ITEM_SCHEMA + ", cached_at timestamp, packed binary"
RESULT_SCHEMA = "key string, hits array<struct<rank:bigint,item_id:string,distance:double>>, cached_at timestamp"


class Versions:
    """A table of which whole versions are written."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):  # noqa: ANN202
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the newest complete version, -1 without one."""
        target, files = self._files()
        if not files.exists(target):
            return -1
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        numbers = [int(s.getPath().getName()[1:]) for s in files.listStatus(target) if s.getPath().getName()[1:].isdigit()]
        return max((n for n in numbers if files.exists(path(f"{self.path}/v{n}/_SUCCESS"))), default=-1)

    def read(self) -> DataFrame:
        n = self.current()
        return self.spark.createDataFrame([], self.schema) if n < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{n}")

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/v{max(self.current(), 0)}")

    def replace(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{self.current() + 1}")


class ItemStore:
    """Items and their cached copy under one path."""

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig()) -> None:
        self.spark, self.config = spark, config
        self.table = Versions(spark, f"{path}/items", items.ITEM_SCHEMA)
        self.cached = Versions(spark, f"{path}/cache", CACHE_SCHEMA)
        self.results = Versions(spark, f"{path}/results", RESULT_SCHEMA)

    def items(self) -> DataFrame:
        return self.table.read()

    def _entries(self) -> DataFrame:
        """All cached rows with their data as it was written."""
        data = F.when(F.col("packed").isNotNull(), F.decode(cache.inflated(F.col("packed")), "utf-8")).otherwise(F.col("content.data"))
        return self.cached.read().withColumn("content", F.col("content").withField("data", data)).drop("packed")

    def cache(self) -> DataFrame:
        """Cached entries that count: the latest of each id."""
        return items.last_write(self._entries(), "id", "cached_at")

    def size(self) -> int:
        return self.items().count()

    def _checked(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "content", "vector", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", "expires_at")
        bad = items.problems(rows, self.config.dimension)
        if not bad.isEmpty():
            raise ValueError(f"invalid items: {bad.limit(5).collect()}")
        return rows

    def _remember(self, rows: DataFrame) -> None:
        self.cached.append(self._packed(rows))

    def _packed(self, rows: DataFrame) -> DataFrame:
        least = self.config.cache.compress_above
        data = F.encode(F.col("content.data"), "utf-8")
        large = F.coalesce(F.octet_length(data) > least, F.lit(False))
        rows = rows.withColumn("packed", F.when(large, cache.compressed(data, least)))
        kept = F.when(F.col("packed").isNull(), F.col("content.data"))
        return rows.withColumn("content", F.col("content").withField("data", kept)).withColumn("cached_at", F.current_timestamp()).select("id", "content", "vector", "metadata", "created_at", "expires_at", "cached_at", "packed")

    def clear(self) -> None:
        """Empty the cache, of items and of search results."""
        self.cached.replace(self.spark.createDataFrame([], CACHE_SCHEMA))
        self.results.replace(self.spark.createDataFrame([], RESULT_SCHEMA))

    def _forget(self) -> None:
        if self.results.current() >= 0:
            self.results.replace(self.spark.createDataFrame([], RESULT_SCHEMA))

    def set(self, rows: DataFrame) -> None:
        """Write items, new or not, to the store and the cache; any invalid item rejects the call before it writes."""
        rows = self._checked(rows)
        self._forget()
        held = self.items().join(rows.select("id"), "id", "left_semi")
        if held.isEmpty():
            self.table.append(items.last_write(rows, "id", "created_at"))
        else:
            self.table.replace(items.upsert(self.items(), rows))
        self._remember(rows)

    def get(self, ids: Iterable[str]) -> DataFrame:
        """Items of the ids, from the cache while they live or else the store; what the store gave is cached. Misses have no row."""
        asked = self.spark.createDataFrame([(i,) for i in ids], "id string")
        found = items.read_through(asked, self.live(time.time_ns()), self.items())
        missed = found.filter("source = 'store'").select("id")
        if not missed.isEmpty():
            self._remember(items.by_ids(self.items(), missed))
        return found.filter("source <> 'miss'")

    def search(self, queries: DataFrame, k: int, mode: str = "standard", book: np.ndarray | None = None) -> DataFrame:
        """(query_id, item_id, rank, distance, index_type) by the index named, or by the one that serves best for ``adaptive``.

        Results younger than the configured minutes are given again (index type ``cached``); of the others results are kept
        and the items found are cached. Writes and deletes drop kept results.
        """
        rows = self.items()
        queries = queries.select("id", "vector")
        known = stage(cache.remembered(self.results.read(), queries, k, F.lit(time.time_ns()), self.config.cache.query_ttl_minutes), "results")
        again = known.select("query_id", F.explode("hits").alias("h")).select("query_id", "h.item_id", "h.rank", "h.distance", F.lit("cached").alias("index_type"))
        fresh = queries.join(known.select(F.col("query_id").alias("id")), "id", "left_anti")
        if fresh.isEmpty():
            return again
        stats = {"queries": self.config.min_queries, "rows": rows.count(), "memory": 0, "latency_ms": 0.0}
        found = stage(search.adaptive_search(rows, fresh, k, stats, book, None if mode == "adaptive" else mode, config=self.config.hashing), "found")
        self.results.append(cache.to_remember(found, fresh, k).withColumn("cached_at", F.current_timestamp()))
        held = self.live(time.time_ns()).select("id")
        self._remember(items.by_ids(rows, found.select(F.col("item_id").alias("id"))).join(held, "id", "left_anti"))
        return found.unionByName(again)

    def graph(self) -> DataFrame:
        """Similarity edges of all items, by the configured threshold and number of neighbours."""
        how = self.config.graph
        return graph.similarity_edges(self.items(), how.similarity, how.neighbours)

    def search_graph(self, edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Best-first search of ``graph()`` from the item with the least id (``graph.best_first``)."""
        first = self.items().agg(F.min("id").alias("id")).first()["id"]
        return graph.best_first(edges, self.items(), queries, k, first, self.config.graph.depth)

    def quantize(self, kind: str) -> DataFrame:
        """(id, codes, error) by a quantizer of that kind, trained on the items by the configured parameters."""
        book = quantize.trained(self.items(), kind, self.config.quantizer)
        return quantize.encode(self.items(), kind, book, probe=self.config.quantizer.probe)

    def similar_queries(self, cached: DataFrame, asked: DataFrame) -> DataFrame:
        return cache.similar_queries(cached, asked, self.config.cache.query_similarity)

    def delete(self, ids: Iterable[str]) -> DataFrame:
        """Delete from store and cache; (id, in_store, in_cache): where each id was found."""
        gone = self.spark.createDataFrame([(i,) for i in ids], "id string").distinct()
        mark = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
        report = gone.join(mark(self.items(), "in_store"), "id", "left").join(mark(self.cached.read(), "in_cache"), "id", "left").select("id", F.coalesce("in_store", F.lit(False)).alias("in_store"), F.coalesce("in_cache", F.lit(False)).alias("in_cache"))
        # as many rows as ids were given
        kept = self.spark.createDataFrame(report.collect(), report.schema)
        self._forget()
        self.table.replace(items.delete(self.items(), gone))
        self.cached.replace(items.delete(self.cached.read(), gone))
        return kept

    def verify(self, repair: bool = False) -> DataFrame:
        """(id, field) of every difference between store and cache; ``repair`` makes the cache equal to the store."""
        found = table_diff(self.items(), self._entries(), "id", ITEM_FIELDS, left_name="store", right_name="cache", right_latest="cached_at")
        if repair:
            self.cached.replace(self._packed(self.items()))
        return found

    def warm(self, log: DataFrame) -> DataFrame:
        """Load what the access log says is wanted and the cache does not hold; the keys loaded."""
        rules = self.config.warming
        wanted = access.warming(access.counts(log), access.newest(log), self.cached.read(), rules.least_accesses, rules.hours)
        loaded = items.by_ids(self.items(), wanted.select(F.col("item_key").alias("id")))
        self._remember(loaded)
        return wanted

    def live(self, now_ns: int) -> DataFrame:
        """Cached entries that have not outlived their time."""
        return cache.live(self.cache(), F.lit(now_ns))
