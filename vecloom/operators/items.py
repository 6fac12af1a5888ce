"""Keyed and predicate reads, validated writes, upserts and deletes of item tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vecloom.functions.keys import valid_type
from vecloom.operators.knn import knn
from vecloom.runtime import shuffle_partitions, stage

ITEM_SCHEMA = "id string, content struct<type:string,data:string,format:map<string,string>>, vector array<float>, metadata string, created_at bigint, expires_at bigint"


def by_id(items: DataFrame, key: str) -> DataFrame:
    """Point lookup; the equality reaches the scan."""
    if not key:
        raise ValueError("a key is needed")
    return items.filter(F.col("id") == key)


def by_ids(items: DataFrame, keys: Iterable[str] | DataFrame, most_literals: int = 1000) -> DataFrame:
    """Rows of many keys: an IN list for few, a semi-join for long lists and tables of keys."""
    if isinstance(keys, DataFrame):
        return items.join(keys.select("id").distinct(), "id", "left_semi")
    keys = list(keys)
    if len(keys) <= most_literals:
        return items.filter(F.col("id").isin(keys))
    return items.join(items.sparkSession.createDataFrame([(k,) for k in set(keys)], "id string"), "id", "left_semi")


def where(items: DataFrame, predicate: Column, limit: int | None = None) -> DataFrame:
    """Rows of a predicate; a limit takes the first ones by id."""
    found = items.filter(predicate)
    return found if limit is None else found.orderBy("id").limit(limit)


def recent(items: DataFrame, hours: int = 24, limit: int = 1000) -> DataFrame:
    """The latest items of the last hours before the newest one, newest first."""
    newest = items.agg(F.max("created_at").alias("newest"))
    since = F.col("created_at") >= F.col("newest") - F.lit(hours * 3600 * 10**9).cast("bigint")
    return items.join(F.broadcast(newest), since).drop("newest").orderBy(F.desc("created_at"), "id").limit(limit)


def numbered(items: DataFrame, order: list[str], column: str = "idx") -> DataFrame:
    """Dense row numbers from 0 in the order given, without one task seeing all rows.

    Rows are range-partitioned and sorted; partition sizes give every partition its first number.
    """
    sorted_rows = items.repartitionByRange(shuffle_partitions(items.sparkSession), *order).sortWithinPartitions(*order)
    # staged, since both uses below must see the same partitions
    keyed = stage(sorted_rows.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() - (F.spark_partition_id().cast("bigint") * (1 << 33))), "numbered")
    sizes = keyed.groupBy("_p").agg(F.count("*").alias("_s"))
    # one row a partition
    first = sizes.withColumn("_first", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_first")
    return keyed.join(F.broadcast(first), "_p").withColumn(column, F.col("_first") + F.col("_n")).drop("_p", "_n", "_first")


def flush_batches(items: DataFrame, order: list[str], size: int = 2000) -> DataFrame:
    """Rows with the number of the batch they are flushed in, batches of ``size`` rows in order."""
    return numbered(items, order).withColumn("batch", F.floor(F.col("idx") / size))


def broken(dimension: int = 64, most_id: int = 256, most_data: int = 65535) -> Column:
    """The rules a row breaks, as an array of names; null values break the rule of their column. No rule sees another row."""
    rules = [
        ("id", F.col("id").isNull() | (F.length("id") > most_id) | (F.col("id") == "")),
        ("content_type", ~valid_type(F.col("content.type"))),
        ("dimension", F.coalesce(F.size("vector") != dimension, F.lit(True)) | F.col("vector").isNull()),
        ("content_data", F.coalesce(F.octet_length("content.data") > most_data, F.lit(False))),
        ("expiry", F.coalesce(F.col("expires_at") < F.col("created_at"), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def problems(items: DataFrame, dimension: int = 64, most_id: int = 256, most_data: int = 65535) -> DataFrame:
    """(id, problem): every rule an item breaks (``broken``)."""
    return items.select("id", F.explode(broken(dimension, most_id, most_data)).alias("problem"))


def write_batch(items: DataFrame, path: str, dimension: int = 64, mode: str = "append") -> int:
    """Validated write: any invalid item rejects the call before anything is written. Returns the rows written."""
    bad = problems(items, dimension)
    if not bad.isEmpty():
        raise ValueError(f"invalid items: {bad.limit(5).collect()}")
    items.write.mode(mode).parquet(path)
    return items.count()


def unwritten(items: DataFrame, path: str) -> DataFrame:
    """Ids that a re-read of the written table does not hold."""
    try:
        stored = items.sparkSession.read.schema("id string").parquet(path)
    except AnalysisException:
        return items.select("id")
    return items.select("id").join(stored, "id", "left_anti")


def delete(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id").distinct(), "id", "left_anti")


def upsert(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items with the updates in place of the rows of the same ids; of several updates of an id the latest counts."""
    latest = last_write(updates, "id", "created_at")
    return delete(items, latest).unionByName(latest)


def last_write(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key: a grouped maximum, combined before the shuffle, so hot keys stay small."""
    others = [c for c in rows.columns if c != key]
    # maps have no order, so they stand after everything that does and are carried as sorted entries
    turn = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in others]).alias("_tie"))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), turn).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def read_through(keys: DataFrame, cache: DataFrame, store: DataFrame) -> DataFrame:
    """(id, source, content, vector, metadata): each key's row from the cache, else from the store, else a miss."""
    fields = ["content", "vector", "metadata"]
    side = lambda df, name: df.select("id", F.struct(*fields).alias(name))
    joined = keys.select("id").distinct().join(side(cache, "c"), "id", "left").join(side(store, "s"), "id", "left")
    row = F.coalesce("c", "s")
    return joined.select("id", F.when(F.col("c").isNotNull(), "cache").when(F.col("s").isNotNull(), "store").otherwise("miss").alias("source"), *[row[f].alias(f) for f in fields])


def hydrate(hits: DataFrame, items: DataFrame, *fields: str) -> DataFrame:
    """Hits with fields of their items; hits of missing items are dropped."""
    return hits.join(items.select(F.col("id").alias("item_id"), *fields), "item_id")


__all__ = ["by_id", "by_ids", "delete", "flush_batches", "hydrate", "knn", "last_write", "numbered", "problems", "read_through", "recent", "unwritten", "upsert", "where", "write_batch"]
