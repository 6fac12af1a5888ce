"""Streaming queries: each runs over everything there is and gives the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import streaming
from vecloom.plans.store import _PROBLEMS
from vecloom.runtime import scratch


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "streamed")
    streaming.ingest(streaming.source(spark, f"{sf_dir}/store_items.parquet"), path)
    return spark.read.parquet(path).select("id", "shard")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "streamed")
    once = streaming.delivered_once(streaming.source(spark, f"{sf_dir}/access_log.parquet"))
    streaming.run(once.select("seq"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.parquet(path).select("seq")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "streamed")
    streaming.closed(spark, f"{sf_dir}/access_log.parquet", streaming.windowed, path)
    return spark.read.parquet(path).select("op", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("latency", 6).alias("latency"), F.round("rate", 6).alias("rate"))


def stream_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "streamed")
    streaming.closed(spark, f"{sf_dir}/access_log.parquet", streaming.patterns, path)
    return spark.read.parquet(path).select("item_key", F.col("start").cast("timestamp_ntz").alias("start"), "accesses", F.col("last").cast("timestamp_ntz").alias("last"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_dedup, stream_windows, stream_patterns)}

_FNV = "list_reduce(list_concat([2166136261::bigint], [ascii(c)::bigint for c in string_split(id, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
ORACLE = {
    "stream_ingest": f"with {_PROBLEMS} select id, {_FNV} % 16 as shard from store_items where id not in (select id from problems)",
    "stream_dedup": "select distinct seq from access_log",
    "stream_windows": "select lower(trim(op)) as op, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(avg(case when latency_ms >= 0 then latency_ms end), 6) as latency, round(avg(case when success then 1.0::double when not success then 0.0::double end), 6) as rate from access_log group by 1, 2",
    "stream_patterns": "with g as (select item_key, ts, case when ts - lag(ts) over (partition by item_key order by ts) < interval 24 hours then 0 else 1 end as fresh from access_log where item_key is not null), s as (select item_key, ts, sum(fresh) over (partition by item_key order by ts, fresh desc rows unbounded preceding) as n from g) select item_key, min(ts) as start, count(*) as accesses, max(ts) as last from s group by item_key, n",
}
