"""Structured Streaming: ingest in micro-batches, deduplication, windows, and keyed state with expiry."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.keys import shard_of
from vecloom.operators.items import broken
from vecloom.operators.metrics import tumbling
from vecloom.runtime import scratch


def source(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # a stream reads folders; of this one, the file
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None, every: str | None = None) -> None:
    """Run a stream's micro-batches through ``write``: all there is and then stop, or ``every`` interval until stopped."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or scratch(spark, "stream"))
    query = writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, path: str, dimension: int = 64, shards: int = 16, **how: Any) -> None:
    """Validated, enriched append: rows that break a rule are left out, the others get their shard. Rows are judged one by one, so a
    batch is read once. A batch writes its own folder, so a repeated batch replaces itself and nothing is written twice."""
    valid = stream.filter(F.size(broken(dimension)) == 0).withColumn("shard", shard_of(F.col("id"), shards))
    run(valid, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), **how)


def close(rows: DataFrame, path: str, column: str = "ts") -> None:
    """End a log that goes on in the folder ``path``: one row of its latest time plus a thousand years and null otherwise, so that
    the watermark passes every window that is still open."""
    last = rows.agg(F.max(column).alias(column)).withColumn(column, (F.coalesce(F.col(column), F.lit("2000-01-01").cast(rows.schema[column].dataType)) + F.expr("INTERVAL 1000 YEARS")).cast(rows.schema[column].dataType))
    last.select(*[F.col(column) if c == column else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(path)


def closed(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], target: str, column: str = "ts") -> None:
    """Run ``plan`` over the log at ``path`` in append mode, each batch into its own folder of ``target``, and then end the log, so
    that all windows are written. State is dropped with the watermark, and what is written is not written again."""
    ends, checkpoint = scratch(spark, "ends"), scratch(spark, "stream")
    log = spark.read.parquet(path)
    stream = source(spark, path).unionByName(spark.readStream.schema(log.schema).parquet(ends))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    run(plan(stream), write, checkpoint=checkpoint)
    close(log, ends, column)
    # the same query goes on where it stopped
    run(plan(stream), write, checkpoint=checkpoint)


def delivered_once(stream: DataFrame, late: str = "14 days") -> DataFrame:
    """The log without repeated deliveries, as long as they come within ``late`` of each other."""
    return stream.withColumn("arrived", F.col("ingested_at").cast("timestamp")).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["seq"]).drop("arrived")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "14 days") -> DataFrame:
    """Tumbling counts, latency and success rate by operation."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).withColumn("op", F.lower(F.trim("op")))
    return tumbling(timed, "at", width, "op", F.when(F.col("latency_ms") >= 0, F.col("latency_ms")), "success")


def patterns(stream: DataFrame, idle: str = "24 hours", late: str = "14 days") -> DataFrame:
    """(item_key, start, accesses, last): access patterns of every key. A pattern ends when its key is not accessed for ``idle``;
    its state is dropped once the watermark has passed that end."""
    # rows without a key move the watermark, too: a filter on the key alone would be moved before it
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).filter(F.when(F.col("at").isNotNull(), F.col("item_key").isNotNull()))
    found = timed.groupBy(F.session_window("at", idle).alias("w"), "item_key").agg(F.count("*").alias("accesses"), F.max("at").alias("last"))
    return found.select("item_key", F.col("w.start").alias("start"), "accesses", "last")
