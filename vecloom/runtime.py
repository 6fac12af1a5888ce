"""Session-level helpers: the shared folder, staged tables and fixed-size dense summaries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, as the session names it in ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vecloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/vecloom-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # deletion on exit takes only what is there when it is asked for
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it. The files are deleted when
    the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read again, and let the driver's collector find the shuffle
    files of the jobs that wrote them, which Spark removes once their plans are garbage. For loops that stage often."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
            spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column: pa.Array | pa.ChunkedArray, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column whose texts hold about ``chars`` bytes together (always one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield start, stop
        start = stop


#: Cells of one slice of a dense summary; a slice is one row in the shuffle.
SLICE_CELLS = 1 << 14


def dense_summary(df: DataFrame, fill: Callable[[Iterable[pa.RecordBatch], np.ndarray], None], cells: int) -> np.ndarray:
    """Sum a fixed number of counters over all rows of ``df``.

    ``fill(batches, counters)`` adds one task's rows to its own counters. What moves is bounded by the
    number of cells a task, and what reaches the driver by the number of cells, whatever the rows.
    """
    n_slices = -(-cells // SLICE_CELLS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(n_slices * SLICE_CELLS, dtype=np.int64)
        fill(batches, counters)
        parts = counters.reshape(n_slices, SLICE_CELLS)
        rows = [i for i in range(n_slices) if parts[i].any()]
        if rows:
            top = int(counters.max())
            kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64
            yield pa.record_batch({"slice": pa.array(rows, pa.int32()), "width": pa.array([np.dtype(kind).itemsize] * len(rows), pa.int32()), "cells": pa.array([parts[i].astype(kind).tobytes() for i in rows], pa.binary())})

    kinds = {1: np.uint8, 2: np.uint16, 8: np.int64}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, width, cells_ in zip(batch["slice"].to_pylist(), batch["width"].to_pylist(), batch["cells"], strict=True):
                part = np.frombuffer(cells_.as_buffer(), dtype=kinds[width])
                if i not in sums:
                    sums[i] = np.zeros(SLICE_CELLS, dtype=np.int64)
                sums[i] += part
        if sums:
            yield pa.record_batch({"slice": pa.array(list(sums), pa.int32()), "width": pa.array([8] * len(sums), pa.int32()), "cells": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "slice int, width int, cells binary"
    merged = df.mapInArrow(local, schema).repartition(min(n_slices, shuffle_partitions(df.sparkSession)), "slice").mapInArrow(merge, schema)
    total = np.zeros(n_slices * SLICE_CELLS, dtype=np.int64)
    for row in merged.select("slice", "cells").collect():
        total[row["slice"] * SLICE_CELLS : (row["slice"] + 1) * SLICE_CELLS] = np.frombuffer(row["cells"], dtype=np.int64)
    return total[:cells]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component being the least node.

    Alternates the large-star and small-star steps, so no group is ever gathered: every step is a grouped
    minimum and a join, and the edge list never grows. Stops when a round changes nothing.
    """
    links = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(),
        "links",
    )
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node points to the node's least neighbour (or itself)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node's smaller neighbours and the node itself point to its least neighbour
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        after = stage(small, "links")
        # a star forest is reached when no node both points and is pointed to, and each points once
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        before = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        links = after
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
