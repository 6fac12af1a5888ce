"""Metric families over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histograms, in seconds.
CACHE_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
STORE_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
CHECK_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
POOL_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, label: str, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """(label, le, n, total, sum): cumulative counts by upper bound. One pass and one row a label in the shuffle; the
    bounds become rows afterwards. Null values are not counted."""
    v = events.select(F.col(label), value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    sums = v.groupBy(label).agg(F.count("*").alias("total"), F.sum("v").alias("sum"), *[F.count_if(F.col("v") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return sums.select(label, F.explode(rows).alias("r"), "total", "sum").select(label, "r.le", "r.n", "total", "sum")


def last_values(events: DataFrame, label: str, value: str, *order: str) -> DataFrame:
    """(label, value): the latest value of each label."""
    return events.filter(F.col(value).isNotNull()).groupBy(label).agg(F.max_by(value, F.struct(*order)).alias(value))


def success_rates(events: DataFrame, label: str, success: str) -> DataFrame:
    return events.groupBy(label).agg(F.avg(F.col(success).cast("double")).alias("rate"), F.count(success).alias("n"))


def tumbling(events: DataFrame, at: str, width: str, label: str, latency: Column, success: str) -> DataFrame:
    """(label, start, n, latency, rate) in windows of ``width``; works on streams with a watermark on ``at`` as well."""
    return events.groupBy(F.window(at, width).alias("w"), label).agg(F.count("*").alias("n"), F.avg(latency).alias("latency"), F.avg(F.col(success).cast("double")).alias("rate")).select(label, F.col("w.start").alias("start"), "n", "latency", "rate")


def check_report(runs: DataFrame) -> DataFrame:
    """One row over verification runs: finished and unfinished ones, sums, and runs whose stated duration is wrong."""
    real = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) * 1000
    done = F.col("end_time").isNotNull()
    return runs.agg(
        F.count_if(done).alias("finished"),
        F.count_if(~done).alias("unfinished"),
        F.sum("checked").alias("checked"),
        F.sum("mismatches").alias("mismatches"),
        F.sum("repaired").alias("repaired"),
        F.coalesce(F.sum(F.size("errors").cast("bigint")), F.lit(0)).alias("errors"),
        F.count_if(done & (real != F.col("duration_ns"))).alias("wrong_durations"),
    )
