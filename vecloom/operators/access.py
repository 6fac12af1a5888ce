"""Access logs: cleaning, counts, transitions, prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.ordered import successors


def delivered_once(log: DataFrame) -> DataFrame:
    """The log without repeated deliveries: of the rows of a ``seq`` the one first ingested; operations in lower case."""
    others = [c for c in log.columns if c != "seq"]
    first = log.groupBy("seq").agg(F.min_by(F.struct(*others), F.struct("ingested_at", "ts", "user_id", "item_key", "op", "latency_ms", "success")).alias("row"))
    return first.select("seq", "row.*").withColumn("op", F.lower(F.trim("op")))


def counts(log: DataFrame, key: str = "item_key", at: str = "ts") -> DataFrame:
    """(key, accesses, last_access), combined before the shuffle."""
    return log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("accesses"), F.max(at).alias("last_access"))


def newest(log: DataFrame, at: str = "ts") -> DataFrame:
    return log.agg(F.max(at).alias("now"))


def fresh(counted: DataFrame, now: DataFrame, hours: int = 24) -> DataFrame:
    """Counts whose last access is within ``hours`` of ``now`` (a table of one row)."""
    return counted.join(F.broadcast(now), F.col("last_access") >= F.col("now") - F.expr(f"INTERVAL {hours} HOURS")).drop("now")


def frequent(counted: DataFrame, least: int, most: int, key: str = "item_key") -> DataFrame:
    """The ``most`` keys of at least ``least`` accesses with the most accesses, ties by key."""
    return counted.filter(F.col("accesses") >= least).orderBy(F.desc("accesses"), key).limit(most)


def transitions(log: DataFrame, user: str = "user_id", order: tuple[str, ...] = ("ts", "seq"), key: str = "item_key") -> DataFrame:
    """(prev, next, n): how often a user's access of one key is followed by one of another, whatever a user's share of rows."""
    pairs = successors(log.filter(F.col(key).isNotNull() & F.col(user).isNotNull()), user, list(order), key)
    return pairs.groupBy(F.col(key).alias("prev"), "next").agg(F.count("*").alias("n"))


def predict(moves: DataFrame, most: int = 5, direct: float = 0.6, indirect: float = 0.3) -> DataFrame:
    """(key, candidate, score, rank): the ``most`` likeliest next keys: direct successors, and successors of predecessors."""
    straight = moves.select(F.col("prev").alias("key"), F.col("next").alias("candidate"), (F.col("n") * F.lit(direct)).alias("score"))
    before = moves.select(F.col("next").alias("key"), F.col("prev").alias("via"))
    around = before.join(moves.select(F.col("prev").alias("via"), F.col("next").alias("candidate"), "n"), "via").select("key", "candidate", (F.col("n") * F.lit(indirect)).alias("score"))
    total = straight.unionByName(around).groupBy("key", "candidate").agg(F.round(F.sum("score"), 6).alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "candidate")
    return total.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)


def warming(counted: DataFrame, now: DataFrame, cached: DataFrame, least: int = 5, hours: int = 24, key: str = "item_key") -> DataFrame:
    """Keys worth loading into the cache: accessed often enough, lately, and not cached."""
    return fresh(counted.filter(F.col("accesses") >= least), now, hours).join(cached.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def label(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))
