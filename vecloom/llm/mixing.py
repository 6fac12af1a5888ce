"""Mixing sources to target weights along a curriculum that changes over the course of training."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.tokens import token_sizes
from vecloom.runtime import stage


@dataclass(frozen=True)
class Mix:
    """``total``: tokens asked for; by default the most that keeps every share within its source's repeats. With a larger total
    a scarce source falls short of its share instead. ``steps``: intervals of time in which schedules are integrated."""

    total: int | None = None
    seed: int = 11
    steps: int = 500
    #: Documents of one epoch of a source that one bucket of the running sums holds on average.
    bucket: int = 20_000
    most_targets: int = 10_000
    most_points: int = 100_000


def source_name(column: Column) -> Column:
    """A source's name without surrounding white space and case."""
    return F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")))


def plan(sizes: Mapping[str, tuple[int, int]], targets: Mapping[str, tuple[float, int]], total: int | None) -> dict[str, tuple[float, float]]:
    """Per source its (share, tokens asked for). Shares are of the weights of sources that have tokens."""
    live = {s: w for s, (w, repeats) in targets.items() if w > 0 and repeats > 0 and sizes.get(s, (0, 0))[0] > 0}
    weight = sum(live.values())
    if not weight:
        return {}
    if total is None:
        total = int(min(targets[s][1] * sizes[s][0] * weight / w for s, w in live.items()))
    return {s: (w / weight, min(total * w / weight, float(targets[s][1] * sizes[s][0]))) for s, w in live.items()}


def schedules(points: DataFrame | None, most: int) -> dict[str, list[tuple[float, float]]]:
    """Per source its (time, weight) by time, from a table (source, time, weight); times outside 0 to 1 and weights that are
    null or negative don't count, and of several weights at one time the greatest does."""
    if points is None:
        return {}
    rows = points.select(source_name(F.col("source")).alias("name"), F.col("time").cast("double").alias("time"), F.col("weight").cast("double").alias("weight")).filter("name is not null and time between 0 and 1 and weight >= 0").groupBy("name", "time").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"at most {most} points of schedules")
    out: dict[str, list[tuple[float, float]]] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["time"])):
        out.setdefault(r["name"], []).append((r["time"], r["weight"]))
    return out


def curves(need: Mapping[str, float], points: Mapping[str, list[tuple[float, float]]], steps: int) -> dict[str, np.ndarray]:
    """Per source the part of its tokens that has been emitted at each of ``steps`` + 1 times, time being the part of all tokens.

    A source's weight runs in straight lines between its points and is constant without any. At every time the weights are
    divided by their sum, so they are shares; each is scaled so that the shares over all of time are those of ``need``.
    """
    names = [s for s, n in need.items() if n > 0]
    if not names:
        return {}
    middle = (np.arange(steps) + 0.5) / steps
    weight = np.ones((len(names), steps))
    for i, s in enumerate(names):
        if points.get(s):
            t, w = zip(*points[s], strict=True)
            # a source that is asked for at no time is asked for evenly; nothing stops all of them at once
            weight[i] = np.interp(middle, t, w)
            weight[i] = weight[i] / weight[i].mean() + 1e-9 if weight[i].mean() > 0 else 1.0
    goal = np.array([need[s] for s in names], np.float64)
    goal /= goal.sum()
    shares = weight * goal[:, None]
    for _ in range(1000):
        shares /= shares.sum(axis=0)
        reached = shares.mean(axis=1)
        if np.abs(reached - goal).max() < 1e-12:
            break
        shares *= (goal / reached)[:, None]
    sums = np.concatenate([np.zeros((len(names), 1)), np.cumsum(shares, axis=1)], axis=1)
    return {s: x / x[-1] for s, x in zip(names, sums, strict=True)}


def mix_sources(df: DataFrame, targets: DataFrame, schedule: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", how: Mix = Mix(), ranks: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the mix in training order, the shares reached).

    The mix has (position, id, source, copy, tokens), ``position`` rising from 0 to 1 over training and ``copy`` counting
    a document's repeats from 0. A source gives whole passes over its documents, each in another random order, until its
    tokens are reached; the last document may go over. No source is passed over more often than its ``max_repeats``.
    Shares have (source, target, share, documents, copies, tokens) for every source that has a target or documents: the
    share aimed at (null without a target) and reached. A target without documents reaches 0, and the others share its
    weight in proportion; documents without a target are not used.

    ``schedule`` (source, time, weight) says how weights change over training: straight lines between the points of a source, in
    proportion to its target; without points a source is mixed in evenly. Weights are divided by their sum at every time and
    scaled so that the shares of the whole mix stay those of the targets (``curves``). Time is the share of all tokens emitted.
    A document's position is the time at which the schedule has asked for the tokens before it: running sums within a
    source invert its integrated weight. They are made in two steps (buckets of a random order, then documents within a
    bucket), so a source with most of the rows is spread over many tasks. The mix is sorted by range partitions.

    Names are compared without case and surrounding blanks; a null source has no target. Texts of 0 tokens keep a place
    in the mix. Repeated rows are documents of their own. Of repeated targets the greatest weight counts. Empty tables give
    an empty mix. Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    asked = targets.select(source_name(F.col("source")).alias("name"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("repeats")).filter("name is not null").groupBy("name").agg(F.max(F.struct(F.coalesce("weight", F.lit(0.0)).alias("w"), F.coalesce("repeats", F.lit(1)).alias("r"))).alias("t")).limit(how.most_targets + 1).collect()
    if len(asked) > how.most_targets:
        raise ValueError(f"at most {how.most_targets} targets")
    wanted = {r["name"]: (r["t"]["w"], r["t"]["r"]) for r in asked}

    text = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source_name(F.col(source_col)).alias("name"))
    sized = stage(token_sizes(text, "id", "text", "name", ranks=ranks), "sizes")
    totals = sized.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    # as many rows as targets, at most
    sizes = {r["name"]: (r["tokens"], r["documents"]) for r in totals.filter(F.col("name").isin(list(wanted))).collect()} if wanted else {}
    planned = plan(sizes, wanted, how.total)
    rows = [(s, share, need, float(sizes[s][0]), max(1, -(-sizes[s][1] // how.bucket))) for s, (share, need) in sorted(planned.items())]
    sources = F.broadcast(spark.createDataFrame(rows, "name string, target double, need double, epoch double, buckets bigint"))
    shared = spark.sparkContext.broadcast(curves({s: need for s, (_, need) in planned.items()}, schedules(schedule, how.most_points), how.steps))
    id_type, id_arrow = text.schema["id"].dataType.simpleString(), to_arrow_type(text.schema["id"].dataType)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.minimum(batch["start"].to_numpy() / np.maximum(batch["need"].to_numpy(), 1e-300), 1.0)
            names = np.array(batch["name"].to_pylist(), dtype=object)
            position = np.zeros(len(part))
            for name in set(names.tolist()):
                curve = shared.value[name]
                own = names == name
                position[own] = np.interp(part[own], curve, np.linspace(0, 1, len(curve)))
            yield pa.record_batch({"position": pa.array(position), "id": batch["id"].cast(id_arrow), "source": batch["name"], "copy": batch["copy"], "tokens": batch["tokens"]})

    last = F.ceil(F.col("need") / F.greatest("epoch", F.lit(1.0))).cast("int")
    copies = sized.join(sources, "name").withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))))
    turn = F.shiftrightunsigned(F.xxhash64("id", "copy", F.lit(how.seed)), 33)
    copies = copies.withColumn("turn", turn).withColumn("bucket", F.shiftright(F.col("turn") * F.col("buckets"), 31))
    key = ["name", "copy", "bucket"]
    sums = copies.groupBy(*key).agg(F.sum("tokens").alias("held"))
    before = sums.withColumn("base", F.sum("held").over(Window.partitionBy("name", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*key, F.coalesce("base", F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy(*key).orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = copies.withColumn("within", within).join(before, key).withColumn("start", F.col("copy") * F.col("epoch") + F.col("base") + F.col("within"))
    taken = started.filter(F.col("start") < F.col("need"))
    placed = stage(taken.select("id", "name", "copy", "tokens", F.col("start").cast("double").alias("start"), "need").mapInArrow(place, f"position double, id {id_type}, source string, copy int, tokens bigint").withColumnRenamed("id", id_col), "mix")
    reached = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("last"))
    all_tokens = F.lit(float(placed.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]))
    targets_of = spark.createDataFrame([(s, planned[s][0] if s in planned else (0.0 if s not in sizes else w)) for s, (w, _) in wanted.items()], "name string, target double")
    # one row a source
    shares = (
        totals.join(targets_of, "name", "full")
        .join(reached.withColumnRenamed("source", "name"), "name", "left")
        .select(F.col("name").alias("source"), "target", F.coalesce(reached["tokens"], F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"), (F.coalesce("last", F.lit(-1)) + 1).alias("passes"))
        .withColumn("share", F.when(all_tokens > 0, F.col("tokens") / all_tokens))
    )
    return placed.orderBy("position", "source", "copy", id_col), shares.select("source", "target", "share", "documents", "copies", "passes", "tokens")
