"""Operators over ordered groups that never bring a whole group to one task.

Rows are range-partitioned by (group, order) and sorted; each task works on its stretch of the order, and what
crosses a boundary is settled on one small row a task and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.runtime import shuffle_partitions, stage


def _changes(g: pa.Array) -> np.ndarray:
    """Whether a row begins a run of equal values; nulls are equal."""
    out = np.ones(len(g), bool)
    if len(g) > 1:
        a, b = g.slice(0, len(g) - 1), g.slice(1)
        same = np.asarray(pc.fill_null(pc.equal(a, b), False)) | (np.asarray(a.is_null()) & np.asarray(b.is_null()))
        out[1:] = ~same
    return out


def _sorted(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    return df.repartitionByRange(shuffle_partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order)


def successors(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, value, next): every row's value and that of the next row of its group; a group's last row has none.

    Null values are values. Ties of the order are settled by the value.
    """
    rows = _sorted(df.select(group, *order, F.col(value).alias("_v")), group, [*order, "_v"]).select(F.col(group).alias("g"), F.col("_v").alias("v"))
    g_type, v_type = (rows.schema[c].dataType for c in ("g", "v"))
    v_arrow = to_arrow_type(v_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = last = None

        def rows_of(kind: int, g: pa.Array, v: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.record_batch({"kind": pa.array(np.full(len(g), kind, np.int32)), "task": pa.array(np.full(len(g), task, np.int64)), "g": g, "v": v, "n": n})

        for batch in batches:
            g, v = batch["g"], batch["v"]
            if not len(g):
                continue
            if first is None:
                first = (g.slice(0, 1), v.slice(0, 1))
            else:
                g, v = pa.concat_arrays([last[0], g]), pa.concat_arrays([last[1], v])
            at = np.flatnonzero(~_changes(g)[1:])
            yield rows_of(0, g.take(pa.array(at)), v.take(pa.array(at)), v.take(pa.array(at + 1)))
            # copied, so that no batch is held for its last row
            last = (g.take(pa.array([len(g) - 1])), v.take(pa.array([len(v) - 1])))
        if first is not None:
            nothing = pa.nulls(1, v_arrow)
            yield rows_of(1, pa.concat_arrays([first[0], last[0]]), pa.concat_arrays([first[1], nothing]), pa.concat_arrays([nothing, last[1]]))

    g_name, v_name = g_type.simpleString(), v_type.simpleString()
    found = stage(rows.mapInArrow(run, f"kind int, task bigint, g {g_name}, v {v_name}, n {v_name}").withColumn("end", F.monotonically_increasing_id()), "successors")
    # two rows a task: its first row, then its last
    edge = found.filter("kind = 1").withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("end")))
    starts = edge.filter("place = 1").select("task", F.col("g").alias("sg"), F.col("v").alias("sv"))
    ends = edge.filter("place = 2").select("task", F.col("g").alias("eg"), F.col("n").alias("ev"))
    chain = starts.join(ends, "task").withColumn("before_g", F.lag("eg").over(Window.orderBy("task"))).withColumn("before_v", F.lag("ev").over(Window.orderBy("task"))).withColumn("known", F.lag(F.lit(True)).over(Window.orderBy("task")))
    across = chain.filter(F.col("known") & F.col("before_g").eqNullSafe(F.col("sg"))).select(F.col("sg").alias("g"), F.col("before_v").alias("v"), F.col("sv").alias("n"))
    return found.filter("kind = 0").select("g", "v", "n").unionByName(across).select(F.col("g").alias(group), F.col("v").alias(value), F.col("n").alias("next"))


def running_total(df: DataFrame, group: str, order: list[str], value: str, column: str = "total") -> DataFrame:
    """Rows with the sum of ``value`` (a bigint) over the rows of their group up to and with their own, in order."""
    rows = _sorted(df, group, order)
    names = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            g = batch[group]
            x = np.nan_to_num(batch[value].to_numpy(zero_copy_only=False)).astype(np.int64)
            if not len(g):
                continue
            change = _changes(g)
            sums = np.cumsum(x)
            base = np.maximum.accumulate(np.where(change, np.arange(len(g)), 0))
            own = sums - sums[base] + x[base]
            if last is not None and g[0].as_py() == last[0]:
                upto = int(np.flatnonzero(change[1:])[0]) + 1 if change[1:].any() else len(g)
                own[:upto] += total
            last, total = (g[len(g) - 1].as_py(),), int(own[-1])
            yield pa.record_batch({**{c: batch[c] for c in names}, "_task": pa.array(np.full(len(g), task, np.int64)), "_own": pa.array(own)})

    found = stage(rows.mapInArrow(run, f"{fields}, _task bigint, _own bigint"), "running")
    # a row for every task that holds part of a group
    parts = found.groupBy("_task", group).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_task", F.col(group).alias("_group"), "_base")
    joined = found.join(parts, (found["_task"] == parts["_task"]) & found[group].eqNullSafe(F.col("_group")))
    return joined.select(*[found[c] for c in names], (F.col("_own") + F.col("_base")).alias(column))


def ewma(df: DataFrame, group: str, order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """(group, n, ewma): exponentially weighted mean of a group's values in order, started with the first; nulls are skipped.

    Every task folds its stretch into (count, weighted sum), and stretches combine in order: the mean after one is
    (1 - alpha) to its count times the mean before, plus its sum.
    """
    rows = _sorted(df.filter(F.col(value).isNotNull()).select(group, *order, F.col(value).cast("double").alias("_v")), group, [*order, "_v"]).select(F.col(group).alias("g"), F.col("_v").alias("v"))
    g_arrow = to_arrow_type(rows.schema["g"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict = {}
        for batch in batches:
            values = batch["v"].to_numpy()
            starts = np.flatnonzero(_changes(batch["g"]))
            for start, stop in zip(starts, [*starts[1:], len(values)], strict=True):
                g, x = batch["g"][int(start)].as_py(), values[start:stop]
                # the fold over a run in one product
                weight = alpha * (1 - alpha) ** np.arange(len(x) - 1, -1, -1.0)
                folded, left = float(weight @ x), (1 - alpha) ** len(x)
                own = held.get(g)
                if own is None:
                    held[g] = [len(x), folded + left * float(x[0]), folded]
                else:
                    held[g] = [own[0] + len(x), left * own[1] + folded, left * own[2] + folded]
            if len(held) > 1:
                # sorted by group: all but the latest are complete
                *done, current = list(held)
                yield out(task, {g: held.pop(g) for g in done})
        yield out(task, held)

    def out(task: int, held: dict) -> pa.RecordBatch:
        return pa.record_batch({"task": pa.array([task] * len(held), pa.int64()), "g": pa.array(list(held), g_arrow), "n": pa.array([x[0] for x in held.values()], pa.int64()), "first": pa.array([x[1] for x in held.values()], pa.float64()), "later": pa.array([x[2] for x in held.values()], pa.float64())})

    parts = rows.mapInArrow(run, f"task bigint, g {rows.schema['g'].dataType.simpleString()}, n bigint, first double, later double")
    order_by = Window.partitionBy("g").orderBy(F.desc("task"))
    # one row a task and group
    parts = parts.withColumn("after", F.coalesce(F.sum("n").over(order_by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("is_first", F.row_number().over(Window.partitionBy("g").orderBy("task")) == 1)
    part = F.when(F.col("is_first"), F.col("first")).otherwise(F.col("later")) * F.pow(F.lit(1 - alpha), F.col("after"))
    return parts.groupBy("g").agg(F.sum("n").alias("n"), F.sum(part).alias("ewma")).withColumnRenamed("g", group)


def ewma_int(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """(group, n, ewma): the whole-number mean (9 * mean + value) div 10 from 0 on. Truncation makes it sequential: a group is
    one task's stream, held in constant memory."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), *order, F.col(value).cast("bigint").alias("_v")).repartition("g").sortWithinPartitions("g", *order, "_v").select("g", F.col("_v").alias("v"))
    g_arrow = to_arrow_type(rows.schema["g"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        n = mean = 0
        done: list[tuple] = []
        for batch in batches:
            for g, v in zip(batch["g"].to_pylist(), batch["v"].to_pylist(), strict=True):
                if current is None or current[0] != g:
                    if current is not None:
                        done.append((current[0], n, mean))
                    current, n, mean = (g,), 0, 0
                total = 9 * mean + v
                mean = total // 10 if total >= 0 else -(-total // 10)
                n += 1
        if current is not None:
            done.append((current[0], n, mean))
        yield pa.record_batch({"g": pa.array([d[0] for d in done], g_arrow), "n": pa.array([d[1] for d in done], pa.int64()), "ewma": pa.array([d[2] for d in done], pa.int64())})

    return rows.mapInArrow(run, f"g {rows.schema['g'].dataType.simpleString()}, n bigint, ewma bigint").withColumnRenamed("g", group)
