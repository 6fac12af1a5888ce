"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

METRICS = ("l2sq", "cosine", "dot", "auto")
Metric = str | Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Queries of a block: what is broadcast at most, and what a task holds at a time.
BLOCK = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances of every query to every row, less is nearer, and how far they may be off: squared L2, 1 - cosine (1 for a zero
    vector), or - dot. Products of matrices sum in an order that depends on their shapes, so these only choose (``measured``)."""
    s = q @ x.T
    a, b = (q * q).sum(axis=1), (x * x).sum(axis=1)
    slack = 1e-11 * float(a.max(initial=0) + b.max(initial=0) + 1)
    if metric == "l2sq":
        return a[:, None] + b[None, :] - 2 * s, slack
    if metric == "dot":
        return -s, slack
    both = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
    return 1.0 - np.divide(s, both, out=np.zeros_like(s), where=both > 0), 1e-11


def measured(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``q`` to the same row of ``x``, summed in one order whatever the blocks."""
    if metric == "l2sq":
        return ((q - x) ** 2).sum(axis=1)
    s = (q * x).sum(axis=1)
    if metric == "dot":
        return -s
    both = np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
    return 1.0 - np.divide(s, both, out=np.zeros_like(s), where=both > 0)


class Nearest:
    """The k nearest rows of every query of a block so far, ties by id; holds k a query, however many tie.

    ``most``: greatest distance. Without ``k``, ``add`` returns all within it instead. ``also``: a second metric to report.
    """

    PAIRS = 100_000

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int | None, metric: Metric, most: float | None = None, skip_self: bool = False, also: str | None = None) -> None:
        self.names, self.q, self.k, self.metric, self.skip_self, self.also = names, q, k, metric, skip_self, also
        self.most = np.inf if most is None else most
        self.owner, self.ids = np.zeros(0, np.int64), None
        self.values = np.zeros((0, 2))
        self.limit = np.full(len(q), self.most)

    def add(self, ids: np.ndarray, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes rows (and of them, per query, those that ``mask`` allows); returns (query, id, distances) where there is no k."""
        out = []
        step = max(1, 2_000_000 // max(1, len(x)))
        for low in range(0, len(self.q), step):
            own = slice(low, low + step)
            d, slack = (self.metric(self.q[own], x), 0.0) if callable(self.metric) else distances(self.q[own], x, self.metric)
            if mask is not None:
                d = np.where(mask[own], d, np.inf)
            if self.skip_self:
                d = np.where(self.names[own, None] == ids[None, :], np.inf, d)
            limit = self.limit[own]
            if self.k is not None and d.shape[1] > self.k:
                limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            rows, columns = np.nonzero((d <= limit[:, None] + slack) & (d < np.inf))
            for at in range(0, len(rows), self.PAIRS):
                r, c = rows[at : at + self.PAIRS], columns[at : at + self.PAIRS]
                a, b = self.q[low + r], x[c]
                value = d[r, c] if callable(self.metric) else measured(a, b, self.metric)
                second = measured(a, b, self.also) if self.also else value
                keep = value <= self.most
                found = low + r[keep], ids[c[keep]], np.stack([value[keep], second[keep]], axis=1)
                if self.k is None:
                    out.append(found)
                else:
                    self._merge(*found)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), ids[:0], np.zeros((0, 2)))

    def _merge(self, owner: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        owner = np.concatenate([self.owner, owner])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        values = np.concatenate([self.values, values])
        order = np.lexsort((ids, values[:, 0], owner))
        own = owner[order]
        first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        keep = order[rank < self.k]
        self.owner, self.ids, self.values = owner[keep], ids[keep], values[keep]
        last = order[rank == self.k - 1]
        self.limit[owner[last]] = np.minimum(self.most, values[last, 0])


def _batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of rows whose vectors have the dimension."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            batch = batch.filter(pa.array(np.asarray(batch["vector"].value_lengths().to_numpy(zero_copy_only=False) == dimension)))
            if batch.num_rows:
                yield np.array(batch["id"].to_pylist()), matrix(batch["vector"])


def _hits(names: np.ndarray, owner: np.ndarray, ids: np.ndarray, values: np.ndarray, query_arrow: pa.DataType, item_arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(owner), 20_000):
        own = slice(at, at + 20_000)
        yield pa.record_batch({"query_id": pa.array(names[owner[own]].tolist(), query_arrow), "item_id": pa.array(ids[own].tolist(), item_arrow), "distance": pa.array(values[own, 0]), "also": pa.array(values[own, 1])})


def scan(source: DataFrame, ids: list, q: np.ndarray, k: int | None, metric: Metric, most: float | None = None, skip_self: bool = False, also: str | None = None, query_type: str | None = None, masks: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, item_id, distance, also): each task's k nearest of (id, vector) for a broadcast block of queries. ``masks`` gives,
    of a matrix of rows, which may be in whose result."""
    kind = source.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(source.schema["id"].dataType)
    shared = source.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = np.array(shared.value[0]), shared.value[1]
        best = Nearest(names, q, k, metric, most, skip_self, also)
        for own, x in _batches(batches, q.shape[1]):
            found = best.add(own, x, None if masks is None else masks(x))
            if k is None:
                yield from _hits(names, *found, arrow_q, arrow)
        if k is not None and best.ids is not None:
            yield from _hits(names, best.owner, best.ids, best.values, arrow_q, arrow)

    query_type = query_type or kind
    arrow_q = pa.array(ids[:1]).type if query_type != kind else arrow
    return source.mapInArrow(run, f"query_id {query_type}, item_id {kind}, distance double, also double")


def _packed(df: DataFrame, ids: str, vectors: str, block: int) -> DataFrame:
    """(dimension, ids, vectors): blocks of a task's rows, each of vectors of one length."""
    kind, arrow = df.schema["id"].dataType.simpleString(), to_arrow_type(df.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dimension: int) -> pa.RecordBatch:
            own, x = held.pop(dimension)
            return pa.record_batch({"dimension": pa.array([dimension], pa.int32()), ids: pa.array([own], pa.list_(arrow)), vectors: pa.array([np.concatenate(x).tobytes()], pa.binary())})

        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                lengths = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
                for dimension in np.unique(lengths).tolist():
                    part = batch.filter(pa.array(lengths == dimension))
                    own, x = held.setdefault(int(dimension), ([], []))
                    if len(own) + part.num_rows > block and own:
                        yield out(int(dimension))
                        own, x = held.setdefault(int(dimension), ([], []))
                    own.extend(part["id"].to_pylist())
                    x.append(matrix(part["vector"]).reshape(part.num_rows, -1))
        for dimension in list(held):
            yield out(dimension)

    return df.mapInArrow(run, f"dimension int, {ids} array<{kind}>, {vectors} binary")


def _meeting(source: DataFrame, asked: DataFrame, k: int | None, metric: Metric, most: float | None, skip_self: bool, block: int) -> DataFrame:
    """As ``scan``, for any number of queries: blocks of queries and of items meet in a square of tasks, each block being sent once
    to every task of its row or column. Nothing passes through the driver."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = int(np.ceil(np.sqrt(parts)))
    place = lambda c: F.pmod(F.xxhash64(F.col(c)[0], F.size(c)), F.lit(side)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    left = _packed(asked, "names", "q", block).withColumn("row", place("names")).withColumn("column", every)
    right = _packed(source, "ids", "x", block).withColumn("column", place("ids")).withColumn("row", every)
    query_type, kind = asked.schema["id"].dataType.simpleString(), source.schema["id"].dataType.simpleString()
    arrow_q, arrow = to_arrow_type(asked.schema["id"].dataType), to_arrow_type(source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one block of queries follow each other, so one block's best are held at a time
        last, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                turn = batch["turn"][i].as_py()
                if turn != last:
                    if best is not None and best.ids is not None:
                        yield from _hits(best.names, best.owner, best.ids, best.values, arrow_q, arrow)
                    dimension = batch["dimension"][i].as_py()
                    best = Nearest(np.array(batch["names"][i].as_py()), np.frombuffer(batch["q"][i].as_py()).reshape(-1, dimension), k, metric, most, skip_self)
                    last = turn
                found = best.add(np.array(batch["ids"][i].as_py()), np.frombuffer(batch["x"][i].as_py()).reshape(-1, best.q.shape[1]))
                if k is None:
                    yield from _hits(best.names, *found, arrow_q, arrow)
        if best is not None and best.ids is not None:
            yield from _hits(best.names, best.owner, best.ids, best.values, arrow_q, arrow)

    pairs = left.withColumn("turn", F.xxhash64("names", "q")).join(right, ["dimension", "row", "column"]).select("turn", "dimension", "names", "q", "ids", "x")
    return pairs.sortWithinPartitions("turn").mapInArrow(run, f"query_id {query_type}, item_id {kind}, distance double, also double")


def all_normalized(df: DataFrame, vector_col: str) -> bool:
    from vecloom.functions.vector import is_normalized

    return bool(df.agg(F.coalesce(F.bool_and(is_normalized(F.col(vector_col))), F.lit(False)).alias("ok")).first()["ok"])


def block_of(asked: DataFrame, block: int = BLOCK) -> list[tuple[list, np.ndarray]] | None:
    """The queries (id, vector), by length of vector, if they fit one block; else None. What reaches the driver is bounded by it."""
    rows = asked.limit(block + 1).collect()
    if len(rows) > block:
        return None
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        by.setdefault(len(r["vector"]), []).append(r)
    return [([r["id"] for r in own], np.array([r["vector"] for r in own], np.float64)) for own in by.values()]


def knn(items: DataFrame, queries: DataFrame, k: int | None, metric: Metric = "l2sq", id_col: str = "id", vector_col: str = "vector", most_distance: float | None = None, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, item_id, rank, distance): the ``k`` nearest items of every query, ties by id.

    Up to ``block`` queries are broadcast, and every task scans its items once. More queries stay on the executors: blocks of
    them and of items meet in a square of tasks (``_meeting``). Tasks keep k a query; the ranking merges those, not the
    distances. ``most_distance`` leaves out what is further; with it, ``k`` may be None for all items within that distance.
    ``metric`` may also be a function of (queries, items) as rows of two matrices that gives their matrix of distances.
    ``auto`` takes 1 - dot if all vectors are normalised and squared L2 otherwise. Items whose vector is null or has another
    length than the query's are in no result; repeated rows are ranked each. Queries with a null id or vector have no rows.
    Distances are summed in one order, so neither blocks nor partitions change a digit.
    """
    if (most_distance is None if k is None else k <= 0) or not (callable(metric) or metric in METRICS):
        raise ValueError("k must be positive, or None with a greatest distance, and the metric known")
    spark = items.sparkSession
    if metric == "auto":
        metric = "cosine" if all_normalized(queries, vector_col) and all_normalized(items, vector_col) else "l2sq"
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and size(vector) > 0")
    source = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and size(vector) > 0")
    query_type, kind = (df.schema["id"].dataType.simpleString() for df in (asked, source))
    blocks = block_of(asked, block)
    if blocks is None:
        found = _meeting(source, asked, k, metric, most_distance, skip_self, block)
    elif not blocks:
        return spark.createDataFrame([], f"query_id {query_type}, item_id {kind}, rank bigint, distance double")
    else:
        found = None
        for ids, q in blocks:
            own = scan(source, ids, q, k, metric, most_distance, skip_self, query_type=query_type)
            found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    ranked = ranked if k is None else ranked.filter(F.col("rank") <= k)
    return ranked.select("query_id", "item_id", F.col("rank").cast("bigint").alias("rank"), (F.col("distance") + 0.0).alias("distance"))
