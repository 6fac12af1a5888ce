"""Exact search: every vector meets every other one that could still be among its most similar."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.annforest import _matrix, _unit, bounded_sample
from vecloom.runtime import shuffle_partitions, stage

#: Most vectors of a block, vectors of a ring (those of a block at about the same angle to its centre), and most cells.
BLOCK, RING, CELLS = 4096, 512, 256
#: Blocks that a task keeps ready for use.
KEPT = 24
#: Slack of angles and of scores in single precision.
_ANGLE, _SCORE = 1e-6, 1e-5


def fit_cells(sample: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    """Centres of ``cells`` cells, by spherical k-means over a bounded sample. They decide how much is skipped, never what is found."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[:cells].copy()
    for _ in range(steps):
        code = (sample @ centres.T).argmax(axis=1)
        for c in np.unique(code):
            mean = sample[code == c].mean(axis=0)
            centres[c] = mean / max(np.sqrt((mean * mean).sum()), 1e-12)
    return centres


class Block:
    """Vectors in order of their ids, in rings around their mean direction."""

    def __init__(self, ids: pa.Array, packed: bytes, dimension: int) -> None:
        self.ids = ids
        self.exact = _unit(np.frombuffer(packed, np.float32).reshape(-1, dimension))
        self.unit = self.exact.astype(np.float32)
        mean = self.exact.mean(axis=0)
        size = np.sqrt((mean * mean).sum())
        self.centre = mean / size if size > 1e-9 else self.exact[0]
        self.angle = self.angles(self.exact)

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.centre, -1, 1))

    def rings(self) -> Iterator[tuple[np.ndarray, float, float]]:
        order = np.argsort(self.angle, kind="stable")
        for at in range(0, len(order), RING):
            ring = order[at : at + RING]
            yield np.sort(ring), self.angle[ring[0]], self.angle[ring[-1]]


def _leading(s: np.ndarray, n: int) -> np.ndarray:
    """Whether a score is among the n best of its row; ties go to the earlier column."""
    if s.shape[1] <= n:
        return np.ones(s.shape, bool)
    last = np.partition(s, -n, axis=1)[:, -n][:, None]
    over = s > last + 1e-12
    tie = (s >= last - 1e-12) & ~over
    return over | tie & (tie.cumsum(axis=1) <= n - over.sum(axis=1, keepdims=True))


def meet(asked: Block, floor: np.ndarray, others: Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place in others, similarity) of similarity ``floor`` (of the asked one) or more, of which the ``k`` best and
    ties of every ring suffice. A ring is skipped for whom the angles to its block's centre rule it out."""
    width = np.arccos(np.clip(floor, -1, 1)) + _ANGLE
    angle = others.angles(asked.exact)
    for ring, low, high in others.rings():
        active = np.flatnonzero((angle - width <= high) & (angle + width >= low))
        for at in range(0, len(active), 1024):
            own = active[at : at + 1024]
            hits = asked.unit[own] @ others.unit[ring].T >= (floor[own] - _SCORE)[:, None]
            many = np.flatnonzero(hits.sum(axis=1) > 4 * (k + 1))
            if len(many):
                # one more, since a vector is its own best
                hits[many] = _leading(asked.exact[own[many]] @ others.exact[ring].T, k + 1)
            rows, columns = np.nonzero(hits)
            a, b = own[rows], ring[columns]
            similarity = (asked.exact[a] * others.exact[b]).sum(axis=1)
            enough = similarity >= floor[a]
            yield a[enough], b[enough], similarity[enough]


def packed_blocks(rows: DataFrame, dimension: int, centres: np.ndarray) -> DataFrame:
    """(ids, vectors, floors): the rows (id, vector, floor) of a cell, ``BLOCK`` at most, as one row."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType
    id_type, id_arrow = kind.simpleString(), to_arrow_type(kind)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = (_unit(_matrix(batch["vector"], dimension)) @ shared.value.T).argmax(axis=1)
                yield pa.record_batch({"cell": pa.array(cell.astype(np.int32)), "id": batch["id"], "vector": batch["vector"], "floor": batch["floor"]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block() -> pa.RecordBatch:
            return pa.record_batch({"ids": pa.array([sum(ids, [])], pa.list_(id_arrow)), "vectors": pa.array([b"".join(v.tobytes() for v in vectors)], pa.binary()), "floors": pa.array([b"".join(f.tobytes() for f in floors)], pa.binary())})

        ids, vectors, floors, held, last = [], [], [], 0, None
        for batch in batches:
            of = batch["cell"].to_numpy()
            at = 0
            while at < len(of):
                if held and (of[at] != last or held == BLOCK):
                    yield block()
                    ids, vectors, floors, held = [], [], [], 0
                last = of[at]
                stop = min(at + int(np.searchsorted(of[at:], last, side="right")), at + BLOCK - held)
                part = batch.slice(at, stop - at)
                ids.append(part["id"].to_pylist())
                vectors.append(_matrix(part["vector"], dimension).astype(np.float32))
                floors.append(part["floor"].to_numpy())
                held += stop - at
                at = stop
        if held:
            yield block()

    sorted_cells = rows.mapInArrow(cells, f"cell int, id {id_type}, vector array<float>, floor double").repartitionByRange(shuffle_partitions(spark), "cell", "id").sortWithinPartitions("cell", "id")
    return stage(sorted_cells.mapInArrow(pack, f"ids array<{id_type}>, vectors binary, floors binary"), "blocks")


def met(asked: DataFrame, others: DataFrame, k: int, dimension: int, id_type: str) -> DataFrame:
    """(a, b, similarity) of packed blocks: for every asked vector all others of similarity ``floor`` or more that can be among its k best.

    Pairs of blocks are the unit of work; every block is sent to a row or column of a square of tasks, once to each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[tuple, Block] = OrderedDict()

        def block(ids: pa.Array, packed: pa.Scalar) -> Block:
            # a first id opens one block of a table, and a block of some of its ids has another length or end
            name = (ids[0].as_py(), ids[-1].as_py(), len(ids))
            if name not in known:
                known[name] = Block(ids.take(pa.array(np.arange(len(ids)))), packed.as_py(), dimension)  # copied, so that no batch is held
                if len(known) > KEPT:
                    known.popitem(last=False)
            known.move_to_end(name)
            return known[name]

        for batch in batches:
            for i in range(batch.num_rows):
                own, floor = block(batch["q_ids"][i].values, batch["q_vectors"][i]), np.frombuffer(batch["q_floors"][i].as_py())
                other = block(batch["ids"][i].values, batch["vectors"][i])
                for a, b, similarity in meet(own, floor, other, k):
                    if len(a):
                        yield pa.record_batch({"a": own.ids.take(pa.array(a)), "b": other.ids.take(pa.array(b)), "similarity": pa.array(similarity)})

    # a square of tasks: asked blocks of a row of it meet the other blocks of a column
    side = int(np.ceil(np.sqrt(shuffle_partitions(asked.sparkSession))))
    own = lambda: F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(side)).cast("int")
    every = lambda: F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    rows = asked.select(own().alias("row"), every().alias("column"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("floors").alias("q_floors"))
    columns = others.select(own().alias("column"), every().alias("row"), "ids", "vectors")
    pairs = rows.join(columns, ["row", "column"]).select("q_ids", "q_vectors", "q_floors", "ids", "vectors")
    return pairs.mapInArrow(search, f"a {id_type}, b {id_type}, similarity double").filter("a <> b")


def closest(rows: DataFrame, number: int, asked: DataFrame, k: int, least: float, dimension: int) -> DataFrame:
    """(a, b, similarity), of similarity ``least`` or more: for every asked id a superset of its k most similar of (id, vector).

    ``asked`` is (id, floor), floor being what the k-th best is expected to reach;
    it bounds the work, not the result: a vector with fewer than k others above its floor is asked again without one. ``rows``
    must be staged, ids unique.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    start = rows.join(asked, "id").select("id", "vector", F.greatest(F.lit(least), F.coalesce("floor", F.lit(least))).alias("floor"))
    centres = fit_cells(bounded_sample(rows, number, 4096, dimension), max(1, min(CELLS, number // BLOCK)))
    blocks = packed_blocks(rows.withColumn("floor", F.lit(least)), dimension, centres)
    found = stage(met(packed_blocks(start, dimension, centres), blocks, k, dimension, id_type), "nearest")
    held = found.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("a").alias("id"))
    short = stage(asked.filter(F.col("floor") > least).select("id").join(held, "id", "left_anti"), "short")
    if number > k and short.head(1):
        again = packed_blocks(rows.join(short, "id").select("id", "vector", F.lit(least).alias("floor")), dimension, centres)
        found = found.unionByName(met(again, blocks, k, dimension, id_type)).distinct()
    return found
