"""Hyperplane hashing: bucket tables, single- and multi-probe search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vector import cosine, l2sq
from vecloom.operators.knn import block_of, knn, matrix, scan
from vecloom.runtime import stage


@dataclass(frozen=True)
class Planes:
    """``tables`` hash tables of ``bits`` planes. Planes come from an integer rule, so any engine can make the same ones.
    ``inclusive``: a bit is set for a dot product of 0 as well."""

    tables: int = 8
    bits: int = 4
    inclusive: bool = True

    def normals(self, dimension: int) -> np.ndarray:
        g = np.arange(self.tables * self.bits * dimension, dtype=np.int64)
        return ((g * 7919 + 104729) * (g + 17) % 2003 / 1001.0 - 1.0).reshape(self.tables * self.bits, dimension)


SINGLE, MULTI = Planes(8, 4, True), Planes(8, 8, False)


def buckets(items: DataFrame, planes: Planes = SINGLE, id_col: str = "id", vector_col: str = "vector", dimension: int = 64) -> DataFrame:
    """(id, table_id, bucket): the bucket of every vector in every table. Vectors of another length have none."""
    source = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(F.size("vector") == dimension)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes.normals(dimension)
        weight = np.int64(1) << np.arange(planes.bits, dtype=np.int64)
        for batch in batches:
            s = matrix(batch["vector"]) @ normals.T if batch.num_rows else np.zeros((0, len(normals)))
            bits = s >= 0 if planes.inclusive else s > 0
            table = bits.reshape(len(s), planes.tables, planes.bits) @ weight
            at = pa.array(np.repeat(np.arange(len(s)), planes.tables))
            yield pa.record_batch({"id": batch["id"].take(at), "table_id": pa.array(np.tile(np.arange(planes.tables, dtype=np.int64), len(s))), "bucket": pa.array(table.ravel().astype(np.int64))})

    return source.mapInArrow(run, f"id {kind}, table_id bigint, bucket bigint")


def probe_list(bucket: Column, bits: int, probes: int) -> Column:
    """The bucket itself, then those with one bit flipped, lowest bit first, ``probes`` at most."""
    return F.slice(F.concat(F.array(bucket), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: bucket.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))), 1, probes)


def candidates(items: DataFrame, queries: DataFrame, planes: Planes = SINGLE, probes: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id): items in a probed bucket of any table, once each; an equi-join of bucket tables."""
    asked = buckets(queries, planes, id_col, vector_col).select(F.col("id").alias("query_id"), "table_id", F.explode(probe_list(F.col("bucket"), planes.bits, probes)).alias("bucket"))
    return asked.join(buckets(items, planes, id_col, vector_col).withColumnRenamed("id", "item_id"), ["table_id", "bucket"]).select("query_id", "item_id").distinct()


def with_vectors(pairs: DataFrame, items: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return pairs.join(queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv")), "query_id").join(items.select(F.col(id_col).alias("item_id"), F.col(vector_col).alias("iv")), "item_id")


def first_k(scored: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def best_candidates(items: DataFrame, queries: DataFrame, k: int, metric: str, planes: Planes = SINGLE, probes: int = 1, most_distance: float | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, similarity, distance): at least the k nearest candidates of each query by ``metric`` (cosine or l2sq).

    Up to a block of queries, their probed buckets and vectors go to the tasks, which hash, score and choose while they scan the
    items, so that only k a task and query move. More queries meet the items in a join of bucket tables.
    """
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and size(vector) > 0")
    source = items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter("id is not null and size(vector) > 0")
    blocks = block_of(asked)
    if blocks is None:
        scored = with_vectors(candidates(items, queries, planes, probes, id_col, vector_col), items, queries, id_col, vector_col)
        scored = scored.select("query_id", "item_id", cosine(F.col("qv"), F.col("iv")).alias("similarity"), l2sq(F.col("qv"), F.col("iv")).alias("distance"))
        return scored if most_distance is None else scored.filter(F.col("similarity") >= 1.0 - most_distance if metric == "cosine" else F.col("distance") <= most_distance)
    found = None
    for ids, q in blocks:
        own = scan(source, ids, q, k, metric, most_distance, also="l2sq" if metric == "cosine" else "cosine", query_type=asked.schema["id"].dataType.simpleString(), masks=Probes(q, planes, probes))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return items.sparkSession.createDataFrame([], f"query_id {asked.schema['id'].dataType.simpleString()}, item_id {source.schema['id'].dataType.simpleString()}, similarity double, distance double")
    near, other = F.col("distance"), F.col("also")
    return found.select("query_id", "item_id", (1.0 - (near if metric == "cosine" else other)).alias("similarity"), (other if metric == "cosine" else near).alias("distance"))


class Probes:
    """Which rows of a matrix are in a probed bucket of which query."""

    def __init__(self, q: np.ndarray, planes: Planes, probes: int) -> None:
        self.planes, self.normals = planes, planes.normals(q.shape[1])
        own = self._buckets(q)
        # of every query and table the probed buckets: its own and those with one bit flipped, lowest first
        flips = np.array([0, *(1 << i for i in range(planes.bits))][:probes], np.int64)
        self.probed = own[:, :, None] ^ flips[None, None, :]

    def _buckets(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.normals.T
        bits = s >= 0 if self.planes.inclusive else s > 0
        return bits.reshape(len(x), self.planes.tables, self.planes.bits) @ (np.int64(1) << np.arange(self.planes.bits, dtype=np.int64))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        of = self._buckets(x)
        out = np.zeros((len(self.probed), len(x)), bool)
        for t in range(self.planes.tables):
            for p in range(self.probed.shape[2]):
                out |= self.probed[:, t, p][:, None] == of[:, t][None, :]
        return out


def lsh_search(items: DataFrame, queries: DataFrame, k: int, threshold: float = 0.8, planes: Planes = SINGLE, probes: int = 1, id_col: str = "id", vector_col: str = "vector", bucket_limit: int | None = None) -> DataFrame:
    """(query_id, item_id, rank, similarity): the k most similar candidates of similarity ``threshold`` or more.

    ``bucket_limit``: rows that a bucket gives at most, those with the least ids; for callers that want work bounded at the cost of
    hits. By default buckets are read whole.
    """
    if bucket_limit is not None:
        kept = buckets(items, planes, id_col, vector_col).withColumn("place", F.row_number().over(Window.partitionBy("table_id", "bucket").orderBy("id"))).filter(F.col("place") <= bucket_limit)
        asked = buckets(queries, planes, id_col, vector_col).select(F.col("id").alias("query_id"), "table_id", F.explode(probe_list(F.col("bucket"), planes.bits, probes)).alias("bucket"))
        pairs = asked.join(kept.select(F.col("id").alias("item_id"), "table_id", "bucket"), ["table_id", "bucket"]).select("query_id", "item_id").distinct()
        scored = with_vectors(pairs, items, queries, id_col, vector_col).withColumn("similarity", cosine(F.col("qv"), F.col("iv"))).filter(F.col("similarity") >= threshold)
    else:
        scored = best_candidates(items, queries, k, "cosine", planes, probes, 1.0 - threshold, id_col, vector_col)
    return first_k(scored, k, F.desc("similarity"), "item_id").select("query_id", "item_id", "rank", "similarity")


def lsh_rerank(items: DataFrame, queries: DataFrame, k: int, planes: Planes = SINGLE, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, rank, distance): 2k best candidates by cosine; where there are fewer than k, topped up with the
    exact nearest; ranked by squared L2."""
    scored = best_candidates(items, queries, 2 * k, "cosine", planes, 1, None, id_col, vector_col)
    found = stage(first_k(scored, 2 * k, F.desc("similarity"), "item_id").select("query_id", "item_id", "distance"), "hashed")
    exact = knn(items, unanswered(queries, found, k, id_col), k, "l2sq", id_col, vector_col).select("query_id", "item_id", "distance")
    # one distance a pair, whichever way it was found
    both = found.unionByName(exact).groupBy("query_id", "item_id").agg(F.min("distance").alias("distance"))
    return first_k(both, k, "distance", "item_id").select("query_id", "item_id", "rank", "distance")


def unanswered(queries: DataFrame, found: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The queries with fewer than k rows in ``found``: all that an exact search has left to do."""
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias(id_col))
    return queries.join(full, id_col, "left_anti")
