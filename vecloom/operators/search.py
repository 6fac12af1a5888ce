"""Searches that combine indexes, and the choice between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.config import HashIndex
from vecloom.operators.knn import knn
from vecloom.operators.lsh import MULTI, SINGLE, Planes, best_candidates, first_k, lsh_rerank, unanswered
from vecloom.operators.quantize import ivf_search
from vecloom.runtime import stage

#: How far a hit may be from the first one, as a multiple of its distance, for hashed results to be trusted.
SPREAD = 1.95


def optimistic_search(items: DataFrame, queries: DataFrame, k: int, planes: Planes = MULTI, probes: int = 9, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, rank, distance, source): the k nearest multi-probe candidates; where there are fewer, those first and
    then the exact nearest others."""
    found = best_candidates(items, queries, k, "l2sq", planes, probes, None, id_col, vector_col)
    hashed = stage(first_k(found, k, "distance", "item_id").select("query_id", "item_id", "distance", F.lit(0).alias("turn")), "hashed")
    exact = knn(items, unanswered(queries, hashed, k, id_col), 2 * k, "l2sq", id_col, vector_col).select("query_id", "item_id", "distance", F.lit(1).alias("turn"))
    once = hashed.unionByName(exact).withColumn("first", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("turn"))).filter("first = 1")
    return first_k(once, k, "turn", "distance", "item_id").select("query_id", "item_id", "rank", "distance", F.when(F.col("turn") == 0, "lsh").otherwise("exact").alias("source"))


def quality(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, hits, valid): whether a query's hits, best first, are k and none is much further than the first."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("distance").alias("most"), F.min_by("distance", "rank").alias("first")).select("query_id", "hits", ((F.col("hits") == k) & (F.col("most") <= SPREAD * F.col("first"))).alias("valid"))


def _hashed(items: DataFrame, queries: DataFrame, n: int, threshold: float, planes: Planes, id_col: str, vector_col: str) -> DataFrame:
    near = best_candidates(items, queries, n, "cosine", planes, 1, 1.0 - threshold, id_col, vector_col)
    return first_k(near, n, F.desc("similarity"), "item_id").select("query_id", "item_id", "rank", "distance")


def hybrid_quality(items: DataFrame, queries: DataFrame, k: int, threshold: float = 0.2, planes: Planes = SINGLE, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    return quality(_hashed(items, queries, k, threshold, planes, id_col, vector_col), k)


def hybrid_search(items: DataFrame, queries: DataFrame, k: int, threshold: float = 0.2, planes: Planes = SINGLE, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, rank, distance, source): the k hashed hits where they are good (``quality``), in order of distance;
    otherwise 2k hashed and k exact hits merged by distance, hashed first on ties, every item once."""
    hashed = stage(_hashed(items, queries, 2 * k, threshold, planes, id_col, vector_col), "hashed")
    firm = quality(hashed.filter(F.col("rank") <= k), k).filter("valid").select("query_id", F.lit(True).alias("firm"))
    tagged = hashed.join(firm, "query_id", "left").withColumn("firm", F.coalesce("firm", F.lit(False)))
    kept = tagged.filter(~F.col("firm") | (F.col("rank") <= k)).select("query_id", "item_id", "distance", F.lit(0).alias("turn"))
    doubtful = queries.join(firm.select(F.col("query_id").alias(id_col)), id_col, "left_anti")
    exact = knn(items, doubtful, k, "l2sq", id_col, vector_col).select("query_id", "item_id", "distance", F.lit(1).alias("turn"))
    # a pair's two distances agree but for the last digits, so the hashed one stands for both
    once = kept.unionByName(exact).withColumn("first", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("turn"))).filter("first = 1")
    return first_k(once, k, "distance", "turn", "item_id").select("query_id", "item_id", "rank", "distance", F.when(F.col("turn") == 0, "lsh").otherwise("exact").alias("source"))


def adaptive_search(items: DataFrame, queries: DataFrame, k: int, stats: dict, book: np.ndarray | None = None, mode: str | None = None, id_col: str = "id", vector_col: str = "vector", config: HashIndex | None = None, probes: int = 1, multi: Planes = MULTI) -> DataFrame:
    """Search by the index that serves best (or ``mode``), its name in ``index_type``.

    ``stats`` has ``queries`` (least of any tracked index), ``rows``, ``memory`` and ``latency_ms``. Modes: hnsw (candidates of
    many probes, topped up), lsh, quantization (needs ``book``), hybrid and standard. ``config`` has the tables and planes of lsh
    and hybrid, and the similarity of hybrid; ``probes`` the cells read by quantization, ``multi`` the tables of hnsw.
    """
    mode = mode or choose(**stats)
    planes = SINGLE if config is None else Planes(config.tables, config.planes, True)
    if mode == "lsh":
        hits = lsh_rerank(items, queries, k, planes, id_col, vector_col)
    elif mode == "quantization":
        hits = ivf_search(items, queries, book, k, probes, id_col, vector_col)
    elif mode == "hybrid":
        hits = hybrid_search(items, queries, k, 0.2 if config is None else config.threshold, planes, id_col, vector_col)
    elif mode == "standard":
        hits = knn(items, queries, k, "l2sq", id_col, vector_col)
    elif mode == "hnsw":
        hits = optimistic_search(items, queries, k, multi, id_col=id_col, vector_col=vector_col)
    else:
        raise ValueError(f"unknown mode {mode}")
    return hits.select("query_id", "item_id", "rank", "distance", F.lit(mode).alias("index_type"))


def choose(queries: int, rows: int, memory: int, latency_ms: float, min_queries: int = 1000) -> str:
    """The rule of ``functions.keys.best_index`` on plain values."""
    if queries < min_queries or rows <= 1_000_000:
        return "hnsw"
    return "lsh" if memory > 2**30 else "quantization" if latency_ms > 100 else "hnsw"


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): share of each query's exact hits that were found."""
    hit = exact.select("query_id", "item_id").join(found.select("query_id", "item_id", F.lit(1.0).alias("hit")).distinct(), ["query_id", "item_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
