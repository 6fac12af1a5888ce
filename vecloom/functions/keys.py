"""Keys, shards, cache entries and tier rules as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.vector import normalize

#: Fixed values of the public FNV-1a 32-bit hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Those of its 64-bit form.
FNV64_OFFSET, FNV64_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
CONTENT_TYPES = ("text", "code", "math", "json", "markdown")
DAY_NS = 24 * 3600 * 10**9


def fnv1a32(key: Column) -> Column:
    """FNV-1a of the key's UTF-8 bytes, as an unsigned number in a bigint."""
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(key) - 1), lambda i: F.conv(F.hex(F.substring(F.encode(key, "utf-8"), i + 1, 1)), 16, 10).cast("bigint"))
    start = F.lit(FNV_OFFSET).cast("bigint")
    folded = F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("bigint")) % F.lit(2**32).cast("bigint"))
    return F.when(F.octet_length(key) > 0, folded).otherwise(start)


def _fnv64(vectors: pd.Series) -> pd.Series:
    """Vectors of one length are hashed together, byte by byte."""
    out = np.full(len(vectors), FNV64_OFFSET, np.uint64)
    lengths = np.array([-1 if v is None else len(v) for v in vectors])
    with np.errstate(over="ignore"):
        for n in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero(lengths == n)
            raw = np.array([vectors.iloc[i] for i in at], "<f4").view(np.uint8).reshape(len(at), -1)
            h = out[at]
            for column in raw.T:
                h = (h ^ column.astype(np.uint64)) * FNV64_PRIME
            out[at] = h
    return pd.Series([None if n < 0 else int(h) for n, h in zip(lengths, out.view(np.int64), strict=True)], dtype="Int64")


def fnv1a64(vector: Column) -> Column:
    """FNV-1a, 64 bits, of a vector's numbers as little-endian 32-bit floats; a bigint with the same bits. Null for null."""
    return F.pandas_udf(_fnv64, "bigint")(vector)


def shard_of(key: Column, shards: int = 16) -> Column:
    return fnv1a32(key) % shards


def query_key(vector: Column, limit: int) -> Column:
    """Cache key of a query: scale-invariant, and different for different limits; null for a zero vector."""
    scaled = F.transform(normalize(vector), lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.when(nonzero, F.sha2(F.concat_ws(",", F.concat(scaled, F.array(F.lit(f"k{limit}")))), 256))


def time_to_live(expires_at: Column, now: Column) -> Column:
    """Nanoseconds an entry stays in the cache: until it expires, or a day where that is past or unknown."""
    return F.when(expires_at > now, expires_at - now).otherwise(F.lit(DAY_NS))


def compressible(data: Column, threshold: int = 1024) -> Column:
    return F.octet_length(data) > threshold


def valid_type(kind: Column) -> Column:
    """Known content types; the empty one is accepted too."""
    return F.coalesce(kind.isin(*CONTENT_TYPES, ""), F.lit(False))


def search_tier(rows: Column) -> dict[str, Column]:
    """Search parameters by collection size: list length, probes, way of running, and workers."""
    pick = lambda a, b, c, d: F.when(rows < 10_000, a).when(rows < 100_000, b).when(rows < 1_000_000, c).otherwise(d)
    return {"nprobe": pick(8, 16, 32, 64), "ef": pick(64, 128, 256, 512), "mode": pick("sequential", "parallel", "parallel", "parallel"), "workers": pick(1, 2, 4, 8)}


def best_index(tracked_least: Column, rows: Column, memory: Column, latency_ms: Column, min_queries: int = 1000) -> Column:
    """Index that serves best: the current one while too little is known, then by size, memory and latency."""
    large = rows > 1_000_000
    return F.when(tracked_least < min_queries, "hnsw").when(large & (memory > 2**30), "lsh").when(large & (latency_ms > 100), "quantization").otherwise("hnsw")


def next_batch_size(current: Column, failure: Column, latency_ms: Column, fast_ms: float = 100.0, least: int = 100, most: int = 2000) -> Column:
    """Batch size after a batch: smaller after failures, larger after quick successes, within bounds."""
    scaled = F.when(failure > 0.1, F.floor(current * 0.8)).when((failure < 0.01) & (latency_ms < fast_ms), F.floor(current * 1.2)).otherwise(current)
    return F.greatest(F.lit(least), F.least(F.lit(most), scaled)).cast("bigint")


def size_class(length: Column, dimension: int, factors: tuple[int, ...] = (32, 128, 512, 2048)) -> Column:
    """Least buffer class that fits, -1 if none does."""
    out = F.lit(-1)
    for i in reversed(range(len(factors))):
        out = F.when(length <= factors[i] * dimension, i).otherwise(out)
    return out
