"""Parameters of a store and its indexes. The defaults of the store this engine is compatible with."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class HashIndex:
    tables: int = 8
    planes: int = 4
    bucket_size: int = 100
    threshold: float = 0.8


@dataclass(frozen=True)
class GraphIndex:
    neighbours: int = 32
    depth: int = 50
    similarity: float = 0.6
    prune_above: int = 64


@dataclass(frozen=True)
class Quantizer:
    centroids: int = 256
    steps: int = 100
    tolerance: float = 1e-6
    sample: int = 10_000
    parts: int = 8
    bits: int = 8
    probe: int = 8


@dataclass(frozen=True)
class CacheRules:
    ttl_hours: int = 24
    compress_above: int = 1024
    query_ttl_minutes: int = 5
    query_similarity: float = 0.95


@dataclass(frozen=True)
class Warming:
    batch: int = 1000
    least_accesses: int = 5
    hours: int = 24


@dataclass(frozen=True)
class StoreConfig:
    dimension: int = 1536
    batch: int = 2000
    buffer: int = 5000
    min_queries: int = 1000
    hashing: HashIndex = field(default_factory=HashIndex)
    graph: GraphIndex = field(default_factory=GraphIndex)
    quantizer: Quantizer = field(default_factory=Quantizer)
    cache: CacheRules = field(default_factory=CacheRules)
    warming: Warming = field(default_factory=Warming)

    def __post_init__(self) -> None:
        if min(self.dimension, self.batch, self.buffer) <= 0:
            raise ValueError("dimension, batch and buffer must be positive")
