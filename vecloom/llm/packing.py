"""Filling containers of fixed capacities with documents that lie together on a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.repetition import words
from vecloom.llm.tokens import count_tokens, rank_file
from vecloom.runtime import shuffle_partitions, slices, stage


@dataclass(frozen=True)
class Curve:
    """Documents as hashed word vectors of ``buckets`` entries, projected to ``dimensions`` and placed on a Hilbert
    curve of ``bits`` bits a dimension."""

    buckets: int = 4096
    dimensions: int = 4
    bits: int = 12
    seed: int = 29

    def projection(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.buckets, self.dimensions))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits (rows are points)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = np.int64(1) << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.int64(1) << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Places:
    """Hilbert keys of texts: the distinct words' hashed vector, projected and brought to the unit cube."""

    def __init__(self, curve: Curve) -> None:
        self.curve, self.matrix, self.known = curve, curve.projection(), {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        spots = np.zeros((len(texts), self.curve.dimensions))
        known, buckets = self.known, self.curve.buckets
        if len(known) > 500_000:
            known.clear()
        for i, text in enumerate(texts):
            found = set(words(text or ""))
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w) % buckets
            at = np.array([known[w] for w in sorted(found)], np.int64)
            if len(at):
                vector = np.bincount(at, minlength=0)
                used = np.flatnonzero(vector)
                spots[i] = vector[used] @ self.matrix[used] / np.sqrt((vector[used] ** 2).sum())
        # a logistic curve close to the normal one spreads the projections evenly
        cells = (1 << self.curve.bits) / (1 + np.exp(-1.702 * spots))
        return hilbert_keys(np.minimum(cells.astype(np.int64), (1 << self.curve.bits) - 1), self.curve.bits)


#: Largest containers that a stretch of the curve fills at least.
_LARGEST = 256


@dataclass
class Open:
    items: list[tuple]
    used: int


class Packer:
    """Packs a stream of sized items into containers; holds at most ``most_open`` unfinished ones.

    An item goes into the fullest open container that still takes it; if none does, the fullest is closed and a new one
    opened. A closed container gets the least capacity that holds it. What is open at the end is packed anew into
    containers of all capacities, large items first.
    """

    def __init__(self, capacities: list[tuple[str, int]], most_open: int = 12) -> None:
        self.kinds = sorted(capacities, key=lambda c: (c[1], c[0]))
        self.most = self.kinds[-1][1]
        self.most_open, self.open = most_open, []

    def _kind(self, used: int) -> tuple[str, int]:
        return next(k for k in self.kinds if k[1] >= used)

    def add(self, item: object, size: int) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
        fits = [o for o in self.open if o.used + size <= self.most]
        if fits:
            best = max(fits, key=lambda o: o.used)
        else:
            if len(self.open) >= self.most_open:
                full = max(self.open, key=lambda o: o.used)
                self.open.remove(full)
                yield self._kind(full.used), full.items
            best = Open([], 0)
            self.open.append(best)
        best.items.append((item, size))
        best.used += size

    def finish(self) -> Iterator[tuple[tuple[str, int], list[tuple]]]:
        rest = [i for o in self.open for i in o.items]
        self.open = []
        rest.sort(key=lambda i: -i[1])
        while rest:
            total, largest = sum(s for _, s in rest), rest[0][1]
            # the largest capacity that can be filled, or else the least that takes the largest item
            kind = max((k for k in self.kinds if k[1] <= total), key=lambda k: k[1], default=self.kinds[0])
            if kind[1] < largest or total <= self.kinds[0][1]:
                kind = self._kind(max(largest, min(total, self.kinds[0][1])))
            left, taken, kept = kind[1], [], []
            for item in rest:
                if item[1] <= left:
                    taken.append(item)
                    left -= item[1]
                else:
                    kept.append(item)
            yield self._kind(kind[1] - left), taken
            rest = kept


def pack(df: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", curve: Curve = Curve(), ranks: str | None = None, most_kinds: int = 1000) -> DataFrame:
    """(id, part, parts, first, tokens, container, capacity, bin, used): every text's place in a container.

    Texts are measured in tokens and placed on a Hilbert curve by their hashed words; the table is range-partitioned
    and sorted by that place, and each task packs its stretch of the curve, so containers hold neighbours. Any number
    of containers of every capacity may be used. ``used`` is what the container ``bin`` holds together. A text is divided
    only if it is larger than the greatest capacity: into pieces of that capacity (``part`` counts from 0, ``first`` is a
    piece's first token in the text) and a rest that is packed like a text. A stretch holds some hundred of the largest
    containers at least, so what its last ones leave empty is little; more partitions than that aren't used.

    Places are tied up to the id, so equal texts, however many, spread over tasks. Null and empty texts have 0 tokens
    and are assigned as well; repeated rows are assigned each. An empty table gives an empty result; without a
    container of positive capacity it is an error. Other columns are not read, whatever their names.
    """
    kinds = [(r["container"], int(r["capacity_tokens"])) for r in containers.filter("capacity_tokens > 0").select("container", "capacity_tokens").distinct().limit(most_kinds + 1).collect()]
    if not 0 < len(kinds) <= most_kinds:
        raise ValueError(f"between 1 and {most_kinds} containers of positive capacity are needed, not {len(kinds)}")
    most = max(c for _, c in kinds)
    ranks = rank_file(df.sparkSession, ranks)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(curve)
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                texts = part["text"].to_pylist()
                yield pa.record_batch({"id": part["id"], "tokens": pa.array(count_tokens(texts, ranks)), "place": pa.array(places(texts))})

    # measured once: the range partitioning samples its input before it reads it
    measured = stage(source.mapInArrow(measure, f"id {id_type}, tokens bigint, place bigint"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(kinds)
        task = TaskContext.get().partitionId()
        made = 0
        rows: list[tuple] = []

        def note(done: Iterator[tuple[tuple[str, int], list[tuple]]]) -> None:
            nonlocal made
            for (name, capacity), items in done:
                used = sum(s for _, s in items)
                rows.extend((i, part, parts, part * most, size, name, capacity, (task << 40) + made, used) for (i, part, parts), size in items)
                made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [id_arrow, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "part", "parts", "first", "tokens", "container", "capacity", "bin", "used"]
            batch = pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})
            rows.clear()
            return batch

        id_arrow = None
        for batch in batches:
            id_arrow = batch["id"].type
            for i, size in zip(batch["id"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                parts = max(1, -(-size // most))
                for part in range(parts):
                    piece = min(most, size - part * most)
                    if piece == most:
                        note([(next(k for k in kinds if k[1] == most), [((i, part, parts), piece)])])
                    else:
                        note(packer.add((i, part, parts), piece))
                if len(rows) > 5000:
                    yield out()
        note(packer.finish())
        if rows:
            yield out()

    stretches = int(measured.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // (_LARGEST * most)
    order = measured.withColumn("tie", F.xxhash64("id")).repartitionByRange(max(1, min(shuffle_partitions(df.sparkSession), stretches)), "place", "tie").sortWithinPartitions("place", "tie", "id")
    packed = order.select("id", "tokens").mapInArrow(run, f"id {id_type}, part int, parts int, first bigint, tokens bigint, container string, capacity bigint, bin bigint, used bigint")
    return packed.withColumnRenamed("id", id_col)


def packing_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, bins, tokens, filled): how many containers of each kind were used, and how full they are."""
    bins = packed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens")).withColumn("filled", F.col("tokens") / (F.col("bins") * F.col("capacity")))
