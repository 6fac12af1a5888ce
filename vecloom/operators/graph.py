"""Similarity graphs: edges, frontier search, merged edge lists, and layered search."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.functions.keys import fnv1a32
from vecloom.functions.vector import cosine
from vecloom.operators.knn import BLOCK, block_of, knn, matrix
from vecloom.runtime import release, stage


def similarity_edges(items: DataFrame, threshold: float = 0.6, most: int = 32, id_col: str = "id", vector_col: str = "vector", block: int = 4096) -> DataFrame:
    """(src, dst, similarity, rank): each node's ``most`` most similar others of cosine ``threshold`` or more, ties by id.

    All nodes are the query set, in blocks against all items (exact). More than a block of them stay on the executors
    (``knn``). The work grows with the square of the nodes; on large collections build the graph from hashed candidates instead (``lsh_search`` with the nodes as queries).
    """
    near = knn(items, items, most, "cosine", id_col, vector_col, 1.0 - threshold, True, block)
    return near.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), (1.0 - F.col("distance")).alias("similarity"), "rank")


def hops(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, node, hop): nodes reached from every start in at most ``depth`` steps, with the least number of steps."""
    reached = starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).cast("bigint").alias("hop")).distinct()
    frontier = reached
    step = edges.select(F.col("src").alias("node"), F.col("dst"))
    for h in range(1, depth + 1):
        frontier = frontier.join(step, "node").select("start", F.col("dst").alias("node"), F.lit(h).cast("bigint").alias("hop")).distinct()
        reached = reached.unionByName(frontier)
    return reached.groupBy("start", "node").agg(F.min("hop").alias("hop"))


def merge_edges(a: DataFrame, b: DataFrame, most: int = 32) -> DataFrame:
    """Union of two edge lists: every edge once with its best similarity, the best ``most`` a node."""
    both = a.select("src", "dst", "similarity").unionByName(b.select("src", "dst", "similarity")).groupBy("src", "dst").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return both.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= most)


def _level(key: Column, most: int = 32) -> Column:
    h = fnv1a32(key.cast("string"))
    # h & -h is the lowest set bit
    low = h.bitwiseAND(-h)
    return F.least(F.when(h == 0, F.lit(32)).otherwise(F.length(F.bin(low)) - 1), F.lit(most)).cast("bigint")


def levels(items: DataFrame, id_col: str = "id", most: int = 32) -> DataFrame:
    """(id, level): layer of every node, at least l with probability 2 to the minus l: the zero bits that end its key's hash."""
    return items.select(F.col(id_col).alias("id"), _level(F.col(id_col), most).alias("level"))


def best_first(edges: DataFrame, items: DataFrame, queries: DataFrame, k: int, entry: object, depth: int = 50, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, visit, similarity): the nodes that a best-first search visits, in order, ``k`` or ``depth`` at most.

    A search starts at the node ``entry``; in every step the most similar node seen and not yet visited
    is visited, ties by id, and its neighbours are seen. All queries take a step together: one join with the edges and one
    with the items' vectors for the nodes newly seen, and a grouped maximum. State grows by a node's edges a step.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv")).filter("query_id is not null and qv is not null")
    vectors = items.select(F.col(id_col).alias("node"), F.col(vector_col).alias("iv"))
    links = stage(edges.select("src", F.col("dst").alias("node")), "edges")

    def scored(nodes: DataFrame) -> DataFrame:
        near = nodes.join(asked, "query_id").join(vectors, "node")
        return near.select("query_id", "node", F.round(cosine(F.col("qv"), F.col("iv")), 9).alias("similarity"), F.lit(None).cast("bigint").alias("visit"))

    seen = stage(scored(asked.select("query_id", F.lit(entry).cast(vectors.schema["node"].dataType).alias("node"))), "seen")
    for step in range(1, min(k, depth) + 1):
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node")
        best = seen.filter("visit is null").withColumn("turn", F.row_number().over(order)).filter("turn = 1").select("query_id", F.col("node").alias("src"))
        marked = seen.join(best.withColumnRenamed("src", "node").withColumn("now", F.lit(step).cast("bigint")), ["query_id", "node"], "left").select("query_id", "node", "similarity", F.coalesce("visit", "now").alias("visit"))
        fresh = best.join(links, "src").select("query_id", "node").distinct().join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        after = stage(marked.unionByName(scored(fresh)), "seen")
        release(seen)
        seen = after
    return seen.filter("visit is not null").select("query_id", F.col("node").alias("item_id"), "visit", "similarity")


class LayeredGraph:
    """A layered graph of one segment's vectors, searched greedily from the top layer and by a beam at the bottom. Every node is
    linked with its ``m`` nearest in each of its layers, from products of blocks, so building holds one block of distances."""

    def __init__(self, x: np.ndarray, neighbours: list[dict[int, np.ndarray]], entry: int) -> None:
        self.x, self.neighbours, self.entry = x, neighbours, entry

    @classmethod
    def build(cls, x: np.ndarray, level: np.ndarray, m: int = 16) -> LayeredGraph:
        neighbours = []
        squares = (x * x).sum(axis=1)
        for l in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= l)
            links: dict[int, np.ndarray] = {}
            for start in range(0, len(nodes), 512):
                own = nodes[start : start + 512]
                d = squares[own][:, None] + squares[nodes][None, :] - 2 * (x[own] @ x[nodes].T)
                d[np.arange(len(own)), start + np.arange(len(own))] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, : min(m, len(nodes) - 1)]
                links |= {int(n): nodes[row] for n, row in zip(own, near, strict=True)}
            neighbours.append(links)
        return cls(x, neighbours, int(np.flatnonzero(level == level.max())[0]) if len(level) else -1)

    def packed(self) -> list[bytes]:
        """Layers as rows of (node, its neighbours), -1 where there are fewer."""
        out = []
        for links in self.neighbours:
            width = max((len(n) for n in links.values()), default=0)
            rows = np.full((len(links), width + 1), -1, np.int32)
            for i, (node, near) in enumerate(links.items()):
                rows[i, 0], rows[i, 1 : 1 + len(near)] = node, near
            out.append(np.int32(width + 1).tobytes() + rows.tobytes())
        return out

    @classmethod
    def unpacked(cls, x: np.ndarray, layers: list[bytes], entry: int) -> LayeredGraph:
        neighbours = []
        for raw in layers:
            rows = np.frombuffer(raw, np.int32)
            rows = rows[1:].reshape(-1, rows[0])
            neighbours.append({int(r[0]): r[1:][r[1:] >= 0].astype(np.int64) for r in rows})
        return cls(x, neighbours, entry)

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = self.entry
        for links in reversed(self.neighbours[1:]):
            while True:
                options = np.append(links[at], at)
                best = int(options[((self.x[options] - q) ** 2).sum(axis=1).argmin()])
                if best == at:
                    break
                at = best
        d = float(((self.x[at] - q) ** 2).sum())
        seen, queue, best_list = {at}, [(d, at)], [(-d, at)]
        while queue:
            d, at = heapq.heappop(queue)
            if len(best_list) >= beam and d > -best_list[0][0]:
                break
            for n in self.neighbours[0][at].tolist():
                if n not in seen:
                    seen.add(n)
                    e = float(((self.x[n] - q) ** 2).sum())
                    if len(best_list) < beam or e < -best_list[0][0]:
                        heapq.heappush(queue, (e, n))
                        heapq.heappush(best_list, (-e, n))
                        if len(best_list) > beam:
                            heapq.heappop(best_list)
        return sorted((-d, n) for d, n in best_list)[:k]


def layered_index(items: DataFrame, id_col: str = "id", vector_col: str = "vector", segment: int = 4096, dimension: int = 64, m: int = 16) -> DataFrame:
    """(ids, vectors, layers, entry): a row for each segment of at most ``segment`` rows with its layered graph, to be written once and
    searched often. Vectors of another length are left out."""
    source = items.filter(F.size(vector_col) == dimension).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), _level(F.col(id_col)).alias("level"))
    kind, arrow = source.schema["id"].dataType.simpleString(), to_arrow_type(source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, segment):
                batch = whole.slice(at, segment)
                x = matrix(batch["vector"])
                graph = LayeredGraph.build(x, batch["level"].to_numpy(), m)
                yield pa.record_batch({"ids": pa.array([batch["id"].to_pylist()], pa.list_(arrow)), "vectors": pa.array([x.tobytes()], pa.binary()), "layers": pa.array([graph.packed()], pa.list_(pa.binary())), "entry": pa.array([graph.entry], pa.int32())})

    return source.mapInArrow(run, f"ids array<{kind}>, vectors binary, layers array<binary>, entry int")


def indexed_search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", beam: int = 64, dimension: int = 64) -> DataFrame:
    """(query_id, item_id, rank, distance): approximate nearest items of a layered index by squared L2.

    Every segment answers a block of queries (``knn.BLOCK`` at most) and the answers are merged by rank, as shards of an index are.
    """
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter((F.size("vector") == dimension) & F.col("id").isNotNull())
    blocks = block_of(asked)
    if blocks is None:
        raise ValueError(f"at most {BLOCK} queries at a time")
    item_type, query_type = index.schema["ids"].dataType.elementType, asked.schema["id"].dataType
    schema = f"query_id {query_type.simpleString()}, item_id {item_type.simpleString()}, distance double"
    if not blocks:
        return index.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0).cast("bigint")).select("query_id", "item_id", "rank", "distance")
    shared = index.sparkSession.sparkContext.broadcast(blocks[0])
    arrow_q, arrow = to_arrow_type(query_type), to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch["ids"][i].as_py()
                graph = LayeredGraph.unpacked(np.frombuffer(batch["vectors"][i].as_py()).reshape(-1, dimension), batch["layers"][i].as_py(), batch["entry"][i].as_py())
                hits = [(name, ids[j], d) for name, row in zip(names, q, strict=True) for d, j in graph.search(row, k, max(beam, 2 * k))]
                yield pa.record_batch({"query_id": pa.array([h[0] for h in hits], arrow_q), "item_id": pa.array([h[1] for h in hits], arrow), "distance": pa.array([h[2] for h in hits], pa.float64())})

    order = Window.partitionBy("query_id").orderBy("distance", "item_id")
    return index.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).select("query_id", "item_id", "rank", "distance")


def layered_search(items: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector", beam: int = 64, segment: int = 4096, dimension: int | None = None) -> DataFrame:
    """``indexed_search`` of an index that is made for it. A beam as large as a segment makes it exact."""
    if dimension is None:
        first = queries.filter(F.size(vector_col) > 0).select(F.size(vector_col).alias("n")).first()
        dimension = first["n"] if first else 1
    return indexed_search(layered_index(items, id_col, vector_col, segment, dimension), queries, k, id_col, vector_col, beam, dimension)
