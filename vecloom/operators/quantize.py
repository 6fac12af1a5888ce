"""k-means, coarse (IVF) search, product and residual quantizers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.config import Quantizer
from vecloom.functions.vector import l2sq
from vecloom.operators.knn import block_of, matrix, scan
from vecloom.operators.lsh import first_k

#: Largest codebook that is sent to every task, in numbers.
MOST_NUMBERS = 20_000_000


def codebook(rows: DataFrame, most: int = 65536) -> np.ndarray:
    """Centroids (code, centroid) by code, as a checked, bounded matrix."""
    got = rows.select("code", "centroid").orderBy("code").limit(most + 1).collect()
    if not 0 < len(got) <= most:
        raise ValueError(f"between 1 and {most} centroids are needed")
    book = np.array([r["centroid"] for r in got], np.float64)
    if book.size > MOST_NUMBERS:
        raise ValueError("codebook too large")
    return book


def first_rows(items: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """The first k vectors by id: the fixed initial centroids."""
    rows = items.filter(F.col(vector_col).isNotNull()).orderBy(id_col).limit(k).select(vector_col).collect()
    if not rows:
        raise ValueError("training needs vectors")
    return np.array([r[0] for r in rows], np.float64)


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances by differences, which is what ties are judged by."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1) if len(x) else np.zeros((0, len(book)))


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            yield batch, matrix(batch["vector"]) if batch.num_rows else np.zeros((0, dimension))


def _source(items: DataFrame, id_col: str, vector_col: str, dimension: int) -> DataFrame:
    return items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(F.size("vector") == dimension)


def assign(items: DataFrame, book: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, code, distance): the nearest centroid of every vector, lowest code on ties, with the squared distance."""
    source = _source(items, id_col, vector_col, book.shape[1])
    shared = items.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, shared.value.shape[1]):
            d = _squares(x, shared.value)
            code = d.argmin(axis=1)
            yield pa.record_batch({"id": batch["id"], "code": pa.array(code.astype(np.int64)), "distance": pa.array(d[np.arange(len(x)), code])})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, code bigint, distance double")


def optimistic(items: DataFrame, book: np.ndarray, epsilon: float, probe: int = 8, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, code, distance): the best of the first ``probe`` centroids if within ``epsilon``, else the best of all."""
    source = _source(items, id_col, vector_col, book.shape[1])
    shared = items.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, shared.value.shape[1]):
            d = np.sqrt(_squares(x, shared.value))
            near, code = d[:, :probe].argmin(axis=1), d.argmin(axis=1)
            own = np.arange(len(x))
            code = np.where(d[own, near] > epsilon, code, near) if len(x) else code
            yield pa.record_batch({"id": batch["id"], "code": pa.array(code.astype(np.int64)), "distance": pa.array(d[own, code])})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, code bigint, distance double")


def step(items: DataFrame, book: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """One Lloyd step: means of the assigned vectors, summed within tasks; an empty cluster keeps its centroid."""
    source = _source(items, id_col, vector_col, book.shape[1])
    shared = items.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        total, count = np.zeros(book.shape), np.zeros(len(book), np.int64)
        for _, x in _blocks(batches, book.shape[1]):
            code = _squares(x, book).argmin(axis=1)
            np.add.at(total, code, x)
            count += np.bincount(code, minlength=len(book))
        used = np.flatnonzero(count)
        if len(used):
            yield pa.record_batch({"code": pa.array(used), "n": pa.array(count[used]), "total": pa.array([t.tobytes() for t in total[used]], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for code, n, t in zip(batch["code"].to_pylist(), batch["n"].to_pylist(), batch["total"].to_pylist(), strict=True):
                own = held.setdefault(code, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(t)
        if held:
            yield pa.record_batch({"code": pa.array(list(held), pa.int64()), "n": pa.array([v[0] for v in held.values()], pa.int64()), "total": pa.array([v[1].tobytes() for v in held.values()], pa.binary())})

    schema = "code bigint, n bigint, total binary"
    out = book.copy()
    # one row a centroid reaches the driver
    for row in source.mapInArrow(run, schema).repartition("code").mapInArrow(merge, schema).collect():
        out[row["code"]] = np.frombuffer(row["total"]) / row["n"]
    return out


def train(items: DataFrame, k: int, steps: int, id_col: str = "id", vector_col: str = "vector", tolerance: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """k-means from the first k vectors: until no centroid moves more than ``tolerance`` (squared) or ``steps`` are done."""
    book = first_rows(items, k, id_col, vector_col) if start is None else start
    for _ in range(steps):
        after = step(items, book, id_col, vector_col)
        moved = ((after - book) ** 2).sum(axis=1).max()
        book = after
        if moved <= tolerance:
            break
    return book


class Cells:
    """Which rows of a matrix are in a probed cell of which query."""

    def __init__(self, q: np.ndarray, book: np.ndarray, nprobe: int) -> None:
        self.book = book
        near = np.argsort(_squares(q, book), axis=1, kind="stable")[:, :nprobe]
        self.probed = np.zeros((len(q), len(book)), bool)
        np.put_along_axis(self.probed, near, True, axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.probed[:, _squares(x, self.book).argmin(axis=1)]


def ivf_search(items: DataFrame, queries: DataFrame, book: np.ndarray, k: int, nprobe: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, item_id, rank, distance): the k nearest items by squared L2 among those in the ``nprobe`` cells nearest to
    the query. Up to a block of queries goes to the tasks, which find an item's cell and score it in one scan; more queries
    meet the items in a join on the cell. ``write_cells`` stores the cells, for ``stored_ivf_search`` to read only those probed."""
    source = _source(items, id_col, vector_col, book.shape[1])
    asked = _source(queries, id_col, vector_col, book.shape[1]).filter("id is not null")
    blocks = block_of(asked)
    if blocks is None:
        coded = assign(items, book, id_col, vector_col).select("id", "code").join(source, "id")
        return _by_cell(coded, asked, book, k, nprobe)
    if not blocks:
        return items.sparkSession.createDataFrame([], f"query_id {asked.schema['id'].dataType.simpleString()}, item_id {source.schema['id'].dataType.simpleString()}, rank bigint, distance double")
    ids, q = blocks[0]
    found = scan(source, ids, q, k, "l2sq", query_type=asked.schema["id"].dataType.simpleString(), masks=Cells(q, book, nprobe))
    return first_k(found, k, "distance", "item_id").select("query_id", "item_id", "rank", "distance")


def _by_cell(coded: DataFrame, asked: DataFrame, book: np.ndarray, k: int, nprobe: int) -> DataFrame:
    shared = coded.sparkSession.sparkContext.broadcast(book)
    kind = asked.schema["id"].dataType.simpleString()

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, shared.value.shape[1]):
            order = np.argsort(_squares(x, shared.value), axis=1, kind="stable")[:, :nprobe]
            at = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
            yield pa.record_batch({"query_id": batch["id"].take(at), "code": pa.array(order.ravel().astype(np.int64)), "qv": batch["vector"].take(at)})

    probed = asked.mapInArrow(probes, f"query_id {kind}, code bigint, qv {asked.schema['vector'].dataType.simpleString()}")
    scored = coded.join(probed, "code").select("query_id", F.col("id").alias("item_id"), l2sq(F.col("qv"), F.col("vector")).alias("distance"))
    return first_k(scored, k, "distance", "item_id").select("query_id", "item_id", "rank", "distance")


def write_cells(items: DataFrame, book: np.ndarray, path: str, id_col: str = "id", vector_col: str = "vector") -> None:
    """Create an index: a table (id, vector, code) with a folder for each cell of the codebook. A new index replaces an old one."""
    source = _source(items, id_col, vector_col, book.shape[1])
    assign(items, book, id_col, vector_col).select("id", "code").join(source, "id").repartition("code").write.mode("overwrite").partitionBy("code").parquet(path)


def stored_ivf_search(spark: SparkSession, path: str, queries: DataFrame, book: np.ndarray, k: int, nprobe: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``ivf_search`` of a stored index; of up to a block of queries, only the folders of their cells are read."""
    asked = _source(queries, id_col, vector_col, book.shape[1]).filter("id is not null")
    stored = spark.read.parquet(path).withColumn("code", F.col("code").cast("bigint"))
    blocks = block_of(asked)
    if blocks:
        used = np.flatnonzero(Cells(blocks[0][1], book, nprobe).probed.any(axis=0)).tolist()
        stored = spark.read.parquet(path).filter(F.col("code").isin(used)).withColumn("code", F.col("code").cast("bigint"))
    return _by_cell(stored, asked, book, k, nprobe)


@dataclass(frozen=True)
class ProductBook:
    """Sub-codebooks of equal width; dimensions past the last full part are ignored."""

    parts: np.ndarray

    @property
    def width(self) -> int:
        return self.parts.shape[2]


def product_book(items: DataFrame, parts: int, codes: int, steps: int = 0, id_col: str = "id", vector_col: str = "vector") -> ProductBook:
    start = first_rows(items, codes, id_col, vector_col)
    width = start.shape[1] // parts
    books = []
    for p in range(parts):
        piece = items.select(F.col(id_col).alias("id"), F.slice(vector_col, p * width + 1, width).alias("vector"))
        books.append(train(piece, codes, steps, start=start[:, p * width : (p + 1) * width]) if steps else start[:, p * width : (p + 1) * width])
    return ProductBook(np.stack(books))


def pq_encode(items: DataFrame, book: ProductBook, dimension: int = 64, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, codes, error): nearest sub-centroid of every part (lowest code on ties), and the squared distance of the vector
    to its reconstruction, in which ignored dimensions are 0."""
    source = _source(items, id_col, vector_col, dimension)
    shared = items.sparkSession.sparkContext.broadcast(book.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        width = parts.shape[2]
        for batch, x in _blocks(batches, dimension):
            codes = np.stack([_squares(x[:, p * width : (p + 1) * width], parts[p]).argmin(axis=1) for p in range(len(parts))], axis=1)
            back = np.zeros_like(x)
            for p in range(len(parts)):
                back[:, p * width : (p + 1) * width] = parts[p][codes[:, p]]
            yield pa.record_batch({"id": batch["id"], "codes": pa.array(codes.astype(np.int16).tolist(), pa.list_(pa.int16())), "error": pa.array(((x - back) ** 2).sum(axis=1))})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, codes array<smallint>, error double")


def rq_encode(items: DataFrame, levels: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, codes, error): per level the centroid nearest to what the levels before left over, and the squared rest."""
    dimension = levels.shape[2]
    source = _source(items, id_col, vector_col, dimension)
    shared = items.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dimension):
            rest, codes = x, []
            for book in shared.value:
                code = _squares(rest, book).argmin(axis=1)
                rest = rest - book[code]
                codes.append(code)
            yield pa.record_batch({"id": batch["id"], "codes": pa.array(np.stack(codes, axis=1).astype(np.int16).tolist(), pa.list_(pa.int16())), "error": pa.array((rest**2).sum(axis=1))})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, codes array<smallint>, error double")


def rq_train(items: DataFrame, levels: int, codes: int, steps: int, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """Codebooks level by level; each level is trained on the rests of the ones before, derived again from the vectors."""
    books: list[np.ndarray] = []
    for _ in range(levels):
        rests = residuals(items, books, id_col, vector_col) if books else items.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        books.append(train(rests, codes, steps))
    return np.stack(books)


def residuals(items: DataFrame, books: list[np.ndarray], id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    dimension = books[0].shape[1]
    source = _source(items, id_col, vector_col, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dimension):
            for book in books:
                x = x - book[_squares(x, book).argmin(axis=1)]
            yield pa.record_batch({"id": batch["id"], "vector": pa.array(x.tolist(), pa.list_(pa.float64()))})

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, vector array<double>")


def pack_codes(codes, bits: int):  # noqa: ANN001, ANN201
    """Codes as one bigint, ``bits`` each, the first lowest. For at most 63 bits together."""
    return F.aggregate(F.transform(codes, lambda c, i: F.call_function("shiftleft", c.cast("bigint"), i * bits)), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))


#: Kinds of quantizers.
KINDS = ("standard", "optimistic", "product", "residual")


def encode(items: DataFrame, kind: str, book: np.ndarray | ProductBook, epsilon: float = 1.3, probe: int = 8, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, codes, error): codes by the quantizer of that kind: one code (standard, optimistic), one a part (product, ``book`` being
    a ``ProductBook``) or one a level (residual, ``book`` having a level in front). Any other kind is an error."""
    if kind in ("standard", "optimistic"):
        found = assign(items, book, id_col, vector_col) if kind == "standard" else optimistic(items, book, epsilon, probe, id_col, vector_col)
        # the optimistic quantizer reports the distance itself, the others its square
        error = F.col("distance") if kind == "standard" else F.col("distance") * F.col("distance")
        return found.select("id", F.array(F.col("code").cast("smallint")).alias("codes"), error.alias("error"))
    if kind == "product":
        return pq_encode(items, book, book.parts.shape[0] * book.width, id_col, vector_col)
    if kind == "residual":
        return rq_encode(items, book, id_col, vector_col)
    raise ValueError(f"unknown quantizer {kind}: one of {', '.join(KINDS)}")


def trained(items: DataFrame, kind: str, how: Quantizer, levels: int = 2, id_col: str = "id", vector_col: str = "vector") -> np.ndarray | ProductBook:
    """The codebook for ``encode`` by the parameters of a configuration."""
    if kind in ("standard", "optimistic"):
        return train(items, how.centroids, how.steps, id_col, vector_col, how.tolerance)
    if kind == "product":
        return product_book(items, how.parts, how.centroids, how.steps, id_col, vector_col)
    if kind == "residual":
        return rq_train(items, levels, how.centroids, how.steps, id_col, vector_col)
    raise ValueError(f"unknown quantizer {kind}: one of {', '.join(KINDS)}")


def change_rate(items: DataFrame, before: np.ndarray, after: np.ndarray, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(rows, changed, rate): share of the vectors that two codebooks assign to different codes, in one scan."""
    source = _source(items, id_col, vector_col, before.shape[1])
    shared = items.sparkSession.sparkContext.broadcast((before, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = changed = 0
        for _, x in _blocks(batches, shared.value[0].shape[1]):
            old, new = (_squares(x, book).argmin(axis=1) for book in shared.value)
            n, changed = n + len(x), changed + int((old != new).sum())
        yield pa.record_batch({"rows": pa.array([n], pa.int64()), "changed": pa.array([changed], pa.int64())})

    sums = source.mapInArrow(run, "rows bigint, changed bigint").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"))
    return sums.withColumn("rate", F.when(F.col("rows") > 0, F.col("changed") / F.col("rows")))
