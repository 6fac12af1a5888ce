"""Most similar vectors for every vector, with a forest of sorted hash strings."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.runtime import shuffle_partitions, stage

#: Bits of a hash string; a tree is the sorted array of the strings of all vectors.
STRING_BITS = 62


@dataclass(frozen=True)
class Forest:
    """``trees``: numbers of trees to choose from by their work. ``most``: rows that a vector may share a prefix with and
    still meet them all; ``missed``: share of the vectors similar enough that may share no such prefix in any tree.
    ``sample`` bounds what the hash functions, levels and cells are fitted to; all vectors are indexed."""

    trees: tuple[int, ...] = (4, 8, 16, 32, 64)
    most: int = 16_384
    missed: float = 0.002
    sample: int = 4096
    seed: int = 17


def usable(vector: Column, dimension: int = 64) -> Column:
    """Whether a vector has ``dimension`` finite numbers, not all zero."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither vanish nor overflow
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_classes(df: DataFrame, id_col: str, vector_col: str, k: int, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Usable vectors, equal ones together: (classes, members).

    ``classes``: (class, vector, ids), ids being the ``k + 1`` least of the class, which are all that can be
    among anyone's k most similar (ties go to the lesser id); ``members``: (id, class). The least ids are found
    by a ranking whose limit applies before the shuffle, so a class with a third of all rows moves little.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).filter("id is not null").filter(usable(F.col("vector"), dimension))
    # adding zero makes the two zeros one value
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast("float")))
    rows = rows.withColumn("class", F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), F.reverse("vector")).alias("g")))
    least = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("place") <= k + 1)
    classes = least.groupBy("class").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))
    return stage(classes, "vectors"), rows.select("id", "class").distinct()


def bounded_sample(rows: DataFrame, number: int, most: int, dimension: int) -> np.ndarray:
    """At most ``most`` unit vectors of (id, vector), chosen by a hash of the id: what planes and cells are fitted to."""
    # a hash range of about four times the sample, so that no task sends much to choose it from
    rate = int(min(1.0, 4 * most / max(1, number)) * (1 << 20))
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= rate).orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toPandas()["vector"]
    return _unit(np.array(sample.tolist(), dtype=np.float64).reshape(-1, dimension)) if len(sample) else np.zeros((0, dimension))


# hash strings


def fit_planes(sample: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash functions from a bounded sample: planes across the line between two sampled vectors, through the
    median of the sample, so that every bit halves the data and dense regions are cut as often as they are full."""
    rng = np.random.default_rng(seed)
    bits = trees * STRING_BITS
    if len(sample) < 2:
        normals = rng.standard_normal((bits, sample.shape[1] if sample.size else 1))
    else:
        first = rng.integers(0, len(sample), bits)
        second = (first + rng.integers(1, len(sample), bits)) % len(sample)
        normals = sample[first] - sample[second]
        flat = np.abs(normals).max(axis=1) < 1e-9
        normals[flat] = rng.standard_normal((int(flat.sum()), sample.shape[1]))
    middle = np.concatenate([np.median(sample @ normals[at : at + STRING_BITS].T, axis=0) for at in range(0, bits, STRING_BITS)]) if len(sample) else np.zeros(bits)
    return normals.astype(np.float32), middle.astype(np.float32)


def hash_strings(x: np.ndarray, normals: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """A row of strings for each vector, one a tree; the first plane gives the highest bit."""
    weight = np.int64(1) << np.arange(STRING_BITS - 1, -1, -1, dtype=np.int64)
    x = x.astype(np.float32)
    out = np.empty((len(x), len(normals) // STRING_BITS), np.int64)
    for t in range(out.shape[1]):
        own = slice(t * STRING_BITS, (t + 1) * STRING_BITS)
        out[:, t] = (x @ normals[own].T >= middle[own]) @ weight
    return out


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of strings."""
    return STRING_BITS - np.ceil(np.log2((a ^ b).astype(np.float64) + 1)).astype(np.int64).clip(0, STRING_BITS)


def cut_cells(strings: np.ndarray, share: float) -> list[tuple[int, int, int]]:
    """Prefixes of varying length that divide a tree: (first string, length, sampled strings), ``share`` of them at most."""
    strings = np.sort(strings)
    cells, open_ = [], [(0, len(strings), 0, 0)]
    while open_:
        low, high, depth, start = open_.pop()
        if high - low <= share or depth == STRING_BITS:
            cells.append((start, depth, high - low))
            continue
        second = start + (1 << (STRING_BITS - 1 - depth))
        middle = low + int(np.searchsorted(strings[low:high], second))
        open_ += [(middle, high, depth + 1, second), (low, middle, depth + 1, start)]
    return sorted(cells)


def spread(sizes: list[float], parts: int) -> list[int]:
    """A part for each cell, the largest first into the least full part."""
    heap = [(0.0, p) for p in range(parts)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        full, p = heapq.heappop(heap)
        out[i] = p
        heapq.heappush(heap, (full + sizes[i] + 1e-6, p))
    return out


@dataclass(frozen=True)
class Hashing:
    """Fitted trees. ``levels[i]``: prefix length to which a vector ascends to meet those of similarity ``scores[i]`` (rising).
    Cells are numbered across trees; ``first[t]`` is a tree's first cell, ``starts[t]`` their strings."""

    normals: np.ndarray
    middle: np.ndarray
    trees: int
    scores: np.ndarray
    levels: np.ndarray
    first: list[int]
    starts: list[np.ndarray]
    depth: np.ndarray
    part: np.ndarray
    parts: int


#: Comparisons that cost about as much as one more row of a tree.
_ROW = 2000


def fit(sample: np.ndarray, number: int, least: float, forest: Forest, parts: int) -> Hashing:
    """Planes, the number of trees, and how far to ascend.

    Sampled vectors and copies moved to a known similarity show which prefixes such pairs share: the level of a similarity
    is the longest prefix that all but ``missed`` of them share in some tree. The fewest comparisons decide the number of
    trees, if a vector meets no more than a fourth of ``most`` rows in one on average; otherwise the least number is taken, and an exact
    search does the rest.
    """
    most_trees = max(forest.trees) if len(sample) > 1 else min(forest.trees)
    normals, middle = fit_planes(sample, most_trees, forest.seed)
    strings = hash_strings(sample, normals, middle) if len(sample) else np.zeros((0, most_trees), np.int64)
    scores = 1 - (1 - least) * 0.7 ** np.arange(14)
    rng = np.random.default_rng(forest.seed + 1)
    tried = sample[:1000]
    lengths = []
    for s in scores if len(tried) else ():
        w = rng.standard_normal(tried.shape)
        w -= (w * tried).sum(axis=1, keepdims=True) * tried
        w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
        moved = s * tried + np.sqrt(max(0.0, 1 - s * s)) * w
        lengths.append(np.maximum.accumulate(shared_bits(strings[: len(tried)], hash_strings(moved, normals, middle)), axis=1))

    def levels(trees: int) -> np.ndarray:
        if not lengths:
            return np.zeros(len(scores), np.int64)
        found = np.array([int(np.quantile(x[:, trees - 1], forest.missed, method="lower")) for x in lengths])
        return np.maximum.accumulate(found)

    def met(trees: int) -> float:
        base = int(levels(trees)[0])
        sizes = [np.unique(strings[:, t] >> (STRING_BITS - base), return_counts=True)[1] for t in range(trees)]
        return number * float(np.mean([((c / max(1, len(sample))) ** 2).sum() for c in sizes]))

    options = [(t * (_ROW + m), t) for t in forest.trees if t <= most_trees and (m := met(t)) <= forest.most / 4] if number > forest.most else []
    trees = min(options)[1] if options else min(forest.trees) if number > forest.most else 1
    parts = max(parts, number * trees // 100_000)
    # cells depend on the data alone, so that partitions change no result
    share = 2 * forest.most * len(sample) / max(1, number)
    first, starts, depth, sizes = [], [], [], []
    for t in range(trees):
        cells = cut_cells(strings[:, t], share)
        first.append(len(depth))
        starts.append(np.array([c[0] for c in cells], np.int64))
        depth += [c[1] for c in cells]
        sizes += [float(c[2]) for c in cells]
    used = slice(0, trees * STRING_BITS)
    return Hashing(normals[used], middle[used], trees, scores, levels(trees), first, starts, np.array(depth), np.array(spread(sizes, parts), np.int32), parts)


# descent and ascent


def _best(owner: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best scores of every owner, and their ranks."""
    order = np.lexsort((-score, owner))
    own = owner[order]
    first = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    return order[rank < k], rank[rank < k]


class Ascent:
    """The rows of one cell of a tree in order of their strings.

    Every vector starts among those with the longest common prefix and ascends: where two branches of the sorted array
    join, open vectors of either meet all of the other. A vector is closed at the level that its k-th best so far asks for:
    with all trees at that level, whoever is at least as similar has been met in one of them. It is left over where it would
    meet more than ``most`` rows.
    """

    LEAF, CHUNK = 96, 512

    def __init__(self, strings: np.ndarray, x: np.ndarray, k: int, least: float, scores: np.ndarray, levels: np.ndarray, most: int) -> None:
        n = len(strings)
        # eight-bit numbers: two more than asked for, and a little less than the least similarity
        self.keep, self.k, self.least = k + 2, k, least
        self.strings, self.x, self.scores, self.levels, self.most = strings, x, scores, levels, most
        self.score = np.full((n, self.keep), -2.0, np.float32)
        self.other = np.full((n, self.keep), -1, np.int64)
        self.floor = np.full(n, least - 0.01, np.float32)
        self.open, self.left = np.ones(n, bool), np.zeros(n, bool)

    def run(self, level: int) -> None:
        if len(self.strings):
            self._visit(0, len(self.strings), level)
            self.left |= self.open

    def _visit(self, low: int, high: int, level: int) -> None:
        bits = STRING_BITS - int(self.strings[low] ^ self.strings[high - 1]).bit_length()
        if high - low <= self.LEAF or bits == STRING_BITS:
            if high - low > self.most:
                return self._leave(low, high)
            self._meet(low, high, low, high)
        else:
            shift = STRING_BITS - 1 - bits
            middle = low + int(np.searchsorted(self.strings[low:high], self.strings[high - 1] >> shift << shift))
            self._visit(low, middle, bits + 1)
            self._visit(middle, high, bits + 1)
            if high - low > self.most:
                return self._leave(low, high)
            if self.open[low:high].any():
                self._meet(low, middle, middle, high)
                self._meet(middle, high, low, middle)
        return self._close(low, high, level)

    def _leave(self, low: int, high: int) -> None:
        self.left[low:high] |= self.open[low:high]
        self.open[low:high] = False

    def _close(self, low: int, high: int, level: int) -> None:
        own = low + np.flatnonzero(self.open[low:high])
        reached = np.maximum(self.score[own, self.k - 1].astype(np.float64) - 0.01, self.least)
        at = self.levels[np.maximum(np.searchsorted(self.scores, reached + 1e-9, side="right") - 1, 0)]
        self.open[own[at >= level]] = False

    def _meet(self, low: int, high: int, first: int, last: int) -> None:
        asked = low + np.flatnonzero(self.open[low:high])
        others = self.x[first:last].T
        for at in range(0, len(asked), self.CHUNK):
            own = asked[at : at + self.CHUNK]
            s = self.x[own] @ others
            if low == first:
                s[np.arange(len(own)), own - first] = -2
            enough = s >= self.floor[own][:, None]
            flat = np.flatnonzero(enough)
            if len(flat) > self.keep * len(own):
                many = np.flatnonzero(enough.sum(axis=1) > 4 * self.keep)
                if len(many):
                    top = np.argpartition(s[many], -self.keep, axis=1)[:, -self.keep :]
                    kept = np.zeros((len(many), s.shape[1]), bool)
                    np.put_along_axis(kept, top, True, axis=1)
                    enough[many] &= kept
                    flat = np.flatnonzero(enough)
            if len(flat):
                rows, columns = np.divmod(flat, s.shape[1])
                self._add(own[rows], columns + first, s.ravel()[flat])

    def _add(self, rows: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        own = np.unique(rows)
        owner = np.concatenate([np.repeat(own, self.keep), rows])
        other = np.concatenate([self.other[own].ravel(), others])
        score = np.concatenate([self.score[own].ravel(), scores])
        best, rank = _best(owner, score, self.keep)
        self.score[owner[best], rank], self.other[owner[best], rank] = score[best], other[best]
        self.floor[own] = np.maximum(self.floor[own], self.score[own, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, other, score) of the rows that are not left over."""
        rows, places = np.nonzero((self.other >= 0) & ~self.left[:, None])
        return rows, self.other[rows, places], self.score[rows, places]


def forest_links(first: DataFrame, number: int, k: int, least: float, dimension: int, forest: Forest = Forest()) -> DataFrame:
    """Links (a, b, score) of (id, vector): for every vector and tree the best k (and two more) of whom it met.

    Each tree is one sorted array of hash strings: rows go to tasks by cells, prefixes of varying length, so a task holds
    stretches of sorted arrays. ``Ascent`` descends to the longest prefixes and ascends in all trees by the same levels.
    Vectors travel as 8-bit integers; scores are within about 0.005 of the cosine and only choose candidates. A link found in
    several trees is given several times; a row without ``b`` says that ``a`` shares the level it needs with too many rows, and has
    the score of its k-th best so far (-2 without one) instead of its links.
    """
    spark = first.sparkSession
    fitted = fit(bounded_sample(first, number, forest.sample, dimension), number, least, forest, shuffle_partitions(spark))
    shared = spark.sparkContext.broadcast(fitted)
    id_type = first.schema["id"].dataType.simpleString()
    id_arrow = to_arrow_type(first.schema["id"].dataType)
    width, most = dimension + 4, forest.most

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x = _unit(_matrix(batch["vector"], dimension)).astype(np.float32)
                scale = np.abs(x).max(axis=1, keepdims=True)
                small = np.rint(x / scale * 127).astype(np.int8)
                payload = np.concatenate([small.view(np.uint8), scale.astype(np.float32).view(np.uint8)], axis=1)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(payload))]).cast(pa.binary())
                keys = hash_strings(x, h.normals, h.middle)
                for t in range(h.trees):
                    cell = h.first[t] + np.searchsorted(h.starts[t], keys[:, t], side="right") - 1
                    yield pa.record_batch({"part": pa.array(h.part[cell]), "cell": pa.array(cell.astype(np.int32)), "string": pa.array(keys[:, t]), "id": batch["id"], "packed": packed})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value

        def links(cell: int, held: list[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            raw = np.frombuffer(b"".join(rows["packed"].to_pylist()), np.uint8).reshape(-1, width)
            x = raw[:, :dimension].view(np.int8).astype(np.float32) * (np.ascontiguousarray(raw[:, dimension:]).view(np.float32) / 127)
            ascent = Ascent(rows["string"].to_numpy(), x, k, least, h.scores, h.levels, most)
            # part of a cell can't say that it is complete at any level
            ascent.run(int(h.depth[cell]) if whole else STRING_BITS + 1)
            ids = rows["id"].chunk(0)
            a, b, score = ascent.found()
            left = np.flatnonzero(ascent.left)
            for at in range(0, len(a), 20_000):
                own = slice(at, at + 20_000)
                yield pa.record_batch({"a": ids.take(pa.array(a[own])), "b": ids.take(pa.array(b[own])), "score": pa.array(score[own])})
            if len(left):
                yield pa.record_batch({"a": ids.take(pa.array(left)), "b": pa.nulls(len(left), id_arrow), "score": pa.array(ascent.score[left, k - 1])})

        yield from by_cell(batches, links)

    rows = first.mapInArrow(strings, f"part int, cell int, string bigint, id {id_type}, packed binary")
    sorted_trees = rows.repartitionById(fitted.parts, "part").sortWithinPartitions("cell", "string", "id")
    return sorted_trees.mapInArrow(walk, f"a {id_type}, b {id_type}, score float")


#: Rows of a cell that a task holds at a time.
WINDOW = 1 << 17


def by_cell(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """``work(cell, rows, whole)`` for each run of a cell's rows; a cell of more than ``WINDOW`` rows comes in several."""
    last, held, size, cut = None, [], 0, False
    for whole in batches:
        of = whole["cell"].to_numpy()
        ends = np.r_[np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else []
        at = 0
        for end in ends:
            if last is not None and of[at] != last:
                yield from work(last, held, not cut)
                held, size, cut = [], 0, False
            last = int(of[at])
            while at < end:
                if size == WINDOW:
                    cut = True
                    yield from work(last, held, False)
                    held, size = [], 0
                part = whole.slice(at, min(int(end) - at, WINDOW - size))
                held.append(part)
                size += part.num_rows
                at += part.num_rows
    if last is not None:
        yield from work(last, held, not cut)


def with_similarity(pairs: DataFrame, first: DataFrame, dimension: int) -> DataFrame:
    """(a, b, similarity) of pairs of ids: the cosine in double precision."""
    kind = first.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                s = (_unit(_matrix(batch["va"], dimension)) * _unit(_matrix(batch["vb"], dimension))).sum(axis=1)
                yield pa.record_batch({"a": batch["a"], "b": batch["b"], "similarity": pa.array(s)})

    side = lambda x: first.select(F.col("id").alias(x), F.col("vector").alias(f"v{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def most_similar(df: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = 5, least: float = -1.0, dimension: int = 64, forest: Forest = Forest()) -> DataFrame:
    """(id, neighbour, similarity, rank): for every usable vector its k most similar others, of similarity ``least`` or more.

    Ties go to the lesser id. Equal vectors are one class in the forest; the others of a vector's class come first
    in its list (similarity 1). Vectors that are null, of another length, zero or not finite have no rows and are in no
    list; so have rows with a null id. Repeated rows with the same id and vector count once. An empty table gives an
    empty result. The forest finds all but a few of the neighbours (``Forest.missed``); vectors that share the prefixes they
    need with too many others are compared exactly, as a query set in blocks (``blocks.closest``). Scores are exact. Other
    columns are not read, whatever their names.
    """
    from vecloom.llm.blocks import closest

    classes, members = vector_classes(df, id_col, vector_col, k, dimension)
    first = classes.select(F.col("ids")[0].alias("id"), "vector")
    number = first.count()
    links = stage(forest_links(first, number, k + 1, least, dimension, forest), "links")
    # a little less than what the k-th best reaches
    rest = stage(links.filter("b is null").groupBy(F.col("a").alias("id")).agg((F.max("score").cast("double") - 0.01).alias("floor")), "rest")
    met = links.filter("b is not null").groupBy("a", "b").agg(F.max("score").alias("score"))
    if rest.head(1):
        settled = met.join(rest.select(F.col("id").alias("a")), "a", "left_anti")
        found = with_similarity(settled.select("a", "b"), first, dimension).unionByName(closest(first, number, rest, k + 1, least, dimension))
    else:
        found = with_similarity(met.select("a", "b"), first, dimension)
    names = classes.select(F.col("ids")[0].alias("name"), "class", "ids")
    directed = found.filter(F.col("similarity") >= least).select(F.col("a").alias("name"), F.col("b").alias("other"), "similarity")
    # a class's k best other classes hold its k best other vectors
    ranked = directed.withColumn("turn", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("similarity"), "other"))).filter(F.col("turn") <= k + 1)
    others = ranked.join(names.select(F.col("name").alias("other"), F.col("ids").alias("near")), "other").groupBy("name").agg(F.flatten(F.collect_list(F.transform("near", lambda i: F.struct((-F.col("similarity")).alias("far"), i.alias("id"))))).alias("near"))
    lists = names.join(others, "name", "left").select("class", F.concat(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("id"))), F.coalesce("near", F.array())).alias("near"))
    own = members.join(lists, "class").select("id", F.slice(F.array_sort(F.filter("near", lambda n: n["id"] != F.col("id"))), 1, k).alias("near"))
    return own.select("id", F.posexplode("near").alias("place", "n")).select("id", F.col("n.id").alias("neighbour"), (-F.col("n.far")).alias("similarity"), (F.col("place") + 1).alias("rank")).filter(F.col("similarity") >= least)


def similar_pairs(df: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = 5, least: float = 0.93, dimension: int = 64, forest: Forest = Forest()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of similarity ``least`` or more, one among the k most similar of the other."""
    found = most_similar(df, id_col, vector_col, k, least, dimension, forest)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
