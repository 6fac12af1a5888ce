"""Similarity clusters by average linkage, merging all reciprocal nearest neighbours of a round at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecloom.llm.annforest import STRING_BITS, _matrix, _unit, bounded_sample, by_cell, cut_cells, fit_planes, hash_strings, spread, vector_classes
from vecloom.runtime import release, shuffle_partitions, stage


@dataclass(frozen=True)
class Linkage:
    """``least``: average similarity below which nothing merges. ``cell``: clusters that are linked with each other in a round;
    the links of a round join those that share a prefix of its tree. ``settled``: share of the clusters that must merge in
    a round for another one to follow, with another tree. ``sample`` bounds what a tree is fitted to."""

    least: float = 0.3
    cell: int = 2048
    settled: float = 0.01
    sample: int = 4096
    seed: int = 29
    most_rounds: int = 100


@dataclass(frozen=True)
class Clusters:
    """``classes``: (class, ids, vector, size, fragment, cluster), a row for each class of equal vectors; ``members``: (id, class);
    ``fragments``: (fragment, cluster), what the first round made and where it ended, each of a bounded number of classes;
    ``sums``: (cluster, size, total), members and the sum of their unit vectors as packed doubles."""

    classes: DataFrame
    members: DataFrame
    fragments: DataFrame
    sums: DataFrame


def merge_all(total: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Average linkage of a complete graph: label (an index) of each node; ``total`` and ``size`` become those of the labels.

    Every step merges all pairs that are each other's most similar, which gives what merging one pair at a time gives, since
    average linkage never makes a merged cluster more similar to a third than both its parts were. The average similarity of two
    clusters is the product of their vector sums over the product of their sizes, so it is exact at any size. Only rows whose
    most similar cluster merged are searched anew. Ties go to the first pair.
    """
    n = len(size)
    label, names = np.arange(n), np.arange(n)
    while len(names) > 1:
        own, weight = total[names], size[names]
        mean = own / weight[:, None]
        s = mean @ mean.T
        np.fill_diagonal(s, -np.inf)
        best = s.argmax(axis=1)
        value = s[np.arange(len(names)), best]
        alive = np.ones(len(names), bool)
        # the matrix is made anew when half of it is gone
        while 2 * alive.sum() >= len(names):
            at = np.flatnonzero(alive & (value >= least))
            a = at[(best[best[at]] == at) & (at < best[at])]
            if not len(a):
                if len(at):
                    # rounding alone can leave none of equal ones mutual
                    a = at[[value[at].argmax()]]
                else:
                    total[names], size[names] = own, weight
                    return _final(label)
            b = best[a]
            own[a] += own[b]
            weight[a] += weight[b]
            mean[a] = own[a] / weight[a][:, None]
            label[names[b]] = names[a]
            alive[b] = False
            s[b] = -np.inf
            s[:, b] = -np.inf
            value[b] = -np.inf
            rows = mean[a] @ mean.T
            rows[:, ~alive] = -np.inf
            rows[np.arange(len(a)), a] = -np.inf
            s[a] = rows
            s[:, a] = rows.T
            gone = np.zeros(len(names), bool)
            gone[a] = gone[b] = True
            again = np.flatnonzero(alive & (gone | gone[best]))
            best[again] = s[again].argmax(axis=1)
            value[again] = s[again, best[again]]
        total[names], size[names] = own, weight
        names = names[alive]
    return _final(label)


def _final(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def pieces(strings: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of sorted strings of ``most`` at most: prefixes as long as that takes, joined from the left while they fit."""
    open_, start, end = [(0, len(strings))], 0, 0
    while open_:
        low, high = open_.pop()
        if high - low > most:
            bits = STRING_BITS - int(strings[low] ^ strings[high - 1]).bit_length()
            if bits < STRING_BITS:
                shift = STRING_BITS - 1 - bits
                middle = low + int(np.searchsorted(strings[low:high], strings[high - 1] >> shift << shift))
            else:
                middle = low + most
            open_ += [(middle, high), (low, middle)]
        elif high - start > most:
            yield start, end
            start, end = low, high
        else:
            end = high
    if end > start:
        yield start, end


def _packed(total: np.ndarray) -> pa.Array:
    return pa.array([t.tobytes() for t in total], pa.binary())


def _sums(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimension).copy()


def _round(nodes: DataFrame, number: int, turn: int, how: Linkage, dimension: int, id_type: str) -> DataFrame:
    """(old, node, size, total): one round; ``size`` and ``total`` on the rows of those that remain.

    Nodes are (id, size, vector): the first round has vectors, later ones means, of which total is the product with the size.
    """
    spark = nodes.sparkSession
    sample = bounded_sample(nodes, number, how.sample, dimension)
    normals, middle = fit_planes(sample, 1, how.seed + turn)
    cells = cut_cells(hash_strings(sample, normals, middle)[:, 0] if len(sample) else np.zeros(0, np.int64), 8 * how.cell * len(sample) / max(1, number))
    parts = shuffle_partitions(spark)
    shared = spark.sparkContext.broadcast((normals, middle, np.array([c[0] for c in cells], np.int64), np.array(spread([float(c[2]) for c in cells], parts), np.int32)))
    of_units, least, cell = turn == 0, how.least, how.cell
    arrow = to_arrow_type(nodes.schema["id"].dataType)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, middle, starts, part = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                x = _matrix(batch["vector"], dimension)
                key = hash_strings(_unit(x), normals, middle)[:, 0]
                of = np.searchsorted(starts, key, side="right") - 1
                yield pa.record_batch({"part": pa.array(part[of]), "cell": pa.array(of.astype(np.int32)), "string": pa.array(key), "id": batch["id"], "size": batch["size"], "vector": _packed(x)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(_: int, held: list[pa.RecordBatch], __: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            ids, key = rows["id"].combine_chunks(), rows["string"].to_numpy()
            for low, high in pieces(key, cell):
                part = rows.slice(low, high - low)
                raw = b"".join(part["vector"].to_pylist())
                x = _unit(np.frombuffer(raw, np.float32).reshape(-1, dimension)) if of_units else np.frombuffer(raw, np.float64).reshape(-1, dimension)
                size = part["size"].to_numpy().astype(np.float64)
                total = x * size[:, None]
                label = merge_all(total, size, least)
                remain = label == np.arange(len(label))
                # nulls where the node is gone
                yield pa.record_batch({"old": ids.slice(low, high - low), "node": ids.take(pa.array(label + low)), "size": pa.array(size.astype(np.int64), mask=~remain), "total": pa.array([t.tobytes() if r else None for t, r in zip(total, remain, strict=True)], pa.binary())})

        yield from by_cell(batches, work)

    rows = nodes.mapInArrow(strings, f"part int, cell int, string bigint, id {id_type}, size bigint, vector binary")
    return stage(rows.repartitionById(parts, "part").sortWithinPartitions("cell", "string", "id").mapInArrow(merge, f"old {id_type}, node {id_type}, size bigint, total binary"), "round")


def _means(now: DataFrame, dimension: int, id_type: str) -> DataFrame:
    """What a round left as nodes of the next one: (id, size, vector), the mean in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = (_sums(batch["total"], dimension) / batch["size"].to_numpy()[:, None]).ravel()
                ends = pa.array(np.arange(0, len(values) + 1, dimension, dtype=np.int32))
                yield pa.record_batch({"id": batch["node"], "size": batch["size"], "vector": pa.ListArray.from_arrays(ends, pa.array(values))})

    return now.filter("total is not null").mapInArrow(run, f"id {id_type}, size bigint, vector array<double>")


def similarity_clusters(df: DataFrame, id_col: str = "id", vector_col: str = "vector", how: Linkage = Linkage(), dimension: int = 64) -> Clusters:
    """Clusters of mutually similar vectors. ``cluster`` is the least id of one class of the cluster; a vector without similar
    ones is a cluster of its own.

    Every round makes a sparse graph: clusters that share a prefix in a tree of hash strings (``cell`` of them at most) are
    linked. Within its links, all pairs that are each other's most similar merge, until no two linked clusters have an
    average similarity of ``least`` (``merge_all``). The next round hashes the means of what is left with another tree, so
    links are never lost for good: fragments of one cluster have means that hardly differ and share the longest prefixes.
    Rounds end when everything left was linked with everything, or few merge (``settled``). Similarities are exact averages from
    vector sums in every round. Cells are fitted to a sample of fixed size, so neither partitions nor tasks change the result.

    Vectors that are not usable belong to no cluster; an empty table gives none. Equal vectors share a cluster, and repeated
    rows count once. Other columns are not read, whatever their names.
    """
    classes, members = vector_classes(df, id_col, vector_col, 1, dimension)
    members = stage(members, "members")
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    classes = stage(classes.join(sizes, "class").withColumn("name", F.col("ids")[0]), "classes")
    id_type = classes.schema["name"].dataType.simpleString()
    nodes, number = classes.select(F.col("name").alias("id"), "size", "vector"), classes.count()
    rounds: list[DataFrame] = []
    for turn in range(how.most_rounds):
        rounds.append(_round(nodes, number, turn, how, dimension, id_type))
        nodes, before = _means(rounds[-1], dimension, id_type), number
        number = nodes.count()
        if before <= how.cell or before - number <= how.settled * before:
            break
    first = rounds[0].select(F.col("old").alias("name"), F.col("node").alias("fragment"))
    # a node is merged away once at most, so the rounds' merges are a forest; halving its paths finds the roots
    up = None
    for now in rounds[1:]:
        gone = now.filter("old <> node").select("old", "node")
        up = gone if up is None else up.unionByName(gone)
    fragments = rounds[0].filter("old = node").select(F.col("node").alias("fragment"))
    if up is None:
        fragments = fragments.withColumn("cluster", F.col("fragment"))
    else:
        up = stage(up, "merges")
        for _ in range((len(rounds) - 1).bit_length()):
            above = up.select(F.col("old").alias("node"), F.col("node").alias("above"))
            up = up.join(above, "node", "left").select("old", F.coalesce("above", "node").alias("node"))
        fragments = stage(fragments.join(up, F.col("fragment") == F.col("old"), "left").select("fragment", F.coalesce("node", "fragment").alias("cluster")), "fragments")
    sums = rounds[-1].filter("total is not null").select(F.col("node").alias("cluster"), "size", "total")
    named = classes.join(first, "name").join(fragments, "fragment").select("class", "ids", "vector", "size", "fragment", "cluster")
    for now in rounds[1:-1]:
        release(now)
    return Clusters(stage(named, "clusters"), members, fragments, sums)


def codebook(centroids: DataFrame, quantizer: str = "standard", version: int = 3, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Codes and unit centroids of one whole-vector codebook, without repeats and nulls, by code. Its size is checked."""
    rows = centroids.filter((F.col("quantizer") == quantizer) & (F.col("version") == version) & F.col("centroid").isNotNull() & F.col("code").isNotNull()).select("code", "centroid").distinct().orderBy("code", "centroid").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a codebook has at most {most} centroids")
    codes = np.array([r["code"] for r in rows], np.int64)
    return codes, _unit(np.array([r["centroid"] for r in rows], np.float64)) if rows else np.zeros((0, 0))


def _slabs(batches: Iterator[pa.RecordBatch], codes: int) -> Iterator[pa.RecordBatch]:
    """Batches whose products with all centroids stay within a few megabytes."""
    step = max(1, min(4000, 1_000_000 // max(1, codes)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def most_like(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and cosine of the centroid most similar to each unit vector, the first of equal ones."""
    s = x @ centroids.T
    near = s >= s.max(axis=1, keepdims=True) - 1e-9
    rows, columns = np.nonzero(near)
    # sums in a fixed order, which no block size changes
    exact = np.full(s.shape, -2.0)
    exact[rows, columns] = (x[rows] * centroids[columns]).sum(axis=1)
    best = exact.argmax(axis=1)
    return best, exact[np.arange(len(x)), best]


def named_clusters(sums: DataFrame, centroids: np.ndarray, dimension: int = 64) -> DataFrame:
    """(cluster, size, place, value, radius, mean): the centroid most similar to each cluster's mean, and the angle to the mean within
    which it is every member's: half of what the second nearest is further away, by the triangle inequality of angles."""
    cluster_type = sums.schema["cluster"].dataType.simpleString()
    shared = sums.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in _slabs(batches, len(c)):
            mean = _sums(batch["total"], dimension)
            mean /= np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-300)
            place, value = most_like(mean, c)
            s = mean @ c.T
            s[np.arange(len(s)), place] = -1
            second = s.max(axis=1) if s.shape[1] > 1 else np.full(len(s), -1.0)
            radius = (np.arccos(np.clip(second, -1, 1)) - np.arccos(np.clip(value, -1, 1))) / 2 - 1e-7
            yield pa.record_batch({"cluster": batch["cluster"], "size": batch["size"], "place": pa.array(place), "value": pa.array(value), "radius": pa.array(radius), "mean": _packed(mean)})

    return sums.mapInArrow(run, f"cluster {cluster_type}, size bigint, place bigint, value double, radius double, mean binary")


def clustered_codes(found: Clusters, codes: np.ndarray, centroids: np.ndarray, least: float = 0.5, dimension: int = 64) -> DataFrame:
    """(id, cluster, code, similarity, by_cluster): every clustered id with the code of the centroid most similar to its vector.

    A cluster is named once, by the centroid most similar to its mean. Members within the cluster's radius
    (``named_clusters``) have its code by membership; for the others the name is a nomination that an exact check
    against the codebook confirms or replaces (``by_cluster`` is false). Ties go to the lesser code; below ``least`` there is no row.
    """
    spark = found.classes.sparkSession
    id_type, class_type, cluster_type = found.members.schema["id"].dataType.simpleString(), *(found.classes.schema[c].dataType.simpleString() for c in ("class", "cluster"))
    if not len(codes):
        return spark.createDataFrame([], f"id {id_type}, cluster {cluster_type}, code bigint, similarity double, by_cluster boolean")
    shared = spark.sparkContext.broadcast((codes, centroids))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, c = shared.value
        for batch in _slabs(batches, len(c)):
            x = _unit(_matrix(batch["vector"], dimension))
            own = np.arccos(np.clip((x * _sums(batch["mean"], dimension)).sum(axis=1), -1, 1))
            place = batch["place"].to_numpy().copy()
            inside = own < batch["radius"].to_numpy()
            out = np.flatnonzero(~inside)
            value = (x * c[place]).sum(axis=1)
            if len(out):
                place[out], value[out] = most_like(x[out], c)
            keep = pa.array(np.flatnonzero(value >= least))
            yield pa.record_batch({"class": batch["class"].take(keep), "cluster": batch["cluster"].take(keep), "code": pa.array(codes[place]).take(keep), "similarity": pa.array(value).take(keep), "by_cluster": pa.array(inside).take(keep)})

    # fragments hold a bounded number of classes, so no key of this join is hot
    by_fragment = found.fragments.join(named_clusters(found.sums, centroids, dimension), "cluster").select("fragment", "place", "radius", "mean")
    named = found.classes.join(by_fragment, "fragment").select("class", "cluster", "vector", "place", "radius", "mean").mapInArrow(name, f"class {class_type}, cluster {cluster_type}, code bigint, similarity double, by_cluster boolean")
    return found.members.join(named, "class").select("id", "cluster", "code", "similarity", "by_cluster")


def described_clusters(found: Clusters, codes: np.ndarray, centroids: np.ndarray, typical: int = 3, least: float = 0.5, dimension: int = 64) -> DataFrame:
    """(cluster, size, code, rank, id, similarity): every cluster's size, the code of the centroid most similar to its
    mean (null below ``least``), and its ``typical`` ids most similar to the mean, ties by id."""
    spark = found.classes.sparkSession
    cluster_type, class_type = (found.classes.schema[c].dataType.simpleString() for c in ("cluster", "class"))
    # a codebook's size is checked when it is read
    table = F.broadcast(spark.createDataFrame(list(enumerate(codes.tolist())) or [(0, None)], "place bigint, code bigint"))
    named = named_clusters(found.sums, centroids if len(codes) else np.zeros((1, dimension)), dimension).join(table, "place").withColumn("code", F.when(F.col("value") >= least, F.col("code")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slabs(batches, 1):
            x = _unit(_matrix(batch["vector"], dimension))
            yield pa.record_batch({"class": batch["class"], "cluster": batch["cluster"], "size": batch["size"], "code": batch["code"], "similarity": pa.array((x * _sums(batch["mean"], dimension)).sum(axis=1))})

    by_fragment = found.fragments.join(named, "cluster").select("fragment", F.col("size").alias("n"), "code", "mean")
    rows = found.classes.join(by_fragment, "fragment").select("class", "cluster", "vector", F.col("n").alias("size"), "code", "mean").mapInArrow(compare, f"class {class_type}, cluster {cluster_type}, size bigint, code bigint, similarity double")
    order = Window.partitionBy("cluster").orderBy(F.desc("similarity"), "id")
    return found.members.join(rows, "class").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= typical).select("cluster", "size", "code", "rank", "id", "similarity")
