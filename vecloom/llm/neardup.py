"""Near-duplicate records: an exact set-similarity join on word shingles that never compares all pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.repetition import words
from vecloom.runtime import components, dense_summary, shuffle_partitions, slices, stage


@dataclass(frozen=True)
class Similarity:
    """What counts as near-duplicate: Jaccard similarity ``least`` or more of the sets of runs of ``shingle`` words.

    Texts under ``least_words`` words belong to no pair.
    """

    shingle: int = 5
    least: float = 0.8
    least_words: int = 5

    def overlap(self, n: Column, m: Column) -> Column:
        """Least common shingles of sets of n and m shingles that are similar enough."""
        return F.ceil(F.lit(self.least / (1 + self.least)) * (n + m) - 1e-9)


#: Cells of the frequency table that orders shingles, and its levels a doubling of the frequency.
ORDER_CELLS = 1 << 20
_LEVELS = 8
#: Classes whose tokens one task has already emitted are remembered up to this many, to combine copies early. It only changes the work.
_REMEMBERED = 200_000
#: Cells of the filter of sets that are asked for.
FILTER_CELLS = 1 << 20
#: Bytes of a token in a shuffle, and of the tokens of one partition.
_TOKEN, _PARTITION = 22, 6_000_000

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P1
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, size: int, least_words: int) -> None:
        self.size, self.least_words, self.known = size, max(least_words, size), _Hashes()

    def __call__(self, text: str | None) -> np.ndarray | None:
        found = words(text or "")
        if len(found) < self.least_words:
            return None
        if len(self.known) > 500_000:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        n = len(found) - self.size + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.size):
            h = _mixed(h * _P1 + hashes[k : k + n])
        return np.unique(h)


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap: bit b is the parity of the number of shingles that hash to it.

    Two bitmaps differ in at most as many bits as the sets have uncommon members, and halves of a bitmap
    XOR to the bitmap of half the width, so sets of different size bands compare at the smaller width.
    """
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.uint64)


def band_bits(n: int) -> int:
    """Bitmap width of the size band of a set: the power of two from twice its size on, 64 at least."""
    return max(64, 1 << int(2 * n - 1).bit_length())


def overlap_bound(a: np.ndarray, n: int, b: np.ndarray, m: int) -> int:
    """Most common members that the bitmaps of two sets of n and m members allow."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (n + m - int(np.bitwise_count(a ^ b).sum())) // 2


def overlap_bounds(a: list[bytes], n: np.ndarray, b: list[bytes], m: np.ndarray) -> np.ndarray:
    """``overlap_bound`` of many pairs, those of the same two widths together."""
    out = np.zeros(len(a), np.int64)
    widths = np.array([len(x) for x in a]) * (1 << 32) + np.array([len(x) for x in b])
    for w in np.unique(widths) if len(a) else ():
        at = np.flatnonzero(widths == w)
        x, y = (np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1) for side in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = (n[at] + m[at] - np.bitwise_count(x ^ y).sum(axis=1)) // 2
    return out


def largest_similar(n: np.ndarray | int, least: float) -> np.ndarray | int:
    """Size of the largest set that can be similar to one of n members."""
    return np.floor(np.asarray(n) / least + 1e-6).astype(np.int64)


def size_bands(least: float, largest: int = 1 << 31, width: int = 3) -> np.ndarray:
    """First size of each band: sets of similarity ``least`` or more are in the same or in neighbouring bands. A band is ``width``
    times as wide as that asks for, so that only the largest sets of a band can have similar ones in the next."""
    edges = [1, 2]
    while edges[-1] <= largest:
        last = edges[-1] - 1
        for _ in range(width):
            last = int(largest_similar(last, least))
        edges.append(max(edges[-1] + 1, last + 1))
    return np.array(edges, np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


@dataclass(frozen=True)
class NearDuplicates:
    """What a near-duplicate join found.

    ``members``: (id, class), a class being all rows with the same set of shingles; ``pairs``: (class_a,
    class_b, similarity) of different similar classes, each pair once.
    """

    members: DataFrame
    pairs: DataFrame


def near_duplicates(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> NearDuplicates:
    """Exact join of all pairs of similar texts, as pairs of classes of equal sets.

    1. Texts are read once, into sorted sets of hashed shingles with their bitmaps.
    2. A frequency table of fixed size counts the shingles of all sets; it only orders them, rare first.
    3. Every class sends its rarest shingles (all but so many that a similar set must meet one) to tiles of its size band,
       and, if the next band can hold similar sets, fewer of them, which is enough to meet larger sets, to tiles of that
       band: a tile is a band and a shingle. A meeting passes if sizes, places in the order and the bit counts of 64-bit signatures allow enough in
       common. Copies are combined within each task before the shuffle; hot tiles are split by the adaptive join.
    4. Bitmaps as wide as the size band, a few bits a shingle, bound each meeting's overlap from above.
    5. Only sets of classes that pass move again; intersecting the sorted arrays decides.

    No pair is lost: every bound holds for any order and any hash (two of a text's shingles, or two sets, meeting in 64
    bits aside). Null, empty and short texts are in no class. Repeated rows and repeated texts share a class.
    An id may occur several times; then the id stands for all its rows. An empty table gives empty results.
    Other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    least, size, least_words = how.least, how.shingle, how.least_words

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size, least_words)
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                found = [shingler(t) for t in part["text"].to_pylist()]
                keep = [i for i, s in enumerate(found) if s is not None]
                some = [found[i] for i in keep]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in some]
                columns = {"id": part["id"].take(pa.array(keep, pa.int64())), "class": pa.array(digests, pa.binary()), "key": pa.array(np.frombuffer(b"".join(d[:8] for d in digests), np.int64)), "n": pa.array([len(s) for s in some], pa.int32())}
                columns |= {"signature": pa.array(np.array([bitmap(s, 64)[0] for s in some], np.uint64).view(np.int64)), "bitmap": pa.array([bitmap(s, band_bits(len(s))).tobytes() for s in some], pa.binary()), "shingles": pa.array([s.tobytes() for s in some], pa.binary())}
                yield pa.record_batch(columns)

    sets = stage(source.mapInArrow(describe, f"id {id_type}, class binary, key bigint, n int, signature bigint, bitmap binary, shingles binary"), "sets")
    members = sets.select("id", "class")

    def flat(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64)

    def count(batches: Iterable[pa.RecordBatch], cells: np.ndarray) -> None:
        for batch in batches:
            for a, b in slices(batch["shingles"], 16_000_000):
                cells += np.bincount((flat(batch["shingles"].slice(a, b - a)) & np.uint64(ORDER_CELLS - 1)).astype(np.int64), minlength=ORDER_CELLS)

    frequency = dense_summary(sets.select("shingles"), count, ORDER_CELLS)
    order = spark.sparkContext.broadcast(np.minimum(255, np.log2(frequency + 1.0) * _LEVELS).astype(np.uint8))
    edges = size_bands(least)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        seen: set[bytes] = set()
        for whole in batches:
            for a, b in slices(whole["shingles"], 4_000_000):
                part = whole.slice(a, b - a)
                fresh = []
                for i, digest in enumerate(part["class"].to_pylist()):
                    if digest not in seen:
                        fresh.append(i)
                        if len(seen) < _REMEMBERED:
                            seen.add(digest)
                part = part.take(pa.array(fresh, pa.int64()))
                n = part["n"].to_numpy().astype(np.int64)
                s = flat(part["shingles"])
                row = np.repeat(np.arange(len(n)), n)
                # shingles are sorted within a row, so a stable sort by level leaves ties in one order everywhere
                rare = np.argsort(row * 256 + level[(s & np.uint64(ORDER_CELLS - 1)).astype(np.int64)], kind="stable")
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                home = place < (n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)[row]
                band = np.searchsorted(edges, n, side="right") - 1
                reaches = largest_similar(n, least) >= edges[band + 1]
                guest = reaches[row] & (place < (n - np.ceil(2 * least / (1 + least) * n - 1e-9).astype(np.int64) + 1)[row])
                for of_guest, chosen in ((0, home), (1, guest)):
                    at = row[chosen]
                    tile = _mixed(s[rare[chosen]] + (band[at] + of_guest).astype(np.uint64) * _P1)
                    take = pa.array(at)
                    # size, place and role in one number: a row of the shuffle is as short as can be
                    packed = n[at] << 32 | place[chosen] << 1 | of_guest
                    yield pa.record_batch({"tile": pa.array(tile.view(np.int64)), "key": part["key"].take(take), "packed": pa.array(packed), "signature": part["signature"].take(take)})

    entry = sets.select("class", "key", "n", "signature", "shingles").mapInArrow(tokens, "tile bigint, key bigint, packed bigint, signature bigint")
    # unpacked above the exchange that both sides read
    unpack = lambda x: entry.hint("merge").alias(x)
    a, b = unpack("a"), unpack("b")
    n_of, place_of, guest_of = (lambda x, e=e: F.expr(e.format(x=x)).cast("int") for e in ("shiftright({x}.packed, 32)", "shiftright({x}.packed, 1) & 2147483647", "{x}.packed & 1"))
    need = how.overlap(n_of("a"), n_of("b"))
    meets = (
        (F.col("a.tile") == F.col("b.tile"))
        # one of the two is at home; said of both sides together, so that both read one exchange
        & (guest_of("a") + 2 * guest_of("b") < 2)
        & ((guest_of("a") + guest_of("b") == 1) | (F.col("a.key") < F.col("b.key")))
        & (F.least(n_of("a"), n_of("b")) >= F.ceil(F.lit(least) * F.greatest(n_of("a"), n_of("b")) - 1e-9))
        & (F.least(n_of("a") - place_of("a"), n_of("b") - place_of("b")) >= need)
        & (F.floor((n_of("a") + n_of("b") - F.bit_count(F.col("a.signature").bitwiseXOR(F.col("b.signature")))) / 2) >= need)
    )
    rows = int(frequency.sum()) * (1 - least) * (1 + 1 / (1 + least) / 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # as many partitions as the tokens fill, so that the largest task doesn't grow with the table
    spark.conf.set("spark.sql.shuffle.partitions", max(shuffle_partitions(spark), int(rows * _TOKEN / _PARTITION)))
    try:
        met = stage(a.join(b, meets).select(F.least("a.key", "b.key").alias("key_a"), F.greatest("a.key", "b.key").alias("key_b")).distinct(), "met")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                n, m = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
                most = overlap_bounds(batch["bitmap_a"].to_pylist(), n, batch["bitmap_b"].to_pylist(), m)
                keep = np.flatnonzero(most >= np.ceil(least / (1 + least) * (n.astype(np.float64) + m) - 1e-9))
                yield batch.select(["class_a", "class_b", "key_a", "key_b"]).take(pa.array(keep))

    # a bitmap takes a few bits a shingle, an array 64: what the bit counts rule out never moves as arrays
    signed = sets.select("class", "key", "n", "bitmap").dropDuplicates(["class"])
    side = lambda x: signed.select(*[F.col(c).alias(f"{c}_{x}") for c in ("class", "key", "n", "bitmap")])
    possible = stage(met.join(side("a"), "key_a").join(side("b"), "key_b").select("class_a", "class_b", "key_a", "key_b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(bounded, "class_a binary, class_b binary, key_a bigint, key_b bigint"), "possible")

    def mark(batches: Iterable[pa.RecordBatch], cells: np.ndarray) -> None:
        for batch in batches:
            for side in ("key_a", "key_b"):
                cells[batch[side].to_numpy() & (FILTER_CELLS - 1)] = 1

    # a filter of fixed size keeps most of the sets that nobody asks for out of the shuffle; the join decides
    asked = spark.sparkContext.broadcast(np.packbits(dense_summary(possible.select("key_a", "key_b"), mark, FILTER_CELLS) > 0, bitorder="little"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch["key"].to_numpy() & (FILTER_CELLS - 1)
            yield batch.select(["class", "shingles"]).take(pa.array(np.flatnonzero(asked.value[cell >> 3] >> (cell & 7) & 1)))

    wanted = possible.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    known = stage(sets.select("key", "class", "shingles").mapInArrow(likely, "class binary, shingles binary").join(wanted, "class", "left_semi").dropDuplicates(["class"]), "arrays")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, similarity = [], []
            for i, (left, right) in enumerate(zip(batch["shingles_a"], batch["shingles_b"], strict=True)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = common(x, y)
                if both >= least * (len(x) + len(y) - both) - 1e-9:
                    keep.append(i)
                    similarity.append(both / (len(x) + len(y) - both))
            at = pa.array(keep, pa.int64())
            yield pa.record_batch({"class_a": batch["class_a"].take(at), "class_b": batch["class_b"].take(at), "similarity": pa.array(similarity, pa.float64())})

    both = possible.join(known.select(F.col("class").alias("class_a"), F.col("shingles").alias("shingles_a")), "class_a").join(known.select(F.col("class").alias("class_b"), F.col("shingles").alias("shingles_b")), "class_b")
    pairs = stage(both.select("class_a", "class_b", "shingles_a", "shingles_b").mapInArrow(verify, "class_a binary, class_b binary, similarity double"), "pairs")
    return NearDuplicates(members, pairs)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids with similar texts, copies included (see ``near_duplicates``).

    The result is as long as the true pairs are many; ``near_duplicate_groups`` stays as long as the input.
    """
    found = near_duplicates(df, id_col, text_col, how)
    members = found.members.distinct()
    of = lambda x: members.select(F.col("class").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"))
    across = found.pairs.join(of("a"), "class_a").join(of("b"), "class_b").select("id_a", "id_b")
    copied = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class").alias("class_a"))
    within = of("a").join(copied, "class_a", "left_semi").join(of("b"), F.col("class_a") == F.col("class_b")).filter("id_a < id_b").select("id_a", "id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).filter("id_a < id_b").unionByName(within).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, how: Similarity = Similarity()) -> DataFrame:
    """One row for each id with a class: (id, class_id, copies, links, group_id).

    ``class_id`` is the least id with the same shingles and ``copies`` their number, ``links`` the number of
    similar other classes, ``group_id`` the least id that is reached over links (the row's own where there is
    none). Nothing is expanded into pairs within a class or group.
    """
    found = near_duplicates(df, id_col, text_col, how)
    members = found.members.distinct()
    named = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    ends = found.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    name = lambda x: named.select(F.col("class").alias(f"class_{x}"), F.col("class_id").alias(x))
    groups = components(found.pairs.join(name("a"), "class_a").join(name("b"), "class_b").select("a", "b"))
    classes = named.join(ends, "class", "left").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    return members.join(classes, "class").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class_id").alias("group_id"))
