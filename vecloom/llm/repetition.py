"""Repetition inside single documents, found with suffix arrays over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.runtime import slices

#: Maximal runs of Unicode letters and digits (``\w`` of this engine is both and the underscore).
_RUN = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits (Unicode L and N) of the lower-cased text."""
    return _RUN.findall(text.lower())


@dataclass(frozen=True)
class Repetition:
    """Per-document figures, one entry a document."""

    n_words: np.ndarray
    covered: np.ndarray
    longest: np.ndarray
    repeats: np.ndarray


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of an integer sequence by prefix doubling, with the ranks of every round.

    ``levels[r][i]`` ranks the ``2**r`` symbols from ``i``; equal ranks are equal substrings. Suffixes
    that are already unique keep their rank, so a round costs only what is still undecided.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    # half as wide as Python's integers: the ranks of all rounds are kept
    kind = np.int32 if n < 1 << 31 else np.int64
    rank = np.empty(n, kind)
    # a rank is the place of its group's first member, so refining a group moves nobody else
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = starts
    levels = [rank]
    width = 1
    while True:
        size = np.diff(np.r_[np.flatnonzero(first), n])
        open_places = np.repeat(size > 1, size)
        if not open_places.any():
            return order, levels
        places = np.flatnonzero(open_places)
        at = order[places]
        after = at + width
        second = np.where(after < n, levels[-1][np.minimum(after, n - 1)] + kind(1), kind(0))
        group = levels[-1][at]
        sub = np.lexsort((second, group))
        at, second, group = at[sub], second[sub], group[sub]
        order[places] = at
        new_first = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        first = first.copy()
        first[places] = new_first
        rank = levels[-1].copy()
        place_starts = np.maximum.accumulate(np.where(new_first, places, 0))
        rank[at] = place_starts
        levels.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the array (0 for the first)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for r in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = levels[r][a[inside]] == levels[r][b[inside]]
        step = same * (1 << r)
        a += step
        b += step
        got += step
    lcp[1:] = got
    return lcp


def measure(texts: list[str | None], run: int = 6) -> Repetition:
    """Repetition of each text: words covered by runs of ``run`` words that also start earlier.

    One suffix array serves all texts of the call: the document is part of every symbol, so no match
    leaves its document. Maximal intervals of the array with a common prefix of ``run`` words or more are
    the repeated substrings; in each, all places but the first are repeats, and their spans are united.
    """
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            found = words(text)
            lengths[i] = len(found)
            ids.extend([vocabulary.setdefault(w, len(vocabulary)) for w in found])
    total = int(lengths.sum())
    none = np.zeros(len(texts), np.int64)
    if not total:
        return Repetition(lengths, none, none.copy(), none.copy())
    document = np.repeat(np.arange(len(texts)), lengths)
    keys = document * (len(vocabulary) + 1) + np.array(ids, np.int64)
    # no word of a document starts with the next document's symbols: keys differ, so suffixes part there
    order, levels = suffix_array(keys)
    lcp = common_prefixes(order, levels)
    interval = np.cumsum(lcp < run)
    least = np.full(int(interval[-1]) + 1, total, np.int64)
    np.minimum.at(least, interval, order)
    later = order > least[interval]
    starts = np.zeros(total + 1, np.int64)
    begun = order[later]
    starts[begun] += 1
    starts[np.minimum(begun + run, total)] -= 1
    covered = np.cumsum(starts)[:total] > 0
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, document[order], lcp)
    return Repetition(lengths, np.bincount(document, covered, len(texts)).astype(np.int64), longest, np.bincount(document[begun], minlength=len(texts)))


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 6) -> DataFrame:
    """Share of repeated content of every document.

    Columns: the id, ``n_words``, ``covered_words``, ``share`` (covered over all words, 0 without words),
    ``longest_repeat`` (words of the longest substring that occurs twice; the two may overlap) and
    ``repeated_runs`` (places where a run of ``run`` words starts that also starts earlier).

    Rows are independent: nothing is shuffled, and every row in gives one row out, repeated ids too. Null
    and empty texts, and texts without words, have all figures 0. Texts are read whole; a task holds a
    few megabytes of text at a time, or one longer text. Other columns are not read, whatever their names.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch["text"], 1_000_000):
                part = batch.slice(start, stop - start)
                found = measure(part["text"].to_pylist(), run)
                yield pa.record_batch({"id": part["id"], "n_words": pa.array(found.n_words), "covered_words": pa.array(found.covered), "share": pa.array(found.covered / np.maximum(found.n_words, 1)), "longest_repeat": pa.array(found.longest), "repeated_runs": pa.array(found.repeats)})

    return (
        df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run_batches, f"id {kind}, n_words bigint, covered_words bigint, share double, longest_repeat bigint, repeated_runs bigint")
        .withColumnRenamed("id", id_col)
    )


def repetitive_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 6, least_words: int = 30, least_share: float = 0.3, most_repeat: int | None = None) -> DataFrame:
    """Documents of at least ``least_words`` words of which at least ``least_share`` are covered (see ``repetition``), or,
    where ``most_repeat`` is given, whose longest repeat has more words than that."""
    over = F.col("covered_words") >= F.lit(least_share) * F.col("n_words")
    if most_repeat is not None:
        over |= F.col("longest_repeat") > most_repeat
    return repetition(df, id_col, text_col, run).filter((F.col("n_words") >= least_words) & over)
