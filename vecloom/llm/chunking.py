"""Splitting oversized items at natural boundaries, by content-defined landmarks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.runtime import slices

#: Where a piece of each content type would best end, as byte patterns; the end of a match is the boundary.
#: In order of preference: the first pattern with a boundary in reach decides. Other types are text.
_TEXT = (rb"\n[ \t\r]*\n\s*", rb"[.!?][\"')\]]*[ \t\r\n]+|\n")
PREFERRED = {
    "text": _TEXT,
    "markdown": (rb"\n(?=#{1,6} )|\n[ \t\r]*\n\s*", rb"\n", rb"[.!?][\"')\]]*[ \t\r\n]+"),
    "code": (rb"\n[ \t\r]*\n(?=\S)|\n(?=\S)", rb"\n"),
    "json": (rb"[,{\[][ \t\r\n]+(?=[\"{\[])", rb"[,\]}][ \t\r\n]+"),
    "math": (rb"\n[ \t\r]*\n\s*", rb"\n"),
}
_COMPILED = {kind: [re.compile(p) for p in patterns] for kind, patterns in PREFERRED.items()}

#: Mixing values of the rolling hash, one a byte, made by a multiplicative rule.
_MIX = np.array([((b + 1) * 0x9E3779B97F4A7C15 ^ (((b + 1) * 0xC2B2AE3D27D4EB4F) >> 29)) % 2**64 for b in range(256)], dtype=np.uint64)
_WINDOW_DOUBLINGS = 6


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes of UTF-8: a piece has at most ``most``; ``least`` of new content where possible; ``spacing``
    (a power of two) is the mean distance of landmarks; ``overlap`` repeats the end of the piece before."""

    most: int = 4096
    least: int = 1024
    spacing: int = 1024
    overlap: int = 256

    def __post_init__(self) -> None:
        if not (0 < self.least < self.most and 0 <= self.overlap < self.most - self.least and self.spacing > 0 and self.spacing & (self.spacing - 1) == 0 and self.most >= 8):
            raise ValueError(f"impossible limits: {self}")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes that end at each place; depends on nothing further away."""
    h = _MIX[data]
    for k in range(_WINDOW_DOUBLINGS):
        width = np.uint64(1 << k)
        ahead = h.copy()
        ahead[int(width) :] += h[: -int(width)] << width if int(width) < len(h) else 0
        h = ahead
    return h


@dataclass(frozen=True)
class Piece:
    start: int
    fresh: int
    end: int
    cut: str


def split(data: bytes, kind: str | None, limits: Limits = Limits()) -> list[Piece]:
    """Cut UTF-8 bytes into pieces of at most ``limits.most`` bytes.

    A piece ends near the first landmark (a place whose rolling hash has its low bits zero) after the least
    size: at the nearest boundary its type prefers, else at the nearest white space, both no further than the
    greatest size (``natural``); only where a run without white space fills all of that, at a character
    (``forced``). The last piece ends with the item (``end``). The next piece starts with ``overlap`` bytes of
    the one before, cut at white space, and with fewer where a long run needs the room.
    """
    n = len(data)
    if n <= limits.most:
        return [Piece(0, 0, n, "end")]
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | (raw == 9) | (raw == 10) | (raw == 13)
    natural = np.flatnonzero(blank[1:] | blank[:-1]) + 1
    landmarks = np.flatnonzero((rolling_hash(raw) >> np.uint64(64 - (limits.spacing - 1).bit_length())) == 0) + 1
    preferred = [np.array([m.end() for m in p.finditer(data) if 0 < m.end() < n], np.int64) for p in _COMPILED.get((kind or "").strip().lower(), _COMPILED["text"])]

    def character(place: int) -> int:
        while place > 0 and place < n and raw[place] & 0xC0 == 0x80:
            place -= 1
        return place

    def nearest(places: np.ndarray, low: int, high: int, to: int) -> int | None:
        a, b = np.searchsorted(places, low), np.searchsorted(places, high, side="right")
        if a == b:
            return None
        i = np.searchsorted(places[a:b], to) + a
        options = places[max(a, i - 1) : min(b, i + 1)]
        return int(options[np.abs(options - to).argmin()])

    pieces: list[Piece] = []
    start = fresh = 0
    while n - start > limits.most:
        low, high = fresh + limits.least, start + limits.most
        i = np.searchsorted(landmarks, low)
        to = int(landmarks[i]) if i < len(landmarks) and landmarks[i] <= high else high
        cut = next((c for p in [*preferred, natural] if (c := nearest(p, low, high, to)) is not None), None)
        if cut is None:
            cut = nearest(natural, fresh + 1, high, high)
        how = "natural" if cut is not None else "forced"
        if cut is None:
            cut = character(high)
        pieces.append(Piece(start, fresh, cut, how))
        fresh = cut
        i = np.searchsorted(natural, fresh, side="right")
        run_end = int(natural[i]) if i < len(natural) else n
        back = max(cut - limits.overlap, pieces[-1].start + 1)
        if run_end - cut <= limits.most:
            back = max(back, run_end - limits.most)
        i = np.searchsorted(natural, back)
        begin = int(natural[i]) if i < len(natural) and natural[i] <= cut else cut
        start = begin if limits.overlap else cut
    pieces.append(Piece(start, fresh, n, "end"))
    return pieces


def split_items(df: DataFrame, id_col: str = "id", data_col: str = "content.data", type_col: str = "content.type", limits: Limits = Limits(), texts: bool = True) -> DataFrame:
    """Pieces of every item: (id, piece, start, fresh, end, cut, item_bytes, forced[, text]).

    ``piece`` counts from 0; ``start`` to ``end`` are the piece's bytes in the item, of which those before
    ``fresh`` repeat the piece before; ``cut`` is how the piece ends (``natural``, ``forced``, ``end``) and
    ``forced`` whether any piece of the item ends so. An item within the limit is one piece, and so is an empty
    or null one (its text as it was, 0 bytes). Rows are independent, so nothing is shuffled; repeated rows
    give repeated pieces. Items are read whole. Other columns are not read, whatever their names.
    """
    kind = df.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, fresh bigint, end bigint, cut string, item_bytes bigint, forced boolean" + ", text string" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["data"]):
                part = batch.slice(a, b - a)
                rows: list[int] = []
                out: list[tuple] = []
                for i, (text, what) in enumerate(zip(part["data"].to_pylist(), part["type"].to_pylist(), strict=True)):
                    data = (text or "").encode()
                    pieces = split(data, what, limits)
                    forced = any(p.cut == "forced" for p in pieces)
                    rows.extend([i] * len(pieces))
                    out.extend((k, p.start, p.fresh, p.end, p.cut, len(data), forced, (text if text is None or len(pieces) == 1 else data[p.start : p.end].decode()) if texts else None) for k, p in enumerate(pieces))
                columns = list(zip(*out, strict=True))
                names = ["piece", "start", "fresh", "end", "cut", "item_bytes", "forced", *["text"] * texts]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * texts]
                yield pa.record_batch({"id": part["id"].take(pa.array(rows)), **{name: pa.array(column, t) for name, column, t in zip(names, columns, types, strict=False)}})

    source = df.select(F.col(id_col).alias("id"), F.col(data_col).cast("string").alias("data"), F.col(type_col).cast("string").alias("type"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col.split(".")[-1])


def oversized(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(id, cut) of the items above the limit: ``forced`` if a piece had to end inside a run without white space."""
    pieces = split_items(df, limits=limits, texts=False)
    return pieces.filter((F.col("piece") == 0) & (F.col("item_bytes") > limits.most)).select("id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))
