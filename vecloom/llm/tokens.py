"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.runtime import slices

#: Rank file of a byte-level BPE vocabulary, unless the session names one that all executors can read in ``SETTING``.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "spark.vecloom.tokenizer"
#: Fixed value: the public pattern that splits text before the merges of such files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vecloom", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def rank_file(spark: SparkSession, ranks: str | None) -> str:
    return ranks or spark.conf.get(SETTING, RANKS)


def count_tokens(texts: list[str | None], ranks: str = RANKS) -> np.ndarray:
    encode = encoder(ranks).encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts], np.int64)


def token_sizes(df: DataFrame, id_col: str, text_col: str, *also: str, ranks: str | None = None) -> DataFrame:
    """(id, tokens, also...): the size of every text; null and empty texts have 0. Nothing is shuffled."""
    ranks = rank_file(df.sparkSession, ranks)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *also)
    schema = ", ".join([f"id {source.schema['id'].dataType.simpleString()}, tokens bigint", *[f"{c} {source.schema[c].dataType.simpleString()}" for c in also]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(batch["text"].slice(a, b - a).to_pylist(), ranks) for a, b in slices(batch["text"])]
            yield pa.record_batch({"id": batch["id"], "tokens": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), **{c: batch[c] for c in also}})

    return source.mapInArrow(run, schema)
