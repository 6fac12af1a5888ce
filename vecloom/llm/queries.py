"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import sql
from vecloom.llm.annforest import most_similar, similar_pairs
from vecloom.llm.chunking import oversized, split_items
from vecloom.llm.linkage import clustered_codes, codebook, described_clusters, similarity_clusters
from vecloom.llm.markup import clean_texts, markup_kinds
from vecloom.llm.mixing import mix_sources
from vecloom.llm.neardup import Similarity, near_duplicate_groups, near_duplicate_pairs
from vecloom.llm.packing import pack, packing_report
from vecloom.llm.repetition import repetition, repetitive_documents
from vecloom.sources import table


#: What TESTDATA.md counts as a changed copy of an item.
ITEM_COPY = Similarity(shingle=3, least=0.6, least_words=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "store_items"), "id", "content.data", ITEM_COPY)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "store_items"), "id", "content.data", ITEM_COPY)


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "store_items"))


def p2_most_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar items of every item, whatever their similarity."""
    return most_similar(table(spark, sf_dir, "store_items")).select("id", "neighbour", F.col("rank").cast("bigint").alias("rank"), (F.round("similarity", 6) + 0.0).alias("similarity"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_kinds(table(spark, sf_dir, "store_items"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's clean text, and the kinds of markup it held as a comma-separated list."""
    clean = clean_texts(table(spark, sf_dir, "store_items"))
    return clean.select("id", F.array_join("kinds", ",").alias("kinds"), "text")


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is no prose is kept as it is, letter for letter."""
    clean = clean_texts(table(spark, sf_dir, "store_items"))
    kinds = table(spark, sf_dir, "store_items").select("id", F.col("content.type").alias("type"))
    return clean.join(kinds.filter(F.col("type").isin("code", "json")), "id").select("id", F.size("kinds").cast("bigint").alias("kinds"), F.coalesce("text", F.lit("")).alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_clusters(table(spark, sf_dir, "store_items"))
    return clustered_codes(found, *codebook(table(spark, sf_dir, "centroids"))).select("id", "code")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described_clusters(similarity_clusters(table(spark, sf_dir, "store_items")), *codebook(table(spark, sf_dir, "centroids")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "store_items"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "store_items"))


def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every item larger than the limit: its bytes, counted from its pieces without their overlaps, and whether all of them fit."""
    pieces = split_items(table(spark, sf_dir, "store_items")).withColumn("bytes", F.octet_length("text").cast("bigint"))
    own = pieces.groupBy("id").agg(F.sum(F.col("end") - F.col("fresh")).alias("bytes"), (F.max("bytes") <= 4096).alias("fits"), (F.sum("bytes") == F.sum(F.col("end") - F.col("start"))).alias("whole"))
    return own.filter(F.col("bytes") > 4096)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_pack(spark, sf_dir))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is placed once and whole, in bins that hold no more than they can."""
    rows = p7_pack(spark, sf_dir)
    bins = rows.groupBy("bin").agg((F.sum("tokens") <= F.min("capacity")).alias("within"))
    own = rows.join(bins, "bin").groupBy("doc_id").agg((F.count("*") == F.max("parts")).alias("whole"), (F.countDistinct("part") == F.max("parts")).alias("once"), F.bool_and("within").alias("within"), F.bool_and((F.col("parts") == 1) | (F.col("part") == F.col("parts") - 1) | (F.col("tokens") == F.col("capacity"))).alias("undivided"))
    return own.select("doc_id", "whole", "once", "within", "undivided")


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether 98 % of the capacity used is filled."""
    return p7_report(spark, sf_dir).agg((F.sum("tokens") >= 0.98 * F.sum(F.col("bins") * F.col("capacity"))).alias("filled"))


#: A curriculum for sources of these tables: conversation early, dense text late. Weights at the start and the end of training.
CURRICULUM = {"chatlog": (1.6, 0.4), "forum": (1.4, 0.6), "codenote": (0.7, 1.3), "mathnote": (0.4, 1.6), "paper": (0.2, 1.8)}


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = spark.createDataFrame([(s, t, w) for s, ends in CURRICULUM.items() for t, w in zip((0.0, 1.0), ends, strict=True)], "source string, time double, weight double")
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), points)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target: whether its source is repeated no more than allowed, and reaches its share to within the largest document."""
    limits = table(spark, sf_dir, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    mix, reached = _mixed(spark, sf_dir)
    whole = mix.agg(F.max("tokens").alias("largest"), F.sum("tokens").alias("all")).first()
    off = F.abs(F.col("share") - F.col("target")) * F.lit(float(whole["all"] or 0))
    return limits.join(reached, "source").select("source", (F.col("passes") <= F.col("max_repeats")).alias("repeats"), (off <= F.lit(float(whole["largest"] or 0))).alias("reached"))


def p9_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that SQL can count."""
    found = p9_repetition(spark, sf_dir)
    return found.select("doc_id", "n_words", "covered_words", (F.round("share", 6) + 0.0).alias("share"), "repeated_runs")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p1_documents": p1_documents,
    "p2_found": p2_found,
    "p2_most_similar": p2_most_similar,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p3_kept": p3_kept,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_cover": p6_cover,
    "p7_pack": p7_pack,
    "p7_report": p7_report,
    "p7_placed": p7_placed,
    "p7_filled": p7_filled,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_kept": p8_kept,
    "p9_found": p9_found,
    "p9_repetition": p9_repetition,
    "p9_figures": p9_figures,
}

ORACLE = sql.ORACLE
