"""One text, vector or source that holds most rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_llm import VECTOR, containers, documents, items, targets
from vecloom.llm import annforest, linkage, mixing, neardup, packing

N = 3000


def test_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = items(spark, [(f"c{i:05}", text) for i in range(N)] + [("x", text.replace("w49", "y")), ("z", " ".join(f"z{i}" for i in range(50)))])
    got = neardup.near_duplicate_groups(df, "id", "content.data")
    assert got.filter("class_id = 'c00000' and copies = 3000 and links = 1 and group_id = 'c00000'").count() == N
    found = neardup.near_duplicates(df, "id", "content.data")
    assert found.pairs.count() == 1 and found.members.count() == N + 2


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(5)
    one = [float(v) for v in rng.standard_normal(64)]
    near = [v + 0.01 for v in one]
    data = [(f"v{i:05}", one, "c", 0) for i in range(N)] + [("near", near, "c", 0)] + [(f"o{i}", [float(v) for v in rng.standard_normal(64)], "c", 0) for i in range(20)]
    df = spark.createDataFrame(data, VECTOR)
    found = annforest.most_similar(df, k=5)
    assert found.filter("id like 'v%'").count() == 5 * N
    assert found.filter("id = 'near'").orderBy("rank").first()["neighbour"] == "v00000"
    assert found.filter("id like 'v%' and neighbour > 'v00005'").count() == 0
    clusters = linkage.similarity_clusters(df)
    assert clusters.classes.groupBy("cluster").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] >= N + 1
    assert clusters.members.count() == N + 21


def test_one_source_and_equal_texts(spark):
    df = documents(spark, [("same text again", "big")] * N + [(f"rare words {i}", "small") for i in range(60)])
    mix, shares = mixing.mix_sources(df, targets(spark, ("big", 3.0, 1), ("small", 1.0, 4)), how=mixing.Mix(bucket=100))
    share = {r["source"]: r["share"] for r in shares.collect()}
    assert abs(share["big"] - 0.75) < 0.01 and mix.count() > 60
    packed = packing.pack(df, containers(spark, 64))
    assert packed.count() == N + 60 and packed.agg(F.max("used")).first()[0] <= 64
