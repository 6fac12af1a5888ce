"""Searches that must find most of the exact neighbours."""

from __future__ import annotations

from vecloom.operators import search
from vecloom.operators.knn import knn
from vecloom.plans import vectors

SF = "/root/testdata/sf0.001"


def test_searches_reach_their_recall(spark):
    exact = knn(vectors._all(spark, SF), vectors._asked(spark, SF), vectors.K, "l2sq", **vectors.PAIR).cache()
    for name in ("ivf_search", "ivf_nprobe_search", "ivf_stored_search", "lsh_search", "lsh_rerank", "mplsh_search", "optimistic_search", "adaptive_search", "hybrid_search"):
        got = search.recall(vectors.QUERIES[name](spark, SF), exact).agg({"recall": "avg"}).first()[0]
        assert got >= 0.9, (name, got)
