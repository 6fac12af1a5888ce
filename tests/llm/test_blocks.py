"""Neighbours that share a prefix with too many others for the forest."""

from __future__ import annotations

import numpy as np

from tests.conftest import rows
from tests.llm.test_llm import frame
from vecloom.llm import annforest


def exact(x, k=5):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_neighbours_beyond_the_reach_are_found(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((3, 64))[rng.integers(0, 3, 1500)] + 0.6 * rng.standard_normal((1500, 64))).astype(np.float32)
    _, near = exact(x)
    got = annforest.most_similar(frame(spark, x), k=5, forest=annforest.Forest(trees=(1,), most=4, sample=50)).select("id", "rank", "neighbour")
    assert rows(got) == sorted(((f"i{i:04}", r + 1, f"i{j:04}") for i, n in enumerate(near) for r, j in enumerate(n)), key=repr)


def test_a_group_of_near_copies_larger_than_the_reach(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal(64)
    x = np.concatenate([one + 0.2 * rng.standard_normal((900, 64)), rng.standard_normal((300, 64))]).astype(np.float32)
    # scaled copies are equally similar, and ties go to the lesser id
    x[500:600] = x[500] * 2.0 ** np.arange(-50, 50)[:, None]
    s, near = exact(x)
    pairs = {(f"i{min(i, j):04}", f"i{max(i, j):04}") for i, n in enumerate(near) for j in n if s[i, j] >= 0.93}
    assert rows(annforest.similar_pairs(frame(spark, x), forest=annforest.Forest(trees=(1,), most=4, sample=50))) == sorted(pairs, key=repr)
