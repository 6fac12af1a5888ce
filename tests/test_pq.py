"""A trained product quantizer against k-means by hand."""

from __future__ import annotations

import numpy as np

from vecloom.operators import quantize
from vecloom.plans import vectors


def kmeans(x, k, steps):
    book = x[:k].copy()
    for _ in range(steps):
        code = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.array([x[code == c].mean(axis=0) if (code == c).any() else book[c] for c in range(k)])
        moved = ((after - book) ** 2).sum(axis=1).max()
        book = after
        if moved <= 1e-6:
            break
    return book


def test_trained_product_quantizer(spark):
    x = np.random.default_rng(6).standard_normal((80, 8)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vector array<float>")
    book = quantize.product_book(df, 2, 4, 20)
    assert np.allclose(book.parts, [kmeans(x[:, :4], 4, 20), kmeans(x[:, 4:], 4, 20)])
    assert "pq_trained_error" in vectors.QUERIES
