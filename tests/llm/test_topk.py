"""Operator 11 against whole products in Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindermap.llm import topk

SCHEMA = "vec_id long, embedding array<double>, block int, least double, score string, is_query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, None, None, None, None) for i, x in rows], SCHEMA).repartition(3)


def brute(rows, every, k=10):
    usable = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    asking = {}
    for i, x in usable:
        if i % every == 0:
            asking[i] = min(asking.get(i, x), x)
    out = []
    for q, x in asking.items():
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), i) for i, y in usable if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def found(df, every, k=10):
    return sorted(map(tuple, topk.top_products(df, F.col("vec_id") % every == 0, k).collect()))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_equal_and_unequal_lengths(spark, spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 16)) * 0.15
    x = x / np.linalg.norm(x, axis=1)[:, None] * np.exp(rng.normal(size=(4000, 1)) * spread)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    assert found(frame(spark, rows), 100) == brute(rows, 100)


def test_both_prunings_are_used(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 12))
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 1000)
    block = topk.Block(np.arange(3000), x, np.linalg.norm(x, axis=1))
    left = []

    def watched(self, unit, cosine, real=topk.Block.near_coordinates):
        left.append(len(got := real(self, unit, cosine)))
        return got

    monkeypatch.setattr(topk.Block, "near_coordinates", watched)
    products = x[:40] @ x.T
    products[np.arange(40), np.arange(40)] = -np.inf
    third = np.sort(products, axis=1)[:, -3]
    for share, by_coordinate in ((0.2, 0), (1.0, 40)):
        left.clear()
        got = {}
        for ids, found, scores in block.best(np.arange(40), x[:40], np.linalg.norm(x[:40], axis=1), third * share, 3):
            for i, v, s in zip(ids.tolist(), found.tolist(), scores.tolist(), strict=True):
                got.setdefault(i, []).append((v, s))
        for i in range(40):
            order = np.lexsort((np.arange(3000), -products[i]))[:3]
            assert got[i] == [(int(j), int(products[i][j])) for j in order]
        assert len(left) >= by_coordinate * 0.9 and (not left or np.mean(left) < 1500)


def test_defined_cases(spark):
    huge = [1e150, -1e150, 3.0]
    rows = [
        (0, [1.0, 2.0, 3.0]), (0, [0.5, 2.0, 3.0]), (5, [0.0, 0.0, 0.0]), (10, [0.0, 0.0, 0.0]), (1, None), (2, [1.0, None, 2.0]), (3, [float("nan"), 0.0, 1.0]), (4, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
        (6, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, -2.0, -3.0]), (9, []), (15, [2.0]), (20, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), (25, huge), (11, [-1e-9, 0.0, 0.0]), (-5, [0.3, -0.2, 0.1]),
    ]
    assert found(frame(spark, rows), 5) == brute(rows, 5)
    assert found(frame(spark, rows), 5, 100) == brute(rows, 5, 100)


def test_hot_vector_and_empty_table(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, -0.25, 0.125] if i % 3 else [float(v) for v in rng.normal(size=3)]) for i in range(1500)]
    assert found(frame(spark, rows), 100) == brute(rows, 100)
    assert found(frame(spark, [(1, [1.0])]).where("vec_id > 1"), 100) == []
    assert found(frame(spark, [(100, [1.0])]), 100) == []
