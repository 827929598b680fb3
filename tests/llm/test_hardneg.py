import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from lakeweave.llm import hardneg


def brute(rows, anchor, positives=5, negatives=5, percent=80):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    known = {}
    for i, label, x in rows:
        v = (label, [math.floor(256 * float(np.float32(c))) for c in x])
        known[i] = min(known.get(i, v), v)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (label, x) in known.items():
        if not anchor(a):
            continue
        others = sorted(((-dot(x, y), i, other) for i, (other, y) in known.items() if i != a))
        for ps, p, _ in [o for o in others if o[2] == label][:positives]:
            fits = [(s, i) for s, i, other in others if other != label and percent * -ps <= 100 * -s <= 100 * -ps]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def run(spark, rows, every=10, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as vec", "2 as leaf", "'x' as qid", "3 as shard")
    found = hardneg.mine(hardneg.prepare(table), F.col("vec_id") % every == 0, **options)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found.collect())


def vectors(n, seed=1, width=8, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"sample": 200, "shard": 40, "queries": 7}, {"sample": 64, "shard": 16}])
def test_equals_brute_force(spark, options):
    rows = vectors(400)
    assert run(spark, rows, **options) == brute(rows, lambda i: i % 10 == 0)


def test_ties_and_copies(spark):
    rng = random.Random(4)
    some = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(6)]
    rows = [(i, rng.randrange(3), rng.choice(some)) for i in range(300)]
    assert run(spark, rows, sample=100, shard=20) == brute(rows, lambda i: i % 10 == 0)


def test_one_vector_is_a_third_of_all_rows(spark):
    rows = vectors(200) + [(1000 + i, 1, [1.0] * 8) for i in range(100)]
    assert run(spark, rows, sample=64, shard=16) == brute(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, 1, [1.0, 2.0]), (11, 1, [1.0, 1.0]), (12, 2, [0.9, 1.0]), (13, None, [1.0]), (14, 2, None), (15, 2, [nan, 1.0]), (16, 2, [inf, 1.0]), (17, 2, [None, 1.0]), (18, 2, []), (None, 2, [1.0, 1.0]), (19, 2, [1.0]), (20, 1, [-1.0, -2.0]), (21, 2, [0.5, 1.0, 9.0])]
    rows += [rows[0], rows[2], (12, 1, [5.0, 5.0])]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows[:1]) == [] and run(spark, []) == []


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(-1, 1) * 2**19)) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert run(spark, [*rows, (1000, 0, [1e30] * 4)]) == brute(rows, lambda i: i % 10 == 0)


def test_buckets_beyond_the_bound_are_not_scored(monkeypatch):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(-20, 20, (500, 4)) + c for c in ([900, 0, 0, 0], [0, 900, 0, 0], [0, 0, 900, 0], [-900, 0, 0, 0])])
    seen, plain = [], hardneg.products
    monkeypatch.setattr(hardneg, "products", lambda a, b: seen.append(len(b)) or plain(a, b))
    anchor, largest = np.array([[900, 10, 0, 0]]), float(hardneg.norms(rows).max())
    ids = np.arange(len(rows))
    ask, got, score = hardneg.first_rows(ids, ids * 0, rows, anchor, np.array([1]), np.array([0]), np.array([-(1 << 60)]), np.array([1 << 60]), 5, False, largest, bucket=64)
    every = (rows @ anchor.T)[:, 0]
    assert got.tolist() == np.lexsort((ids, -every))[:5].tolist() and score.tolist() == every[got].tolist()
    assert sum(seen) <= 600
