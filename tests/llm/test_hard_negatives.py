"""Hard negatives and their packed products against brute force."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.llm import queries
from atollkit.llm.hard_negatives import best, hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block int"


def plain(rows, anchor=lambda i: i % 50 == 0, label=lambda i, x: x):
    """The contract, pair by pair."""
    fine = [(i, label(i, x), [math.floor(256 * c) for c in v]) for i, v, x in rows if i is not None and x is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a in sorted({r[0] for r in fine if anchor(r[0])}):
        _, own, q = min(r for r in fine if r[0] == a)
        scored = [(sum(map(int.__mul__, q, v)), i, x) for i, x, v in fine if i != a and len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == own][:5]:
            near = [s for s in scored if s[2] != own and 50 * ps <= 100 * s[0] <= 95 * ps][:3]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(near)]
    return sorted(out)


def made(n, seed, labels=3, dims=(6,)):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in r.normal(size=dims[i % len(dims)]) + 0.4], int(r.integers(labels))) for i in range(n)]


def asked(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect())


@pytest.mark.parametrize("top", [1, 90, 2000, 1 << 23, 1 << 27])
def test_products_are_exact(top):
    """One field a word, several, and fields wider than a word."""
    r = np.random.default_rng(top)
    q, x = (r.integers(-top, top + 1, (n, 64)).astype(float) for n in (7, 50))
    x[0], q[0] = top, -top
    want = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
    assert products(q, x).tolist() == want
    assert products(abs(q), abs(x)).tolist() == [[sum(abs(int(a) * int(b)) for a, b in zip(u, v, strict=True)) for v in x] for u in q]


def test_products_end_at_64_bits():
    assert products(np.array([[2.0**60]]), np.array([[2.0**60], [-(2.0**60)], [3.0]])).tolist() == [[(1 << 63) - 1, 1 - (1 << 63), 3 << 60]]
    assert products(np.zeros((0, 3)), np.zeros((4, 3))).shape == (0, 4)


def test_best_takes_the_left_of_equal_scores():
    r = random.Random(2)
    s = np.array([[r.choice([3, 5, np.iinfo(np.int64).min]) for _ in range(9)] for _ in range(50)])
    rows, cols = best(s, 3)
    for i in range(50):
        assert cols[rows == i].tolist() == sorted((c for c in range(9) if s[i, c] > 0), key=lambda c: (-s[i, c], c))[:3]


@pytest.mark.parametrize(("block", "crowd"), [(4096, 1024), (40, 2), (7, 1)])
def test_against_brute_force(spark, block, crowd):
    rows = made(330, 1)
    assert asked(spark, rows, block=block, crowd=crowd) == plain(rows) != []


def test_one_label_holds_most_rows_and_many_labels_few(spark):
    rows = [(i, v, 0 if i % 3 else i) for i, v, _ in made(300, 2)]
    rows += [(1000 + i, rows[100][1], 150) for i in range(40)]
    assert asked(spark, rows, block=25, crowd=3) == plain(rows)


def test_nulls_lengths_ties_and_repeated_rows(spark):
    rows = made(120, 3, dims=(6, 6, 6, 3))
    rows += [(None, [1.0] * 6, 1), (300, None, 1), (350, [], 1), (400, [1.0, None], 1), (450, [1.0, float("nan")], 0), (500, [float("inf")] * 6, 0), (550, [1.0] * 6, None)]
    rows += [rows[0], rows[0], rows[1], rows[1], (50, rows[2][1], 1)]
    rows += [(700 + i, rows[4][1], i % 3) for i in range(12)]
    assert asked(spark, rows, block=20, crowd=2) == plain(rows)


def test_empty_and_anchors_alone(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(0, [1.0], 1)]) == []
    assert asked(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_query_changes_labels(spark, tmp_path):
    rows = made(220, 4, labels=10)
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect())
    assert got == plain(rows, label=lambda i, x: (x + 1) % 10 if i % 7 == 0 else x) != []
    assert not any(isinstance(x, Decimal) for r in got for x in r)
