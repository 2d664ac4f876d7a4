"""Operator 7 against brute force."""

import math

import numpy as np
import pytest

from atollkit.llm import topk
from atollkit.llm.topk import Tree, dual_tree, top_k

SCHEMA = "vec_id long, embedding array<float>, id int, v string"


def brute(rows, queries, k):
    ok = [(i, [math.floor(1024.0 * np.float32(c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in ok if queries(i)}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("shape", ["spread", "clusters", "copies"])
def test_top_k(spark, shape):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8))
    if shape == "clusters":
        x = np.repeat(r.normal(size=(8, 8)) * 5, 50, 0) + r.normal(size=(400, 8)) * 0.01
    if shape == "copies":
        x[50:350] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(500, None), (520, []), (540, [1.0] * 7 + [None]), (560, [float("nan")] * 8), (580, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "v") for i, v in rows], SCHEMA)
    want = brute(rows, lambda i: i % 20 == 0, 10)
    for sizes in (dict(block=100, query_block=8, cell_rows=40), dict(block=30, query_block=3, cell_rows=40, sample=60), {}):
        got = sorted(tuple(t) for t in top_k(df, df.where("vec_id % 20 = 0"), 10, **sizes).collect())
        assert got == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, "") for i in range(4)], SCHEMA)
    assert top_k(df, df.where("vec_id = 0"), 10).count() == 3
    assert top_k(df.limit(0), df.limit(0), 10).count() == 0
    assert top_k(df, df.limit(0), 10).count() == 0


def test_repeated_ids_lengths_and_negative_ids(spark):
    r = np.random.default_rng(5)
    rows = [(-i, [float(np.float32(c)) for c in r.normal(size=4 if i % 3 else 6)]) for i in range(120)]
    rows += [(-5, rows[5][1]), (-7, rows[9][1]), (-200, [0.5] * 9)]
    df = spark.createDataFrame([(i, v, 1, "v") for i, v in rows], SCHEMA)
    queries = df.where("vec_id % 10 = 0 AND vec_id NOT IN (-5, -7)")
    for sizes in (dict(block=20, query_block=4, cell_rows=10), dict(sample=1)):
        got = sorted(tuple(t) for t in top_k(df, queries, 7, **sizes).collect())
        assert got == brute(rows, lambda i: i % 10 == 0, 7)


def nearest(q, x, k):
    s = q @ x.T
    return [[(-a, b) for a, b in sorted(zip(-row, range(len(x)), strict=True))[:k]] for row in s]


def test_cover_tree_covers():
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(20, 4)) * 1000, 200, 0) + r.normal(size=(4000, 4))
    tree = Tree(x)
    inner = np.flatnonzero(tree.size > 0)
    assert len(inner) > 20
    for node in inner.tolist():
        rows = tree.rows(node)
        assert (np.sqrt(((x[rows] - x[tree.centre[node]]) ** 2).sum(1)) <= tree.radius[node] + 1e-6).all()
        below = tree.children(np.array([node]))
        assert sorted(np.concatenate([tree.rows(int(c)) for c in below])) == sorted(rows)
        assert (tree.radius[below] < tree.radius[node]).all() or tree.radius[node] == 0
    assert sorted(tree.rows(0)) == list(range(4000))


def test_dual_tree_prunes_clusters_in_64_dimensions():
    """Work is below all pairs where vectors are clustered, whatever the length; spread ones leave nothing to prune."""
    r = np.random.default_rng(2)
    for spread, most in ((0.02, 0.15), (0.1, 0.6)):
        centres = r.normal(size=(60, 64))
        centres *= 1024 / np.sqrt((centres**2).sum(1))[:, None]
        x = np.floor(centres[r.integers(0, 60, 6000)] + r.normal(size=(6000, 64)) * 1024 * spread / 8)
        q = np.floor(centres[r.integers(0, 60, 200)] + r.normal(size=(200, 64)) * 1024 * spread / 8)
        row, at, score, share = dual_tree(q, np.arange(200), x, np.arange(6000), 10, same=False)
        want = nearest(q, x, 10)
        assert [[(int(s), int(c)) for s, c in zip(score[row == i], at[row == i], strict=True)] for i in range(200)] == [[(int(s), int(c)) for s, c in w] for w in want]
        assert share < most, share


def test_groups_ask_few_cells():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 64))
    centres *= 1024 / np.sqrt((centres**2).sum(1))[:, None]
    x = centres[np.repeat(np.arange(40), 100)] + r.normal(size=(4000, 64)) * 4
    cells = topk.Cells(list(x[::7]), 40)
    own, away = cells.nearest(x)
    cells.count = {int(c): int((own == c).sum()) for c in np.unique(own)}
    cells.radius = {int(c): float(away[own == c].max()) for c in np.unique(own)}
    tree, names = cells.upper(64)
    q = x[::50]
    floor = np.sort(q @ x.T, 1)[:, -10]
    asked = {(i, int(names[at])) for rows, at in topk.reached(q, floor, tree) for i in rows.tolist()}
    need = {(i, int(own[j])) for i in range(len(q)) for j in np.flatnonzero(q[i] @ x.T >= floor[i])}
    assert need <= asked and len(asked) < 0.3 * len(q) * len(names)
