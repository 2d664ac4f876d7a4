"""Operator 7: zones, lots of queries, and how the search is dealt out."""

import numpy as np

from atollkit.llm import topk
from atollkit.llm.topk import top_k
from tests.llm.test_topk import SCHEMA, brute


def test_lots_and_queries_without_a_cell_of_their_own(spark):
    r = np.random.default_rng(11)
    x = r.normal(size=(300, 8))
    x[100:220] = x[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    far = [(1000 + i, [float(50 * (i + 1))] * 8) for i in range(12)] + [(2000, [1.0] * 3)]  # no rows near them, or none of their length
    df, asked = (spark.createDataFrame([(i, v, 1, "v") for i, v in t], SCHEMA) for t in (rows, rows[::3] + far))
    ids = {i for i, _ in far}
    want = [t for t in brute(rows + far, lambda i: i in ids or i < 300 and i % 3 == 0, 4000) if t[2] not in ids]
    best, n = [], {}
    for q, _, c, s in want:
        n[q] = n.get(q, 0) + 1
        best += [(q, n[q], c, s)] if n[q] <= 5 else []
    for sizes in (dict(block=40, query_block=6, cell_rows=10, crowd=7), dict(block=40, cell_rows=10, sample=30, crowd=1000)):
        assert sorted(tuple(t) for t in top_k(df, asked, 5, **sizes).collect()) == best


def test_search_is_not_put_together_in_one_task(spark):
    """Spark would join small partitions, whose work is that of all pairs."""
    r = np.random.default_rng(12)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "v") for i, v in enumerate(r.normal(size=(400, 8)))], SCHEMA)
    out = top_k(df, df.where("vec_id % 20 = 0"), 10, block=40, cell_rows=20)
    assert len(out.collect()) == 200
    lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    searches = [i for i, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line]
    assert searches
    for i in searches:
        to = next(j for j in range(i, len(lines)) if "ShuffleQueryStage" in lines[j])
        assert not any("AQEShuffleRead" in line for line in lines[i:to]), lines[i:to]


def test_neighbours_share_zones():
    """Spread vectors make a cell of nearly each sampled row; queries go to zones, not to each cell."""
    r = np.random.default_rng(13)
    x = np.floor(r.normal(size=(4000, 64)) * 128)
    cells = topk.Cells(list(x[:1000]), 4)
    own, away = cells.nearest(x)
    cells.count = {int(c): int((own == c).sum()) for c in np.unique(own)}
    cells.radius = {int(c): float(away[own == c].max()) for c in np.unique(own)}
    cells.settle(1000)
    assert len(cells.count) > 100
    zones = {z for c in cells.count for z in cells.zones(c).tolist()}
    assert len(zones) <= 9
    assert all(cells.length(c) == 64 for c in cells.count)


def test_whole_numbers_are_exact_in_either_type():
    r = np.random.default_rng(14)
    for most in (300, 4000):  # norms below and above what a short float holds
        x = r.integers(-most, most, (500, 64)).astype(np.float64)
        row, at, score, _ = topk.dual_tree(x[:40], np.arange(40), x, np.arange(500), 10)
        s = (x[:40].astype(np.int64) @ x.astype(np.int64).T).tolist()
        want = [(i, c, s[i][c]) for i in range(40) for c in sorted((c for c in range(500) if c != i), key=lambda c: (-s[i][c], c))[:10]]
        assert sorted(zip(row.tolist(), at.tolist(), score.tolist(), strict=True)) == sorted(want)


def test_only_the_cells_places_are_broadcast(spark):
    """Queries on their way to zones compress well: broadcast for their size in files, they were beyond the driver's memory."""
    r = np.random.default_rng(15)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1, "v") for i, v in enumerate(r.normal(size=(400, 8)))], SCHEMA)
    out = top_k(df, df.where("vec_id % 20 = 0"), 10, block=40, cell_rows=20)
    assert len(out.collect()) == 200
    lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    deep = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
            assert not any("Arrow" in x or "Exchange hashpartitioning" in x for x in lines[i + 1 : end]), lines[i:end]
