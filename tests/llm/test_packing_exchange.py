"""The exchange step of packing looks sizes up in a table instead of searching for each pair of items."""

import numpy as np

from atollkit.llm.packing import TRIED, Packing


def test_exchange_looks_sizes_up(monkeypatch):
    rng = np.random.default_rng(3)
    p = Packing(np.sort(rng.integers(200, 1500, 2000))[::-1], 2048, 1)
    s = p.start(0.0)
    s[np.isin(s, rng.choice(s.max() + 1, 12, replace=False))] = -1
    s[s >= 0] = np.unique(s[s >= 0], return_inverse=True)[1]
    fills = lambda s: np.bincount(s[s >= 0], weights=p.lengths[s >= 0])
    before, asked, search = fills(s), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: asked.append(np.size(v)) or search(a, v, *rest))
    p.exchange(s)
    after = fills(s)
    assert after.max() <= p.size and (after >= before).all() and after.sum() > before.sum()
    assert asked and max(asked) <= p.size + 1 and len(asked) <= 2 * TRIED


def test_full_bins_are_not_looked_at():
    """Items of full bins are no part of an exchange's work."""
    p = Packing(np.array([60, 40, 70, 20, 100, 30]), 100, 1)
    assert p.roomy(np.array([0, 0, 1, 1, 2, -1])).tolist() == [2, 3]
    s = np.array([0, 0, 1, 1, 2, -1])
    p.exchange(s)
    assert s.tolist() == [0, 0, 1, -1, 2, 1]


def test_few_items_have_room():
    p = Packing(np.array([30, 30, 20, 10, 100, 60]), 100, 1)
    s = np.array([0, 0, 0, 0, 1, -1])
    p.exchange(s)
    assert p.fills(np.where(s < 0, 2, s)).max() <= 100 and (s < 0).any() and s[5] == 0
