"""Operators 3 and 4 against plain versions: the risk row by row, and the fewest bins by trying all subsets."""

import functools

import numpy as np
import pytest

from atollkit.llm import quality
from atollkit.llm.packing import Packing


def fewest(lengths, size):
    """Fewest bins, by the best way to fill a bin with the first item that is left and any others."""
    n = len(lengths)
    total = [sum(lengths[i] for i in range(n) if s >> i & 1) for s in range(1 << n)]

    @functools.cache
    def bins(left):
        if not left:
            return 0
        first = left & -left
        rest, sub, best = left ^ first, left ^ first, n
        while True:
            if total[sub | first] <= size:
                best = min(best, 1 + bins(rest & ~sub))
            if not sub:
                return best
            sub = (sub - 1) & rest

    return bins((1 << n) - 1)


@pytest.mark.parametrize("seed", range(12))
def test_small_instances_are_packed_as_well_as_can_be(seed):
    r = np.random.default_rng(seed)
    lengths, size = r.integers(3, 40, 11), 50
    p = Packing(lengths, size, seed)
    found, _ = p.evolve([p.start(0.0), p.start(0.3), p.start(0.6), p.start(0.9)])
    assert (p.fills(found[0]) <= size).all() and sorted(np.unique(found[0])) == list(range(p.cost(found[0])[0]))
    assert p.cost(found[0])[0] == fewest(lengths.tolist(), size)


def risk(w, good, text, prior, ridge):
    """prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) and the ridge, a row at a time."""
    loss = lambda rows, y: sum((1 - y * (float(x @ w[:-1]) + w[-1])) ** 2 / 4 for x in rows) / len(rows)
    return prior * loss(good, 1) + max(0.0, loss(text, -1) - prior * loss(good, -1)) + float(w @ ridge @ w) / 2


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.95])
def test_no_weights_nearby_have_a_smaller_risk(prior):
    r = np.random.default_rng(int(100 * prior))
    good = r.normal(1, 1, (80, 4)).astype(np.float32)
    text = np.concatenate([r.normal(1, 1, (60, 4)), r.normal(-1, 1, (50, 4))]).astype(np.float32)
    p, u = quality.moments(good), quality.moments(text)
    model = quality.fit(p, u, prior, steps=3000)
    ridge = quality._scaled(p, u, 1e-2)[2]
    least = risk(model.weights, good, text, prior, ridge)
    for scale in (1e-3, 1e-2, 0.1, 1.0):
        for _ in range(25):
            assert risk(model.weights + r.normal(0, scale, 5), good, text, prior, ridge) > least - 2e-4


def test_the_risk_of_moments_is_that_of_rows():
    """One step from no weights goes down the row-wise risk, along its finite differences."""
    r = np.random.default_rng(3)
    good, text = r.normal(1, 1, (50, 4)).astype(np.float32), r.normal(0, 1, (70, 4)).astype(np.float32)
    p, u = quality.moments(good), quality.moments(text)
    ridge = quality._scaled(p, u, 1e-2)[2]
    w = quality.fit(p, u, 0.5, steps=1, rate=1e-3).weights
    f = lambda x: risk(x, good, text, 0.5, ridge)
    slope = np.array([(f(1e-5 * e) - f(-1e-5 * e)) / 2e-5 for e in np.eye(5)])
    assert f(w) < f(np.zeros(5)) and f(w) - f(np.zeros(5)) == pytest.approx(slope @ w, rel=0.02)
