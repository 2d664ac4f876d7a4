"""Suffix-array dedup: only triggers that may have many phrases are asked about apart from their phrases."""

import random
import tracemalloc

import numpy as np
import pytest

from atollkit.llm import suffix_dedup as sd
from tests.llm.test_dedup import brute_suffix
from tests.llm.test_hot_triggers import corpus


def rounds(rows, blocks, buckets, hot, counted=True):
    """All rounds in one process: (removed bytes of each row, bytes asked in each round, wide triggers). Without counted every trigger is wide."""
    parts = [rows[k::blocks] for k in range(blocks)]
    states = [sd.State([i for i, _ in p], [t.encode() for _, t in p], 50, 28, buckets) for p in parts]
    asked = []

    def ask(questions, reply):
        by_bucket = {}
        for k, said in enumerate(questions):
            for b, data in said:
                by_bucket.setdefault(b, []).append((k, data))
        got = [{} for _ in states]
        for b, said in by_bucket.items():
            for (k, _), x in zip(said, reply([k for k, _ in said], [d for _, d in said]), strict=True):
                got[k][b] = x
        asked.append(sum(len(d) for said in by_bucket.values() for _, d in said))
        return got

    for s in states:
        s.triggers()
    for s, g in zip(states, ask([s.numbers() for s in states], lambda _, d: sd.met(d, hot)), strict=True):
        live, wide = ({b: x[: len(x) // 2] if k == 0 else x[len(x) // 2 :] for b, x in g.items()} for k in (0, 1))
        s.drop_lonely(live, wide if counted else None)
        s.phrases()
    for s, g in zip(states, ask([s.questions() for s in states], lambda b, d: sd.parse_order(b, d, hot)), strict=True):
        s.parsed(g)
    out = {}
    for s, p, g in zip(states, parts, ask([s.dictionary() for s in states], sd.dictionary_order(50)), strict=True):
        for run, gone in zip(s.parses, s.gone(g), strict=True):
            for lo, hi, (i, _) in zip(run.at[:-1], run.at[1:], p, strict=True):
                out[i] = int(gone[lo:hi].sum())
    return out, asked, set(np.concatenate([s.wide_keys for s in states]).tolist())


def passages(n, seed=3):
    """Texts that share passages by twos and threes, whole or in part."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(k))
    pool = [noise(400) for _ in range(n // 3)]
    cut = lambda x: x[r.randrange(100) :][: r.randrange(60, 300)]
    return [(i, noise(40) + cut(r.choice(pool)) + noise(40) + cut(r.choice(pool))) for i in range(n)]


@pytest.mark.parametrize("hot", [1 << 14, 100, 2, 0])
def test_same_bytes_go_whatever_is_wide(hot):
    rows = corpus(200) + [(10_000 + i, t) for i, t in passages(150)]
    want = {d: removed for d, _, removed, *_ in brute_suffix(rows, 50)}
    got, _, wide = rounds(rows, 7, 16, hot)
    assert got == want
    assert (hot == 1 << 14 and not wide) or (hot == 0 and wide) or 0 < hot < 1 << 14


def test_phrases_of_narrow_triggers_take_less():
    """A phrase and its trigger took 31 bytes a phrase; without the trigger's summary it is 20."""
    rows = passages(900)
    apart, together = (rounds(rows, 8, 48, sd.HOT, counted) for counted in (False, True))
    assert apart[0] == together[0] and apart[1][2] == together[1][2]
    assert together[1][1] < 0.75 * apart[1][1]


def test_numbers_of_phrases():
    """Blocks' phrases of a trigger are added up; copies of a phrase in a block count once."""
    key = np.array([5, 9], np.uint64)
    said = lambda n: np.uint32(2).tobytes() + sd.pack(key, 3) + np.packbits(np.array(n) > 1).tobytes() + np.array([x for x in n if x > 1], "<u2").tobytes()
    assert sd.met([said([1, 3]), said([2, 4])], 6) == [np.packbits([1, 1]).tobytes() + np.packbits([0, 1]).tobytes()] * 2
    s = sd.State([1, 2, 3], [b"x" * 70 + b"0123456789" * 9] * 3, 50, 28, 1)
    s.triggers()
    ((_, data),) = s.numbers()
    n = int(np.frombuffer(data, "<u4", 1)[0])
    assert n == len(s.keys) and not np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 4 + 3 * n)).all()


def test_windows_of_hot_triggers_in_little_memory(monkeypatch):
    """Distinct windows were taken out by a matrix of 400 bytes a window."""
    s = sd.State([], [], 50, 28, 4)
    n, size = 300, 1000
    r = np.random.default_rng(1)
    spans = [r.integers(97, 123, size).astype(np.uint8) for _ in range(n)]
    s.hot, s.c_windows, s.chosen = np.ones(n, bool), np.full(n, size - 49), np.arange(n)
    s.e_doc = np.arange(n).astype(np.uint64)
    monkeypatch.setattr(s, "spans_of", lambda at: [spans[i] for i in at])
    tracemalloc.start()
    s.windows()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(s.w_text) == n * (size - 49) and bytes(s.w_text[s.w_of[951]]) == spans[1][:50].tobytes()
    assert peak < 260 * n * (size - 49)
