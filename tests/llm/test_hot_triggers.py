"""A short string that every document has in surroundings of its own: suffix-array dedup with hot triggers."""

import random

import numpy as np
import pytest

from atollkit.llm import suffix_dedup as sd
from tests.llm.test_dedup import brute_suffix

COMMON = "the same forty-five bytes stand in every text"


def corpus(n, seed=1):
    """Texts with the common string, some of which also share what stands around it, in part or whole."""
    r = random.Random(seed)
    noise = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(k))
    out = []
    for i in range(n):
        before, after = noise(r.randrange(20, 90)), noise(r.randrange(20, 90))
        out.append((i, before + COMMON + after))
        if i % 9 == 0:
            out.append((n + i, noise(30) + before[-r.randrange(1, 20) :] + COMMON + after[: r.randrange(1, 20)] + noise(30)))
        if i % 31 == 0:
            out.append((2 * n + i, out[r.randrange(len(out))][1]))
    r.shuffle(out)
    return out


def answered(rows, blocks, buckets, hot, monkeypatch):
    """All rounds in one process: (removed bytes of each row, most bytes of dictionary text and of parse entries in a bucket)."""
    monkeypatch.setattr(sd, "HOT", hot)
    parts = [rows[k::blocks] for k in range(blocks)]
    states = [sd.State([i for i, _ in p], [t.encode() for _, t in p], 50, 28, buckets) for p in parts]
    largest = []

    def ask(questions, reply):
        by_bucket = {}
        for k, said in enumerate(questions):
            for b, data in said:
                by_bucket.setdefault(b, []).append((k, data))
        got = [{} for _ in states]
        for b, said in by_bucket.items():
            for (k, _), x in zip(said, reply([k for k, _ in said], [d for _, d in said]), strict=True):
                got[k][b] = x
        largest.append(max(sum(len(d) for _, d in said) for said in by_bucket.values()))
        return got

    for s in states:
        s.triggers()
    lonely = lambda _, datas: [np.packbits(m).tobytes() for m in sd.meets([sd.unpack(d, 3) for d in datas])]
    got = ask([[(b, sd.pack(s.keys[s.cuts[b] : s.cuts[b + 1]], 3)) for b in range(buckets) if s.cuts[b + 1] > s.cuts[b]] for s in states], lonely)
    for s, g in zip(states, got, strict=True):
        s.drop_lonely(g)
        s.phrases()
    for s, g in zip(states, ask([s.questions() for s in states], sd.parse_order), strict=True):
        s.parsed(g)
    out = {}
    for s, p, g in zip(states, parts, ask([s.dictionary() for s in states], sd.dictionary_order(50)), strict=True):
        for run, gone in zip(s.parses, s.gone(g), strict=True):
            for lo, hi, (i, _) in zip(run.at[:-1], run.at[1:], p, strict=True):
                out[i] = int(gone[lo:hi].sum())
    return out, largest


@pytest.mark.parametrize("hot", [256, 3, 0])
def test_windows_of_hot_triggers(hot, monkeypatch):
    rows = corpus(300)
    got, _ = answered(rows, 7, 16, hot, monkeypatch)
    assert got == {d: removed for d, _, removed, *_ in brute_suffix(rows, 50)}


def test_no_bucket_gathers_a_trigger(monkeypatch):
    """2,400 surroundings: with a trigger's phrases in one bucket the largest has nearly all of the dictionary's text; spread, a small part of it."""
    rows = corpus(2000)
    whole = answered(rows, 8, 64, 1 << 30, monkeypatch)
    spread = answered(rows, 8, 64, 256, monkeypatch)
    assert whole[0] == spread[0]
    assert spread[1][1] < 3 * sum(20 for _ in rows) * 8 / 64 + 4000  # phrases, about three a row
    assert spread[1][2] < whole[1][2] / 2


def test_query_path(spark):
    rows = corpus(700)
    for hot in (sd.HOT, 100):
        got = sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=50, hot=hot).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(brute_suffix(rows, 50))
