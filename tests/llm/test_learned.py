"""Operators 3 and 4: held-out accuracy, invariants and round trips."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atollkit.llm import packing, quality, queries

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    rows = queries.op3_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for q, s in test if q], [s for q, s in test if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.99 and np.mean([s < 0.3 for s in bad]) > 0.8


def test_quality_ignores_other_columns_and_survives_nulls(spark):
    docs = spark.createDataFrame([(1, "a good text", "x"), (2, None, "y"), (None, "", "z"), (1, "a good text", "w"), (4, "long " * 50_000, "v")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (4, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).select("doc.*", F.col("score").alias("s")).collect()
    assert len(got) == 5 and all(0 <= r.s <= 1 for r in got)
    assert len({r.s for r in got if r.doc_id == 1}) == 1
    none = quality.train(docs.limit(0), labels.limit(0))
    assert none.prior == 0.5 and quality.score(docs.limit(0), none).count() == 0
    assert quality.kept_documents(docs, labels).columns == docs.columns


def test_risk_stays_above_zero_and_the_prior_is_found():
    r = np.random.default_rng(0)
    for prior in (2 / 3, 0.3):
        good, fresh = (r.normal(1, 1, (1000, 5)).astype(np.float32) for _ in range(2))
        mixed = np.concatenate([r.normal(1, 1, (int(6000 * prior), 5)), r.normal(-1, 1, (int(6000 * (1 - prior)), 5))]).astype(np.float32)
        u = quality.moments(mixed)
        first = quality.told_apart(quality.moments(good), u)
        found = quality.estimated_prior(quality.steps_of(first.value(fresh)), quality.steps_of(first.value(mixed)))
        assert abs(found - prior) < 0.06
        m = quality.fit(quality.moments(good), u, found)
        m = m.calibrated(m.value(good), quality.steps_of(m.value(mixed)))
        good, bad = m.score(fresh), m.score(r.normal(-1, 1, (500, 5)).astype(np.float32))
        assert np.median(good) > 0.9 and (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.9
        one, two = (quality.fit(quality.moments(fresh[:6]), quality.moments(mixed[:8]), 0.9, decay=d).weights for d in (1e-6, 1.0))
        assert np.isfinite(one).all() and np.isfinite(two).all()


def test_moments_are_those_of_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").repartition(40)
    x = quality.features([r.text.encode() for r in docs.collect()])
    got = quality.total_moments(docs)
    assert np.allclose(got, quality.moments(x), rtol=1e-4, atol=1e-2) and got[-1, -1] == len(x)
    model = quality.Model(np.linspace(-0.1, 0.1, quality.WIDTH + 1), 0.5)
    assert quality.counted_scores(docs, model).sum() == len(x)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(spark, size):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.JSON)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "x"), (-3, "a b c " * 3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", "lang").unionByName(extra.withColumn("lang", F.lit(None).cast("string")))
    got = packing.pack(docs, queries.JSON, 0, size).collect()
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, []).append(r.text or "")
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(text)
    for d, ts in text.items():
        ids = np.array([*tok.encode(ts[0], add_special_tokens=False).ids, 0], "<u4")
        want, at, stop = [], 0, (len(ids) - 1) % size + 1
        while at < len(ids):
            want.append((len(want), at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at, stop = stop, stop + size
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == sorted(want * len(ts))
    total = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
    assert len(by_seq) <= 1.03 * -(-total // size) + 1


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.JSON).count() == 0


def test_grouping_operators_keep_solutions_whole():
    r = np.random.default_rng(0)
    p = packing.Packing(r.integers(200, 1400, 300), 2048, 1)
    a, b = p.start(0.0), p.start(0.5)
    for s in (a, b, p.crossover(a, b), p.crossover(b, a), p.mutate(a), *p.evolve([a, b, p.start(0.3), p.start(0.2)])[0]):
        f = p.fills(s)
        assert s.min() == 0 and (f > 0).all() and f.max() <= 2048 and f.sum() == p.lengths.sum()
    assert p.cost(p.evolve([a, b])[0][0]) <= p.cost(a)


def test_two_rounds_of_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs, queries.JSON).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in seqs.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0 and sum(n for _, n in x) <= 2048
    assert len(seqs) <= 1.03 * sum(r.length for r in got) / 2048 + 2


def triplets(n, size, seed):
    """3 * n items that fill n bins exactly, each bin with one item from each third."""
    r = np.random.default_rng(seed)
    big = r.integers(int(0.38 * size), int(0.49 * size), n)
    mid = np.array([r.integers(int(0.25 * size) + 1, (size - x) // 2) for x in big])
    return np.concatenate([big, mid, size - big - mid])


def test_evolution_beats_best_fit_on_triplets(spark, monkeypatch):
    monkeypatch.setattr(packing, "GENERATIONS", 400)
    monkeypatch.setattr(packing, "PATIENCE", 150)
    rows = [(shard, i, 0, int(x), 0, shard) for shard in range(2) for i, x in enumerate(triplets(30, 1000, shard))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, shard long")
    for r in packing.shard_solutions(items, 1000).collect():
        assert r.bound == 30 and r.start > 31 and r.end <= 31 and r.generations > 0
