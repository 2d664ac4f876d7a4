"""The pipeline against a brute-force version of its stages."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from atollkit.llm import quality, queries
from tests.llm.test_dedup import brute_jaccard, brute_suffix
from tests.llm.test_text_operators import brute_rules

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept, columns = docs, docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append(kept.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or kept.columns == columns
    text = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    scored = dict(zip(text, model.score(quality.features([t.encode() for t in text.values()])), strict=True))
    assert {r.doc_id for r in seen[0]} == {d for d, s in scored.items() if s >= 0.3}
    assert all(r.text == text[r.doc_id] for r in seen[2])
    assert {r.doc_id for r in seen[1]} <= {r.doc_id for r in seen[0] if not brute_rules(r.text)[-1]}
    alone = brute_jaccard([(r.doc_id, r.text) for r in seen[1]], 80)
    assert {r.doc_id for r in seen[2]} == {c for _, _, c in alone}
    want = {d: raw.decode("utf-8", "ignore") for d, _, _, _, raw in brute_suffix([(r.doc_id, r.text) for r in seen[2]], 50)}
    assert {r.doc_id: r.text for r in seen[3]} == want and all(r.n_chars == len(r.text) for r in seen[3])
    tok = Tokenizer.from_file(queries.JSON)
    pieces = []
    for r in seen[3]:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        at, stop, k = 0, (len(ids) - 1) % 2048 + 1, 0
        while at < len(ids):
            pieces.append((r.doc_id, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
            at, stop, k = stop, stop + 2048, k + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in seen[4]) == sorted(pieces)
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(pieces)


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_clashing_columns_and_nulls(spark):
    rows = [(i, t, i, "x", 1.0, 2) for i, t in enumerate([None, "", "The and of the to be in that it is for this with was on are by at from. " * 9, "a"])] + [(None, "The of and to a in is that it was for on are with as his they at be this. " * 9, 1, "y", 2.0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, rest string, score double, _join_digest int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {r.doc_id: r.rest for r in got.collect()}.items() <= {0: "x", 1: "x", 2: "x", 3: "x", None: "y"}.items()


def test_long_texts_and_repeated_rows(spark):
    sentence = "The of and to in is that it for was on are as with be by this at or from. "
    long = " ".join(f"word{i} the of" for i in range(60_000))
    rows = [(1, long, 1), (2, long, 1), (3, None, 2), (4, "a b", 3)] + [(5, "One more of the clean texts that are to be kept for this and that: " + sentence, 4)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    got = {r.doc_id: r for r in kept.collect()}
    assert sorted(r.doc_id for r in got.values()) == [1, 3, 4, 5] and got[1].text == long and got[1].n_chars == len(long)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sum(r.doc_id == 5 for r in packed) == 60 and max(r.length for r in packed) <= 2048
    rules_kept = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert rules_kept.columns == docs.columns and rules_kept.where("doc_id = 4").count() == 0
