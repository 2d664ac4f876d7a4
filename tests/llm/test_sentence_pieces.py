"""SentencePiece encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from atollkit.llm import queries, sentence_pieces
from atollkit.llm.sentence_pieces import Encoder

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return Encoder(PATH)


def odd_texts(own):
    r = random.Random(1)
    chars, tokens = "ab tTh e  ▁  \n\t.,'é́漢字の한ⅷ٣\x00\U0001d4b3ingtheandSS  ", list(own.merges.id)
    out = ["", " ", "\n", "a", "<s> </s> <unk> <0x41>", "▁", "▁▁a", "漢字かな" * 400, "ab" * 900]
    out += ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(1500)]
    out += [" " * k + x for k in range(60) for x in ("", "a", "the", " \n", "\n  ", "漢", "ą")]
    out += ["".join(r.choice(tokens) for _ in range(r.randrange(12))) for _ in range(1500)]
    return out + ["".join(r.choice(" ▁") if r.random() < 0.8 else r.choice("xyqt") for _ in range(r.randrange(120))) for _ in range(800)]


def test_odd_texts(own, library):
    """Also once more from kept words, and with small runs, small tables and stretches that are worked out one by one."""
    texts = odd_texts(own)
    want = library.encode(texts)
    for _ in range(2):
        assert [x.tolist() for x in own.encode(texts)] == want


def test_small_limits(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "RUN", 500)
    monkeypatch.setattr(sentence_pieces, "CACHE", 5000)
    monkeypatch.setattr(sentence_pieces, "SHORT", 7)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 4)
    own = Encoder(PATH)
    texts = odd_texts(own)
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)
    assert own.young.size() <= 2500


def test_last_tokens_are_those_of_every_prefix(own, library):
    """The table's claim itself: each prefix of a text, encoded alone, ends with the token that the table holds for it."""
    for text in (" unbelievable", "   international", " aaaaaaaab"):
        last = own.merges.one_by_one(text)
        for n in range(1, len(text) + 1):
            assert own.merges.text[int(last[n - 1])] == own.merges.merged(text[:n])[-1]


def test_query_and_outputs(spark, tmp_path, library):
    texts = [None, "", " two  words ", "line\nline", "é" * 5000, "same", "same"]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(6, "same", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_sentence_pieces(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "")
        want.append((str(d), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")))
    assert got == sorted(want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for r in sentence_pieces.sentence_pieces(docs, PATH).collect():
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist()) if r.ids else r.decoded == ""
    assert queries.op13_sentence_pieces(spark, str(tmp_path)).where("doc_id < 0").count() == 0


def test_whole_table_against_the_library(spark, library):
    at = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids_sha256 for r in queries.op13_sentence_pieces(spark, at).collect()}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest()
