"""Texts with an added token's content get the library's own ids."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from atollkit.llm import packing, queries, token_files, tokens
from atollkit.llm.tokens import Pieces

TEXTS = ["end of file <|endoftext|> next", "", "no such token here", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  c", "<|endoftext <|endof text|>", " x y" * 900 + " <|endoftext|>" + " y z" * 900]


@pytest.fixture(scope="module")
def ids():
    tok = Tokenizer.from_file(queries.JSON)
    return [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4") for t in TEXTS]


def test_encoder(ids):
    assert ids[0].tolist() == [437, 286, 2393, 220, 50256, 1306]
    tok = Pieces(queries.JSON)
    for _ in range(2):
        assert list(tok.encode(TEXTS)) == [x.tobytes() for x in ids]


def test_queries(spark, tmp_path, ids):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, start = sorted(queries.op8_repair_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id), 0
    for r, x in zip(got, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x) + 1, zlib.crc32(np.append(x, 2).astype("<u4").tobytes()))
        start += r.n_tokens
    packed = queries.op4_best_fit_packing(spark, str(tmp_path)).collect()
    want = {}
    for d, x in enumerate(ids):
        x, at = np.append(x, 0).astype("<u4"), 0
        stop = (len(x) - 1) % 2048 + 1
        while at < len(x):
            want[d, at] = (stop - at, zlib.crc32(x[at:stop].tobytes()))
            at, stop = stop, stop + 2048
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packed} == want
    rows = packing.pieces(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.JSON, 0, 2048, ids=True).collect()
    assert any(50256 in np.frombuffer(r.ids, "<u4") for r in rows)


def test_odd_texts_and_a_small_cache(monkeypatch):
    rnd = random.Random(1)
    chars = "ab zZ  \n\t\r.,!?'sß\x85 é\u0301漢ⅷ٣3\x1c\x00\U0001d4b3'll<|endoftext|>\u3000—“"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    texts += [" ".join("".join(rnd.choice(chars[:20]) for _ in range(rnd.randrange(80))) for _ in range(rnd.randrange(30))) for _ in range(300)]
    plain = Tokenizer.from_file(queries.JSON)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for room in (16 << 20, 20_000, 0):
        monkeypatch.setattr(tokens, "CACHE", room)
        monkeypatch.setattr(tokens, "RUN", 3000)
        tok = Pieces(queries.JSON)
        for _ in range(2):
            assert list(tok.encode(texts)) == want
        assert tok.young.size() <= room // 2


def test_short_texts_and_a_warm_cache():
    """Chunks in which no piece begins with a space, or all but one are known."""
    plain = Tokenizer.from_file(queries.JSON)
    tok = Pieces(queries.JSON)
    for texts in (["abc"], ["the cat sat on the mat"], ["dog"], ["", ""], ["a", "", " b", "c"], ["\n", " ", "x\ny"], ["the cat", "7", "!"], ["<|endoftext|>", "q"]):
        assert list(tok.encode(texts)) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_one_word_tables(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r.doc_id, r.length, r.offset) for r in packing.pack(docs, queries.JSON, end_id=0, size=2048).collect()] == [(1, 2, 0)]
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.token_files(docs, queries.JSON, end_id=2, ids=False, literal=False).collect()] == [(1, 0, 2)]
