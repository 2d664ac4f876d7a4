"""Operators 2, 5, 8 and 9 against brute force."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from atollkit.llm import bpe, queries, rules, token_files, warc

SCHEMA = "doc_id long, text string, lang string, block int, w string, m string"
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a  b \n c\t\td  ",
    "The of and.\nThe of and.\n\nThe of and.\n" * 3,
    "it's 1234 und ß — 日本語 \U0001f600 <|endoftext|> ### x_y z   end \x1c x",
    "word " * 40_000,
    "x" * 5000,
    " lead and trail ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "w", "m") for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None, None), (None, "two words", "en", 1, "w", "m")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, docs, empty):
    import tiktoken

    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe(docs, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            text = TEXTS[r.doc_id] or ""
            ids = enc.encode_ordinary(text)
            assert (r.n_tokens, bytes(r.ids), bytes(r.decoded)) == (len(ids), np.array(ids, "<u4").tobytes(), text.encode())
    for t in TEXTS:
        assert [i for p in bpe.cut(t or "", 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t or "")
    assert bpe.bpe(empty, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.JSON)
    tok.encode_special_tokens = True
    got = sorted(token_files.token_files(docs, queries.JSON, 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: -1 if x is None else x)
    start = 0
    for r in got:
        text = "two words" if r.doc_id is None else TEXTS[r.doc_id] or ""
        raw = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(raw) // 4, zlib.crc32(raw), raw)
        start += r.n_tokens
    assert token_files.token_files(empty, queries.JSON, 2).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    for n, v in ((1, 3), (2, 1), (500, 2), (5000, 4), (40_000, 300)):
        rows = [rng.integers(0, v, k).astype("<u4").tobytes() for k in rng.multinomial(n, [0.2, 0.5, 0.3]) + 1]
        raw = token_files.write_shard(0, 0, [5, None, 7], rows, 50_257, 15_000) + token_files.TRAILER
        s = token_files.Shard(raw, 0)
        assert [s.document(k).tobytes() for k in range(3)] == rows
        assert all(len(token_files.expand(np.array([s.first + i]), s.rules, s.lengths, s.first)) == s.lengths[i] for i in range(len(s.rules)))
    assert len(token_files.write_shard(0, 0, [1], [np.tile(np.arange(7), 9000).astype("<u4").tobytes()], 50_257, 15_000)) < 20_000


def test_repair_counts_pairs_exactly():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 30_000).astype(np.uint32) % 900
    ends = np.arange(100, 30_001, 100)
    most = token_files.LEAST
    symbols, at, rules, lengths = token_files.repair(ids, ends, 1000, 5000)
    assert (token_files.by_levels(symbols, rules, 1000) == ids).all() and at[-1] == len(symbols)
    pairs = Counter((a, b) for lo, hi in zip([0, *at[:-1]], at, strict=True) for a, b in zip(symbols[lo : hi - 1].tolist(), symbols[lo + 1 : hi].tolist(), strict=True))
    # Nothing frequent is left: only a pair that overlaps itself counts more often than it can be replaced.
    assert all(n < most or a == b and n < 2 * most for (a, b), n in pairs.items())
    with pytest.raises(ValueError, match="vocabulary"):
        token_files.write_shard(0, 0, [1], [np.array([7], "<u4").tobytes()], 7, 10)


def test_text_writer_keeps_all_bytes(spark, tmp_path):
    raw = bytes(range(256)) * 3 + b"\r\n\r\n"
    df = spark.createDataFrame([(bytearray(raw),)], "value binary").select(F.col("value").cast("string").alias("value"))
    df.write.option("encoding", "ISO-8859-1").option("lineSep", token_files.TRAILER.decode("latin-1")).text(str(tmp_path / "t"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "t").glob("part-*")) == raw + token_files.TRAILER


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    under = {i + k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under), len(w) < 10 or 100 * len(under) > 20 * len(w)


def test_rules(spark, docs, empty):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, sample, docs.withColumn("text", F.concat(F.col("text"), F.lit(" a b c d e a b c d e a b c d e x y z a b c d e")))):
        texts = df.select("doc_id", "text").collect()
        got = rules.quality_rules(df).select("doc.doc_id", "doc.text", "m.*", "base_failed", "kept").collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text or "")
            assert not (r.kept and r.base_failed)
    plan = rules.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert rules.kept_documents(docs).columns == docs.columns
    assert rules.quality_rules(empty).count() == 0


def test_rules_keep_clean_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.quality_rules(docs).select("doc.doc_id", "base_failed", "kept").join(labels, "doc_id")
    by = {(r.quality, r.kept): r["count"] for r in got.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.01 * by[1, True]
    assert by.get((0, True), 0) <= 0.25 * by.get((0, False), 1)


PAGES = [(1, "http://a/ x", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (0, None, "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 40_000), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")]


def b32(s):
    return base64.b32encode(hashlib.sha1(s).digest()).decode()


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    first = {}
    for i, _, html in sorted(PAGES, key=lambda p: p[0]):
        raw = (html or "").encode()
        one = first.setdefault(raw, i)
        r = got.pop(i)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), b32(raw), "response" if one == i else "revisit", None if one == i else one)
    assert not got
    least = {r.page_id: r.record_type for r in warc.warc_round_trip(pages, least=5).collect()}
    assert least[4] == "response" and least[1] == "revisit"
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_salvage():
    recs = [warc.record_bytes(i, "http://x", f"<p>{i}</p>".encode() * 50, b32(f"<p>{i}</p>".encode() * 50), None) for i in range(6)]
    gz = [gzip.compress(r) for r in recs]
    whole = list(warc.salvage(b"".join(gz)))
    assert [r["page_id"] for r in whole] == list(range(6)) and all(r["kind"] == "record" for r in whole)
    broken = bytearray(gz[2])
    broken[len(broken) // 2] ^= 0xFF
    raw = gz[0] + gz[1] + bytes(broken) + b"junk\x1f\x8b\x08junk" + gz[3] + warc.EMPTY_MEMBER + gz[4] + gz[5][:40]
    got = list(warc.salvage(raw))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 1, 3, 4]
    gaps = [r for r in got if r["kind"] == "gap"]
    assert gaps[0]["at"] == len(gz[0]) + len(gz[1]) and gaps[-1]["at"] + gaps[-1]["length"] == len(raw)
    plain = recs[0] + recs[1][:-30] + recs[2] + b"noise" + recs[3].replace(b"<p>3", b"<q>3", 1) + recs[4]
    got = list(warc.salvage(plain))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2, 4]
    assert sum(r["length"] for r in got if r["kind"] == "gap") == len(plain) - len(recs[0]) - len(recs[2]) - len(recs[4])
    assert list(warc.salvage(b"")) == []


def test_warc_odd_ids_and_files_by_bytes(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "v", "only null"), (None, "w", "only null"), (2, "x", "<p>a</p>")]
    rows += [(100 + i, "big", "".join(chr(0x4E00 + (i * 7919 + j * j) % 20000) for j in range(4000))) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, file_bytes=20_000)
    assert len(list((tmp_path / "w").glob("part-*"))) > 3
    got = warc.read_warc(spark, path).where("kind = 'record'").collect()
    assert spark.read.format("binaryFile").load(path).count() > 3 and len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in got if r.url != "big")
    assert kinds == sorted([(1, "response", -1), (1, "response", -1), (-1, "revisit", 1), (-1, "response", -1), (-1, "response", -1), (2, "revisit", 1)])


def test_texts_without_spaces_are_cut():
    text = ("日本語の文章です。" * 3 + "漢字，假名！abc") * 20_000
    parts = list(bpe.cut(text, 1 << 16))
    assert len(parts) > 5 and "".join(parts) == text
    enc = bpe.encoding(queries.RANKS, public_tokenizers.PATTERN)
    assert bpe.encode(text, queries.RANKS, public_tokenizers.PATTERN) == enc.encode_ordinary(text)
