"""Merkle manifests against a tree built level by level."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from atollkit.llm import queries
from atollkit.llm.merkle import Append, crc32_of_id, fold, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(made, i):
    out = []
    for level in made[:-1]:
        if i ^ 1 < len(level):
            out.append(level[i ^ 1])
        i //= 2
    return "".join(out)


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain(rows):
    """The contract, tree by tree."""
    order = lambda x: (x is not None, b"" if x is None else x.encode())
    langs = sorted({r[2] for r in rows}, key=order)
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    made = {x: levels([leaf(r) for r in t]) for x, t in trees.items()}
    top = levels([made[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(trees[x]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = leaf((*r[:3], r[3] + 1 if changed and r[3] is not None else r[3], *r[4:]))
            sub = levels([now if j == i else y for j, y in enumerate(made[x][0])])[-1][0]
            folded = levels([sub if j == k else y for j, y in enumerate(top[0])])[-1][0]
            out.append((r[0], leaf(r), made[x][-1][0], top[-1][0], path(made[x], i) + path(top, k), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def asked(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in manifest(df, crc32_of_id(F.col("doc_id")) % 7 == 0, **more).collect())


def made(n, langs):
    r = random.Random(n)
    return [(i, r.choice("ab"), r.choice(langs), r.choice([None, 3, 40]), r.choice([None, "", "é", "text " * 9])) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("n", [*range(1, 18), 31, 32, 33, 100])
def test_append_and_fold(n):
    nodes = [h(str(i)) for i in range(n)]
    a = Append(n)
    for x in nodes:
        a.add(x.encode())
    root = a.close().decode()
    want = levels(nodes)
    assert root == want[-1][0]
    for i in range(n):
        assert a.witness(i).decode() == path(want, i)
        assert fold(nodes[i].encode(), a.witness(i) + b"rest", i, n) == (root.encode(), b"rest")
        assert fold(b"other", a.witness(i), i, n)[0] != root.encode()


def test_witnesses_grow_as_siblings_come():
    """A node's witness so far is a part of what it will be."""
    nodes = [h(str(i)) for i in range(16)]
    want, a = levels(nodes), Append(16)
    for k, x in enumerate(nodes):
        a.add(x.encode())
        assert [o[0] for o in a.open] == [i for i in range(4, -1, -1) if (k + 1) >> i & 1]
        assert all(path(want, i).startswith(a.witness(i).decode()) for i in range(k + 1))


@pytest.mark.parametrize("block", [12, 1, 2])
def test_against_plain_trees(spark, block):
    """In one block a tree, and in blocks of two and four nodes over many rounds."""
    rows = made(70, ["en", None, "zz", "Ä", "de"]) + made(1, ["only one"])
    assert asked(spark, rows, levels=block) == plain(rows)


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 23}", i, "t") for i in range(60)]
    assert asked(spark, rows, levels=2) == plain(rows)


def test_nulls_ties_repeated_and_long_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 1, "x" * 300_000), (5, "s", "en", 1, "a"), (5, "s", "en", 2, "b"), (7, "s", "en", None, "")]
    rows += [(9, "s", "en", 3, "same")] * 9 + [(3, "s", "", 3, "empty lang")]
    assert asked(spark, rows, levels=2) == plain(rows)


def test_empty_and_single(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(1, "s", "en", 4, "t")]) == plain([(1, "s", "en", 4, "t")])


def test_query_finds_what_was_tampered_with(spark, tmp_path):
    rows = made(90, ["en", "fr"])
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    bad = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert {r.doc_id for r in got if not r.verified} == bad != set()
    proofs = {r.doc_id: r.proof for r in manifest(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(r.proof_sha256 == h(proofs[r.doc_id]) for r in got)
    assert manifest(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("not verified").count() == 0
