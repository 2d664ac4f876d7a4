"""Operators 1, 6 and 10 against brute force."""

import random
import re
from collections import defaultdict

import pytest

from atollkit.llm.components import components
from atollkit.llm.jaccard_join import jaccard_components
from atollkit.llm.substring_dedup import doubling, substring_dedup
from atollkit.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, block int, level string, bucket int, data binary"


def corpus(seed=0):
    r = random.Random(seed)
    vocab = ["the", "of", "é", "日本", "a", "bb", "ccc", "x" * 30] + ["w%d" % i for i in range(300)]
    sent = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, page = sent(60), sent(150)
    texts = [None, "", " \n\t ", "one two", page, page, page + " tail", sent(20) + "\n" + passage + " " + sent(15), sent(9) + " " + passage, passage + " " + passage, "a " * 200, "b" * 400, "ab" * 300]
    for _ in range(25):
        words = page.split()
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = r.choice(vocab)
        texts.append(" ".join(words))
    texts += [sent(r.randrange(1, 120)) for _ in range(30)] + [passage[:200].upper() + "  " + passage, "  ".join([sent(40)] * 3), "\t".join([sent(5)] * 30)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(10_000, page), (-5, passage), (10_000, "same id " + passage), (10_001, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "l", 2, b"d") for i, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_substring(rows, n):
    places = defaultdict(int)
    split = [words(t) for _, t in rows]
    for w in split:
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])] += 1
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = {i + k for i in range(len(w) - n + 1) if places[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("n", [35, 8, 17])
def test_substring_dedup(spark, docs, rows, n):
    got = sorted(tuple(r) for r in substring_dedup(docs, n).collect())
    assert got == brute_substring(rows, n)


def test_substring_levels():
    assert doubling(35) == [9, 18, 35] and doubling(8) == [8] and doubling(64) == [8, 16, 32, 64]


def brute_suffix(rows, n):
    first = {}
    for d, t in rows:
        w = (t or "").encode()
        for i in range(len(w) - n + 1):
            s = w[i : i + n]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode()
        g = bytearray(len(w))
        for i in range(len(w) - n + 1):
            if first[w[i : i + n]] < d:
                g[i : i + n] = b"\1" * n
        out.append((d, len(w), sum(g), sum(g[i] and not (i and g[i - 1]) for i in range(len(g))), bytes(a for a, m in zip(w, g, strict=True) if not m)))
    return sorted(out)


@pytest.mark.parametrize("n", [50, 33])
def test_suffix_dedup(spark, docs, rows, n):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, n).collect())
    assert got == brute_suffix(rows, n)


def test_dedup_of_nothing_and_null_ids(spark, docs):
    for f in (substring_dedup, suffix_dedup):
        assert f(docs.limit(0)).count() == 0
    page = "p q r s t u v w x y z " * 9
    two = spark.createDataFrame([(None, page), (None, page), (4, page + "q")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup(two).collect())
    assert got == [(False, 0), (True, len(page)), (True, len(page))]
    assert all(r.n_removed == r.n_words for r in substring_dedup(two.where("doc_id is null")).collect())


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_jaccard(rows, percent):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("percent", [80, 60])
def test_jaccard_components(spark, docs, rows, percent):
    got = sorted(tuple(r) for r in jaccard_components(docs, 5, percent).collect())
    assert got == brute_jaccard(rows, percent)


def test_jaccard_chain(spark):
    """Neighbours link, ends do not: one component all the same."""
    base = ["t%d" % i for i in range(200)]
    chain = [" ".join(base[i * 8 : i * 8 + 120]) for i in range(9)]
    rows = [(i, t) for i, t in enumerate(chain)]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_jaccard(rows, 80) and {r[2] for r in got} == {0}


def test_jaccard_of_nothing(spark, docs):
    assert jaccard_components(docs.limit(0)).count() == 0
    got = jaccard_components(spark.createDataFrame([(None, "a b"), (None, None), (3, "A b"), (3, "A b")], "doc_id long, text string")).collect()
    assert sorted((r.n_shingles, r.component_id or -1) for r in got) == [(0, -1), (1, 3), (1, 3), (1, 3)]


def test_components(spark):
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(60)] + [("a", "b"), ("c", "b"), ("x", "x")]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:04}"] for i in range(61)} == {"0000"} and got["c"] == "a" and got["x"] == "x"


def test_very_long_texts_and_repeated_rows(spark):
    """Whole texts of some hundred thousand words, and hundreds of equal rows, equal ids and null ids among them."""
    r = random.Random(4)
    vocab = ["w%d" % i for i in range(5000)]
    sent = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, long = sent(80), sent(120_000)
    near = long.split()
    near[7] = near[90_000] = "other"
    rows = [(1, long), (2, " ".join(near)), (3, sent(50_000) + " " + passage), (4, passage), (5, "x" * 300_000)]
    rows += [(6, passage + " end")] * 200 + [(None, "of " * 12)] * 50 + [(7, "")] * 50
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, crew int")
    got = [tuple(t) for t in substring_dedup(df, 35).collect()]
    assert len(got) == len(rows)
    by_id = {}
    for d, n, gone, kept in got:
        by_id.setdefault(d, set()).add((n, gone, kept))
    want = {}
    for d, n, gone, kept in brute_substring([(-1 if i is None else i, t) for i, t in rows], 35):
        want.setdefault(None if d == -1 else d, set()).add((n, gone, kept))
    assert by_id == want
    cut = {(t.doc_id, t.n_bytes, t.n_removed) for t in suffix_dedup(df, 50).collect()}
    assert (1, len(long), 0) in cut and (4, len(passage), len(passage)) in cut and {n for d, _, n in cut if d == 5} == {0}
    found = {(t.doc_id, t.component_id) for t in jaccard_components(df, 5, 80).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 4), (7, 7), (None, None)}
