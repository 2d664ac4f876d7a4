"""Operator 10: n-gram Jaccard join over a token-group matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.llm.common import U, Words, blocked, mix, pack, pinned, prefix_sums, runs, skew_join, spans_hash, unpack, windows_hash
from atollkit.llm.components import components, nearer
from atollkit.llm.exchange import deal, rounds

#: Members of a group, and queries that open it together, aimed at.
GROUP, QUERIES = 512, 512
#: Bytes of tokens in a group, at most (a larger set is alone).
GROUP_BYTES = 16 << 20
#: Bytes kept of a token: two of a pair's tokens meet by chance with odds of about 1 in 10**9. Bytes of it that a bucket is asked about.
WIDTH, ASKED = 6, 3


def prefix_length(n, percent: int):
    """Tokens of the rarest-first prefix that any two linked sets must share one of."""
    return n - -(-percent * n // 100) + 1


class Sets:
    """Distinct shingle hashes of each document of a block: flat arrays in document order, ascending in each."""

    def __init__(self, rows: list[bytes], n: int):
        flat, sizes = [np.zeros(0, U)], []
        for lo, hi in runs(rows):
            w = Words(rows[lo:hi], lower=True)
            sums = prefix_sums(w.hash, 1)
            first, count = w.first[:-1], w.count
            owner = w.owner()
            m = len(owner) - n + 1
            at = np.flatnonzero(owner[:m] == owner[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
            short = np.flatnonzero((count > 0) & (count < n))
            h = np.concatenate([windows_hash(sums, n, 1)[at], spans_hash(sums, first[short], first[short] + count[short], 1)])
            d = np.concatenate([owner[at], short])
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)]
            flat.append(h[new])
            sizes.append(np.bincount(d[new], minlength=hi - lo))
        self.flat = np.concatenate(flat)
        self.size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])


def frequency_classes(blocks: list[int], datas: list[bytes]) -> list[bytes]:
    """For each block's tokens a class of their frequency: 0 for one document, then quarters of powers of two.

    Frequency is the number of blocks that hold a token, twice counted where several documents of the block do: it only orders tokens, every
    document sees the same order, and tokens that meet by chance only count as more frequent than they are."""
    sizes = [8 * len(d) // (8 * ASKED + 1) for d in datas]
    token = np.concatenate([unpack(d[: ASKED * n], ASKED) for d, n in zip(datas, sizes, strict=True)]).astype(np.uint32)
    count = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8, -1, ASKED * n), count=n) for d, n in zip(datas, sizes, strict=True)]).astype(np.int64) + 1
    order = np.argsort(token, kind="stable")
    s = token[order]
    group = np.cumsum(np.append(False, s[1:] != s[:-1]))
    total = np.bincount(group, weights=count[order])
    out = np.empty(len(s), np.uint8)
    out[order] = np.minimum(255, 4 * np.log2(total)).astype(np.uint8)[group]
    return [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]


def shingle_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cls (a digest of the set), lone, tokens, gkey and gkey2 (of the most frequent tokens) of every document.

    Tokens come rarest first, WIDTH bytes each; lone of them occur in one document alone. tokens is null where so many are lone that no other
    set can be similar enough."""
    rows, blocks = blocked(docs)
    buckets = max(48, blocks // 4)

    def ask(level, ids, texts, got):
        keys, counts = np.unique(Sets(texts, n).flat, return_counts=True)
        c = deal(keys, buckets)
        return [(b, pack(keys[c[b] : c[b + 1]], ASKED) + np.packbits(counts[c[b] : c[b + 1]] > 1).tobytes()) for b in range(buckets) if c[b + 1] > c[b]]

    def finish(ids, texts, rest, got):
        s = Sets(texts, n)
        keys, inverse = np.unique(s.flat, return_inverse=True)
        c, answer = deal(keys, buckets), got.get(0, {})
        rare = np.concatenate([np.frombuffer(answer[b], np.uint8) for b in range(buckets) if c[b + 1] > c[b]] or [np.zeros(0, np.uint8)])[inverse]
        mixed = mix(s.flat ^ U(0xA0761D6478BD642F))
        sums, sums2 = np.concatenate([[U(0)], np.cumsum(s.flat)]), np.concatenate([[U(0)], np.cumsum(mixed)])
        digests = [(x[s.at[1:]] - x[s.at[:-1]]).tolist() for x in (sums, sums2)]
        cls, lone, tokens, gkeys = [], [], [], [[], []]
        for lo, hi, one, two in zip(s.at[:-1], s.at[1:], *digests, strict=True):
            size = int(hi - lo)
            r = rare[lo:hi]
            alone = int((r == 0).sum())
            gkeys[0].append(None)
            gkeys[1].append(None)
            lone.append(alone)
            if not size or alone >= prefix_length(size, percent):
                cls.append(None)
                tokens.append(None)
                continue
            cls.append(f"{one:016x}{two:016x}{size:x}")
            kept = s.flat[lo:hi][np.lexsort((s.flat[lo:hi], r))]
            tokens.append(pack(kept, WIDTH))
            gkeys[0][-1], gkeys[1][-1] = int(kept[-1] >> U(1)), int(kept[-2:][0] >> U(1))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(s.size, pa.int64()), "cls": pa.array(cls, pa.string()), "lone": pa.array(lone, pa.int32()), "tokens": pa.array(tokens, pa.binary()), "gkey": pa.array(gkeys[0], pa.int64()), "gkey2": pa.array(gkeys[1], pa.int64())})

    return rounds(rows, blocks, buckets, ask, [frequency_classes], finish, "doc_id long, n_shingles long, cls string, lone int, tokens binary, gkey long, gkey2 long")


def _sorted(raw: bytes) -> np.ndarray:
    return np.sort(unpack(raw, WIDTH))


def _shared(q: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens of q in each of the sets flat[at[i]:at[i + 1]]."""
    k = np.minimum(np.searchsorted(q, flat), len(q) - 1)
    hits = np.concatenate([[0], np.cumsum(q[k] == flat)])
    return hits[at[1:]] - hits[at[:-1]]


MEMBERS = "cls string, rep long, lone int, tokens binary, comp string, gid string"


def with_groups(classes: DataFrame, percent: int) -> DataFrame:
    """classes in groups: MEMBERS with gid (their group) and comp.

    Sets are dealt out by ranges of their two most frequent tokens and sorted by them, and each run of GROUP sets at most is a group: so
    similar sets stand together, a token that most sets share makes many groups, and rare ones share a group. Within a
    group every link is found, so sets that are linked there, directly or by others, have one comp (its least cls)."""
    parts = max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["gkey", "gkey2", "cls"]
    rows = classes.select(*order, "rep", "lone", "tokens").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        held, n, size, key = [], 0, 0, None
        for b in batches:
            keys, sizes = b.column("gkey").to_pylist(), pc.binary_length(b.column("tokens")).to_pylist()
            lo = 0
            for i, (k, more) in enumerate(zip(keys, sizes, strict=True)):
                if n and (n >= GROUP or size + more > GROUP_BYTES or (n >= GROUP // 2 and k != key)):
                    held.append(b.slice(lo, i - lo))
                    yield from linked(held, percent).to_batches()
                    held, n, size, lo = [], 0, 0, i
                n, size, key = n + 1, size + more, k
            held.append(b.slice(lo))
        if n:
            yield from linked(held, percent).to_batches()

    return rows.mapInArrow(run, MEMBERS)


def linked(rows: list[pa.RecordBatch], percent: int) -> pa.Table:
    """The sets of a group with their comp; the group's name is that of its first set."""
    t = pa.Table.from_batches(rows).sort_by("cls")
    names = t.column("cls").to_pylist()
    comp = np.arange(len(names))
    if len(names) > 1:
        sets = [unpack(x, WIDTH) for x in t.column("tokens").to_pylist()]
        size = np.array([len(x) for x in sets])
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        column = np.cumsum(count > 1) - 1  # tokens of one set alone add nothing
        shared = count[token] > 1
        token, owner = column[token[shared]], owner[shared]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
            a, b = np.searchsorted(token, (lo, lo + 2048))
            m = np.zeros((len(sets), 2048), np.float32)
            m[owner[a:b], token[a:b] - lo] = 1
            both += m @ m.T
        link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, True)
        while True:
            least = np.where(link, comp[None, :], len(names)).min(1)
            least = least[least]
            if (least == comp).all():
                break
            comp = least
    return pa.table({**{c: t.column(c) for c in ("cls", "rep", "lone", "tokens")}, "comp": pa.array([names[i] for i in comp], pa.string()), "gid": pa.array(names[:1] * len(names), pa.string())})


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cls, token) for the tokens of each set's prefix that other documents have too."""
    def run(batches):
        for b in batches:
            cls, tok = [], []
            for c, lone, raw in zip(b.column("cls").to_pylist(), b.column("lone").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                x = unpack(raw, WIDTH).astype(np.int64)
                x = x[lone : prefix_length(len(x), percent)]
                tok.append(x)
                cls += [c] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.string()), pa.array(np.concatenate(tok) if tok else [], pa.int64())], ["cls", "token"])

    return sets.select("cls", "lone", "tokens").mapInArrow(run, "cls string, token long")


def links_between(sets: DataFrame, comps: DataFrame, percent: int, first: bool = False) -> DataFrame:
    """(a, b): components a and b in which some pair of sets links. sets has cls, gid, lone and tokens, comps what merged() gives.

    A set asks the groups that share a token of its prefix and hold a set of a larger component (ties by name), so each pair
    of components is asked in one direction. Tokens that stand in the same groups ask as one. The group's token union bounds the overlap;
    groups that qualify are opened. With first, a token names one group alone, that of its largest component: a
    pass whose rows are no more than the prefixes' tokens, and which joins most of what is linked."""
    ranked = comps.select("cls", "gid", F.struct("members", "comp").alias("at"))
    rows = skew_join(prefixes(sets, percent), ranked, "cls", "inner").select("token", "cls", "gid", "at")
    ends = rows.groupBy("token").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low != high")
    rows = pinned(skew_join(rows, ends, "token", "inner"))
    asking, asked = rows.where("at < high").select("token", "cls", "at"), rows.where("at > low")
    if first:
        asked = asked.groupBy("token").agg(F.max(F.struct("at", "gid")).alias("top")).select("token", F.col("top.gid").alias("gid"), F.col("top.at").alias("most"))
    else:
        asked = asked.groupBy("token", "gid").agg(F.max("at").alias("most"))
    # Tokens with equal lists of groups, by 128 bits: the least of them stands for all.
    print_ = lambda salt: F.sum(F.xxhash64("gid", "most", F.lit(salt)).cast("decimal(20,0)"))
    lists = asked.groupBy("token").agg(F.count("*").alias("n"), print_("a").alias("p"), print_("b").alias("q"))
    least = lists.groupBy("n", "p", "q").agg(F.min("token").alias("stands"))
    names = pinned(lists.join(least, ["n", "p", "q"]).select("token", "stands"))
    asking = skew_join(asking, names, "token", "inner").select(F.col("stands").alias("token"), "cls", "at").distinct()
    asked = asked.join(names.where("token = stands").select("token"), "token")
    opened = pinned(skew_join(asking, asked, "token", "inner").where("at < most").select("cls", "at", "gid").distinct())
    count = opened.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    opened = skew_join(opened, count, "gid").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    queries = skew_join(opened, sets.select("cls", "tokens"), "cls", "inner").select("gid", "part", F.col("at.members").alias("members"), F.col("at.comp").alias("comp"), "tokens")
    held = skew_join(sets.select("cls", "gid", "tokens"), count, "gid", "inner").select("cls", "gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "tokens")
    held = skew_join(held, ranked.select("cls", "at"), "cls", "inner").select("gid", "part", F.col("at.members").alias("members"), F.col("at.comp").alias("comp"), "tokens")

    def check(key, q, g):
        sets_ = [_sorted(x) for x in g.column("tokens").to_pylist()]
        flat = np.concatenate(sets_) if sets_ else np.zeros(0, U)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets_])]).astype(np.int64)
        size, union = np.diff(at), np.unique(flat)
        place = list(zip(g.column("members").to_pylist(), g.column("comp").to_pylist(), strict=True))
        found = set()
        for raw, *mine in zip(*(q.column(c).to_pylist() for c in ("tokens", "members", "comp")), strict=True) if len(union) else ():
            x = _sorted(raw)
            if 100 * int(_shared(x, union, np.array([0, len(union)]))[0]) < percent * len(x):
                continue
            both = _shared(x, flat, at)
            linked = np.flatnonzero(100 * both >= percent * (len(x) + size - both))
            found.update((mine[1], place[i][1]) for i in linked if place[i] > tuple(mine))
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string())})

    held = held.toDF(*held.columns)  # columns of its own: both sides come from sets
    return queries.groupBy("gid", "part").cogroup(held.groupBy("gid", "part")).applyInArrow(check, "a string, b string").distinct()


def merged(comps: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """comps (cls, rep, gid, comp) with the components that labels (id, comp) rename, and members, the number of a component's sets."""
    if labels is not None:
        comps = skew_join(comps.select("cls", "rep", "gid", "comp"), labels.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp").withColumn("comp", F.coalesce("to", "comp"))
    sizes = comps.groupBy("comp").agg(F.count("*").alias("members"))
    return pinned(skew_join(comps.select("cls", "rep", "gid", "comp"), sizes, "comp").select("cls", "rep", "gid", "comp", "members"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every document.

    A set holds the distinct n-word shingles of the text with A-Z lower-cased, or its whole word sequence where it has
    fewer words. Two sets link when 100 * |both| >= percent * |either|. Null and empty texts have empty sets and
    link with nothing. Equal sets form one class, whose copies are never expanded into pairs. Repeated rows link with each
    other; a null id's component is the smallest id linked with it, or null.

    1. every token's frequency, by packed exchange; sets with too many tokens of their own fall out;
    2. classes of equal sets; groups of similar ones, within which all links are found;
    3. across groups, first with one group a token, then with all: prefix tokens name candidate groups, the token union of a
       group bounds the overlap, qualifying groups are opened and checked exactly.
    Only links within one component are left out, so no component is lost. Two texts' tokens meet by chance with odds of about 1 in
    10**9 a pair of texts (48 bits a token), two sets' digests with 1 in 10**38."""
    sets = pinned(shingle_sets(docs, n, percent))
    live = sets.where("tokens is not null")
    classes = live.groupBy("cls").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("lone", "tokens", "gkey", "gkey2")))
    members = pinned(with_groups(classes, percent))
    comps = merged(members)
    # The first pass only saves work: what it leaves apart the second one finds again.
    comps = merged(comps, nearer(pinned(links_between(members, comps, percent, first=True))))
    labels = components(pinned(links_between(members, comps, percent)))
    comps = skew_join(comps.select("cls", "rep", "comp"), labels.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp").withColumn("comp", F.coalesce("to", "comp"))
    least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = skew_join(comps.select("cls", "comp"), least, "comp").select("cls", "component_id")
    alone = sets.where("tokens is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    held = skew_join(live.select("doc_id", "n_shingles", "cls"), by_class, "cls").select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(held)


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one document of each component, that with the smallest doc_id; equal rows of it are one.

    Rows without an id cannot be named by a component: they stay. Texts are compared only where several rows share an id."""
    found = jaccard_components(docs, n, percent)
    keep = pinned(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    of = lambda ids: docs.where(F.col("doc_id").isNotNull()).join(ids.select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    once, more = of(keep.where("n = 1")), of(keep.where("n > 1")).dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).unionByName(docs.where(F.col("doc_id").isNull()))
