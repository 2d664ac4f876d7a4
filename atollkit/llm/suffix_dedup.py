"""Operator 6: suffix-array dedup by prefix-free parsing.

A rolling hash over `k` bytes triggers at the smallest value among the k-grams of each `length`-byte window, so a window always
holds its trigger whole, and equal windows hold it at the same place. The windows of one trigger lie side by
side: together they are a phrase. Phrases are the dictionary, their occurrences in id order the parse. As a phrase is as
long as its last window reaches, suffixes of dictionary phrases decide the corpus order to depth `length`:

1. triggers met in one document alone fall out;
2. the parse is put in the order of (trigger, phrase, id): a phrase's first document is known, all later ones lose all its
   windows;
3. where one trigger has several phrases, their first occurrences enter a suffix array of the dictionary, whose
   neighbours that share `length` bytes form classes; a window goes if its class has a smaller id.

No task gathers a trigger: where a trigger has more than HOT phrases (a short string that many documents have in different surroundings)
its phrases meet by trigger and phrase, and each distinct window of them is a dictionary phrase of its own, dealt out by its own hash. Step 1
counts the phrases of each trigger, so those of all others meet by their trigger and nothing is asked about it apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atollkit.llm.common import BYTE, U, blocked, mix, pack, prefix_sums, runs, sliding_min, spans_hash, unpack, windows_hash
from atollkit.llm.exchange import bits, deal, meets, rounds

LAST = (1 << 63) - 1
#: A trigger with more phrases than this, about 1.3 MB of text, has its windows dealt out one by one: that takes more bytes, but no task holds them together.
HOT = 1 << 14


class Parse:
    """Phrases of some texts of a block: first and last window start, trigger and phrase hashes, text number."""

    def __init__(self, rows: list[bytes], length: int, k: int):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = np.frombuffer(b"".join(rows), np.uint8)
        n = len(self.raw)
        change = np.zeros(n + 1, np.int8)
        whole = sizes >= length
        np.add.at(change, self.at[:-1][whole], 1)
        np.add.at(change, (self.at[1:] - length + 1)[whole], -1)
        idx = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(idx):
            self.lo = self.hi = self.doc = np.zeros(0, np.int64)
            self.trigger = self.phrase = np.zeros(0, U)
            return
        c = prefix_sums(BYTE[self.raw], 0)
        h = windows_hash(c, k, 0)
        shift = U(n.bit_length())
        v = ((h >> shift) << shift) | np.arange(len(h)).astype(U)
        t = (sliding_min(v, length - k + 1)[idx] & ((U(1) << shift) - U(1))).astype(np.int64)
        begin = np.flatnonzero((np.diff(t, prepend=-1) != 0) | (np.diff(idx, prepend=-9) != 1))
        self.lo, self.hi = idx[begin], idx[np.append(begin[1:], len(idx)) - 1]
        self.doc = np.searchsorted(self.at, self.lo, "right") - 1
        self.trigger = mix(h[t[begin]])  # least values crowd near 0: mixed again, buckets get equal shares
        self.phrase = spans_hash(c, self.lo, self.hi + length, 0)

    def keep(self, mask: np.ndarray) -> None:
        self.lo, self.hi, self.doc, self.trigger, self.phrase = (x[mask] for x in (self.lo, self.hi, self.doc, self.trigger, self.phrase))


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` bytes (8 at least), by prefix doubling; equal ranks share them.

    The order of the ranks is the suffix array to that depth."""
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel()
    rank, have = np.unique(words, return_inverse=True)[1].astype(U), 8
    while have < depth:
        step = min(have, depth - have)
        n = len(rank) - step
        rank, have = np.unique((rank[:n] << U(32)) | rank[step:], return_inverse=True)[1].astype(U), have + step
    return rank[: len(text)]


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def met(datas: list[bytes], hot_from: int) -> list[bytes]:
    """For each block's triggers whether another block has them, and whether they may have more than hot_from phrases in all (the
    numbers of phrases of triggers that agree in the bytes sent are added up)."""
    sizes = [int(np.frombuffer(d, "<u4", 1)[0]) for d in datas]
    keys, counts = [unpack(d[4 : 4 + 3 * n], 3) for d, n in zip(datas, sizes, strict=True)], []
    for d, n in zip(datas, sizes, strict=True):
        counts.append(np.ones(n, np.int64))
        more = np.unpackbits(np.frombuffer(d, np.uint8, -(-n // 8), 4 + 3 * n), count=n).astype(bool)
        counts[-1][more] = np.frombuffer(d, "<u2", -1, 4 + 3 * n + -(-n // 8))
    which = np.unique(np.concatenate(keys), return_inverse=True)[1]
    total = np.bincount(which, weights=np.concatenate(counts))
    wide = np.split((total > hot_from)[which], np.cumsum(sizes)[:-1])
    return [np.packbits(m).tobytes() + np.packbits(w).tobytes() for m, w in zip(meets(keys), wide, strict=True)]


def parse_order(blocks: list[int], datas: list[bytes], hot_from: int | None = None) -> list[bytes]:
    """For each block's phrases that fall to this bucket whether an earlier document has the phrase and whether this is its first, and
    for the wide triggers whether they have several phrases and whether more than HOT (or hot_from).

    Phrases of a wide trigger are dealt out by trigger and phrase, so they spread; of the trigger only a summary meets: a block's number of phrases,
    the least and the greatest. All phrases of any other trigger are here: if it has a single one, that is no first."""
    heads, ones, narrow = zip(*(np.frombuffer(d, "<u4", 3).tolist() for d in datas), strict=True)
    parts = [(d[12 : 12 + 20 * n], d[12 + 20 * n :]) for d, n in zip(datas, heads, strict=True)]
    cut = [(unpack(a[: 6 * n], 6), unpack(a[6 * n : 12 * n], 6), from_planes(a[12 * n :]), np.arange(n) < k) for (a, _), n, k in zip(parts, heads, narrow, strict=True)]
    trigger, phrase, doc, here = (np.concatenate([c[i] for c in cut]) for i in range(4))
    order = np.lexsort((doc, phrase, trigger))
    t, p, d = trigger[order], phrase[order], doc[order]
    new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))[: len(t)]
    first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    begin = np.append(True, t[1:] != t[:-1])[: len(t)]
    single = (np.bincount(np.cumsum(begin) - 1, weights=new) == 1)[np.cumsum(begin) - 1]  # a trigger's only phrase
    later, is_first = np.empty(len(d), bool), np.empty(len(d), bool)
    later[order], is_first[order] = first < d, (first == d) & ~(single & here[order])

    cut, counts = [], []
    for (_, b), k in zip(parts, ones, strict=True):  # k triggers of one phrase, then those of several
        one, b = b[: 11 * k], b[11 * k :]
        m = len(b) // 20
        cut += [(unpack(one[: 6 * k], 6), *[unpack(one[6 * k :], 5)] * 2, np.ones(k, np.int64)), (unpack(b[: 6 * m], 6), unpack(b[6 * m : 11 * m], 5), unpack(b[11 * m : 16 * m], 5), np.frombuffer(b, "<u4", m, 16 * m).astype(np.int64))]
        counts.append(k + m)
    trigger, least, most, number = (np.concatenate([c[i] for c in cut]) for i in range(4))
    order = np.argsort(trigger, kind="stable")
    t = trigger[order]
    several, hot = np.zeros(len(t), bool), np.zeros(len(t), bool)
    if len(t):
        new = np.append(True, t[1:] != t[:-1])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        several[order] = (np.minimum.reduceat(least[order], starts) != np.maximum.reduceat(most[order], starts))[group]
        hot[order] = (np.add.reduceat(number[order], starts) > (HOT if hot_from is None else hot_from))[group]
    split = lambda x, n: np.split(x, np.cumsum(n)[:-1])
    return [np.packbits(np.concatenate(x)).tobytes() for x in zip(split(later, heads), split(is_first, heads), split(several, counts), split(hot, counts), strict=True)]


def dictionary_order(length: int):
    """For each block's dictionary phrases: which of their windows a document with a smaller id has."""

    def reply(blocks: list[int], datas: list[bytes]) -> list[bytes]:
        docs, sizes, texts, counts = [], [], [], []
        for raw in datas:
            n = int(np.frombuffer(raw, "<u4", 1)[0])
            docs.append(np.frombuffer(raw, "<u8", n, 4))
            sizes.append(np.frombuffer(raw, "<u2", n, 4 + 8 * n).astype(np.int64))
            texts.append(np.frombuffer(raw, np.uint8, -1, 4 + 10 * n))
            counts.append(int((sizes[-1] - length + 1).sum()))
        doc, size, text = np.concatenate(docs), np.concatenate(sizes), np.concatenate(texts)
        windows = size - length + 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        first = np.concatenate([[0], np.cumsum(windows)[:-1]])
        at = np.repeat(start - first, windows) + np.arange(int(windows.sum()))
        rank = suffix_ranks(text, length)[at].astype(np.int64)
        own = np.repeat(doc, windows)
        least = np.full(int(rank.max()) + 1, np.iinfo(np.uint64).max, U)
        np.minimum.at(least, rank, own)
        return [np.packbits(x).tobytes() for x in np.split(least[rank] < own, np.cumsum(counts)[:-1])]

    return reply


class State:
    """The rounds of one block, as far as answers are known."""

    def __init__(self, ids: list, rows: list[bytes], length: int, k: int, buckets: int):
        self.length, self.buckets = length, buckets
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.order_ids = (self.ids.astype(np.uint64)) ^ U(1 << 63)  # unsigned, in the order of ids
        self.spans = list(runs(rows))
        self.parses = [Parse(rows[lo:hi], length, k) for lo, hi in self.spans]

    def triggers(self):
        parts = [np.stack([p.trigger, (p.doc + lo).astype(U)], 1) for (lo, _), p in zip(self.spans, self.parses, strict=True)]
        pair = np.concatenate(parts) if parts else np.zeros((0, 2), U)
        ids = self.order_ids[pair[:, 1].astype(np.int64)] if len(pair) else np.zeros(0, U)
        order = np.lexsort((ids, pair[:, 0]))
        key, ids = pair[order, 0], ids[order]
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        self.keys = key[new]
        self.own = np.zeros(len(self.keys), bool)
        if len(key) > 1:
            self.own[(np.cumsum(new) - 1)[1:][(key[1:] == key[:-1]) & (ids[1:] != ids[:-1])]] = True
        self.cuts = deal(self.keys, self.buckets)

    def numbers(self) -> list[tuple[int, bytes]]:
        """Triggers for each bucket of met(), with how many phrases they have here (65,535 at most) where that is more than one."""
        t = np.concatenate([p.trigger for p in self.parses] or [np.zeros(0, U)])
        x = np.concatenate([p.phrase for p in self.parses] or [np.zeros(0, U)])
        at = np.searchsorted(self.keys, t)
        often = np.bincount(at, minlength=len(self.keys)) > 1
        at, x = at[often[at]], x[often[at]]
        order = np.lexsort((x, at))
        at, x = at[order], x[order]
        new = np.append(True, (at[1:] != at[:-1]) | (x[1:] != x[:-1]))[: len(at)].astype(bool)
        number = np.minimum(np.bincount(at[new], minlength=len(self.keys)), 65535)
        out = []
        for b in range(self.buckets):
            lo, hi = self.cuts[b], self.cuts[b + 1]
            if hi > lo:
                n = number[lo:hi]
                out.append((b, np.uint32(hi - lo).tobytes() + pack(self.keys[lo:hi], 3) + np.packbits(n > 1).tobytes() + n[n > 1].astype("<u2").tobytes()))
        return out

    def drop_lonely(self, got: dict[int, bytes], wide: dict[int, bytes] | None = None):
        """got, wide: flags of triggers that others have, and of those that may have more than HOT phrases (all, if that was not asked)."""
        live = bits(got, self.cuts) | self.own
        self.wide_keys = self.keys if wide is None else self.keys[bits(wide, self.cuts)]
        for p in self.parses:
            p.keep(live[np.searchsorted(self.keys, p.trigger)])

    def phrases(self):
        """Distinct (trigger, phrase) with their smallest id in this block, in that order."""
        self.doc = np.concatenate([self.order_ids[p.doc + lo] for (lo, _), p in zip(self.spans, self.parses, strict=True)] or [np.zeros(0, U)])
        t = np.concatenate([p.trigger for p in self.parses] or [np.zeros(0, U)])
        x = np.concatenate([p.phrase for p in self.parses] or [np.zeros(0, U)])
        order = np.lexsort((self.doc, x, t))
        st, sx = t[order], x[order]
        new = (np.append(True, (st[1:] != st[:-1]) | (sx[1:] != sx[:-1])) if len(st) else np.zeros(0, bool)).astype(bool)
        self.entry = np.empty(len(t), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]  # the occurrence with the smallest id
        self.e_trigger, self.e_phrase, self.e_doc = t[self.first], x[self.first], self.doc[self.first]
        self.e_wide = np.isin(self.e_trigger, self.wide_keys)
        key = np.where(self.e_wide, mix(self.e_trigger ^ mix(self.e_phrase)), self.e_trigger)
        self.dealt = np.argsort(key, kind="stable")  # phrases in the order in which they are dealt out
        self.e_cuts = deal(key[self.dealt], self.buckets)
        begin = np.flatnonzero(np.append(True, self.e_trigger[1:] != self.e_trigger[:-1])[: len(self.e_trigger)])
        self.t_number = np.diff(begin, append=len(self.e_trigger))
        self.t_key = self.e_trigger[begin]
        seen = (1 << 40) - 1  # as much of a phrase as tells those of a trigger apart
        low = self.e_phrase & U(seen)
        self.t_least, self.t_most = (f.reduceat(low, begin) if len(begin) else low[:0] for f in (np.minimum, np.maximum))
        self.t_wide = np.flatnonzero(self.e_wide[begin])
        self.t_cuts = deal(self.t_key[self.t_wide], self.buckets)

    def told(self, b: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Phrases and wide triggers that bucket b is asked about, in their order, how many triggers come first that have one phrase here, and how
        many phrases come first whose trigger is not wide."""
        e, t = self.dealt[self.e_cuts[b] : self.e_cuts[b + 1]], self.t_wide[self.t_cuts[b] : self.t_cuts[b + 1]]
        one, wide = self.t_number[t] == 1, self.e_wide[e]
        return np.concatenate([e[~wide], e[wide]]), np.concatenate([t[one], t[~one]]), int(one.sum()), int((~wide).sum())

    def questions(self) -> list[tuple[int, bytes]]:
        """Phrases and wide triggers for each bucket of parse_order()."""
        out = []
        for b in range(self.buckets):
            e, t, k, narrow = self.told(b)
            if len(e) or len(t):
                phrases = pack(self.e_trigger[e], 6) + pack(self.e_phrase[e], 6) + planes(self.e_doc[e])
                one, more = t[:k], t[k:]
                triggers = pack(self.t_key[one], 6) + pack(self.t_least[one], 5) + pack(self.t_key[more], 6) + pack(self.t_least[more], 5) + pack(self.t_most[more], 5) + self.t_number[more].astype("<u4").tobytes()
                out.append((b, np.array([len(e), k, narrow], "<u4").tobytes() + phrases + triggers))
        return out

    def parsed(self, got: dict[int, bytes]):
        self.later, first = np.zeros(len(self.first), bool), np.zeros(len(self.first), bool)
        several, hot = np.ones(len(self.t_key), bool), np.zeros(len(self.t_key), bool)
        several[self.t_wide] = False  # of other triggers with one phrase none is a first
        for b, data in got.items():
            e, t, *_ = self.told(b)
            n, m = len(e), len(t)
            x = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * (n + m)).astype(bool)
            self.later[e], first[e], several[t], hot[t] = x[:n], x[n : 2 * n], x[2 * n : 2 * n + m], x[2 * n + m :]
        of = np.repeat(np.arange(len(self.t_key)), self.t_number)
        self.chosen = np.flatnonzero(first & several[of])
        self.hot = hot[of][self.chosen]
        lo = np.concatenate([p.lo for p in self.parses] or [np.zeros(0, np.int64)])
        hi = np.concatenate([p.hi for p in self.parses] or [np.zeros(0, np.int64)])
        self.c_windows = (hi - lo + 1)[self.first[self.chosen]]
        self.cold = np.flatnonzero(~self.hot)
        self.c_cuts = deal(self.e_trigger[self.chosen[self.cold]], self.buckets)
        self.windows()

    def windows(self):
        """The distinct windows of hot triggers' phrases, dealt out by their own hashes: those of one trigger spread, and a window is one entry a block, with its
        smallest id there."""
        at = np.flatnonzero(self.hot)
        spans = self.spans_of(at)
        count = self.c_windows[at]
        text = np.concatenate([*spans, np.zeros(0, np.uint8)])
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        start = np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        hashes = [(np.zeros(0, U), np.zeros(0, U))]
        for lo, hi in runs(spans):
            part = np.concatenate(spans[lo:hi])
            own = start[int(count[:lo].sum()) : int(count[:hi].sum())] - int(size[:lo].sum())
            hashes.append(tuple(windows_hash(prefix_sums(BYTE[part], which), self.length, which)[own] for which in (0, 1)))
        one, two = (np.concatenate(x) for x in zip(*hashes, strict=True))
        own = np.repeat(self.e_doc[self.chosen[at]], count)
        order = np.lexsort((own, two, one))
        new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))[: len(order)]
        self.w_of = np.empty(len(order), np.int64)
        self.w_of[order] = np.cumsum(new) - 1
        self.w_doc = own[order][new]
        self.w_text = np.lib.stride_tricks.sliding_window_view(text, self.length)[start[order][new]] if len(order) else np.zeros((0, self.length), np.uint8)
        self.w_before = self.w_doc[self.w_of] < own  # an earlier document of this block has it
        self.w_cuts = deal(one[order][new], self.buckets)

    def spans_of(self, at: np.ndarray) -> list[np.ndarray]:
        """Bytes of the given ones of the chosen phrases."""
        edge = np.cumsum([0, *(len(p.lo) for p in self.parses)])
        first = self.first[self.chosen[at]]
        where = np.searchsorted(edge, first, "right") - 1
        out = []
        for e, r in zip(first.tolist(), where.tolist(), strict=True):
            p = self.parses[r]
            i = e - edge[r]
            out.append(p.raw[p.lo[i] : p.hi[i] + self.length])
        return out

    def dictionary(self) -> list[tuple[int, bytes]]:
        out, spans = [], self.spans_of(self.cold)
        for b in range(self.buckets):
            lo, hi, x, y = self.c_cuts[b], self.c_cuts[b + 1], self.w_cuts[b], self.w_cuts[b + 1]
            n = hi - lo + y - x
            if n:
                docs = np.concatenate([self.e_doc[self.chosen[self.cold[lo:hi]]], self.w_doc[x:y]])
                sizes = np.array([*map(len, spans[lo:hi]), *[self.length] * int(y - x)], "<u2")
                out.append((b, b"".join([np.uint32(n).tobytes(), docs.astype("<u8").tobytes(), sizes.tobytes(), *(z.tobytes() for z in spans[lo:hi]), self.w_text[x:y].tobytes()])))
        return out

    def gone(self, got: dict[int, bytes]) -> list[np.ndarray]:
        """For each run of texts, which bytes go."""
        flags = [np.zeros(0, bool)] * len(self.chosen)
        at = np.concatenate([[0], np.cumsum(self.c_windows[self.cold])])
        single = np.zeros(len(self.w_doc), bool)
        for b, data in got.items():
            lo, hi, x, y = self.c_cuts[b], self.c_cuts[b + 1], self.w_cuts[b], self.w_cuts[b + 1]
            n = int(at[hi] - at[lo])
            told = np.unpackbits(np.frombuffer(data, np.uint8), count=n + int(y - x)).astype(bool)
            for e in range(lo, hi):
                flags[self.cold[e]] = told[at[e] - at[lo] : at[e + 1] - at[lo]]
            single[x:y] = told[n:]
        hot = np.flatnonzero(self.hot)
        for e, x in zip(hot.tolist(), np.split(single[self.w_of] | self.w_before, np.cumsum(self.c_windows[hot])[:-1]) if len(hot) else [], strict=True):
            flags[e] = x
        whole = self.later[self.entry] | (self.doc > self.e_doc[self.entry]) if len(self.entry) else np.zeros(0, bool)
        number = np.full(len(self.first), -1, np.int64)
        number[self.chosen] = np.arange(len(self.chosen))
        part = number[self.entry] if len(self.entry) else np.zeros(0, np.int64)
        out, done = [], 0
        for p in self.parses:
            n = len(p.lo)
            w, q = whole[done : done + n], part[done : done + n]
            done += n
            change = np.zeros(len(p.raw) + 1, np.int32)
            np.add.at(change, p.lo[w], 1)
            np.add.at(change, p.hi[w] + self.length, -1)
            for i in np.flatnonzero(~w & (q >= 0)):
                start = p.lo[i] + np.flatnonzero(flags[q[i]])
                change[start] += 1
                change[start + self.length] -= 1
            out.append(np.cumsum(change[:-1]) > 0)
        return out


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 28, carry: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (bytes left) of every document; with carry also
    rest, the document's own row without its text, and kept is a string, without the parts of characters that were cut. hot: phrases of a trigger from which on its windows are dealt out one by one; the result is the same.

    Texts are UTF-8 bytes. A byte goes if it lies in a `length`-byte string that also starts in a document with a smaller
    doc_id, so that the first document keeps each passage; matches stay within documents and are judged on the input.
    Null and empty texts have no bytes. Rows that share an id do not remove each other's bytes; null ids count as the
    largest. Columns other than doc_id and text are not read. A task holds one block of a few MB, or one longer text with about
    80 bytes a byte of it. Hashes of 96 bits stand for phrases, bytes for the dictionary."""
    rows, n = blocked(docs, carry)
    rows = rows.withColumn("rest", F.col("rest").dropFields("text")) if carry else rows
    buckets = max(48, n // 2)
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if carry else T.BinaryType()), *([rows.schema["rest"]] if carry else [])])

    def state(ids, texts, got, upto):
        s = State(ids, texts, length, k, buckets)
        s.triggers()
        if upto > 0:
            half = {b: (d[: len(d) // 2], d[len(d) // 2 :]) for b, d in got.get(0, {}).items()}
            s.drop_lonely({b: d for b, (d, _) in half.items()}, {b: d for b, (_, d) in half.items()})
            s.phrases()
        if upto > 1:
            s.parsed(got.get(1, {}))
        return s

    def ask(level, ids, texts, got):
        s = state(ids, texts, got, level)
        if level == 0:
            return s.numbers()
        if level == 1:
            return s.questions()
        return s.dictionary()

    def finish(ids, texts, rest, got):
        s = state(ids, texts, got, 2)
        out = []
        for p, gone in zip(s.parses, s.gone(got.get(2, {})), strict=True):
            for lo, hi in zip(p.at[:-1], p.at[1:], strict=True):
                g = gone[lo:hi]
                left = p.raw[lo:hi][~g].tobytes()
                out.append((hi - lo, int(g.sum()), int((np.diff(g.view(np.int8), prepend=np.int8(0)) == 1).sum()), left.decode("utf-8", "ignore") if carry else left))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        more = {"rest": rest} if carry else {}
        return pa.table({"doc_id": pa.array(ids, pa.int64()), **{n: pa.array(c, pa.int64()) for n, c in zip(("n_bytes", "n_removed", "n_spans"), cols, strict=False)}, "kept": pa.array(cols[3], pa.string() if carry else pa.binary()), **more})

    return rounds(rows, n, buckets, ask, [lambda blocks, datas: met(datas, hot), lambda blocks, datas: parse_order(blocks, datas, hot), dictionary_order(length)], finish, schema)


def deduplicated_documents(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with the bytes left as text (parts of characters that were cut fall out) and n_chars, if there, to match.

    The text is made where the bytes are: a function of its own behind it would keep two Python workers busy for each task, and both would
    live on through all later stages."""
    out = suffix_dedup(docs, length, carry=True).select("rest", F.col("kept").alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(made[c].alias(c) if c in made else F.col("rest")[c].alias(c) for c in docs.columns))
