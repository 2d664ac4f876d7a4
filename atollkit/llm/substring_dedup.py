"""Operator 1: substring dedup by level-wise doubling over word windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atollkit.llm.common import U, Words, blocked, mix, pack, prefix_sums, runs, sliding_min, unpack, windows_hash
from atollkit.llm.exchange import bits, deal, meets, rounds


def doubling(window: int, least: int = 8) -> list[int]:
    """Lengths from short to the window, each at most twice the one before: 35 gives 9, 18, 35."""
    out = [window]
    while (half := -(-out[0] // 2)) >= least:
        out.insert(0, half)
    return out


class Run:
    """Some texts of a block: word hashes, the starts at which a window may still repeat, and the shorter window in each that does."""

    def __init__(self, rows: list[bytes], window: int):
        self.words, self.window = Words(rows), window
        self.sums, self.more = (prefix_sums(self.words.hash, which) for which in (1, 0))
        owner = self.words.owner()
        n = len(owner) - window + 1
        self.alive = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.place, self.length = self.alive, 0

    def extend(self, length: int) -> np.ndarray:
        """Windows of this length for the live starts; their hashes, one for each place, come back.

        The first ones are chosen: of all within the full window that with the smallest hash, which equal windows have at the same
        offset. Later ones extend the window that repeats, to the right or, where the full window ends before, to the left."""
        h = windows_hash(self.sums, length, 1)
        if length == self.window or not len(self.alive):
            self.place = self.alive
        elif not self.length:
            shift = U(max(1, len(h).bit_length()))
            v = ((h >> shift) << shift) | np.arange(len(h)).astype(U)
            low = sliding_min(v, self.window - length + 1)[self.alive]
            self.place = (low & ((U(1) << shift) - U(1))).astype(np.int64)
        else:
            fits = self.place + length <= self.alive + self.window
            self.place = np.where(fits, self.place, self.place - (length - self.length))
        self.length = length
        return h

    def keep(self, mask: np.ndarray) -> None:
        self.alive, self.place = self.alive[mask], self.place[mask]


class Levels:
    """The levels of one block, as far as answers are known."""

    def __init__(self, rows: list[bytes], window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.spans = list(runs(rows))
        self.runs = [Run(rows[lo:hi], window) for lo, hi in self.spans]

    def ask(self, length: int):
        self.places, hashes, more = [], [], []
        for r in self.runs:
            h = r.extend(length)
            self.places.append(mix(h[r.place]))  # least values crowd near 0: mixed again, buckets get equal shares
            at = np.unique(r.place)
            hashes.append(mix(h[at]))
            more.append(windows_hash(r.more, length, 0)[at] if length == self.window else hashes[-1])
        self.keys, first, counts = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U), return_index=True, return_counts=True)
        self.more = np.concatenate(more)[first] if more else self.keys
        self.own = counts > 1
        self.cuts = deal(self.keys, self.buckets)

    def answer(self, got: dict[int, bytes]):
        live = bits(got, self.cuts) | self.own
        for r, keys in zip(self.runs, self.places, strict=True):
            r.keep(live[np.searchsorted(self.keys, keys)])


def both_meet(datas: list[bytes]) -> list[np.ndarray]:
    """meets() of keys of 8 bytes that are told apart by 4 more."""
    sizes = [len(d) // 12 for d in datas]
    one = np.concatenate([unpack(d[: 8 * n], 8) for d, n in zip(datas, sizes, strict=True)])
    two = np.concatenate([unpack(d[8 * n :], 4) for d, n in zip(datas, sizes, strict=True)])
    order = np.lexsort((two, one))
    eq = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    same = np.append(False, eq) | np.append(eq, False)
    out = np.empty(len(one), bool)
    out[order] = same[: len(one)]
    return np.split(out, np.cumsum(sizes)[:-1])


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept (words left, joined by one space) of every document.

    A word goes if it lies in a window of `window` words that starts anywhere else too, in the same document or in
    another; windows are judged on the input. Level by level, from short windows to the full length, those that repeat, at that length
    alone, are extended to twice the length, and none are left where nothing repeats: of each full window the 9-word window
    with the smallest hash is asked about first, then 18 words that hold it, then all 35. Short levels
    are compared by 32-bit keys in a bucket (a chance meeting only costs work later), the last by 96 bits: at 10**13 windows
    the odds that any two others meet are 1 in 10**3.

    Words are maximal runs without 0x20 and 0x09-0x0D, unchanged. Null and empty texts have no words. Repeated rows remove
    each other's windows like any two documents. Null ids are kept as null. Columns other than doc_id and text are not read.
    A task holds one block of a few MB, or one longer text with about 60 bytes a byte of it."""
    rows, n = blocked(docs)
    buckets = max(48, n // 8)
    lengths = doubling(window)
    last = len(lengths) - 1

    def levels(texts, got, upto):
        state = Levels(texts, window, buckets)
        for k in range(upto):
            state.ask(lengths[k])
            state.answer(got.get(k, {}))
        return state

    def ask(level, ids, texts, got):
        state = levels(texts, got, level)
        state.ask(lengths[level])
        c = state.cuts
        said = lambda lo, hi: pack(state.keys[lo:hi], 8) + pack(state.more[lo:hi], 4) if level == last else pack(state.keys[lo:hi], 4)
        return [(b, said(c[b], c[b + 1])) for b in range(buckets) if c[b + 1] > c[b]]

    def reply(level):
        return lambda blocks, datas: [np.packbits(m).tobytes() for m in (both_meet(datas) if level == last else meets([unpack(d, 4) for d in datas]))]

    def finish(ids, texts, rest, got):
        state = levels(texts, got, len(lengths))
        n_words, n_removed, kept = [], [], []
        for (lo, hi), r in zip(state.spans, state.runs, strict=True):
            change = np.zeros(len(r.words.hash) + 1, np.int32)
            change[r.alive] += 1
            change[r.alive + window] -= 1
            gone = np.cumsum(change[:-1]) > 0
            at = r.words.first
            for k, text in enumerate(texts[lo:hi]):
                mask = gone[at[k] : at[k + 1]]
                words = text.split()
                removed = int(mask.sum())
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~mask)] if removed else words))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return rounds(rows, n, buckets, ask, [reply(k) for k in range(len(lengths))], finish, "doc_id long, n_words long, n_removed long, kept string")
