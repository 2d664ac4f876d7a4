"""Exact byte-level BPE ids at corpus scale with the tokenizers library.

Ids of a text are those of its pre-tokens one after the other. Where plain ASCII and Latin letters, digits, marks and single
spaces leave no doubt, pre-tokens are cut here, over arrays of bytes; all else stays together in longer pieces, which the library
splits itself. Of a megabyte's distinct pieces only those that a worker has not met lately go to the library: it keeps the ids of
short pieces in flat arrays of CACHE bytes at most, told apart by 128 bits of hash. A text that holds the content of an added
token goes to the plain library as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from atollkit.llm.common import BYTE, U, prefix_sums, spans_hash

#: Bytes of kept hashes and ids in a worker: the younger and the older half.
CACHE = 16 << 20
#: Longer pieces are never kept.
LONGEST = 64
#: Bytes that are split into pieces together.
RUN = 1 << 19
#: Classes of bytes.
OTHER, LETTER, DIGIT, MARK, BLANK, BREAK = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = MARK
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[32], CLASS[10] = BLANK, BREAK
#: A space before such a byte belongs to the pre-token that the byte begins: no character of white space begins with it.
BEGINS = np.zeros(256, bool)
BEGINS[[*range(33, 127), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
SAFE = re.compile(rb" (?=[!-~\xc3-\xdf\xe4-\xf4])")
#: Pieces that are one pre-token.
SIMPLE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself where it is visible Latin-1, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


def cuts(b: np.ndarray) -> np.ndarray:
    """Whether a piece may begin at each byte, by the bytes around it.

    A pre-token is an optional space and a run of letters, digits or marks, or a run of white space; an apostrophe may
    draw a letter to it. So one begins at a space before a character that is none, where two runs of known classes meet
    (not after an apostrophe), and on either side of a lone line break between known characters."""
    c = CLASS[b]
    lead = np.flatnonzero((b >= 0xC3) & (b <= 0xC5))
    lead = lead[lead + 1 < len(b)]
    lead = lead[(b[lead] != 0xC3) | ((b[lead + 1] != 0x97) & (b[lead + 1] != 0xB7))]
    c[lead] = c[lead + 1] = LETTER  # U+00C0 to U+017F but for the two signs of arithmetic
    known = (c >= LETTER) & (c <= MARK)
    out = np.zeros(len(b), bool)
    out[:-1] = (b[:-1] == 32) & BEGINS[b[1:]]
    out[1:] |= known[1:] & known[:-1] & (c[1:] != c[:-1]) & (b[:-1] != 39)
    lone = np.zeros(len(b), bool)
    lone[1:-1] = (c[1:-1] == BREAK) & known[:-2] & known[2:]
    out |= lone
    out[1:] |= lone[:-1]
    return out


def gathered(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start[i]:start[i] + count[i]] for each i, one after the other."""
    ends = np.cumsum(count)
    return pool[np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Table:
    """Ids of pieces by their two hashes; the first ones ascend."""

    def __init__(self):
        self.one = self.two = np.zeros(0, U)
        self.start = self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def size(self) -> int:
        return 24 * len(self.one) + 4 * len(self.pool)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 if it is not there."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)

    def add(self, one: np.ndarray, two: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Pieces that are not there yet, in ascending order of the first hash."""
        at = np.searchsorted(self.one, one)
        start = len(self.pool) + np.cumsum(count) - count
        self.one, self.two = np.insert(self.one, at, one), np.insert(self.two, at, two)
        self.start, self.count = np.insert(self.start, at, start.astype(np.int32)), np.insert(self.count, at, count.astype(np.int32))
        self.pool = np.concatenate([self.pool, ids])


class Pieces:
    """With literal, special tokens' contents are text like any other; else texts get the library's own ids for them."""

    def __init__(self, path: str, literal: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.path, self.plain = path, None
        self.tok = Tokenizer.from_file(path)
        self.added = [] if literal else [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.tok.encode_special_tokens = True  # pieces hold no added token, or are to be read literally
        # Pre-tokens written in the vocabulary's own characters, with blanks between them: only the merges are left to do.
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.letters = byte_letters() | {0: " "}
        self.young, self.old = Table(), Table()
        vocab = self.tok.get_vocab()
        self.size_of_vocab = max(vocab.values()) + 1
        self.spaced = np.zeros(self.size_of_vocab, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    def _each(self, texts: list[str], tok=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (tok or self.tok).encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Texts with added tokens, by the plain library call."""
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.path)
        return self._each(texts, self.plain)

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces from the library. Simple ones that begin with a space are encoded as one text: the tokens that
        begin with a space show where each begins."""
        out: list = [None] * len(pieces)
        simple = [i for i, p in enumerate(pieces) if SIMPLE.fullmatch(p)]
        for lo in range(0, len(simple), 4000):
            part = [i for i in simple[lo : lo + 4000] if pieces[i][0] == " "]
            text = "\0".join([pieces[i] for i in part]).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.spaced[ids])
            if part and len(at) == len(part):
                raw, at = ids.tobytes(), (at * 4).tolist()
                for i, a, b in zip(part, at, [*at[1:], len(raw)], strict=True):
                    out[i] = raw[a:b]
        left = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(left, self._each([pieces[i] for i in left]), strict=True):
            out[i] = x
        return out

    def _found(self, one: np.ndarray, two: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, ids) of distinct pieces in ascending order of their first hash; piece(places) gives the texts of some."""
        start, count, pools, size = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), [], 0
        left = np.arange(len(one))
        keep = []

        def take(places, counts, ids):
            nonlocal size
            count[places], start[places] = counts, size + np.cumsum(counts) - counts
            pools.append(ids)
            size += len(ids)

        for table in (self.young, self.old):
            at = table.find(one[left], two[left])
            hit = at >= 0
            at, places, left = at[hit], left[hit], left[~hit]
            ids = gathered(table.pool, table.start[at].astype(np.int64), table.count[at].astype(np.int64))
            take(places, table.count[at], ids)
            if table is self.old:
                keep.append((places, table.count[at].astype(np.int64), ids))
        learned = self._learn(piece(left))
        counts, ids = np.fromiter((len(x) // 4 for x in learned), np.int64, len(learned)), np.frombuffer(b"".join(learned), "<u4")
        take(left, counts, ids)
        keep.append((left, counts, ids))
        for places, counts, ids in keep:
            self.young.add(one[places], two[places], counts, ids)
        if self.young.size() > CACHE // 2:
            self.old, self.young = self.young, Table()
        return start, count, np.concatenate(pools)

    def _run(self, raws: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        at = np.concatenate([[0], np.cumsum(sizes)])
        raw = b"".join(raws)
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            return [b""] * len(raws)
        mark = cuts(b)
        full = np.flatnonzero(sizes)
        ends = at[full + 1] - 1
        single = b[ends] == 32  # a last space is no safe one, whatever text comes next
        mark[ends[single]] = False
        mark[at[full]] = True
        self._undo(mark, b, at[full])
        begin = np.flatnonzero(mark)
        end = np.append(begin[1:], len(b))
        values = BYTE[b]
        one, two = (spans_hash(prefix_sums(values, which), begin, end, which) for which in (0, 1))
        short = end - begin <= LONGEST
        _, first, inverse = np.unique(one[short], return_index=True, return_inverse=True)
        lo, hi = begin[short][first], end[short][first]
        text = lambda places: [raw[i:j].decode() for i, j in zip(lo[places].tolist(), hi[places].tolist(), strict=True)]
        start, count, pool = self._found(one[short][first], two[short][first], text)
        s, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        s[short], n[short] = start[inverse], count[inverse]
        if not short.all():
            long = np.flatnonzero(~short)
            made = self._each([raw[i:j].decode() for i, j in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
            n[long] = [len(x) // 4 for x in made]
            s[long] = len(pool) + np.cumsum(n[long]) - n[long]
            pool = np.concatenate([pool, np.frombuffer(b"".join(made), "<u4")])
        ids = gathered(pool, s, n).astype("<u4").tobytes()
        edge = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, at)] * 4
        return [ids[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    @staticmethod
    def _undo(mark: np.ndarray, b: np.ndarray, starts: np.ndarray) -> None:
        """A line break that ends or begins a text has no known character beyond it."""
        ends = starts[1:] - 1
        last = ends[b[ends] == 10]
        mark[last[~np.isin(last, starts)]] = False
        first = starts[b[starts] == 10] + 1
        first = first[first < len(b)]
        mark[first[~np.isin(first, starts)]] = False

    def encode(self, texts: list[str]):
        """Ids of each text as little-endian unsigned 32-bit integers, in their order."""
        part: list[bytes] = []
        whose: list[int] = []
        out: dict[int, bytes] = {}
        size = 0

        def flush():
            nonlocal part, whose, size
            for d, ids in zip(whose, self._run(part), strict=True):
                out[d] = out[d] + ids if d in out else ids
            part, whose, size = [], [], 0

        done = 0
        for d, t in enumerate(texts):
            if any(a in t for a in self.added):
                out[d] = self._whole([t])[0]
                continue
            raw, lo = t.encode(), 0
            while lo < len(raw) or not lo:
                m = SAFE.search(raw, lo + RUN) if len(raw) - lo > RUN else None
                hi = m.start() if m else len(raw)
                part.append(raw[lo:hi])
                whose.append(d)
                size += hi - lo + 1
                lo = max(hi, 1)
                if size >= RUN:
                    flush()
            while done < d:
                if done in whose[:1]:
                    break
                yield out.pop(done)
                done += 1
        flush()
        for d in range(done, len(texts)):
            yield out.pop(d)


@lru_cache(1)
def pieces(path: str, literal: bool = False) -> Pieces:
    """One for each worker, vocabulary file and reading of special tokens."""
    return Pieces(path, literal)
