"""Operator 13: SentencePiece encoding and decoding over a table of each prefix's last token.

A byte-pair encoding of a text begins with the encodings of its token-wise prefixes, so every prefix of a text has one last
token: of the vocabulary's tokens that end there, found by an automaton, the one that may follow the last token of the prefix before it.
Two tokens may follow each other if merging their joint string yields just these two. The ids are read off the table from
its end. Time and memory are linear in the text, however long its words are.

No token of the vocabulary has a character before a blank, so words with the blanks before them are encoded apart, and
a line break that no token holds stands alone. A worker keeps the ids of short words in tables of CACHE bytes.
"""

from __future__ import annotations

import hashlib
import re
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atollkit.llm.common import BYTE, U, prefix_sums, spans_hash, texts, trim
from atollkit.llm.tokens import Table, gathered

#: The character that stands for a blank in the vocabulary.
BLANK = "▁"
#: Bytes of kept words and ids in a worker, the longest word kept, bytes that are split into words together.
CACHE, LONGEST, RUN = 24 << 20, 64, 1 << 20
#: Characters of the longest stretch whose table is worked out along with others', and the power of two of kept tests of pairs.
SHORT, PAIRS = 96, 22
ODD = U(0x9E3779B97F4A7C15)


class Merges:
    """The vocabulary of a merge-type model; blanks stand for themselves here."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.sp.get_piece_size())
        plain = [i for i in ids if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        self.byte_id = np.array([i for _, i in sorted((int(self.sp.id_to_piece(i)[1:-1], 16), i) for i in ids if self.sp.is_byte(i))], np.int64)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no pieces for all bytes")
        self.text = {i: self.sp.id_to_piece(i).replace(BLANK, " ") for i in plain}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: self.sp.get_score(i) for t, i in self.id.items()}
        self.length = np.zeros(self.sp.get_piece_size(), np.int64)
        self.length[plain] = [len(self.text[i]) for i in plain]
        self.known = np.zeros(sys.maxunicode + 1, bool)
        self.known[[ord(t) for t in self.id if len(t) == 1]] = True
        self.kept_pair, self.kept_result = np.zeros(1 << PAIRS, U), np.zeros(1 << PAIRS, bool)
        #: Where a token can hold a character before a blank, or a line break, texts are not cut there.
        self.by_words = not any(re.search("[^ ] ", t) for t in self.id)
        self.by_lines = not any("\n" in t for t in self.id)
        self.ends = ahocorasick.Automaton()
        for t, i in self.id.items():
            if len(t) == 1 or self.merged(t) == [t]:  # others are never made by merges
                self.ends.add_word(t, i)
        self.ends.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The text under the merges: the pair of the highest score first, the leftmost of equal ones. For the short strings of tokens."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                s = score.get(pair[0] + pair[1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, first: int, second: int) -> bool:
        a, b = self.text[first], self.text[second]
        return self.merged(a + b) == [a, b]

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """may_follow for pairs, packed as first << 32 | second. Results are kept in a table where a newer pair takes an older one's slot."""
        slot = ((keys * ODD) >> U(64 - PAIRS)).astype(np.int64)
        out = self.kept_result[slot]
        miss = np.flatnonzero(self.kept_pair[slot] != keys)
        if len(miss):
            fresh, inverse = np.unique(keys[miss], return_inverse=True)
            made = np.array([self.may_follow(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool)
            out[miss] = made[inverse]
            self.kept_pair[slot[miss]], self.kept_result[slot[miss]] = keys[miss], out[miss]
        return out

    def one_by_one(self, text: str) -> np.ndarray:
        """The last token of each prefix of a long stretch of the vocabulary's characters."""
        last: list = [None] * (len(text) + 1)
        kept: dict[tuple[int, int], bool] = {}
        for end, token in self.ends.iter(text):
            start = end + 1 - len(self.text[token])
            if last[end + 1] is not None or (start and last[start] is None):
                continue
            fits = not start or kept.get((last[start], token))
            if fits is None:
                fits = kept[last[start], token] = self.may_follow(last[start], token)
                if len(kept) > 1 << 16:
                    kept = {}
            if fits:
                last[end + 1] = token
        return np.array(last[1:], np.int64)

    def ids(self, text: str, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has) of the words of a text that begin at the given characters, the first of which is 0.

        Characters beyond the vocabulary are their bytes and merge with nothing, so the table is worked out for stretches between
        them and the words' ends: for all short stretches at once, from their first characters to their last ones."""
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        strange = ~self.known[chars]
        opens = strange.copy()
        opens[begin] = True
        opens[1:] |= strange[:-1]
        stretch = np.flatnonzero(opens)
        size = np.diff(stretch, append=len(chars))
        whose = np.repeat(np.arange(len(stretch)), size)
        last = np.full(len(chars), -1, np.int64)
        end, token = np.fromiter(chain.from_iterable(self.ends.iter(text)), np.int64).reshape(-1, 2).T
        start = end + 1 - self.length[token]
        fits = (whose[np.maximum(start, 0)] == whose[end]) & (size[whose[end]] <= SHORT)
        end, token, start = end[fits], token[fits], start[fits]
        at = end - stretch[whose[end]]
        order = np.argsort(at, kind="stable")
        end, token, start = end[order], token[order], start[order]
        steps = np.searchsorted(at[order], np.arange(SHORT + 1))
        first = start == stretch[whose[end]]
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            if lo == hi:
                continue
            good = first[lo:hi].copy()
            before = last[np.maximum(start[lo:hi] - 1, 0)]
            ask = np.flatnonzero(~good & (before >= 0))
            good[ask] = self.follow((before[ask].astype(U) << U(32)) | token[lo:hi][ask].astype(U))
            last[end[lo:hi][good]] = token[lo:hi][good]
        for k in np.flatnonzero(size > SHORT).tolist():
            last[stretch[k] : stretch[k] + size[k]] = self.one_by_one(text[stretch[k] : stretch[k] + size[k]])
        # Backwards: the last token of each stretch, then the one that ends where it begins, and so on.
        own = ~strange[stretch]
        at, low = (stretch + size - 1)[own], stretch[own]
        ends: list[np.ndarray] = []
        while len(at):
            ends.append(at)
            at = at - self.length[last[at]]
            at, low = at[at >= low], low[at >= low]
        place = np.concatenate([*ends, np.zeros(0, np.int64)])
        odd = np.flatnonzero(strange)
        bytes_ = [text[i].encode() for i in odd.tolist()]
        ids = np.concatenate([last[place], self.byte_id[np.frombuffer(b"".join(bytes_), np.uint8)]])
        place = np.concatenate([place, np.repeat(odd, [len(x) for x in bytes_])])
        order = np.argsort(place, kind="stable")
        return ids[order].astype(np.uint32), np.diff(np.searchsorted(place[order], np.append(begin, len(chars))))


class Encoder:
    """Ids of whole texts, word by word, with the ids of short words kept."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.young, self.old = Table(), Table()

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Whether a word begins at each byte."""
        out = np.zeros(len(b), bool)
        if self.merges.by_words:
            out[1:] = (b[1:] == 32) & (b[:-1] != 32)
        if self.merges.by_lines:
            line = b == 10
            out |= line
            out[1:] |= line[:-1]
        return out

    def _ids(self, one: np.ndarray, two: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, ids) of distinct words b[begin:end] in ascending order of their first hash."""
        start, count, pools, size = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64), [], 0
        left, keep = np.arange(len(one)), []
        for table in (self.young, self.old, None):
            if table is None:
                places, (ids, counts) = left, self._learnt(b, begin[left], end[left])
            else:
                at = table.find(one[left], two[left])
                hit = at >= 0
                at, places, left = at[hit], left[hit], left[~hit]
                counts = table.count[at].astype(np.int64)
                ids = gathered(table.pool, table.start[at].astype(np.int64), counts)
            count[places], start[places] = counts, size + np.cumsum(counts) - counts
            pools.append(ids)
            size += len(ids)
            if table is not self.young:
                keep.append((places, counts, ids))
        for places, counts, ids in keep:
            self.young.add(one[places], two[places], counts, ids)
        if self.young.size() > CACHE // 2:
            self.old, self.young = self.young, Table()
        return start, count, np.concatenate(pools)

    def _learnt(self, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each word has) of the words b[begin:end], by the tables of last tokens."""
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = gathered(b, begin, end - begin)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return self.merges.ids(raw.tobytes().decode(), chars[np.cumsum(end - begin) - (end - begin)])

    def run(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some UTF-8 texts that begin where words do."""
        at = np.concatenate([[0], np.cumsum([len(x) for x in raws])]).astype(np.int64)
        raw = b"".join(raws)
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            return [np.zeros(0, np.uint32)] * len(raws)
        mark = self.cuts(b)
        mark[at[:-1][np.diff(at) > 0]] = True
        begin = np.flatnonzero(mark)
        end = np.append(begin[1:], len(b))
        one, two = (spans_hash(prefix_sums(BYTE[b], which), begin, end, which) for which in (0, 1))
        short = end - begin <= LONGEST
        _, first, inverse = np.unique(one[short], return_index=True, return_inverse=True)
        start, count, pool = self._ids(one[short][first], two[short][first], b, begin[short][first], end[short][first])
        s, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        s[short], n[short] = start[inverse], count[inverse]
        made, n[~short] = self._learnt(b, begin[~short], end[~short])
        s[~short] = len(pool) + np.cumsum(n[~short]) - n[~short]
        ids = gathered(np.concatenate([pool, made]), s, n)
        edge = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, at)]
        return [ids[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def parts(self, text: str):
        """The normalised text in parts of about RUN bytes that begin where words do."""
        raw = self.merges.sp.normalize(text).replace(BLANK, " ").encode()
        lo, safe = 0, re.compile(b"|".join([rb"(?<=[^ ]) "] * self.merges.by_words + [rb"\n"] * self.merges.by_lines) or rb"(?!)")
        while len(raw) - lo > RUN:
            m = safe.search(raw, lo + RUN)
            if not m:
                break
            yield raw[lo : m.start()]
            lo = m.start()
        yield raw[lo:]

    def encode(self, rows: list[str]):
        """Ids of each text, in their order."""
        part: list[bytes] = []
        whose: list[int] = []
        size = 0
        out: dict[int, list[np.ndarray]] = {}
        for d, t in enumerate(rows):
            out[d] = []
            for raw in self.parts(t):
                part.append(raw)
                whose.append(d)
                size += len(raw) + 1
                if size >= RUN:
                    for k, ids in zip(whose, self.run(part), strict=True):
                        out[k].append(ids)
                    part, whose, size = [], [], 0
            if not part:  # all before are whole
                for k in sorted(out):
                    yield np.concatenate(out.pop(k))
        for k, ids in zip(whose, self.run(part), strict=True):
            out[k].append(ids)
        for k in sorted(out):
            yield np.concatenate(out[k])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker and model file."""
    return Encoder(path)


def sentence_pieces(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (text) of every whole text.

    Without ids or decoded, their SHA-256 alone is returned: ids_sha256 of the decimal ids joined by commas, decoded_sha256
    of the text in UTF-8. The model file must hold a merge-type vocabulary with pieces for all bytes and without user-defined symbols;
    begin and end ids are not added. Texts are normalised, and ids decoded, as the model says. Null and empty texts have no ids. Rows stay where they
    are: no shuffle; repeated rows each give a row, null ids stay null."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids" if ids else "ids_sha256", pa.binary() if ids else pa.string()), ("decoded" if decoded else "decoded_sha256", pa.string())]

    def run(batches):
        enc = encoder(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            trim()
            n, a, d = [], [], []
            for got in enc.encode(b.column("text").to_pylist()):
                listed = got.tolist()
                back = enc.merges.sp.decode(listed) if listed else ""
                n.append(len(got))
                a.append(got.astype("<u4").tobytes() if ids else sha(",".join(map(str, listed)).encode()))
                d.append(back if decoded else sha(back.encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, f[1]) for x, f in zip((n, a, d), fields[1:], strict=True))], schema=pa.schema(fields))

    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {fields[2][0]} {'binary' if ids else 'string'}, {fields[3][0]} string")
