"""Rounds of question and answer between blocks of documents and buckets of keys.

A block (a few MB of documents) reduces what it asks to distinct 64-bit keys; a bucket compares the keys of all blocks that fall to
it and answers each block in the same order. A key on a third of all documents is one entry a block, so no bucket grows
with a hot key. Were every block to send every bucket a row, rows would grow with the square of the input. So messages
go by two hops: blocks form crews and buckets ranges, each about as many as the root of their number. A block sends one row to each range, a
crew's rows for a range are sorted into one row a bucket, and answers come back the same way. Rows grow with the 1.5th
power of the input and stay of some KB where one hop would have sent bytes. The documents are dealt out once; every round of one
query reads that same shuffle again. All of it is a function of the rows, so a lost executor's tasks give the
same bytes when they run again.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atollkit.llm.common import trim

U = np.uint64
ANSWER = "block int, level int, data binary"
HOP = "crew int, zone int, bucket int, data binary"


def root(n: int) -> int:
    """The least whole number whose square is n or more."""
    return isqrt(max(1, n) - 1) + 1


def bundle(parts: list[tuple[int, bytes]]) -> bytes:
    """Numbered pieces of data as one."""
    return np.array([len(parts), *(k for k, _ in parts), *(len(d) for _, d in parts)], "<i8").tobytes() + b"".join(d for _, d in parts)


def unbundle(raw: bytes) -> list[tuple[int, bytes]]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    names, sizes = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(2, n)
    ends = (8 + 16 * n + np.cumsum(sizes)).tolist()
    return [(k, raw[hi - size : hi]) for k, size, hi in zip(names.tolist(), sizes.tolist(), ends, strict=True)]


def table(columns: dict[str, tuple[str, list]]) -> pa.Table:
    kinds = {"i": pa.int32(), "b": pa.binary()}
    return pa.table({c: pa.array(x, kinds[k]) for c, (k, x) in columns.items()})


def gathered(parts: list[tuple[int, bytes]], width: int) -> list[tuple[int, bytes]]:
    """Numbered data by stretches of width numbers: (stretch, bundle)."""
    out: dict[int, list] = {}
    for k, d in parts:
        out.setdefault(k // width, []).append((k, d))
    return [(z, bundle(x)) for z, x in out.items()]


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of ascending keys into buckets: bucket b has keys[cuts[b]:cuts[b + 1]]."""
    b = ((keys >> U(32)) * U(buckets)) >> U(32)
    return np.searchsorted(b, np.arange(buckets + 1).astype(U))


def bits(answers: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    """One flag for each asked key, from the buckets' packed answers."""
    out = np.zeros(cuts[-1], bool)
    for b, data in answers.items():
        lo, hi = cuts[b], cuts[b + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
    return out


def meets(parts: list[np.ndarray]) -> list[np.ndarray]:
    """For distinct keys of several blocks: which also occur in another block."""
    flat = np.concatenate(parts)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(s), bool)
    out[order] = same
    return np.split(out, np.cumsum([len(p) for p in parts])[:-1])


def sorted_rows(t: pa.Table) -> tuple[list, list[bytes], pa.ChunkedArray | None]:
    """Ids, texts and what is carried with them (None if nothing is) of a block in the order of (id, text), nulls last."""
    ids, rows = t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
    rest = t.column("rest").take(pa.array(order, pa.int64())) if "rest" in t.column_names else None
    return [ids[i] for i in order], [rows[i] for i in order], rest


def _by_level(t: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for level, data in zip(*(t.column(c).to_pylist() for c in ("level", "data")), strict=True):
        out.setdefault(level, {}).update(unbundle(data))
    return out


def over_blocks(blocked: DataFrame, answers: DataFrame | None, fn: Callable, schema) -> DataFrame:
    """fn(block, ids, texts, rest, answers by level and bucket) for each block."""
    if answers is None:
        def alone(key, t):
            trim()
            return fn(key[0].as_py(), *sorted_rows(t), {})

        return blocked.groupBy("block").applyInArrow(alone, schema)

    def both(key, t, a):
        trim()
        return fn(key[0].as_py(), *sorted_rows(t), _by_level(a))

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def transposed(t: pa.Table, by: str) -> dict[int, list[tuple[int, bytes]]]:
    """What a crew or bucket said to whom, by the numbers inside the bundles; senders in ascending order."""
    out: dict[int, list] = {}
    for who, data in sorted(zip(t.column(by).to_pylist(), t.column("data").to_pylist(), strict=True), key=lambda x: x[0]):
        for to, d in unbundle(data):
            out.setdefault(to, []).append((who, d))
    return out


def rounds(blocked: DataFrame, blocks: int, buckets: int, ask: Callable, answer: list[Callable], finish: Callable, schema) -> DataFrame:
    """One round for each answer function, then finish(ids, texts, rest, answers) -> pa.Table of schema for each block.

    ask(level, ids, texts, answers) -> [(bucket, data)]; answer(blocks, datas) -> datas in the same order."""
    crew, zone = root(blocks), root(buckets)

    def question(level):
        def run(block, ids, texts, rest, got):
            made = gathered(ask(level, ids, texts, got), zone)
            n = len(made)
            return table({"crew": ("i", [block // crew] * n), "zone": ("i", [z for z, _ in made]), "bucket": ("i", [block] * n), "data": ("b", [d for _, d in made])})

        return run

    def sort_out(key, t):
        made = [(b, bundle(x)) for b, x in transposed(t, "bucket").items()]
        n = len(made)
        return table({"crew": ("i", [key[0].as_py()] * n), "zone": ("i", [key[1].as_py()] * n), "bucket": ("i", [b for b, _ in made]), "data": ("b", [d for _, d in made])})

    def bucket(reply):
        def run(key, t):
            said = sorted(p for raw in t.column("data").to_pylist() for p in unbundle(raw))
            names = [b for b, _ in said]
            made = gathered(list(zip(names, reply(names, [d for _, d in said]), strict=True)), crew)
            b, n = key[0].as_py(), len(made)
            return table({"crew": ("i", [c for c, _ in made]), "zone": ("i", [b // zone] * n), "bucket": ("i", [b] * n), "data": ("b", [d for _, d in made])})

        return run

    def bring_back(level):
        def run(key, t):
            made = [(k, bundle(x)) for k, x in transposed(t, "bucket").items()]
            return table({"block": ("i", [k for k, _ in made]), "level": ("i", [level] * len(made)), "data": ("b", [d for _, d in made])})

        return run

    answers = None
    for level, reply in enumerate(answer):
        said = over_blocks(blocked, answers, question(level), HOP).groupBy("crew", "zone").applyInArrow(sort_out, HOP)
        back = said.groupBy("bucket").applyInArrow(bucket(reply), HOP).groupBy("crew", "zone").applyInArrow(bring_back(level), ANSWER)
        answers = back if answers is None else answers.unionByName(back)
    return over_blocks(blocked, answers, lambda block, ids, texts, rest, got: finish(ids, texts, rest, got), schema)
