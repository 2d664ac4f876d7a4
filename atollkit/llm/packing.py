"""Operator 4: best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.llm.common import pinned, texts, trim
from atollkit.llm.tokens import pieces as encoder

SHARD, ISLANDS, EPOCHS, POPULATION = 4096, 4, 2, 8
#: An epoch of an island ends after so many generations, or so many without a better solution.
GENERATIONS, PATIENCE = 40, 12
#: Displaced items that are tried in pairs.
TRIED = 48
#: Sequences filled less than this are packed again with those of other shards.
WELL = 0.985


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's ids and the end id, cut into pieces of
    size where it is longer; only its first piece may be shorter."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else [])]

    def run(batches):
        trim()
        tok, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for d, raw in zip(b.column("doc_id").to_pylist(), tok.encode(b.column("text").to_pylist()), strict=True):
                raw += end
                at, stop, k = 0, (len(raw) // 4 - 1) % size + 1, 0
                while at * 4 < len(raw):
                    part = raw[4 * at : 4 * stop]
                    for column, x in zip(out, (d, k, at, stop - at, zlib.crc32(part), part), strict=False):
                        column.append(x)
                    at, stop, k = stop, stop + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])
        trim()

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


@lru_cache(TRIED + 1)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Packing:
    """Solutions of one shard: an array with each item's bin, bins numbered from 0."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int):
        self.lengths, self.size, self.rng = lengths.astype(np.int64), size, np.random.default_rng(seed)
        self.bound = -(-int(self.lengths.sum()) // size)

    def fills(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(s, weights=self.lengths).astype(np.int64)

    def cost(self, s: np.ndarray) -> tuple[int, float]:
        """Bins, then how unevenly they are filled: full bins leave room for changes in the others."""
        f = self.fills(s)
        return len(f), -float((f / self.size) @ (f / self.size))

    def best_fit(self, s: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Put the items, in their order, each into the fullest bin of s that takes it, or a new one; s has -1 for them."""
        placed = s[s >= 0]
        used = int(placed.max()) + 1 if len(placed) else 0
        fill = np.bincount(placed, weights=self.lengths[s >= 0], minlength=used).astype(np.int64)
        free = sorted((((self.size - fill) << 32) | np.arange(used)).tolist())
        for i, n in zip(items.tolist(), self.lengths[items].tolist(), strict=True):
            k = bisect_left(free, n << 32)
            if k < len(free):
                x = free.pop(k)
                room, b = x >> 32, x & 0xFFFFFFFF
            else:
                room, b, used = self.size, used, used + 1
            s[i] = b
            insort(free, ((room - n) << 32) | b)
        return s

    def decreasing(self, items: np.ndarray, noise: float = 0.0) -> np.ndarray:
        weight = self.lengths[items] * (1 + noise * self.rng.random(len(items)))
        return items[np.argsort(-weight, kind="stable")]

    def start(self, noise: float) -> np.ndarray:
        n = len(self.lengths)
        return self.best_fit(np.full(n, -1, np.int64), self.decreasing(np.arange(n), noise))

    def crossover(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of b go into a; bins of a that hold one of their items go, and what they still held is
        placed again."""
        fill = self.fills(b)
        inject = (fill >= np.quantile(fill, 0.5)) & (self.rng.random(len(fill)) < self.rng.uniform(0.1, 0.7))
        inside = inject[b]
        hit = np.zeros(int(a.max()) + 1, bool)
        hit[a[inside]] = True
        return self._rebuilt(np.where(inside, b + len(hit), a), ~inside & hit[a])

    def mutate(self, s: np.ndarray) -> np.ndarray:
        """The least filled bin and a few others are emptied and their items placed again."""
        fill = self.fills(s)
        out = np.zeros(len(fill), bool)
        out[self.rng.integers(0, len(fill), int(self.rng.integers(2, 6)))] = True
        out[np.argmin(fill)] = True
        return self._rebuilt(s.copy(), out[s])

    def _rebuilt(self, s: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        s[displaced] = -1
        kept = s >= 0
        s[kept] = np.unique(s[kept], return_inverse=True)[1]
        self.exchange(s)
        return self.best_fit(s, self.decreasing(np.flatnonzero(s < 0), 0.02))

    def roomy(self, s: np.ndarray) -> np.ndarray:
        """Placed items whose bins have room. Nothing that takes an item's place in a full bin fills it better."""
        placed = np.flatnonzero(s >= 0)
        return placed[(np.bincount(s[placed], weights=self.lengths[placed]) < self.size)[s[placed]]]

    def exchange(self, s: np.ndarray) -> None:
        """Displaced items, one or two, take the place of one or two in a bin that they fill better; the smaller ones are
        displaced instead, and find a place more easily. Each step takes the greatest gain; it ends when there is none."""
        n, loose = self.lengths, np.flatnonzero(s < 0)
        if not len(loose) or not (s >= 0).any():
            return
        loose = list(self.rng.permutation(loose))
        sizes = np.arange(self.size + 1)
        for _ in range(2 * TRIED):
            tried = np.array(loose[:TRIED])
            i, j = _pairs(len(tried))
            gives = np.concatenate([n[tried], n[tried[i]] + n[tried[j]]])
            order = np.argsort(gives, kind="stable")
            ascending = gives[order]
            at = np.searchsorted(ascending, sizes, "right") - 1  # for each size the greatest that goes in
            most = np.where(at >= 0, ascending[np.maximum(at, 0)], -1)
            placed = self.roomy(s)
            if not len(placed):
                return
            bins = s[placed]
            by_bin = np.argsort(bins.astype(np.int16) if bins.max() < 1 << 15 else bins, kind="stable")
            placed, bins = placed[by_bin], bins[by_bin]
            own = n[placed]
            room = (self.size - np.bincount(bins, weights=own).astype(np.int64))[bins]
            gain, one, two, space = 0, -1, -1, 0
            for step in range(6):  # an item alone, then with the next ones of its bin
                x = np.flatnonzero(bins[step:] == bins[: max(0, len(bins) - step)]) if step else slice(None)
                take = own[x] + own[step:][x] if step else own
                if not len(take):
                    continue
                gains = most[take + room[x]] - take
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    first = int(x[k]) if step else k
                    gain, one, two, space = int(gains[k]), int(placed[first]), int(placed[first + step]) if step else -1, int(take[k] + room[first])
            if gain <= 0:
                return
            g = int(order[at[space]])
            into = [int(tried[g])] if g < len(tried) else [int(tried[i[g - len(tried)]]), int(tried[j[g - len(tried)]])]
            out = [x for x in (one, two) if x >= 0]
            s[into], s[out] = s[one], -1
            loose = [x for x in loose if x not in into] + out

    def evolve(self, population: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
        """(population, best first; generations). A generation crosses two solutions picked by tournament and mutates one; the children
        drive out the worst. It ends where the lower bound is met, after GENERATIONS, or after PATIENCE of them without a better solution."""
        population = sorted(population, key=self.cost)
        done = idle = 0
        while done < GENERATIONS and idle < PATIENCE and self.cost(population[0])[0] > self.bound:
            before = self.cost(population[0])
            i, j, k = (int(self.rng.integers(0, len(population), 2).min()) for _ in range(3))
            children = [self.crossover(population[i], population[j]), self.mutate(population[k])]
            costs = {}
            for s in [*population, *children]:
                costs.setdefault(self.cost(s), s)
            population = [costs[c] for c in sorted(costs)[:POPULATION]]
            done, idle = done + 1, 0 if self.cost(population[0]) < before else idle + 1
        return population, done


def _seed(shard: int, island: int, epoch: int) -> int:
    return zlib.crc32(f"{shard}/{island}/{epoch}".encode())


def _canonical(t: pa.Table) -> pa.Table:
    """The items of a shard in an order that does not depend on how they arrived."""
    return t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])


STATE = "shard long, island int, lengths binary, solutions array<binary>, start long, generations int"


def _state(shard: int, islands: list[int], lengths: np.ndarray, solutions: list[list[np.ndarray]], start: int, generations: int) -> pa.Table:
    n = len(islands)
    return pa.table({"shard": pa.array([shard] * n, pa.int64()), "island": pa.array(islands, pa.int32()), "lengths": pa.array([lengths.astype("<i4").tobytes()] * n, pa.binary()), "solutions": pa.array([[s.astype("<i4").tobytes() for s in x] for x in solutions], pa.list_(pa.binary())), "start": pa.array([start] * n, pa.int64()), "generations": pa.array([generations] * n, pa.int32())})


SOLVED = "shard long, solution binary, bound long, start long, end long, generations long"


def shard_solutions(items: DataFrame, size: int, shards: int = 1) -> DataFrame:
    """SOLVED: the best packing of each shard's items in canonical order, with the lower bound of its sequences, their number in the first
    solution (best fit of decreasing lengths) and at the end, and the generations of all islands.

    ISLANDS populations of a shard evolve in tasks of their own; after each epoch every island's best also enters the
    next island of the ring. A shard whose first solution meets the bound, which proves it best, has no generations. States are small and slow to
    work on, so they are dealt out to a stated number of tasks, which Spark does not put together again."""
    spark = items.sparkSession
    tasks = min(shards * ISLANDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))

    def first(key, t):
        lengths = _canonical(t).column("length").to_numpy()
        return _state(key[0].as_py(), list(range(ISLANDS)), lengths, [[] for _ in range(ISLANDS)], 0, 0)

    def epoch(number):
        def run(key, t):
            shard, island = key[0].as_py(), key[1].as_py()
            lengths = np.frombuffer(t.column("lengths")[0].as_py(), "<i4")
            p = Packing(lengths, size, _seed(shard, island, number))
            found = sorted(raw for x in t.column("solutions").to_pylist() for raw in x)
            population = [np.frombuffer(raw, "<i4").astype(np.int64) for raw in found]
            start, before = max(t.column("start").to_pylist()), max(t.column("generations").to_pylist())
            if not population:
                population = [p.start(0.0)]
                start = p.cost(population[0])[0]
                if start > p.bound:
                    population += [p.start(0.05 * (island + k)) for k in range(1, POPULATION)]
            population, done = p.evolve(population)
            return _state(shard, [island], lengths, [population], start, before + done)

        return run

    state = items.groupBy("shard").applyInArrow(first, STATE)
    for number in range(EPOCHS):
        if number:
            elite = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS))).withColumn("solutions", F.slice("solutions", 1, 1)).withColumn("generations", F.lit(0))
            state = state.unionByName(elite)
        state = pinned(state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInArrow(epoch(number), STATE))

    def best(key, t):
        p = Packing(np.frombuffer(t.column("lengths")[0].as_py(), "<i4"), size, 0)
        found = sorted(x[0] for x in t.column("solutions").to_pylist())
        cost = lambda raw: p.cost(np.frombuffer(raw, "<i4").astype(np.int64))
        least = min(found, key=cost)
        numbers = (p.bound, max(t.column("start").to_pylist()), cost(least)[0], sum(t.column("generations").to_pylist()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "solution": pa.array([least], pa.binary()), **{c: pa.array([x], pa.int64()) for c, x in zip(("bound", "start", "end", "generations"), numbers, strict=True)}})

    return state.groupBy("shard").applyInArrow(best, SOLVED)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def packed(items: DataFrame, size: int, first_shard: int, shards: int) -> DataFrame:
    """Every item with its sequence, its place there, and how full the sequence is.

    A shard is a hash of the item and of its partition (items are read from a checkpoint, so it stays the same), which deals repeated rows out too."""
    dealt = items.withColumn("shard", F.lit(first_shard) + F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(shards)))
    columns = [c.split()[0] for c in PLACED.split(", ")[:5]]

    def place(key, t, s):
        t = _canonical(t)
        bins = np.frombuffer(s.column("solution")[0].as_py(), "<i4").astype(np.int64)
        lengths = t.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(lengths[order]) - lengths[order]
        begin = np.append(True, bins[order][1:] != bins[order][:-1])
        offset = np.empty(len(bins), np.int64)
        offset[order] = sums - np.maximum.accumulate(np.where(begin, sums, 0))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return pa.table({**{c: t.column(c) for c in columns}, "sequence_id": pa.array((key[0].as_py() << 20) + bins), "offset": pa.array(offset), "fill": pa.array(fill[bins])})

    return dealt.groupBy("shard").cogroup(shard_solutions(dealt, size, shards).groupBy("shard")).applyInArrow(place, PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Every document's ids (null text: none) and the end id; documents longer than size are cut into pieces of size, their first
    piece may be shorter. Full pieces are sequences of their own. All others go to shards of about SHARD items, where island
    populations evolve; sequences that stay badly filled are taken apart once more and their items packed together with those
    of other shards. Repeated rows are packed each, null ids stay null, no documents give no rows. A task holds one
    shard's lengths and a few solutions."""
    all_ = pinned(pieces(docs, tokenizer, end_id, size))
    full = all_.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = all_.where(F.col("length") < size)
    shards = max(1, -(-items.count() // SHARD))
    once = pinned(packed(items, size, 0, shards))
    if shards > 1:
        loose = once.where(F.col("fill") < int(WELL * size)).drop("sequence_id", "offset", "fill")
        again = max(1, -(-loose.count() // SHARD))
        once = once.where(F.col("fill") >= int(WELL * size)).unionByName(packed(loose, size, shards, again))
    return full.unionByName(once.drop("fill"))
