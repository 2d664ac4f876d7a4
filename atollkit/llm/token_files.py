"""Operator 8: token ids in binary files under Re-Pair grammar compression.

File format: shards one after the other, each followed by TRAILER. A shard is MAGIC, a header of eight little-endian
64-bit integers (part, shard, documents, rules, symbols, ids, first rule's symbol, bytes a symbol), then for each
document its id, whether the id is null, its ids and its symbols before it (one more entry at the end), then the rules
(pairs of symbols), their expansion lengths (32 bits), and the symbols; symbols take 2 bytes where they fit, else 4. No
symbol crosses the end of a document, so any document is decoded from its own symbols. Shards lie in the folder kind=shard; kind=index
has a line "part shard ids" for each of them, so that offsets need no second look into the files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atollkit.llm.common import new_path, texts, trim
from atollkit.llm.tokens import pieces

MAGIC, TRAILER = b"REPAIR01", b"\xffEND\xfe\n"
HEADER = struct.Struct("<8q")
CELLS, BATCH, LEAST = 16, 4096, 5


def repair(ids: np.ndarray, ends: np.ndarray, first: int, most_rules: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends of documents among them, rules, expansion lengths).

    Each round counts all pairs exactly and makes the BATCH most frequent ones nonterminals, which stand for their pair
    wherever it occurs, from left to right, never across the end of a document. Pairs meet in cells of a hash table, where the more frequent one
    goes first; the other has its turn in a later round. It ends when no pair stands LEAST times (a rule takes as many bytes as four
    uses save) or the symbols are used up but for a sixteenth of a batch."""
    kind, half = (np.uint64, 32) if first + most_rules > 1 << 16 else (np.uint32, 16)
    wide, none = kind(half), ~kind(0)
    low, shift, odd = kind((1 << half) - 1), kind(2 * half - CELLS), kind(0x9E3779B97F4A7C15 >> (64 - 2 * half) | 1)
    s, last, made = ids.astype(kind), ends - 1, 0
    rules, length_of = [np.zeros((0, 2), np.uint32)], np.ones(first + most_rules, np.int64)
    while len(s) > 1 and most_rules - made > (BATCH // 16 if made else 0):
        key = (s[:-1] << wide) | s[1:]
        key[last[:-1]] = none
        pairs = np.sort(key)
        begin = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
        count, pairs = np.diff(begin, append=len(pairs)), pairs[begin]
        often = np.flatnonzero((count >= LEAST) & (pairs != none))
        room = min(BATCH, most_rules - made)
        if len(often) > room:
            often = often[np.argpartition(count[often], -room)[-room:]]
        pairs = pairs[often[np.argsort(count[often], kind="stable")]]
        held = np.full(1 << CELLS, none, kind)
        held[(pairs * odd) >> shift] = pairs  # ascending: the most frequent pair of a cell stays
        cell = (key * odd) >> shift
        at = np.flatnonzero((held[cell] == key) & (key != none))
        begins = np.diff(at, prepend=-2) != 1
        if not begins.all():  # of pairs that overlap every second one
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        which = cell[at]
        chosen = np.flatnonzero(np.bincount(which.astype(np.int64), minlength=1 << CELLS) >= LEAST)
        if not len(chosen):
            break
        number = np.zeros(1 << CELLS, kind)
        number[chosen] = first + made + np.arange(len(chosen))
        to = number[which]
        at, to = at[to > 0], to[to > 0]
        rule = np.stack([held[chosen] >> wide, held[chosen] & low], 1).astype(np.uint32)
        length_of[first + made : first + made + len(chosen)] = length_of[rule].sum(1)
        rules.append(rule)
        made += len(chosen)
        s[at] = to
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, last = s[stay], last - np.searchsorted(at, last)
    return s.astype(np.uint32), last + 1, np.concatenate(rules), length_of[first : first + made]


def by_levels(s: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids behind the symbols, each round putting every nonterminal's pair in its place."""
    while (big := s >= first).any():
        at = np.arange(len(s)) + np.cumsum(big) - big
        out = np.empty(len(s) + int(big.sum()), np.uint32)
        out[at[~big]] = s[~big]
        r = rules[s[big] - first]
        out[at[big]], out[at[big] + 1] = r[:, 0], r[:, 1]
        s = out
    return s


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, table: np.ndarray | None = None) -> np.ndarray:
    """The ids behind the symbols: each is copied from the table of all rules' expansions, found by their lengths."""
    table = by_levels(np.arange(first, first + len(rules), dtype=np.uint32), rules, first) if table is None else table
    s = symbols.astype(np.int64)
    rule = s - first
    big = rule >= 0
    n = np.ones(len(s), np.int64)
    n[big] = lengths[rule[big]]
    start = np.full(len(s), -1, np.int64)
    start[big] = (np.cumsum(lengths) - lengths)[rule[big]]
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(s) else 0, np.uint32)
    out[(ends - 1)[~big]] = s[~big]
    m, where = n[big], (ends - n)[big]
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    out[np.repeat(where, m) + step] = table[np.repeat(start[big], m) + step]
    return out


def write_shard(part: int, shard: int, doc_ids: list, rows: list[bytes], vocab: int, most_rules: int) -> bytes:
    ids = np.frombuffer(b"".join(rows), "<u4")
    if len(ids) and int(ids.max()) >= vocab:
        raise ValueError(f"id {int(ids.max())} in a vocabulary of {vocab}")
    ends = np.cumsum(np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows)))
    symbols, symbol_ends, rules, lengths = repair(ids, ends, vocab, most_rules)
    width = 2 if vocab + len(rules) <= 1 << 16 else 4
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, HEADER.pack(part, shard, len(rows), len(rules), len(symbols), len(ids), vocab, width),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(),
        np.concatenate([[0], ends]).astype("<i8").tobytes(), np.concatenate([[0], symbol_ends]).astype("<i8").tobytes(),
        rules.astype(f"<u{width}").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """A shard in a file's bytes, with random access to its documents."""

    def __init__(self, raw: bytes, at: int):
        if raw[at : at + 8] != MAGIC:
            raise ValueError(f"no shard at byte {at}")
        self.part, self.number, n, rules, symbols, self.ids, self.first, width = HEADER.unpack_from(raw, at + 8)
        at += 8 + HEADER.size

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        self.doc_ids, self.null = take("<i8", n), take("u1", n).astype(bool)
        self.id_at, self.symbol_at = take("<i8", n + 1), take("<i8", n + 1)
        self.rules, self.lengths, self.symbols = take(f"<u{width}", 2 * rules).reshape(-1, 2).astype(np.uint32), take("<u4", rules).astype(np.int64), take(f"<u{width}", symbols)
        if raw[at : at + len(TRAILER)] != TRAILER:
            raise ValueError(f"no trailer at byte {at}")
        self.end = at + len(TRAILER)
        self.table = None

    def document(self, k: int) -> np.ndarray:
        return self.documents(k, k + 1)

    def documents(self, lo: int, hi: int) -> np.ndarray:
        if self.table is None:
            self.table = by_levels(np.arange(self.first, self.first + len(self.rules), dtype=np.uint32), self.rules, self.first)
        return expand(self.symbols[self.symbol_at[lo] : self.symbol_at[hi]], self.rules, self.lengths, self.first, self.table)


def shards(raw: bytes):
    at = 0
    while at < len(raw):
        s = Shard(raw, at)
        yield s
        at = s.end


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = 1 << 20, part_bytes: int = 8 << 20, literal: bool = True) -> None:
    """Encode every whole text (null: empty), end it with end_id, and write ids in ascending doc_id order to files at path.

    One range shuffle orders the documents; each task then encodes and compresses shards of about shard_ids ids, never
    splitting a document. Files go through Spark's own committer, so a lost executor's tasks run again. Its text writer
    puts out a string's bytes as they are, all 256 values (the encoding is that of the separator). Rules are numbered from the size of the tokenizer's vocabulary. Null ids
    come first; repeated rows all stay. Special tokens' contents are read as text if literal, else as the library reads them."""
    rows = texts(docs)
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0

    def run(batches):
        trim()
        tok, part, shard = pieces(tokenizer, literal), TaskContext.get().partitionId(), 0
        vocab = max(tok.size_of_vocab, end_id + 1)
        most_rules = (1 << 16) - vocab if vocab < 1 << 16 else 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        out_ids, out, size = [], [], 0

        def emit():
            data = [write_shard(part, shard, out_ids, out, vocab, most_rules), f"{part} {shard} {size}".encode()]
            return pa.RecordBatch.from_arrays([pa.array(["shard", "index"]), pa.array(data, pa.binary())], ["kind", "value"])

        for b in batches:
            b = b.to_pydict()
            for d, ids in zip(b["doc_id"], tok.encode(b["text"]), strict=True):
                out_ids.append(d)
                out.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield emit()
                    shard, out_ids, out, size = shard + 1, [], [], 0
        if out:
            yield emit()

    ordered = rows.repartitionByRange(max(12, int(total // part_bytes) + 1), "doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(run, "kind string, value binary").select("kind", F.col("value").cast("string").alias("value"))
    made.write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", TRAILER.decode("latin-1")).text(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids of every document in the files.

    Starts are running sums of the index: of parts (one row a file), then of a part's own shards."""
    fields = ["doc_id long", "part long", "shard long", "within long", "n_tokens long", "ids_crc32 long", *(["ids binary"] if ids else [])]
    if not holds(spark, path):
        return spark.createDataFrame([], ", ".join(["doc_id long", "start long", *fields[4:]]))
    files = spark.read.format("binaryFile").load(f"{path}/kind=shard").where(F.col("length") > 0).select("content")

    def documents(batches):
        for b in batches:
            for c in b.column("content"):
                for s in shards(c.as_py()):
                    for lo in range(0, len(s.doc_ids), 4096):
                        hi = min(lo + 4096, len(s.doc_ids))
                        flat, at = s.documents(lo, hi), s.id_at[lo : hi + 1] - s.id_at[lo]
                        raw = [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                        cols = [pa.array(s.doc_ids[lo:hi], mask=s.null[lo:hi]), pa.array([s.part] * (hi - lo), pa.int64()), pa.array([s.number] * (hi - lo), pa.int64()), pa.array(s.id_at[lo:hi]), pa.array(np.diff(at)), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if ids else [])], [f.split()[0] for f in fields])

    line = F.split("value", " ")
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", TRAILER.decode("latin-1")).text(f"{path}/kind=index")
    sums = lines.select(*(line[i].cast("long").alias(c) for i, c in enumerate(("part", "shard", "ids"))))
    parts = sums.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("parts_before"))
    within = sums.select("part", "shard", (F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")).alias("shards_before"))
    before = within.join(parts, "part").select("part", "shard", (F.col("parts_before") + F.col("shards_before")).alias("before"))
    out = files.mapInArrow(documents, ", ".join(fields)).join(before, ["part", "shard"])
    return out.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def holds(spark: SparkSession, path: str) -> bool:
    """Whether any shard was written: no documents, no folder of shards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=shard")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, ids: bool = True, literal: bool = True) -> DataFrame:
    """Write the files, by default under the shared folder, and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, literal=literal)
    return read_tokens(spark, path, ids)
