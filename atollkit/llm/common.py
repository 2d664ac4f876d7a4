"""What several training-data operators share: shared folder, blocks of documents, hashing kernels."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
WS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session (tests), which is a
    single process, gets a new one; on a cluster that is an error."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder, and what the lineage held released."""
    spark, names = df.sparkSession, df.columns
    shared_dir(spark)
    out = df.checkpoint().toDF(*names)
    del df  # else its shuffles would outlive the release
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and broadcasts of plans that nothing refers to any more, now instead of at the driver's next
    garbage collection. A query of many checkpoints needs it: without it the Jaccard join took 2.4 GB of disk instead of
    1.7 for 0.5 GB of input, and released only after large checkpoints 1.5 GB of the driver instead of 1.25."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Give a worker's free memory back to the system. Workers live on from stage to stage, and what one stage's arrays took
    would otherwise stay with the C library while the next one takes its own."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def texts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns and their names do not matter.

    With carry, each whole row comes along as the struct rest."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *([F.struct("*").alias("rest")] if carry else []))


def blocked(docs: DataFrame, carry: bool = False, block_bytes: int = 2 << 20) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the number of blocks, each of about block_bytes of text.

    A document's block is a hash of id, text and number of the input partition, so that every pass over the data forms the
    same blocks, also after a lost executor, and repeated rows do not all fall to one."""
    rows = texts(docs, carry)
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    n = max(64, int(total // block_bytes) + 1)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int")), n


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join on key for a left side with hot keys and a right side with one row a key.

    The join key is an expression of the key, so that Spark deals both sides out for the join alone and
    can split its large partitions at run time (an aggregate below would pin them)."""
    tag = f"_join_{key}"
    made = right.withColumn(tag, F.concat(F.col(key).cast("string"), F.lit("~"))).drop(key)
    return left.withColumn(tag, F.concat(F.col(key).cast("string"), F.lit("~"))).join(made, tag, how).drop(tag)


# ---------------------------------------------------------------- hashing, all modulo 2**64

U = np.uint64
_M, _Q = U(0x9E3779B97F4A7C15 | 1), U(0xC2B2AE3D27D4EB4F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd number and of its inverse, kept up to the greatest length asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                out = []
                for b in (self.base, self.inverse):
                    p = np.full(n, b, U)
                    p[0] = 1
                    out.append(np.cumprod(p, dtype=U))
            if n > 8 << 20:  # not kept for a single huge text
                return out[0], out[1]
            self.up, self.down = out
        return self.up[:n], self.down[:n]


@lru_cache(4)
def _powers(which: int) -> _Powers:
    return _Powers((_M, _Q)[which])


def prefix_sums(values: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums of values times powers, from which any window's hash follows."""
    up, _ = _powers(which).get(len(values) + 1)
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=c[1:])
    return c


def spans_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of each span [start, end) of the sequence behind c."""
    _, down = _powers(which).get(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(U))


def windows_hash(c: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of each window of the given length; one for each start."""
    n = len(c) - length
    if n <= 0:
        return np.zeros(0, U)
    _, down = _powers(which).get(len(c))
    return mix((c[length:] - c[:n]) * down[:n] + U(length))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    have, m = 1, v
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


class Words:
    """Words of a run of texts: byte spans, hashes and the text that each belongs to."""

    def __init__(self, rows: list[bytes], lower: bool = False):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(sizes + 1, out=self.at[1:])
        self.raw = b"\n".join(rows) + b"\n"
        b = np.frombuffer(self.raw, np.uint8)
        if lower:
            b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = spans_hash(prefix_sums(BYTE[b], 0), self.start, self.end, 0)
        self.first = np.searchsorted(self.start, self.at)  # of each text; the last entry ends the last one
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low width bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :width] = x
    return out.view("<u8").ravel()


def runs(rows: list[bytes], most: int = 1 << 20, per_row: int = 1):
    """(from, to) of consecutive texts that together have about most bytes at most, each counted with per_row more; a longer text is alone."""
    lo, size = 0, 0
    for i, r in enumerate(rows):
        if size and size + len(r) > most:
            yield lo, i
            lo, size = i, 0
        size += len(r) + per_row
    if lo < len(rows):
        yield lo, len(rows)
