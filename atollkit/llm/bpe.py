"""Operator 5: byte-level BPE encoding and decoding with the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atollkit.llm.common import texts

#: A space followed by a non-space begins a match of the pattern wherever it stands, so a text may be cut before it; so does a
#: letter after one of these marks, which texts without spaces have.
SAFE = re.compile(r" (?=\S)|(?<=[,.!?;:\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a])(?=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])")


@lru_cache(2)
def encoding(path: str, pattern: str):
    """The encoding of a local rank file (base64 token and rank a line); one for each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, size: int):
    """The text in parts of about size characters, cut at safe boundaries alone."""
    lo = 0
    while len(text) - lo > size:
        m = SAFE.search(text, lo + size)
        if not m:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def encode(text: str, path: str, pattern: str, size: int = 1 << 16) -> list[int]:
    enc = encoding(path, pattern)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in cut(text, size) for i in enc.encode_ordinary(part)]


def bpe(docs: DataFrame, path: str, pattern: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (bytes) of every whole text.

    Without ids or decoded, their SHA-256 alone is returned (ids_sha256, decoded_sha256), which keeps rows small.
    Each match of pattern is encoded on its own, without special tokens; bytes, not characters, are decoded, so ids that
    end inside a character decode too. Null and empty texts have no ids. Rows stay where they are: no shuffle; repeated
    rows each give a row, null ids stay null."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids" if ids else "ids_sha256", pa.binary() if ids else pa.string()), ("decoded" if decoded else "decoded_sha256", pa.binary() if decoded else pa.string())]

    def run(batches):
        enc = encoding(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for t in b.column("text"):
                got = encode(t.as_py(), path, pattern)
                raw, back = np.array(got, "<u4").tobytes(), enc.decode_bytes(got)
                n.append(len(got))
                a.append(raw if ids else hashlib.sha256(raw).hexdigest())
                d.append(back if decoded else hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, f[1]) for x, f in zip((n, a, d), fields[1:], strict=True))], schema=pa.schema(fields))

    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {fields[2][0]} {'binary' if ids else 'string'}, {fields[3][0]} {'binary' if decoded else 'string'}")
