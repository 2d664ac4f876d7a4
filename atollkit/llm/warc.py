"""Operator 2: WARC archives, written by Spark and read back by a salvage reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atollkit.llm.common import new_path, skew_join

#: The digits of Spark's base 32 and those of RFC 4648.
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member: it may stand between any two members.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
#: Where a member or a record may begin.
BEGIN = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column, by built-in functions: each five hexadecimal digits make four."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, RFC4648)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every page: null where the page is its payload's response.

    Of rows with equal payloads of at least `least` bytes the one with the smallest page_id is the response (repeated rows
    of that id too), others revisit it. Payloads meet by SHA-1 in a partial aggregate; the join back can be split by
    Spark, so a payload on a third of all pages makes no large task, and has only payloads that occur more than once on its other
    side. Null html: empty payload. Null page_id: never a response that others refer to unless all ids of that payload are null."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    out = skew_join(rows, first, "digest")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.coalesce(F.col("page_id"), F.lit(-(1 << 63))), F.col("first_id")).alias("refers_to"))


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP header alone, whose Content-Length tells the payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, least: int = 0, file_bytes: int = 16 << 20) -> None:
    """Archives at path: each record is a gzip member of its own. A file ends with the record that brings it to file_bytes.

    A row is one file's bytes. Spark's text writer puts them out as they are, all 256 values, and its committer moves them
    into place."""

    def run(batches):
        out, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(z.compress(record_bytes(*row)) + z.flush())
                size += len(out[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    made = records(pages, least).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _record(raw: bytes, at: int) -> tuple[dict, int] | str:
    """The record that begins at a byte and where it ends, or what is wrong with it."""
    if not VERSION.match(raw, at):
        return "no version line"
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        return "header without end"
    f = _fields(raw[at:stop])
    if not f.get("content-length", "").isdigit():
        return "no length"
    lo = stop + 4
    hi = lo + int(f["content-length"])
    if hi > len(raw):
        return "block cut short"
    if raw[hi : hi + 4] != b"\r\n\r\n":
        return "no end of record"
    block = raw[lo:hi]
    said = f.get("warc-block-digest", "").removeprefix("sha1:")
    if said and said != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = f.get("warc-type", ""), f.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        return "payload digest differs"
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    return {
        "kind": "record", "record_type": kind, "page_id": page(f.get("warc-record-id", "")), "url": f.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" or not length else int(length[1]),
        "refers_to": page(f.get("warc-refers-to", "")), "payload": payload if kind == "response" else None,
    }, hi + 4


def _plain(raw: bytes, base: int):
    """Records and gaps of uncompressed bytes; base is their place in the file."""
    at = 0
    while at < len(raw):
        got = _record(raw, at)
        if isinstance(got, tuple):
            got[0]["at"], at = base + at, got[1]
            yield got[0]
            continue
        m = VERSION.search(raw, at + 1)
        end = m.start() if m else len(raw)
        yield {"kind": "gap", "at": base + at, "length": end - at, "reason": got}
        at = end


def _inflate(raw: bytes, at: int) -> tuple[bytes, int, bool]:
    """The body of the gzip member at a byte, where the member ends, and whether it is whole; CRC and length are checked."""
    z, out, view = zlib.decompressobj(31), [], memoryview(raw)
    while at < len(raw) and not z.eof:
        part = view[at : at + (1 << 16)]
        out.append(z.decompress(part))
        at += len(part)
    return b"".join(out), at - len(z.unused_data), z.eof


def salvage(raw: bytes):
    """Every record of an archive's bytes that passes its checks, and a row for each quarantined gap between them.

    Gzip members are checked by their CRC and length, plain records by their length and digests; whatever a sound record
    holds is its payload. After a failed check the reader searches for the nearer of the next sound member and the next
    version line with a sound record."""
    at = 0
    while at < len(raw):
        if raw[at : at + 3] == MEMBER:
            try:
                body, end, ended = _inflate(raw, at)
                reason = "" if ended else "member cut short"
            except zlib.error as e:
                reason = f"member damaged: {str(e)[:60]}"
            if not reason:
                if body:
                    for r in _plain(body, 0):
                        r["at"] = at
                        if r["kind"] == "gap":
                            r |= {"length": end - at, "reason": f"in a member: {r['reason']}"}
                        yield r
                at = end
                continue
        else:
            got = _record(raw, at)
            if isinstance(got, tuple):
                got[0]["at"], at = at, got[1]
                yield got[0]
                continue
            reason = got
        end = next((m.start() for m in BEGIN.finditer(raw, at + 1) if _sound(raw, m.start())), len(raw))
        yield {"kind": "gap", "at": at, "length": end - at, "reason": reason}
        at = end


def _likely(raw: bytes, at: int) -> bool:
    """Whether a gzip header's flags, level and system are ones that exist, and its first bytes inflate: most chance meetings end here."""
    head = raw[at : at + 10]
    if len(head) < 10 or head[3] & 0xE0 or head[8] not in (0, 2, 4) or (head[9] > 13 and head[9] != 255):
        return False
    try:
        zlib.decompressobj(31).decompress(raw[at : at + 512], 1024)
    except zlib.error:
        return False
    return True


def _sound(raw: bytes, at: int) -> bool:
    """Whether a whole member or record begins at a byte."""
    if raw[at : at + 3] != MEMBER:
        return isinstance(_record(raw, at), tuple)
    if not _likely(raw, at):
        return False
    try:
        return _inflate(raw, at)[2]
    except zlib.error:
        return False


FIELDS = (("kind", "string"), ("file", "string"), ("at", "long"), ("length", "long"), ("reason", "string"), ("record_type", "string"), ("page_id", "long"), ("url", "string"), ("payload_digest", "string"), ("payload_bytes", "long"), ("refers_to", "long"), ("payload", "binary"))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of kind record or gap from all archives at path, plain or gzip, whole or damaged.

    A gap row names the file, the first byte, the length and why those bytes are quarantined; records after it are
    recovered. Each file is one row of work: write files of bounded size, as write_warc does by bytes (Spark reads 2 GB at most as one)."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f for f in FIELDS if payload or f[0] != "payload"]

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part = []
                for r in salvage(raw.as_py()):
                    part.append(r | {"file": name})
                    if len(part) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in part], kinds[k]) for n, k in fields], [n for n, _ in fields])
                        part = []
                yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in part], kinds[k]) for n, k in fields], [n for n, _ in fields])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def warc_round_trip(pages: DataFrame, least: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as archives, by default under the shared folder, and return the records that are read back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, least)
    out = read_warc(spark, path, payload=False).where("kind = 'record'")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
