"""Plain and mixed archives whose payloads hold gzip members."""

import base64
import gzip
import hashlib

from atollkit.llm import warc


def record(i, body):
    return warc.record_bytes(i, "http://x", body, base64.b32encode(hashlib.sha1(body).digest()).decode(), None)


def read(raw):
    got = list(warc.salvage(raw))
    return [(r["page_id"], r["payload"]) for r in got if r["kind"] == "record"], [(r["at"], r["length"]) for r in got if r["kind"] == "gap"]


BODIES = [gzip.compress(f"<p>{i}</p>".encode() * 50) for i in range(4)] + [b"\x1f\x8b\x08 no member", gzip.compress(record(99, b"inner"))]
RECORDS = [record(i, b) for i, b in enumerate(BODIES)]


def test_gzip_payloads_in_a_plain_archive():
    assert read(b"".join(RECORDS)) == (list(enumerate(BODIES)), [])


def test_mixed_archive():
    raw = RECORDS[0] + gzip.compress(RECORDS[1]) + RECORDS[2] + RECORDS[3] + gzip.compress(RECORDS[4]) + warc.EMPTY_MEMBER + RECORDS[5]
    assert read(raw) == (list(enumerate(BODIES)), [])


def test_plain_records_after_a_damaged_member():
    broken = bytearray(gzip.compress(RECORDS[1]))
    broken[len(broken) // 2] ^= 0xFF
    raw = RECORDS[0] + bytes(broken) + RECORDS[2] + gzip.compress(RECORDS[3]) + gzip.compress(RECORDS[4])[:-9] + RECORDS[5]
    assert read(raw)[0] == [(i, BODIES[i]) for i in (0, 2, 3, 5)]
    assert read(raw)[1][0] == (len(RECORDS[0]), len(broken))


def test_members_after_a_damaged_record():
    raw = RECORDS[0][:-20] + gzip.compress(RECORDS[1]) + b"noise" + RECORDS[2].replace(b"WARC-Payload", b"WARC-Payl0ad").replace(b"sha1:", b"sha1:A") + RECORDS[3]
    got, gaps = read(raw)
    assert got == [(1, BODIES[1]), (3, BODIES[3])] and gaps[0][0] == 0
    assert read(b"\x1f\x8b\x08" * 50 + RECORDS[4]) == ([(4, BODIES[4])], [(0, 150)])
