"""The salvaging reader: linear time, bounded memory, no valid record lost."""

import hashlib
import io
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.common import new_path


def record(i, body, packed):
    r = warc.build_record(i, f"http://x/{i}", body, None, hashlib.sha256(body).hexdigest())
    return warc.gzip_member(r) if packed else r


def read(data):
    items = list(warc.SalvageReader(io.BytesIO(data)))
    at = 0
    for x in items:  # records and gaps cover the stream
        assert x[1] == at
        at = x[2] if x[0] == "gap" else next((y[1] for y in items if y[1] > at), len(data))
    return [x[2]["x-page-id"] for x in items if x[0] == "record"], [x[1:3] for x in items if x[0] == "gap"]


@pytest.mark.parametrize("buffer", [64, 1 << 20])
@pytest.mark.parametrize("packed", [True, False])
def test_random_damage(packed, buffer, monkeypatch):
    monkeypatch.setattr(warc, "READ", buffer)
    rng = random.Random(5)
    for _ in range(60):
        parts, good = [], []
        for i in range(rng.randint(0, 8)):
            body = bytes(rng.choices(b"WARC/1.\r\n\x1f\x8b\x08ab: ", k=rng.randint(0, 300)))
            part = record(i, body, packed)
            kind = rng.choice(("whole", "whole", "cut", "flipped", "junk"))
            if kind == "cut":
                part = part[: rng.randint(0, len(part) - 5)]
            elif kind == "flipped":
                k = part.index(b"-Digest") if not packed else len(part) // 2
                part = part[:k] + bytes([part[k] ^ 0x55]) + part[k + 1:]
                if not packed:  # an unknown field's name has changed: spoil the length as well
                    part = part.replace(b"Content-Length: ", b"Content-Length: 9")
            elif kind == "junk":
                part = bytes(rng.choices(range(256), k=rng.randint(1, 200))) + part
            parts.append(part)
            if kind in ("whole", "junk"):
                good.append(str(i))
        assert read(b"".join(parts))[0] == good


def test_a_payload_may_hold_what_looks_like_a_record(monkeypatch):
    monkeypatch.setattr(warc, "READ", 4096)
    body = b"x" * 9000 + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + b"y" * 9000
    assert read(record(0, body, False) + record(1, b"b", False)) == (["0", "1"], [])
    plain = record(0, body, False)
    head, _, rest = plain.partition(b"\r\n\r\n")
    bare = b"\r\n".join(x for x in head.split(b"\r\n") if b"Digest" not in x) + b"\r\n\r\n" + rest
    assert read(bare + record(1, b"b", False)) == (["0", "1"], [])


def test_junk_takes_linear_time_and_little_memory():
    junk = {n: random.Random(1).randbytes(1 << 20) * n for n in (8, 64)}
    took = {}
    for n, data in junk.items():
        stream = io.BytesIO(record(0, b"a", True) + data + record(1, b"b", False))
        tracemalloc.start()
        began = time.process_time()
        items = list(warc.SalvageReader(stream))
        took[n] = time.process_time() - began
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x[0] for x in items] == ["record", "gap", "record"] and items[1][2] - items[1][1] == len(data)
        assert peak < 8 << 20
    assert took[64] < 16 * took[8] + 1


def test_large_plain_record_in_small_buffers(monkeypatch):
    monkeypatch.setattr(warc, "READ", 1 << 16)
    body = b"0123456789abcdef" * (4 << 20)
    began = time.process_time()
    assert read(record(0, body, False) + record(1, b"b", False)) == (["0", "1"], [])
    assert time.process_time() - began < 5


def test_a_wrong_length_is_seen_before_anything_is_read():
    bad = record(0, b"a", False).replace(b"Content-Length: ", b"Content-Length: 99999999")
    assert read(bad + record(1, b"b", False))[0] == ["1"]


def test_repeated_ids_and_clashing_columns(spark):
    body = "z" * 150
    rows = [(3, "u", body), (3, "v", body), (4, "w", body), (None, None, body), (9, "u", "s" * 99), (8, "u", "s" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "kind": F.lit("x"), "__digest": F.lit("d")})
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages, new_path(spark, "t"))).collect()), key=str)
    assert got == sorted([(3, "response", None), (3, "response", None), (4, "revisit", 3), (None, "revisit", 3), (8, "response", None), (9, "response", None)], key=str)


def test_foreign_members_and_headers():
    """A member that expands beyond its stated length is given up early; foreign numbers are no numbers."""
    import gzip

    bomb = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\n" + b"0" * (400 << 20))
    sound = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    tracemalloc.start()
    found = list(warc.SalvageReader(io.BytesIO(bomb + sound)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert [item[0] for item in found] == ["gap", "record"] and found[1][3] == b"hello"
    assert [warc.whole(t) for t in ("12", "-3", "x", "", None, "1e3", "9" * 40, "\u0663")] == [12, -3, None, None, None, None, None, None]
