import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.functions.frames import Frames, split_frames

KEYS = ["user:1001", "用户:🚀:données", "k", ""]
VALUES = [b"John Doe", b"", bytes(range(256)), random.Random(42).randbytes(1 << 20)]


def record(key, value, ts):
    k = key.encode()
    body = struct.pack(">qii", ts, len(k), -1 if value is None else len(value)) + k + (value or b"")
    return struct.pack(">I", zlib.crc32(body)) + body


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, v, ts) for k in KEYS for v, ts in zip(VALUES, (0, 1, -5, 1 << 45), strict=True)]
    return spark.createDataFrame(data, "key string, value binary, ts long")


def test_bytes_sizes_and_round_trip(rows):
    out = rows.select("*", codec.encode_record(F.col("key"), F.col("value"), F.col("ts")).alias("b"), codec.encode_tombstone(F.col("key"), F.col("ts")).alias("t"))
    out = out.select("*", codec.decode_record(F.col("b")).alias("r"), codec.decode_record(F.col("t")).alias("d"), codec.peek_size(F.col("b")).alias("n"), codec.peek_size(F.col("t")).alias("m"))
    for r in out.collect():
        assert bytes(r.b) == record(r.key, bytes(r.value), r.ts) and bytes(r.t) == record(r.key, None, r.ts)
        assert (r.r.key, bytes(r.r.value), r.r.ts, r.r.tombstone, r.r.corrupt_reason) == (r.key, bytes(r.value), r.ts, False, None)
        assert (r.d.key, bytes(r.d.value), r.d.tombstone) == (r.key, b"", True)
        assert r.n == len(r.b) and r.m == len(r.t)


def test_damage_is_told(spark):
    good = record("key", b"value", 7)
    flipped = good[:-1] + bytes([good[-1] ^ 1])
    body = struct.pack(">qii", 1, -4, 2) + b"zz"
    negative = struct.pack(">I", zlib.crc32(body)) + body
    longer = struct.pack(">qii", 1, 1, 99) + b"k"
    cut = struct.pack(">I", zlib.crc32(longer)) + longer
    df = spark.createDataFrame([(i, b) for i, b in enumerate([good, flipped, good[:10], negative, cut, b"", None])], "i int, b binary")
    got = [r.x for r in df.orderBy("i").select(codec.decode_record(F.col("b"))["corrupt_reason"].alias("x")).collect()]
    assert got == [None, "checksum", "short", "key size", "truncated", "short", "short"]


def test_frames(spark):
    pairs = [("b", b"2"), ("a", b""), ("é", b"\x00\xff")]
    df = spark.createDataFrame([("k", b"v", pairs, "host", 7777)], "key string, value binary, pairs array<struct<key:string,value:binary>>, host string, port int")
    r = df.select(
        codec.put_request(F.col("key"), F.col("value")).alias("put"), codec.range_request(F.col("key"), F.col("host")).alias("range"), codec.batch_request(F.col("pairs")).alias("batch"),
        codec.compact_request().alias("compact"), codec.range_response(F.col("pairs")).alias("found"), codec.redirect(F.col("host"), F.col("port")).alias("moved"), codec.ok_long(F.lit(-3)).alias("n")).first()
    s = lambda b: struct.pack(">i", len(b)) + b
    assert bytes(r.put) == b"\x01" + s(s(b"k") + s(b"v")) and bytes(r.range) == b"\x04" + s(s(b"k") + s(b"host"))
    assert bytes(r.compact) == b"\x06" + s(b"") and bytes(r.n) == b"\x00" + s(struct.pack(">q", -3))
    entries = lambda xs: struct.pack(">i", len(xs)) + b"".join(s(k.encode()) + s(v) for k, v in xs)
    assert bytes(r.batch) == b"\x05" + s(entries(pairs)) and bytes(r.found) == b"\x00" + s(entries(sorted(pairs)))
    back = spark.createDataFrame([(r.found, r.moved)], "found binary, moved binary").select(
        codec.decode_entries(codec.decode_response(F.col("found"))["payload"]).alias("e"), codec.decode_redirect(codec.decode_response(F.col("moved"))["payload"]).alias("m")).first()
    assert [(e.key, bytes(e.value)) for e in back.e] == sorted(pairs) and tuple(back.m) == ("host", 7777)


def test_incomplete_frames_wait(spark):
    data = b"\x02" + struct.pack(">i", 3) + b"abc" + b"\xff" + struct.pack(">i", 0) + b"\x01" + struct.pack(">i", 9) + b"x"
    assert [(n, c, p) for n, c, p, _ in split_frames(data)] == [(0, 2, b"abc"), (1, -1, b"")]
    df = spark.createDataFrame([(1, data), (2, None), (3, b"\x01")], "i int, data binary")
    assert df.lateralJoin(Frames(F.col("data").outer())).count() == 2
