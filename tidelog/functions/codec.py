"""The record codec and the wire frames as column expressions: all JVM-side, no Python per row.

A record is crc32(4) ts(8) key size(4) value size(4) key value, big-endian; the checksum covers what follows it, and
a value size of -1 with no value marks a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADER, OPCODES, STATUS, TOMBSTONE


def int32(n: Column) -> Column:
    """Four bytes, big-endian, two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(8)))


def int64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def int8(n: Column) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 16, "0"), F.lit(2)))


def read_int64(b: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(8))), 16, -10).cast("long")


def read_int32(b: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    n = F.conv(F.hex(F.substring(b, at + 1, F.lit(4))), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def utf8(key: Column) -> Column:
    return F.encode(key, "UTF-8")


def record_size(key: Column, value: Column) -> Column:
    return HEADER + F.octet_length(key) + F.octet_length(value)


def tombstone_size(key: Column) -> Column:
    return HEADER + F.octet_length(key)


def size_of(key: Column, value: Column, op: Column) -> Column:
    """The size of a log row's record, a deletion's included."""
    return F.when(op == "delete", tombstone_size(key)).otherwise(record_size(key, F.coalesce(value, F.lit(b"")))).cast("long")


def encode_record(key: Column, value: Column, ts: Column) -> Column:
    body = F.concat(int64(ts), int32(F.octet_length(key)), int32(F.octet_length(value)), utf8(key), value)
    return F.concat(int32(F.crc32(body)), body)


def encode_tombstone(key: Column, ts: Column) -> Column:
    body = F.concat(int64(ts), int32(F.octet_length(key)), int32(F.lit(TOMBSTONE)), utf8(key))
    return F.concat(int32(F.crc32(body)), body)


def peek_size(b: Column, at: Column | int = 0) -> Column:
    """A record's size as its header says, -1 where less than a header is left."""
    at = F.lit(at) if isinstance(at, int) else at
    value = read_int32(b, at + 16)
    return F.when(F.octet_length(b) - at < HEADER, -1).otherwise(HEADER + read_int32(b, at + 12) + F.greatest(value, F.lit(0)))


def decode_record(b: Column) -> Column:
    """struct(key, value, ts, tombstone, corrupt_reason): everything else is null where a reason stands."""
    key_size, value_size = read_int32(b, 12), read_int32(b, 16)
    body = F.substring(b, F.lit(5), F.octet_length(b))
    total = HEADER + key_size + F.greatest(value_size, F.lit(0))
    reason = (
        F.when(b.isNull() | (F.octet_length(b) < HEADER), "short")
        .when(F.crc32(body) != F.conv(F.hex(F.substring(b, F.lit(1), F.lit(4))), 16, 10).cast("long"), "checksum")
        .when(key_size < 0, "key size")
        .when(value_size < TOMBSTONE, "value size")
        .when(F.octet_length(b) < total, "truncated")
    )
    dead = value_size == TOMBSTONE
    key = F.substring(b, F.lit(HEADER + 1), key_size).cast("string")
    value = F.when(dead, F.lit(b"")).otherwise(F.substring(b, HEADER + 1 + key_size, value_size))
    good = lambda c: F.when(reason.isNull(), c)
    return F.struct(good(key).alias("key"), good(value).alias("value"), good(read_int64(b, 4)).alias("ts"), good(dead).alias("tombstone"), reason.alias("corrupt_reason"))


def encode_index_entry(key: Column, ts: Column, value_size: Column, offset: Column) -> Column:
    return F.concat(int64(ts), int32(F.octet_length(key)), int32(value_size), int64(offset), utf8(key))


# ---------------------------------------------------------------- frames


def _sized(b: Column) -> Column:
    return F.concat(int32(F.octet_length(b)), b)


def request(op: str, payload: Column) -> Column:
    return F.concat(int8(F.lit(OPCODES[op])), _sized(payload))


def put_request(key: Column, value: Column) -> Column:
    return request("put", F.concat(_sized(utf8(key)), _sized(value)))


def get_request(key: Column) -> Column:
    return request("get", _sized(utf8(key)))


def delete_request(key: Column) -> Column:
    return request("delete", _sized(utf8(key)))


def range_request(start: Column, end: Column) -> Column:
    return request("range", F.concat(_sized(utf8(start)), _sized(utf8(end))))


def joined(parts: Column) -> Column:
    """The bytes of an array one after another, in one pass over them."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _entries(pairs: Column) -> Column:
    """count and the sized keys and values of array<struct<key, value>>."""
    return F.concat(int32(F.size(pairs)), joined(F.transform(pairs, lambda p: F.concat(_sized(utf8(p["key"])), _sized(p["value"])))))


def batch_request(pairs: Column) -> Column:
    return request("batch", _entries(pairs))


def compact_request() -> Column:
    return request("compact", F.lit(b""))


def response(status: str, payload: Column) -> Column:
    return F.concat(int8(F.lit(STATUS[status])), _sized(payload))


def ok_long(n: Column) -> Column:
    return response("ok", int64(n))


def range_response(pairs: Column) -> Column:
    """pairs in any order; the response has them ascending by key."""
    return response("ok", _entries(F.array_sort(pairs)))


def redirect(host: Column, port: Column) -> Column:
    return response("redirect", F.concat(_sized(utf8(host)), int32(port)))


def decode_response(b: Column) -> Column:
    return F.struct(F.conv(F.hex(F.substring(b, F.lit(1), F.lit(1))), 16, 10).cast("int").alias("status"), F.substring(b, F.lit(6), read_int32(b, 1)).alias("payload"))


def read_sized(b: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(b, at + 5, read_int32(b, at))


def decode_redirect(payload: Column) -> Column:
    host = read_sized(payload, 0)
    return F.struct(host.cast("string").alias("host"), read_int32(payload, 4 + F.octet_length(host)).alias("port"))


def decode_entries(payload: Column) -> Column:
    """array<struct<key, value>> of a range response's or batch request's payload, for few entries; frames.Entries gives rows."""
    start = F.struct(F.lit(4).alias("at"), F.array().cast("array<struct<key:string,value:binary>>").alias("out"))

    def step(acc, _):
        key = read_sized(payload, acc["at"])
        value = read_sized(payload, acc["at"] + 4 + F.octet_length(key))
        after = acc["at"] + 8 + F.octet_length(key) + F.octet_length(value)
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(F.struct(key.cast("string").alias("key"), value.alias("value")))).alias("out"))

    n = read_int32(payload, 0)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step)["out"]).otherwise(start["out"])
