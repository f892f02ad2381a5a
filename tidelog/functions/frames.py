"""A stream buffer's complete frames, one row each: a Python table function, as frames have no fixed width."""

from __future__ import annotations

import struct

from pyspark.sql.functions import udtf


def split_frames(data: bytes):
    """(number, code, payload, bytes used so far) of each complete frame; an incomplete rest gives nothing."""
    at, n = 0, 0
    while at + 5 <= len(data):
        code, size = struct.unpack_from(">bi", data, at)
        if size < 0 or at + 5 + size > len(data):
            return
        yield n, code, data[at + 5 : at + 5 + size], at + 5 + size
        at, n = at + 5 + size, n + 1


@udtf(returnType="frame int, code int, payload binary, used int")
class Frames:
    def eval(self, data: bytes):
        yield from split_frames(bytes(data) if data is not None else b"")


def split_entries(data: bytes):
    """(number, key, value) of each whole entry of a range response's or batch request's payload."""
    if len(data) < 4:
        return
    (count,), at = struct.unpack_from(">i", data), 4
    for n in range(count):
        both = []
        for _ in range(2):
            if at + 4 > len(data):
                return
            (size,) = struct.unpack_from(">i", data, at)
            if size < 0 or at + 4 + size > len(data):
                return
            both.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        yield n, both[0].decode("utf-8", "replace"), both[1]


@udtf(returnType="n int, key string, value binary")
class Entries:
    def eval(self, data: bytes):
        yield from split_entries(bytes(data) if data is not None else b"")
