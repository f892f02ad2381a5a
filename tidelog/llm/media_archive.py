"""Media columns: a Spark data source over directories of archives.

``write_archives`` stores one member a row: the row's UTF-8 bytes, padded with bytes 255 to a positive multiple
of 576, as the samples of an 8-bit grey PNG of width 576, in zip archives (members stored, not compressed
again) of bounded size in a shared folder. Archives are streamed out member by member. A task writes under names of
its own, and only what finished tasks report enters the folder's list (one line an archive of ARCHIVE_BYTES), so
retried or lost tasks leave nothing that is read.

``MediaArchiveSource`` (format ``media_archive``) plans byte ranges over the listed archives from their sizes
alone, without opening them; a range's reader takes the members whose headers start in it from the archive's
directory, fetches each by its offset, checks its CRC, and retries just that member when it fails. Payloads
leave in Arrow batches of bounded bytes. A member that fails all tries gives a row with ``error`` set.

Null text is stored as empty text (576 padding bytes). Repeated rows are stored each. An empty table gives an
empty folder list and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 576
ARCHIVE_BYTES = 1 << 30
ARCHIVE_MEMBERS = 1_000_000
RANGE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
LISTING = "_archives.json"

_PNG = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- payloads and samples


def payload_of(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % WIDTH or (WIDTH if not data else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a leading 0 on each line: no filter
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey PNG as encode_png writes it; raises ValueError on anything else or damage."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, width, height, body = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("bad chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy, and shares of 8 levels, all to fixed digits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = len(payload)
    level = np.arange(256)
    mean = float((counts * level).sum()) / n
    spread = max(0.0, float((counts * level * level).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    shares = counts.reshape(8, 32).sum(1) * 1000 // n
    return f"mean={mean:.3f};std={spread:.3f};entropy={0.0 - (p * np.log2(p)).sum():.3f};levels={'/'.join(map(str, shares))}"


# ---------------------------------------------------------------- archives


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANY = 0xFFFF  # entries from which on a zip directory needs its wide end record


class _ArchiveWriter:
    """Streams members to archives under folder and rolls over at the limits."""

    def __init__(self, folder: str):
        self.folder, self.out, self.done = folder, None, []

    def add(self, name: str, media: bytes) -> None:
        if self.out is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.zip"
            files, path = _open(self.uri)
            self.out, self.directory, self.members, self.bytes = files.open_output_stream(path), io.BytesIO(), 0, 0
        data, crc = name.encode(), zlib.crc32(media)
        # version, flags, method, time, date, CRC, sizes, lengths: the same in the header and the directory
        fields = struct.pack("<HHHHHLLLHH", 20, 0, 0, 0, 0x21, crc, len(media), len(media), len(data), 0)
        self.directory.write(b"PK\x01\x02" + struct.pack("<H", 20) + fields + struct.pack("<HHHLL", 0, 0, 0, 0, self.bytes) + data)
        for part in (b"PK\x03\x04", fields, data, media):
            self.out.write(part)
        self.members, self.bytes = self.members + 1, self.bytes + 30 + len(data) + len(media)
        if self.bytes >= ARCHIVE_BYTES or self.members >= ARCHIVE_MEMBERS:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            size, n = self.directory.tell(), self.members
            self.out.write(self.directory.getvalue())
            if n >= _MANY:
                self.out.write(b"PK\x06\x06" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, n, n, size, self.bytes))
                self.out.write(b"PK\x06\x07" + struct.pack("<LQL", 0, self.bytes + size, 1))
            few = min(n, _MANY)
            self.out.write(b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, few, few, size, self.bytes, 0))
            self.out.close()
            self.done.append((self.uri, n))
            self.out = None


def write_archives(docs: DataFrame, folder: str) -> int:
    """Stores docs(doc_id, text, ...) as archives in folder and lists them there; returns the number of members.

    A member's name is its running number in the archive and its doc_id ("null" for none).
    """
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def store(batches):
        writer, n = _ArchiveWriter(folder), 0
        for part, buf, off in common.parts(batches, "text"):
            data = buf.tobytes()
            for i, key in enumerate(part["doc_id"].to_pylist()):
                writer.add(f"{n:07d}_{'null' if key is None else key}", encode_png(payload_of(data[off[i] : off[i + 1]])))
                n += 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in writer.done], pa.string()), pa.array([m for _, m in writer.done], pa.int64())], names=["archive", "members"])

    # one row an archive of ARCHIVE_BYTES: as few as files that Spark lists itself
    archives = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(store, "archive string, members long").collect()
    with files.open_output_stream(f"{path}/{LISTING}") as out:
        out.write("\n".join(json.dumps({"archive": r.archive.rpartition("/")[2], "members": r.members}) for r in archives).encode())
    return sum(r.members for r in archives)


def archive_directory(f, start: int = 0, stop: int | None = None) -> list[tuple[str, int]]:
    """(member name, header offset) of each entry of the archive's directory whose offset is in start..stop, in its order."""
    end = f.size() - 22
    sign, _, _, _, n, size, at, _ = struct.unpack("<4s4H2LH", f.read_at(22, end))
    if sign != b"PK\x05\x06":
        raise ValueError("no directory at the archive's end")
    if n == _MANY:  # the wide end record has the number
        sign, place = struct.unpack("<4s4xQ4x", f.read_at(20, end - 20))
        if sign == b"PK\x06\x07":
            n, size, at = struct.unpack("<32xQQQ", f.read_at(56, place))
    table, at, out = f.read_at(size, at), 0, []
    for _ in range(n):
        name, extra, comment = struct.unpack_from("<3H", table, at + 28)
        offset = struct.unpack_from("<L", table, at + 42)[0]
        if offset >= start and (stop is None or offset < stop):
            out.append((table[at + 46 : at + 46 + name].decode(), offset))
        at += 46 + name + extra + comment
    return out


def read_member(f, offset: int) -> bytes:
    """The payload of the member whose header starts at offset; ValueError on damage."""
    head = f.read_at(30, offset)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member header")
    method, crc, size, name, extra = struct.unpack("<8xH4xL4xLHH", head)
    data = f.read_at(size, offset + 30 + name + extra)
    if method or len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged member")
    return data


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self):
        files, path = _open(self.folder)
        with files.open_input_stream(f"{path}/{LISTING}") as f:
            names = [json.loads(x)["archive"] for x in f.read().decode().splitlines() if x]
        out = []
        for info in files.get_file_info([f"{path}/{x}" for x in names]):
            uri = f"{self.folder}/{info.base_name}"
            out += [ByteRange(uri, at, min(at + self.range_bytes, info.size)) for at in range(0, info.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def _retry(self, uri: str, what):
        """what(file), on a newly opened file each time it failed."""
        for k in range(self.tries):
            try:
                files, path = _open(uri)
                with files.open_input_file(path) as f:
                    return what(f), None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**k if k + 1 < self.tries else 0)
        return None, error

    def read(self, part: ByteRange):
        if not part.archive:
            return
        members, error = self._retry(part.archive, lambda f: archive_directory(f, part.start, part.end))
        if members is None:
            raise OSError(f"{part.archive}: {error}")
        files, path = _open(part.archive)
        rows, held = [], 0
        with files.open_input_file(path) as f:
            for name, offset in members:
                try:
                    media, error = read_member(f, offset), None
                except (OSError, ValueError, struct.error):
                    media, error = self._retry(part.archive, lambda g, o=offset: read_member(g, o))
                rows.append((part.archive, offset, name, media, error))
                held += len(media or b"")
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "media", "error"])


class MediaArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "archive string, offset long, name string, media binary, error string"

    def reader(self, schema):
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def media_columns(members: DataFrame) -> DataFrame:
    """Per member: doc_id, sizes, digests and the feature of what is stored. A member that couldn't be read fails the query."""

    def run(batches):
        for batch in batches:
            out = []
            for name, media, error in zip(*(batch[c].to_pylist() for c in ("name", "media", "error")), strict=True):
                if error is not None:
                    raise OSError(f"{name}: {error}")
                payload = decode_png(media)
                key = name.partition("_")[2]
                data = payload.rstrip(b"\xff")  # 255 is never a byte of UTF-8
                out.append((None if key == "null" else int(key), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return members.select("name", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
