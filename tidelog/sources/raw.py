"""Raw segment and index files: a Python data source (formats ``kvlog`` and ``kvhint``) and the sink.

Records have no fixed width, so a file is walked from its start, in bounded pieces; an input partition walks one large
file or many small ones. The walk ends at the first record that is cut off or damaged, as recovery does; with option
``strict`` it fails instead. With option ``all`` a last row tells why the walk ended. With ``values`` false the rows have
value_size in place of the value. Names that start with a dot are unfinished files and no data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codec import encode_index_entry, encode_record, encode_tombstone
from ..schema import HEADER, INDEX_HEADER
from .scratch import scratch_folder

PIECE = 4 << 20
PARTITIONS = 256  # of a folder, while they have between LEAST and MOST bytes
LEAST, MOST = 4 << 20, 64 << 20
OPENING = 16 << 10  # what opening a file counts as, in bytes
LOG_SCHEMA = "file_id string, offset long, record_size int, key string, value binary, ts long, tombstone boolean, corrupt_reason string"
HINT_SCHEMA = "file_id string, key string, ts long, value_size int, offset long"


def walk_records(f, size: int):
    """(offset, size, key, value, ts, tombstone, reason) of each record; the last one may have a reason."""
    data, base, at = b"", 0, 0
    while base + at < size:
        need = HEADER
        for _ in range(2):
            if len(data) - at < need and base + len(data) < size:
                data, base, at = data[at:] + f.read(max(PIECE, need - (len(data) - at))), base + at, 0
            if len(data) - at < need:
                yield base + at, len(data) - at, None, None, None, None, "truncated"
                return
            crc, ts, key_size, value_size = struct.unpack_from(">Iqii", data, at)
            if key_size < 0 or value_size < -1:
                yield base + at, HEADER, None, None, None, None, "size"
                return
            need = HEADER + key_size + max(value_size, 0)
            if need > size - base - at:  # a damaged size would ask for more than there is
                yield base + at, size - base - at, None, None, None, None, "truncated"
                return
        body = data[at + 4 : at + need]
        if zlib.crc32(body) != crc:
            yield base + at, need, None, None, None, None, "checksum"
            return
        key = body[16 : 16 + key_size].decode("utf-8", "replace")
        yield base + at, need, key, body[16 + key_size :], ts, value_size == -1, None
        at += need


def walk_index(f, size: int):
    """(key, ts, value size, offset) of each whole entry; a partial last one ends the walk."""
    data, base, at = b"", 0, 0
    while base + at + INDEX_HEADER <= size:
        if len(data) - at < INDEX_HEADER:
            data, base, at = data[at:] + f.read(PIECE), base + at, 0
        ts, key_size, value_size, offset = struct.unpack_from(">qiiq", data, at)
        need = INDEX_HEADER + key_size
        if key_size < 0 or base + at + need > size:
            return
        if len(data) - at < need:
            data, base, at = data[at:] + f.read(max(PIECE, need)), base + at, 0
        yield data[at + INDEX_HEADER : at + need].decode("utf-8", "replace"), ts, value_size, offset
        at += need


def files_in(folder: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the finished files of a folder, sorted."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    return sorted((i.base_name, i.size) for i in files.get_file_info(fs.FileSelector(path)) if i.base_name.endswith(suffix) and not i.base_name.startswith("."))


def names_in(folder: str, suffix: str) -> list[str]:
    return [n for n, _ in files_in(folder, suffix)]


def bundles(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Names in groups of like weight: no group is above the target but a file that is so by itself."""
    target = min(max(sum(n + OPENING for _, n in sizes) // PARTITIONS, LEAST), MOST)
    out, weight = [], 0
    for name, n in sizes:
        if not out or weight + n + OPENING > target:
            out.append([])
            weight = 0
        out[-1].append(name)
        weight += n + OPENING
    return out


@dataclass
class Files(InputPartition):
    names: list[str]


class _Reader(DataSourceReader):
    suffix = ".data"

    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.strict = options.get("strict", "false").lower() == "true"
        self.all = options.get("all", "false").lower() == "true"
        self.values = options.get("values", "true").lower() == "true"

    def partitions(self):
        return [Files(names) for names in bundles(files_in(self.folder, self.suffix))] or [Files([])]

    def read(self, part):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.folder)
        held, weight = [], 0
        for name in part.names:
            size = files.get_file_info(f"{path}/{name}").size
            with files.open_input_stream(f"{path}/{name}") as f:
                for n, row in self.rows(f, size, name.removesuffix(self.suffix)):
                    held.append(row)
                    weight += n
                    if weight >= PIECE:
                        yield self.batch(held)
                        held, weight = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows):
        names, kinds = zip(*self.columns(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


class LogReader(_Reader):
    def columns(self):
        value = ("value", pa.binary()) if self.values else ("value_size", pa.int32())
        return [("file_id", pa.string()), ("offset", pa.int64()), ("record_size", pa.int32()), ("key", pa.string()), value, ("ts", pa.int64()), ("tombstone", pa.bool_()), ("corrupt_reason", pa.string())]

    def rows(self, f, size, file_id):
        for offset, n, key, value, ts, dead, reason in walk_records(f, size):
            if reason and self.strict:
                raise ValueError(f"{file_id} at {offset}: {reason}")
            if reason and not self.all:
                return
            if not self.values and value is not None:
                value = len(value)
            yield n, (file_id, offset, n, key, value, ts, dead, reason)


class HintReader(_Reader):
    suffix = ".hint"

    def columns(self):
        return [("file_id", pa.string()), ("key", pa.string()), ("ts", pa.int64()), ("value_size", pa.int32()), ("offset", pa.int64())]

    def rows(self, f, size, file_id):
        for key, ts, value_size, offset in walk_index(f, size):
            yield INDEX_HEADER + len(key), (file_id, key, ts, value_size, offset)


class LogSource(DataSource):
    @classmethod
    def name(cls):
        return "kvlog"

    def schema(self):
        values = self.options.get("values", "true").lower() == "true"
        return LOG_SCHEMA if values else LOG_SCHEMA.replace("value binary", "value_size int")

    def reader(self, schema):
        return LogReader(self.options)


class HintSource(DataSource):
    @classmethod
    def name(cls):
        return "kvhint"

    def schema(self):
        return HINT_SCHEMA

    def reader(self, schema):
        return HintReader(self.options)


def read_log(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(LogSource)
    return spark.read.format("kvlog").options(path=folder, **options).load()


def read_hints(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(HintSource)
    return spark.read.format("kvhint").options(path=folder).load()


def _write_files(rows: DataFrame, folder: str, suffix: str) -> None:
    """rows(file_id, offset, bytes): a task writes its files whole under a name of its own first, then renames them.

    Attempts that run side by side don't share those names; the one that ends last puts the same bytes in place again.
    """

    def store(batches):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        out, current, n, attempt = None, None, 0, uuid.uuid4().hex

        def finish():
            out.close()
            files.move(f"{path}/.{current}-{attempt}{suffix}", f"{path}/{current}{suffix}")

        for batch in batches:
            for file_id, data in zip(batch["file_id"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if file_id != current:
                    if out is not None:
                        finish()
                    current, n = file_id, n + 1
                    out = files.open_output_stream(f"{path}/.{current}-{attempt}{suffix}")
                out.write(data)
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    rows.select("file_id", "offset", "bytes").repartition("file_id").sortWithinPartitions("file_id", "offset").mapInArrow(store, "n long").agg(F.sum("n")).collect()


def write_log(segments: DataFrame, folder: str) -> None:
    """Segments (a log with file_id and offset) as raw files."""
    data = F.when(F.col("op") == "delete", encode_tombstone(F.col("key"), F.col("ts"))).otherwise(encode_record(F.col("key"), F.coalesce("value", F.lit(b"")), F.col("ts")))
    _write_files(segments.withColumn("bytes", data), folder, ".data")


def write_hints(keydir: DataFrame, folder: str) -> None:
    """Index files of the live keys; a file without live keys gets none."""
    _write_files(keydir.withColumn("bytes", encode_index_entry(F.col("key"), F.col("ts"), F.col("value_size"), F.col("offset"))), folder, ".hint")


def recover(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """(index rows, whether any file was there): index files if every data file has one, else a replay of the log."""
    from ..operators.views import live_hints

    data = {n.removesuffix(".data") for n in names_in(folder, ".data")}
    if data and data <= {n.removesuffix(".hint") for n in names_in(folder, ".hint")}:
        return live_hints(read_hints(spark, folder)), True
    walked, table = read_log(spark, folder, values="false").drop("corrupt_reason"), scratch_folder(spark, "walked")
    walked.write.parquet(table)  # a replay reads it twice, and files are walked once
    return replay(spark.read.schema(walked.schema).parquet(table)), bool(data)


def read_at(places: DataFrame, folder: str) -> DataFrame:
    """places(file_id, offset, record_size, ...) with bytes, the record that lies there; a place outside its file fails.

    A place whose file isn't there gives null, as a lookup in a dropped file does. Places of one file are dealt out in
    pieces of it and read in order.
    """

    def fetch(batches):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        name, f, size = None, None, 0
        for batch in batches:
            data = []
            for file_id, offset, n in zip(*(batch[c].to_pylist() for c in ("file_id", "offset", "record_size")), strict=True):
                if file_id != name:
                    if f is not None:
                        f.close()
                    info = files.get_file_info(f"{path}/{file_id}.data")
                    name, size = file_id, info.size
                    f = files.open_input_file(info.path) if info.type == fs.FileType.File else None
                if f is not None and (offset < 0 or offset + n > size):
                    raise EOFError(f"{file_id}: {n} bytes at {offset} of {size}")
                data.append(f.read_at(n, offset) if f is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "bytes"])
        if f is not None:
            f.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields)
    dealt = places.repartition("file_id", F.floor(F.col("offset") / F.lit(64 << 20))).sortWithinPartitions("file_id", "offset")
    return dealt.mapInArrow(fetch, f"{fields}, bytes binary")


def replay(records: DataFrame) -> DataFrame:
    """The index by replaying records, read without values, in order of file and offset."""
    place = F.struct("file_id", "offset")
    dead = F.max(F.when(F.col("tombstone"), place))
    lost = records.groupBy("key").agg(dead.alias("dead"))
    puts = records.where("not tombstone").join(lost, "key").where(F.col("dead").isNull() | (place > F.col("dead")))
    best = F.max_by(F.struct("ts", "value_size", "offset", "file_id", "record_size"), F.struct("ts", "file_id", "offset")).alias("r")
    return puts.groupBy("key").agg(best).select("key", "r.ts", "r.value_size", "r.offset", "r.file_id", F.col("r.record_size").cast("long").alias("record_size"))
