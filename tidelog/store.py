"""The store: a folder of Parquet segments behind a manifest that is swapped whole.

A write is on storage when it returns: as a small file of its rows in ``pending``, renamed into place. ``flush`` (and
every read) collects pending rows as one segment; a segment counts once the manifest names it, so a batch is all there
or not at all. Opening a store takes up what a lost writer left pending. There is one writer.

Readers pin the manifest they opened, so compaction needs no lock: segments that it replaces stay, listed in the
manifest with the time, until ``vacuum`` deletes those older than its grace period.
"""

from __future__ import annotations

import base64
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .operators import compaction, reads, segments, views
from .schema import BATCH, DELETE, MAX_FILE_SIZE, PUT, RECORD
from .sources import raw


class Store:
    def __init__(self, spark: SparkSession, path: str, max_file_size: int = MAX_FILE_SIZE, threshold: float = compaction.THRESHOLD):
        self.spark, self.path, self.max_file_size, self.threshold = spark, path.rstrip("/"), max_file_size, threshold
        self.buffer: list[tuple] = []
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/pending"))
        self.manifest = self._load()
        self._take_pending()

    # ---------------------------------------------------------------- manifest

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _load(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "segments": [], "next_seq": 0, "old": [], "commits": {}}
        text = self.spark.read.text(f"{self.path}/manifest-{versions[-1]:010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _swap(self, manifest: dict) -> None:
        """Writes the next version aside and renames it into place; the rename fails if another writer was first."""
        before = self.manifest["version"]
        manifest = manifest | {"version": before + 1}
        self._write_whole(f"{self.path}/manifest-{manifest['version']:010d}.json", json.dumps(manifest).encode())
        self.manifest = manifest
        for name in self._names("pending"):  # they are in the segments now, or were refused
            if name < f"{before + 1:010d}":
                self._fs.delete(self._Path(f"{self.path}/pending/{name}"), False)

    # ---------------------------------------------------------------- writes

    def put(self, key: str, value: bytes) -> None:
        if key is None or value is None:
            raise ValueError("key and value are needed")
        self._accept([(key, value, self._now(), PUT)])

    def delete(self, key: str) -> None:
        if key is None:
            raise ValueError("a key is needed")
        self._accept([(key, None, self._now(), DELETE)])

    def batch_put(self, keys: list[str], values: list[bytes]) -> None:
        """Commits at once, with one timestamp; the last of a repeated key wins."""
        if len(keys) != len(values):
            raise ValueError("keys and values differ in number")
        ts = self._now()
        if any(k is None or v is None for k, v in zip(keys, values, strict=True)):
            raise ValueError("key and value are needed")
        self._accept([(k, v, ts, BATCH) for k, v in zip(keys, values, strict=True)])

    def _accept(self, rows: list[tuple]) -> None:
        """Writes the rows as one pending file under the place they will have; a batch's rows are there together."""
        if not rows:
            return
        if self._fs.exists(self._Path(f"{self.path}/manifest-{self.manifest['version'] + 1:010d}.json")):
            raise RuntimeError("another writer has committed")
        first = self.manifest["next_seq"] + len(self.buffer)
        text = json.dumps([[k, None if v is None else base64.b64encode(v).decode(), ts, op] for k, v, ts, op in rows])
        self._write_whole(f"{self.path}/pending/{self.manifest['version']:010d}-{first:020d}.json", text.encode())
        self.buffer += rows

    def _take_pending(self) -> None:
        """Rows that a writer of this manifest's version acknowledged and didn't flush; others are in a segment or refused."""
        mine, names = f"{self.manifest['version']:010d}-", self._names("pending")
        for name in sorted(n for n in names if n.startswith(mine) and n.endswith(".json")):
            text = self.spark.read.text(f"{self.path}/pending/{name}", wholetext=True).first()[0]
            self.buffer += [(k, None if v is None else base64.b64decode(v), ts, op) for k, v, ts, op in json.loads(text)]

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/{folder}"))]

    def _write_whole(self, to: str, data: bytes) -> None:
        """Written aside, on storage, and renamed into place; fails if the name is taken."""
        aside = self._Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(data)
        out.hsync()
        out.close()
        to = self._Path(to)
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            self._fs.delete(aside, False)
            raise RuntimeError("another writer has committed")

    @staticmethod
    def _now() -> int:
        return int(time.time() * 1000)

    def flush(self) -> None:
        if self.buffer:
            base = self.manifest["next_seq"]
            rows = [(base + i, *r) for i, r in enumerate(self.buffer)]
            self._commit(self._write(self.spark.createDataFrame(rows, RECORD).coalesce(1)), len(rows))
            self.buffer = []

    def append(self, rows: DataFrame, commit: tuple[str, int] | None = None) -> bool:
        """Appends log rows (key, value, ts, op and an order in seq); False if that commit (stream, number) is in already.

        A stream's numbers rise, so the manifest keeps the last of each stream only.
        """
        self.flush()
        if commit is not None and commit[1] <= self.manifest["commits"].get(commit[0], -1):
            return False
        base = self.manifest["next_seq"]
        name = self._write(rows.select((F.lit(base) + F.col("seq")).cast("long").alias("seq"), "key", "value", "ts", "op"))
        top = self.spark.read.schema(RECORD).parquet(f"{self.path}/{name}").agg(F.max("seq")).first()[0]  # rows are made once
        if top is None:
            self._fs.delete(self._Path(f"{self.path}/{name}"), True)
            return False
        self._commit(name, top + 1 - base, commit)
        return True

    def _write(self, rows: DataFrame) -> str:
        """Writes the rows as a segment that no manifest names yet."""
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _commit(self, name: str, n: int, commit: tuple[str, int] | None = None) -> None:
        m = self.manifest
        self._swap(m | {"segments": [*m["segments"], name], "next_seq": m["next_seq"] + n, "commits": m["commits"] | (dict([commit]) if commit else {})})

    def rotate(self) -> None:
        """Closes the segment at hand: rows written from here on come in another."""
        self.flush()

    @classmethod
    def recovered(cls, spark: SparkSession, path: str, folder: str, **options) -> Store:
        """A new store of the rows that the raw files of a folder give after a crash: replayed, or as the index files say.

        Values are read at the places of the index. The files stay as they are; the store's writes come behind them.
        """
        store = cls(spark, path, **options)
        index, found = raw.recover(spark, folder)
        if found:
            rows = raw.read_at(index, folder).where("bytes is not null").select("file_id", "offset", codec.decode_record(F.col("bytes")).alias("r"))
            files = spark.createDataFrame([(n.removesuffix(".data"), i) for i, n in enumerate(raw.names_in(folder, ".data"))], "file_id string, i long")
            place = F.shiftleft(F.col("i"), 40) + F.col("offset")  # files in order, places in them: up to a terabyte each
            store.append(rows.join(F.broadcast(files), "file_id").select(place.alias("seq"), "r.key", "r.value", "r.ts", F.lit(PUT).alias("op")))
        return store

    # ---------------------------------------------------------------- reads

    def log(self) -> DataFrame:
        self.flush()
        names = self.manifest["segments"]
        if not names:
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.path}/{n}" for n in names])

    def live(self) -> DataFrame:
        return views.live_online(self.log())

    def snapshot(self) -> DataFrame:
        """The live rows as of now; later writes don't show, as the segments read are those of this manifest."""
        return views.live_as_of(self.log(), self.manifest["next_seq"] - 1)

    def get(self, key: str) -> bytes | None:
        row = views.live_online(self.log().where(F.col("key") == key)).first()
        return None if row is None else bytes(row.value)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.live(), keys)

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def size(self) -> int:
        return self.live().count()

    def keys(self) -> DataFrame:
        return reads.keys(self.live())

    def range(self, start: str, end: str, utf16: bool = False) -> DataFrame:
        if not utf16 and start.encode() <= end.encode():  # bounds reach the scan below the aggregate
            return reads.range_scan(views.live_online(self.log().where(F.col("key").between(start, end))), start, end)
        return reads.range_scan(self.live(), start, end, utf16)

    # ---------------------------------------------------------------- maintenance

    def segments(self) -> DataFrame:
        """The log with record_size, the segment of each row as its file_id, and the offset it would have there."""
        return segments.with_offsets(self._placed())

    def _placed(self) -> DataFrame:
        log = self.log()
        name = F.regexp_extract(F.col("_metadata.file_path"), "(segment-[0-9a-f]+)", 1) if self.manifest["segments"] else F.lit("")
        return views.sized(log.select("*", name.alias("file_id")))

    def raw_segments(self) -> DataFrame:
        """The log in files of max_file_size, as the raw layout has them: for ``raw.write_log``."""
        return segments.rotate(self.log(), self.max_file_size)

    def files(self) -> DataFrame:
        return segments.files(self.segments())

    def keydir(self) -> DataFrame:
        return views.keydir(self.segments())

    def dead_bytes(self) -> DataFrame:
        return segments.dead_bytes(self._placed())

    def should_compact(self) -> bool:
        """Whether the share of superseded bytes reaches the threshold; a store has no active segment left open."""
        if not self.manifest["segments"] and not self.buffer:
            return False
        sums = self.dead_bytes().agg(F.sum("dead_bytes").alias("dead"), F.sum("file_bytes").alias("all")).first()
        return bool(sums["all"]) and sums.dead / sums["all"] >= self.threshold

    def compact(self) -> dict[str, int]:
        """Rewrites the live rows, by key, as the only segment in use; bytes reclaimed once the others go, gross and net."""
        log = views.sized(self.log())
        before = log.agg(F.coalesce(F.sum("record_size"), F.lit(0))).first()[0]
        names, live = self.manifest["segments"], self.live()
        if not names:
            return {"gross": 0, "net": 0}
        name = f"segment-{uuid.uuid4().hex}"
        rows = live.select("seq", "key", "value", "ts", F.lit(PUT).alias("op"))
        rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{name}")
        after = views.sized(self.spark.read.schema(RECORD).parquet(f"{self.path}/{name}")).agg(F.coalesce(F.sum("record_size"), F.lit(0))).first()[0]
        self._swap(self.manifest | {"segments": [name], "old": [*self.manifest["old"], *[[n, self._now()] for n in names]]})
        return {"gross": before, "net": before - after}

    def vacuum(self, grace_sec: float = 3600.0) -> int:
        """Deletes segments that compaction replaced more than grace_sec ago; readers opened before that may lose them."""
        self.flush()
        until = self._now() - grace_sec * 1000
        gone = [n for n, at in self.manifest["old"] if at <= until]
        if gone:
            self._swap(self.manifest | {"old": [x for x in self.manifest["old"] if x[0] not in gone]})
            for n in gone:
                self._fs.delete(self._Path(f"{self.path}/{n}"), True)
        return len(gone)

    def maybe_compact(self) -> dict[str, int] | None:
        return self.compact() if self.should_compact() else None

    def close(self) -> None:
        self.flush()
