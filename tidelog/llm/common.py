"""What the corpus operators share: scratch tables, byte-balanced batches, word and shingle hashing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20  # bytes of text that the vectorised kernels take at once

U = np.uint64


# ---------------------------------------------------------------- tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a local session may go without, and gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = getattr(spark, "_tidelog_scratch", None) or tempfile.mkdtemp(prefix="tidelog-")
        spark._tidelog_scratch = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables whose every use has been written out."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for the jobs run inside, where rows are long; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ---------------------------------------------------------------- batches


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def byte_ranges(offsets: np.ndarray, target: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about target bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def parts(batches, column: str, target: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the Arrow batches with about target bytes of text: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in byte_ranges(off, target):
            yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    r = np.random.Generator(np.random.PCG64(seed))
    t = r.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
    p = int(r.integers(1, 1 << 62)) * 4 + 3
    return t, p, pow(p, -1, 1 << 64)


_T, _P, _Q = _tables(20240607)
_T_FOLDED = _T.copy()
_T_FOLDED[65:91] = _T[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and the inverses, modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_P, _Q):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * U(pow(base, done, 1 << 64))
                done *= 2
            both.append(out)
        if size <= 4 * CHUNK:
            _POWERS[size] = tuple(both)
        return tuple(both)
    return _POWERS[size]


def rolling(buf: np.ndarray, folded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(C, inverse powers): the hash of bytes i..j is (C[j] - C[i]) * inverse[i]."""
    p, q = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_T_FOLDED if folded else _T)[buf] * p[: len(buf)], out=c[1:])
    return c, q


def class_table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Word bytes of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing A-Z).
NOT_SPACE = class_table(lambda b: b != 32 and not 9 <= b <= 13)
ALNUM = class_table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each row): maximal runs of word bytes that don't cross rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal (case-folded) words in any batch."""
    c, q = rolling(buf, folded)
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, in order, and the row offsets into them.

    A row of fewer than k words, but not none, has one shingle: its whole sequence.
    """
    n_words = np.diff(word_offsets)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    start = np.repeat(word_offsets[:-1] - off[:-1], counts) + np.arange(off[-1])
    size = np.repeat(np.minimum(n_words, k), counts)
    out = size.astype(np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        term = padded[start + j] * U((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1) | 1)
        term ^= term >> U(29)
        out += np.where(size > j, term, U(0)) * U(0xD6E8FEB86659FD93 + 2 * j)
    return mix(out), off


def sha256_hex(data) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
