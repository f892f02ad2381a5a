"""The key index fed by a stream of log segments.

State is one row a key, kept for good: the store never expires keys, so there is no watermark. Late rows meet the
state by position, so files that arrive out of order end in the same view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RECORD


def read_segments(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).parquet(folder)


def streaming_live(log: DataFrame) -> DataFrame:
    """Complete- or update-mode rows of each key's last operation; op tells deletions."""
    last = F.max_by(F.struct("op", "value", "ts", "seq"), "seq").alias("r")
    return log.groupBy("key").agg(last).select("key", "r.op", "r.value", "r.ts", "r.seq")


def append_once(store, stream: str = "stream", compact: bool = False):
    """A foreachBatch sink that appends each micro-batch to a store once, also when it is run again.

    With compact, the store is compacted behind a batch whenever its dead share reaches the threshold.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        if store.append(batch, commit=(stream, batch_id)) and compact:
            store.maybe_compact()

    return sink


_FRONTS = "key array<string>, dead array<long>, n array<int>, ts array<long>, seq array<long>, value array<binary>"


def _front(dead: int, puts: list[tuple]) -> list[tuple]:
    """Of puts (ts, seq, value) those behind dead that no other beats in both, the last position first."""
    kept: list[tuple] = []
    for p in sorted((p for p in puts if p[1] > dead), key=lambda p: -p[1]):
        if not kept or p[0] > kept[-1][0]:
            kept.append(p)
    return kept


def streaming_replay(log: DataFrame, buckets: int = 4096) -> DataFrame:
    """Update-mode rows (key, value, ts, seq) of the replay view; value, ts and seq are null once a key is dead.

    Rows may come in any order. A key's state is its last deletion and the puts behind it that no other put beats in both
    position and timestamp: a later deletion may still strike any put that is ahead now. Such puts have falling timestamps at
    rising positions, so where clocks don't run back there is one.

    The keys of a bucket share a state row and a call of Python, which costs milliseconds whatever it holds. A bucket that a
    batch touches is written whole, so stores of very many keys want more buckets; a stream keeps its number for good.
    """
    import pandas as pd

    def fold(_, frames, state):
        held = {}
        if state.exists:
            keys, deads, counts, *fronts = state.get
            puts = zip(*fronts, strict=True)
            held = {k: (dead, [next(puts) for _ in range(n)]) for k, dead, n in zip(keys, deads, counts, strict=True)}
        touched = {}
        for frame in frames:
            came: dict = {}
            for key, op, ts, seq, value in zip(*(frame[c].tolist() for c in ("key", "op", "ts", "seq", "value")), strict=True):
                gone, puts = came.setdefault(key, ([-1], []))
                gone.append(seq) if op == "delete" else puts.append((ts, seq, value))
            for key, (gone, puts) in came.items():
                dead, front = held.get(key, (-1, []))
                dead = max(dead, *gone)
                held[key] = touched[key] = (dead, _front(dead, front + puts))
        kept = [p for _, front in held.values() for p in front]
        state.update((list(held), [dead for dead, _ in held.values()], [len(front) for _, front in held.values()], [p[0] for p in kept], [p[1] for p in kept], [None if p[2] is None else bytes(p[2]) for p in kept]))
        ahead = [front[-1] if front else (None, None, None) for _, front in touched.values()]
        ts, seq, value = zip(*ahead, strict=True) if ahead else ((), (), ())
        yield pd.DataFrame({"key": list(touched), "value": list(value), "ts": pd.array(ts, "Int64"), "seq": pd.array(seq, "Int64")})

    rows = log.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "op", "ts", "seq", "value")
    return rows.groupBy("bucket").applyInPandasWithState(fold, "key string, value binary, ts long, seq long", _FRONTS, "update", "NoTimeout")
