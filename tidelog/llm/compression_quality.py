"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text is compressed
whole with either; the difference of the two sizes over their sum is its only feature. Labelled texts that
took no part in the dictionaries calibrate that difference to a probability (logistic, by Newton steps), each
class weighing as much as it has among all labelled rows that aren't held out, so that scores are probabilities.

The labelled sample that trains is bounded by ``sample_rows`` a class (documented, chosen by a hash of
doc_id). Its texts take part whole: those that calibrate are compressed whole, on the executors, and dictionary
pieces come from all over the others; where those exceed ``sample_bytes`` a class, pieces are chosen by hash.
Everything else is one pass over the documents with the two dictionaries, whose size is fixed.

Nulls: a null text scores as an empty one: its difference is 0, so it gets the calibrated score of 0. A label
row with a null doc_id or quality teaches nothing; labels with conflicting rows for one doc_id teach nothing.
Without labels of both classes every score is 0.5. Repeated rows are scored each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SAMPLE_ROWS = 3000  # labelled documents of each class that train, at most
SAMPLE_BYTES = 8 << 20  # of dictionary pieces a class, at most, from all over its texts
PIECE = 2000  # bytes of a dictionary piece
DICT_BYTES = 32 << 10
SMOOTHING = 100  # bytes added to the sum that the difference is divided by, so that frame overhead doesn't decide on short texts
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5  # rows whose crc32(doc_id) mod FOLDS is 0 are held out


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    level: int = LEVEL

    def scorer(self):
        """A function from UTF-8 bytes to the score of a text."""
        if not self.good:
            return lambda data: 0.5
        sides = _sides(self.good, self.bad, self.level)

        def score(data: bytes) -> float:
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * difference(sides, data) + self.bias))))

        return score


def _loaded(data: bytes, level: int):
    import zstandard as z

    d = z.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return d


def difference(sides, data: bytes) -> float:
    """Normalised: positive where the good dictionary compresses the text better."""
    if not data:
        return 0.0
    good, bad = (len(s.compress(data)) for s in sides)
    return (bad - good) / (bad + good + SMOOTHING)


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    import zstandard as z

    total = sum(map(len, pieces))
    try:
        return z.train_dictionary(min(size, max(1024, total // 4)), pieces, level=LEVEL, threads=0).as_bytes()
    except z.ZstdError:  # too few samples to train: the raw content serves as the dictionary
        return b"".join(pieces)[-size:] or b" " * 8


def _calibrate(x: np.ndarray, y: np.ndarray, weight: dict[int, float]) -> tuple[float, float]:
    """Logistic slope and bias by penalised Newton steps; weight is each class's share."""
    scale = max(float(np.std(x)), 1e-6)
    a = np.stack([x / scale, np.ones_like(x)], 1)
    # two soft points a side keep the fit finite where the classes part cleanly
    w = np.where(y == 1, weight[1] / max(1, (y == 1).sum()), weight[0] / max(1, (y == 0).sum())) * len(y)
    soft = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        grad = a.T @ (w * (p - soft)) + np.array([1e-3, 0]) * beta
        hess = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def _pieces(sample: DataFrame, share: dict[int, float]) -> dict[int, list[bytes]]:
    """Dictionary pieces of each class, of the share of them that their hashes choose."""

    def cut(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for q, text in zip(batch["q"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                keyed = [(xxh3_64_intdigest(p), p) for p in pieces if len(p) >= 8]
                keyed = [(k - (1 << 63), p) for k, p in keyed if k < share[q] * 2**64]
                if keyed:
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(keyed), pa.int32()), pa.array([k for k, _ in keyed], pa.int64()), pa.array([p for _, p in keyed], pa.binary())], names=["q", "k", "piece"])

    out: dict[int, list[bytes]] = {0: [], 1: []}
    rows = sorted((r.q, r.k, bytes(r.piece)) for r in sample.select("q", "text").mapInArrow(cut, "q int, k long, piece binary").toLocalIterator())
    for q, _, piece in rows:
        out[q].append(piece)
    return out


def _sides(good: bytes, bad: bytes, level: int = LEVEL):
    import zstandard as z

    return [z.ZstdCompressor(dict_data=_loaded(d, level), level=level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]


def _differences(sample: DataFrame, good: bytes, bad: bytes) -> list[tuple[float, int]]:
    """(difference, class) of each whole text of the sample, sorted."""

    def run(batches):
        sides = _sides(good, bad)
        for batch in batches:
            found = [difference(sides, t.encode("utf-8", "replace")) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch["q"]], names=["x", "q"])

    return sorted((r.x, r.q) for r in sample.select("text", "q").mapInArrow(run, "x double, q int").collect())


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on labelled rows that aren't held out; half of the sample's texts build dictionaries, half calibrate."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    known = known.where(~held_out()).select("doc_id", "q", F.xxhash64("doc_id", F.lit(11)).alias("u"))
    chosen = known.where("q = 0").orderBy("u").limit(sample_rows).unionByName(known.where("q = 1").orderBy("u").limit(sample_rows))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # equal texts are on one side
    sample = materialize(texts.groupBy("q", F.sha2("text", 256).alias("t")).agg(F.first("text").alias("text")).withColumn("side", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int")), "quality-sample")
    size = {(r.q, r.side): (r.n, r.bytes) for r in sample.groupBy("q", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if any((q, 0) not in size and (q, 1) not in size for q in (0, 1)):
        return Model(b"", b"", 0.0, 0.0)
    # a class of few texts may have a side without any: then all of them are on both
    on = lambda side: sample.where(F.expr(" or ".join(f"(q = {q}" + (f" and side = {side})" if (q, side) in size else ")") for q in (0, 1))))
    total = {q: (size.get((q, 0)) or size[(q, 1)])[1] for q in (0, 1)}
    pieces = _pieces(on(0), {q: min(1.0, sample_bytes / max(1, total[q])) for q in (0, 1)})
    good, bad = (_dictionary(pieces[q], dict_bytes) for q in (1, 0))
    seen = _differences(on(1), good, bad)
    count = {r.q: r["count"] for r in known.groupBy("q").count().collect()}
    discard(sample)
    slope, bias = _calibrate(np.array([d for d, _ in seen]), np.array([q for _, q in seen]), {q: n / sum(count.values()) for q, n in count.items()})
    return Model(good, bad, slope, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of docs(doc_id, text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches):
        rate = shared.value.scorer()
        for batch in batches:
            texts = batch["text"].cast(pa.large_binary())
            scores = [rate(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text the model doesn't reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        rate = shared.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            keep = [rate(t.as_buffer().to_pybytes() if t.is_valid else b"") >= threshold for t in texts]
            if any(keep):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
