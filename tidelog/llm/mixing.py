"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents the copy probability target / source size.
The whole part of that is taken as it is. The fractional parts are rounded dependently: two documents meet,
mass moves at random from one to the other, weighted by their sizes so that the expected words stay as they
are, until one of the two is integral; the other meets the next. So every group of documents ends with at most
one fractional residual a source, and residuals of groups meet in a reduction tree of fixed fan-in until one a
source is left, which is rounded by itself. A source's taken words therefore differ from its target by less
than its largest document's size, while every document keeps its marginal probability.

Scale: one shuffle of (doc_id, source, size, p) rows by group, in groups of about GROUP rows chosen by a hash
of doc_id, so that a source with a third of all rows spreads evenly; then rows shrink by the fan-in at each
level. All random draws come from hashes of (seed, group, level), so reruns and retried tasks agree.

Nulls: a null source is a source of its own, last in order; a null text has size 0, and documents of size 0
take p like others but never words. Rows are told apart by a hash of all their columns, so the same table gives the
same mix however it is partitioned; rows equal in every column are rounded each for itself and are interchangeable.
An empty table gives no rows. Columns of any other name are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GROUP = 1024  # rows that meet in one first-level group, of all sources
FAN_IN = 32  # groups whose residuals meet at each further level
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0

_STATE = "doc_id long, row_hash long, source string, src int, size long, source_size long, target double, whole int, u long, bucket long, p double, level int"


def text_size(column: str = "text"):
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, src (its rank by code point, null last), source_size and target, from rows (source, size).

    Targets are weight shares of share times all words, at most `most` times the source's own; what exceeds that
    is shared again by weight until none is above. That ends at min(most * size, level * weight) for one level,
    which falls out of running sums over the sources ordered by most * size / weight. One row a source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    rank = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    filling = Window.orderBy("fills_at", "src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(rank) - 1)
        .withColumn("w", weight)
        .withColumn("fills_at", F.lit(most) * F.col("source_size") / F.col("w"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("level_here", (F.col("budget") - F.col("full_before")) / (F.col("w_all") - F.col("w_before")))
        # the first source, in filling order, that the level reached there doesn't fill fixes the level
        .withColumn("level", F.min(F.when(F.col("level_here") < F.col("fills_at"), F.struct("fills_at", "src", "level_here"))).over(everything)["level_here"])
        .withColumn("target", F.least(F.lit(most) * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), F.lit(most) * F.col("source_size"))))
        .select("source", "src", "source_size", "target")
    )


def _meet(p: float, a: float, q: float, b: float, r: float) -> tuple[float, float]:
    """Move mass between p (size a) and q (size b), keeping a*p + b*q, until one is 0 or 1; keeps both means."""
    if a == 0 and b == 0:  # sizes don't bind: plain pivotal step
        a = b = 1.0
    if a == 0:
        return (1.0 if r < p else 0.0), q
    if b == 0:
        return p, (1.0 if r < q else 0.0)
    up = min(1.0 - p, q * b / a)  # p rises by up, q falls by up * a / b
    down = min(p, (1.0 - q) * b / a)
    if r < down / (up + down):
        x, y = p + up, q - up * a / b
        return (1.0, y) if up == 1.0 - p else (x, 0.0)
    x, y = p - down, q + down * a / b
    return (0.0, y) if down == p else (x, 1.0)


def _draw(seed: int, *keys) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, *[int(k) & (2**64 - 1) for k in keys]])))


def _level(seed: int, fan_in: int, last: bool):
    """Rounds sorted rows group by group; yields all rows, decided ones with p 0 or 1, residuals with the next bucket."""

    def run(batches):
        key, held, rng = None, None, None  # held: the fractional row that waits, as (row, p, size)
        tail: dict | None = None

        def emit(cols, p, level):
            cols = dict(cols)
            cols["p"] = pa.array(p, pa.float64())
            cols["level"] = pa.array(level, pa.int32())
            return pa.RecordBatch.from_pydict(cols)

        def waiting():
            row = {k: pa.array([v], t) for (k, v), t in zip(tail.items(), types, strict=True)}
            p = held[0]
            if last:
                return emit(row, [1.0 if rng.random() < p else 0.0], row["level"])
            row["bucket"] = pa.array([tail["bucket"] // fan_in], pa.int64())
            return emit(row, [p], [tail["level"] + 1])

        types = None
        for batch in batches:
            types = [f.type for f in batch.schema]
            names = batch.schema.names
            bucket, src = batch["bucket"].to_numpy(), batch["src"].to_numpy()
            size, p = batch["size"].to_numpy().astype(float), batch["p"].to_numpy().copy()
            keep = np.ones(len(p), bool)
            holder = -1  # index of the waiting row, if in this batch
            for i in range(len(p)):
                if key != (bucket[i], src[i]):
                    if held is not None:
                        if holder >= 0:
                            keep[holder] = False
                            tail = dict(zip(names, (batch.column(j)[holder].as_py() for j in range(len(names))), strict=True))
                        yield waiting()
                        held, holder, tail = None, -1, None
                    key = (bucket[i], src[i])
                    rng = _draw(seed, bucket[i], src[i], batch["level"][i].as_py())
                if not 0.0 < p[i] < 1.0:
                    continue
                if held is None:
                    held, holder = (p[i], size[i]), i
                    continue
                x, y = _meet(held[0], held[1], p[i], size[i], rng.random())
                if 0.0 < x < 1.0:  # the waiting one waits on
                    p[i] = y
                    held = (x, held[1])
                    continue
                if holder >= 0:
                    p[holder] = x
                else:
                    done = {k: pa.array([v], t) for (k, v), t in zip(tail.items(), types, strict=True)}
                    yield emit(done, [x], done["level"])
                    tail = None
                p[i] = y
                held, holder = ((y, size[i]), i) if 0.0 < y < 1.0 else (None, -1)
            if holder >= 0:
                keep[holder] = False
                tail = dict(zip(names, (batch.column(j)[holder].as_py() for j in range(len(names))), strict=True))
            if keep.any():
                out = {n: batch.column(j) for j, n in enumerate(names)}
                yield emit(out, p, batch["level"]).filter(pa.array(keep))
        if held is not None:
            yield waiting()

    return run


def mix_sources(docs: DataFrame, seed: int = 20240607, weights=WEIGHTS, share: float = SHARE, most: float = MOST, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, copies and taken (copies * size) of each row of docs(doc_id, text, source, ...)."""
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row_hash"), F.col("source").cast("string").alias("source"), text_size().alias("size")), "mix-sizes")
    n = sized.count()
    targets = materialize(source_targets(sized, weights, share, most), "mix-targets")
    buckets = max(1, -(-n // group))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        sized.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, sized.source.eqNullSafe(targets.source))
        .drop(targets.source)
        .withColumn("whole", F.floor(ratio).cast("int"))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("u", F.xxhash64("doc_id", "row_hash", "size", F.lit(seed)))
        .withColumn("bucket", F.pmod(F.col("u"), F.lit(buckets)))
        .withColumn("level", F.lit(0))
        .select("doc_id", "row_hash", "source", "src", "size", "source_size", "target", "whole", "u", "bucket", "p", "level")
    )
    decided, fraction, height = [], state, 0
    while True:
        last = buckets == 1
        around = fraction.repartition("bucket").sortWithinPartitions("bucket", "src", "u", "doc_id", "row_hash", "size")
        rounded = materialize(around.mapInArrow(_level(seed, fan_in, last), _STATE), f"mix-level{height}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("level") > height)
        decided.append(rounded.where(~open_))
        if last:
            break
        fraction = rounded.where(open_)
        buckets, height = -(-buckets // fan_in), height + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("p").cast("int")
    return out.select("doc_id", "row_hash", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def row_hash(docs: DataFrame):
    """64 bits of all columns that have a hash (maps have none)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as many times as its copies say, in docs' columns.

    Copies are found without the texts, which are moved once, to meet them. Rows equal in all columns share theirs: one of
    them is repeated as often as all are taken.
    """
    copies = materialize(mixed.groupBy(F.col("doc_id").alias("k"), F.col("row_hash").alias("h")).agg(F.sum("copies").alias("m"), F.count(F.lit(1)).alias("n")), "mix-copies")
    # the row is one column, so that its names can't clash with those here
    rows = docs.select(F.col("doc_id").cast("long").alias("k"), row_hash(docs).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = lambda a, b: a.k.eqNullSafe(b.k) & (a.h == b.h)

    def taken(rows, copies):
        return rows.join(copies, same(rows, copies)).select("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i")).select("row.*")

    found = taken(rows, copies.where("n = 1 and m > 0"))
    several = copies.where("n > 1 and m > 0")
    if several.limit(1).count():
        once = rows.join(several, same(rows, several), "left_semi").groupBy("k", "h").agg(F.first("row").alias("row"))
        found = found.unionByName(taken(once, several))
    return found
