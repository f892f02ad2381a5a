"""Segments: how log rows fall into files, where they lie, and what is dead in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_FILE_SIZE
from .ordered import carried, running_sum
from .views import sized


def file_name(n):
    """Ten digits, so that names sort as numbers do."""
    return F.lpad(n.cast("string"), 10, "0")


def with_offsets(rows: DataFrame) -> DataFrame:
    """offset of each record in its file: the running size less its own. A file may be larger than a task."""
    return running_sum(rows, ["file_id"], "seq", "record_size", "offset").withColumn("offset", F.col("offset") - F.col("record_size"))


def rotate(log: DataFrame, max_file_size: int = MAX_FILE_SIZE, first: int = 1) -> DataFrame:
    """The log with record_size, file_id and offset: a file is left when the next record doesn't fit.

    Greedy with a reset at each file, so every place depends on all before it: the sizes alone (two longs a record)
    stream in order through one task of constant memory, and come back to the rows by seq. A record above the
    limit gets a file of its own.
    """
    rows = sized(log)

    def fold(batches):
        at, file_id = 0, first
        for batch in batches:
            places, ids = [], []
            for n in batch["record_size"].to_pylist():
                if at + n > max_file_size:
                    at, file_id = 0, file_id + 1
                places.append(at)
                ids.append(file_id)
                at += n
            yield pa.RecordBatch.from_arrays([batch["seq"], pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["seq", "n", "offset"])

    ordered = rows.select("seq", "record_size").repartitionByRange(1, "seq").sortWithinPartitions("seq")
    places = ordered.mapInArrow(fold, "seq long, n long, offset long")
    return rows.join(places, "seq").withColumn("file_id", file_name(F.col("n"))).drop("n")


def dead_rows(segments: DataFrame) -> DataFrame:
    """Records that count as dead when written over: live ones whose key's next operation is a put or a deletion.

    A batch doesn't count what it overwrites, and deletions themselves never count; superseded has the full truth.
    """
    after = F.col("next_op")
    rows = carried(segments, ["key"], "seq", "op", "next_op", ahead=True)
    return rows.withColumn("counted", (F.col("op") != "delete") & F.coalesce(after.isin("put", "delete"), F.lit(False))).withColumn("superseded", after.isNotNull() | (F.col("op") == "delete"))


def dead_bytes(segments: DataFrame) -> DataFrame:
    """Per file: bytes counted dead, bytes superseded in truth, all bytes and records."""
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("record_size"))), F.lit(0))
    return dead_rows(segments.select("file_id", "seq", "key", "op", "record_size")).groupBy("file_id").agg(of("counted").alias("dead_bytes"), of("superseded").alias("superseded_bytes"), F.sum("record_size").alias("file_bytes"), F.count(F.lit(1)).alias("records"))


def files(segments: DataFrame) -> DataFrame:
    return segments.groupBy("file_id").agg(F.sum("record_size").alias("file_bytes"), F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def index_rows(segments: DataFrame) -> DataFrame:
    """Index entries: the log without values."""
    return segments.where("op <> 'delete'").select("file_id", "key", "ts", F.octet_length("value").alias("value_size"), "offset")
