"""All registered queries of the keyed log, each with equivalent SQL where SQL can express it.

Values are shown as text (``value`` decoded), as the tables' values are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.frames import Entries, Frames
from ..operators import compaction, reads, replication, segments, views, writes
from ..operators import requests as requests_
from ..sources import raw
from ..sources.scratch import scratch_folder
from ..store import Store
from ..streaming import index as streaming
from . import logs
from .logs import SQL_MIXED, SQL_PLAIN, SQL_REQUESTS, SQL_SEGMENTS, SQL_SIZED, SQL_SKEWED

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


_LIVE = "live AS (SELECT key, value, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op <> 'delete')"


# ---------------------------------------------------------------- the log and its views


@_query(f"WITH {SQL_PLAIN} SELECT seq, key, value, ts, op FROM log")
def log_rows(spark, sf_dir):
    return _text(logs.plain_log(spark, sf_dir))


@_query(f"WITH {SQL_PLAIN}, {SQL_SIZED} SELECT op, count(*) AS n, CAST(sum(record_size) AS BIGINT) AS bytes FROM sized GROUP BY op")
def record_size(spark, sf_dir):
    return views.sized(logs.plain_log(spark, sf_dir)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("record_size").alias("bytes"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live")
def live_online(spark, sf_dir):
    return _text(views.live_online(logs.plain_log(spark, sf_dir)))


@_query(
    f"""WITH {SQL_SKEWED}, dead AS (SELECT key, max(seq) AS gone FROM log WHERE op = 'delete' GROUP BY key)
    SELECT key, value, ts, seq FROM (
      SELECT log.*, row_number() OVER (PARTITION BY log.key ORDER BY ts DESC, seq DESC) AS rn
      FROM log LEFT JOIN dead USING (key) WHERE op <> 'delete' AND seq > coalesce(gone, -1)) WHERE rn = 1"""
)
def live_replay(spark, sf_dir):
    return _text(views.live_replay(logs.plain_log(spark, sf_dir, skew=True)))


@_query(
    f"""WITH {SQL_SEGMENTS.replace("epoch_us(ts) // 1000 AS ts", "epoch_us(ts) // 1000 - (event_id % 7) * 3600000 AS ts")}
    SELECT key, ts, value_size, "offset", file_id, CAST(20 + octet_length(encode(key)) + value_size AS BIGINT) AS record_size FROM (
      SELECT *, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, row_number() OVER (PARTITION BY key ORDER BY ts DESC, file_id DESC, "offset" DESC) AS rn
      FROM segments WHERE op <> 'delete') WHERE rn = 1"""
)
def live_hints(spark, sf_dir):
    late = (F.col("seq") % 7) * 3_600_000
    return views.live_hints(segments.index_rows(logs.segmented(spark, sf_dir).withColumn("ts", F.col("ts") - late)))


@_query(f"WITH {SQL_PLAIN.replace('FROM events', 'FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events)')}, {_LIVE} SELECT * FROM live")
def live_as_of(spark, sf_dir):
    log = logs.plain_log(spark, sf_dir)
    half = logs.events(spark, sf_dir).agg(F.floor(F.max("event_id") / 2)).first()[0]  # one row
    return _text(views.live_as_of(log, half if half is not None else -1))


# ---------------------------------------------------------------- reads


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live WHERE key = 'user:00007'")
def get_point(spark, sf_dir):
    return _text(reads.get(views.live_online(logs.plain_log(spark, sf_dir)), "user:00007"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live WHERE key = 'nobody'")
def get_missing(spark, sf_dir):
    return _text(reads.get(views.live_online(logs.plain_log(spark, sf_dir)), "nobody"))


_KEYS = "asked AS (SELECT DISTINCT 'user:' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS key FROM customer)"


def _asked(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).alias("key")).distinct()


@_query(f"WITH {SQL_PLAIN}, {_LIVE}, {_KEYS} SELECT key, value, ts, seq FROM asked LEFT JOIN live USING (key)")
def multi_get(spark, sf_dir):
    return _text(reads.multi_get(views.live_online(logs.plain_log(spark, sf_dir)), _asked(spark, sf_dir)))


@_query(f"WITH {SQL_PLAIN}, {_LIVE}, {_KEYS} SELECT key FROM asked WHERE key IN (SELECT key FROM live)")
def exists(spark, sf_dir):
    return reads.exists(views.live_online(logs.plain_log(spark, sf_dir)), _asked(spark, sf_dir))


@_query(f"WITH {SQL_PLAIN}, {_LIVE}, {_KEYS} SELECT key FROM asked WHERE key NOT IN (SELECT key FROM live)")
def missing_keys(spark, sf_dir):
    return reads.missing(views.live_online(logs.plain_log(spark, sf_dir)), _asked(spark, sf_dir))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT count(*) AS n FROM live")
def live_size(spark, sf_dir):
    return reads.size(views.live_online(logs.plain_log(spark, sf_dir)))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT key FROM live")
def live_keys(spark, sf_dir):
    return reads.keys(views.live_online(logs.plain_log(spark, sf_dir)))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live WHERE key BETWEEN 'user:00010' AND 'user:00090' ORDER BY key")
def range_scan(spark, sf_dir):
    return _text(reads.range_scan(views.live_online(logs.plain_log(spark, sf_dir)), "user:00010", "user:00090"))


@_query(f"WITH {SQL_PLAIN.replace('FROM events', 'FROM events WHERE user_id <> 50')} , {_LIVE} SELECT * FROM live WHERE key BETWEEN 'user:00040' AND 'user:00060' ORDER BY key")
def range_after_delete(spark, sf_dir):
    """As if user 50 had been deleted at the end."""
    log = logs.plain_log(spark, sf_dir)
    gone = log.agg(F.max("seq").alias("m")).select((F.coalesce("m", F.lit(0)) + 1).alias("seq"), F.lit("user:00050").alias("key"), F.lit(None).cast("binary").alias("value"), F.lit(0).cast("long").alias("ts"), F.lit("delete").alias("op"))
    return _text(reads.range_scan(views.live_online(log.unionByName(gone)), "user:00040", "user:00060"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live WHERE key BETWEEN 'x' AND 'y'")
def range_empty(spark, sf_dir):
    return _text(reads.range_scan(views.live_online(logs.plain_log(spark, sf_dir)), "x", "y"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live WHERE key BETWEEN 'user:00007' AND 'user:00007'")
def range_single_key(spark, sf_dir):
    return _text(reads.range_scan(views.live_online(logs.plain_log(spark, sf_dir)), "user:00007", "user:00007"))


# ---------------------------------------------------------------- writes and segments


@_query(
    """SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, max_by(o_orderpriority, (o_orderkey, o_orderpriority)) AS value, count(*) AS writes FROM orders GROUP BY o_custkey"""
)
def batch_put_dups(spark, sf_dir):
    log = writes.batch_rows(logs.batches(spark, sf_dir))
    n = log.groupBy("key").agg(F.count(F.lit(1)).alias("writes"))
    return _text(views.live_online(log).select("key", "value")).join(n, "key")


@_query(f'WITH {SQL_SEGMENTS} SELECT file_id, seq, record_size, "offset" FROM segments')
def segment_offsets(spark, sf_dir):
    return logs.segmented(spark, sf_dir).select("file_id", "seq", "record_size", "offset")


@_query(
    f"""WITH {SQL_SEGMENTS} SELECT key, file_id, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, "offset", record_size, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM segments) WHERE rn = 1 AND op <> 'delete'"""
)
def keydir(spark, sf_dir):
    return views.keydir(logs.segmented(spark, sf_dir))


@_query(
    f"""WITH RECURSIVE {SQL_PLAIN}, {SQL_SIZED}, ends AS (SELECT seq, record_size, sum(record_size) OVER (ORDER BY seq) AS stop FROM sized),
    starts(n, seq, base) AS (
      SELECT 1, min(seq), CAST(0 AS HUGEINT) FROM ends
      UNION ALL
      SELECT n + 1, x.seq, x.base FROM starts s, LATERAL (
        SELECT e.seq, e.stop - e.record_size AS base FROM ends e WHERE e.seq > s.seq AND e.stop - s.base > 65536 ORDER BY e.seq LIMIT 1) x)
    SELECT lpad(CAST(n AS VARCHAR), 10, '0') AS file_id, count(*) AS records, CAST(sum(record_size) AS BIGINT) AS file_bytes, min(e.seq) AS first_seq, max(e.seq) AS last_seq
    FROM (SELECT *, coalesce(lead(seq) OVER (ORDER BY n), 9223372036854775807) AS next FROM starts) s JOIN ends e ON e.seq >= s.seq AND e.seq < s.next GROUP BY n"""
)
def file_rotation(spark, sf_dir):
    return segments.files(segments.rotate(logs.plain_log(spark, sf_dir), 65536))


@_query(f"""WITH {SQL_SEGMENTS} SELECT file_id, count(*) AS records FROM (
    SELECT *, bool_and(seq % 3001 <> 1500) OVER (PARTITION BY file_id ORDER BY "offset") AS good FROM segments) WHERE good GROUP BY file_id""")
def valid_prefix(spark, sf_dir):
    """Every 3001st record is damaged: what follows it in its file is lost, other files aren't."""
    bad = logs.segmented(spark, sf_dir).withColumn("ok", F.col("seq") % 3001 != 1500)
    return views.valid_prefix(bad).groupBy("file_id").agg(F.count(F.lit(1)).alias("records"))


_DEAD = f"""{SQL_SEGMENTS}, nexts AS (SELECT *, lead(op) OVER (PARTITION BY key ORDER BY seq) AS next_op FROM segments),
  dead AS (SELECT file_id, CAST(coalesce(sum(record_size) FILTER (WHERE op <> 'delete' AND next_op IN ('put', 'delete')), 0) AS BIGINT) AS dead_bytes,
    CAST(coalesce(sum(record_size) FILTER (WHERE next_op IS NOT NULL OR op = 'delete'), 0) AS BIGINT) AS superseded_bytes,
    CAST(sum(record_size) AS BIGINT) AS file_bytes, count(*) AS records FROM nexts GROUP BY file_id)"""


@_query(f"WITH {_DEAD} SELECT * FROM dead")
def dead_bytes(spark, sf_dir):
    return segments.dead_bytes(logs.segmented(spark, sf_dir))


@_query(
    f"""WITH {_DEAD} SELECT dead_bytes, closed_bytes, round(dead_bytes / closed_bytes, 9) AS ratio, dead_bytes / closed_bytes >= 0.5 AS should_compact FROM (
    SELECT CAST(sum(dead_bytes) AS BIGINT) AS dead_bytes, CAST(sum(file_bytes) AS BIGINT) AS closed_bytes FROM dead WHERE file_id <> '0000000010')"""
)
def should_compact(spark, sf_dir):
    return compaction.should_compact(logs.segmented(spark, sf_dir), "0000000010").withColumn("ratio", F.round("ratio", 9))


@_query(f"WITH {SQL_MIXED}, {_LIVE} SELECT * FROM live")
def compaction_live(spark, sf_dir):
    """The live view after compaction is that before it."""
    return _text(views.live_online(compaction.compact(logs.segmented(spark, sf_dir), "0000000010", 11)))


@_query(
    f"""WITH {SQL_SEGMENTS}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM segments)
    SELECT gross_bytes, files, live_bytes, live_records, gross_bytes - live_bytes AS net_bytes FROM
    (SELECT CAST(coalesce(sum(record_size), 0) AS BIGINT) AS gross_bytes, count(DISTINCT file_id) AS files FROM segments WHERE file_id <> '0000000010'),
    (SELECT CAST(coalesce(sum(record_size), 0) AS BIGINT) AS live_bytes, count(*) AS live_records FROM last WHERE rn = 1 AND op <> 'delete' AND file_id <> '0000000010')"""
)
def compaction_stats(spark, sf_dir):
    return compaction.stats(logs.segmented(spark, sf_dir), "0000000010")


def _twice_compacted(spark, sf_dir):
    """Compacted once when file 5 was active, and again when file 10 is; as the SQL has it, no deletion of a closed file stays."""
    log, first = logs.segmented(spark, sf_dir), "0000000005"
    folder = scratch_folder(spark, "compacted")
    once = compaction.compact(log.where(F.col("file_id") <= first), first, 0, deletions=False)
    once.write.parquet(folder)  # a compaction's files are written before the next one reads them
    once = spark.read.schema(once.schema).parquet(folder)
    return compaction.compact(once.unionByName(log.where(F.col("file_id") > first)), "0000000010", 11, deletions=False)


_MERGED = f"""{SQL_SEGMENTS}, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM segments),
  merged AS (SELECT '0000000011' AS file_id, seq, key, value, ts, op, record_size, CAST(sum(record_size) OVER (ORDER BY seq) - record_size AS BIGINT) AS "offset"
    FROM last WHERE rn = 1 AND op <> 'delete' AND file_id <> '0000000010'),
  compacted AS (SELECT * FROM merged UNION ALL SELECT file_id, seq, key, value, ts, op, record_size, "offset" FROM segments WHERE file_id = '0000000010')"""


@_query(f'WITH {_MERGED} SELECT file_id, seq, key, op, record_size, "offset" FROM compacted')
def second_compaction(spark, sf_dir):
    """A second compaction over the first one's file gives what one alone would."""
    return _twice_compacted(spark, sf_dir).select("file_id", "seq", "key", "op", "record_size", "offset")


@_query(
    f"""WITH {_MERGED} SELECT key, file_id, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, "offset", record_size, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM compacted) WHERE n = 1 AND op <> 'delete'"""
)
def compacted_keydir(spark, sf_dir):
    return views.keydir(_twice_compacted(spark, sf_dir))


# ---------------------------------------------------------------- raw files, recovery, the store


def _late_segments(spark, sf_dir):
    return logs.segmented(spark, sf_dir).withColumn("ts", F.col("ts") - (F.col("seq") % 7) * 3_600_000)


_LATE = SQL_SEGMENTS.replace("epoch_us(ts) // 1000 AS ts", "epoch_us(ts) // 1000 - (event_id % 7) * 3600000 AS ts")
_REPLAYED = f"""{_LATE}, gone AS (SELECT key, max(seq) AS seq FROM segments WHERE op = 'delete' GROUP BY key),
  replayed AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.key ORDER BY ts DESC, s.seq DESC) AS rn
    FROM segments s LEFT JOIN gone g ON g.key = s.key WHERE op <> 'delete' AND s.seq > coalesce(g.seq, -1)) WHERE rn = 1)"""


@_query(
    f"""WITH {SQL_SEGMENTS} SELECT file_id, "offset", CAST(record_size AS INTEGER) AS record_size, key, coalesce(value, '') AS value, ts, op = 'delete' AS tombstone FROM segments"""
)
def raw_round_trip(spark, sf_dir):
    """Segments as raw files, walked again from their starts."""
    folder = scratch_folder(spark, "raw")
    raw.write_log(logs.segmented(spark, sf_dir), folder)
    return _text(raw.read_log(spark, folder, strict="true").drop("corrupt_reason"))


@_query(
    f"""WITH {SQL_SEGMENTS} SELECT file_id, key, ts, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, "offset" FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM segments) WHERE rn = 1 AND op <> 'delete'"""
)
def raw_hints(spark, sf_dir):
    """Index files of the live keys, read again."""
    folder = scratch_folder(spark, "hints")
    raw.write_hints(views.keydir(logs.segmented(spark, sf_dir)), folder)
    return raw.read_hints(spark, folder)


@_query(f"""WITH {_REPLAYED} SELECT key, ts, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, "offset", file_id, record_size FROM replayed""")
def recover_from_log(spark, sf_dir):
    """The index after a crash, without index files: a replay, with clocks that run back by turns."""
    folder = scratch_folder(spark, "raw")
    raw.write_log(_late_segments(spark, sf_dir), folder)
    return raw.recover(spark, folder)[0]


@_query(
    f"""WITH {_LATE} SELECT key, ts, value_size, "offset", file_id, CAST(20 + octet_length(encode(key)) + value_size AS BIGINT) AS record_size FROM (
      SELECT *, CAST(octet_length(encode(value)) AS INTEGER) AS value_size, row_number() OVER (PARTITION BY key ORDER BY ts DESC, file_id DESC, "offset" DESC) AS rn
      FROM segments WHERE op <> 'delete') WHERE rn = 1"""
)
def recover_from_hints(spark, sf_dir):
    """The index after a crash, where every data file has an index file: those alone decide."""
    folder, log = scratch_folder(spark, "raw"), _late_segments(spark, sf_dir)
    raw.write_log(log, folder)
    raw.write_hints(segments.index_rows(log), folder)
    return raw.recover(spark, folder)[0]


@_query(f"WITH {_REPLAYED} SELECT key, value, ts FROM replayed")
def recovered_store(spark, sf_dir):
    """A store opened on what the raw files give after a crash."""
    folder = scratch_folder(spark, "raw")
    raw.write_log(_late_segments(spark, sf_dir), folder)
    return _text(Store.recovered(spark, scratch_folder(spark, "store"), folder).live().select("key", "value", "ts"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE}, {_KEYS} SELECT key, value, ts FROM live WHERE key IN (SELECT key FROM asked)")
def positional_read(spark, sf_dir):
    """Values of many keys, each read at its file and offset."""
    folder, log = scratch_folder(spark, "raw"), logs.segmented(spark, sf_dir)
    raw.write_log(log, folder)
    places = views.keydir(log).join(_asked(spark, sf_dir), "key", "left_semi").select("file_id", "offset", "record_size")
    return _text(raw.read_at(places, folder).select(codec.decode_record(F.col("bytes")).alias("r")).select("r.key", "r.value", "r.ts"))


@_query(f"WITH {SQL_PLAIN}, {_LIVE} SELECT * FROM live")
def store_compacted(spark, sf_dir):
    """A store filled in two appends, compacted between and after them, and opened again."""
    path, log = scratch_folder(spark, "store"), logs.plain_log(spark, sf_dir)
    store = Store(spark, path)
    half = logs.events(spark, sf_dir).agg(F.floor(F.max("event_id") / 2)).first()[0] or 0  # one row
    store.append(log.where(F.col("seq") <= half))
    store.compact()
    store.append(log.where(F.col("seq") > half).withColumn("seq", F.col("seq") - half - 1))
    store.compact()
    return _text(Store(spark, path).live())


@_query(
    f"""WITH {SQL_SKEWED}, dead AS (SELECT key, max(seq) AS gone FROM log WHERE op = 'delete' GROUP BY key)
    SELECT key, value, ts, seq FROM (
      SELECT log.*, row_number() OVER (PARTITION BY log.key ORDER BY ts DESC, seq DESC) AS rn
      FROM log LEFT JOIN dead USING (key) WHERE op <> 'delete' AND seq > coalesce(gone, -1)) WHERE rn = 1"""
)
def stream_replay(spark, sf_dir):
    """The replay view kept by a stream over segments that arrive in any order."""
    folder = scratch_folder(spark, "stream")
    log = logs.plain_log(spark, sf_dir, skew=True)
    log.repartition(4, F.col("seq") % 16).write.parquet(f"{folder}/in")
    sink = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/out/n={n}")
    views_ = streaming.streaming_replay(streaming.read_segments(spark, f"{folder}/in", max_files=2))
    views_.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("key string, value binary, ts long, seq long, batch long").parquet(f"{folder}/out")
    last = out.groupBy("key").agg(F.max_by(F.struct("value", "ts", "seq"), "batch").alias("r")).where("r.seq is not null")
    return _text(last.select("key", "r.value", "r.ts", "r.seq"))


# ---------------------------------------------------------------- requests


_ANSWERED = f"""{SQL_REQUESTS}, w AS (SELECT * FROM requests WHERE op IN ('put', 'delete')),
    answered AS (SELECT r.seq, w.op = 'put' AS hit, w.value FROM (SELECT * FROM requests WHERE op = 'get') r ASOF LEFT JOIN w ON r.key = w.key AND r.seq > w.seq)"""


@_query(f"WITH {_ANSWERED} SELECT seq, CASE WHEN coalesce(hit, false) THEN 0 ELSE 1 END AS status, CASE WHEN coalesce(hit, false) THEN value ELSE '' END AS payload FROM answered")
def get_responses(spark, sf_dir):
    """Answers to gets as response frames, taken apart again."""
    rows = requests_.answer_gets(logs.requests(spark, sf_dir))
    frame = F.when(F.col("status") == "ok", codec.response("ok", F.col("value"))).otherwise(codec.response("not_found", F.lit(b"")))
    back = rows.select("seq", codec.decode_response(frame).alias("r"))
    return back.select("seq", "r.status", F.col("r.payload").cast("string").alias("payload"))


@_query(
    f"""WITH {SQL_REQUESTS}, met AS (
      SELECT r.seq, w.key, max_by(w.op, w.seq) AS op, max_by(w.value, w.seq) AS value
      FROM requests r JOIN requests w ON r.op = 'range' AND w.op IN ('put', 'delete') AND w.key >= r.key AND w.key <= r.end_key AND w.seq < r.seq GROUP BY r.seq, w.key)
    SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY key) - 1 AS INTEGER) AS n, key, value FROM met WHERE op = 'put'"""
)
def range_responses(spark, sf_dir):
    """Answers to ranges as one response frame each, its entries taken apart again."""
    rows = requests_.answer_ranges(logs.requests(spark, sf_dir), width=8)
    frames = rows.groupBy("seq").agg(F.collect_list(F.struct("key", "value")).alias("pairs")).select("seq", codec.decode_response(codec.range_response(F.col("pairs")))["payload"].alias("payload"))
    return _text(frames.lateralJoin(Entries(F.col("payload").outer())).select("seq", "n", "key", "value"))


@_query("""SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, max_by(o_orderpriority, (o_orderkey, o_orderpriority)) AS value FROM orders GROUP BY o_custkey""")
def batch_frames(spark, sf_dir):
    """Batches as request frames, taken apart, checked and applied entry by entry."""
    pairs = F.arrays_zip(F.col("keys").alias("key"), F.col("values").alias("value"))
    frames = logs.batches(spark, sf_dir).select("batch", codec.decode_response(codec.batch_request(pairs))["payload"].alias("payload"))
    parsed = frames.lateralJoin(Entries(F.col("payload").outer())).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("n", "key", "value"))).alias("e"))
    entries = requests_.batch_entries(parsed.select(F.col("batch").alias("seq"), F.col("e.key").alias("keys"), F.col("e.value").alias("values"))).where("status = 'ok'")
    log = entries.select((F.shiftleft(F.col("seq").cast("long"), 32) + F.col("n")).alias("seq"), "key", "value", F.lit(0).cast("long").alias("ts"), F.lit("batch").alias("op"))
    return _text(views.live_online(log).select("key", "value"))


@_query(f"WITH {SQL_REQUESTS} SELECT seq, CASE WHEN seq % 3 = 0 THEN 'error' ELSE 'ok' END AS status FROM requests WHERE op = 'range'")
def reversed_ranges(spark, sf_dir):
    """Every third request's bounds are the wrong way round: an error, not an empty answer."""
    turn = (F.col("op") == "range") & (F.col("seq") % 3 == 0)
    rows = logs.requests(spark, sf_dir).withColumns({"key": F.when(turn, F.col("end_key")).otherwise(F.col("key")), "end_key": F.when(turn, F.col("key")).otherwise(F.col("end_key"))})
    return requests_.answer_status(rows).where("op = 'range'").select("seq", "status")


@_query(
    f"""WITH {SQL_REQUESTS}, w AS (SELECT * FROM requests WHERE op IN ('put', 'delete'))
    SELECT r.seq, r.key, CASE WHEN w.op = 'put' THEN 'ok' ELSE 'not_found' END AS status, CASE WHEN w.op = 'put' THEN w.value END AS value
    FROM (SELECT * FROM requests WHERE op = 'get') r ASOF LEFT JOIN w ON r.key = w.key AND r.seq > w.seq"""
)
def request_gets(spark, sf_dir):
    return _text(requests_.answer_gets(logs.requests(spark, sf_dir)))


@_query(
    f"""WITH {SQL_REQUESTS}, met AS (
      SELECT r.seq, w.key, max_by(w.op, w.seq) AS op, max_by(w.value, w.seq) AS value
      FROM requests r JOIN requests w ON r.op = 'range' AND w.op IN ('put', 'delete') AND w.key >= r.key AND w.key <= r.end_key AND w.seq < r.seq GROUP BY r.seq, w.key)
    SELECT seq, key, value FROM met WHERE op = 'put'"""
)
def request_ranges(spark, sf_dir):
    return _text(requests_.answer_ranges(logs.requests(spark, sf_dir), width=8))


@_query(
    f"""WITH {SQL_REQUESTS}, w AS (SELECT * FROM requests WHERE op IN ('put', 'delete')),
    gets AS (SELECT r.seq, w.op FROM (SELECT * FROM requests WHERE op = 'get') r ASOF LEFT JOIN w ON r.key = w.key AND r.seq > w.seq)
    SELECT op, status, count(*) AS n FROM (
      SELECT op, CASE WHEN op = 'range' AND key > end_key THEN 'error' ELSE 'ok' END AS status FROM requests WHERE op <> 'get'
      UNION ALL SELECT 'get', CASE WHEN op = 'put' THEN 'ok' ELSE 'not_found' END FROM gets) GROUP BY op, status"""
)
def request_status(spark, sf_dir):
    return requests_.answer_status(logs.requests(spark, sf_dir)).groupBy("op", "status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- replication

#: Entries (term, idx, op, key, value): terms rise every 40 suppliers, ten per node's region of keys.
_ENTRIES = """entries AS (SELECT CAST(s_suppkey // 4 + 1 AS BIGINT) AS term, CAST(s_suppkey AS BIGINT) AS idx, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS op,
  's' || CAST(s_suppkey % 7 AS VARCHAR) AS key, s_name AS value FROM supplier)"""


def _entries(spark, sf_dir):
    s, n = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    return s.select((F.floor(n / 4) + 1).cast("long").alias("term"), n.cast("long").alias("idx"), F.when(n % 5 == 0, 2).otherwise(1).alias("op"), F.concat(F.lit("s"), (n % 7).cast("string")).alias("key"), F.encode("s_name", "UTF-8").alias("value"))


@_query(f"WITH {_ENTRIES} SELECT coalesce(max(idx), 0) AS last_idx, coalesce(max_by(term, idx), 0) AS last_term, count(*) AS size FROM entries")
def log_end(spark, sf_dir):
    return replication.log_end(_entries(spark, sf_dir))


@_query(
    f"""WITH {_ENTRIES} SELECT idx, term, key, value FROM entries WHERE idx < 6
    UNION ALL SELECT idx, term + 100, key, value FROM entries WHERE idx BETWEEN 6 AND 8"""
)
def truncate_append(spark, sf_dir):
    old = _entries(spark, sf_dir)
    new = old.where("idx between 6 and 8").withColumn("term", F.col("term") + 100)
    return _text(replication.truncate_append(old, 6, new)).select("idx", "term", "key", "value")


@_query(f"""WITH {_ENTRIES}, log AS (SELECT idx AS seq, key, value, CASE op WHEN 1 THEN 'put' ELSE 'delete' END AS op FROM entries WHERE idx <= 9)
    SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND op = 'put'""")
def apply_committed(spark, sf_dir):
    return _text(views.live_online(replication.apply_committed(_entries(spark, sf_dir), 9))).select("key", "value", "seq")


#: Leaders are nations: four peers each, whose match indexes are spread around the leader's own log of 10 entries.
@_query(
    """WITH leaders AS (SELECT n_nationkey AS node, CAST(n_nationkey % 4 + 2 AS BIGINT) AS term, CAST(n_nationkey % 6 AS BIGINT) AS commit_idx FROM nation),
    peers AS (SELECT node, p, CAST((node * 3 + p * 4) % 11 AS BIGINT) AS match_idx FROM leaders, range(1, 5) t(p)),
    entries AS (SELECT node, CAST(i AS BIGINT) AS idx, least(term, CAST((i + 1) // 2 AS BIGINT)) AS term FROM leaders, range(1, 11) t(i)),
    held AS (SELECT l.node, e.idx FROM leaders l JOIN entries e USING (node) WHERE e.term = l.term AND e.idx > l.commit_idx
      AND 1 + (SELECT count(*) FROM peers p WHERE p.node = l.node AND p.match_idx >= e.idx) >= 3)
    SELECT node, coalesce(max(idx), any_value(commit_idx)) AS commit_idx FROM leaders LEFT JOIN held USING (node) GROUP BY node"""
)
def commit_index(spark, sf_dir):
    n = F.col("n_nationkey")
    leaders = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("node"), (n % 4 + 2).cast("long").alias("term"), (n % 6).cast("long").alias("commit_idx"))
    each = lambda k: leaders.select("node", "term", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    peers = each(4).select("node", F.col("i").alias("peer"), ((F.col("node") * 3 + F.col("i") * 4) % 11).cast("long").alias("match_idx"))
    entries = each(10).select("node", F.col("i").cast("long").alias("idx"), F.least("term", F.floor((F.col("i") + 1) / 2).cast("long")).alias("term"))
    return replication.commit_index(leaders, peers, entries)


_VOTES = """votes AS (SELECT c_custkey AS req, CAST(c_custkey % 5 AS BIGINT) AS term, CAST(c_custkey % 3 AS BIGINT) AS candidate, CAST(c_custkey % 11 AS BIGINT) AS last_idx, CAST(c_custkey % 4 AS BIGINT) AS last_term,
  CAST(c_custkey % 7 AS BIGINT) AS my_term, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 6 AS BIGINT) END AS voted_for, CAST(6 AS BIGINT) AS my_last_idx, CAST(2 AS BIGINT) AS my_last_term FROM customer)"""


@_query(
    f"""WITH {_VOTES} SELECT req, term >= my_term AND (term > my_term OR voted_for IS NULL OR voted_for = candidate)
    AND (last_term > my_last_term OR (last_term = my_last_term AND last_idx >= my_last_idx)) AS granted, greatest(term, my_term) AS new_term FROM votes"""
)
def vote_decision(spark, sf_dir):
    c = F.col("c_custkey")
    m = lambda k, name: (c % k).cast("long").alias(name)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("req"), m(5, "term"), m(3, "candidate"), m(11, "last_idx"), m(4, "last_term"), m(7, "my_term"), F.when(c % 2 == 0, (c % 6).cast("long")).alias("voted_for"),
        F.lit(6).cast("long").alias("my_last_idx"), F.lit(2).cast("long").alias("my_last_term"))
    return replication.vote_decision(rows)


@_query(
    f"""WITH {_ENTRIES}, top AS (SELECT coalesce(max(idx), 0) AS last FROM entries),
    asked AS (SELECT c_custkey AS req, c_custkey % 3 + 1 AS term, c_custkey % 12 AS prev_idx, c_custkey % 4 + c_custkey % 2 AS prev_term, c_custkey % 3 AS n_new, c_custkey % 15 AS leader_commit, 2 AS my_term, CAST(4 AS BIGINT) AS commit_idx FROM customer),
    judged AS (SELECT a.*, last, a.term >= my_term AND (prev_idx = 0 OR coalesce(e.term = prev_term, false)) AS success FROM asked a CROSS JOIN top LEFT JOIN entries e ON e.idx = prev_idx)
    SELECT req, success, CAST(CASE WHEN success AND leader_commit > commit_idx THEN least(leader_commit, CASE WHEN n_new > 0 THEN prev_idx + n_new ELSE last END) ELSE commit_idx END AS BIGINT) AS new_commit FROM judged"""
)
def append_decision(spark, sf_dir):
    c = F.col("c_custkey")
    entries = _entries(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("req"), (c % 3 + 1).alias("term"), (c % 12).alias("prev_idx"), (c % 4 + c % 2).alias("prev_term"), (c % 3).alias("n_new"), (c % 15).alias("leader_commit"),
        F.lit(2).alias("my_term"), F.lit(4).cast("long").alias("commit_idx"))
    last = replication.log_end(entries).select(F.col("last_idx").alias("my_last_idx"))  # one row
    return replication.append_decision(rows.join(F.broadcast(last)), entries)


@_query(
    """WITH nodes AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 6 = 0 THEN 'leader' ELSE 'follower' END AS role, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey - n_nationkey % 6 END AS leader FROM nation),
    ends AS (SELECT n_nationkey AS node, lower(n_name) AS host, 7777 + n_nationkey AS port FROM nation WHERE n_nationkey <> 18)
    SELECT n.node, CASE WHEN role = 'leader' THEN 'none' WHEN e.host IS NULL THEN 'error' ELSE 'redirect' END AS status, CASE WHEN role <> 'leader' AND e.host IS NOT NULL THEN e.host || ':' || CAST(e.port AS VARCHAR) END AS target
    FROM nodes n LEFT JOIN ends e ON e.node = n.leader"""
)
def redirect_route(spark, sf_dir):
    nation, n = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("n_nationkey")
    nodes = nation.select(n.alias("node"), F.when(n % 6 == 0, "leader").otherwise("follower").alias("role"), F.when(n % 6 != 5, n - n % 6).alias("leader"))
    ends = nation.where(n != 18).select(n.alias("node"), F.lower("n_name").alias("host"), (n + 7777).alias("port"))
    return replication.route(nodes, ends)


#: A follower's log departs from the leader's at two thirds of it.
@_query(f"WITH {_ENTRIES}, cut AS (SELECT max(idx) * 2 // 3 AS parted FROM entries) SELECT coalesce(max(idx), 0) AS match_idx FROM entries, cut WHERE idx < parted")
def common_prefix(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    at = entries.agg(F.floor(F.max("idx") * 2 / 3).alias("at"))  # one row
    other = entries.join(F.broadcast(at)).select("idx", (F.col("term") + (F.col("idx") >= F.col("at")).cast("long")).alias("term"))
    return replication.common_prefix(entries, other)


@_query(
    f"""WITH {_ENTRIES}, top AS (SELECT coalesce(max(idx), 0) AS last FROM entries) SELECT idx, term, key, value FROM entries
    UNION ALL SELECT last + 1 + n_nationkey, 1000, 'n' || CAST(n_nationkey AS VARCHAR), n_name FROM nation, top"""
)
def submit_write(spark, sf_dir):
    """A leader's log with writes behind it; another node takes none."""
    n = F.col("n_nationkey")
    writes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.cast("long").alias("pos"), F.lit(1).alias("op"), F.concat(F.lit("n"), n.cast("string")).alias("key"), F.encode("n_name", "UTF-8").alias("value"))
    entries = _entries(spark, sf_dir)
    kept = replication.submit(entries, writes, 1000, leads=False)
    return _text(replication.submit(kept, writes, 1000, leads=True)).select("idx", "term", "key", "value")


@_query("""SELECT n_regionkey AS cluster, CASE count(*) FILTER (WHERE n_nationkey % 9 = 0) WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS code FROM nation GROUP BY n_regionkey""")
def probe_result(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return replication.probe_result(nation.select(F.col("n_regionkey").alias("cluster"), (F.col("n_nationkey") % 9 == 0).alias("ok")))


# ---------------------------------------------------------------- codec and frames


@_query(f"WITH {SQL_PLAIN}, {SQL_SIZED} SELECT seq, CAST(record_size AS INTEGER) AS size FROM sized")
def peek_size(spark, sf_dir):
    """Sizes as the headers of encoded records tell them."""
    log = logs.plain_log(spark, sf_dir)
    record = F.when(F.col("op") == "delete", codec.encode_tombstone(F.col("key"), F.col("ts"))).otherwise(codec.encode_record(F.col("key"), F.coalesce("value", F.lit(b"")), F.col("ts")))
    return log.select("seq", record.alias("b")).select("seq", codec.peek_size(F.col("b")).alias("size"))


@_query("""SELECT conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key, text AS value, CAST(turn AS BIGINT) AS ts, false AS tombstone, CAST(NULL AS VARCHAR) AS corrupt_reason,
    CAST(20 + octet_length(encode(conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0'))) + octet_length(encode(text)) AS BIGINT) AS bytes FROM conversations""")
def codec_roundtrip(spark, sf_dir):
    """Records of the conversations, encoded and decoded again, against their source rows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("key"), F.encode("text", "UTF-8").alias("value"), F.col("turn").cast("long").alias("ts"))
    raw = rows.select(codec.encode_record(F.col("key"), F.col("value"), F.col("ts")).alias("b"))
    return _text(raw.select(codec.decode_record(F.col("b")).alias("r"), F.octet_length("b").cast("long").alias("bytes")).select("r.*", "bytes"))


@_query("SELECT event_id AS seq, CASE event_id % 4 WHEN 1 THEN 'checksum' WHEN 2 THEN 'short' WHEN 3 THEN 'checksum' END AS corrupt_reason FROM events")
def crc_check(spark, sf_dir):
    """Whole records, and records with a changed last byte, cut to 10 bytes, or cut by one byte."""
    log = logs.plain_log(spark, sf_dir)
    raw = log.select("seq", F.when(F.col("op") == "delete", codec.encode_tombstone(F.col("key"), F.col("ts"))).otherwise(codec.encode_record(F.col("key"), F.coalesce("value", F.lit(b"")), F.col("ts"))).alias("b"))
    n, cut = F.octet_length("b"), lambda k: F.substring("b", F.lit(1), k)
    harmed = F.when(F.col("seq") % 4 == 1, F.concat(cut(n - 1), F.unhex(F.lit("FF")))).when(F.col("seq") % 4 == 2, cut(F.lit(10))).when(F.col("seq") % 4 == 3, cut(n - 1)).otherwise(F.col("b"))
    return raw.select("seq", codec.decode_record(harmed)["corrupt_reason"].alias("corrupt_reason"))


@_query(
    f"""WITH {SQL_REQUESTS} SELECT CASE op WHEN 'put' THEN 1 WHEN 'get' THEN 2 WHEN 'delete' THEN 3 ELSE 4 END AS code, count(*) AS n,
    CAST(sum(4 + octet_length(encode(key)) + CASE op WHEN 'put' THEN 4 + octet_length(encode(value)) WHEN 'range' THEN 4 + octet_length(encode(end_key)) ELSE 0 END) AS BIGINT) AS payload_bytes
    FROM requests GROUP BY 1"""
)
def frame_parse(spark, sf_dir):
    """All requests as frames, twenty in a buffer, taken apart again."""
    key, value, end = F.col("key"), F.coalesce("value", F.lit(b"")), F.coalesce("end_key", F.lit(""))
    frame = F.when(F.col("op") == "put", codec.put_request(key, value)).when(F.col("op") == "get", codec.get_request(key)).when(F.col("op") == "delete", codec.delete_request(key)).otherwise(codec.range_request(key, end))
    rows = logs.requests(spark, sf_dir).select(F.floor(F.col("seq") / 20).alias("buffer"), F.struct("seq", frame.alias("b")).alias("f"))
    buffers = rows.groupBy("buffer").agg(F.array_sort(F.collect_list("f"))["b"].alias("parts")).select(codec.joined(F.col("parts")).alias("data"))
    parsed = buffers.lateralJoin(Frames(F.col("data").outer()))
    return parsed.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("payload_bytes"))
