"""The logs that the registered queries read, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import file_name, with_offsets
from ..operators.views import sized


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def millis(c):
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def plain_log(spark: SparkSession, sf_dir: str, skew: bool = False, batches: bool = False) -> DataFrame:
    """One operation an event: errors delete, all else puts props under the user's key. skew sets timestamps back by turns."""
    live = F.when(F.col("event_type") == "signup", "batch").otherwise("put") if batches else F.lit("put")
    ts = millis(F.col("ts"))
    if skew:
        ts = ts - (F.col("event_id") % 7) * 3_600_000
    dead = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("key"),
        F.when(~dead, F.encode("props", "UTF-8")).alias("value"), ts.alias("ts"), F.when(dead, "delete").otherwise(live).alias("op"))


def mixed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the plain log, with signups written by batches."""
    return plain_log(spark, sf_dir, batches=True)


def segmented(spark: SparkSession, sf_dir: str, per_file: int = 1000) -> DataFrame:
    """The mixed log in files of per_file records."""
    rows = sized(mixed_log(spark, sf_dir))
    return with_offsets(rows.withColumn("file_id", file_name(F.floor(F.col("seq") / per_file) + 1)))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 100 orders: the priority under the customer's key, in order of orderkey."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = F.struct("o_orderkey", F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("k"), F.encode("o_orderpriority", "UTF-8").alias("v"))
    rows = F.array_sort(F.collect_list(row))
    return orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("batch")).agg(rows.alias("r")).select(
        "batch", F.col("r.k").alias("keys"), F.col("r.v").alias("values"), F.col("batch").cast("long").alias("ts"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved requests: clicks get, views and purchases put, errors delete, signups scan five users on."""
    user = F.col("user_id")
    key = lambda n: F.concat(F.lit("user:"), F.lpad(n.cast("string"), 5, "0"))
    op = F.when(F.col("event_type") == "click", "get").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "range").otherwise("put")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), op.alias("op"), key(user).alias("key"), F.when(F.col("event_type") == "signup", key(user + 5)).alias("end_key"),
        F.when(op == "put", F.encode("props", "UTF-8")).alias("value"))


#: The same in SQL, as common table expressions.
SQL_PLAIN = """log AS (
  SELECT event_id AS seq, 'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value,
         epoch_us(ts) // 1000 AS ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events)"""
SQL_SKEWED = SQL_PLAIN.replace("epoch_us(ts) // 1000 AS ts", "epoch_us(ts) // 1000 - (event_id % 7) * 3600000 AS ts")
SQL_MIXED = SQL_PLAIN.replace("ELSE 'put' END", "WHEN event_type = 'signup' THEN 'batch' ELSE 'put' END")
SQL_SIZED = "sized AS (SELECT *, CAST(20 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) AS BIGINT) AS record_size FROM log)"
SQL_SEGMENTS = f"""{SQL_MIXED}, {SQL_SIZED}, segments AS (
  SELECT *, CAST(sum(record_size) OVER (PARTITION BY file_id ORDER BY seq) - record_size AS BIGINT) AS "offset"
  FROM (SELECT *, lpad(CAST(seq // 1000 + 1 AS VARCHAR), 10, '0') AS file_id FROM sized))"""
SQL_REQUESTS = """requests AS (
  SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'get' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'range' ELSE 'put' END AS op,
         'user:' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS key,
         CASE WHEN event_type = 'signup' THEN 'user:' || lpad(CAST(user_id + 5 AS VARCHAR), 5, '0') END AS end_key, props AS value FROM events)"""
