"""Driver queries on streams: a table is read as a stream until its end, and what comes out is written in the shared folder and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import staging
from attestry.streaming import ledger


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's as a stream; its path may be a file or a folder."""
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(path)


def drained(rows: DataFrame) -> DataFrame:
    """What a stream gives until its input ends."""
    spark = rows.sparkSession
    path = f"{staging.shared_dir(spark)}/attestry-{uuid.uuid4().hex}"
    staging.written.append((spark, path))
    rows.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12, W01, W02 on a stream: the events of each user in the order of their time, numbered by a property and said to have been a few minutes before."""
    read = streamed(spark, sf_dir, "events")
    events = read.selectExpr("user_id AS key", "ts AS received", "CAST(get_json_object(props, '$.k') AS BIGINT) AS sequence", "ts - make_interval(0, 0, 0, 0, 0, event_id % 7 * 10) AS at")
    return drained(ledger.order_issues(events, "1 hour", kept_days=100_000)).select("key", F.col("received").cast("timestamp_ntz").alias("received"), "sequence", "code")


ORDER_SQL = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS key, ts AS received, CAST(json_extract(props, '$.k') AS BIGINT) AS sequence, ts - to_minutes(CAST(event_id % 7 * 10 AS BIGINT)) AS said FROM events WHERE ts IS NOT NULL),
seen AS (
  SELECT *, coalesce(last_value(sequence IGNORE NULLS) OVER own, -1) AS last, last_value(said IGNORE NULLS) OVER own AS last_said FROM e
  WINDOW own AS (PARTITION BY key ORDER BY received, sequence NULLS FIRST, said NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
passed AS (SELECT date_trunc('second', date_trunc('millisecond', max(received)) - INTERVAL 1 HOUR) AS mark FROM e)
SELECT key, received, sequence, code FROM (
  SELECT *, 'event_order' AS code FROM seen WHERE sequence <= last UNION ALL SELECT *, 'event_time_order' FROM seen WHERE said < last_said), passed
WHERE received <= mark
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {"stream_order": (stream_order, ORDER_SQL)}
