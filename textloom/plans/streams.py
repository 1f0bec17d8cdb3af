"""Queries on the events table, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.common import shared_folder
from textloom.streaming import streams as ST

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file source wants a folder or a pattern; this pattern is the table itself, be it a file or a folder
    return ST.read_files(spark, f"{d}/event[s].parquet", schema).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


EV = "SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type FROM events"


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, event_type, count(*) AS n FROM ({EV}) GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ST.run_to_table(ST.tumbling(_stream(spark, d), "ts", "1 hour"), "tumbling", _folder(spark), "complete")


@query(f"SELECT event_id FROM ({EV})")
def stream_dedup_watermark(spark: SparkSession, d: str) -> DataFrame:
    out = ST.first_seen(_stream(spark, d), "ts", ["event_id"], "10 days")
    return ST.run_to_table(out.select("event_id"), "dedup", _folder(spark))


@query(
    f"""WITH e AS ({EV}), g AS (SELECT *, (ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    return ST.run_to_table(ST.sessions(_stream(spark, d), "ts", "user_id", "30 minutes"), "sessions", _folder(spark), "complete")


@query(
    f"""SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS w_start, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) + INTERVAL 2 HOUR AS w_end, event_type, count(*) AS n
    FROM ({EV}), range(4) r(k) GROUP BY ALL"""
)
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return ST.run_to_table(ST.sliding(_stream(spark, d), "ts", "2 hours", "30 minutes", ["event_type"]), "sliding", _folder(spark), "complete")


@query(f"SELECT event_type, (count(*) // 10)::BIGINT AS dev, (count(*) - count(*) // 10)::BIGINT AS train FROM ({EV}) GROUP BY event_type")
def stream_dev_split(spark: SparkSession, d: str) -> DataFrame:
    with ST.state_store(spark):
        rows = ST.run_to_table(ST.split_stream(_stream(spark, d), "event_type", "0.1"), "split", _folder(spark))
    of = lambda part: F.count_if(F.col("split") == part).alias(part)
    return rows.groupBy("event_type").agg(of("dev"), of("train"))
