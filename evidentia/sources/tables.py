"""Readers of the supplied tables, and the usage view of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage_events(events: DataFrame) -> DataFrame:
    """Events as usage rows: stream, line, model, step and four counters. The
    counters are integer functions of value and props.k, as FIXTURES.md maps
    them; USAGE is the same in SQL."""
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    return events.select(
        F.col("user_id").alias("stream"),
        F.col("event_id").alias("line"),
        "ts",
        F.col("event_type").alias("model"),
        F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", 2).cast("int").alias("signal"),
        F.coalesce(k, F.lit(0)).alias("tokens_in"),
        value.alias("tokens_out"),
        (F.coalesce(k, F.lit(0)) * 2).alias("cache_write"),
        (value * 3).alias("cache_read"),
    )


USAGE = """
select user_id as stream, event_id as line, ts, event_type as model,
       cast(case event_type when 'signup' then 1 when 'purchase' then 2 end as int) as signal,
       coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) as tokens_in,
       cast(floor(coalesce(value, 0)) as bigint) as tokens_out,
       coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) * 2 as cache_write,
       cast(floor(coalesce(value, 0)) as bigint) * 3 as cache_read
from events
"""
