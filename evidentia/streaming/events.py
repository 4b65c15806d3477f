"""Event streams: extraction, counters and sessions; keyed states are in keyed.

Each takes a streaming (or batch) DataFrame of events: event_id, ts, user_id,
event_type, value, props.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail_events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over a folder of immutable Parquet segments. Appended files are
    not seen again; writers land new segments."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file is a source as well
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def error_events(events: DataFrame) -> DataFrame:
    """Errors with a kind by their props, stateless."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(k.isNull(), "torn").when(k % 3 == 0, "timeout").when(k % 3 == 1, "refused").otherwise("other")
    return events.filter("event_type = 'error'").select("event_id", "ts", "user_id", kind.alias("kind"))


def error_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, kind, n: tumbling windows; rows over `late` late are dropped."""
    rows = error_events(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    rows = rows.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "kind", "n")


def running_counts(events: DataFrame, step: int = 10) -> DataFrame:
    """event_type, user_id, n, alerts: repeats of a signature and how many steps
    they have passed."""
    rows = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("alerts", F.floor(F.col("n") / step).cast("long"))


def overlong(events: DataFrame, ceilings: dict[str, int], gap: str = "30 minutes", other_s: int = 1200, late: str = "1 day") -> DataFrame:
    """user_id, role, started, seconds of sessions over the ceiling of their
    role, or other_s where a role has none; events have a column role."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy("user_id", "role", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    seconds = F.unix_timestamp("ended") - F.unix_timestamp("started")
    ceiling = F.lit(other_s)
    for role, most in ceilings.items():
        ceiling = F.when(F.col("role") == role, most).otherwise(ceiling)
    return rows.select("user_id", "role", "started", seconds.alias("seconds")).filter(F.col("seconds") > ceiling)


def latest(events: DataFrame) -> DataFrame:
    """user_id, event_type, ts: the last event, a keyed state."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    return events.groupBy("user_id").agg(last).select("user_id", "x.event_type", "x.ts")


def channel_state(events: DataFrame, now, dead_s: int = 3600, alive_s: int = 900) -> DataFrame:
    """user_id, state: dead for dead_s after an error, alive for alive_s after a
    view, unknown after that."""
    marks = latest(events.filter("event_type in ('error', 'view')"))
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    dead = F.col("event_type") == "error"
    return marks.select("user_id", F.when(age > F.when(dead, dead_s).otherwise(alive_s), "unknown").when(dead, "dead").otherwise("alive").alias("state"))


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Run a stream over all there is, into Parquet under folder/out, a folder for
    each batch, so that a batch that is repeated replaces itself; of complete
    results the last batch is the result."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def streamed(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append") -> DataFrame:
    stream = build(tail_events(spark, path))
    run_available(stream, folder, mode)
    rows = spark.read.schema(f"{','.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/out")
    if mode == "complete":
        rows = rows.filter(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return rows.drop("batch")
