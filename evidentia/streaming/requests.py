"""Requests merged into a table of jobs, once for each batch.

A batch's result is written as a version of the table named after the batch,
from the last version before it. A batch that is repeated after a failure starts
from the same version and writes the same one again, so it changes nothing; a
version counts once the journal names it, which is written last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOBS = "key string, hash string, priority long, version long, state string, checked timestamp, pending_hash string"
#: States in which an equal request is not a new one.
WAITING = ["queued", "running", "deferred", "blocked"]
FRESH_DAYS = 7


def merge(batch: DataFrame, jobs: DataFrame, now: Column, fresh_days: int = FRESH_DAYS) -> DataFrame:
    """jobs with the requests of a batch (key, hash, priority, at). Of several
    requests of a key the last hash counts (equal times: the greatest), with the
    best priority asked for it.

    Equal hash, and waiting or checked within fresh_days: a duplicate, which can
    only better the priority. Another hash while the job runs: kept as
    pending_hash. Otherwise the job is queued anew as the next version, checked
    forgotten where the hash is another. Requests without a key or hash are left
    out; columns beyond these are ignored."""
    asked = batch.filter("key is not null and hash is not null").groupBy("key", "hash").agg(F.min("priority").alias("priority"), F.max("at").alias("at"))
    asked = asked.groupBy("key").agg(F.max(F.struct("at", "hash", "priority")).alias("x")).select("key", F.col("x.hash").alias("n_hash"), F.col("x.priority").alias("n_priority"))
    rows = jobs.join(asked, "key", "full")
    old, new = F.col("version").isNotNull(), F.col("n_hash").isNotNull()
    same = F.col("hash").eqNullSafe(F.col("n_hash"))
    age = F.unix_timestamp(now) - F.unix_timestamp("checked")
    fresh = F.coalesce((age >= 0) & (age <= fresh_days * 86400), F.lit(False))
    duplicate = old & same & (F.col("state").isin(*WAITING) | (F.col("state").isin("current", "updated") & fresh))
    pending = old & ~same & (F.col("state") == "running")
    kept = ~new | duplicate | pending
    return rows.select(
        "key",
        F.when(kept, F.col("hash")).otherwise(F.col("n_hash")).alias("hash"),
        F.when(~new, F.col("priority")).when(kept, F.least("priority", "n_priority")).otherwise(F.col("n_priority")).alias("priority"),
        F.when(kept, F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1).alias("version"),
        F.when(kept, F.col("state")).otherwise("queued").alias("state"),
        F.when(kept | same, F.col("checked")).alias("checked"),
        F.when(new & pending, F.col("n_hash")).when(kept, F.col("pending_hash")).alias("pending_hash"),
    )


def finish(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs after runs ended (key, at): a pending request becomes the job's next
    version and is queued; else the job is current, checked at that time."""
    rows = jobs.join(done.groupBy("key").agg(F.max("at").alias("at")), "key", "left")
    ended = F.col("at").isNotNull() & (F.col("state") == "running")
    again = ended & F.col("pending_hash").isNotNull()
    return rows.select(
        "key",
        F.when(again, F.col("pending_hash")).otherwise(F.col("hash")).alias("hash"),
        "priority",
        (F.col("version") + F.when(again, 1).otherwise(0)).alias("version"),
        F.when(again, "queued").when(ended, "current").otherwise(F.col("state")).alias("state"),
        F.when(again, F.lit(None)).when(ended, F.col("at")).otherwise(F.col("checked")).alias("checked"),
        F.when(~again, F.col("pending_hash")).alias("pending_hash"),
    )


def last_version(spark: SparkSession, folder: str, before: int | None = None) -> int | None:
    try:
        rows = spark.read.schema("batch long").parquet(f"{folder}/journal")
        return rows.filter(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def read_jobs(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The table after the last batch, or after the last one before a batch."""
    version = last_version(spark, folder, before)
    if version is None:
        return spark.createDataFrame([], JOBS)
    return spark.read.schema(JOBS).parquet(f"{folder}/batch-{version}")


def write_jobs(jobs: DataFrame, folder: str, batch: int) -> None:
    jobs.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
    jobs.sparkSession.createDataFrame([(batch,)], "batch long").write.mode("append").parquet(f"{folder}/journal")


def merger(folder: str, now: Column) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: merges each batch into the table in folder."""

    def put(batch: DataFrame, number: int) -> None:
        write_jobs(merge(batch, read_jobs(batch.sparkSession, folder, number), now), folder, number)

    return put
