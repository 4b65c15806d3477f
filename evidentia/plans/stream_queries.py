"""Queries that run as streams over the supplied tables, each over all there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.shared import shared_dir
from evidentia.sources.tables import table
from evidentia.streaming import events as V
from evidentia.streaming import keyed, requests, tail

QUERIES, SQL = {}, {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def folder(spark) -> str:
    return f"{shared_dir(spark)}/evidentia/stream-{uuid.uuid4().hex}"


@q("select event_id, user_id, event_type from events")
def r01_tail_lines(spark, d):
    """Events as JSON lines in files of a shared folder, read by byte ranges."""
    at, run = folder(spark), folder(spark)
    table(spark, d, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type"))).write.text(at)
    lines = tail.tail_lines(spark, at, suffix=".txt", chunk=1 << 18)
    V.run_available(lines, run)
    rows = spark.read.schema(tail.LINES).parquet(f"{run}/out")
    return rows.select(F.from_json("line", "event_id long, user_id long, event_type string").alias("x")).select("x.*")


@q("select event_type || ':' || user_id as signature, unnest(range(1, n // 3 + 1)) as step, step * 3 as total from (select event_type, user_id, count(*) as n from events group by 1, 2)")
def r03_step_alerts(spark, d):
    keyed.use_rocksdb(spark)
    signature = F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("signature")
    return V.streamed(spark, f"{d}/events.parquet", lambda e: keyed.step_alerts(e.select(signature), 3), folder(spark))


@q("""with e as (select user_id, event_id, ts, event_type, case event_type when 'error' then interval 3600 second else interval 900 second end as ttl from events where event_type in ('error', 'view')),
m as (select *, lag(event_type) over w as pt, lag(ts + ttl) over w as pu, lead(ts) over w as nx from e window w as (partition by user_id order by ts, event_id)), wm as (select max(ts) - interval 1 day as w from e)
select user_id, cast(epoch_us(ts) as bigint) as at_us, case event_type when 'error' then 'dead' else 'alive' end as state from m where pt is null or pt <> event_type or ts > pu
union all select user_id, epoch_us(pu), 'unknown' from m where ts > pu union all select user_id, epoch_us(ts + ttl), 'unknown' from m, wm where nx is null and ts + ttl < w""")
def r04_channel_changes(spark, d):
    keyed.use_rocksdb(spark)

    def build(e: DataFrame) -> DataFrame:
        marks = e.filter("event_type in ('error', 'view')")
        return keyed.mark_changes(marks.select(F.col("user_id").alias("key"), "ts", (F.col("event_type") == "error").alias("dead"), F.col("event_id").alias("seq")))

    out = V.streamed(spark, f"{d}/events.parquet", build, folder(spark))
    return out.select(F.col("key").cast("long").alias("user_id"), "at_us", "state")


@q("""select cast(user_id % 10 as varchar) as owner, event_type as quota, count(*) as used, case event_type when 'click' then 20 when 'error' then 1000000 else 0 end as cap,
event_type not in ('click', 'error') or count(*) <= case event_type when 'click' then 20 else 1000000 end as enough from events group by 1, 2""")
def r04_quota(spark, d):
    """A count for each quota that the users of a group share."""
    keyed.use_rocksdb(spark)
    spends = lambda e: e.select((F.col("user_id") % 10).alias("owner"), F.col("event_type").alias("quota"), F.lit(1).alias("n"))
    return V.streamed(spark, f"{d}/events.parquet", lambda e: keyed.quota_spending(spends(e), {"click": 20, "error": 1_000_000}), folder(spark), "update")


@q("""with recursive e as (select user_id, epoch_us(ts) as t, event_type = 'click' as opens, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('click', 'purchase')),
f(user_id, rn, opened, closed, state) as (
  select user_id, 0::bigint, null::bigint, null::bigint, null::varchar from (select distinct user_id from e)
  union all
  select e.user_id, e.rn,
    case when f.opened is null or e.t - f.opened > 1200000000 then case when e.opens then e.t end when e.opens then f.opened end,
    case when f.opened is not null and (e.t - f.opened > 1200000000 or not e.opens) then f.opened end,
    case when f.opened is not null and e.t - f.opened > 1200000000 then 'silent' when f.opened is not null and not e.opens then 'returned' end
  from f join e on e.user_id = f.user_id and e.rn = f.rn + 1),
wm as (select epoch_us(max(ts) - interval 1 day) as w from events where event_type in ('click', 'purchase'))
select user_id, closed as opened_us, state from f where state is not null
union all select user_id, opened, 'silent' from (select user_id, max_by(opened, rn) as opened from (select user_id, rn, coalesce(opened, -1) as opened from f) group by 1), wm where opened >= 0 and opened + 1200000000 < w - 1000""")
def r05_silence(spark, d):
    keyed.use_rocksdb(spark)

    def build(e: DataFrame) -> DataFrame:
        rows = e.filter("event_type in ('click', 'purchase')")
        return keyed.silence(rows.select(F.col("user_id").alias("key"), "ts", (F.col("event_type") == "click").alias("opens"), F.col("event_id").alias("seq")))

    return V.streamed(spark, f"{d}/events.parquet", build, folder(spark)).select(F.col("key").cast("long").alias("user_id"), "opened_us", "state")


@q("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as sid from g),
l as (select user_id, case when user_id % 3 = 0 then 'lead' else 'worker' end as role, cast(floor(epoch(max(ts))) - floor(epoch(min(ts))) as bigint) as seconds from s group by user_id, sid)
select * from l where seconds > case role when 'lead' then 2700 else 1200 end""")
def r07_overlong(spark, d):
    role = F.when(F.col("user_id") % 3 == 0, "lead").otherwise("worker")
    out = V.streamed(spark, f"{d}/events.parquet", lambda e: V.overlong(e.withColumn("role", role), {"lead": 2700}, "2 hours"), folder(spark), "complete")
    return out.select("user_id", "role", "seconds")


@q("""with jobs as (select cast(user_id as varchar) as key, min(event_type) as hash, min(event_id % 7) as priority, 1 + user_id % 3 as version, ['queued', 'running', 'current', 'failed'][1 + user_id % 4] as state,
  case when user_id % 4 = 2 then timestamp '2024-01-01' + to_days(cast(user_id % 20 as int)) end as checked from events where event_id % 2 = 0 group by user_id),
per_hash as (select cast(user_id as varchar) as key, event_type as hash, min(event_id % 7) as priority, max(ts) as asked_at from events where event_id % 2 = 1 group by 1, 2),
asked as (select key, hash as n_hash, priority as n_priority from per_hash qualify row_number() over (partition by key order by asked_at desc, hash desc) = 1),
r as (select coalesce(j.key, a.key) as key, j.*, a.n_hash, a.n_priority, j.version is not null as old, n_hash is not null as new, coalesce(j.hash = a.n_hash, false) as same,
  coalesce(date_diff('second', checked, timestamp '2024-01-20') between 0 and 604800, false) as fresh from jobs j full join asked a on j.key = a.key),
k as (select *, old and new and not same and state = 'running' as pending, not new or (old and same and (state in ('queued', 'running') or (state = 'current' and fresh))) or (old and not same and state = 'running') as kept from r)
select key, case when kept then hash else n_hash end as hash, case when not new then priority when kept then least(priority, n_priority) else n_priority end as priority,
  case when kept then version else coalesce(version, 0) + 1 end as version, case when kept then state else 'queued' end as state,
  case when (kept or same) and checked is not null then cast(epoch(checked) as bigint) end as checked_s, case when pending then n_hash end as pending_hash from k""")
def r08_merge_requests(spark, d):
    """Requests of odd events, merged by a stream into jobs of even ones."""
    at = folder(spark)
    u = F.col("user_id")
    checked = F.when(u % 4 == 2, F.timestamp_seconds(1704067200 + (u % 20) * 86400))
    jobs = table(spark, d, "events").filter("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_type").alias("hash"), F.min(F.col("event_id") % 7).alias("priority"))
    jobs = jobs.select(u.cast("string").alias("key"), "hash", "priority", (1 + u % 3).alias("version"), F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "current", "failed")]), (u % 4 + 1).cast("int")).alias("state"), checked.alias("checked"), F.lit(None).cast("string").alias("pending_hash"))
    requests.write_jobs(jobs, f"{at}/jobs", -1)
    stream = V.tail_events(spark, f"{d}/events.parquet").filter("event_id % 2 = 1").select(u.cast("string").alias("key"), F.col("event_type").alias("hash"), (F.col("event_id") % 7).alias("priority"), F.col("ts").alias("at"))
    put = requests.merger(f"{at}/jobs", F.timestamp_seconds(F.lit(1705708800)))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return requests.read_jobs(spark, f"{at}/jobs").select("key", "hash", "priority", "version", "state", F.unix_timestamp("checked").alias("checked_s"), "pending_hash")
