"""Streams over several batches: growing files, late marks, quotas, replays."""

import os
import tempfile

from pyspark.sql import functions as F

from evidentia.streaming import keyed, requests, tail


def new_folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(stream, folder, mode="append"):
    """One run over all there is; rows of each batch land in Parquet once."""

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def landed(spark, stream, folder):
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if os.path.isdir(f"{folder}/out") else spark.createDataFrame([], stream.schema)


# ------------------------------------------------------------------------ tail
def test_tail_of_growing_files(spark):
    data, run = new_folder(), new_folder()
    a, b = f"{data}/a.jsonl", f"{data}/deep/b.jsonl"
    os.makedirs(f"{data}/deep")
    open(a, "w").write("one\ntwo\nthr")
    open(b, "w").write("")
    open(f"{data}/c.txt", "w").write("not this one\n")

    def tick():
        s = tail.tail_lines(spark, data, chunk=5)
        done = drain(s, run)
        found = [(os.path.basename(r["path"]), r["at"], r["line"]) for r in landed(spark, s, run).drop("batch").collect()]
        return sorted(found), done

    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert tick()[0] == want  # the torn line waits
    open(a, "a").write("ee\nfour is a longer line than a chunk\n\nél")
    open(b, "a").write("x\n")
    want += [("a.jsonl", 8, "three"), ("a.jsonl", 14, "four is a longer line than a chunk"), ("a.jsonl", 49, ""), ("b.jsonl", 0, "x")]
    got, done = tick()  # a new query over the checkpoint: a restart
    assert got == sorted(want)
    last = [p for p in done.recentProgress if p["numInputRows"]][-1]
    states = {os.path.basename(r["path"]): r["state"] for r in tail.coverage(spark, last).collect()}
    assert states == {"a.jsonl": "read", "b.jsonl": "read"}
    assert tick()[0] == sorted(want)
    open(a, "w").write("new\n")  # shorter than what was read: from its start
    assert tick()[0] == sorted([*want, ("a.jsonl", 0, "new")])


def test_lines_belong_to_the_range_of_their_line_feed():
    import pyarrow as pa

    text = b"ab\n\ncdefgh\nij\n" + b"k" * 200_000 + b"\nlast\ntorn"
    whole = list(tail.lines_of(pa.BufferReader(text), 0, len(text)))
    assert [x[1] for x in whole] == text.split(b"\n")[:-1] and all(text[at : at + len(x)] == x for at, x in whole)
    for step in (1, 3, 7, 100_001):
        cut = range(0, len(text), step) if step > 5 else [*range(0, 40, step), 40]
        edges = [*cut, len(text)]
        got = [x for low, high in zip(edges, edges[1:], strict=False) for x in tail.lines_of(pa.BufferReader(text), low, high, most=50_000)]
        assert got == whole


# ----------------------------------------------------------------------- marks
def files_of(spark, batches, schema, data, start=0):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{data}/{start + i}")


def over_batches(spark, batches, schema, build, mode="append"):
    """Each list of rows as a batch of its own, with a restart between."""
    data, run = new_folder(), new_folder()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{data}/in")
        s = build(spark.readStream.schema(schema).parquet(f"{data}/in"))
        drain(s, run, mode)
    return landed(spark, s, run)


MARKS = "key string, ts timestamp, dead boolean, seq long"


def marks(*rows):
    from datetime import datetime

    return [(k, datetime.fromisoformat(f"2024-01-01T{t}"), d, i) for i, (k, t, d) in enumerate(rows)]


def test_marks_late_expired_and_lengthened(spark):
    keyed.use_rocksdb(spark)
    batches = [
        marks(("a", "10:00:00", False), ("b", "10:00:00", True), ("c", "10:00:00", False), ("c", "10:10:00", False), (None, "10:00:00", True)),
        marks(("a", "09:58:00", True), ("b", "10:30:00", True), ("c", "10:24:00", True)),  # a: late, changes nothing
        marks(("a", "10:40:00", True), ("d", "13:00:00", False)),
        marks(("e", "13:00:01", False)),
    ]
    out = over_batches(spark, batches, MARKS, lambda s: keyed.mark_changes(s, late="10 minutes"))
    got = sorted((r["key"], str(r["t"])[11:], r["state"]) for r in out.withColumn("t", F.timestamp_micros("at_us")).collect())
    assert got == [
        ("a", "10:00:00", "alive"), ("a", "10:15:00", "unknown"), ("a", "10:40:00", "dead"), ("a", "11:40:00", "unknown"),
        ("b", "10:00:00", "dead"), ("b", "11:30:00", "unknown"),
        ("c", "10:00:00", "alive"), ("c", "10:24:00", "dead"), ("c", "11:24:00", "unknown"),
        ("d", "13:00:00", "alive"), ("e", "13:00:01", "alive"),
    ]


OPENS = "key string, ts timestamp, opens boolean, seq long"


def test_silence_over_batches(spark):
    keyed.use_rocksdb(spark)
    batches = [
        marks(("a", "10:00:00", True), ("a", "10:05:00", False), ("b", "10:00:00", True), ("c", "10:00:00", True), ("c", "10:10:00", True)),
        marks(("b", "09:59:00", False), ("c", "10:19:00", False), ("d", "10:00:00", False)),  # b: late, answers nothing
        marks(("b", "11:00:00", True), ("b", "11:01:00", False), ("e", "12:00:00", True)),
        marks(("f", "13:00:00", True)),
        marks(("f", "13:00:01", True)),
    ]
    out = over_batches(spark, batches, OPENS, lambda s: keyed.silence(s, late="10 minutes"))
    got = sorted((r["key"], str(r["t"])[11:], r["state"]) for r in out.withColumn("t", F.timestamp_micros("opened_us")).collect())
    assert got == [("a", "10:00:00", "returned"), ("b", "10:00:00", "silent"), ("b", "11:00:00", "returned"), ("c", "10:00:00", "returned"), ("e", "12:00:00", "silent")]


def test_quota_is_shared_and_counts_over_its_cap(spark):
    keyed.use_rocksdb(spark)
    batches = [[("run1", "search", 199), ("run2", "search", 5), ("run1", "free", 1000)], [("run1", "search", 2), (None, "search", 7)], [("run2", "search", 1)]]
    out = over_batches(spark, batches, "owner string, quota string, n long", lambda s: keyed.quota_spending(s, {"search": 200}), "update")
    assert sorted(tuple(r)[:5] for r in out.collect()) == [("run1", "free", 1000, 0, True), ("run1", "search", 199, 200, True), ("run1", "search", 201, 200, False), ("run2", "search", 5, 200, True), ("run2", "search", 6, 200, True)]


def test_alerts_once_a_step(spark):
    keyed.use_rocksdb(spark)
    batches = [[("x",)] * 7 + [("y",)] * 31, [("x",)] * 2 + [(None,)] * 20, [("x",)] * 12]
    out = over_batches(spark, batches, "signature string", lambda s: keyed.step_alerts(s, 10))
    assert sorted(tuple(r)[:3] for r in out.collect()) == [("x", 1, 10), ("x", 2, 20), ("y", 1, 10), ("y", 2, 20), ("y", 3, 30)]


# -------------------------------------------------------------------- requests
REQUESTS = "key string, hash string, priority long, at timestamp"


def job(spark, *rows):
    return spark.createDataFrame(list(rows), requests.JOBS)


def test_rules_of_a_merge(spark):
    from datetime import datetime as D

    now = F.lit("2024-01-20").cast("timestamp")
    old, new, t = D(2024, 1, 2), D(2024, 1, 18), D(2024, 1, 19)
    jobs = job(spark, ("wait", "h", 50, 1, "queued", None, None), ("run", "h", 50, 3, "running", new, None), ("run_same", "h", 50, 3, "running", new, "p"), ("fresh", "h", 50, 2, "current", new, None), ("stale", "h", 50, 2, "current", old, None), ("other", "h", 50, 2, "updated", new, None), ("failed", "h", 50, 2, "failed", new, None), ("quiet", "h", 50, 9, "current", old, None))
    asked = [("wait", "h", 10, t), ("run", "g", 60, t), ("run_same", "h", 10, t), ("fresh", "h", 90, t), ("stale", "h", 70, t), ("other", "g", 80, t), ("failed", "h", 5, t), ("new", "n", 40, t), ("new", "m", 1, new), ("new", "n", 30, new), (None, "h", 1, t)]
    got = {r["key"]: tuple(r)[1:] for r in requests.merge(spark.createDataFrame(asked, REQUESTS), jobs, now).collect()}
    assert got == {
        "wait": ("h", 10, 1, "queued", None, None), "run": ("h", 50, 3, "running", new, "g"), "run_same": ("h", 10, 3, "running", new, "p"), "fresh": ("h", 50, 2, "current", new, None),
        "stale": ("h", 70, 3, "queued", old, None), "other": ("g", 80, 3, "queued", None, None), "failed": ("h", 5, 3, "queued", new, None), "new": ("n", 30, 1, "queued", None, None), "quiet": ("h", 50, 9, "current", old, None),
    }
    after = requests.finish(requests.merge(spark.createDataFrame(asked, REQUESTS), jobs, now), spark.createDataFrame([("run", t), ("run_same", t), ("fresh", t)], "key string, at timestamp"))
    ended = {r["key"]: tuple(r)[1:] for r in after.collect()}
    assert ended["run"] == ("g", 50, 4, "queued", None, None) and ended["run_same"] == ("p", 10, 4, "queued", None, None) and ended["fresh"] == got["fresh"]


def test_a_repeated_batch_changes_nothing(spark):
    from datetime import datetime as D

    folder, now, t = new_folder(), F.lit("2024-01-20").cast("timestamp"), D(2024, 1, 19)
    first, second = spark.createDataFrame([("a", "1", 5, t), ("b", "1", 5, t)], REQUESTS), spark.createDataFrame([("a", "2", 3, t), ("c", "1", 9, t)], REQUESTS)
    put = requests.merger(folder, now)
    put(first, 0)
    put(second, 1)
    want = sorted(map(tuple, requests.read_jobs(spark, folder).collect()), key=repr)
    put(second, 1)
    assert sorted(map(tuple, requests.read_jobs(spark, folder).collect()), key=repr) == want
    assert {r[0]: (r[1], r[3]) for r in want} == {"a": ("2", 2), "b": ("1", 1), "c": ("1", 1)}


def test_half_written_version_is_not_seen(spark):
    from datetime import datetime as D

    folder, now, t = new_folder(), F.lit("2024-01-20").cast("timestamp"), D(2024, 1, 19)
    put = requests.merger(folder, now)
    put(spark.createDataFrame([("a", "1", 5, t)], REQUESTS), 0)
    requests.merge(spark.createDataFrame([("z", "1", 5, t)], REQUESTS), requests.read_jobs(spark, folder), now).write.parquet(f"{folder}/batch-1")
    assert [r["key"] for r in requests.read_jobs(spark, folder).collect()] == ["a"]
    put(spark.createDataFrame([("y", "1", 5, t)], REQUESTS), 1)
    assert sorted(r["key"] for r in requests.read_jobs(spark, folder).collect()) == ["a", "y"]


def test_empty_streams(spark):
    assert requests.merge(spark.createDataFrame([], REQUESTS), spark.createDataFrame([], requests.JOBS), F.current_timestamp()).count() == 0
