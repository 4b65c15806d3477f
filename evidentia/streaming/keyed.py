"""Keyed states of event streams: marks that expire, a quota, step alerts.

Each is a stateful processor (RocksDB state). Rows of a key come in pieces and
only what the fold needs is kept of them, so a key with very many rows in a batch
does not fill a task. Expiry goes by event time: a timer at the mark's end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


CHANGES = "key string, at_us long, state string"


class Marks(StatefulProcessor):
    """State dead or alive with the mark's time; unknown when it has run out."""

    def __init__(self, dead_s: int, alive_s: int):
        self.life = {1: dead_s * 1_000_000, 0: alive_s * 1_000_000}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "dead int, at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["at_us"].to_numpy(np.int64), r["dead"].to_numpy(np.int64), r["seq"].to_numpy(np.int64)) for r in rows]
        at, dead, seq = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, at))
        state, since = self.mark.get() if self.mark.exists() else (None, None)
        out = []
        for t, d in zip(at[order].tolist(), dead[order].tolist(), strict=True):
            if state is not None and t < since:
                continue  # late: a newer mark is known
            if state is not None and t > since + self.life[state]:
                out.append((key[0], since + self.life[state], "unknown"))
                state = None
            if d != state:
                out.append((key[0], t, "dead" if d else "alive"))
            state, since = d, t
        self.mark.update((state, since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(-(-(since + self.life[state]) // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "at_us", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.mark.exists():
            state, since = self.mark.get()
            out.append((key[0], since + self.life[state], "unknown"))
            self.mark.clear()
        yield pd.DataFrame(out, columns=["key", "at_us", "state"])

    def close(self) -> None:
        pass


def mark_changes(marks: DataFrame, dead_s: int = 3600, alive_s: int = 900, late: str = "1 day") -> DataFrame:
    """key, at_us, state: changes of a state that expires; marks: key, ts, dead
    (boolean), seq (order of equal times). A dead mark holds for dead_s, an alive
    one for alive_s; the same mark again lengthens it, after its end the state is
    unknown and forgotten. A mark older than the one known changes nothing, as
    does one that the watermark (`late`) has passed. Marks without a key or time
    are left out."""
    rows = marks.filter("key is not null and ts is not null and dead is not null").select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at_us"), F.col("dead").cast("int").alias("dead"), F.col("seq").cast("long").alias("seq"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Marks(dead_s, alive_s), CHANGES, "Append", "EventTime")


OPENINGS = "key string, opened_us long, state string"


class Openings(StatefulProcessor):
    """The time of an opening that has not been answered, and of the last row."""

    def __init__(self, silent_s: int):
        self.silent = silent_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened_us long, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["at_us"].to_numpy(np.int64), r["opens"].to_numpy(np.int64), r["seq"].to_numpy(np.int64)) for r in rows]
        at, opens, seq = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((seq, at))
        opened, last = self.open.get() if self.open.exists() else (None, None)
        out = []
        for t, o in zip(at[order].tolist(), opens[order].tolist(), strict=True):
            if last is not None and t < last:
                continue  # late: what came after it is known
            if opened is not None and t - opened > self.silent:
                out.append((key[0], opened, "silent"))
                opened = None
            if o and opened is None:
                opened = t
            elif not o and opened is not None:
                out.append((key[0], opened, "returned"))
                opened = None
            last = t
        self.open.update((opened, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if opened is not None:
            self.handle.registerTimer(max((opened + self.silent) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "opened_us", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        opened, _ = self.open.get() if self.open.exists() else (None, None)
        if opened is not None:
            out.append((key[0], opened, "silent"))
        self.open.clear()
        yield pd.DataFrame(out, columns=["key", "opened_us", "state"])

    def close(self) -> None:
        pass


def silence(rows: DataFrame, silent_s: int = 1200, late: str = "1 day") -> DataFrame:
    """key, opened_us, state: an opening is returned by the first answer within
    silent_s, and silent if that time passes; rows: key, ts, opens (boolean: an
    opening, else an answer), seq. An opening while one is open, and an answer
    while none is, change nothing, nor does a row older than the last one known."""
    rows = rows.filter("key is not null and ts is not null and opens is not null").select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at_us"), F.col("opens").cast("int").alias("opens"), F.col("seq").cast("long").alias("seq"))
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Openings(silent_s), OPENINGS, "Append", "EventTime")


SPENT = "owner string, quota string, used long, cap long, enough boolean"


class Quota(StatefulProcessor):
    """A shared count for each quota of an owner."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "quota string", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, caps = {}, {}
        for r in rows:
            for (quota, cap), n in r.groupby(["quota", "cap"])["n"].sum().items():
                new[quota], caps[quota] = new.get(quota, 0) + int(n), int(cap)
        out = []
        for quota in sorted(new):
            before = self.used.getValue((quota,))[0] if self.used.containsKey((quota,)) else 0
            total = before + new[quota]
            self.used.updateValue((quota,), (total,))
            out.append((key[0], quota, total, caps[quota], not caps[quota] or total <= caps[quota]))
        yield pd.DataFrame(out, columns=["owner", "quota", "used", "cap", "enough"])

    def close(self) -> None:
        pass


def quota_spending(spends: DataFrame, caps: dict[str, int]) -> DataFrame:
    """owner, quota, used, cap, enough: after each batch the count of every quota
    that was spent from; spends: owner, quota, n. A quota without a cap (0) is
    always enough; what is over the cap is counted as well."""
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]) if caps else F.create_map().cast("map<string,int>")
    rows = spends.filter("owner is not null and quota is not null and n is not null")
    rows = rows.select(F.col("owner").cast("string").alias("owner"), "quota", F.col("n").cast("long").alias("n"), F.coalesce(F.try_element_at(cap, F.col("quota")), F.lit(0)).cast("long").alias("cap"))
    return rows.groupBy("owner").transformWithStateInPandas(Quota(), SPENT, "Update", "None")


ALERTS = "signature string, step long, total long"


class Steps(StatefulProcessor):
    """A running count and the last step that was told."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()[0] if self.count.exists() else 0
        now = before + sum(len(r) for r in rows)
        self.count.update((now,))
        out = [(key[0], step, step * self.size) for step in range(before // self.size + 1, now // self.size + 1)]
        yield pd.DataFrame(out, columns=["signature", "step", "total"])

    def close(self) -> None:
        pass


def step_alerts(events: DataFrame, size: int = 10) -> DataFrame:
    """signature, step, total: a row for each multiple of size that the count of
    a signature reaches, once, in whatever batches the events come. Events
    without a signature are left out."""
    rows = events.filter("signature is not null").select(F.col("signature").cast("string").alias("signature"))
    return rows.groupBy("signature").transformWithStateInPandas(Steps(size), ALERTS, "Append", "None")
