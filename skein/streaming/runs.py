"""Structured Streaming forms of the event operators, and a runner that drains what is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.shared import new_path

def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 4) -> DataFrame:
    """Reader events as a stream of files; ts becomes a timestamp, which windows need. No watermark: files come in any order of time, the
    whole history counts, and a watermark of one batch would drop the older rows of the next."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """What the stream gives once all present input is read: in complete mode the last batch's rows, else all batches' rows."""
    spark = stream.sparkSession
    out, schema = new_path(spark, label), stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*schema.names)


def tumbling(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.unix_seconds("session_window.start").alias("start"), "user_id", "n")


def first_views(events: DataFrame) -> DataFrame:
    """The first view of a visitor, who is a user on a UTC day, that the stream meets; the state is one row a visitor."""
    return events.where("event_type = 'view'").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "ts").dropDuplicates(["user_id", "day"])


def rate_limited(events: DataFrame, most: int = 30, seconds: int = 60, idle: str | None = None) -> DataFrame:
    """(user_id, event_id, stored): an event is stored if fewer than `most` stored ones of its user lie in the seconds before it, itself left out. Events
    of a batch are taken in time order; one that comes late is judged by what lies before it. The state is the stored times of the last three periods;
    of a stream that runs on it goes when a user has been idle for so long by the clock. A stream that is to end when its input does has no such clock."""
    period = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        stored = []
        for t in rows["us"].tolist():
            stored.append(sum(0 <= t - x < period for x in times) < most)
            if stored[-1]:
                times.append(t)
        newest = max(times, default=0)
        state.update(([x for x in times if x > newest - 3 * period],))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "stored": stored})

    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, stored boolean", "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def anchored(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, event_id, first_us): the start of each event's run, which the first event so many seconds or more after the start of the one before
    begins. A user's events are taken in time order; the state holds them until none earlier can come, that is, until the stream's input is drained:
    runs of an event depend on all before it. Each trigger gives the runs that its events and those held make; the last one's stand."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches))
        times += rows["us"].tolist()
        ids += rows["event_id"].tolist()
        state.update((times, ids))
        order = sorted(range(len(ids)), key=lambda i: (times[i], ids[i]))
        first, out = None, []
        for i in order:
            if first is None or times[i] - first >= seconds * 1_000_000:
                first = times[i]
            out.append((key[0], ids[i], first, len(ids)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "first_us", "seen"])

    rows = events.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, first_us long, seen long", "times array<long>, ids array<long>", "append", GroupStateTimeout.NoTimeout)


class _Runs(StatefulProcessor):
    """A user's runs in event time. The state is the events that an earlier one could still come before, and the start of the last run until it is over."""

    def __init__(self, seconds: int) -> None:
        self.length = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.anchor = handle.getValueState("anchor", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i)) for pdf in rows for t, i in zip(pdf["us"], pdf["event_id"], strict=True)]
        self.waiting.appendList(new)
        self._wake(min(t for t, _ in new))
        yield pd.DataFrame({"user_id": [], "event_id": [], "first_us": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((int(t), int(i)) for t, i in self.waiting.get())
        settled, later = [x for x in held if x[0] <= mark], [x for x in held if x[0] > mark]
        first = int(self.anchor.get()[0]) if self.anchor.exists() else None
        out = []
        for t, i in settled:
            if first is None or t - first >= self.length:
                first = t
            out.append((key[0], i, first))
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if first is not None and first + self.length > mark:
            self.anchor.update((first,))
            self._wake(first + self.length)
        else:
            self.anchor.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "first_us"])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def settled_runs(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """(user_id, event_id, first_us) as anchored gives them, of each event once, when none earlier can come any more: a stream in which events come up to
    `late` after newer ones. A run that is over leaves the state, which holds a user's events of the last `late` and one start. Events that come later than
    that are dropped. The state store must be one with timers (RocksDB)."""
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Runs(seconds), "user_id long, event_id long, first_us long", "Append", "EventTime")
