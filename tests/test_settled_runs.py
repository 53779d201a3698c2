"""Runs of a stream with bounded state: every event once, whatever the triggers, late events within the stated delay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein.streaming import runs

STORE = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    was = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, was)


def test_each_event_once_over_ten_triggers(rocks, tmp_path):
    rnd, spark = random.Random(3), rocks
    rows = [(i, i % 4, START + dt.timedelta(minutes=10 * i + rnd.randrange(40))) for i in range(120)]
    rows.append((999, 9, START + dt.timedelta(days=9)))  # moves the watermark past all others
    for n in range(10):
        part = [r for r in rows if r[0] // 12 == n or n == 9 and r[0] == 999]
        spark.createDataFrame(part, "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runs.drained(runs.settled_runs(stream, 3600, "2 hours"), "settled", "append").collect()
    want = {}
    for user in range(4):
        first = None
        for i, _, t in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            if first is None or t - first >= dt.timedelta(hours=1):
                first = t
            want[i] = first
    assert len(got) == len(want) and {r.event_id: r.first_us for r in got} == {i: int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for i, t in want.items()}
