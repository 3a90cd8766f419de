"""Streams over a finished table, cut into any number of batches, against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.streaming import changes

LATE = "36500 days"


@pytest.mark.parametrize("pieces", [1, 3, 7])
def test_streams_equal_their_twins_in_any_batches(spark, tmp_path, pieces):
    rng = random.Random(4)
    rows = [(rng.randrange(5), rng.randrange(10**7) * 1000, k, rng.random()) for k in range(600)]
    events = spark.createDataFrame(rows, "key long, us long, event_id long, value double").select(
        "key", F.timestamp_micros("us").alias("ts"), "event_id", "value"
    )
    marker = spark.sql("select cast(null as bigint) key, timestamp'2200-01-01' ts, cast(null as bigint) event_id, cast(null as double) value")
    run = lambda s: changes.debounce_changes(s, 20_000, LATE)
    got = changes.drained(events, run, "ts", str(tmp_path / "saves"), pieces, marker).filter("key is not null")
    stream = got.select("key", F.unix_micros("first_ts"), F.unix_micros("saved_from"), "changes", "value")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, changes.bursts(events, 20_000).collect()))
    run = lambda s: changes.expire_idle(s, 60_000, LATE)
    gone = changes.drained(events, run, "ts", str(tmp_path / "gone"), pieces, marker).filter("key is not null")
    lives = gone.select("key", F.unix_micros("first_ts"), F.unix_micros("expires_at"), "writes")
    assert sorted(map(tuple, lives.collect())) == sorted(map(tuple, changes.expired(events, 60_000).collect()))


def test_a_stream_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "file string, pos long, ts timestamp")
    got = changes.drained(none, lambda s: changes.progress_stream(s, LATE), "ts", str(tmp_path / "none"))
    assert got.count() == 0
