"""Change bursts, expiry and progress, as streams and as batch twins of the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.scans import last_before, running_sum

C = F.col

# Quiet time after which a change is saved, idle time after which parts are
# removed, and bytes per progress step (as a shift).
DEBOUNCE_MS = 32
IDLE_MS = 60_000
STEP_SHIFT = 18


def debounce_changes(events: DataFrame, gap_ms: int = DEBOUNCE_MS, late: str = "10 minutes") -> DataFrame:
    """One save per burst of a key's changes, with the last content. For streams (append mode).

    ``events``: key, ts (TIMESTAMP), event_id, value. Later than the watermark is dropped.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy("key", F.session_window("ts", f"{gap_ms} milliseconds").alias("burst"))
        .agg(
            F.count("*").alias("changes"),
            F.max("ts").alias("saved_from"),
            F.max_by("value", F.struct("ts", "event_id")).alias("value"),
        )
        .select("key", C("burst.start").alias("first_ts"), "saved_from", "changes", "value")
    )


def _micros(ts: str):
    return F.unix_micros(C(ts).cast("timestamp"))


def bursts(events: DataFrame, gap_ms: int) -> DataFrame:
    """(key, first_us, last_us, changes, value): batch twin of session windows.

    Events of one key within one gap-long slot always share a burst, so they are combined
    map-side first; the scan over slots then works block by block, whatever a key's share is.
    """
    gap = gap_ms * 1000
    us = _micros("ts")
    slots = (
        events.select("key", us.alias("us"), "event_id", "value")
        .groupBy("key", F.floor(C("us") / gap).alias("slot"))
        .agg(
            F.min("us").alias("lo"),
            F.max("us").alias("hi"),
            F.count("*").alias("n"),
            F.max(F.struct("us", "event_id", "value")).alias("v"),
        )
    )
    seen = last_before(slots, ["key"], "slot", C("hi"), "__prev", inclusive=False)
    fresh = F.when(C("__prev").isNull() | (C("lo") - C("__prev") > gap), 1).otherwise(0)
    marked = running_sum(seen, ["key"], "slot", fresh, "burst")
    return (
        marked.groupBy("key", "burst")
        .agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("changes"), F.max("v").alias("v"))
        .select("key", "first_us", "last_us", "changes", C("v.value").alias("value"))
    )


def expire_idle(writes: DataFrame, ttl_ms: int = IDLE_MS, late: str = "10 minutes") -> DataFrame:
    """(key, first_ts, expires_at, writes): when a bundle's parts are removed. For streams.

    Every write refreshes the bundle; after the idle time it goes with all its parts.
    """
    return (
        writes.withWatermark("ts", late)
        .groupBy("key", F.session_window("ts", f"{ttl_ms} milliseconds").alias("life"))
        .agg(F.count("*").alias("writes"))
        .select("key", C("life.start").alias("first_ts"), C("life.end").alias("expires_at"), "writes")
    )


def drained(
    rows: DataFrame, run, order: str, target: str, pieces: int = 4, marker: DataFrame | None = None
) -> DataFrame:
    """What a stream gives for a finished table: cut into batches, run to its end and read back.

    ``run`` makes the streaming result of a streaming DataFrame. The table is written in ``pieces`` files by ``order``, one
    to a batch; ``marker`` rows come in a batch of their own at the end, to move the watermark past all open groups. Results of a batch
    are written by its number, so a batch that is run again overwrites itself.
    """
    spark = rows.sparkSession
    rows.repartitionByRange(pieces, order).write.parquet(f"{target}/in")
    if marker is not None:
        marker.select(rows.columns).coalesce(1).write.mode("append").parquet(f"{target}/in")
    stream = run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/in"))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/out/epoch={epoch}")

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{target}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/out").select(stream.columns)


def expired(writes: DataFrame, ttl_ms: int = IDLE_MS) -> DataFrame:
    """Batch twin of ``expire_idle`` with times in microseconds."""
    return bursts(writes, ttl_ms).select(
        "key", "first_us", (C("last_us") + ttl_ms * 1000).alias("expires_us"), C("changes").alias("writes")
    )


def progress_stream(reads: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Once per file and 256 KiB boundary. ``reads``: file, pos after the read, ts."""
    stepped = reads.withColumn("step", F.shiftright("pos", STEP_SHIFT)).filter("step > 0")
    return stepped.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file", "step"])


def progress_buckets(reads: DataFrame) -> DataFrame:
    """(file, read_no, pos, step, progress) of reads that cross a boundary. Batch.

    ``reads``: file, read_no (unique per file), length.
    """
    sizes = reads.groupBy("file").agg(F.sum("length").alias("size"))
    rows = running_sum(reads, ["file"], "read_no", C("length"), "pos")
    crossed = F.shiftright("pos", STEP_SHIFT) != F.shiftright(C("pos") - C("length"), STEP_SHIFT)
    return rows.filter(crossed).join(sizes, "file").select(
        "file", "read_no", "pos", F.shiftright("pos", STEP_SHIFT).alias("step"),
        (C("pos") / C("size")).alias("progress"),
    )
