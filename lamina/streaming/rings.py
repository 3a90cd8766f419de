"""Stateful streams: the ring of recent versions and the growing tile dictionary."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lamina.operators.tiles import chop_rasters, merge_dictionaries, tile_dictionary
from lamina.session import staging_dir

C = F.col
_OUT = "user long, slot int, ts_us long, session long, doc_hash string, id string"


def replay(ring: list[tuple], last: dict[str, str], saves, keep: int) -> list[tuple]:
    """The ring (ts, session, doc, id) after ``saves`` in order; ``last`` maps "session/doc" to the version saved last."""
    for ts, session, doc, version, entries in saves:
        owner = f"{session}/{doc}"
        if owner not in last and not entries:
            continue
        gone = {version, last.get(owner)}
        ring = [v for v in ring if v[2] != doc or v[3] not in gone]
        ring = sorted([*ring, (ts, session, doc, version)])[-keep:]
        last[owner] = version
    return ring


def stream_recent_versions(saves: DataFrame, keep: int = 8) -> DataFrame:
    """The newest ``keep`` stored versions per user after every batch (update mode).

    ``saves``: user, session, ts_us, doc_hash, id, entries, arriving in order of time. A save stores its
    version anew and takes away the one that its session saved before; an empty first save is not
    stored. Saves are replayed one by one, so the result doesn't depend on where batches are
    cut. The state of a user is the ring and the last version of each of their sessions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"ring": [], "last": {}}
        rows = pd.concat(list(batches)).sort_values(["ts_us", "id", "session"])
        columns = ("ts_us", "session", "doc_hash", "id", "entries")
        saved = zip(*(rows[c].tolist() for c in columns), strict=True)
        ring = replay([tuple(v) for v in held["ring"]], held["last"], saved, keep)
        state.update((json.dumps({"ring": ring, "last": held["last"]}),))
        out = [(key[0], slot, *v) for slot, v in enumerate(ring)]
        yield pd.DataFrame(out, columns=["user", "slot", "ts_us", "session", "doc_hash", "id"])

    return saves.groupBy("user").applyInPandasWithState(
        step, _OUT, "ring string", "update", GroupStateTimeout.NoTimeout
    )


def stream_tiles(rasters: DataFrame, target: str, key: str = "md5"):
    """Start a query that keeps the tile dictionary of a stream of pictures under ``target``.

    Each batch is chopped without state, reduced to its own dictionary and written as one more
    delta, named by batch so that a replay overwrites itself. ``read_dictionary`` merges deltas;
    numbering and packing run once at the end.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        tile_dictionary(chop_rasters(batch, key)).write.mode("overwrite").parquet(f"{target}/delta={epoch}")

    spark = rasters.sparkSession
    return (
        rasters.writeStream.foreachBatch(add)
        .option("checkpointLocation", f"{staging_dir(spark)}/lamina/stream-{uuid.uuid4().hex}")
        .trigger(availableNow=True)
        .start()
    )


def read_dictionary(spark, target: str) -> DataFrame:
    """All deltas merged: smallest position and total uses per tile."""
    deltas = spark.read.parquet(target).drop("delta")
    return merge_dictionaries(deltas, deltas.filter("false"))
