"""The state of documents as a stream: what happens to them goes in, changes of their state come out.

A document is queued, indexing, ready or in error. Events come in any number of files, from any
number of writers; the state of each document is kept by the stream, so that a restart goes on from
its checkpoint. A document that is queued or indexing and of which nothing is heard for `patience`
is in error until it is heard of again. Time is that of the events: the watermark that sets off
the timers moves with the latest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import put_entries

EVENTS = "doc_id string, event string, message string, chunks int, at timestamp"
CHANGES = "doc_id string, status string, message string, progress string, chunks int, at timestamp"
QUEUED, INDEXING, READY, ERROR = "queued", "indexing", "ready", "error"
#: The state after each event, and the states that it may come in; in others it is late and counts for nothing.
STEPS = {
    "queued": (QUEUED, ("", READY, ERROR, QUEUED)),
    "started": (INDEXING, ("", QUEUED, ERROR)),
    "progress": (INDEXING, (INDEXING, ERROR)),
    "finished": (READY, (INDEXING, ERROR)),
    "failed": (ERROR, (QUEUED, INDEXING)),
}
STUCK = "nothing was heard of it for too long"


def step(status: str, event: str) -> str | None:
    """The state after an event, None if the event doesn't count."""
    after, before = STEPS.get(event, (None, ()))
    return after if status in before else None


def changes(events: DataFrame, patience_s: int = 3600, late: str = "1 minute") -> DataFrame:
    """CHANGES of a stream of EVENTS, in the order in which each document's events happened within a batch."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("", 0)
        out = []
        if state.hasTimedOut:
            if status in (QUEUED, INDEXING):
                out.append((key[0], ERROR, STUCK, "", None, pd.Timestamp(last + patience_s * 1000, unit="ms")))
                state.update((ERROR, last))
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for r in rows.itertuples(index=False):
                after = step(status, r.event)
                if after is None:
                    continue
                message = "" if pd.isna(r.message) else r.message
                chunks = None if pd.isna(r.chunks) else int(r.chunks)
                out.append((key[0], after, message if after == ERROR else "", message if after == INDEXING else "", chunks, r.at))
                status, last = after, int(r.at.value // 1_000_000)
            state.update((status, last))
            if status in (QUEUED, INDEXING):
                # a timer may not lie before the watermark
                state.setTimeoutTimestamp(max(last + patience_s * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "status", "message", "progress", "chunks", "at"]).astype({"chunks": "Int32"})

    known = events.where("doc_id is not null and at is not null").withWatermark("at", late)
    return known.groupBy("doc_id").applyInPandasWithState(follow, CHANGES, "status string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def follow_events(spark: SparkSession, folder: str, registry: str, checkpoint: str, patience_s: int = 3600, late: str = "1 minute") -> StreamingQuery:
    """Take up the events in the JSON lines files of `folder` that are new, add the latest change of each document to the registry, then stop."""

    def put(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("doc_id").agg(F.max(F.struct("at", "status", "message", "progress")).alias("x"), F.max("chunks").alias("chunks"))
        put_entries(newest.select("doc_id", "x.status", "x.message", "x.progress", "chunks"), registry)

    rows = spark.readStream.schema(EVENTS).json(folder)
    return changes(rows, patience_s, late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
