"""A folder of chunk files as a stream into the index, one partition per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import CHUNK_SCHEMA, index_rows, write_index


def ingest(spark: SparkSession, folder: str, index: str, state: str, encode: Callable[[Column], Column]) -> StreamingQuery:
    """Index every new file of `folder` (JSON lines with doc_id), then stop; a rerun takes up what is new."""

    def put(batch: DataFrame, _: int) -> None:
        # one write: the partitions of the documents in it are replaced, others stay
        write_index(index_rows(batch, encode), index)

    rows = spark.readStream.schema("doc_id string, " + CHUNK_SCHEMA).json(folder)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
