"""Incremental loads as a stream: each micro-batch replaces the years it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import tables


def replace_years(stream: DataFrame, path: str, checkpoint: str, key: str = "year", once: bool = False) -> StreamingQuery:
    """Within a batch the rows of a year stand as they are; a later batch with that year takes its place.

    Replacing a partition is idempotent, so a batch that is run again after a failure does no harm.
    ``once``: what is there now, then the query ends.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: tables.write_years(batch, path, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
