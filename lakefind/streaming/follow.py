"""Incremental sync as a streaming query.

The stream's source is the log of the versioned table: each commit is one new
file.  A micro-batch says only that there are commits; what has to be done is
worked out from the index's own watermark, so a batch that is run again after a
failure does nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def follow(index, *, available_now: bool, interval: str, segment_size: int | None) -> StreamingQuery:
    """Start a query that pulls the source's new versions into the index."""
    source = index.source
    if source is None:
        from ..errors import TableError

        raise TableError(f"index '{index.name}' has no source table")
    commits = index.spark.readStream.format("text").option("pathGlobFilter", "*.json").load(f"{source.path}/log")

    def pull(batch: DataFrame, number: int) -> None:
        index.sync(once=True, segment_size=segment_size)

    writer = commits.writeStream.foreachBatch(pull).option("checkpointLocation", f"{index.engine.data_dir}/{index.name}/stream")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
