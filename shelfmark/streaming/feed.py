"""The change feed as a stream: micro-batches of events appended to a catalog's log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.changes import SCHEMA
from shelfmark.operators.log import ChangeLog

INTERVAL = "500 milliseconds"
#: Batches after which the log is merged into its base.
COMPACT_EVERY = 50


def changes_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Change events as they arrive as parquet files in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def follow(changes: DataFrame, log: ChangeLog, checkpoint: str, exclusions: list[str] | None = None, on_commit: Callable[[int], None] | None = None, once: bool = False, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Append a stream of changes to a log; a batch writes the facts of the paths it names.

    A batch that is run again after a failure replaces itself, and facts of a batch that a compaction has taken in change
    nothing when they come once more. Events that arrive while a scan runs stay in the source and are merged afterwards.
    """

    def commit(batch: DataFrame, number: int) -> None:
        log.append(batch, number, exclusions)
        if compact_every and number % compact_every == compact_every - 1:
            log.compact()
        if on_commit is not None:
            on_commit(number)

    writer = changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)
    return writer.start()
