"""The progress feed as a stream: offsets instead of wall-clock cursors, so that no late event is lost."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """job_events as they are appended to a folder; the schema is the folder's."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    single = os.path.isfile(path)  # a stream reads folders: one file is picked from its own
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.option("pathGlobFilter", name).parquet(folder) if single else stream.option("pathGlobFilter", "*.parquet").parquet(path)


def deduplicated(events: DataFrame) -> DataFrame:
    """Repeated deliveries dropped, however late they are and in whatever order files come.

    No watermark, as that would drop late first deliveries too: the state holds the key of every event so far.
    """
    return events.dropDuplicates(["project_id", "chapter_id", "para_id", "level_name", "message", "event_at"])


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that is there now, appended as parquet."""
    q: StreamingQuery = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


class Stopped(Exception):
    """A batch that was not begun, since the run is to stop."""


def commit_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, stopped: Callable[[], bool] = lambda: False) -> bool:
    """Calls write(batch, batch_id) for each batch that is there now; False if the run was stopped before the last.

    ``stopped`` is asked before each batch: a batch that has begun is finished and committed, and
    one that has not is the first of the next run.
    """

    def guarded(batch: DataFrame, batch_id: int) -> None:
        if stopped():
            raise Stopped
        write(batch, batch_id)

    query: StreamingQuery = df.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped():
            raise
        return False
    return True
