"""What running streams took in, batch by batch."""

from __future__ import annotations

import time
from collections import deque
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

PROGRESS_DDL = (
    "query string, batch_id bigint, input_rows bigint, state_rows bigint, dropped_late bigint, "
    "duration_ms bigint, watermark string"
)


class ProgressLog(StreamingQueryListener):
    """Counters of each batch of all queries of a session; the newest `keep` batches stay."""

    def __init__(self, keep: int = 10_000):
        self._rows: deque[tuple] = deque(maxlen=keep)
        self._lock = Lock()
        self.started = self.ended = self.failed = 0

    def onQueryStarted(self, event) -> None:
        self.started += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators),
               sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
               p.durationMs.get("triggerExecution"), p.eventTime.get("watermark"))
        with self._lock:
            self._rows.append(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
        self.failed += event.exception is not None

    def wait(self, spark: SparkSession, query: str, seconds: float = 60) -> DataFrame:
        """The batches of a query that ran to its end, whose events come a little after it."""
        until = time.monotonic() + seconds
        while not self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.table(spark, query)

    def table(self, spark: SparkSession, query: str | None = None) -> DataFrame:
        """A row per batch, of one query or of all."""
        with self._lock:
            rows = [r for r in self._rows if query in (None, r[0])]
        return spark.createDataFrame(rows, PROGRESS_DDL)


def files_taken(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Logs the files each batch took from a file stream, with their bytes and rows."""
    named = stream.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite") \
            .parquet(f"{path}/batch_id={batch_id}")

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
