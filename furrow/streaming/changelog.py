"""A keyed table kept as a log of changes.

Each micro-batch writes only the rows it changed, into a folder named by its batch id. A batch that
is run again after a failure overwrites its own folder, so replays leave no trace. The current table
is the log reduced to the newest row per key; `compact` writes that down and the log before it is no
longer read. Nothing is ever overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.events import keep_latest


class ChangeLog:
    """`version` names the columns that say which row of a key is the newest: those of the row,
    then the batch. With `merge`, rows of a key are merged by that function instead (it keeps the
    greatest batch_id). The log is compacted after each `compact_every` batches (0: never)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str,
                 version: list[str] | None = None, compact_every: int = 16,
                 merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = keys
        self.schema = schema
        self.version = F.struct(*(version or []), "batch_id")
        self.compact_every = compact_every
        self.merge = merge

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        if self.compact_every and (batch_id + 1) % self.compact_every == 0:
            self.compact()

    def _fs(self, pattern: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        """Numbers in the names of a kind's complete folders, ascending; one listing."""
        fs, pattern = self._fs(f"{kind}/*/_SUCCESS")
        names = [found.getPath().getParent().getName() for found in fs.globStatus(pattern) or []]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _base(self, before: int | None) -> int:
        """Batch of the newest complete snapshot, -1 without one."""
        return max((n for n in self._numbers("snapshots") if before is None or n < before),
                   default=-1)

    def _remove(self, kind: str, name: str, numbers: list[int]) -> None:
        for n in numbers:
            fs, path = self._fs(f"{kind}/{name}={n}")
            fs.delete(path, True)

    def rows(self, before: int | None = None) -> DataFrame:
        """The snapshot and all rows logged after it, with their batch id.

        `before` leaves out that batch and later ones, which makes a replay see what the first
        run saw.
        """
        base = self._base(before)
        batches = [
            n for n in self._numbers("changes")
            if n > base and (before is None or n < before)
        ]
        reader = self.spark.read.schema(f"{self.schema}, batch_id bigint")
        parts = []
        if base >= 0:
            parts.append(reader.parquet(f"{self.path}/snapshots/upto={base}"))
        if batches:
            # the folder name gives batch_id
            parts.append(reader.option("basePath", f"{self.path}/changes").parquet(
                *[f"{self.path}/changes/batch_id={n}" for n in batches]))
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, batch_id bigint")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _newest(self, before: int | None = None) -> DataFrame:
        rows = self.rows(before)
        return self.merge(rows) if self.merge else keep_latest(rows, self.keys, self.version)

    def current(self, before: int | None = None) -> DataFrame:
        """Newest row per key."""
        return self._newest(before).drop("batch_id")

    def compact(self) -> None:
        """A snapshot of the table as it is; what the snapshot before it replaced is removed.

        A batch that is run again sees the log before it, so the last snapshot and what was logged
        since are kept until there is a newer one.
        """
        batches, old = self._numbers("changes"), self._base(None)
        if batches and batches[-1] > old:
            self._newest().write.mode("overwrite").parquet(
                f"{self.path}/snapshots/upto={batches[-1]}")
            self._remove("changes", "batch_id", [n for n in batches if n <= old])
            self._remove("snapshots", "upto", [n for n in self._numbers("snapshots") if n < old])
