"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import work_dir

#: Fixed value: what separates words, by the contract of the text operators.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Whole texts go to Python in batches of few rows, so that a task holds little at a time.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has, capitals or not."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written once below the shared folder and read again: what several later steps need."""
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> pa.Array:
    """Texts with null as the empty one."""
    return column.fill_null("")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row limits (one more than rows), without a copy."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, limits, data = column.buffers()
    limits = np.frombuffer(limits, "<i8")[column.offset:column.offset + len(column) + 1] \
        if limits else np.zeros(1, "<i8")
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    start = int(limits[0])
    return whole[start:int(limits[-1])], limits - start


def in_chunks(
    batches: Iterable[pa.RecordBatch], max_bytes: int, text: str = "text",
    max_rows: int = 50_000,
) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut between rows, to about max_bytes of text (one row at least) and
    max_rows rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, limits = utf8(texts_of(batch.column(text)))
        first = 0
        while first < batch.num_rows:
            room = max_bytes - size
            last = int(np.searchsorted(limits, limits[first] + max(room, 0), "right")) - 1
            last = min(max(last, first + 1 if not held else first), batch.num_rows)
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(limits[last] - limits[first])
            if last < batch.num_rows or size >= max_bytes \
                    or sum(b.num_rows for b in held) >= max_rows:
                yield _one(held)
                held, size = [], 0
            first = last
    if held:
        yield _one(held)
    held.clear()
    release()


def release() -> None:
    """Gives memory that a task has freed back to the system: a Python worker lives on, idle or with
    another stage's tasks, while the executor needs the room elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]
