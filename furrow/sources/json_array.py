"""Files that hold one JSON array each, read in splits.

A split may begin anywhere: inside a string, deep in an object. Spark's text source cuts the files
at closing braces, so a split is a run of pieces, and an escape (a backslash and what follows it)
never lies across two of them. Then

1. each split gives its effect: whether it holds an odd number of quotes, and by how much it changes
   the nesting if it begins outside or inside a string;
2. effects are put together along a file, a row per split, which tells how each split begins;
3. each split cuts its own elements; what its borders cut gives fragments, joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow import session

SPLIT_BYTES = 64 << 20
#: Splits whose beginnings are sent to every task; with more, pieces are shuffled to them.
MAX_BROADCAST_SPLITS = 1_000_000

_EFFECT = "file long, start long, odd int, outside long, inside long"
_PART = "file long, start long, fragment boolean, begins boolean, value string"


def _structure(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of quotes that open or close a string; of all brackets and braces the place, the step
    in nesting, and whether the number of quotes before it is odd."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == ord('"'))
    slashes = np.flatnonzero(b == ord("\\"))
    if len(slashes):
        apart = np.diff(slashes) > 1
        first, last = slashes[np.append(True, apart)], slashes[np.append(apart, True)]
        quotes = np.setdiff1d(quotes, last[(last - first) % 2 == 0] + 1, assume_unique=True)
    opens = (b == ord("{")) | (b == ord("["))
    places = np.flatnonzero(opens | (b == ord("}")) | (b == ord("]")))
    return len(quotes), places, np.where(opens[places], 1, -1), np.searchsorted(quotes, places) & 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """Text of neighbouring pieces, each with its brace, and what all of them have in common: file
    and start, then how the split begins where that is known."""
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        new = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            if a < b:
                pieces = batch.column("value").slice(a, b - a).cast(pa.binary()).to_pylist()
                yield tuple(int(k[a]) for k in keys), b"}".join(pieces) + b"}"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list[int]] = {}
    for key, data in _chunks(batches):
        effect = found.setdefault(key, [0, 0, 0])
        n, _, steps, odd = _structure(data)
        for begun in (0, 1):
            effect[1 + begun] += int(steps[(odd + effect[0] + begun) % 2 == 0].sum())
        effect[0] = (effect[0] + n) % 2
    rows = [(*key, *effect) for key, effect in found.items()]
    names = [c.split()[0] for c in _EFFECT.split(", ")]
    yield pa.RecordBatch.from_pylist(
        [dict(zip(names, r)) for r in rows],
        schema=pa.schema([(c, pa.int32() if c == "odd" else pa.int64()) for c in names]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole elements and fragments. An element lies at depth 2, the array's own being 1."""
    split, open_, began, inside, depth = None, [], False, 0, 0
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _PART.split(", ")])
        rows.clear()
        return out

    for key, data in _chunks(batches):
        if key[:2] != split:
            if open_:
                rows.append((*split, True, began, b"".join(open_).decode()))
            split, inside, depth = key[:2], key[2], key[3]
            open_, began = [], False
        n, places, steps, odd = _structure(data)
        outside = (odd + inside) % 2 == 0
        places, steps = places[outside], steps[outside]
        depths = depth + np.cumsum(steps)
        starts = places[(steps == 1) & (depths == 2)].tolist()
        ends = (places[(steps == -1) & (depths == 1)] + 1).tolist()
        if depth >= 2:
            end = ends.pop(0) if ends else None
            open_.append(data[:end])
            if end is not None:
                rows.append((*split, not began, began, b"".join(open_).decode()))
                open_ = []
        for a, b in zip(starts, ends):
            rows.append((*split, False, True, data[a:b].decode()))
        if len(starts) > len(ends):
            open_, began = [data[starts[-1]:]], True
        inside = (inside + n) % 2
        depth = int(depths[-1]) if len(depths) else depth
        yield flush()
    if open_:
        rows.append((*split, True, began, b"".join(open_).decode()))
    yield flush()


def _beginnings(effects: DataFrame) -> DataFrame:
    """How each split begins: file, start, in_string, depth, and how it leaves off."""
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    told = effects.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    told = told.withColumn("step", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
    return told.select(
        "file", "start", "in_string", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
        ((F.col("in_string") + F.col("odd")) % 2).alias("left_in"), F.sum("step").over(along).alias("left_at"),
        F.lead("start").over(along).isNull().alias("last"))


def elements(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES,
             max_broadcast: int = MAX_BROADCAST_SPLITS) -> DataFrame:
    """`value`: the elements of the arrays in the files at `path`, each as JSON text.

    Elements are objects; numbers and texts that stand in the array by themselves are left out. An
    empty array or file has none. A file whose quotes or brackets don't balance raises an error. The
    texts are cut when the function is called and kept below the shared folder; both passes over the
    files see the same splits, whatever executors there are. A text between two closing braces has to
    be below 2 GB. Files are told apart by a hash of 64 bits.
    """
    with session.settings(spark, {"spark.sql.files.maxPartitionBytes": f"{split_bytes}b",
                                  "spark.sql.files.minPartitionNum": "1"}):
        pieces = spark.read.option("lineSep", "}").text(path).select(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"), "value")
        splits, n = session.counted(_beginnings(pieces.mapInArrow(_effects, _EFFECT)), max_broadcast)
        # the text after the last brace of a file was given one as well
        broken = splits.filter("last AND (left_in <> 0 OR left_at <> -1)").count()
        if broken:
            raise ValueError(f"{broken} files at {path} hold no whole JSON array")
        told = splits.select("file", "start", "in_string", "depth")
        names = ["file", "start", "in_string", "depth", "value"]
        if n <= max_broadcast:
            begun = pieces.join(F.broadcast(told), ["file", "start"]).select(*names)
        else:
            begun = pieces.withColumn("place", F.monotonically_increasing_id()).join(told, ["file", "start"]) \
                .repartition("file", "start").sortWithinPartitions("file", "start", "place").select(*names)
        out = session.work_dir(spark, "array-parts")
        begun.mapInArrow(_cut, _PART).write.partitionBy("fragment").parquet(out)
    parts = spark.read.schema(_PART).parquet(out)
    along = Window.partitionBy("file").orderBy("start", "begins").rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.filter("fragment").withColumn("n", F.sum(F.col("begins").cast("int")).over(along)) \
        .groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "begins", "value"))).alias("of")) \
        .select(F.array_join("of.value", "").alias("value"))
    return parts.filter("NOT fragment").select("value").unionByName(joined)


def write(texts: DataFrame, path: str) -> None:
    """Array files out of `value`, a JSON text per element: a file per partition."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = []
            for value in batch.column("value").to_pylist():
                lines.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if lead == "[" else "]"]})

    texts.select("value").mapInArrow(arrays, "value string").write.mode("overwrite").text(path)
