"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

A file set is a Parquet folder whose rows are blocks of whole documents. Within a block each id is
replaced by its rank among the block's ids by frequency (0: the most frequent; ties by id), and
ranks are written in as few whole bytes as they need. The lengths, two bits each (0: one byte, 3:
four bytes), stand apart in `control`, four to a byte from the low bits up; `data` holds the bytes,
low byte first. A reader looks up four lengths per control byte in a table, sums them to places,
and gathers: no loop over ids. Every block carries its own table of ranks, so one pass over the
corpus writes it, blocks can be read alone, and a lost task writes its own blocks again only.

Blocks, and documents within them, are in ascending order of the document's id (then of the text's
hash; null ids first): `shard` counts the ranges, `block_start` the ids before the block in its
shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm import bpe, common

BLOCK_DDL = ("shard int, block int, block_start long, n_ids long, doc_ids array<long>, "
             "lengths array<long>, ranks binary, control binary, data binary")
DOC_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"
IDS_DDL = "doc_id long, start long, ids array<long>"

#: Text bytes that make a block: some 2 million ids.
BLOCK_BYTES = 6 << 20

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    codes = ((values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF))
    ends = np.cumsum(codes + np.int64(1))
    places = ends - codes - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[places] = values & 0xFF
    for more in (1, 2, 3):
        wide = np.flatnonzero(codes >= more)
        if not len(wide):
            break
        data[places[wide] + more] = values[wide] >> np.uint32(8 * more) & 0xFF
    quads = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    quads[:len(values)] = codes
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again, by table lookup and one gather."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(bytes(data) + b"\0\0\0", np.uint8)
    words = np.ndarray(max(len(padded) - 3, 0), "<u4", padded.data, strides=(1,))
    return words[places] & _MASKS[lengths] if n else np.zeros(0, np.uint32)


def rank(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling frequency, and each id's rank in that list."""
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    places = np.zeros(len(counts), np.uint32)
    places[order] = np.arange(len(order))
    return order.astype(np.uint32), places[ids]


def write(
    docs: DataFrame, path: str, tokenizer: str, end: int = 0, id_col: str = "doc_id",
    text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> None:
    """Encode all texts into a file set at `path`.

    A null text counts as empty: its document holds the end id alone. Repeated ids and texts are
    kept row for row; a null document id stays null. An empty table gives an empty file set. Other
    columns are ignored. A document is never cut: one longer than a block is a block of its own.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        codec = bpe.encoder(tokenizer)
        for n, batch in enumerate(common.in_chunks(batches, block_bytes)):
            ids, lengths = bpe.with_end(
                *codec.encode(common.texts_of(batch.column("text"))), end)
            table, ranks = rank(ids)
            control, data = pack(ranks)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([n], pa.int32()), pa.array([before]),
                pa.array([len(ids)]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([lengths.tolist()], pa.list_(pa.int64())),
                *(pa.array([x], pa.binary()) for x in (table.astype("<u4").tobytes(), control, data)),
            ], names=[c.split()[0] for c in BLOCK_DDL.split(", ")])
            before += len(ids)

    narrow = docs.select(
        common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).alias("text"),
        F.xxhash64(common.col(text_col)).alias("tie"))
    (narrow.repartitionByRange(shards or common.partitions(spark), "doc_id", "tie")
     .sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
     .mapInArrow(encode, BLOCK_DDL)
     # ranks don't repeat as text does: page compression gains nothing on these bytes
     .write.option("compression", "uncompressed").parquet(path))


def _bases(blocks: DataFrame) -> DataFrame:
    """Ids before each shard: one row per shard, so the window over all of them is small."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "shard", F.coalesce(F.sum("total").over(before), F.lit(0).cast("long")).alias("base"))


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """Per block: document ids, lengths, all ids, ids before the block."""
    for row in batch.select(
            ["doc_ids", "lengths", "ranks", "control", "data", "n_ids", "block_start", "base"]).to_pylist():
        values = unpack(row["control"], row["data"], row["n_ids"])
        ids = np.frombuffer(row["ranks"], "<u4")[values]
        yield (row["doc_ids"], np.array(row["lengths"], np.int64), ids,
               row["block_start"] + row["base"])


def _read(spark: SparkSession, path: str, per_block, ddl: str) -> DataFrame:
    blocks = spark.read.schema(BLOCK_DDL).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for block in _decoded(batch.slice(i, 1)):
                    yield per_block(*block)

    # a row per shard: no more than the writer's partitions
    return blocks.join(F.broadcast(_bases(blocks)), "shard").mapInArrow(decode, ddl)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids, with the number of ids of all documents before it."""
    def rows(doc_ids, lengths, ids, before):
        ends = np.cumsum(lengths)
        return pa.RecordBatch.from_arrays([
            pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths),
            pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32),
                                     pa.array(ids.astype(np.int64))),
        ], names=["doc_id", "start", "ids"])

    return _read(spark, path, rows, IDS_DDL)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document's place, length and checksum, from the decoded ids."""
    def rows(doc_ids, lengths, ids, before):
        ends = np.cumsum(lengths)
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b])
               for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths),
            pa.array(lengths), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(spark, path, rows, DOC_DDL)
