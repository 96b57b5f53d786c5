"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of its pieces'
squared lengths). A piece's demands follow from its length alone, so the number of pieces of each
length, at most `tokens` numbers, is all that a plan needs. The plan is made over sequences in
bulk: those with equal residuals are one state. Lengths come in falling order; among the states
that can take a piece under every capacity, the one with the best score takes pieces of that
length until it can hold no more, then the next; new sequences open only when no state fits. The
score is the smallest weighted norm of what is left (`norm`), or the largest weighted product of
residual and demand (`dot`); a capacity weighs as much as the corpus as a whole demands of it.

The work on documents is Spark's: pieces are cut and numbered where their text lies, and each
number's sequence is looked up in the plan.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import bpe, common

PIECE_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
             "task int, nth long")
PLACED_DDL = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")
#: Text bytes encoded at a time.
CHUNK_BYTES = 8 << 20


@dataclasses.dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def of(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.float64)

    def fits(self, length: int) -> bool:
        return length <= self.tokens and self.documents >= 1 and length * length <= self.attention


@dataclasses.dataclass(frozen=True)
class Run:
    """Pieces `first`.. of a length go to as many successive sequences, at one offset."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: Capacity, score: str = "norm") -> list[Run]:
    """Where the pieces of each length go; their numbers run from 0 within a length."""
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    demand = sum((capacity.of(x) * n for x, n in counts.items()), np.zeros(3)) / limits
    weights = demand / max(demand.sum(), 1e-12)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    runs: list[Run] = []
    sequences = 0

    def room(state: tuple[int, int, int], length: int) -> int:
        return min(state[0] // length, state[1], state[2] // (length * length))

    def key(state: tuple[int, int, int], length: int) -> float:
        left, item = np.array(state) / limits, capacity.of(length) / limits
        if score == "dot":
            return -float((weights * left * item).sum())
        return float((weights * (left - item) ** 2).sum())

    def fill(state: tuple[int, int, int], first_sequence: int, bins: int, each: int, length: int,
             number: int) -> None:
        """`each` pieces into each of `bins` sequences of a state."""
        used = capacity.tokens - state[0]
        for k in range(each):
            runs.append(Run(length, number + k * bins, bins, first_sequence, used + k * length))
        rest = (state[0] - each * length, state[1] - each, state[2] - each * length * length)
        if rest[0] > 0 and rest[1] > 0 and rest[2] > 0:
            open_[rest].append((first_sequence, bins))

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        states = sorted((s for s in open_ if room(s, length)), key=lambda s: (key(s, length), s))
        for state in states:
            each, parts = room(state, length), open_.pop(state)
            while parts and left:
                first_sequence, bins = parts.pop()
                full = min(bins, left // each)
                if full:
                    fill(state, first_sequence, full, each, length, number)
                    number, left = number + full * each, left - full * each
                if full < bins and left:  # fewer pieces than one sequence could take
                    fill(state, first_sequence + full, 1, left, length, number)
                    number, left, full = number + left, 0, full + 1
                if full < bins:
                    parts.append((first_sequence + full, bins - full))
            if parts:
                open_[state].extend(parts)
            if not left:
                break
        if left:
            empty = (capacity.tokens, capacity.documents, capacity.attention)
            each = room(empty, length)
            for bins, n in ((left // each, each), (1, left % each)):
                if bins and n:
                    fill(empty, sequences, bins, n, length, number)
                    sequences, number = sequences + bins, number + bins * n
    return runs


def cut(
    docs: DataFrame, tokenizer: str, end: int, capacity: Capacity,
    id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
    max_words: int = bpe.MAX_WORDS,
) -> DataFrame:
    """Documents as pieces of at most `capacity.tokens`, the first of a long one the shorter.

    `nth` counts the pieces of equal length of a task; with `task` it numbers them without moving
    a row. A worker encodes some chunk_bytes of text at a time and remembers max_words words in each
    of the encoder's generations: both weigh memory against time, the pieces are the same.
    """
    most = capacity.tokens
    if not capacity.fits(most):
        raise ValueError("a piece of full length must fit into an empty sequence")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        codec = bpe.encoder(tokenizer, max_words)
        for batch in common.in_chunks(batches, chunk_bytes):
            ids, lengths = bpe.with_end(
                *codec.encode(common.texts_of(batch.column("text"))), end)
            many = -(-lengths // most)
            doc = np.repeat(np.arange(len(lengths)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            head = lengths - (many - 1) * most
            size = np.where(piece == 0, head[doc], most)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * most)
            begin = start + (np.cumsum(lengths) - lengths)[doc]
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * b])
                   for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
            order = np.argsort(size, kind="stable")
            n = np.bincount(size, minlength=most + 1)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(np.cumsum(n) - n, n) \
                + np.repeat(seen, n)
            seen += n
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth),
            ], names=[c.split()[0] for c in PIECE_DDL.split(", ")])

    return docs.select(
        common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).alias("text"),
    ).mapInArrow(pieces, PIECE_DDL)


def place(pieces: DataFrame, capacity: Capacity, score: str = "norm") -> DataFrame:
    """A sequence and an offset for each stored piece. To the driver go counts per length only."""
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(counts, capacity, score), key=lambda r: (r.length, r.first))
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(
        np.array([dataclasses.astuple(r) for r in runs], np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")).select(
        "task", "length",
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    span = capacity.tokens + 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # one rising key for (length, number of the piece)
        wide = 1 + (int(table[:, 1].max()) + int(table[:, 2].max()) if len(table) else 0)
        if wide * span >= 1 << 62:
            raise OverflowError("too many pieces for one plan")
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            number = batch.column("number").to_numpy()
            length = batch.column("length").to_numpy()
            at = np.searchsorted(keys, length * wide + number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(table[at, 3] + number - table[at, 1]), pa.array(table[at, 4])],
                names=[c.split()[0] for c in PLACED_DDL.split(", ")])

    return pieces.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.col("nth")).alias("number")).mapInArrow(look_up, PLACED_DDL)


def pack(
    docs: DataFrame, tokenizer: str, end: int, capacity: Capacity = Capacity(),
    score: str = "norm", id_col: str = "doc_id", text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES, max_words: int = bpe.MAX_WORDS,
) -> DataFrame:
    """One row per piece: its span in the document, its sequence, its offset there.

    A null text counts as empty: its one piece is the end id. Repeated documents are packed as
    often as they occur; null ids stay null. Other columns are ignored. Sequences are filled
    without gaps from offset 0; an empty table has none. Which of several pieces of equal length
    gets which place is open.
    """
    pieces = cut(docs, tokenizer, end, capacity, id_col, text_col, chunk_bytes, max_words)
    return place(common.stored(pieces, "pieces"), capacity, score)
