"""Document fingerprints by one-permutation MinHash.

A text's shingle hashes are dealt once into 512 bins by their high bits; each bin keeps its
smallest remainder. Empty bins take the value of a filled one, each by a sequence of bins of its
own that is the same for all texts (optimal densification), so two texts fill a bin alike when
their donors are alike. Of each value the 4 lowest mixed bits are stored, two bins to a byte.
Different values agree in 4 bits once in 16 times; the likeness estimate takes that out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common, shingles

BINS = 512
BITS = 4
CHUNK_BYTES = 2 << 20
ROWS_AT_ONCE = 512

_EMPTY = np.uint64(2**64 - 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


#: For each bin, all bins in the order in which it asks them; and the place of each in that order.
_ASKED = np.argsort(shingles.mix(
    np.arange(BINS, dtype=np.uint64)[:, None] << np.uint64(32)
    | np.arange(1, BINS + 1, dtype=np.uint64)), axis=1).astype(np.int16)
_TURN = np.argsort(_ASKED, axis=1).astype(np.int16)
_OWN = shingles.mix(np.arange(1, BINS + 1, dtype=np.uint64))
#: With fewer filled bins than this, each empty bin looks for the first of them in its order.
_FEW = 64


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of bins per text; a text without shingles has empty bins only."""
    n = len(at) - 1
    out = np.full(n * BINS, _EMPTY)
    text = np.repeat(np.arange(n), np.diff(at))
    cell = text * BINS + (h >> _SHIFT).astype(np.int64)
    np.minimum.at(out, cell, h & ~(_EMPTY << _SHIFT))
    return out.reshape(n, BINS)


def densified(table: np.ndarray) -> np.ndarray:
    """Empty bins filled from the first filled one they ask; rows without any value stay empty."""
    filled = table != _EMPTY
    number = filled.sum(axis=1)
    out = table.copy()
    for row in np.flatnonzero((number > 0) & (number < _FEW)):
        some = np.flatnonzero(filled[row])
        donors = some[_TURN[:, some].argmin(axis=1)]
        out[row] = np.where(filled[row], table[row], table[row, donors])
    rows, bins = np.nonzero(~filled & (number >= _FEW)[:, None])
    attempt = 0
    while len(rows):
        donors = _ASKED[bins, attempt]
        good = filled[rows, donors]
        out[rows[good], bins[good]] = table[rows[good], donors[good]]
        rows, bins, attempt = rows[~good], bins[~good], attempt + 1
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """Packed low bits, a row of bytes per text; zeros for texts without words."""
    out = np.zeros((len(texts), BINS * BITS // 8), np.uint8)
    for a in range(0, len(texts), ROWS_AT_ONCE):
        part = pa.array(texts[a:a + ROWS_AT_ONCE], pa.string())
        h, at = shingles.shingle_hashes(*common.utf8(part))
        # one value in several bins leaves other bits in each
        low = (shingles.mix(densified(minima(h, at)) ^ _OWN) & np.uint64(15)).astype(np.uint8)
        low[np.diff(at) == 0] = 0
        out[a:a + len(low)] = low[:, 0::2] | low[:, 1::2] << 4
    return out


def likeness(x: np.ndarray, y: np.ndarray, x_some: np.ndarray, y_some: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles, row by row. Two texts without words are alike."""
    differ = x ^ y
    same = ((differ & 15 == 0).sum(axis=1) + (differ >> 4 == 0).sum(axis=1)) / BINS
    chance = 1 / (1 << BITS)
    estimate = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(x_some & y_some, estimate, np.where(x_some == y_some, 1.0, 0.0))


def decode(fingerprint: str) -> np.ndarray:
    """A fingerprint's bytes; none for a text without words."""
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8)


def _encoded(rows: np.ndarray, some: np.ndarray) -> list[str]:
    return [base64.b64encode(r.tobytes()).decode() if s else "" for r, s in zip(rows, some)]


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the next one's beginning."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def with_next(
    docs: DataFrame, compare: Callable[[list[int], list[str], list[str]], pa.RecordBatch], ddl: str,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`compare` over all documents with the texts of those that follow in descending id.

    Documents are dealt into ranges of ids of about equal numbers; each range also gets the first
    text of the range after it, so no other text is handed across. The last document is followed
    by the first; a single one follows itself. Null texts count as empty; null ids come last; rows
    with one id follow in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    narrow = docs.select(common.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(common.col(text_col), F.lit("")).alias("text"))
    bounds = np.unique(narrow.agg(F.percentile_approx(
        "doc_id", [k / n for k in range(1, n)] or [1.0], 100 * n)).first()[0] or [0])

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(np.int64)))

    dealt = narrow.withColumn("range", F.when(
        F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(
            range_of(F.coalesce("doc_id", F.lit(0).cast("long"))))).withColumn("after", F.lit(0))
    first_ids = dealt.groupBy("range").agg(F.max("doc_id").alias("first_id"))
    turn = Window.orderBy("range")
    # a row per range
    ranges = first_ids.withColumn("for_range", F.coalesce(
        F.lag("range").over(turn), F.max("range").over(Window.partitionBy())))
    heads = narrow.join(F.broadcast(first_ids.select("first_id").distinct()),
                        F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    tie = F.xxhash64("text")
    first_rows = heads.groupBy(F.col("doc_id").alias("head_id")).agg(
        F.min_by("text", F.struct(tie, "text")).alias("text"))
    last = ranges.join(first_rows, F.col("first_id").eqNullSafe(F.col("head_id"))).select(
        F.lit(None).cast("long").alias("doc_id"), "text", F.col("for_range").alias("range"),
        F.lit(1).alias("after"))
    ordered = dealt.unionByName(last).withColumn("tie", tie).repartitionById(
        n, F.pmod("range", F.lit(n))).sortWithinPartitions(
            "range", "after", F.col("doc_id").desc_nulls_last(), "tie", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in common.in_chunks(batches, CHUNK_BYTES):
            ids = held[0] + batch.column("doc_id").to_pylist()
            texts = held[1] + batch.column("text").to_pylist()
            ends = [False] * len(held[0]) + [x == 1 for x in batch.column("after").to_pylist()]
            at = [i for i in range(len(ids) - 1) if not ends[i]]
            held = ([], []) if ends[-1] else (ids[-1:], texts[-1:])
            if at:
                yield compare([ids[i] for i in at], [texts[i] for i in at], [texts[i + 1] for i in at])

    return ordered.select("doc_id", "text", "after").mapInArrow(rows, ddl)


DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
       "edited_fingerprint string, near_edited double, near_next double")


def compare_next(ids: list[int], texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # every text but the last is fingerprinted once: it follows the one before
    run = [*texts, *following[-1:]] if texts[1:] == following[:-1] else [*texts, *following]
    own, other = fingerprints(run), fingerprints(changed)
    nexts = own[1:] if len(run) == len(texts) + 1 else own[len(texts):]
    some = np.array([bool(t.strip(" \t\n\v\f\r")) for t in run], bool)
    some_next = some[1:] if len(run) == len(texts) + 1 else some[len(texts):]
    n = len(texts)
    own, some = own[:n], some[:n]
    some_changed = np.array([bool(t.strip(" \t\n\v\f\r")) for t in changed], bool)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                 pa.string()),
        pa.array(_encoded(own, some), pa.string()),
        pa.array(_encoded(other, some_changed), pa.string()),
        pa.array(likeness(own, other, some, some_changed), pa.float64()),
        pa.array(likeness(own, nexts[:n], some, some_next[:n]), pa.float64()),
    ], names=[c.split()[0] for c in DDL.split(", ")])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint and likeness to its edited text and to the next document.

    Equal texts have equal fingerprints. A text without words has the empty fingerprint; it is
    like others without words (1) and unlike all others (0). Extra columns are ignored; an empty
    table gives no rows.
    """
    return with_next(docs, compare_next, DDL, id_col, text_col)
