"""Running places and prefix hashes along sorted keys, with one carried row per partition.

Rows are dealt to ranges of (key, order) and sorted there; each task numbers its rows and hashes
its prefixes as if it held whole keys. What a key has in earlier partitions is added afterwards: a
partition hands on one row, for the key it ends with, so a key as large as the table is as evenly
spread as many small ones.

A prefix hash is a polynomial over the rows' SHA-256 words, modulo four primes: such hashes can be
continued from their value and length alone. It has 124 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import common

# Primes below 2^31 and the points at which the polynomials are taken.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
POINTS = np.array([1103515245, 1664525013, 822587467, 1597334677], np.uint64)
LANES = len(PRIMES)

EMPTY = bytes(4 * LANES)


def powers(n: int) -> np.ndarray:
    """The first n powers of each point, a row each."""
    out = np.ones((max(n, 1), LANES), np.uint64)
    done = 1
    while done < n:
        step = out[done - 1] * POINTS % PRIMES
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step % PRIMES
        done += more
    return out[:n]


def power(exponent: int) -> np.ndarray:
    return np.array([pow(int(r), exponent, int(p)) for r, p in zip(POINTS, PRIMES, strict=True)],
                    np.uint64)


def words_of(keys: pa.Array) -> np.ndarray:
    """Four residues per 32-byte key."""
    whole = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, LANES)
    return whole % PRIMES


def packed(hashes: np.ndarray) -> list[bytes]:
    whole, width = hashes.astype("<u4").tobytes(), 4 * LANES
    return [whole[i:i + width] for i in range(0, len(whole), width)]


def unpacked(hashes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(hashes.to_pylist()), "<u4").reshape(-1, LANES).astype(np.uint64)


def _local(batches: Iterator[pa.RecordBatch], key: str, digest: str) -> Iterator[pa.RecordBatch]:
    """Places and hashes within the partition; rows come in order."""
    own, count, state = None, 0, np.zeros(LANES, np.uint64)
    part = TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key).to_numpy()
        words = words_of(batch.column(digest))
        place, hashes = np.empty(n, np.int64), np.empty((n, LANES), np.uint64)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), n]
        table = powers(max(b - a for a, b in zip(cuts, cuts[1:])))
        for a, b in zip(cuts, cuts[1:]):
            if own is None or keys[a] != own:
                own, count, state = keys[a], 0, np.zeros(LANES, np.uint64)
            place[a:b] = count + 1 + np.arange(b - a)
            # terms stay below 2^31 and a batch has far less than 2^32 rows
            terms = words[a:b] * table[:b - a] % PRIMES
            hashes[a:b] = (state + np.cumsum(terms, axis=0) % PRIMES * power(count)) % PRIMES
            count, state = count + b - a, hashes[b - 1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place),
             pa.array(packed(hashes), pa.binary())],
            names=[*batch.schema.names, "part", "place", "prefix"])


def numbered(rows: DataFrame, key: str, order: list[str], digest: str, drop: list[str] = ()) -> DataFrame:
    """The rows with `place` (from 1 within the key, in order) and `prefix` (the hash of the key's
    rows up to this one), written below the shared folder. Columns in `drop` only serve the order.

    key: a long column without nulls; digest: a column of 32 bytes. Rows that agree in the whole
    order may come in any order.
    """
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n not in drop)
    kept = [n for n in rows.columns if n not in drop]
    dealt = rows.repartitionByRange(*map(common.col, (key, *order))).sortWithinPartitions(
        *map(common.col, (key, *order))).select(*map(common.col, kept))
    local = common.stored(dealt.mapInArrow(
        lambda batches: _local(batches, key, digest),
        f"{fields}, part int, place long, prefix binary"), "runs")
    # per partition, the last row of the key it ends with: one row each, whatever the input
    ends = local.groupBy("part").agg(
        F.max_by(F.struct(F.col(key).alias("key"), "place", "prefix"), F.struct(F.col(key), "place")).alias("end"),
        F.min(key).alias("first")).orderBy("part").collect()
    carried: dict[int, tuple[int, int, bytes]] = {}
    held: tuple[int, int, np.ndarray] | None = None
    for r in ends:
        if held and r["first"] == held[0]:
            carried[r["part"]] = (held[0], held[1], packed(held[2][None])[0])
        state = np.frombuffer(r["end"]["prefix"], "<u4").astype(np.uint64)
        if held and r["end"]["key"] == held[0]:
            held = (held[0], held[1] + r["end"]["place"], (held[2] + state * power(held[1])) % PRIMES)
        else:
            held = (r["end"]["key"], r["end"]["place"], state)
    if not carried:
        return local.drop("part")

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys = batch.column("part").to_numpy(), batch.column(key).to_numpy()
            place, hashes = batch.column("place").to_numpy().copy(), unpacked(batch.column("prefix"))
            for part in np.unique(parts).tolist():
                if part in carried:
                    own, count, state = carried[part]
                    hit = (parts == part) & (keys == own)
                    before = np.frombuffer(state, "<u4").astype(np.uint64)
                    hashes[hit] = (before + hashes[hit] * power(count)) % PRIMES
                    place[hit] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(place), pa.array(packed(hashes), pa.binary())],
                names=[*kept, "place", "prefix"])

    return local.mapInArrow(continued, f"{fields}, place long, prefix binary")
