"""Embedding near duplicates by randomised-rotation binary codes.

A normalised vector is turned by a random rotation and coded by the signs of what comes out. With
each code goes its correction factor, the cosine between the vector and its code. For another
vector q, <code, q> divided by that factor is an unbiased estimate of the cosine, and its error
stays within a bound that follows from the factor. Codes (a bit per component) and factors are
stored once per vector, beside the turned vector in bytes that stands for q; the bound covers what
these bytes round off. Only codes, factors and bytes go to where vectors meet. A pair whose
estimate plus bound is below the threshold, from either side, is left out; for those left open the
vectors are fetched, and their cosines computed in double precision.

Pairs come from an index over all rows: further rotations give more sign bits, cut into bands, and
vectors that agree in a whole band meet. Bands grow with the logarithm of the number of vectors, so
strangers meet seldom at every size, and their number is such that a pair at the threshold is
missed with a probability of 1 in 1,000. Equal vectors meet as one, with their number. A band's
list is cut into blocks; each pair of blocks is a row of its own, and gives counts of links and a
spanning forest of them, not the pairs. A pair counts in the first band in which it meets.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import common
from furrow.llm.components import components

SEED = 20_260_101
#: Chance that a pair at the threshold meets in no band.
MISS = 0.001
#: Widths of the error bound in standard deviations.
BOUND = 5.0
BLOCK = 256
#: Pairs that are computed at a time.
PAIRS = 20_000
OPEN_DDL = "dim int, band int, key long, block long, other long, ids array<array<long>>, bits binary"
OPEN = pa.schema([
    ("dim", pa.int32()), ("band", pa.int32()), ("key", pa.int64()), ("block", pa.int64()),
    ("other", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64()))), ("bits", pa.binary())])


@dataclasses.dataclass(frozen=True)
class Index:
    """Bands of sign bits: how many, and how many bits each."""

    bands: int
    bits: int

    @staticmethod
    def of(vectors: int, threshold: float) -> Index:
        same = 1 - math.acos(threshold) / math.pi
        bits = max(12, math.ceil(math.log2(max(vectors, 2))) + 5)
        return Index(math.ceil(math.log(MISS) / math.log1p(-same ** bits)), bits)


@functools.lru_cache(maxsize=512)
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, number: int = 0) -> np.ndarray:
    """Signs after a rotation, as bits."""
    return x @ rotation(x.shape[1], number) >= 0


def factors(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Cosine between each unit vector and its code."""
    turned = x @ rotation(x.shape[1], 0)
    return np.where(bits, turned, -turned).sum(axis=1) / math.sqrt(x.shape[1])


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes of unit vectors, their factors, the turned vectors in bytes, and the bytes' unit."""
    bits, turned = codes(x), x @ rotation(x.shape[1], 0)
    unit = np.abs(turned).max(axis=1) / 127
    return np.packbits(bits, axis=1), factors(x, bits), np.rint(turned / unit[:, None]).astype(np.int8), unit


def bands(x: np.ndarray, index: Index) -> np.ndarray:
    """A 64-bit key per vector and band."""
    dim = x.shape[1]
    need, found = index.bands * index.bits, []
    for number in range(1, -(-need // dim) + 1):
        found.append(codes(x, number))
    bits = np.concatenate(found, axis=1)[:, :need].reshape(len(x), index.bands, index.bits)
    with np.errstate(over="ignore"):
        place = np.uint64(1) << (np.arange(index.bits, dtype=np.uint64) % np.uint64(63))
        return (bits * place).sum(axis=2, dtype=np.uint64).view(np.int64)


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v.as_buffer() for v in values), "<f8").reshape(len(values), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> DataFrame:
    """id, vec (doubles as bytes), dim, copies: one row per different usable vector."""
    ddl = "vec_id long, dim int, vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                v = v.values
                if i is None or v is None or not len(v) or v.null_count:
                    continue
                x = v.to_numpy().astype("<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    # a scale that keeps squares within range and changes no direction
                    x = x / 2.0 ** np.frexp(np.abs(x).max())[1]
                    ids.append(i), dims.append(len(x)), out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                names=["vec_id", "dim", "vec"])

    return vectors.select(common.col("vec_id"), common.col("embedding")).mapInArrow(run, ddl)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links between small integers, those that a spanning forest needs."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((i, j))
    return kept


@dataclasses.dataclass(frozen=True)
class Side:
    """The stored sketches of a block's members."""

    signs: np.ndarray
    factor: np.ndarray
    turned: np.ndarray
    unit: np.ndarray

    @staticmethod
    def of(members: list[dict], dim: int) -> Side:
        packed = np.frombuffer(b"".join(m["code"] for m in members), np.uint8).reshape(len(members), -1)
        signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        unit = np.array([m["unit"] for m in members])
        bytes_ = np.frombuffer(b"".join(m["turned"] for m in members), np.int8).reshape(-1, dim)
        return Side(signs / np.float32(math.sqrt(dim)), np.array([m["factor"] for m in members]),
                    bytes_ * unit[:, None].astype(np.float32), unit)

    def ceiling(self, other: Side) -> np.ndarray:
        """Estimates of all cosines from the own turned vectors and the other's codes, plus bounds."""
        dim = self.signs.shape[1]
        spread = BOUND * np.sqrt(np.maximum(1 - other.factor ** 2, 0)) / math.sqrt(max(dim - 1, 1))
        rounded = self.unit[:, None] / 2 * math.sqrt(dim)
        return (self.turned @ other.signs.T + spread + rounded) / other.factor + 1e-5


def undecided(x: Side, y: Side, threshold: float) -> np.ndarray:
    """Which pairs the bounds leave open, by the codes of both sides."""
    return (x.ceiling(y) >= threshold) & (y.ceiling(x).T >= threshold)


def sketched(same: DataFrame) -> DataFrame:
    """id, code, factor, turned, unit per class: what is stored and sent instead of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                code, factor, turned, unit = sketches(_unit(part.column("vec"), dim))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([c.tobytes() for c in code], pa.binary()),
                    pa.array(factor), pa.array([t.tobytes() for t in turned], pa.binary()),
                    pa.array(unit)], names=["id", "code", "factor", "turned", "unit"])

    return same.select("id", "dim", "vec").mapInArrow(
        run, "id long, code binary, factor double, turned binary, unit double")


def posted(same: DataFrame, index: Index) -> DataFrame:
    """id, dim, band, key: the bands under which each class may meet others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                own = bands(_unit(part.column("vec"), dim), index)
                row = pa.array(np.repeat(np.arange(part.num_rows), index.bands))
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(row), part.column("dim").take(row),
                    pa.array(np.tile(np.arange(index.bands), part.num_rows), pa.int32()),
                    pa.array(own.ravel())], names=["id", "dim", "band", "key"])

    return same.select("id", "dim", "vec").mapInArrow(run, "id long, dim int, band int, key long")


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def links(same: DataFrame, index: Index, threshold: float) -> DataFrame:
    """same: id, dim, vec, copies. Rows (kind 0: id, number of linked vectors other than copies;
    kind 1: a, b of a spanning forest)."""
    by = ["dim", "band", "key"]
    postings = common.stored(posted(same, index), "bands")
    sketch = common.stored(sketched(same), "codes")
    lists = common.stored(postings.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    # lists in blocks of members; a row per pair of blocks, with both blocks' sketches
    met = postings.join(lists, by).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = common.stored(met.join(sketch, "id").groupBy(*by, "blocks", "block").agg(
        F.collect_list(F.struct("id", "code", "factor", "turned", "unit")).alias("members")), "blocks")
    one = blocks.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))) \
        .withColumnRenamed("members", "left")
    two = blocks.select(*by, F.col("block").alias("other"), F.col("members").alias("right"))
    pair = [*by, "block", "other"]

    def leave_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each pair of blocks the members that are in open pairs, and these pairs as bits."""
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                r, = batch.slice(at, 1).to_pylist()
                x, y = (Side.of(r[side], r["dim"]) for side in ("left", "right"))
                open_ = undecided(x, y, threshold)
                if r["block"] == r["other"]:
                    open_ = np.triu(open_, 1)
                i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                if len(i):
                    rows.append({**{k: r[k] for k in pair},
                                 "ids": [[r["left"][k]["id"] for k in i], [r["right"][k]["id"] for k in j]],
                                 "bits": np.packbits(open_[np.ix_(i, j)]).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=OPEN)

    opened = common.stored(one.join(two, [*by, "other"]).select(*pair, "left", "right").mapInArrow(
        leave_open, OPEN_DDL), "open")
    wanted = opened.select(*pair, "bits", F.posexplode("ids").alias("side", "of")).select(
        *pair, "bits", "side", F.posexplode("of").alias("place", "id")).withColumn(
            "bits", F.when((F.col("side") == 0) & (F.col("place") == 0), F.col("bits")))
    fetched = wanted.join(same.select("id", "vec", "copies"), "id").groupBy(*pair).agg(
        F.max("bits").alias("bits"),
        F.collect_list(F.struct("side", "place", "id", "copies", "vec")).alias("members"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, a, b = [], [], []
            for at in range(batch.num_rows):
                r, = batch.slice(at, 1).to_pylist()
                members = sorted(r["members"], key=lambda m: (m["side"], m["place"]))
                left, right = ([m for m in members if m["side"] == side] for side in (0, 1))
                x, y = (np.frombuffer(b"".join(m["vec"] for m in side), "<f8").reshape(-1, r["dim"])
                        for side in (left, right))
                x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
                i, j = np.divmod(np.flatnonzero(np.unpackbits(
                    np.frombuffer(r["bits"], np.uint8), count=len(x) * len(y))), len(y))
                good = np.concatenate([
                    np.einsum("ij,ij->i", x[i[p:p + PAIRS]], y[j[p:p + PAIRS]]) >= threshold
                    for p in range(0, len(i), PAIRS)])
                i, j = i[good], j[good]
                if not len(i):
                    continue
                # a pair counts in the first band in which it meets
                kx, ky = bands(x, index), bands(y, index)
                first = np.concatenate([
                    ~(kx[i[p:p + PAIRS], :r["band"]] == ky[j[p:p + PAIRS], :r["band"]]).any(axis=1)
                    for p in range(0, len(i), PAIRS)])
                i, j = i[first], j[first]
                nx, ny = (np.array([m["copies"] for m in side]) for side in (left, right))
                for side, n, m in ((left, np.bincount(i, ny[j], len(left)), i),
                                   (right, np.bincount(j, nx[i], len(right)), j)):
                    for k in np.unique(m).tolist():
                        kind.append(0), a.append(side[k]["id"]), b.append(int(n[k]))
                # a vector of one block may stand on both sides
                p, q = (np.array([m["id"] for m in side], np.int64)[m] for side, m in ((left, i), (right, j)))
                ids, at_ = np.unique(np.concatenate([p, q]), return_inverse=True)
                for p, q in _forest(at_[:len(i)], at_[len(i):]):
                    kind.append(1), a.append(int(ids[p])), b.append(int(ids[q]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                names=["kind", "a", "b"])

    return fetched.mapInArrow(exact, "kind int, a long, b long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an
    id are linked with nothing. Vectors of different length are never linked. Rows with one id count
    as one vector of several values. Other columns, labels among them, are ignored.
    """
    narrow = vectors.select(common.col(id_col).cast("long").alias("vec_id"),
                            common.col(vector_col).alias("embedding"))
    usable = common.stored(classes(narrow), "vectors")
    key = F.sha2("vec", 256)
    groups = usable.withColumn("same", key).groupBy("same").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    same = common.stored(usable.withColumn("own", key).join(
        groups, (F.col("own") == F.col("same")) & (F.col("vec_id") == F.col("id"))).select(
            "id", "same", "copies", "dim", "vec").dropDuplicates(["same"]), "classes")
    found = common.stored(links(
        same, Index.of(same.count(), threshold), threshold), "links")
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("linked")).agg(F.sum("b").alias("n"))
    part = components(found.filter("kind = 1").select("a", "b"))
    of_row = usable.select("vec_id", key.alias("same")).join(
        same.select("same", "id", "copies"), "same").select("vec_id", "id", "copies")
    per_id = of_row.join(counts, F.col("id") == F.col("linked"), "left").join(
        part, F.col("id") == F.col("node"), "left").groupBy(F.col("vec_id").alias("own_id")).agg(
            F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.min(F.coalesce("component", "id")).alias("component"))
    return narrow.select("vec_id").join(per_id, F.col("vec_id") == F.col("own_id"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
