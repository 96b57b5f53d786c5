"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. Angles obey the triangle inequality on
the sphere: two vectors with the angles s and t to one reference form an angle between |s - t| and
min(s + t, 2 pi - s - t). The references' intervals, intersected, bound the cosine, and times both
norms the inner product; margins cover the rounding of stored angles, so no pair is lost. Blocks of
vectors carry the ranges of their angles and norms: anchors whose interval with a block misses the
windows that are asked for are left out, then vectors whose interval with the anchors left does,
and of long vectors single pairs. All others are scored, exactly, in whole numbers held by floats:
single ones where the norms say that every partial sum fits, else doubles.

Vectors of one label and neighbouring angles lie in blocks. Anchors are scored within the block
they lie in and those beside it, which gives each a first bound for its positives. Then all anchors meet all blocks of
vectors in a grid of tasks: positives of one label first, then negatives of others. A task holds
its anchors and passes its blocks by them; the k best so far of an anchor and window narrow it, as
do, before, those among a few blocks that all anchors meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import common

SEED = 20_260_613
REFERENCES = 8
BLOCK, ANCHOR_BLOCK = 1024, 512
#: Largest squared norm: inner products of such vectors are exact in doubles in any order.
MAX_SQUARE = 1 << 53
#: Margin on angles, above the rounding of the arc cosine and of the stored single-precision value.
ANGLE_SLACK = 1e-5
#: Components of blocks that give anchors a first bound: of those beside them, and of a few others.
NEAR, FEW = 1 << 20, 64
#: Whole numbers up to twice this are exact in single floats.
SINGLE = 1 << 23
#: Anchors that a task holds, about, and bytes of their components; columns of the grid of tasks,
#: and bytes of components that one of them takes before there are more.
HELD, HELD_BYTES = 250_000, 64 << 20
COLUMNS, COLUMN_BYTES = 64, 128 << 20
#: Components from which a score costs more than the bounds of a pair.
LONG = 4096
#: Scores that may count, as a share of the rows that have some and by window, above which whole
#: rows are searched.
DENSE = 1 / 512
#: Scores that anchors of one label put aside before they take them up.
ASIDE = 8192

ROW = "vec_id long, label long, dim int, square long, q binary, angles binary, angle float"
PACKED = "ids binary, squares binary, q binary, angles binary, low array<float>, high array<float>, " \
    "least double, most double"
BLOCKS = f"dim int, label long, block long, n int, {PACKED}"


@functools.lru_cache(maxsize=256)
def directions(dim: int) -> np.ndarray:
    """Unit reference directions, orthogonal as far as the dimension allows, the same everywhere."""
    count = min(REFERENCES, dim)
    q, _ = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, count)))
    return q


def angles_of(q: np.ndarray) -> np.ndarray:
    """Angles to the references; a vector of zeros is as far from each as from its opposite."""
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    return np.arccos(np.clip(q @ directions(q.shape[1]) / np.where(norm > 0, norm, 1), -1, 1))


def bounds(s: np.ndarray, t: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products, rows of (s, norms m) by rows of (t, norms n)."""
    near = np.zeros((len(s), len(t)), np.float64)
    far = np.full((len(s), len(t)), math.pi)
    for k in range(s.shape[1]):
        a, b = s[:, k, None].astype(float), t[None, :, k].astype(float)
        np.maximum(near, np.abs(a - b), out=near)
        np.minimum(far, np.minimum(a + b, 2 * math.pi - a - b), out=far)
    size = m[:, None] * n[None, :]
    slack = 1 + size * 1e-9
    near, far = np.maximum(near - 2 * ANGLE_SLACK, 0), np.minimum(far + 2 * ANGLE_SLACK, math.pi)
    return size * np.cos(far) - slack, size * np.cos(near) + slack


def binaries(rows: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    limits = np.arange(len(rows) + 1, dtype=np.int32) * rows[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def usable(vectors: DataFrame, scale: float, relabel: Callable | None) -> DataFrame:
    """One row per different (id, label, vector) that takes part."""
    label = common.col("label").cast("long")
    narrow = vectors.select(
        common.col("vec_id").cast("long").alias("vec_id"),
        (relabel(common.col("vec_id").cast("long"), label) if relabel else label).alias("label"),
        common.col("embedding").alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            v = batch.column(2)
            length = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            first = np.cumsum(length) - length
            flat = v.flatten().cast(pa.float64(), safe=False).fill_null(math.nan).to_numpy()
            for dim in np.unique(length[length > 0]).tolist():
                at = np.flatnonzero(length == dim)
                x = flat[first[at][:, None] + np.arange(dim)]
                finite = np.isfinite(x).all(axis=1)
                with np.errstate(over="ignore"):
                    q = np.floor(scale * x[finite])
                    square = np.einsum("ij,ij->i", q, q)
                fits = square <= MAX_SQUARE
                at, q = at[finite][fits], q[fits]
                if not len(at):
                    continue
                a, square = angles_of(q).astype("<f4"), square[fits].astype(np.int64)
                short = (np.abs(q) < 1 << 15).all(axis=1)  # judged by row: equal vectors get equal bytes
                for kind, part in (("<i2", np.flatnonzero(short)), ("<i4", np.flatnonzero(~short))):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[at[part]], pa.int64()), pa.array(own[at[part]], pa.int64()),
                            pa.array(np.full(len(part), dim, np.int32)), pa.array(square[part]),
                            binaries(q[part].astype(kind)), binaries(a[part]), pa.array(a[part, 0], pa.float32())],
                            names=["vec_id", "label", "dim", "square", "q", "angles", "angle"])

    return narrow.mapInArrow(run, ROW).dropDuplicates(["vec_id", "label", "dim", "q"])


def _packed(rows: list[dict], key: tuple, block: int) -> dict:
    """Rows of one dimension and label as one row, in order of their ids; components take two bytes
    each if all of them fit, else four."""
    rows = sorted(rows, key=lambda r: r["vec_id"])
    q = np.concatenate([np.frombuffer(r["q"], "<i2" if len(r["q"]) == 2 * key[0] else "<i4") for r in rows])
    angles = b"".join(r["angles"] for r in rows)
    a = np.frombuffer(angles, "<f4").reshape(len(rows), -1)
    squares = np.array([r["square"] for r in rows], "<i8")
    return {
        "dim": key[0], "label": key[1], "block": block, "n": len(rows),
        "ids": np.array([r["vec_id"] for r in rows], "<i8").tobytes(), "squares": squares.tobytes(),
        "q": q.tobytes(), "angles": angles,
        "low": a.min(axis=0).tolist(), "high": a.max(axis=0).tolist(),
        "least": math.sqrt(squares.min()), "most": math.sqrt(squares.max())}


def blocked(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Sorted rows packed into blocks of one dimension and label; `extra` columns of longs go along
    as one binary column each. Blocks are numbered by partition and place, and written."""
    names = [c.split()[0] for c in extra.split(", ") if c]
    ddl = BLOCKS + "".join(f", {n} binary" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, nr = [], None, TaskContext.get().partitionId() << 32

        def out():
            row = _packed(held, key, nr)
            ordered = sorted(held, key=lambda r: r["vec_id"])
            for n in names:
                row[n] = np.array([r[n] for r in ordered], "<i8").tobytes()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                own = row["dim"], row["label"]
                if held and (own != key or len(held) == size):
                    yield out()
                    held, nr = [], nr + 1
                key = own
                held.append(row)
        if held:
            yield out()

    schema = pa.schema([("dim", pa.int32()), ("label", pa.int64()), ("block", pa.int64()), ("n", pa.int32()),
                        ("ids", pa.binary()), ("squares", pa.binary()), ("q", pa.binary()),
                        ("angles", pa.binary()), ("low", pa.list_(pa.float32())),
                        ("high", pa.list_(pa.float32())), ("least", pa.float64()), ("most", pa.float64()),
                        *((n, pa.binary()) for n in names)])
    by = ["dim", "label", "angle", "vec_id"]
    return common.stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, ddl), "blocks")


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        q = np.frombuffer(row["q"], "<i2" if len(row["q"]) == 2 * n * dim else "<i4").reshape(n, dim)
        self.hold(np.frombuffer(row["ids"], "<i8"),
                  q.astype(np.float32 if row["most"] <= SINGLE else float),
                  np.frombuffer(row["angles"], "<f4").reshape(n, -1),
                  np.sqrt(np.frombuffer(row["squares"], "<i8").astype(float)))

    def hold(self, ids: np.ndarray, q: np.ndarray, angles: np.ndarray, norms: np.ndarray) -> None:
        self.n, self.dim = q.shape
        self.ids, self.q, self.angles, self.norms = ids, q, angles, norms
        self.across = np.ascontiguousarray(angles.T)
        self.low, self.high = self.across.min(axis=1, keepdims=True), self.across.max(axis=1, keepdims=True)
        self.least, self.most = norms.min(), norms.max()

    def reach(self, other: Block) -> np.ndarray:
        """Per row, an upper bound of its products with the other block's rows."""
        gap = np.maximum(np.maximum(self.across - other.high, other.low - self.across).max(axis=0), 0).astype(float)
        cosine = np.cos(np.maximum(gap - 2 * ANGLE_SLACK, 0))
        size = self.norms * np.where(cosine >= 0, other.most, other.least)
        return size * cosine + 1 + size * 1e-9


def products(a: Block, b: Block, rows: np.ndarray | slice = slice(None), cols: np.ndarray | slice = slice(None),
             room: np.ndarray | None = None) -> np.ndarray:
    """Scores of rows of `a` by rows of `b`, in single floats where no partial sum is too long for
    them: none is above the product of the norms. room: single floats that may be overwritten."""
    kind = np.float32 if a.most * b.most <= SINGLE else float
    left, right = a.q[rows].astype(kind, copy=False), b.q[cols].astype(kind, copy=False)
    size = len(left) * len(right)
    if kind is float or room is None or len(room) < size:
        return left @ right.T
    return np.matmul(left, right.T, out=room[:size].reshape(len(left), len(right)))


def best(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores that fit and their ids, ties by the smaller id: ids ascend."""
    left = np.where(fits, scores, -np.inf)
    values, who = np.full((len(left), k), -np.inf), np.zeros((len(left), k), np.int64)
    if not left.size:
        return values, who
    row = np.arange(len(left))
    for r in range(k):
        at = left.argmax(axis=1)
        values[:, r], who[:, r] = left[row, at], ids[at]
        left[row, at] = -np.inf
    return values, who


def merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of best per row."""
    values, who = (np.concatenate(x, axis=-1) for x in zip(a, b, strict=True))
    order = np.lexsort((who, -values), axis=-1)[..., :k]
    return np.take_along_axis(values, order, -1), np.take_along_axis(who, order, -1)


def first_bounds(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """The anchors, each with its k-th best score within its own block and its neighbours (`floor`;
    the least long where they have fewer) and a number of its own (`anchor`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if some and (size > NEAR or (row["dim"], row["label"]) != (some[0]["dim"], some[0]["label"])):
                    yield from out(some)
                    some, size = [], 0
                some.append(row)
                size += row["n"] * row["dim"]
        if some:
            yield from out(some)

    def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        near = [Block(row) for row in rows]
        for row, own in zip(rows, near, strict=True):
            at = np.flatnonzero(own.ids % every == 0)
            if not len(at):
                continue
            values = np.full((len(at), k), -np.inf)
            who = np.zeros(values.shape, np.int64)
            for b in near:
                scores = products(own, b, at)
                values, who = merged((values, who), best(scores, own.ids[at][:, None] != b.ids, b.ids, k), k)
            last = np.where(np.isfinite(values[:, -1]), values[:, -1], -2.0 ** 62).astype("<i8")
            kind = "<i2" if np.abs(own.q[at]).max() < 1 << 15 else "<i4"
            yield pa.RecordBatch.from_arrays([
                pa.array(own.ids[at]), pa.array(np.full(len(at), row["label"])),
                pa.array(np.full(len(at), row["dim"], np.int32)),
                pa.array(np.frombuffer(row["squares"], "<i8")[at]), binaries(own.q[at].astype(kind)),
                binaries(own.angles[at]), pa.array(own.angles[at, 0], pa.float32()), pa.array(last),
                pa.array(row["block"] * BLOCK + at)],
                names=[*(c.split()[0] for c in ROW.split(", ")), "floor", "anchor"])

    return blocks.mapInArrow(run, f"{ROW}, floor long, anchor long")


def narrowed(limit: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Limits of whole scores as scores are held, those beyond any score cut to one beyond any."""
    return np.clip(limit, -2 * SINGLE, 2 * SINGLE).astype(kind) if kind == np.float32 else limit


def highest(key: np.ndarray, score: np.ndarray, who: np.ndarray, k: int) -> tuple:
    """The different keys, and of each the k highest scores and their ids, ties by the smaller id."""
    order = np.lexsort((who, -score, key))
    key, score, who = key[order], score[order], who[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    place = np.arange(len(key)) - first[group]
    group, place, kept = group[place < k], place[place < k], place < k
    values, ids = np.full((len(first), k), -np.inf), np.zeros((len(first), k), np.int64)
    values[group, place], ids[group, place] = score[kept], who[kept]
    return key[first], values, ids


class Held:
    """Anchors of one dimension in a task, in tiles by label, with the k best scores so far of each
    anchor and window and their ids: a row per anchor, in it one per window."""

    def __init__(self, rows: list[dict], windows: Callable, k: int):
        rows.sort(key=lambda row: row["label"])
        least, self.most = (np.concatenate(x) for x in zip(*map(windows, rows), strict=True))
        self.labels = np.repeat([row["label"] for row in rows], [row["n"] for row in rows])
        self.parts = [(row["block"], row["anchor"], row["n"]) for row in rows]
        blocks = [Block(row) for row in rows]
        rows.clear()
        arrays = [np.concatenate([getattr(b, c) for b in blocks]) for c in ("ids", "q", "angles", "norms")]
        del blocks
        n, self.places = least.shape
        self.k, self.floor = k, least.copy()
        self.low, self.top = least.min(axis=1), self.most.max(axis=1)
        self.values, self.who = np.full((n * self.places, k), -np.inf), np.zeros((n * self.places, k), np.int64)
        self.aside, self.waiting = [], 0
        self.tiles = []
        for first in range(0, n, ANCHOR_BLOCK):
            tile = Block.__new__(Block)
            tile.hold(*(x[first:first + ANCHOR_BLOCK] for x in arrays))
            self.tiles.append((first, tile))

    def meet(self, b: Block, label: int, same: bool, room: np.ndarray) -> None:
        """Scores a block of vectors of one label against all anchors of that label, or of others,
        that it may matter to."""
        for first, a in self.tiles:
            labels = self.labels[first:first + a.n]
            inside, alone = labels[0] <= label <= labels[-1], labels[0] == labels[-1]
            if inside and alone and not same or not inside and same:
                continue
            low = self.low[first:first + a.n]
            wanted = a.reach(b) >= low
            if inside and not alone:
                wanted &= (labels == label) == same
            rows = np.flatnonzero(wanted)
            if not len(rows):
                continue
            cols, fits = slice(None), None
            if len(rows) < a.n:
                cols = np.flatnonzero(b.reach(a) >= low[rows].min())
            if b.dim >= LONG:
                under, over = bounds(a.angles[rows], b.angles[cols], a.norms[rows], b.norms[cols])
                fits = (over >= low[rows][:, None]) & (under <= self.top[first + rows][:, None])
                some = np.flatnonzero(fits.any(axis=0))
                cols, fits = np.arange(b.n)[cols][some], fits[:, some]
            ids = b.ids[cols]
            if not len(ids):
                continue
            scores = products(a, b, rows if len(rows) < a.n else slice(None), cols, room)
            low = narrowed(low[rows], scores.dtype)
            some = np.flatnonzero(scores.max(axis=1) >= low)
            if not len(some):
                continue
            if len(some) < len(rows):
                rows, low, scores = rows[some], low[some], scores[some]
            open_ = scores >= low[:, None]
            if fits is not None:
                open_ &= fits[some]
            many = DENSE * self.places * scores.size
            if np.count_nonzero(open_) > many:  # copies of an anchor may be many, and above its windows
                open_ &= scores <= narrowed(self.top[first + rows], scores.dtype)[:, None]
                open_ &= a.ids[rows][:, None] != ids
            if np.count_nonzero(open_) > many:
                self.search(first + rows, scores, open_, ids)
            else:
                self.pick(first + rows, a.ids[rows], scores, open_, ids)

    def pick(self, rows: np.ndarray, own: np.ndarray, scores: np.ndarray, open_: np.ndarray, ids: np.ndarray) -> None:
        """Puts single scores aside, and takes them up when they are many."""
        at = np.flatnonzero(open_)
        r, c = np.divmod(at, len(ids))
        other = own[r] != ids[c]
        at, r, c = at[other], r[other], c[other]
        self.aside.append((rows[r], scores.ravel()[at].astype(float), ids[c]))
        self.waiting += len(at)
        if self.waiting > ASIDE:
            self.settle()

    def settle(self) -> None:
        """Takes up the scores put aside."""
        if self.waiting:
            row, score, who = (np.concatenate(x) for x in zip(*self.aside, strict=True))
            i, place = np.nonzero((score[:, None] >= self.floor[row]) & (score[:, None] <= self.most[row]))
            if len(i):
                self.take(*highest(row[i] * self.places + place, score[i], who[i], self.k))
        self.aside, self.waiting = [], 0

    def search(self, rows: np.ndarray, scores: np.ndarray, open_: np.ndarray, ids: np.ndarray) -> None:
        """Takes up the best of whole rows of scores."""
        for p in range(self.places):
            high = narrowed(self.most[rows, p], scores.dtype)[:, None]
            values, who = best(scores, open_ & (scores <= high), ids, self.k)
            values[values < self.floor[rows, p][:, None]] = -np.inf
            self.take(rows * self.places + p, values, who)

    def take(self, key: np.ndarray, values: np.ndarray, who: np.ndarray) -> None:
        """Merges what was found for some anchors and windows, whose floors rise to their k-th best."""
        values, who = merged((self.values[key], self.who[key]), (values, who), self.k)
        self.values[key], self.who[key] = values, who
        row, place = np.divmod(key, self.places)
        self.floor[row, place] = np.maximum(self.floor[row, place], values[:, -1])
        self.low[row] = self.floor[row].min(axis=1)

    def out(self) -> Iterator[dict]:
        """What was found, a row per block of anchors."""
        self.settle()
        first = 0
        for block, anchor, n in self.parts:
            part = slice(first * self.places, (first + n) * self.places)
            values, who = self.values[part], self.who[part]
            key, r = np.nonzero(np.isfinite(values))
            if len(key):
                yield {"block": block, "anchor": anchor, "key": key.astype("<i4").tobytes(),
                       "score": values[key, r].astype("<i8").tobytes(), "who": who[key, r].tobytes()}
            first += n


def grid(anchors: DataFrame, blocks: DataFrame) -> tuple[int, int]:
    """Rows and columns of the grid of tasks: no row has too many anchors to hold, no column too many
    vectors, and the copies of both stay small."""
    def size(df: DataFrame) -> tuple[int, int]:
        n, data = df.agg(F.sum("n"), F.sum(F.col("n").cast("long") * F.col("dim") * 4)).first()
        return n or 0, data or 0

    (n, data), (n_all, data_all) = size(anchors), size(blocks)
    tasks = 2 * common.partitions(blocks.sparkSession)
    most = max(COLUMNS, -(-data_all // COLUMN_BYTES))
    columns = max(1, min(most, tasks, round(math.sqrt(tasks * n_all / max(n, 1)))))
    rows = max(1, -(-n // HELD), -(-data // HELD_BYTES), -(-min(tasks, most) // columns))
    return rows, columns


def met(anchors: DataFrame, blocks: DataFrame, same: bool, k: int, places: int, windows: Callable) -> DataFrame:
    """anchor, place, id, score, rank: per anchor and window its k best of all vectors of its own
    label, or of others.

    A grid of tasks: blocks of anchors are copied along one side, blocks of vectors along the other,
    so that either copying stays small and no task holds all of one label. windows: of a block of
    anchors, the least and the greatest score that counts, a row per anchor, in it one per window.
    """
    rows, columns = grid(anchors, blocks)
    # blocks are numbered in a partition: neighbours go to different places
    def dealt(n: int):
        first = F.pmod(F.xxhash64(F.shiftright("block", 32)), F.lit(n))
        return F.pmod(F.col("block").bitwiseAND((1 << 32) - 1) + first, F.lit(n))

    def along(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = anchors.select("*", dealt(rows).alias("x"), along(columns).alias("y"), F.lit(0).alias("side"))
    right = blocks.select("*", dealt(columns).alias("y"), along(rows).alias("x"), F.lit(1).alias("side"))
    cells = left.unionByName(right, allowMissingColumns=True).withColumn(
        "cell", (F.col("x") * columns + F.col("y")).cast("int")).drop("x", "y")
    schema = pa.schema([("block", pa.int64()), ("anchor", pa.binary()), ("key", pa.binary()),
                        ("score", pa.binary()), ("who", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(BLOCK * ANCHOR_BLOCK, np.float32)
        cell, rows, held = None, {}, {}

        def out():
            for own in held.values():
                for row in own.out():
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from out()
                    cell, rows, held = row["cell"], {}, {}
                if row["side"] == 0:
                    rows.setdefault(row["dim"], []).append(row)
                    continue
                if rows:
                    held = {dim: Held(rows.pop(dim), windows, k) for dim in list(rows)}
                if row["dim"] in held:
                    held[row["dim"]].meet(Block(row), row["label"], same, room)
        yield from out()
        common.release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            key, score, who = (np.concatenate([np.frombuffer(r[c], kind) for r in some])
                               for c, kind in (("key", "<i4"), ("score", "<i8"), ("who", "<i8")))
            key, values, who = highest(key, score.astype(float), who, k)
            i, r = np.nonzero(np.isfinite(values))
            row, place = np.divmod(key[i].astype(np.int64), places)
            return pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(some[0]["anchor"], "<i8")[row]), pa.array(place + 1), pa.array(who[i, r]),
                pa.array(values[i, r].astype(np.int64)), pa.array(r + 1)],
                names=["anchor", "place", "id", "score", "rank"])

        some = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if some and row["block"] != some[0]["block"]:
                    yield out()
                    some = []
                some.append(row)
        if some:
            yield out()

    found = cells.repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(
        run, "block long, anchor binary, key binary, score binary, who binary")
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(
        gather, "anchor long, place long, id long, score long, rank long")


def positives(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """anchor, positive_id, positive_score, place: per anchor its k best of the same label."""
    def windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
        least = np.frombuffer(row["floor"], "<i8").astype(float)[:, None]
        return least, np.full(least.shape, 2.0 ** 62)

    return met(anchors, blocks, True, k, 1, windows).select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("rank").alias("place"))


def raised(anchors: DataFrame, blocks: DataFrame, k: int, places: int, windows: Callable) -> DataFrame:
    """The anchors, each with the least score that still counts in each window (`floor1` and so on)
    after it met a few blocks of other labels, which are sent to all tasks as they are."""
    first, size = [], 0
    for row in blocks.select("block", "n", "dim").orderBy(F.xxhash64("block")).limit(FEW).collect():
        size += row["n"] * row["dim"]
        if not first or size <= NEAR:
            first.append(row["block"])
    few = [row.asDict() for row in blocks.filter(F.col("block").isin(first)).collect()]
    names = [f"floor{p}" for p in range(1, places + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [(Block(row), row["label"]) for row in few]
        room = np.empty(BLOCK * ANCHOR_BLOCK, np.float32)
        for batch in batches:
            for i in range(batch.num_rows):
                row, = batch.slice(i, 1).to_pylist()
                held = Held([row], windows, k)
                for block, label in near:
                    if block.dim == row["dim"]:
                        held.meet(block, label, False, room)
                held.settle()
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns, *(pa.array([x.astype("<i8").tobytes()]) for x in held.floor.T)],
                    names=[*batch.schema.names, *names])

    schema = T.StructType([*anchors.schema.fields, *(T.StructField(n, T.BinaryType()) for n in names)])
    return common.stored(anchors.mapInArrow(run, schema), "raised")


def negatives(anchors: DataFrame, blocks: DataFrame, k: int, places: int, low: int, high: int) -> DataFrame:
    """anchor, place, negative_id, negative_score, rank: per anchor and place of a positive, the k
    best of other labels with low * positive <= 100 * score <= high * positive.

    anchors: with the scores of their positives in columns score1 and so on; places without a
    positive hold the least long.
    """
    def longs(row: dict, name: str) -> np.ndarray:
        return np.stack([np.frombuffer(row[f"{name}{p}"], "<i8") for p in range(1, places + 1)], axis=1)

    def windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
        scores = longs(row, "score")
        there = scores > -(1 << 62)
        safe = np.where(there, scores, 0)
        # the least and the greatest whole score in the window; none fits below a negative score
        return (np.where(there, -(-low * safe // 100), 1 << 60).astype(float),
                np.where(there, high * safe // 100, -(1 << 60)).astype(float))

    def narrower(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return longs(row, "floor").astype(float), windows(row)[1]

    return met(raised(anchors, blocks, k, places, windows), blocks, False, k, places, narrower).select(
        "anchor", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")


def mine(
    vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0, relabel: Callable | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; other columns are ignored. Anchors are the rows whose id is a
    multiple of `every`. Components are floor(scale * x); a score is their inner product. Rows with
    a null id or label take no part, nor do vectors that are null or empty, hold null or non-finite
    components, or have a squared norm above 2^53, whose scores would not be exact. Vectors of
    different length never meet. Rows that repeat id, label and components count once; rows of one
    id that differ are rows of their own, but never each other's positives or negatives. `relabel`
    maps the columns (id, label) to the label to use.
    """
    blocks = blocked(usable(vectors, scale, relabel), BLOCK)
    at_home = common.stored(first_bounds(blocks, every, n_positives), "anchors")
    found = common.stored(positives(blocked(at_home, ANCHOR_BLOCK, "floor long, anchor long"), blocks,
                                    n_positives), "positives")
    # the places of positives as columns, at most n_positives an anchor
    wide = found.groupBy("anchor").agg(*(
        F.max(F.when(F.col("place") == p, F.col("positive_score"))).alias(f"score{p}")
        for p in range(1, n_positives + 1)))
    names = [f"score{p}" for p in range(1, n_positives + 1)]
    scored = at_home.drop("floor").join(wide, "anchor").fillna(-(1 << 62), names)
    packed = blocked(scored, ANCHOR_BLOCK, ", ".join(f"{n} long" for n in ["anchor", *names]))
    hard = negatives(packed, blocks, n_negatives, n_positives, low, high)
    return hard.join(found.withColumn("place", F.col("place").cast("long")), ["anchor", "place"]).join(
        at_home.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
            "positive_score", "negative_score")
