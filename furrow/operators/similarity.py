"""Semantic search: the k nearest vectors of a table for each of a table of query vectors.

Vectors are dealt to clusters around centroids, which come from a bounded sample; every vector is
in the index, in blocks that keep the range of their angles to the centroid. A vector at the angle
a from a centroid and a query at the angle q are at least |q - a| apart, so a block whose best
possible cosine is below the k-th score a query already has cannot change its answer: the search is
exact, however well or badly the clusters fit. A query is first scored in its own cluster, then in
those that its k-th score leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.session import work_dir

#: Bytes of a block's vectors: what one scoring step holds of either side.
BLOCK_BYTES = 2 << 20
#: Blocks that meet a cluster's queries in one place: what a task of the scoring join holds at a time.
PLACE_BLOCKS = 32
#: Queries scored against a block at a time.
QUERY_ROWS = 512
#: Vectors the centroids are fitted on, chosen by a hash of their ids, and the most centroids per
#: length of vectors.
SAMPLE, CENTROIDS, STEPS = 4096, 64, 8
#: Margin on cosines, above the rounding of angles and sums.
SLACK = 1e-6
#: Margin on scores, above what rounding them to 12 digits moves them.
ROUNDING = 1e-11


def _unit_rows(batch: pa.RecordBatch, id_col: str) -> Iterator[tuple[object, np.ndarray]]:
    """Ids and unit vectors. Vectors that are null, empty, zero or hold anything but finite numbers
    are left out (`unusable` counts them)."""
    for key, vector in zip(batch.column(id_col), batch.column("embedding"), strict=True):
        x = vector.values
        if x is None or x.null_count or not len(x):
            continue
        x = x.to_numpy().astype("<f8")
        if np.isfinite(x).all() and x.any():
            x = x / 2.0 ** np.frexp(np.abs(x).max())[1]
            yield key.as_py(), x / np.linalg.norm(x)


def centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit centroids per length of vectors, from at most SAMPLE of them."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64(F.col("vec_id").cast("string"))) \
        .limit(SAMPLE).toArrow()
    found: dict[int, list] = {}
    for batch in rows.to_batches():
        for _, x in _unit_rows(batch, "vec_id"):
            found.setdefault(len(x), []).append(x)
    out = {}
    for dim, members in found.items():
        x = np.array(members)
        centres = x[:max(1, min(CENTROIDS, len(x) // 16))]
        for _ in range(STEPS):
            own = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        out[dim] = centres
    return out


def _angles(x: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """Angles to all centroids of that length; one of 0 where the sample had none."""
    if centres is None:
        return np.zeros((len(x), 1))
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(rows: DataFrame, id_col: str, more: list[str] = ()) -> DataFrame:
    """Rows (id, dim, cluster, angle, data, more doubles) in blocks of one cluster and like angles:
    block, dim, cluster, low, high (angles), ids, data, more as arrays."""
    kind = rows.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, nr, id_type = [], None, TaskContext.get().partitionId() << 32, None

        def out():
            angles = [r["angle"] for r in held]
            return pa.RecordBatch.from_arrays([
                pa.array([nr], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                pa.array([min(angles)]), pa.array([max(angles)]),
                pa.array([[r[id_col] for r in held]], pa.list_(id_type)),
                pa.array([b"".join(r["data"] for r in held)], pa.binary()),
                *(pa.array([[r[m] for r in held]], pa.list_(pa.float64())) for m in more)],
                names=["block", "dim", "cluster", "low", "high", "ids", "data", *more])

        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for row in batch.to_pylist():
                own = row["dim"], row["cluster"]
                if held and (own != key or len(held) * len(row["data"]) >= BLOCK_BYTES):
                    yield out()
                    held, nr = [], nr + 1
                key = own
                held.append(row)
        if held:
            yield out()

    by = ["dim", "cluster", "angle", id_col]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        pack, f"block long, dim int, cluster int, low double, high double, ids array<{kind}>, data binary"
        + "".join(f", {m} array<double>" for m in more))


def _assigned(df: DataFrame, id_col: str, centres: dict[int, np.ndarray]) -> DataFrame:
    """Usable vectors with their nearest centroid and the angle to it."""
    kind = df.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_unit_rows(batch, id_col))
            for dim in {len(x) for _, x in rows}:
                part = [(i, x) for i, x in rows if len(x) == dim]
                angles = _angles(np.array([x for _, x in part]), centres.get(dim))
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in part], batch.schema.field(id_col).type),
                    pa.array([dim] * len(part), pa.int32()), pa.array(own.astype(np.int32)),
                    pa.array(angles[np.arange(len(part)), own]),
                    pa.array([x.tobytes() for _, x in part], pa.binary())],
                    names=[id_col, "dim", "cluster", "angle", "data"])

    return df.select(id_col, "embedding").mapInArrow(
        assign, f"{id_col} {kind}, dim int, cluster int, angle double, data binary")


def unusable(vectors: DataFrame) -> DataFrame:
    """How many vectors are left out, and why."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(
        F.when(x.isNull(), "null").when(F.size(x) == 0, "empty").when(odd, "not finite")
        .when(~F.exists(x, lambda v: v != 0), "zero").alias("reason")) \
        .filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _met(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each block of its clusters: query_id, vec_id, score.

    asked: rows (query_id, dim, cluster, angle, data, floor); a query is there once per cluster to
    look at, with its angle to that centroid and the score below which nothing matters. Some
    PLACE_BLOCKS blocks of a cluster share a place and its queries go to each, so a cluster with
    most of the vectors is searched by many tasks. Queries are sent to places by a shuffle, however
    small their stored form looks: copied to all places they are too many for one process. The
    queries of a place stream past its blocks.
    """
    id_kind = blocks.schema["ids"].dataType.elementType.simpleString()
    query_kind = asked.schema["query_id"].dataType.simpleString()
    # at most CENTROIDS rows per length of vectors
    places = F.broadcast(blocks.groupBy("dim", "cluster").agg(
        F.ceil(F.count(F.lit(1)) / PLACE_BLOCKS).alias("places")))
    right = blocks.join(places, ["dim", "cluster"]).withColumn(
        "place", F.pmod(F.xxhash64("block"), F.col("places"))).drop("places")
    left = _blocks(asked, "query_id", ["floor"]).join(places, ["dim", "cluster"]).select(
        "dim", "cluster", F.col("low").alias("query_low"), F.col("high").alias("query_high"),
        F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), "floor",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(c).type.value_type for c in ("query_ids", "ids")]
            for i in range(batch.num_rows):
                low, high, q_low, q_high, n = (
                    batch.column(c)[i].as_py() for c in ("low", "high", "query_low", "query_high", "dim"))
                floor = np.array(batch.column("floor")[i].as_py())
                gap = max(q_low - high, low - q_high, 0.0)
                if np.cos(gap) + SLACK < floor.min():
                    continue
                ids, query_ids = (batch.column(c)[i].as_py() for c in ("ids", "query_ids"))
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, n)
                        for c in ("data", "query_data"))
                order = np.argsort(np.argsort(np.array(ids, object), kind="stable"), kind="stable")
                found = ([], [], [])
                for first in range(0, len(q), QUERY_ROWS):
                    scores = q[first:first + QUERY_ROWS] @ x.T
                    least = floor[first:first + QUERY_ROWS]
                    if len(ids) > k and least.min() < -1:
                        kth = len(ids) - k
                        least = np.maximum(least, np.partition(scores, kth, axis=1)[:, kth])
                    near = scores >= least[:, None] - ROUNDING
                    for row in np.flatnonzero(near.any(axis=1)).tolist():
                        pool = np.flatnonzero(near[row])
                        # equal vectors score alike wherever they stand in a block
                        s = np.round(scores[row, pool], 12)
                        best = np.lexsort((order[pool], -s))
                        best = best[s[best] >= floor[first + row]][:k]
                        found[0].extend([query_ids[first + row]] * len(best))
                        found[1].extend(ids[t] for t in pool[best])
                        found[2].extend(s[best].tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, (*kinds, pa.float64()), strict=True)],
                    names=["query_id", "vec_id", "score"])

    return left.hint("merge").join(right, ["dim", "cluster", "place"]).select(
        "dim", "low", "high", "ids", "data", "query_low", "query_high", "query_ids", "query_data", "floor"
    ).mapInArrow(score, f"query_id {query_kind}, vec_id {id_kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores in the queries' own clusters, queries with the further clusters to look at, blocks)."""
    spark, centres = vectors.sparkSession, centroids(vectors)
    blocks = _stored(_blocks(_assigned(vectors, "vec_id", centres), "vec_id"), "vector-blocks")
    asked = _stored(_assigned(queries, "query_id", centres), "queries")
    at_home = _stored(_met(blocks, asked.withColumn("floor", F.lit(-2.0)), k), "own-cluster")
    # at most CENTROIDS rows per length of vectors
    reach = {(r["dim"], r["cluster"]): (r["low"], r["high"]) for r in blocks.groupBy("dim", "cluster").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    kth = _best(at_home, k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    rows = asked.join(kth, "query_id", "left").select(
        *asked.columns, F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    kind = queries.schema["query_id"].dataType.simpleString()

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                angles = _angles(np.frombuffer(r["data"], "<f8")[None], centres.get(r["dim"]))[0]
                for cluster, angle in enumerate(angles.tolist()):
                    low, high = reach.get((r["dim"], cluster), (None, None))
                    if low is None or cluster == r["cluster"]:
                        continue
                    if np.cos(max(angle - high, low - angle, 0.0)) + SLACK >= r["floor"]:
                        rows.append({**r, "cluster": cluster, "angle": angle})
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    more = rows.mapInArrow(
        further, f"query_id {kind}, dim int, cluster int, angle double, data binary, floor double")
    return at_home, _stored(more, "further-clusters"), blocks


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine neighbours among vectors of the query's length, ties by id.

    query_id, vec_id, score, rank. Ids keep their own type; those of queries should be unique. A
    query without usable vector has no neighbours. A query is copied to the clusters it has to look
    at, at most CENTROIDS, and nothing but the sample and one row per cluster reaches the driver.
    """
    at_home, more, blocks = _search(vectors, queries, k)
    return _best(at_home.unionByName(_met(blocks, more, k)), k)


def searched_share(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row: how many pairs of a query and a cluster there are, and how many were searched."""
    _, more, blocks = _search(vectors, queries, k)
    clusters = blocks.select("dim", "cluster").distinct().groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    asked = _assigned(queries, "query_id", centroids(vectors))
    every = asked.join(F.broadcast(clusters), "dim").select("n", F.lit(1).alias("one"))
    return every.unionByName(more.select(F.lit(0).cast("long").alias("n"), F.lit(1).alias("one"))).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("one").alias("searched"))


def sampled_queries(vectors: DataFrame, every: int = 50) -> DataFrame:
    """The rows whose id is divisible by `every`, as queries."""
    return vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
