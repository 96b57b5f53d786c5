"""Keyed tables of which a batch reads and rewrites only what it touches.

Keys are dealt to a fixed number of buckets, each a folder. `UpsertTable` holds one row per key: a
batch merges the buckets of its own keys and leaves the files of all others as they are.
`InsertLog` only grows: each batch adds the rows whose keys are new. Which stored keys may equal an
arriving one, a Bloom filter per bucket tells, so a batch reads the buckets with a possible copy,
and an exact anti join settles those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.operators.events import keep_latest
from furrow.session import work_dir
from furrow.streaming.changelog import ChangeLog

BUCKETS = 64
#: Bits of a bucket's filter and bits set per key: below one in 10,000 keys are taken for stored
#: ones while a bucket has fewer than 1.6 million; more keys cost reads, not results.
FILTER_BITS = 1 << 25
HASHES = 5


def bucket(keys: list[str], n: int) -> Column:
    """Nulls count as a value of their own."""
    return F.pmod(F.xxhash64(*keys, *[F.col(k).isNull() for k in keys]), F.lit(n)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    """Has anything been written to this folder?"""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


class UpsertTable:
    """One row per key, the newest by `version`; null keys form one group each, as in GROUP BY."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str,
                 version: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema, self.buckets = StructType.fromDDL(schema), buckets
        self.version = F.struct(*version)

    def _rows(self) -> DataFrame:
        wide = StructType.fromDDL(f"{self.schema.toDDL()}, _bucket int")
        if not _there(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], wide)
        return self.spark.read.schema(wide).parquet(f"{self.path}/rows")

    def current(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def upsert(self, batch: DataFrame) -> list[int]:
        """Merge a batch, newest wins; returns the buckets that were rewritten.

        The merged buckets are written elsewhere first, so nothing is overwritten while it is
        read, then they replace their folders. A batch that runs again changes nothing.
        """
        fresh = keep_latest(batch.select(*self.schema.names), self.keys, self.version).withColumn(
            "_bucket", bucket(self.keys, self.buckets))
        arriving = work_dir(self.spark, "arriving")
        fresh.write.parquet(arriving)
        fresh = self.spark.read.schema(fresh.schema).parquet(arriving)
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())
        if not touched:
            return []
        met = self._rows().filter(F.col("_bucket").isin(touched)).unionByName(fresh)
        merged = keep_latest(met, ["_bucket", *self.keys], self.version)
        staged = work_dir(self.spark, "merged")
        merged.write.parquet(staged)
        # ranges within buckets: a crowded bucket is written by several tasks, others by one
        self.spark.read.schema(merged.schema).parquet(staged) \
            .repartitionByRange("_bucket", F.xxhash64(*self.keys)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.path}/rows")
        return touched


def filter_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The bits that the keys set: word (a place in the bucket's filter) and bits, per row and hash."""
    marks = [F.col(k).isNull() for k in keys]
    places = F.array(*(F.pmod(F.xxhash64(*keys, *marks, F.lit(f"hash {i}")), F.lit(FILTER_BITS))
                       for i in range(HASHES)))
    return rows.withColumn("_place", F.explode(places)).withColumns({
        "word": F.shiftright("_place", 6).cast("int"),
        "bits": F.expr("shiftleft(1L, cast(_place & 63 as int))")}).drop("_place")


def _joined(words: DataFrame) -> DataFrame:
    return words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"), F.max("batch_id").alias("batch_id"))


class InsertLog:
    """Rows of the first batch in which their key came, in folders by batch and bucket."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema, self.buckets = StructType.fromDDL(schema), buckets
        self.filters = ChangeLog(spark, f"{self.path}/filters", ["bucket", "word"],
                                 "bucket int, word int, bits bigint", merge=_joined)

    def rows(self, before: int | None = None, among: list[int] | None = None) -> DataFrame:
        """All rows with their batch id, or those of some buckets: other folders are not read."""
        wide = StructType.fromDDL(f"{self.schema.toDDL()}, batch_id bigint, _bucket int")
        if not _there(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], wide).drop("_bucket")
        rows = self.spark.read.schema(wide).parquet(f"{self.path}/rows")
        if before is not None:
            rows = rows.filter(F.col("batch_id") < before)
        if among is not None:
            rows = rows.filter(F.col("_bucket").isin(among))
        return rows.drop("_bucket")

    def possible(self, fresh: DataFrame, before: int) -> list[int]:
        """Buckets that may hold a key of these rows (with `_bucket`); at most as many as there are."""
        asked = filter_words(fresh.select(*self.keys, "_bucket"), self.keys)
        held = _joined(self.filters.rows(before)).select("bucket", F.col("word").alias("_word"),
                                                         F.col("bits").alias("_bits"))
        hits = asked.join(held, (F.col("_bucket") == F.col("bucket")) & (F.col("word") == F.col("_word"))) \
            .filter(F.col("_bits").bitwiseAND(F.col("bits")) != 0)
        found = hits.groupBy("_bucket", *self.keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HASHES)
        return sorted(r[0] for r in found.select("_bucket").distinct().collect())

    def insert(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Add the rows of new keys, one per key; of copies in the batch the earliest by ts stays.
        Returns the buckets that had to be read. A batch that runs again replaces what it added."""
        rest = [c for c in self.schema.names if c not in self.keys]
        fresh = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct("ts", *rest)).alias("_r")) \
            .select(*self.keys, "_r.*").withColumn("_bucket", bucket(self.keys, self.buckets))
        arriving = work_dir(self.spark, "arriving")
        fresh.write.parquet(arriving)
        fresh = self.spark.read.schema(fresh.schema).parquet(arriving)
        read = self.possible(fresh, batch_id)
        if read:
            known = self.rows(batch_id, read).select(*[F.col(k).alias(f"_known_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in self.keys]
            new = work_dir(self.spark, "new")
            fresh.join(known, same, "left_anti").write.parquet(new)
            fresh = self.spark.read.schema(fresh.schema).parquet(new)
        fresh.select(*self.schema.names, "_bucket").repartitionByRange("_bucket", F.xxhash64(*self.keys)) \
            .write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/rows/batch_id={batch_id}")
        self.filters.write(filter_words(fresh.select(*self.keys, "_bucket"), self.keys).groupBy(
            F.col("_bucket").alias("bucket"), "word").agg(F.bit_or("bits").alias("bits")), batch_id)
        return read
