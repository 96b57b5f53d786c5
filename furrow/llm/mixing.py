"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A source's target is its weight's part of the total, but at most `epochs` times what it has; what
is cut off goes to the others in proportion to their weights, until none is above. The level at
which that ends follows from the sources in the order of cap over weight: those before a point are
at their caps, the rest share what is left. A target is then met by whole repetitions of all of a
source's documents and one fractional one: the documents first in a seeded order, as many as come
next to the words still missing.

The seeded order of a large source is never sorted as a whole. Hashes fall into slices; sums per
slice tell in which slice a source's cut lies, and only that slice's documents are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common
from furrow.session import broadcast_if_small

#: Hexadecimal digits that name a slice: up to 65,536 slices a source.
SLICE_DIGITS = 4

#: Sources whose cuts are sent to every task; with more, the join shuffles.
MAX_BROADCAST_SOURCES = 20_000


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: str) -> Column:
    """A document's place in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
                 .cast("binary"))


def targets(
    sizes: DataFrame, share: float, epochs: float, weights: tuple[float, ...],
) -> DataFrame:
    """sizes: source, source_size. Adds target, in words.

    The windows span all sources, a row each. A source without words gets 0; where all caps
    together are below the share, every source gets its cap.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "nr")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = sizes.withColumn("nr", F.row_number().over(by_name)).withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)),
                               (F.col("nr") - 1) % len(weights) + 1),
        "cap": F.col("source_size") * F.lit(epochs),
        "total": F.sum("source_size").over(everything) * F.lit(share),
    }).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward))
    free = F.col("ratio") > F.col("level")
    return levels.withColumn("last", F.max(F.when(free, F.col("level"))).over(everything)).select(
        "source", "source_size",
        F.when(free, F.col("last") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, epochs: float = 2.0,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    name: str = "mixed",
) -> DataFrame:
    """The documents with a struct column (size, source_size, target, times): how often the mix
    takes each.

    Sources in code-point order, null last, get the weights in turn. A null text counts no words.
    Copies of a row share a place in the order, so which of them is taken is open, but not how
    many. An empty table stays empty. Other columns pass through; one called like the struct is
    replaced. Given the seed, reruns agree.
    """
    kept = [common.col(c) for c in docs.columns if c != name]
    goal_, slice_col, size_, more_, spot_ = common.fresh(docs, "goal", "slice", "size", "more", "spot")
    spot, source = place(common.col(id_col), seed), common.col(source_col)
    slice_ = F.substring(spot, 1, SLICE_DIGITS)
    slices = docs.select(
        source.alias("source"), slice_.alias("slice"), words(common.col(text_col)).alias("size"),
    ).groupBy("source", "slice").agg(F.sum("size").alias("n"))
    goals = targets(
        slices.groupBy("source").agg(F.sum("n").alias("source_size")), share, epochs, weights,
    ).withColumn("whole", F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0))) \
        .withColumn("rest", F.greatest(
            F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))) \
        .withColumnRenamed("source", "goal_source")
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1)
    # the slice in which a source's cut lies: the last that begins at or before it
    cuts = slices.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))) \
        .join(goals, F.col("source").eqNullSafe(F.col("goal_source"))) \
        .filter(F.col("before") <= F.col("rest")).groupBy("source").agg(
            *(F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")),
            F.max(F.struct("slice", "before")).alias("at"))
    goal = broadcast_if_small(cuts, MAX_BROADCAST_SOURCES).select(
        F.struct("source", "source_size", "target", "whole", "rest", "at").alias(goal_))
    rows = docs.select(*kept, slice_.alias(slice_col)).join(
        goal, source.eqNullSafe(F.col(f"{goal_}.source")))
    inside = F.col(slice_col) == F.col(f"{goal_}.at.slice")
    rest, size = F.col(f"{goal_}.rest"), words(common.col(text_col))
    clear = rows.filter(~inside).select(
        *kept, goal_, size.alias(size_),
        ((F.col(slice_col) < F.col(f"{goal_}.at.slice")) & (rest > 0)).alias(more_))
    earlier = Window.partitionBy(source).orderBy(spot_, size_).rowsBetween(
        Window.unboundedPreceding, -1)
    middle = F.col(f"{goal_}.at.before") + F.coalesce(F.sum(size_).over(earlier), F.lit(0)) \
        + F.col(size_) / 2
    close = rows.filter(inside).select(
        *kept, goal_, size.alias(size_), spot.alias(spot_)).select(
            *kept, goal_, size_, ((middle <= rest) & (rest > 0)).alias(more_))
    return clear.unionByName(close).select(*kept, F.struct(
        F.col(size_).alias("size"), F.col(f"{goal_}.source_size").alias("source_size"),
        F.col(f"{goal_}.target").alias("target"),
        (F.col(f"{goal_}.whole") + F.col(more_).cast("long")).alias("times")).alias(name))


def repeated(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    name, = common.fresh(docs, "mixed")
    return mix(docs, name=name, **kwargs).select(
        *map(common.col, docs.columns),
        F.explode(F.array_repeat(F.lit(1), F.col(f"{name}.times").cast("int"))).alias(name)
    ).select(*map(common.col, docs.columns))
