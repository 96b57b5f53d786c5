"""Connected components of links between integer ids, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import common


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). One row per linked id: node, component (its smallest reachable id).

    Each step ties an id's neighbours to the smallest of them, first the larger ones, then the
    smaller ones, until every id hangs on its component's smallest. Neighbours are never gathered:
    a step is an aggregate and a join, both on single rows. Rows with a null are ignored; repeated
    links and links to oneself do no harm. Each round is written below the shared folder, so the
    plan does not grow with the rounds; the number of rounds grows with the logarithm of the ids.
    """
    edges = common.stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND u <> v"), "links")
    while not _stars(edges):
        edges = common.stored(_small(_large(edges)), "links")
    ends = edges.groupBy("u").agg(F.min("v").alias("component"))
    return ends.select(F.col("u").alias("node"), "component").unionByName(
        ends.select(F.col("component").alias("node"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Does every id hang on one other, on which nothing hangs but such ids?"""
    sides = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v")))
    bent = sides.groupBy("u").agg(
        F.max("v").alias("high"), F.min("v").alias("low"), F.count_if(F.col("v").isNull()).alias("held")) \
        .filter("high <> low OR (high IS NOT NULL AND held > 0)")
    return bent.agg(F.count(F.lit(1))).first()[0] == 0


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of an id hangs on the smallest of its neighbours and itself."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.filter("y > x").join(least, "x").select(
        F.col("y").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of an id, and the id, hangs on the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
