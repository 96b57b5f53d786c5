"""URL rules by Bloom filter cascades: exact membership of the corpus's keys without joins.

A rule names a host and a beginning of paths, and fits the host, its subdomains and all paths that
begin so. A URL's keys are the strings under which a rule could fit it: as many last labels of its
host, and as many first characters of its path, as some rule has. All keys of all URLs are the
universe. A list of keys becomes a chain of Bloom filters: the first holds the list; the second the
universe's other keys that the first lets through by mistake; the third the listed keys that the
second lets through; and so on, until no mistake is left. The first filter that stops a key tells
whether it is listed. Every filter is smaller than the last by its rate of mistakes, and only
filters travel to the tasks that judge URLs.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import common

ALLOW, BLOCK = "allow", "block"
RULE_DDL = "verdict string, host string, path string"

BITS_PER_KEY = 8.0
HASHES = 5
#: Largest filter that is sent to tasks: 64 MB, some 64 million listed keys.
MAX_FILTER_BITS = 1 << 29
#: Chains end long before; one that does not has two keys with one hash and is built again.
MAX_LEVELS = 40


def _positions(h: np.ndarray, bits: int, level: int) -> np.ndarray:
    """The places of 64-bit hashes in a level's filter, a row per hash."""
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None] * np.uint64(0x9E3779B1)
                >> np.uint64(3)) % np.uint64(bits)


@dataclasses.dataclass
class Cascade:
    """A chain of filters over hashes made with one seed."""

    seed: int
    bits: list[int]
    words: list[np.ndarray]

    def passes(self, level: int, h: np.ndarray) -> np.ndarray:
        at = _positions(h, self.bits[level], level)
        return (self.words[level][(at >> np.uint64(6)).astype(np.int64)]
                >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """For hashes of keys of the universe: whether they are listed."""
        out = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for level in range(len(self.bits)):
            held = self.passes(level, h[left])
            # who is let through by all belongs to the last filter's own kind
            out[left[held]] = level % 2 == 0
            out[left[~held]] = level % 2 == 1
            left = left[held]
        return out


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def _test(spark: SparkSession, cascade: Cascade, level: int | None = None):
    """A column function of hashes: let through by a level, or listed by the whole chain."""
    shared = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        chain, values = shared.value, h.to_numpy(np.int64).view(np.uint64)
        return pd.Series(chain.contains(values) if level is None else chain.passes(level, values))

    return test


def _add_level(chain: Cascade, keys: DataFrame) -> int:
    """A further filter that holds the hashes of `keys`; returns how many there are.

    Its set bits come to the driver as words, no more than the filter has.
    """
    n = keys.count()
    bits = max(64, int(n * BITS_PER_KEY))
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"{n} keys are more than a filter of {MAX_FILTER_BITS} bits holds")
    level = len(chain.bits)

    @F.pandas_udf("array<long>")
    def places(h: pd.Series) -> pd.Series:
        return pd.Series(list(_positions(
            h.to_numpy(np.int64).view(np.uint64), bits, level).astype(np.int64)))

    words = np.zeros(-(-bits // 64), np.uint64)
    at = keys.select(F.explode(places("h")).alias("at"))
    for r in at.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toLocalIterator():
        words[r["word"]] = np.uint64(r["mask"] % 2**64)
    chain.bits.append(bits)
    chain.words.append(words)
    return n


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The chain for the keys of `listed` over those of `universe` (both: key, repeats allowed).

    Every key of the universe is tested against the first filter, and each later one against all
    keys that reached it. Null keys are ignored; an empty list is a chain without filters.
    """
    spark = listed.sparkSession
    listed = common.stored(listed.filter("key IS NOT NULL").distinct(), "listed")
    for seed in range(100):
        chain = Cascade(seed, [], [])
        own = listed.withColumn("h", _hash(F.col("key"), seed))
        if not _add_level(chain, own.select("h")):
            return Cascade(seed, [], [])
        passing = universe.filter("key IS NOT NULL").withColumn("h", _hash(F.col("key"), seed)).filter(
            _test(spark, chain, 0)("h")).distinct().join(listed, "key", "left_anti")
        other = common.stored(passing, "mistakes")
        while len(chain.bits) < MAX_LEVELS:
            if not other.take(1):
                return chain
            _add_level(chain, other.select("h"))
            own, other = other, common.stored(
                own.filter(_test(spark, chain, len(chain.bits) - 1)("h")), "mistakes")
    raise RuntimeError("no seed tells the keys apart")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; then up to ? or #.

    Both are empty for a null URL and one without ://.
    """
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return common.ascii_lower(part(1)), part(2)


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """A URL's keys, one per shape (labels of the host, characters of the path); null where it has
    fewer."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return [F.when((host != "") & (labels >= n) & (F.length(path) >= k),
                   F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, k)))
            for n, k in shapes]


def judge(
    pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW, url_col: str = "url",
    name: str = "judged",
) -> DataFrame:
    """The pages with a struct column (host, path, rule, verdict).

    Of the rules that fit, the longest (host and path together, then the host) decides; a rule that
    is both allowed and blocked blocks. Where none fits, `rule` is null and the verdict is
    `otherwise`. Rule hosts are taken in lower case; rules with a null are ignored. All columns pass
    through; one called like the struct is replaced.
    """
    spark = pages.sparkSession
    rules = common.stored(rules.dropna(subset=["verdict", "host", "path"]).select(
        "verdict", common.ascii_lower(F.col("host")).alias("host"), "path").distinct(), "rules")
    # a row per length that occurs, not per rule
    shapes = [tuple(r) for r in rules.select(
        F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")).distinct()
        .orderBy("n", "k").collect()]
    host, path = host_and_path(common.col(url_col))
    keys = _keys(F.col("host"), F.col("path"), shapes)
    universe = pages.select(host.alias("host"), path.alias("path")).select(
        F.explode(F.array(*keys) if keys else F.array().cast("array<string>")).alias("key"))
    listed = rules.withColumn("key", F.concat("host", "path"))
    tests = {}
    for verdict in (BLOCK, ALLOW):
        chain = build(listed.filter(F.col("verdict") == verdict).select("key"), universe)
        tests[verdict] = functools.partial(_in, _test(spark, chain), chain.seed)
    found = []
    for (n, _), key in zip(shapes, keys, strict=True):
        verdict = F.when(tests[BLOCK](key), F.lit(BLOCK)).when(tests[ALLOW](key), F.lit(ALLOW))
        found.append(F.when(verdict.isNotNull(), F.struct(
            F.length(key).alias("length"), F.length(F.substring_index(F.col("host"), ".", -n)).alias("own"),
            key.alias("rule"), verdict.alias("verdict"))))
    best = F.greatest(*found) if len(found) > 1 else found[0] if found else \
        F.lit(None).cast("struct<length:int,own:int,rule:string,verdict:string>")
    kept = [c for c in pages.columns if c != name]
    parts = pages.select(F.struct(*map(common.col, kept)).alias("page"), host.alias("host"),
                         path.alias("path"))
    return parts.withColumn("best", best).select(
        *[F.col("page").getField(c).alias(c) for c in kept],
        F.struct("host", "path", "best.rule", F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
        .alias(name))


def _in(test, seed: int, key: Column) -> Column:
    # a hash is never null, so it reaches Python as a whole number
    return key.isNotNull() & test(_hash(key, seed))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_DDL)
