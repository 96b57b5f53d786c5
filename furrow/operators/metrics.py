"""Pipeline health: counters, rates, lag, quantiles, drift.

Series are tables `metric, labels, ts, value` with one row per series and minute, so what a window
sees grows with the time span, not with the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import exact, text

COUNTER_BUCKETS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def minute_counts(events: DataFrame, *labels: Column, chosen: Column | None = None) -> DataFrame:
    counted = F.count(F.lit(1)) if chosen is None else F.count_if(chosen)
    return events.groupBy(*labels, F.date_trunc("minute", "ts").alias("ts")).agg(
        counted.alias("n"))


def daily_counter(counts: DataFrame, series: list[str]) -> DataFrame:
    """A counter sampled per minute that starts again at each midnight."""
    day = W.partitionBy(*series, F.to_date("ts")).orderBy("ts").rowsBetween(
        W.unboundedPreceding, 0)
    return counts.select(*series, "ts", F.sum("n").over(day).alias("value"))


def increases(samples: DataFrame, series: list[str]) -> DataFrame:
    """Growth of each counter since its sample before; after a reset the value itself counts, and
    a series' first sample has none."""
    order = W.partitionBy(*series).orderBy("ts")
    before = F.lag("value").over(order)
    return samples.withColumn(
        "increase",
        F.when(before.isNull(), None)
        .when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before),
    )


def topic_counter(events: DataFrame) -> DataFrame:
    counts = minute_counts(events, text.topic_of(F.col("event_type")).alias("topic"))
    return daily_counter(counts, ["topic"])


def ingest_rate(samples: DataFrame) -> DataFrame:
    """Messages per second per topic and minute."""
    return increases(samples, ["topic"]).select(
        "topic", F.col("ts").alias("minute"),
        (F.col("increase") / F.lit(60.0)).alias("per_second"),
    )


def hourly_increase(samples: DataFrame, series: list[str]) -> DataFrame:
    """Growth of all series together per hour."""
    return increases(samples, series).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.coalesce(F.sum("increase"), F.lit(0)).cast("bigint").alias("sent"))


def bucket_counts(events: DataFrame, value: Column, window: str = "5 minutes") -> DataFrame:
    """Cumulative histogram buckets per window; the last, unbounded one has le = infinity."""
    wide = events.groupBy(F.window("ts", window)["start"].alias("window_start")).agg(
        *[F.count_if(value <= le).alias(f"b{i}") for i, le in enumerate(COUNTER_BUCKETS)],
        F.count(value).alias("total"),
    )
    rows = F.array(
        *[F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("cumulative"))
          for i, le in enumerate(COUNTER_BUCKETS)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("cumulative")),
    )
    return wide.select("window_start", F.inline(rows))


def histogram_quantile(buckets: DataFrame, q: float, series: list[str]) -> DataFrame:
    """Quantile read from cumulative buckets by linear interpolation.

    In the unbounded bucket the greatest finite bound is the answer. A window holds one row per
    bucket, a fixed few.
    """
    within = W.partitionBy(*series)
    order = within.orderBy("le")
    ranked = buckets.withColumns({
        "total": F.max("cumulative").over(within),
        "low": F.lag("le", 1, 0.0).over(order),
        "below": F.lag("cumulative", 1, 0).over(order),
    })
    rank = F.lit(q) * F.col("total")
    first = (
        ranked.filter((F.col("total") > 0) & (F.col("cumulative") >= rank))
        .groupBy(*series)
        .agg(F.min_by(F.struct("le", "low", "below", "cumulative", "total"), "le").alias("b"))
    )
    b = F.col("b")
    into = (F.lit(q) * b.total - b.below) / (b.cumulative - b.below)
    return first.select(
        *series,
        F.when(b.le == float("inf"), b.low).otherwise(b.low + (b.le - b.low) * into)
        .alias("quantile"),
    )


def partition_totals(events: DataFrame, committed: Column, partitions: int = 3) -> DataFrame:
    """Running totals of produced and committed records per topic partition and minute. Numbers
    are dealt by their value, other ids by a hash.

    The window runs over one row per minute of a partition.
    """
    counts = events.groupBy(
        text.topic_of(F.col("event_type")).alias("topic"),
        F.pmod(F.coalesce(F.col("event_uuid").try_cast("bigint"), F.xxhash64("event_uuid")),
               F.lit(partitions)).cast("int").alias("partition"),
        F.date_trunc("minute", "ts").alias("ts"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(committed).alias("c"))
    so_far = W.partitionBy("topic", "partition").orderBy("ts").rowsBetween(
        W.unboundedPreceding, 0)
    return counts.select(
        "topic", "partition", "ts", F.sum("n").over(so_far).alias("produced"),
        F.sum("c").over(so_far).alias("committed"))


def consumer_lag(totals: DataFrame, series: list[str], limit: int = C.LAG_LIMIT,
                 growth_limit: int = C.LAG_GROWTH_LIMIT) -> DataFrame:
    """Lag of each topic partition per minute, its growth since the sample before, and the alarm.

    A minute without a commit sample (null) keeps the total before it.
    """
    order = W.partitionBy(*series).orderBy("ts")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    lag = F.col("produced") - F.coalesce(
        F.last("committed", ignorenulls=True).over(so_far), F.lit(0))
    return (
        totals.withColumn("lag", lag)
        .withColumn("growth", F.col("lag") - F.lag("lag").over(order))
        .select(*series, F.col("ts").alias("minute"), "lag", "growth",
                ((F.col("lag") > limit) | (F.coalesce("growth", F.lit(0)) > growth_limit))
                .alias("alarm"))
    )


def gauge_alarm(samples: DataFrame, window: str = "5 minutes",
                limit: float = C.DLQ_LIMIT) -> DataFrame:
    """Mean of a gauge per window and whether it is above the limit."""
    return (
        samples.groupBy(F.window("ts", window)["start"].alias("window_start"))
        .agg(exact.mean(F.col("value").cast("double")).alias("mean_value"))
        .withColumn("alarm", F.col("mean_value") > limit)
    )


def arrivals_alarm(events: DataFrame, window: str = "1 hour", limit: int = C.DLQ_LIMIT):
    """The other reading of the same limit: dead letters that came in within a window."""
    return (
        events.groupBy(F.window("ts", window)["start"].alias("window_start"))
        .agg(F.count(F.lit(1)).alias("letters"))
        .withColumn("alarm", F.col("letters") > limit)
    )


#: Bins per factor of e by which a percentile's place is narrowed down; 1e12 takes some 7,000.
PERCENTILE_BINS = 256


def latency_p95(events: DataFrame, value: Column, keys: list[str], limit: float,
                q: float = 0.95) -> DataFrame:
    """Exact percentile per key, interpolated between neighbouring values.

    Equal values are counted first, then values per bin of a fixed logarithmic scale. Sums over a
    key's bins tell which of them hold the wanted ranks, and only the values of these are put in
    order: no task holds all values of a key.
    """
    x = F.col("latency")
    scale = F.floor(F.signum(x) * F.log1p(F.abs(x)) * PERCENTILE_BINS).cast("long")
    counts = events.groupBy(*keys, value.alias("latency")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("bin", scale)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    key = W.partitionBy(*keys)
    valued = F.when(F.col("bin").isNotNull(), F.col("n"))
    so_far = key.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    ranks = bins.withColumns({
        "n_requests": F.sum("n").over(key), "rank": (F.sum(valued).over(key) - 1) * F.lit(q),
        "before": F.coalesce(F.sum(valued).over(so_far), F.lit(0)),
    })

    def holds(rank: Column) -> Column:
        return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

    low, high = F.floor("rank"), F.ceil("rank")
    wanted = ranks.filter(F.col("bin").isNotNull() & (holds(low) | holds(high))).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("bin").alias("_bin"),
        "n_requests", "rank", F.col("before").alias("_before"))
    same = F.col("bin") == F.col("_bin")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "bin").orderBy("latency").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.join(wanted, same).withColumn(
        "before", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ends = placed.groupBy(*keys).agg(
        F.max(F.when(holds(low), x)).alias("low"), F.max(F.when(holds(high), x)).alias("high"),
        F.max("n_requests").alias("n_requests"), F.max("rank").alias("rank"))
    return ends.select(
        *keys, (F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - low)).alias("p95"),
        "n_requests").withColumn("alarm", F.col("p95") > limit)


#: Size of a sketch, and the error of its ranks that it stays within (some 7 standard deviations).
SKETCH_K = 400
RANK_ERROR = 0.02


def latency_sketches(events: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """A quantile sketch of the values of each key and minute, formed in the tasks that read them;
    what is kept of the events for reports over any longer span. Nulls count nowhere."""
    return events.select(*keys, "ts", value.cast("double").alias("x")).filter("x IS NOT NULL").groupBy(
        *keys, F.date_trunc("minute", "ts").alias("start")).agg(
            F.kll_sketch_agg_double("x", SKETCH_K).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str], span: str) -> DataFrame:
    """Sketches of longer spans merged from shorter ones, without the values."""
    return sketches.groupBy(*keys, F.window("start", span)["start"].alias("start")).agg(
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def sketch_report(sketches: DataFrame, keys: list[str], limit: float, q: float = 0.95) -> DataFrame:
    """Percentile, count and alarm per key and span. The alarm is `over` or `under` where the limit
    is passed, or kept, at both ends of what the percentile may be, and `open` between them."""
    at = lambda r: F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(r, 0.0), 1.0)))
    return sketches.select(
        *keys, "start", at(q).alias("quantile"), F.kll_sketch_get_n_double("sketch").alias("n"),
        F.when(at(q - RANK_ERROR) > limit, "over").when(at(q + RANK_ERROR) <= limit, "under")
        .otherwise("open").alias("alarm"))


def sketch_check(events: DataFrame, value: Column, report: DataFrame, keys: list[str], span: str,
                 q: float = 0.95) -> DataFrame:
    """Per key and span of a report: how many values there are, and whether the reported percentile's
    true rank is within the error that sketches promise."""
    x, quantile, n = F.col("x"), F.col("quantile"), F.count(F.lit(1))
    rows = events.select(*keys, F.window("ts", span)["start"].alias("start"),
                         value.cast("double").alias("x")).filter("x IS NOT NULL")
    # equal values take one row, so a busy key spreads and shrinks before it meets its report
    counts = rows.groupBy(*keys, "start", "x").agg(n.alias("copies"))
    of = report.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_start"), "quantile")
    same = F.col("start") == F.col("_start")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    share = lambda which: F.sum(F.when(which, F.col("copies")).otherwise(0)) / F.sum("copies")
    return counts.join(of, same).groupBy(*keys, "start").agg(
        F.sum("copies").alias("n"),
        ((share(x < quantile) <= q + RANK_ERROR) & (share(x <= quantile) >= q - RANK_ERROR))
        .alias("within"))


def success_rate(runs: DataFrame, key: str = "event_type") -> DataFrame:
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("succeeded"),
    ).withColumn("rate", F.col("succeeded") / F.col("runs"))


def data_drift(events: DataFrame, split: Column, readings: dict[str, tuple[float, float]],
               bins: int = 10) -> DataFrame:
    """Compare readings before and after a point in time: means, spreads, null rates and the
    population stability index over fixed equal bins.

    One pass: rows are reduced to counts per reading, period and bin.
    """
    period = F.when(split, "after").otherwise("before")
    items = F.array(*[
        F.struct(
            F.lit(name).alias("reading"), F.col(name).alias("x"),
            F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(
                (F.col(name) - F.lit(low)) * bins / F.lit(high - low)))).cast("int").alias("bin"),
        ) for name, (low, high) in readings.items()
    ])
    x = F.col("x")
    binned = (
        events.select(period.alias("period"), F.inline(items))
        .groupBy("reading", "period", F.when(F.col("x").isNotNull(), F.col("bin")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.count(x).alias("nn"),
             F.sum(x * x).alias("ss"))
    )
    after, before = F.col("period") == "after", F.col("period") == "before"
    per_bin = binned.groupBy("reading", "bin").agg(
        *[F.coalesce(F.sum(F.when(p, F.col(c))), F.lit(0)).alias(f"{c}_{t}")
          for t, p in (("a", after), ("b", before)) for c in ("n", "s", "nn", "ss")])
    whole = W.partitionBy("reading")
    floor_share = 1e-4
    shares = per_bin.withColumns({
        "pa": F.greatest(F.col("nn_a") / F.sum("nn_a").over(whole), F.lit(floor_share)),
        "pb": F.greatest(F.col("nn_b") / F.sum("nn_b").over(whole), F.lit(floor_share)),
    })
    psi = F.when(F.col("bin").isNotNull(),
                 (F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb")))

    def total(c: str) -> Column:
        return F.sum(c)

    def mean(t: str) -> Column:
        return exact.mean_of(total(f"s_{t}"), total(f"nn_{t}"))

    def deviation(t: str) -> Column:
        n, s, ss = total(f"nn_{t}"), total(f"s_{t}"), total(f"ss_{t}")
        m = s.cast("double") / n.cast("double")
        spread_sq = ss.cast("double") / n.cast("double") - m * m
        return F.sqrt(F.greatest(spread_sq, F.lit(0.0)))

    return shares.groupBy("reading").agg(
        mean("b").alias("mean_before"), mean("a").alias("mean_after"),
        deviation("b").alias("stddev_before"), deviation("a").alias("stddev_after"),
        (F.lit(1.0) - total("nn_b") / total("n_b")).alias("null_rate_before"),
        (F.lit(1.0) - total("nn_a") / total("n_a")).alias("null_rate_after"),
        F.sum(psi).alias("psi"),
    )
