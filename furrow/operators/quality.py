"""Data-quality rules: each is one boolean column, all of a table are judged in one pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow import contracts as C
from furrow.operators.events import once

REQUIRED = ["event_uuid", "event_type", "ts"]


def required_rules() -> dict[str, Column]:
    """Rule name -> broken? A market event needs its crop, any other its plot."""
    rules = {f"required:{c}": F.col(c).isNull() for c in REQUIRED}
    rules["required:plot_id|crop"] = F.when(
        F.col("event_type") == C.MARKET, F.col("crop").isNull()
    ).otherwise(F.col("plot_id").isNull())
    return rules


def range_rules(columns: list[str]) -> dict[str, Column]:
    out = {}
    for kind, ranges in C.RANGES.items():
        for reading, (low, high) in ranges.items():
            if reading in columns:
                out[f"range:{kind}.{reading}"] = (
                    (F.col("event_type") == kind) & ~F.col(reading).between(low, high))
    return out


def membership_rules(columns: list[str]) -> dict[str, Column]:
    out = {}
    for kind, fields in C.MEMBERSHIP.items():
        for field, allowed in fields.items():
            if field in columns:
                out[f"member:{kind}.{field}"] = (
                    (F.col("event_type") == kind) & ~F.col(field).isin(allowed))
    return out


def health_rules() -> dict[str, Column]:
    """The served health score, where there is one, lies within its range."""
    return {"range:health_score": ~F.col("health_score").between(*C.HEALTH_SCORE_RANGE)}


def all_rules(columns: list[str]) -> dict[str, Column]:
    return {**required_rules(), **range_rules(columns), **membership_rules(columns)}


def tally(events: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows checked and rows failing per rule: one wide aggregate, turned into rows."""
    names = list(rules)
    wide = events.agg(
        F.count(F.lit(1)).alias("checked"),
        *[F.count_if(F.coalesce(broken, F.lit(False))).alias(f"r{i}")
          for i, broken in enumerate(rules.values())],
    )
    per_rule = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failed"))
        for i, name in enumerate(names)
    ])
    return wide.select("checked", F.inline(per_rule)).select("rule", "checked", "failed")


def range_report(events: DataFrame) -> DataFrame:
    return tally(events, range_rules(events.columns))


def membership_report(events: DataFrame) -> DataFrame:
    return tally(events, membership_rules(events.columns))


def summary(events: DataFrame) -> DataFrame:
    """Every rule with its verdict."""
    return tally(events, all_rules(events.columns)).withColumn("passed", F.col("failed") == 0)


def run_verdict(summary_rows: DataFrame) -> DataFrame:
    """One row per run: rules run and rules passed."""
    return summary_rows.agg(
        F.count(F.lit(1)).alias("expectations_run"), F.count_if("passed").alias("passed"))


def repeated_ids(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once."""
    return (
        events.groupBy("event_uuid").agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def with_reasons(events: DataFrame) -> DataFrame:
    """Add the names of the rules each row breaks; the list is only put together for rows that
    break one."""
    rules = all_rules(events.columns)
    any_broken = reduce(or_, [F.coalesce(b, F.lit(False)) for b in rules.values()])
    names = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in rules.items()]))
    return events.withColumn(
        "reasons", F.when(any_broken, names).otherwise(F.array().cast("array<string>")))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("reasons") == 0).drop("reasons")


def quarantined(judged: DataFrame) -> DataFrame:
    return judged.filter(F.size("reasons") > 0)


def contract_drift(records: DataFrame) -> DataFrame:
    """Data keys seen per event type against the contract: missing, unknown or known.

    `records` holds the event JSON text in `value`; the counts shrink to one row per type and key
    in each task before they are shuffled.
    """
    spark = records.sparkSession
    event = F.from_json("value", C.RAW_EVENT_DDL)
    seen = (
        once(records.select("value"), "e", event).filter(F.col("e.event_type").isNotNull())
        .select(F.col("e.event_type").alias("event_type"),
                F.explode(F.json_object_keys("e.data")).alias("data_key"))
        .groupBy("event_type", "data_key").agg(F.count(F.lit(1)).alias("n"))
    )
    expected = spark.createDataFrame(
        [(t, k, True) for t, keys in C.DATA_KEYS.items() for k in keys],
        "event_type string, data_key string, expected boolean",
    )
    return (
        seen.join(expected, ["event_type", "data_key"], "full_outer")
        .select(
            "event_type", "data_key", F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("n").isNull(), "missing").when(F.col("expected").isNull(), "unknown")
            .otherwise("known").alias("state"),
        )
    )


#: Levels of keys below `data` that are told apart.
DRIFT_DEPTH = 3


def _kind(value: Column) -> Column:
    of = F.regexp_extract(F.schema_of_variant(value), "^[A-Z_]+", 0)
    return F.when(of.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(of)) \
        .when(of == "VOID", "null").otherwise("number")


def _contract_paths(fields: StructType, above: str = "") -> list[tuple[str, str]]:
    found = []
    for field in fields:
        kind = {"string": "string", "struct": "object"}.get(field.dataType.typeName(), "number")
        found.append((above + field.name, kind))
        if kind == "object":
            found += _contract_paths(field.dataType, f"{above}{field.name}.")
    return found


def typed_drift(records: DataFrame) -> DataFrame:
    """Every key below `data`, nested ones too, with its kind of value, against the contract.

    event_type, path, kind, n (records), state, change. state: `known`; `null`; `changed` (another
    kind than the contract's); `unknown` (not in the contract); `missing` (in the contract, never
    seen). Changed and missing keys break readers, unknown and null ones do not. Texts that are not
    JSON and records without an event type are counted as rows of their own, without a type. Keys
    deeper than DRIFT_DEPTH are not entered; items of arrays have the path of their array and `[]`.
    The text is parsed and read once, and each task sends one row per type, path and kind.
    """
    spark = records.sparkSession
    explode = spark.tvf.variant_explode_outer
    body = records.select(F.try_parse_json("value").alias("v")).select(
        F.col("v").isNull().alias("undecodable"),
        F.try_variant_get("v", "$.event_type", "string").alias("event_type"),
        F.try_variant_get("v", "$.data", "variant").alias("v0"))
    for level in range(1, DRIFT_DEPTH + 1):
        inner = body.lateralJoin(explode(F.col(f"v{level - 1}").outer()))
        body = inner.withColumnsRenamed({"pos": f"p{level}", "key": f"k{level}", "value": f"v{level}"})
    path, first, at = F.lit(""), F.lit(True), []
    for level in range(DRIFT_DEPTH, 0, -1):
        # a key stands in a row for each key below it, and counts in the first of them
        at.append((level, first))
        first = first & (F.coalesce(F.col(f"p{level}"), F.lit(0)) == 0)
    firsts = dict(at)
    items = []
    for level in range(1, DRIFT_DEPTH + 1):
        step = F.coalesce(F.col(f"k{level}"), F.lit("[]"))
        path = step if level == 1 else F.concat(
            path, F.when(F.col(f"k{level}").isNull(), "[]").otherwise(F.concat(F.lit("."), f"k{level}")))
        items.append(F.when(firsts[level] & F.col(f"v{level}").isNotNull(), F.struct(
            path.alias("path"), _kind(F.col(f"v{level}")).alias("kind"))))
    none = F.lit(None).cast("string").alias("path")
    lost = F.when(first, F.array(F.struct(none, F.when(F.col("undecodable"), "undecodable")
                                          .otherwise("untyped").alias("kind"))))
    seen = body.select("event_type", F.inline(F.when(
        F.col("event_type").isNull(), lost).otherwise(F.array_compact(F.array(*items))))).groupBy(
            "event_type", "path", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = dict(_contract_paths(StructType.fromDDL(C.DATA_DDL)))
    expected = spark.createDataFrame(
        [(t, p, kind) for t, keys in C.DATA_KEYS.items() for p, kind in kinds.items()
         if p.split(".")[0] in keys], "event_type string, path string, wanted string")
    state = F.when(F.col("n").isNull(), "missing") \
        .when(F.col("event_type").isNull(), F.col("kind")).when(F.col("wanted").isNull(), "unknown") \
        .when(F.col("kind").isin("null"), "null").when(F.col("kind") == F.col("wanted"), "known") \
        .otherwise("changed")
    return seen.join(expected, ["event_type", "path"], "full_outer").select(
        "event_type", "path", "kind", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state")).withColumn(
            "change", F.when(F.col("state") == "known", "none")
            .when(F.col("state").isin("unknown", "null"), "compatible").otherwise("breaking"))


def run_metrics(events: DataFrame, min_rows: int = 1) -> DataFrame:
    """Rows per run (one per event type and day) against the least number wanted."""
    return (
        events.groupBy("event_type", F.to_date("ts").cast("string").alias("run_day"))
        .agg(F.count(F.lit(1)).alias("records"),
             F.count_distinct(F.coalesce("plot_id", "crop")).alias("sources"))
        .withColumn("enough", F.col("records") >= min_rows)
    )


def _stretches(sources: DataFrame, seen: DataFrame, first: str, last: str) -> DataFrame:
    """source, first_day, last_day, days: where a source sent nothing within the period.

    sources: source; seen: source, day, a row for each day with something. A stretch lies between
    two such days or the period's ends, so there are no more than days seen and sources.
    """
    start, end = (F.lit(d).cast("date") for d in (first, last))
    ends = sources.select("source", F.date_add(end, 1).alias("day"))
    by_source = W.partitionBy("source").orderBy("day")
    return seen.join(sources, "source", "left_semi").select("source", "day").unionByName(ends) \
        .withColumn("first_day", F.coalesce(F.date_add(F.lag("day").over(by_source), 1), start)) \
        .withColumn("last_day", F.date_sub("day", 1)) \
        .withColumn("days", F.datediff("day", "first_day").cast("bigint")) \
        .filter("days > 0").select("source", "first_day", "last_day", "days")


def cadence_gaps(events: DataFrame, plots: DataFrame, first: str, last: str) -> DataFrame:
    """Where plots and crops sent less than their sources should, from the first to the last day.

    A day with too few readings is a row; days in a row without any are one row together, so a
    source that never sent is a single one. A satellite pass is due within any three days: three
    days without one miss one pass, each further day one more.
    """
    within = events.withColumn("day", F.to_date("ts")).filter(F.col("day").between(first, last))

    def gaps(sources: DataFrame, rows: DataFrame, reading: str, per_day: int) -> list[DataFrame]:
        counts = rows.filter(F.col("source").isNotNull()).groupBy("source", "day").agg(
            F.count(F.lit(1)).alias("seen"))
        name, due = F.lit(reading).alias("reading"), F.lit(per_day).cast("bigint")
        silent = _stretches(sources, counts, first, last)
        if reading == C.SATELLITE:
            idle = C.SATELLITE_EVERY_DAYS - 1
            return [silent.filter(F.col("days") > idle).select(
                "source", name, "first_day", "last_day", (F.col("days") - idle).alias("expected"),
                F.lit(0).cast("bigint").alias("seen"))]
        few = counts.join(sources, "source", "left_semi").filter(F.col("seen") < per_day)
        return [
            few.select("source", name, F.col("day").alias("first_day"), F.col("day").alias("last_day"),
                       due.alias("expected"), "seen"),
            silent.select("source", name, "first_day", "last_day", (F.col("days") * due).alias("expected"),
                          F.lit(0).cast("bigint").alias("seen")),
        ]

    fields = plots.select(F.col("plot_id").alias("source"))
    found = []
    for reading, per_day in {**C.CADENCE_PER_DAY, C.SATELLITE: 0}.items():
        found += gaps(fields, within.filter(F.col("event_type") == reading).withColumn(
            "source", F.col("plot_id")), reading, per_day)
    crops = events.sparkSession.createDataFrame([(c,) for c in C.CROPS], "source string")
    found += gaps(crops, within.filter(F.col("event_type") == C.MARKET).withColumn(
        "source", F.col("crop")), C.MARKET, C.PRICES_PER_CROP_DAY)
    return reduce(DataFrame.unionByName, found).select(
        "source", "reading", F.col("first_day").cast("string").alias("first_day"),
        F.col("last_day").cast("string").alias("last_day"), "expected", "seen",
        (F.col("expected") - F.col("seen")).alias("missing"))
