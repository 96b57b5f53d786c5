"""From alerts to outgoing messages, delivery results, dead letters and their retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import text


def to_messages(alerts: DataFrame, plots: DataFrame) -> DataFrame:
    """Window alerts as notification messages.

    The plot table supplies the farmer; what an alert does not carry takes its default.
    """
    given = set(alerts.columns)

    def or_default(name: str, default: str):
        return F.coalesce(F.col(name), F.lit(default)) if name in given else F.lit(default)

    shaped = alerts.select(
        text.alert_id(F.col("plot_id"), F.col("alert_type"), F.col("window_end"),
                      F.col("message")).alias("alert_id"),
        "plot_id", "alert_type",
        or_default("severity", C.DEFAULT_SEVERITY).alias("severity"),
        F.col("message").alias("message_en"),
        F.lit(None).cast("string").alias("message_local"),
        or_default("language", C.DEFAULT_LANGUAGE).alias("language"),
        or_default("channel", C.DEFAULT_CHANNEL).alias("channel"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("window_end").alias("ts"),
    )
    owners = plots.select("plot_id", "farmer_id")
    return shaped.join(owners, "plot_id", "left")


def to_serving(messages: DataFrame) -> DataFrame:
    """Notification messages in the form the alert reads serve."""
    return messages.select(
        "alert_id", "plot_id", "alert_type", "severity", F.col("message_en").alias("message"),
        F.col("ts").alias("timestamp"), F.lit(False).alias("acknowledged"),
    )


def with_contact(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Add the farmer's contact; without one the language and phone take their defaults.

    No hint: the contact table grows with the farmers, so its size at run time decides between a
    broadcast and a shuffle, and a farmer with very many alerts is split by the skew join.
    """
    known = contacts.select("farmer_id", "phone", "preferred_language", "preferred_channel")
    joined = messages.join(known, "farmer_id", "left")
    return joined.withColumns({
        "phone": F.coalesce("phone", F.lit("")),
        "preferred_language": F.coalesce("preferred_language", F.lit(C.DEFAULT_LANGUAGE)),
        "preferred_channel": F.coalesce("preferred_channel", F.lit(C.DEFAULT_CHANNEL)),
    })


def translate(messages: DataFrame) -> DataFrame:
    """Fill the local text where the farmer reads another language and none is given.

    The contact's language decides; the message's own language field plays no part.
    """
    wanted = (F.col("preferred_language") != C.DEFAULT_LANGUAGE) & F.col("message_local").isNull()
    return messages.withColumn(
        "message_local",
        F.when(wanted, text.translation(F.col("message_en"), F.col("preferred_language")))
         .otherwise(F.col("message_local")),
    )


def compose(messages: DataFrame) -> DataFrame:
    """Display text with the local text appended when there is one."""
    shown = text.display_message(
        F.col("plot_id"), F.col("alert_type"), F.col("severity"), F.col("message_en"))
    local = F.coalesce("message_local", F.lit(""))
    tail = F.when(local != "", text.fill(C.LOCAL_TEXT, text=local)).otherwise("")
    return messages.withColumn("display", F.concat(shown, tail))


def route(messages: DataFrame) -> DataFrame:
    """Choose the route; an empty channel falls back to the contact's, an unknown one (an empty
    one of the contact's too) is published to the topic."""
    channel = F.coalesce(
        F.nullif(F.col("channel"), F.lit("")), F.col("preferred_channel"), F.lit(C.DEFAULT_CHANNEL),
    )
    return messages.withColumn("wanted", channel).withColumns({
        "route": F.when(F.col("wanted").isin(C.CHANNELS), F.col("wanted")).otherwise("sns"),
        "body": F.when(F.col("wanted") == "sms",
                       text.sms_body(F.col("alert_type"), F.col("message_en")))
                 .when(F.col("wanted") != "voice_call", F.col("display")),
        "subject": F.when(~F.col("wanted").isin(C.CHANNELS),
                          text.topic_subject(F.col("alert_type"))),
    }).drop("wanted")


def outbox(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """One outgoing message per alert. Ids are hashes of what is sent (for a voice call, of the
    alert id), so a replay produces the same ids."""
    ready = route(compose(translate(with_contact(messages, contacts))))
    prefix = text.lookup(F.col("route"), C.DELIVERY_PREFIXES)
    return ready.select(
        "alert_id", "route", "phone", "subject", "body",
        F.concat(prefix, F.sha2(F.coalesce("body", "alert_id"), 256)).alias("message_id"),
        "ts",
    )


#: What a dead letter holds of the message it could not deliver.
LETTER_DDL = "alert_id string, route string, phone string, subject string, body string"


def letter_payload() -> Column:
    """An outbox row as the text a dead letter keeps."""
    return F.to_json(F.struct("alert_id", "route", "phone", "subject", "body"))


def resendable(letters: DataFrame) -> DataFrame:
    """The messages of failed deliveries, from the letters alone."""
    return letters.select(F.from_json("payload", LETTER_DDL).alias("m"), "attempts").select(
        "m.*", "attempts")


def delivery_summary(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("channel").agg(
        F.count_if(F.col("success")).alias("succeeded"), F.count(F.lit(1)).alias("total"))


def failed(attempts: DataFrame) -> DataFrame:
    """Dead letters of failed deliveries: one row per alert however often it failed."""
    return (
        attempts.filter(~F.col("success")).groupBy("alert_id")
        .agg(F.max_by("error", F.struct("attempt", "ts")).alias("error"),
             F.max("attempt").cast("int").alias("attempts"), F.max("ts").alias("ts"),
             F.max("payload").alias("payload"))
    )


def dead_letters(attempts: DataFrame, poison: DataFrame) -> DataFrame:
    """Both kinds of dead letter: failed deliveries and records that cannot be decoded."""
    deliveries = failed(attempts).select(
        F.lit("delivery").alias("kind"), F.col("alert_id").alias("ref"), "error", "attempts", "ts",
        "payload",
    )
    records = poison.select(
        F.lit("record").alias("kind"), F.col("record_id").alias("ref"),
        F.lit("undecodable").alias("error"), F.lit(0).alias("attempts"),
        F.col("received").alias("ts"), F.col("bad_record").alias("payload"),
    )
    return deliveries.unionByName(records)


def retry(letters: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of one replay of the failed deliveries.

    Recovered letters leave the queue; the others stay, once each, with one attempt more.
    `results` holds the new attempts.
    """
    again = results.groupBy("alert_id").agg(F.bool_or("success").alias("recovered"))
    return letters.join(again, "alert_id", "left").select(
        "alert_id",
        F.coalesce("recovered", F.lit(False)).alias("recovered"),
        (F.col("attempts") + F.when(F.col("recovered").isNotNull(), 1).otherwise(0))
        .alias("attempts"),
    )


def still_failing(outcome: DataFrame) -> DataFrame:
    return outcome.filter(~F.col("recovered")).drop("recovered")
