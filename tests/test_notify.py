from __future__ import annotations

from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import text
from furrow.operators import notify
from helpers import T0, contact_rows, message_rows

HINDI = ("FARM-7", "+910000000007", "hi", "sms")


def translated(spark, message, language):
    df = spark.createDataFrame([(message, language)], "m string, l string")
    return df.select(text.translation(F.col("m"), F.col("l"))).first()[0]


def test_translation(spark):
    hi, bn = C.PHRASES["hi"], C.PHRASES["bn"]
    assert translated(spark, "Irrigation and pest", "hi") == hi["irrigation_needed"]
    assert translated(spark, "Pest before weather", "hi") == hi["pest_detected"]
    assert translated(spark, "IRRIGATION", "bn") == bn["irrigation_needed"]
    assert translated(spark, "bad weather", "bn") == bn["weather_alert"]
    assert translated(spark, "pest", "ta") == "pest"
    assert translated(spark, "hello", "hi") == "hello"


def test_english_is_left_alone(spark):
    rows = notify.translate(notify.with_contact(
        message_rows(spark, {"message_en": "Irrigation needed immediately"}),
        contact_rows(spark, ("FARM-7", "1", "en", "sms")))).collect()
    assert rows[0].message_local is None and rows[0].message_en == "Irrigation needed immediately"


def test_display_text(spark):
    shown = message_rows(spark, {}).select(text.display_message(
        F.col("plot_id"), F.col("alert_type"), F.col("severity"), F.col("message_en"))).first()[0]
    assert shown == (
        "🆘 *कृषि सतर्कता | Agricultural Alert*\n\n📍 Plot: WB_123_45\n"
        "🔔 Type: Low Soil Moisture\n⚡ Severity: CRITICAL\n\n"
        "📝 Roots find no water\n\n💡 Recommendation: Take immediate action.\n")
    odd = message_rows(spark, {"severity": "urgent"}).select(text.display_message(
        F.col("plot_id"), F.col("alert_type"), F.col("severity"), F.col("message_en"))).first()[0]
    assert odd.startswith("⚠️ ")


def test_local_text_is_appended(spark):
    out = notify.outbox(
        message_rows(spark, {"message_en": "Irrigation recommended within 24 hours."},
                     {"alert_id": "b", "message_en": "Nothing known"},
                     {"alert_id": "c", "message_local": ""}),
        contact_rows(spark, HINDI))
    bodies = {r.alert_id: r.body for r in out.collect()}
    assert bodies["first-alert"].endswith("action.\n\n\n" + C.PHRASES["hi"]["irrigation_needed"])
    assert bodies["b"].endswith("action.\n\n\nNothing known")
    assert bodies["c"].endswith("action.\n")


def test_channels(spark):
    out = notify.outbox(
        message_rows(
            spark, {"alert_id": "empty", "channel": ""}, {"alert_id": "mail", "channel": "email"},
            {"alert_id": "call", "channel": "voice_call"}, {"alert_id": "plain"},
            {"alert_id": "lost", "channel": None, "farmer_id": "nobody"}),
        contact_rows(spark, HINDI))
    rows = {r.alert_id: r for r in out.collect()}
    assert {k: r.route for k, r in rows.items()} == {
        "empty": "sms", "mail": "sns", "call": "voice_call", "plain": "whatsapp",
        "lost": "whatsapp"}
    assert rows["mail"].subject == "Agri Alert: low_soil_moisture"
    assert rows["call"].body is None and rows["call"].message_id.startswith("voice_")
    assert rows["empty"].body == "Alert: low_soil_moisture. Roots find no water"
    assert rows["lost"].phone == ""


def test_sms_counts_code_points(spark):
    message = "सू🌾" * 50
    out = notify.outbox(
        message_rows(spark, {"channel": "sms", "message_en": message}), contact_rows(spark, HINDI))
    assert out.first().body == "Alert: low_soil_moisture. " + message[:100]


def attempt_rows(spark, *rows):
    return spark.createDataFrame(
        [(a, ok, None, "sms", None if ok else "down", n, T0, f'{{"alert_id": "{a}", "body": "text"}}')
         for a, ok, n in rows], C.ATTEMPT_DDL)


def test_retry_keeps_one_letter_per_alert(spark):
    letters = notify.failed(attempt_rows(spark, ("a", False, 1), ("b", False, 1), ("c", True, 1)))
    outcome = notify.retry(letters, attempt_rows(spark, ("a", False, 2), ("b", True, 2)))
    left = notify.still_failing(outcome).collect()
    assert [(r.alert_id, r.attempts) for r in left] == [("a", 2)]
    assert {(r.alert_id, r.body, r.attempts) for r in notify.resendable(letters).collect()} == {
        ("a", "text", 1), ("b", "text", 1)}
    twice = notify.failed(attempt_rows(spark, ("a", False, 1), ("a", False, 2)))
    assert [(r.alert_id, r.attempts) for r in twice.collect()] == [("a", 2)]


def test_bulk_summary(spark):
    rows = notify.delivery_summary(attempt_rows(
        spark, ("a", True, 1), ("b", False, 1), ("c", True, 1))).collect()
    assert [(r.succeeded, r.total) for r in rows] == [(2, 3)]


def test_ids(spark):
    df = spark.createDataFrame([("UP_789_12", "Heavy rain forecasted"),
                                ("UP_789_12", "Heavy hail forecasted")], "p string, m string")
    rows = df.select(
        text.length_id("alert", F.col("p"), F.col("m")).alias("old"),
        text.alert_id(F.col("p"), F.lit("weather_alert"), F.lit(T0), F.col("m")).alias("new"),
    ).collect()
    assert [r.old for r in rows] == ["alert_UP_789_12_21"] * 2
    assert rows[0].new != rows[1].new


def test_message_defaults(spark):
    alerts = spark.createDataFrame(
        [("WB_123_45", T0, "pest_sighting", None, "Pest detected in crop")],
        "plot_id string, window_end timestamp, alert_type string, severity string, message string")
    plots = spark.createDataFrame([("WB_123_45", "F1")], "plot_id string, farmer_id string")
    row = notify.to_messages(alerts, plots).first()
    assert (row.channel, row.language, row.severity, row.farmer_id, row.metadata) == (
        "whatsapp", "en", "medium", "F1", {})
    served = notify.to_serving(notify.to_messages(alerts, plots)).first()
    assert served.message == "Pest detected in crop" and served.acknowledged is False
