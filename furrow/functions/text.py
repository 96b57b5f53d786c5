"""Text expressions: lookups, messages, ids."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow import contracts as C


def lookup(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value for a key in a small fixed table, else the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hit = F.try_element_at(pairs, key)
    return hit if default is None else F.coalesce(hit, default)


def topic_of(event_type: Column) -> Column:
    return lookup(event_type, C.TOPICS, F.lit(C.TOPIC_OTHER))


def title_words(snake: Column) -> Column:
    return F.initcap(F.replace(snake, F.lit("_"), F.lit(" ")))


def translation(message: Column, language: Column) -> Column:
    """Stock phrase in the wanted language for the first keyword found, else the message."""
    folded = F.lower(message)
    phrase = F.lit(None).cast("string")
    for word, key in reversed(C.PHRASE_KEYWORDS):
        phrase = F.when(folded.contains(word), F.lit(key)).otherwise(phrase)
    flat = {
        f"{lang}/{key}": text for lang, known in C.PHRASES.items() for key, text in known.items()
    }
    return lookup(F.concat_ws("/", language, phrase), flat, message)


def fill(template: str, **columns: Column) -> Column:
    """A text with named gaps filled by columns; null when one of them is null."""
    parts = []
    for words, gap, _, _ in Formatter().parse(template):
        if words:
            parts.append(F.lit(words))
        if gap:
            parts.append(columns[gap])
    return F.concat(*parts)


def display_message(plot: Column, alert_type: Column, severity: Column, message: Column) -> Column:
    """The text shown to a farmer; its header is always bilingual."""
    return fill(
        C.DISPLAY_TEXT, emoji=lookup(severity, C.SEVERITY_EMOJI, F.lit(C.EMOJI_OTHER)),
        plot=plot, type=title_words(alert_type), severity=F.upper(severity), message=message)


def sms_body(alert_type: Column, message: Column) -> Column:
    return fill(C.SMS_TEXT, type=alert_type, message=F.substring(message, 1, C.SMS_BODY_CHARS))


def topic_subject(alert_type: Column) -> Column:
    return fill(C.SUBJECT_TEXT, type=alert_type)


def alert_id(plot: Column, alert_type: Column, ts: Column, message: Column) -> Column:
    return F.sha2(F.concat_ws("|", plot, alert_type, ts.cast("string"), message), 256)


def length_id(prefix: str, plot: Column, message: Column) -> Column:
    """The older id form; two messages of one length on one plot share it."""
    return F.concat_ws("_", F.lit(prefix), plot, F.length(message).cast("string"))
