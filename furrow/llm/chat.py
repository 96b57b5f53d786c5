"""Chats in reply order, by linking quotations.

Lines that begin with `>` are quoted, as many levels deep as there are marks. A message's quoted
passages are cut into sentences, normalised (words in lower case, no marks) and hashed, each by
itself and all of a passage together, and so is what messages say themselves. A quoted sentence or
passage belongs to the latest earlier message of its conversation that says it. A message replies to
the one that most of its outermost quotes belong to: long ones count first, then the letters of all
(ties: the later one). If none of these is found, deeper levels are asked, outermost first. A message that quotes nobody follows the turn before it, whatever numbers are missing between them.
One whose quotes nobody before said does so only if no number is missing: else what it quotes may
be gone, and it begins a thread. Replies form threads; within one, messages stand in the order of
turns, every reply after what it replies to, without their quotes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common
from furrow.session import broadcast_if_small

#: Sentences of so many words or letters are long: shorter ones say less of whose they are. Letters
#: tell in scripts that put no blanks between words.
MIN_WORDS = 3
MIN_LETTERS = 12
MAX_BROADCAST_CONVERSATIONS = 1_000_000
UNIT_DDL = "conv_id long, turn long, level int, hash long, letters int, long boolean, sentence boolean"

_MARKS = re.compile(r"^(?:[ \t]?>)+[ \t]?")
_SENTENCE = re.compile(r"[^.!?。！？｡।॥؟۔።]+")
_WORD = re.compile(r"\w+")


def levels(text: str) -> list[tuple[int, str]]:
    """Each line's quote level and what follows its marks. A line that announces a quote (`...
    wrote:`) belongs to it."""
    out: list[tuple[int, str]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        out.append((marks[0].count(">"), line[marks.end():]) if marks else (0, line))
    for i in range(len(out) - 1):
        level, line = out[i]
        if out[i + 1][0] > level and line.rstrip().endswith("wrote:"):
            out[i] = (out[i + 1][0], "")
    return out


def own_text(text: str) -> str:
    """A message without its quotes and the blank lines around them."""
    if ">" not in text:
        return text
    lines = levels(text)
    if not any(level for level, _ in lines):
        return text
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line for level, line in lines if not level)).strip("\n")


def passages(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one level, a blank apart: quotes may be wrapped anew, or a line be one."""
    out: list[tuple[int, list[str]]] = []
    for level, line in levels(text):
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, part) for level, lines in out for part in {" ".join(lines), *lines}]


def units(text: str) -> dict[tuple[int, int], tuple[int, bool, bool]]:
    """Levels and hashes of a message's sentences and of its passages of several, each with its
    letters, whether it is long, and whether it is a sentence."""
    found: dict[tuple[int, int], tuple[int, bool, bool]] = {}
    for level, passage in passages(text):
        sentences = [words for part in _SENTENCE.findall(passage) if (words := _WORD.findall(part.lower()))]
        whole = [word for words in sentences for word in words]
        for words in ([whole] if len(sentences) > 1 else []) + sentences:
            raw = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8)
            key = (level, int.from_bytes(raw.digest(), "little", signed=True))
            letters = sum(map(len, words))
            sentence = words is not whole or found.get(key, (0, False, False))[2]
            found[key] = letters, len(words) >= MIN_WORDS or letters >= MIN_LETTERS, sentence
    return found


def _units_of(messages: DataFrame, own: bool) -> DataFrame:
    """Sentences and passages that messages say themselves, or those that they quote."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, level, h, *about)
                    for c, t, x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "text")),
                                       strict=True)
                    if own or ">" in x for (level, h), about in units(x).items() if own == (not level)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                names=[c.split()[0] for c in UNIT_DDL.split(", ")])

    return messages.select("conv_id", "turn", "text").mapInArrow(run, UNIT_DDL)


def quoted(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, hash, letters, long, sentence of all that is quoted."""
    return common.stored(_units_of(messages, own=False).filter(
        "conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", "level", "hash").agg(
            F.max("letters").alias("letters"), F.max("long").alias("long"),
            F.max("sentence").alias("sentence")), "quotes")


def quotations(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, turn, level, original (turn), long (quotes), letters, sentences: who quotes whom, and
    how much. Where a passage alone is found, it counts as one sentence.

    A quoted sentence is never joined with all who say it: quotes and sayings stand in the order of
    turns, and each quote sees the last saying before it.
    """
    concerned = broadcast_if_small(
        quotes.select("conv_id").distinct(), MAX_BROADCAST_CONVERSATIONS)
    says = _units_of(messages.join(concerned, "conv_id", "left_semi"), own=True)
    said = says.select("conv_id", "hash", "turn").distinct().select(
        "*", F.lit(0).alias("level"), F.lit(0).alias("letters"), F.lit(False).alias("long"),
        F.lit(False).alias("sentence"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(
        Window.unboundedPreceding, -1)
    return said.unionByName(quotes).withColumn(
        "original", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)) \
        .filter("level > 0 AND original IS NOT NULL") \
        .groupBy("conv_id", "turn", "level", "original").agg(
            F.count_if("long").alias("long"), F.sum("letters").alias("letters"),
            F.greatest(F.count_if("sentence"), F.lit(1).cast("long")).alias("sentences"))


def preceding(turns: DataFrame) -> DataFrame:
    """Adds last: the greatest smaller turn of the conversation (null: there is none).

    Turns are sorted over all tasks, so a long conversation lies in many. The first turn of a part
    follows the last one of the part before it, of which a table has one row per part.
    """
    parts = common.stored(turns.select("conv_id", "turn").repartitionByRange("conv_id", "turn").select(
        "*", F.spark_partition_id().alias("part")), "turns")
    whole = F.struct("conv_id", "turn")
    ends = parts.groupBy("part").agg(F.max(whole).alias("end")).select(
        F.col("part"), F.lag("end").over(Window.orderBy("part")).alias("before"))
    within = Window.partitionBy("part", "conv_id").orderBy("turn")
    return parts.withColumn("last", F.lag("turn").over(within)).join(F.broadcast(ends), "part").select(
        "conv_id", "turn", F.coalesce("last", F.when(
            F.col("before.conv_id") == F.col("conv_id"), F.col("before.turn"))).alias("last"))


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent (null: begins a thread), sentences that tell so; one row per turn."""
    quotes = quoted(messages)
    best = quotations(messages, quotes).groupBy("conv_id", "turn").agg(F.max(F.struct(
        (-F.col("level")).alias("near"), "long", "letters", "original", "sentences")).alias("best"))
    quoting = quotes.select("conv_id", "turn", F.lit(True).alias("quoting")).distinct()
    turns = messages.select("conv_id", "turn").filter(
        "conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    follows = F.col("quoting").isNull() | (F.col("last") == F.col("turn") - 1)
    return preceding(turns).join(best, ["conv_id", "turn"], "left").join(
        quoting, ["conv_id", "turn"], "left").select(
            "conv_id", "turn",
            F.coalesce("best.original", F.when(follows, F.col("last"))).alias("parent"),
            F.coalesce("best.sentences", F.lit(0).cast("long")).alias("sentences"))


def threads(links: DataFrame) -> DataFrame:
    """Adds thread (the turn that begins it) and depth, by doubling the way up until all are there."""
    start = links.select(
        "*", F.coalesce("parent", "turn").alias("thread"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    at = common.stored(start, "threads")
    there, going = at.filter("depth = 0"), at.filter("depth > 0")
    while not going.isEmpty():
        above = there.unionByName(going).select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("further"),
            F.col("depth").alias("more"))
        then = common.stored(going.join(above, ["conv_id", "thread"]).select(
            "conv_id", "turn", "parent", "sentences", F.col("further").alias("thread"),
            (F.col("depth") + F.col("more")).alias("depth"), "more"), "threads")
        # whoever stood below a thread's first message has arrived and takes no part any more
        there = there.unionByName(then.filter("more = 0").drop("more"))
        going = then.filter("more > 0").drop("more")
    return there


def reply_order(
    chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, thread, turn, parent, depth, role, text without quotes, n_quoted (sentences that
    link it to its parent). Order: conv_id, thread, turn.

    A null text counts as empty. Rows without a conversation or turn are threads of their own, depth
    0. Rows of one conversation and turn are one message of several texts: each keeps its row, and
    what any of them quotes links all. Marks inside a line, and quotes that nobody before said, link
    nothing. An empty table gives no rows; other columns are ignored.
    """
    messages = chats.select(
        common.col(conv_col).cast("long").alias("conv_id"), common.col(turn_col).cast("long").alias("turn"),
        common.col(role_col).alias("role"), F.coalesce(common.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("string")
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(own_text)

    places = threads(parents(messages))
    text = F.when(F.contains("text", F.lit(">")), stripped("text")).otherwise(F.col("text"))
    return messages.join(places, ["conv_id", "turn"], "left").select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", "parent",
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "role", text.alias("text"),
        F.coalesce("sentences", F.lit(0).cast("long")).alias("n_quoted"))
