"""The conversation prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from furrow.llm import common, prefix_trie, runs

DDL = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
           "ends_sha256"]


@pytest.fixture(scope="module", autouse=True)
def configured(spark):
    common.configure(spark)


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        new = own.get(base, [])[:h] + turns[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, who in members.items():
        cost = (len(who) - 1) * len(re.findall(common.WORD, node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += cost
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -10**9, len(who), children[node], leaves[node],
         saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, who in members.items())


def ours(df):
    return sorted(tuple(-10**9 if v is None else v for v in r)
                  for r in df.select(*COLUMNS).collect())


def random_rows(seed, convs, long=0):
    rng = random.Random(seed)
    texts = ["a", "b b", "", None, "c\tc c", "é \x0b x"]
    rows = []
    for c in rng.sample(range(-45, 400), convs):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["u", "v", None]), rng.choice(texts)))
    for c in (20, 21, 27)[:3 if long else 0]:
        rows += [(c, t, "u", "a" if t < long - 5 else str(c)) for t in range(long)]
    rows += rows[:20] + [(None, 1, "u", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, long, band", [(1, 0, 16), (2, 120, 2), (3, 300, 4), (4, 70, 16)])
def test_matches_plain(spark, seed, long, band):
    rows = random_rows(seed, 150, long)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert ours(prefix_trie.trie(df, band)) == plain(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, t, "u", f"turn {t}") for t in range(500)] + [(3, 0, "u", "x"), (9, 0, "u", "y")]
    df = spark.createDataFrame(rows, DDL).select(
        "*", F.unhex(F.sha2("text", 256)).alias("digest"))
    found = runs.numbered(df, "conv_id", ["turn"], "digest")
    places = {(r.conv_id, r.turn): (r.place, bytes(r.prefix)) for r in found.collect()}
    assert all(places[7, t][0] == t + 1 for t in range(500))
    assert len({p for _, p in places.values()}) == len(rows)
    alone = runs.numbered(df.filter("turn < 100").coalesce(1), "conv_id", ["turn"], "digest")
    assert {(r.conv_id, r.turn): (r.place, bytes(r.prefix)) for r in alone.collect()}.items() <= places.items()


def test_turnless_and_equal_conversations(spark):
    # 42 borrows from 40, which is not there: its only turn is replaced by nothing
    short = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "u", "gone"), (61, 5, None, None), (62, 1, None, None)]
    assert ours(prefix_trie.trie(spark.createDataFrame(rows, DDL))) == plain(rows)


def test_empty_and_clashing_columns(spark):
    none = spark.createDataFrame([], DDL)
    assert ours(prefix_trie.trie(none)) == []
    rows = random_rows(9, 30)
    more = spark.createDataFrame(rows, DDL).withColumns(
        {c: F.lit("x") for c in ("node", "depth", "digest", "place", "a.b", "words", "part")})
    assert ours(prefix_trie.trie(more)) == plain(rows)


def test_very_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in (1, 2)] + [(1, 1, "user", "w" * 1_000_000)]
    assert ours(prefix_trie.trie(spark.createDataFrame(rows, DDL))) == plain(rows)


def test_digest_of_many_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    ends = spark.range(100, 400).select(F.lit(b"n").alias("node"), F.col("id").alias("conv_id"))
    row, = prefix_trie.end_digests(ends.repartition(4)).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(100, 400))).encode()).hexdigest()
