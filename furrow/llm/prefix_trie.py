"""The prefix trie of conversations, with subtree totals by depth-band rollup.

A node is a distinct sequence of first turns, known by its prefix hash, and named by its smallest
member and its depth. Subtree totals are rolled up in bands of depth: a node is exploded only to
its ancestors within its band, at most BAND of them, however deep the trie is. The nodes at the
tops of bands form a trie that is BAND times lower and is rolled up the same way; the completed
totals of those tops are then handed to the ancestors in the band above. So the number of rounds
grows with the logarithm of the depth, and a node is exploded at most BAND times in each.

Ancestors are found by an equality join: a node's smallest member passes through all of them, so
(member, band) leads to at most BAND rows on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import common, runs

BAND = 16
#: Ids that go into one row on their way to a node's digest.
IDS = 4096
#: Fixed value: SHA-256 of no bytes.
NOTHING = hashlib.sha256(b"").hexdigest()

#: Most turns a conversation takes from the first of its group, by the contract.
BORROWED, GROUP = 3, 20


def _length_and_text(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations) of the conversations after each took its first turns from another.

    rows: conv_id, digest (of role and text), words, place (from 1), prefix (hash of the turns so
    far). conversations: conv_id, turnless ones included. Null roles and texts are empty; turns of
    one number go by role, then text, in code points; a null turn is first. Rows without a conv_id
    belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(common.col(c), F.lit("")) for c in ("role", "text"))
    own = turns.select(
        common.col("conv_id").cast("long").alias("conv_id"), common.col("turn").alias("turn"),
        role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(F.concat(_length_and_text(role), text), 256)).alias("digest"),
        F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long").alias("words"),
    ).filter("conv_id IS NOT NULL")
    ordered = runs.numbered(own, "conv_id", ["turn", "role", "text"], "digest",
                            drop=["turn", "role", "text"]).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (BORROWED + 1))
    conversations = ordered.filter("place = 1").select(
        "conv_id", "h", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = ordered.filter(F.col("place") <= BORROWED).select(
        F.col("conv_id").alias("base"), "place", "digest", "words")
    lent = conversations.join(heads, "base").filter("place <= h").select(
        "conv_id", "place", "digest", "words")
    rest = ordered.filter("place > h").select("conv_id", "place", "digest", "words")
    both = lent.unionByName(rest).withColumnRenamed("place", "nr")
    return (runs.numbered(both, "conv_id", ["nr"], "digest", drop=["nr"]),
            conversations.select("conv_id"))


def _ancestors(items: DataFrame, at: DataFrame, last: Column, values: list[str]) -> DataFrame:
    """Each item's values at its band's nodes down to the depth `last`: (node, values)."""
    return items.withColumn("last", last).join(at, ["conv_id", "band"]).filter("depth <= last").select(
        "node", *values)


def rolled_up(nodes: DataFrame, at: DataFrame, deepest: int, values: list[str], band: int = BAND) -> DataFrame:
    """Sums of `values` over each node's subtree, itself included: (node, values).

    nodes: node, conv_id (any member of all its ancestors), depth, and the values as longs. at:
    conv_id, depth, node: through which nodes conversations pass.
    """
    def total(df: DataFrame) -> DataFrame:
        return df.groupBy("node").agg(*(F.sum(v).alias(v) for v in values))

    def places(stride: int) -> DataFrame:
        return at.filter(F.col("depth") % stride == 0).withColumn(
            "band", F.floor(F.col("depth") / (stride * band)))

    where = nodes.select("node", "conv_id", "depth")
    # upwards: sums within bands, then the tops of bands as the nodes of the next, lower trie
    strides, parts, items, stride = [], [], nodes, 1
    while True:
        own = items.withColumn("band", F.floor(F.col("depth") / (stride * band))).select(
            "conv_id", "band", F.col("depth").alias("own"), *values)
        part = common.stored(total(_ancestors(own, places(stride), F.col("own"), values)), "band-sums")
        strides.append(stride), parts.append(part)
        if stride * band > deepest:
            break
        stride *= band
        items = part.join(where, "node").filter(F.col("depth") % stride == 0)
    # downwards: completed totals of the tops go to the band above
    done = parts.pop()
    strides.pop()
    while parts:
        stride = strides.pop()
        tops = done.join(where, "node").filter("depth > 0").select(
            "conv_id", F.floor((F.col("depth") - 1) / (stride * band)).alias("band"),
            (F.col("depth") - stride).alias("own"), *values)
        handed = _ancestors(tops, places(stride), F.col("own"), values)
        done = common.stored(total(parts.pop().unionByName(handed)), "totals")
    return done


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: node, conv_id. Per node the SHA-256 of its ids in decimal, ascending, joined by commas.

    A digest takes its bytes in order, so one task reads them, but as rows of up to IDS ids that
    sorted ranges have joined before; it holds one such row at a time.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def row():
            return pa.RecordBatch.from_pylist(
                [{"node": node, "first": ids[0], "ids": ",".join(map(str, ids))}], schema=joined)

        for batch in batches:
            for n, i in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (n != node or len(ids) == IDS):
                    yield row()
                    ids = []
                node = n
                ids.append(i)
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, out = [], []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if state:
                        nodes.append(node), out.append(state.hexdigest())
                    node, state = n, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({"node": nodes, "ends_sha256": out}, schema=digests)
        if state:
            yield pa.RecordBatch.from_pydict(
                {"node": [node], "ends_sha256": [state.hexdigest()]}, schema=digests)

    joined = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    digests = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id") \
        .mapInArrow(join, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first") \
        .mapInArrow(digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    An empty table has no conversations and so no root. Columns other than conv_id, turn, role and
    text are ignored. Texts are hashed whole, whatever their length.
    """
    rows, conversations = rebuilt(turns)
    rows = common.stored(rows, "prefixes")
    roots = conversations.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(runs.EMPTY).alias("node"),
        F.lit(0).cast("long").alias("words"))
    at = roots.unionByName(rows.select(
        "conv_id", F.col("place").alias("depth"), F.col("prefix").alias("node"), "words"))
    at = common.stored(at, "paths")
    found = at.groupBy("depth", "node").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"))
    # a node's smallest member leads to its parent
    nodes = common.stored(found.join(at.select(
        "conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")),
        ["conv_id", "depth"], "left"), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    counted = common.stored(nodes.join(children, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "counted")
    deepest = counted.agg(F.max("depth")).first()[0] or 0
    totals = rolled_up(
        counted.select("node", "conv_id", "depth", "n_leaves", "saved_tokens"),
        at.select("conv_id", "depth", "node"), deepest, ["n_leaves", "saved_tokens"], band)
    ends = at.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    parents = counted.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return counted.drop("n_leaves", "saved_tokens").join(totals, "node") \
        .join(end_digests(ends), "node", "left").join(parents, "parent", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
