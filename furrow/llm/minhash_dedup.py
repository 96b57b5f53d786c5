"""Near duplicates by MinHash: an inverted join over signature coordinates.

1. A text's shingles become 64 minima, its signature. Texts with the same set form a class, which
   its smallest id stands for; from here on there are classes only.
2. Each coordinate and its value are a token. Tokens that only one class has can't join anything.
   Of two classes that agree in 30 of 64 coordinates, at least one agreement is among the 35 rarest
   tokens of both, in one order of all tokens: the lists of those hold every such pair (prefix
   merging). A class with fewer than 30 tokens in long lists is in none of these.
3. A list's members are first compared with the one in their middle and with another: groups of
   near copies fall into one component with as many comparisons as members. For this, a class takes
   part in 8 long lists only, those of its smallest minima.
4. All lists of the 35 rarest, long ones included, that then still span components are compared
   throughout, long ones in blocks that give links, not pairs. A component with many members in a
   list has blocks of its own, which are not compared with each other.
5. Agreements are counted over the whole signatures; pairs with 30 or more go on, and the exact
   likeness of their full sets decides.

Of pairs with a likeness of 0.75, all but one in some 10 million agree in 30 of 64 coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common, shingles
from furrow.llm.components import components
from furrow.session import broadcast_if_small

COORDINATES = 64
MATCHES = 30
LONG_LIST = 500
#: Long lists of a class in which it is compared with the members in their middle (see 3 above).
KEPT_LONG = 8
#: Lists up to this length give their pairs as rows; longer ones are compared in blocks.
SHORT_LIST = 32
BLOCK = 128
BLOCK_BYTES = 2 << 20
COLUMNS = 4096
CHUNK_BYTES = 4 << 20
#: Class ids sent to every task to pick texts; with more, the join shuffles.
MAX_BROADCAST_IDS = 2_000_000

_SEEDS = shingles.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of 64 hash functions per text; texts without shingles get zeros."""
    out = np.zeros((len(at) - 1, COORDINATES), np.uint32)
    filled = np.flatnonzero(np.diff(at))
    if not len(filled):
        return out
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            v = ((h ^ (seed >> np.uint64(7))) * seed) >> np.uint64(32)
            out[filled, k] = np.minimum.reduceat(v.astype(np.uint32), at[filled])
    return out


def features(docs: DataFrame, n: int = shingles.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, and the signature."""
    ddl = "doc_id long, n_shingles long, set_a long, set_b long, signature array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches, CHUNK_BYTES):
            data, limits = common.utf8(common.texts_of(batch.column("text")))
            h, at = shingles.shingle_hashes(data, limits, n)
            size = np.zeros(len(at) - 1, np.int64)
            sums = np.zeros((2, len(at) - 1), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(len(size)):
                    own = np.unique(h[at[i]:at[i + 1]])
                    size[i] = len(own)
                    sums[0, i] = own.sum(dtype=np.uint64)
                    sums[1, i] = (own * (own >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64)
            sig = signatures(h, at).view(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size), *(pa.array(s.view(np.int64)) for s in sums),
                pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), COORDINATES).cast(
                    pa.list_(pa.int32())),
            ], names=[c.split()[0] for c in ddl.split(", ")])

    return docs.mapInArrow(run, ddl)


def sets(docs: DataFrame, n: int = shingles.SHINGLE) -> DataFrame:
    """id, signature and sorted shingle hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches, CHUNK_BYTES):
            data, limits = common.utf8(common.texts_of(batch.column("text")))
            h, at = shingles.shingle_hashes(data, limits, n)
            own = [np.unique(h[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            sig = [row.tobytes() for row in signatures(h, at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sig, pa.binary()), pa.array(own, pa.binary())],
                names=["id", "signature", "hashes"])

    return docs.mapInArrow(run, "id long, signature binary, hashes binary")


def posted(classes: DataFrame) -> DataFrame:
    """token, id, n_shingles, weight, first, rarest: what each class is posted under, for the first
    comparisons and as one of its rarest tokens (see 2 and 3 above). A class weighs as much as its
    tokens are common: in a group of near copies, the one in their middle."""
    one = ["id", "n_shingles", "set_a", "set_b"]  # an id may stand for several classes
    tokens = classes.select(*one, F.posexplode("signature").alias("k", "value")).select(
        *one,
        F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(
            F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    long_ = F.col("f") > LONG_LIST
    by_class = Window.partitionBy(*one)
    value = F.col("token").bitwiseAND(0xFFFFFFFF)
    ranked = tokens.join(shared, "token").withColumns({
        "from_end": F.row_number().over(by_class.orderBy(F.desc("f"), F.desc("token"))),
        "long_rank": F.row_number().over(by_class.orderBy(F.desc(long_.cast("int")), value, "token")),
        "n_long": F.sum(long_.cast("int")).over(by_class),
        "weight": F.sum("f").over(by_class),
    })
    rarest = F.col("from_end") > MATCHES - 1
    first = F.when(long_, (F.col("n_long") >= MATCHES) & (F.col("long_rank") <= KEPT_LONG)).otherwise(rarest)
    return ranked.select("token", "id", "n_shingles", "weight", first.alias("first"), rarest.alias("rarest")) \
        .filter("first OR rarest")


def confirmed(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates and whose sets are alike enough."""
    side = lambda x: own.select(
        F.col("id").alias(x), F.col("signature").alias(f"s{x}"), F.col("hashes").alias(f"h{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb, ha, hb in zip(*(batch.column(c) for c in ("sa", "sb", "ha", "hb")), strict=True):
                sa, sb = (np.frombuffer(v.as_buffer(), np.uint32) for v in (sa, sb))
                if np.count_nonzero(sa == sb) < MATCHES:
                    keep.append(False)
                    continue
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (ha, hb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        common.release()

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long")


def links_between(classes: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Links that join the same classes as all links do."""
    postings = common.stored(posted(classes), "postings")
    wanted = broadcast_if_small(postings.select("id").distinct(), MAX_BROADCAST_IDS)
    own = common.stored(
        sets(docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi"), n), "sets")
    ratio = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    middle, other = (F.max(F.struct(*order, F.col("id").alias("a"), F.col("n_shingles").alias("na")))
                     for order in (("weight", F.xxhash64("id")), (F.xxhash64("id"),)))
    early = postings.filter("first").drop("first")
    lists = early.groupBy("token").agg(
        middle.alias("middle"), other.alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = lists.select("token", F.explode(F.array_distinct(F.array(*(
        F.struct(f"{c}.a", f"{c}.na") for c in ("middle", "other"))))).alias("first")).select(
            "token", "first.a", "first.na")
    pairs = early.select("token", F.col("id").alias("b"), F.col("n_shingles").alias("nb")).join(
        first, "token").filter((F.col("a") != F.col("b")) & ratio) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = common.stored(confirmed(pairs, own, percent), "links")
    part = components(found)
    # lists within one component are done; the rest are seen with their components
    seen = postings.filter("rarest").join(part, postings["id"] == part["node"], "left").select(
        "token", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    sizes = seen.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count(F.lit(1)).alias("n")).filter("low < high").drop("low", "high")
    listed = common.stored(seen.join(sizes, "token"), "open-lists")
    short = listed.filter(F.col("n") <= SHORT_LIST)
    one = short.select("token", F.col("id").alias("a"), F.col("n_shingles").alias("na"),
                       F.col("component").alias("ca"))
    two = short.select("token", F.col("id").alias("b"), F.col("n_shingles").alias("nb"),
                       F.col("component").alias("cb"))
    pairs = one.join(two, "token").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & ratio) \
        .select("a", "b").distinct()
    return found.unionByName(confirmed(pairs, own, percent)).unionByName(
        in_blocks(listed.filter(F.col("n") > SHORT_LIST), own, percent))


def in_blocks(members: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links between components in long lists: a list's members stand in blocks, and a row per pair
    of blocks compares all of one with all of the other, giving links only. Components with more than
    a block of members in a list stand in blocks of their own; blocks of one component never meet."""
    large = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held")) \
        .filter(F.col("held") > BLOCK).select("token", "component", F.col("component").alias("group"))
    grouped = members.join(large, ["token", "component"], "left")
    by_group = Window.partitionBy("token").orderBy(F.col("group").asc_nulls_first())
    groups = grouped.groupBy("token", "group").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES)).alias("blocks")) \
        .select(F.col("token").alias("list"), F.col("group").alias("of"), "blocks",
                F.sum("blocks").over(by_group).alias("next"),
                F.sum("blocks").over(Window.partitionBy("token")).alias("all"))
    block = F.col("next") - F.col("blocks") + F.pmod(F.xxhash64("id"), F.col("blocks"))
    held = grouped.join(groups, (F.col("token") == F.col("list")) & F.col("group").eqNullSafe(F.col("of"))) \
        .select("token", "id", "component", "all", block.alias("block"),
                F.when(F.col("group").isNull(), block).otherwise(F.col("next")).alias("from")) \
        .join(own, "id").groupBy("token", "all", "block", "from").agg(F.collect_list(
            F.struct("id", "component", "signature", "hashes")).alias("left"))
    held = common.stored(held, "blocks")
    one = held.filter(F.col("from") < F.col("all")).withColumn(
        "other", F.explode(F.sequence(F.col("from"), F.col("all") - 1)))
    two = held.select("token", F.col("block").alias("other"), F.col("left").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (_Block(batch.column(side)[r].as_py()) for side in ("left", "right"))
                i, j = x.alike(y, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x.ids[i], y.ids[j])), pa.array(np.maximum(x.ids[i], y.ids[j]))],
                    names=["a", "b"])
        common.release()

    return one.join(two, ["token", "other"]).select("left", "right").mapInArrow(compare, "a long, b long")


class _Block:
    """Members of a list as arrays."""

    def __init__(self, members: list[dict]):
        self.ids = np.array([m["id"] for m in members], np.int64)
        self.component = np.array([m["component"] for m in members], np.int64)
        self.signature = np.frombuffer(b"".join(m["signature"] for m in members), np.uint32) \
            .reshape(-1, COORDINATES)
        self.sets = [np.frombuffer(m["hashes"], np.uint64) for m in members]
        self.size = np.array([len(s) for s in self.sets], np.int64)

    def alike(self, other: _Block, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of different components that agree enough and whose sets are alike."""
        agree = np.zeros((len(self.ids), len(other.ids)), np.int32)
        for k in range(COORDINATES):
            agree += self.signature[:, k, None] == other.signature[None, :, k]
        likely = (agree >= MATCHES) & (self.component[:, None] != other.component[None, :])
        if not likely.any():
            return np.nonzero(likely)
        both = np.concatenate([*self.sets, *other.sets])
        _, at, n = np.unique(both, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(self.ids) + len(other.ids)), np.concatenate([self.size, other.size]))
        shared = n[at] > 1
        row, at = row[shared], (np.cumsum(n > 1) - 1)[at[shared]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        inter = np.zeros(likely.shape, np.float64)
        for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):  # few shingles at a time
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            table = np.zeros((len(self.ids) + len(other.ids), COLUMNS), np.float32)
            table[row[a:b], at[a:b] - first] = 1
            inter += table[:len(self.ids)] @ table[len(self.ids):].T
        total = self.size[:, None] + other.size[None, :] - inter
        return np.nonzero(likely & (100 * inter >= percent * total))


def links_of_ids(usable: DataFrame, of_class: DataFrame, same: tuple[str, ...]) -> DataFrame:
    """Links between an id and the classes of its texts, for ids that have different ones."""
    key = F.struct(*same)
    several = usable.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")) \
        .filter("low <> high").select("doc_id")
    held = usable.join(several, "doc_id", "left_semi").select("doc_id", *same).distinct()
    return held.join(of_class, list(same)).filter("id <> doc_id").select(
        F.least("id", "doc_id").alias("a"), F.greatest("id", "doc_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 75, n: int = shingles.SHINGLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of n-word shingles have a likeness of at least `percent`
    hundredths. Null and empty texts, and texts without words, have no shingles and are linked with
    nothing. Rows with one id count as one document of several texts, linked with whatever one of
    these is linked with; rows without an id are linked with nothing and kept. Other columns are
    ignored.
    """
    narrow = docs.select(
        common.col(id_col).cast("long").alias("doc_id"), common.col(text_col).alias("text"))
    every = common.stored(features(narrow, n), "features")
    same = ("n_shingles", "set_a", "set_b")
    usable = every.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    of_class = usable.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # one row per class: the signature of a row that stands for it
    classes = common.stored(
        usable.join(of_class.select("id", *(F.col(c).alias(f"own_{c}") for c in same)),
                    [F.col("doc_id") == F.col("id"), *(F.col(c) == F.col(f"own_{c}") for c in same)])
        .select("id", *same, "signature").dropDuplicates(["id", *same]), "classes")
    links = links_between(classes, narrow, percent, n).unionByName(links_of_ids(usable, of_class, same))
    part = components(links)
    classes_of = of_class.filter("copies > 1").select(*same, F.col("id").alias("first"))
    labelled = every.join(classes_of, list(same), "left").withColumn(
        "first", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")))
    return labelled.join(part, F.col("first") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays.

    All columns pass through. Of rows with one id, one stays; rows without an id all stay.
    """
    own, kept = common.fresh(docs, "own", "kept")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **kwargs)
    per_id = common.stored(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
        .filter("component_id <> doc_id OR rows > 1")
        .select(F.col("doc_id").alias(own), (F.col("component_id") == F.col("doc_id")).alias(kept)),
        "duplicates")
    known = common.col(id_col).cast("long") == F.col(own)
    listed = broadcast_if_small(per_id, MAX_BROADCAST_IDS)
    repeated = broadcast_if_small(per_id.filter(kept), MAX_BROADCAST_IDS)
    return docs.join(listed, known, "left_anti").unionByName(
        docs.join(repeated, known, "left_semi").dropDuplicates([id_col]))
