"""WARC archives written and read by Spark, with record boundaries verified as a chain.

Writing: records are texts, so Spark's text writer puts them down one after another, its separator
being the blank lines that end a record; files are committed like any other Spark output.

Reading: tasks split the files at the magic line a record starts with. Not every such line starts a
record, since a payload may hold one as well. Each piece is a candidate: its own offset, and the
offset its length field names as its successor's. A file's records are those that the chain from
its first byte reaches. Within a split a task follows successors by doubling jumps, so a candidate
knows where it leaves the split; a table of such exits is then doubled over the splits of a file,
and at last marks which candidates the chain visits. Payloads that hold the magic come in several
pieces and are put together from them; all others are digested where they are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm import common
from furrow.session import broadcast_if_small

# The record format's own lines.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]{1,15})\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads from this size on are stored once.
REVISIT_FROM = 1000
#: Revisits known to every writing task; with more, the join shuffles.
MAX_BROADCAST_REVISITS = 500_000
DATE = "1970-01-01T00:00:00Z"

INDEX_DDL = ("file string, split long, rel long, size long, record long, leave long, header string, "
             "digest string")

def _uuid(kind: str, id_: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), id_.cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column]], payload: Column) -> Column:
    """A whole record but for the blank lines after it; a field whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
             for name, value in fields]
    return F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), payload)


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html",
) -> None:
    """One record per row: the payload in a `response`, or a `revisit` of the row with the same one.

    Of rows with equal payloads of REVISIT_FROM bytes or more, that with the largest id holds it.
    A null payload counts as empty; a null url leaves out its field, and line breaks in one become
    blanks. Rows without an id are responses of their own. Rows with one id are written each, and
    each payload among them is held or referred to by itself: a record is named by id and payload.
    Other columns are ignored.
    """
    rows = pages.select(
        common.col(id_col).cast("long").alias("id"), common.col(url_col).cast("string").alias("url"),
        F.coalesce(common.col(payload_col), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    rows = rows.withColumn("same", F.when(
        (F.octet_length("payload") >= REVISIT_FROM) & F.col("id").isNotNull(), F.sha2(raw, 256)))
    large = rows.filter("same IS NOT NULL").select("id", "same")
    holders = large.groupBy("same").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1")
    revisits = broadcast_if_small(
        large.join(holders, "same").filter("id <> holder").select(
            F.col("id").alias("visitor"), F.col("same").alias("visited"), "holder").distinct(),
        MAX_BROADCAST_REVISITS)
    joined = rows.join(
        revisits, (F.col("id") == F.col("visitor")) & (F.col("same") == F.col("visited")), "left")
    digest = F.sha1(raw)
    named = lambda id_: _uuid("page", F.concat_ws(":", id_.cast("string"), digest))
    revisit = F.col("holder").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = _record([
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.when(F.col("id").isNotNull(), named(F.col("id")))
         .otherwise(_uuid("payload", digest))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        ("WARC-Page-ID", F.col("id").cast("string")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Payload-Length", F.octet_length("payload").cast("string")),
        ("WARC-Refers-To", F.when(revisit, named(F.col("holder")))),
        ("WARC-Refers-To-Page-ID", F.col("holder").cast("string")),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(body).cast("string")),
    ], body)
    joined.select(record.alias("value")).write.option("lineSep", END).text(path)


@contextmanager
def _same_splits(spark: SparkSession) -> Iterator[None]:
    """Scans inside cut their files alike, whether executors come or go between them: the size of a
    split follows from a number that is set once, not from the cores there are at each scan."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(before or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines, with the file and the split it was read in."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Each piece with its place in its split; the magic before the next piece counts to it."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        for file, split, value in zip(*(batch.column(c) for c in ("file", "split", "value")),
                                      strict=True):
            key, value = (file.as_py(), split.as_py()), value.as_py()
            rel = at.get(key, 0)
            at[key] = rel + len(value) + len(MAGIC)
            yield *key, rel, value


def _followed(rel: np.ndarray, record: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves its split, by doubling jumps; -1: it breaks.

    rel: places of the candidates in rising order; record: their records' sizes; total: the split's
    size.
    """
    target = rel + record
    n = len(rel)
    step = np.searchsorted(rel, target)
    hit = (step < n) & (rel[np.minimum(step, n - 1)] == target) if n else np.zeros(0, bool)
    jump = np.where(hit, step, np.arange(n))  # the last of a chain points to itself
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    leave = target[jump]
    return np.where(leave >= total, leave, -1)


def _index(spark: SparkSession, path: str) -> DataFrame:
    """A row per piece. record: the size of the record that its header announces, from its magic to
    the blank lines; null without a header. leave: where its chain leaves the split. The digest is
    there for payloads that lie in one piece."""
    names = [c.split()[0] for c in INDEX_DDL.split(", ")]

    def flush(key: tuple[str, int], rows: list[tuple]) -> pa.RecordBatch:
        rel, size, record, header, digest = zip(*rows, strict=True)
        rel, size = np.array(rel), np.array(size)
        able = np.flatnonzero([r is not None for r in record])
        leave = np.full(len(rel), -1)
        leave[able] = _followed(rel[able], np.array([record[i] for i in able], np.int64),
                                int(rel[-1] + size[-1]))
        n = len(rel)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(rel), pa.array(size),
            pa.array(record, pa.int64()), pa.array(leave), pa.array(header, pa.string()),
            pa.array(digest, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for file, split, rel, value in _placed(batches):
            if rows and key != (file, split):
                yield flush(key, rows)
                rows = []
            key, size = (file, split), len(value) + len(MAGIC)
            record = header = digest = None
            cut = value.find(b"\r\n\r\n")
            lines = b"\r\n" + value[:cut + 2] if cut >= 0 else b""
            # what stands before a file's first magic is no candidate
            if (length := LENGTH.search(lines)) and (split or rel):
                payload = int(length[1])
                record = len(MAGIC) + cut + 4 + payload + 4
                header = lines.decode("utf-8", "replace")
                if record == size:
                    digest = hashlib.sha1(memoryview(value)[cut + 4:cut + 4 + payload]).hexdigest()
            rows.append((rel, size, record, header, digest))
        if rows:
            yield flush(key, rows)

    return _lines(spark, path).mapInArrow(run, INDEX_DDL)


def _reached(candidates: DataFrame) -> DataFrame:
    """file, at: where the chain from each file's start enters its splits.

    candidates: file, at, leave. Only places at which some chain leaves a split can be entries; a
    table of these is doubled until a jump spans the longest file.
    """
    spark = candidates.sparkSession
    leaves = candidates.filter("leave IS NOT NULL")
    entries = leaves.select("file", F.col("leave").alias("at")).distinct().unionByName(
        candidates.select("file", F.lit(0).cast("long").alias("at")).distinct()).distinct()
    jumps = common.stored(leaves.join(entries, ["file", "at"]).select("file", "at", "leave"), "jumps")
    reached = common.stored(
        candidates.select("file", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    while True:
        more = reached.join(jumps, ["file", "at"]).select("file", F.col("leave").alias("at"))
        grown = common.stored(reached.unionByName(more).distinct(), "reached")
        if grown.count() == reached.count():
            return grown
        reached = grown
        then = jumps.select("file", F.col("at").alias("leave"), F.col("leave").alias("further"))
        jumps = common.stored(jumps.join(then, ["file", "leave"]).select(
            "file", "at", F.col("further").alias("leave")), "jumps")


def _owners(index: DataFrame, bases: DataFrame) -> DataFrame:
    """Every piece of an archive with the record it belongs to.

    Adds at (offset of the piece's magic in the file), start (is it a record), own (offset of the
    last record in the piece's split that starts at or before it; null if none does).
    """
    placed = index.join(bases, ["file", "split"]).withColumn(
        "at", F.col("base") + F.col("rel") - len(MAGIC))
    entries = _reached(placed.filter("record IS NOT NULL").select(
        "file", "at", F.when(F.col("leave") >= 0, F.col("base") + F.col("leave") - len(MAGIC))
        .alias("leave")))
    heads = placed.select("file", "split", "at").join(entries, ["file", "at"]).select(
        "file", "split", F.col("at").alias("entry"))
    ddl = "file string, split long, rel long, at long, size long, record long, start boolean, own long"

    def walk(table: pa.Table) -> pa.Table:
        """One split: from its entry on, each record leads to the next."""
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        record = table.column("record").fill_null(-1).to_numpy()
        entry = table.column("entry")[0].as_py()
        start = np.zeros(len(at), bool)
        place = -1 if entry is None else int(np.searchsorted(at, entry))
        while 0 <= place < len(at) and record[place] > 0:
            start[place] = True
            target = at[place] + record[place]
            place = int(np.searchsorted(at, target))
            if place < len(at) and at[place] != target:
                break
        own = np.maximum.accumulate(np.where(start, at, -1))
        return pa.table({
            "file": table.column("file"), "split": table.column("split"), "rel": table.column("rel"),
            "at": table.column("at"), "size": table.column("size"), "record": table.column("record"),
            "start": pa.array(start), "own": pa.array(own, mask=own < 0)})

    return placed.join(heads, ["file", "split"], "left").select(
        "file", "split", "rel", "at", "size", "record", "entry").groupBy("file", "split").applyInArrow(
            walk, ddl)


def _rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip(
            zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
        names=["file", "split", "rel", "value"])


def _long_digests(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """file, at, digest of the records whose payload holds the magic, from all their pieces."""
    by_file = Window.partitionBy("file").orderBy("split")
    # the record in whose midst a split begins: the last one before it
    earlier = owned.groupBy("file", "split").agg(F.max("own").alias("last")).withColumn(
        "before", F.max("last").over(by_file.rowsBetween(Window.unboundedPreceding, -1))) \
        .select("file", "split", "before")
    long_ = owned.filter("start AND record <> size").select(
        "file", F.col("at").alias("own"), F.col("record").alias("own_record"))
    parts = common.stored(
        owned.join(earlier, ["file", "split"]).withColumn("own", F.coalesce("own", "before"))
        .join(long_, ["file", "own"]).select("file", "split", "rel", "at", "own", "own_record"), "parts")
    if parts.isEmpty():
        return parts.select("file", F.col("own").alias("at"), F.lit("").alias("digest"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in _placed(batches):
            rows.append(row)
            if len(rows) == 100:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    read = _lines(spark, path).mapInArrow(bodies, "file string, split long, rel long, value binary")

    def digest(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        whole = MAGIC.encode().join([b"", *table.column("value").to_pylist()])
        cut = whole.index(b"\r\n\r\n", len(MAGIC)) + 4
        end = table.column("own_record")[0].as_py() - 4
        return pa.table({
            "file": table.column("file")[:1], "at": table.column("own")[:1],
            "digest": pa.array([hashlib.sha1(whole[cut:end]).hexdigest()])})

    return read.join(broadcast_if_small(parts, MAX_BROADCAST_REVISITS), ["file", "split", "rel"]) \
        .groupBy("file", "own").applyInArrow(digest, "file string, at long, digest string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, at, header, payload_bytes, digest of every record of the archives below a folder.

    A file whose chain breaks gives its records up to the break; bytes no record covers give none.
    An empty folder gives no rows. The archives are read a second time where payloads hold the magic;
    a digest that this leaves out (the files have changed) is an error.
    """
    with _same_splits(spark):
        return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    index = common.stored(_index(spark, path), "warc-index")
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("file", "split").agg(F.max(F.col("rel") + F.col("size")).alias("total")) \
        .select("file", "split", F.coalesce(F.sum("total").over(by_file), F.lit(0)).alias("base"))
    owned = common.stored(_owners(index, bases), "warc-pieces")
    digests = common.stored(
        _long_digests(spark, path, owned).withColumnRenamed("digest", "long_digest"), "warc-digests")
    return owned.filter("start").join(index.select("file", "split", "rel", "header", "digest"),
                                      ["file", "split", "rel"]) \
        .join(digests, ["file", "at"], "left").select(
            "file", "at", "header",
            field("Content-Length").cast("long").alias("payload_bytes"),
            F.coalesce("digest", "long_digest", F.raise_error(F.concat(
                F.lit("no digest of the record at "), F.col("at").cast("string"), F.lit(" of "), F.col("file"))))
            .alias("digest"))


def field(name: str) -> Column:
    """A header field of a record that was read; null if it has none."""
    pattern = f"\r\n{name}: ([^\r]*)\r\n"
    return F.when(F.col("header").rlike(pattern), F.regexp_extract("header", pattern, 1))


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read back.

    A response's size and digest are those of the payload that was read; a revisit has none of its
    own and names those of the payload it refers to.
    """
    kind = field("WARC-Type")
    response = kind == "response"
    return records.select(
        field("WARC-Page-ID").cast("long").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(
            field("WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(
            F.substring(field("WARC-Payload-Digest"), 6, 40)).alias("payload_digest"),
        kind.alias("record_type"), field("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"))
