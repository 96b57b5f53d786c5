"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings the operators rely on; all can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # the JVM never compiles a method of more than 8000 bytes; wide rule sets exceed that when they
    # are generated as one method, so such stages use split projections instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # event time of a union is that of its slowest input
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
}


# Settings only a new session can take.
STATIC_CONF = {
    # no call sites are recorded for each column expression built in Python
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Session settings for what runs inside; those before it are put back."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def build(app: str = "furrow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, label: str) -> str:
    """A folder of its own for one run, under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/furrow/{label}-{uuid.uuid4().hex}"


def counted(df: DataFrame, max_rows: int) -> tuple[DataFrame, int]:
    """A derived table cut from its lineage, hinted for broadcast when its counted size is within
    the bound, and that count (one above the bound stands for all larger ones).

    The reliable checkpoint keeps the check from computing the rows a second time. Above the
    bound the table carries no hint and a join with it shuffles.
    """
    checkpoint_root(df.sparkSession)
    small = df.checkpoint(eager=True)
    n = small.limit(max_rows + 1).count()
    return (F.broadcast(small) if n <= max_rows else small), n


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    return counted(df, max_rows)[0]


def zoneless(df: DataFrame) -> DataFrame:
    """Output form of a table: event times as zone-free timestamps (UTC)."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
