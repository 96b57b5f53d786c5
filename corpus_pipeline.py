"""The corpus pipeline: language ID, near-duplicate removal, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet and hands them, read again, to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import common, language_id, minhash_dedup, mixing, packing
from furrow.llm.queries import tokenizer_path

END = 2

#: Whole texts pass from stage to stage: small row groups and batches, so that a task of one stage
#: finds room beside what the Python workers and the heap keep of the stage before it.
CONF = {
    "parquet.block.size": str(16 << 20),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}

#: For the same reason the last stage encodes less text at a time than packing alone does, and a
#: worker remembers fewer words: more of them are encoded again.
PACK = {"chunk_bytes": 2 << 20, "max_words": 200_000}


def configure(spark: SparkSession) -> None:
    common.configure(spark)
    for key, value in CONF.items():
        spark.conf.set(key, value)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the classifier knows: those it rejects go (texts that are null or
    without letters, and those far from every learned language)."""
    configure(spark)
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id")))
    name, = common.fresh(docs, "language")
    judged = language_id.identify(docs, model, name=name)
    return judged.filter(~F.col(f"{name}.rejected")).select(*map(common.col, docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    configure(spark)
    return minhash_dedup.keep_one(docs, percent=75, n=5)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 150% of all words, two epochs at most."""
    configure(spark)
    return mixing.repeated(docs, share=1.5, epochs=2.0)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces in sequences of 1024 tokens."""
    configure(spark)
    return packing.pack(docs, tokenizer_path(), end=END, **PACK)


STAGES = [
    ("language ID", known_languages),
    ("MinHash near-dedup", without_near_duplicates),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
