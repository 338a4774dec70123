"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage applies one operator of ``walkframe.llm`` to all that the stage before
kept; all but the last return the columns of ``documents``. Stages treat rows as
their operators do: null and empty texts stay until the mix, which takes no row
without words; of rows with equal ids and texts near-deduplication keeps one; an
empty table passes through; further columns may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from walkframe.llm import bpe, mixing, pii, simhash, toxicity
from walkframe.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the tagger learns from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.near_deduplicate(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in ``text``; ``n_chars`` follows the text."""
    return pii.with_surrogates(docs).drop("n_entities")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on a source's budget is cut to the words taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.bpe_round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("surrogates", surrogates),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the trained tagger, near-duplicates through chains of links, or BPE.
ORACLE_SQL = None


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written to the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(here := f"{base}/{k}-{name}")
        docs = spark.read.parquet(here)
        if before:
            delete(spark, before)  # nothing reads it any more: what came of it is written
        before = here
    return STAGES[-1][1](spark, docs, sf_dir)
