"""The corpus pipeline: what is kept of ``documents``, stage by stage.

Defined results, in all stages: a null text has no language and goes at the first; nulls in other columns change nothing (a null
source is a source, a null id comes last); texts are taken whole, whatever their length; of repeated rows and near copies one row
stays, that of the smallest id; an empty table stays empty; other columns, of any name, are kept (the mix's own becomes ``copies_`` beside one
named ``copies``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import decontaminate, langid, mixing, simhash, suffixdedup
from seriesloom.llm.common import ensure_checkpoint_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found."""
    return langid.identified_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without bytes that repeat strings of an earlier document; n_chars is counted anew."""
    kept = suffixdedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, and how often each is taken (copies)."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", benchmark), ("mixing", mixture)]
#: SQL can express neither the network nor the fingerprints; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written to the shared checkpoint folder and read again by the next."""
    ensure_checkpoint_dir(spark)
    docs, at = table(spark, sf_dir, "documents"), f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{n}")
        docs = spark.read.parquet(f"{at}/{n}")
        suffixdedup.release(spark)
        if n:  # what the stage before wrote has been read for the last time
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{n - 1}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
