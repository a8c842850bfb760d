"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and returns documents with the columns that it got; the
last one adds what the mix takes of each. Between stages the documents are written to the shared folder as Parquet, so a lost executor
or a failed stage costs no more than that stage.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.llm import decontam, mixing, neardup, pii, quality
from seqspark.llm.common import cut, discard, documents


def _measured(docs: DataFrame) -> DataFrame:
    """docs whose texts have changed, with n_chars to match."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored by their statistics; without labels of both values all
    have one score; of repeated rows all stay or none."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. Texts without words and rows without an id are no duplicates; of rows of equal id and
    text one stays."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that consist of them for the most part go. Null and empty texts stay, as do all with an
    empty benchmark; repeated rows are cut alike."""
    return _measured(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets surrogates under the session's key; without one, under a key for tests, which protects nothing and is warned of.
    A null text stays null."""
    key = pii.key_of(spark)
    if key is None:
        warnings.warn(f"no {pii.KEY_SETTING}: surrogates are made with a key for tests", stacklevel=2)
    return _measured(pii.pseudonymised(docs, key or pii.TEST_KEY).select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix of sources takes words, with size, source_size, target and taken. Texts without words give none and go; a
    null source is one of its own; repeated rows have a place each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the classifier nor the surrogates; the tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            discard(before)
    return docs
