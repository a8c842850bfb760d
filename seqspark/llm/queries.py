"""The registered queries of the corpus operators. Each takes (spark, sf_dir) and covers whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqspark.llm import chatfmt, decontam, langid, licenses, merkle, mixing, neardup, novelty, periodic, pii, quality, rules, tokencount
from seqspark.llm.common import documents


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_edited(documents(spark, sf_dir), tokencount.revisions())


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=4)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(documents(spark, sf_dir), pii.key_of(spark) or pii.TEST_KEY).select("doc_id", "text", "n_entities")


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chatfmt.read_back(chatfmt.prefix_tree(rows))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.collapsed(documents(spark, sf_dir), weave=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(documents(spark, sf_dir))


def op13_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.scan(documents(spark, sf_dir))


QUERIES = {
    "op1_language_gru": op1_language_gru,
    "op2_quality_fm": op2_quality_fm,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_decontaminate": op5_decontaminate,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_surrogates": op7_surrogates,
    "op8_chat_tree": op8_chat_tree,
    "op9_license_scan": op9_license_scan,
    "op10_source_mix": op10_source_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_novelty": op13_secret_novelty,
}
