"""Corpus pipeline: each stage gets the documents that the one before it kept; all but the last return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm.common import read_table, scratch_path
from frameloom.llm.decontaminate import drop_leaks
from frameloom.llm.minhash import keep_one
from frameloom.llm.pattern_packing import best_fit_packing
from frameloom.llm.pii import redact_documents
from frameloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. Null and empty texts have the score of a text without words; null ids, ties and repeated rows are
    rows like all others; very long texts are scored whole; without documents there are none, without labels of both kinds all scores are that
    of the only kind."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near-duplicates. Null, empty and blank texts are near to nothing and stay; rows with a
    null id go if a copy has an id; of rows that repeat an id and its text one stays; texts of any length are compared whole."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaked into, in any letter case. Null and empty texts and rows with a null id stay; of rows that share an id all
    go if an item leaked into one of them; without items all stay."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null and empty texts stay as they are; texts of any length are read whole; every row comes
    out once."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents in sequences of 4096 ids. Null and empty texts are one piece of the closing id; longer texts are cut,
    none is dropped; repeated rows are packed each; without documents there are no rows."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", packing),
]

#: Hashing, a fitted classifier and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir; what a stage returns is written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
