"""Corpus pipeline: each stage is one operator of fieldloom.llm over all that the stage before kept.

Edge cases, of all stages: null and empty texts are documents like others (not toxic unless the model says so,
near copies of nothing, without passages or hits) and end as a piece of the final id alone; texts of any length are
taken whole; a null doc_id stays null, has no label, and its row stays unless its group of near copies has one with
an id; equal rows are judged alike (of near copies all rows of the kept doc_id stay), ties go to the smaller
doc_id; columns besides those of documents are not read and end at the first stage, whatever their names; an
empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, neardup, packing, registry, substring_dedup, toxicity
from fieldloom.llm.shared import Scratch

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels scores 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 0").select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike at 0.8 on 5-word shingles that of the smallest doc_id stays."""
    return neardup.dedup_near(docs, shingle=5, percent=80).select(*DOCUMENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words that stand twice; documents of which nothing is left go."""
    out = substring_dedup.dedup_substrings(docs, window=50)
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 10 benchmark words go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item"), "text")
    return decontaminate.decontaminate(docs, bench, n=10).where("n_hit = 0").select(*DOCUMENT)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids, in sequences of at most 2048."""
    return packing.pack(docs, registry.tokenizer_path(), capacity=2048, final_id=0, with_ids=True)


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]

#: The stages keep state that one SQL statement cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
