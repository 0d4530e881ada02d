"""From raw documents to packed token sequences, in five stages; each one's result is a Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_jobs.llm import decontaminate, line_dedup, near_dedup, packing, quality
from catalog_jobs.llm.common import read, written
from catalog_jobs.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the decision list learned from labels reject go.

    Null and empty texts go, as they have too few words; repeated rows stay or go together; other columns aren't touched.
    """
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeated windows go, and documents that have no word left because of it; n_chars follows the text.

    Null and empty texts, and those of under three lines, stay as they are; repeated rows of one doc_id and text are cut alike.
    """
    cut = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.filter(F.coalesce(~emptied, F.lit(True))).withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 or more.

    That is the one with the least doc_id, null first, and once if its row is repeated. Texts without words, null ones too, are near nothing and all stay.
    """
    return near_dedup.one_of_each_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go.

    Null and empty texts stay; repeated rows stay or go together; with an empty benchmark all stay.
    """
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset.

    A null or empty text is one token, its end; longer texts than 4096 tokens are cut; repeated rows are packed each on their own; an empty table gives an empty one.
    """
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_free),
    ("best_fit_packing", packed),
]

#: SQL can't express the learned list, the tokenizer and the linear program: tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
