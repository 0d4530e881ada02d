"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_jobs.llm import conversation, decontaminate, fim, line_dedup, near_dedup, packing, quality, secret_scan, sharding, substring_dedup, suffix_dedup, url_filter, warc
from catalog_jobs.llm.common import read, written
from catalog_jobs.llm.sql import ORACLE_SQL
from catalog_jobs.sources.tables import new_path

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Fixed values of the task: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two versions, by halves of a hash of doc_id: the second is scanned for blobs that the first one's ledger lacks."""
    docs = read(spark, sf_dir, "documents")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    paths, ledger = secret_scan.scan_versions([docs.filter(~late), docs.filter(late)])
    return secret_scan.secret_report(secret_scan.findings_by_path(paths, ledger))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, _ = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return stats.select("doc_id", *quality.STATS, "base_failed", "kept")


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = written(sharding.sort_keys(read(spark, sf_dir, "documents")), "keys")
    dealt = sharding.shard_by_bytes(keys, 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.component_report(read(spark, sf_dir, "documents"), near_dedup.Join(words=2))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = substring_dedup.dedup_in_batches(read(spark, sf_dir, "documents"))
    return report.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = suffix_dedup.dedup_bytes(read(spark, sf_dir, "documents"))
    return report.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as whole-file gzip, those as archives with a member for each record, and what reading these back gives."""
    whole, cut = new_path(spark, "whole"), new_path(spark, "warc")
    warc.write_monolithic(warc.with_revisits(read(spark, sf_dir, "pages")), whole)
    warc.normalise(spark, whole, cut)
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(whole)  # not read any more
    found = warc.read_archives(spark, cut)
    return found.select(warc.urn_key("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.urn_key("refers_to").cast("long").alias("refers_to"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fim_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation.repair_report(conversation.repair_rows(conversation.damaged(conversations)), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_warc_normaliser": op11_warc_normaliser,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
