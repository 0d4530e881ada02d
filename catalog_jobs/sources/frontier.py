"""Urls to fetch, as DataFrames: listing pages, makers by header letter, products by id range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header letters under which makers are listed: 26 Latin ones and 46 kana.
MAKER_HEADERS = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"]


def frontier_pages(spark: SparkSession, first: int, last: int, base: str, order: str = "order=post_date&direction=desc") -> DataFrame:
    """(page_no, url) for pages first to last, both included; page 1 has no page part."""
    page = F.col("id").cast("int")
    url = F.concat(F.lit(base), F.when(page > 1, F.format_string("page-%d", page)).otherwise(""), F.lit(f"?{order}"))
    return spark.range(first, last + 1).select(page.alias("page_no"), url.alias("url"))


def frontier_makers(spark: SparkSession, sections: list[str], headers: list[str] | None, base: str, path: str) -> DataFrame:
    """(section, header, url = base + section + path + header): both lists are short literals, so every section meets every header; None is all of MAKER_HEADERS."""
    pairs = spark.range(1).select(F.explode(F.array(*map(F.lit, sections))).alias("section")).withColumn("header", F.explode(F.array(*map(F.lit, MAKER_HEADERS if headers is None else headers))))
    return pairs.withColumn("url", F.concat(F.lit(base), F.col("section"), F.lit(path), F.col("header")))


def frontier_products(spark: SparkSession, prefix: str, start: int, end: int, base: str) -> DataFrame:
    """(product_id, url) for numbers start to end - 1, padded to six digits; longer numbers stay as they are."""
    number = F.col("id").cast("string")
    padded = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    rows = spark.range(start, end).select(F.concat(F.lit(prefix), padded).alias("product_id"))
    return rows.withColumn("url", F.concat(F.lit(base), F.col("product_id")))
