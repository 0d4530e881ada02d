"""Which crawled rows are new: change test, cut at the first stale row, label filter, lookups and details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Makers are broadcast up to this number of rows (an id and a name each, under 50 MB in all).
BROADCAST_MAKERS = 500_000


def exclude_readme(listing: DataFrame, label: str = "README", column: str = "category") -> DataFrame:
    """Without rows of one category, compared as it is written."""
    return listing.filter(F.coalesce(F.col(column), F.lit("")) != label)


def mark_changed(listing: DataFrame, stored: DataFrame, key: str = "thread_id", stamp: str = "last_thread_comment") -> DataFrame:
    """listing with `changed`: its stamp is later than the stored one, or none (null or 0) is stored. Two columns of `stored` are read."""
    old = stored.select(F.col(key).alias("__key"), F.col(stamp).alias("__old"))
    joined = listing.join(old, F.col(key) == F.col("__key"), "left")
    seen = F.coalesce("__old", F.lit(0))
    return joined.withColumn("changed", (seen == 0) | (F.coalesce(F.col(stamp), F.lit(0)) > seen)).drop("__key", "__old")


def changed_threads(listing: DataFrame, stored: DataFrame, key: str = "thread_id", stamp: str = "last_thread_comment") -> DataFrame:
    """The changed or new rows of a listing."""
    return mark_changed(listing, stored, key, stamp).filter("changed").drop("changed")


def page_prefix_until_stale(marked: DataFrame, page: str = "page_no", pos: str = "pos", category: str = "category") -> DataFrame:
    """Of mark_changed() rows, those before the first unchanged one of their page; README rows neither stop nor pass.

    Pages hold a bounded number of items, so a window by page is a small group.
    """
    rows = exclude_readme(marked, column=category)
    stale = F.sum(F.when(F.col("changed"), 0).otherwise(1)).over(Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__stale", stale).filter("__stale = 0").drop("__stale", "changed")


def join_details(listing: DataFrame, details: DataFrame, key: str = "site_url", require_details: bool = False) -> DataFrame:
    """listing with the details of its page; rows without fetched details stay with blank ones. With require_details their stamp is withheld, so that they are tried again."""
    found = details.withColumn("__found", F.lit(True))
    joined = listing.join(found, key, "left")
    if require_details and "last_thread_comment" in listing.columns:
        joined = joined.withColumn("last_thread_comment", F.when(F.col("__found"), F.col("last_thread_comment")))
    return joined.drop("__found")


def wanted_details(details: DataFrame, listing: DataFrame, key: str = "site_url") -> DataFrame:
    """Detail pages of listed rows only, before they are parsed."""
    return details.join(listing.select(key), key, "left_semi")


def lookup_maker(rows: DataFrame, makers: DataFrame) -> DataFrame:
    """rows with `creator`: the maker's name, or the maker id where it is unknown. Few makers are broadcast, which keeps common ones from skewing the join."""
    names = makers.select(F.col("maker_id").alias("__maker"), F.col("name").alias("__name"))
    if names.limit(BROADCAST_MAKERS + 1).count() <= BROADCAST_MAKERS:
        names = F.broadcast(names)
    return rows.join(names, F.col("maker_id") == F.col("__maker"), "left").withColumn("creator", F.coalesce("__name", "maker_id")).drop("__maker", "__name")
