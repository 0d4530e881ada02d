"""Incremental upserts: crawled listing, detail and feed pages become catalogue and listing rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_jobs.functions import text as tx
from catalog_jobs.operators import changes, upsert
from catalog_jobs.operators.stored import IdMark, upsert_joined
from catalog_jobs.sources import html as pages
from catalog_jobs.sources.tables import written

CATALOG = (
    "catalog_id long, id_name string, title string, short_name string, original_name string, category string, engine string, status string, version string, developer string, creator string, "
    "overview string, censored string, language string, translations string, genre string, tags string, voice string, os string, length string, banner string, banner_wide string, cover string, "
    "logo string, wallpaper string, previews string, release_date long, last_record_update long"
)
FORUM_LISTING = (
    "thread_id long, catalog_id long, banner_url string, site_url string, tags string, screens string, last_thread_comment long, thread_publish_date long, last_record_update long, "
    "views long, likes long, replies long, rating double"
)
STORE_LISTING = "product_id string, catalog_id long, maker_id string, work_type string, banner_url string, site_url string, tags string, screens string, register_date string, views long, likes long, rating double, last_record_update long"
SITE_LISTING = "site string, site_id string, catalog_id long, banner_url string, site_url string, tags string, screens string, views long, likes long, rating double, last_record_update long"

_CATALOG_FIELDS = ["id_name", "title", "short_name", "category", "engine", "status", "version", "creator", "overview", "release_date", "censored", "language", "translations", "length", "voice", "os"]
_LISTING_FIELDS = ["thread_id", "id_name", "site_url", "banner_url", "tags", "screens", "likes", "views", "replies", "rating", "thread_publish_date", "last_thread_comment"]


@dataclass
class Merged:
    catalog: DataFrame
    listing: DataFrame
    rejects: DataFrame


def merge_rows(catalog: DataFrame, listing: DataFrame, rows: DataFrame, order: list[str], now: int, key: str = "thread_id", catalog_fields: list[str] | None = None, listing_fields: list[str] | None = None, drop_blanks: bool = True, mark: IdMark | None = None) -> Merged:
    """Parsed rows into both tables: ids for new keys (above `mark`'s, if there is one), column-wise upserts by both unique keys of a listing.

    A batch row that names a stored entity takes its listing row over, other columns stay; one whose keys are those of two stored rows is a reject. Rows of the batch
    that another one for their entity replaced are listed with the rejects: their values count, their key names no row. Rows without a key go to rejects first, so that they don't gather in one group. The rows are written once: all branches read that table.
    """
    rows = written(rows, "rows")
    catalog_fields, listing_fields = catalog_fields or _CATALOG_FIELDS, listing_fields or _LISTING_FIELDS
    blank = F.col("id_name").isNull() | F.col("id_name").startswith("_") | F.col(key).isNull()
    good = rows.filter(~blank)
    entity, entry = upsert.split_record(good, [*catalog_fields, *order], list(dict.fromkeys([*listing_fields, *order])), now)
    if drop_blanks:
        epochs = [c for c in ("release_date", "thread_publish_date", "last_thread_comment") if c in entity.columns or c in entry.columns]
        entity, entry = (upsert.drop_blank(df, keep=["id_name", key], epochs=[c for c in epochs if c in df.columns]) for df in (entity, entry))
    ids = upsert.assign_catalog_ids(catalog, entity, mark=mark)
    entity = entity.join(ids.withColumnRenamed("catalog_id", "__new_id"), "id_name", "left").withColumn("catalog_id", F.col("__new_id")).drop("__new_id")  # null for known ones, which keep theirs
    merged = written(upsert_joined(catalog, entity, "id_name", order).select(*catalog.columns), "catalog")
    entry = upsert.resolve_catalog_id(entry, merged).drop("id_name")
    updated, clash = upsert.merge_two_keys(listing, entry, key, order)
    updated = written(updated.select(*listing.columns), "listing")
    named = lambda df, reason: df.select(F.col(key).cast("string").alias("key"), reason.alias("reason"))
    replaced = entry.select(key).distinct().join(updated.select(key), key, "left_anti").join(clash.select(key), key, "left_anti")
    rejects = named(rows.filter(blank), F.lit("no key")).unionByName(named(clash.dropDuplicates([key]), F.col("reason"))).unionByName(named(replaced, F.lit("entity has another row")))
    return Merged(merged, updated, rejects)


def forum_crawl(catalog: DataFrame, listing: DataFrame, list_pages: DataFrame, detail_pages: DataFrame, now: int, base_url: str = "", stop_at_stale: bool = False, require_details: bool = False, mark: IdMark | None = None) -> Merged:
    """Listing pages (page_no, html) and detail pages (url, html) into both tables; only changed threads' details are parsed, and each page once."""
    parsed, bad = pages.listing_rows(written(pages.listing_items(list_pages), "items"), base_url)
    marked = changes.mark_changed(parsed, listing)
    rows = changes.page_prefix_until_stale(marked) if stop_at_stale else changes.exclude_readme(marked.filter("changed").drop("changed"))
    wanted = changes.wanted_details(detail_pages.withColumnRenamed("url", "site_url"), rows).withColumnRenamed("site_url", "url")
    details, no_post = pages.detail_rows(written(pages.detail_items(wanted), "details"))
    full = changes.join_details(rows, details, require_details=require_details).withColumn("likes", F.col("likes").try_cast("long"))
    merged = merge_rows(catalog, listing, full, ["page_no", "pos"], now, mark=mark)
    more = bad.select(F.concat_ws("/", "page_no", "pos").alias("key"), F.lit("no date or links").alias("reason"))
    return Merged(merged.catalog, merged.listing, merged.rejects.unionByName(more).unionByName(no_post.select(F.col("site_url").alias("key"), F.lit("no post").alias("reason"))))


def latest_feed(catalog: DataFrame, listing: DataFrame, games: DataFrame, now: int, order: list[str], mark: IdMark | None = None) -> Merged:
    """read_latest_feed() rows into both tables."""
    fields = ["id_name", "title", "short_name", "version", "creator"]
    return merge_rows(catalog, listing, games, order, now, catalog_fields=fields, listing_fields=["thread_id", "id_name", "views", "likes", "rating", "banner_url", "site_url", "screens"], mark=mark)


def store_feed(catalog: DataFrame, listing: DataFrame, products: DataFrame, makers: DataFrame, now: int, order: list[str], mark: IdMark | None = None) -> Merged:
    """read_product_json() products into both tables; blank values overwrite here."""
    named = changes.lookup_maker(products, makers)
    named = named.withColumns({"short_name": tx.short_name(F.col("title")), "id_name": tx.entity_key(F.col("title"), F.col("creator"))})
    fields = ["id_name", "title", "short_name", "version", "creator"]
    return merge_rows(catalog, listing, named, order, now, "product_id", fields, ["product_id", "id_name", "maker_id", "site_url", "banner_url", "work_type", "register_date"], drop_blanks=False, mark=mark)
