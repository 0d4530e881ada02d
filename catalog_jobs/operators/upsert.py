"""Upserts, ids and entity resolution: one shuffle by key for each merge, no global window."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_jobs.functions.text import null_if_blank
from catalog_jobs.sources.tables import written

if TYPE_CHECKING:
    from catalog_jobs.operators.stored import IdMark


def drop_blank(df: DataFrame, keep: Iterable[str] = (), epochs: Iterable[str] = ()) -> DataFrame:
    """Empty strings, and zeros of epoch columns, become null, so that upsert_merge leaves stored values alone."""
    keep, epochs = set(keep), set(epochs)
    change = {f.name: null_if_blank(F.col(f.name), f.name in epochs) for f in df.schema if f.name not in keep and (f.name in epochs or f.dataType.simpleString() == "string")}
    return df.withColumns(change)


def _stacked(target: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Both with one order of effects: target first, then the batch by `order` (columns of batch only)."""
    seq = F.struct(*(F.col(c) for c in order)).alias("__seq")
    old = target.select("*", F.lit(0).alias("__new"))
    new = batch.select(*(c for c in batch.columns if c not in order or c in target.columns), seq, F.lit(1).alias("__new"))
    return old.unionByName(new, allowMissingColumns=True)


def upsert_merge(target: DataFrame, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Target with the batch's values: of each column the last one that isn't null counts; columns that the batch lacks stay.

    `order` orders the batch's rows. Rows without a key are dropped: send them to rejects first. Columns that only the
    batch has are added. Partial aggregation leaves one row for each key and task before the shuffle.
    """
    rows = _stacked(target, batch, order).filter(F.col(key).isNotNull())
    at = F.struct("__new", "__seq")
    names = [c for c in rows.columns if c not in (key, "__new", "__seq")]
    return rows.groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in names))


def upsert_replace(target: DataFrame, batch: DataFrame, key: str, order: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Target with whole rows of the batch: the last row for a key replaces the stored one, and columns it lacks become null, except those in keep (such as stable ids)."""
    rows = _stacked(target, batch, order).filter(F.col(key).isNotNull())
    at, keep = F.struct("__new", "__seq"), set(keep)
    names = [c for c in rows.columns if c not in (key, "__new", "__seq")]
    whole = [c for c in names if c not in keep]
    kept = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in names if c in keep]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*whole), at).alias("__row"), *kept)
    return last.select(key, *((F.col(c) if c in keep else F.col(f"__row.{c}")).alias(c) for c in names))


def resolve_catalog_id(rows: DataFrame, catalog: DataFrame, key: str = "id_name") -> DataFrame:
    """rows with catalog_id of the catalogue's row with the same key, 0 if there is none."""
    ids = catalog.select(F.col(key).alias("__key"), F.col("catalog_id").alias("__id"))
    joined = rows.drop("catalog_id").join(ids, F.col(key) == F.col("__key"), "left")
    return joined.withColumn("catalog_id", F.coalesce("__id", F.lit(0)).cast("long")).drop("__key", "__id")


def dense_numbers(rows: DataFrame, by: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """rows with consecutive numbers from `start` in the order of `by`, which must be unique.

    Ranges of the order are numbered each on their own, and shifted by the counts of the ranges before: no task holds all rows. The
    ranges are written once, so that a lost executor doesn't change which range a row is in.
    """
    ranged = written(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__part").count()
    # as many rows as partitions
    before = counts.withColumn("__before", F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*by)) - 1
    numbered = ranged.withColumn("__local", local).join(F.broadcast(before), "__part")
    start = F.lit(start) if isinstance(start, int) else start
    return numbered.withColumn(name, (start + F.col("__before") + F.col("__local")).cast("long")).drop("__part", "__before", "__local")


def assign_catalog_ids(catalog: DataFrame, new_rows: DataFrame, key: str = "id_name", mark: IdMark | None = None) -> DataFrame:
    """(key, catalog_id) for keys that the catalogue lacks: numbers above its largest id, in key order. Stored ids never change.

    With a mark, ids are also above any that was ever given out, so that a deleted row's id isn't used again, and two jobs at a time get different ones.
    """
    fresh = new_rows.select(key).filter(F.col(key).isNotNull()).distinct().join(catalog.select(key), key, "left_anti")
    top = catalog.agg(F.coalesce(F.max("catalog_id"), F.lit(0)).alias("m")).first()["m"]
    if mark is None:
        return dense_numbers(fresh, [key], "catalog_id", top + 1)
    fresh = written(fresh, "fresh")  # as many ids are reserved as rows are numbered
    return dense_numbers(fresh, [key], "catalog_id", mark.reserve(fresh.count(), top))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table with a `source` column; columns that a source lacks are null."""
    named = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def split_record(rows: DataFrame, catalog_columns: list[str], listing_columns: list[str], stamp: Column | int) -> tuple[DataFrame, DataFrame]:
    """One parsed table -> (catalogue rows, listing rows), both stamped with last_record_update."""
    at = (F.lit(stamp) if isinstance(stamp, int) else stamp).cast("long").alias("last_record_update")
    return rows.select(*catalog_columns, at), rows.select(*listing_columns, at)


def unique_per_catalog(listing: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each catalog_id: the last by order, rejects: the other rows). Rows without an entity (0 or null) are rejects.

    The rows of one entity are ordered by partial maxima, so that an entity with very many rows isn't sorted in one task.
    """
    with_id = listing.filter("catalog_id > 0")
    rank = F.struct(*(F.col(c) for c in order), F.col(key))
    last = with_id.groupBy("catalog_id").agg(F.max(rank).alias("__last"))
    joined = with_id.join(last, "catalog_id").withColumn("__is", rank == F.col("__last"))
    rejects = joined.filter(~F.col("__is")).drop("__is", "__last").unionByName(listing.filter("coalesce(catalog_id, 0) <= 0"))
    return joined.filter("__is").drop("__is", "__last").dropDuplicates(["catalog_id"]), rejects


def merge_two_keys(stored: DataFrame, batch: DataFrame, key: str, order: list[str], second: str = "catalog_id") -> tuple[DataFrame, DataFrame]:
    """(stored with the batch's values, rejects) where both keys are unique: a batch row updates the stored row that has either of its keys, column by column, keys too.

    So a row with a new `key` for a stored entity takes that row over, with all columns that the batch leaves null, and a stored row that comes with another
    entity moves there. A batch row whose keys are those of two different stored rows is a reject (reason "keys of two rows"), and stored rows then stay as they are. Stored keys are those before the
    batch. A row that moves away by its `key` leaves its entity free for others. Of rows for an entity that isn't stored the first by `order` decides which stored row they update,
    if any. Rows without one of the keys (null, or entity 0) are rejects with reason "no key". Rejects hold the batch's columns.

    Rows of one entity are only ever aggregated with partial maxima; stored rows are moved once, and only their two keys besides.
    """
    seq, names = F.struct(*(F.col(c) for c in order)), [c for c in batch.columns if c not in (key, second) and (c not in order or c in stored.columns)]
    complete = F.coalesce(F.col(key).isNotNull() & (F.col(second) != 0), F.lit(False))
    rows = written(batch.withColumn("__seq", seq), "batch")
    good = rows.filter(complete)
    # of one key's rows the last entity counts, and each column's last value
    one = good.groupBy(key).agg(F.max_by(second, "__seq").alias(second), F.max("__seq").alias("__seq"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(f"__{c}") for c in names))
    by_key = stored.select(F.col(key).alias("__a"))
    by_second = stored.filter(F.col(second).isNotNull()).select(F.col(key).alias("__b"), F.col(second).alias("__entity"))
    found = one.join(by_key, F.col(key) == F.col("__a"), "left").join(by_second, F.col(second) == F.col("__entity"), "left").drop("__entity")
    found = written(found, "found")
    # rows that move: their key is stored, their entity isn't; of several for one entity only the first may
    first = found.filter("__b is null").groupBy(second).agg(F.min_by("__a", "__seq").alias("__first"))
    moved = written(first.filter("__first is not null").select(F.col("__first").alias("__moved")), "moved")
    placed = found.join(first.withColumnRenamed(second, "__entity"), F.col(second) == F.col("__entity"), "left")
    # rows for entities that aren't stored, however many, have no key to meet: they stay out of the joins by stored keys
    placed = placed.filter("__b is not null").join(moved, F.col("__b") == F.col("__moved"), "left").unionByName(placed.filter("__b is null").withColumn("__moved", F.lit(None).cast(moved.schema["__moved"].dataType)))
    left = F.col("__b").isNotNull() & F.col("__moved").isNotNull()  # the stored row of this entity goes elsewhere
    target = F.when(F.col("__b").isNull(), F.col("__first")).when(~left, F.col("__b"))
    two = F.col("__a").isNotNull() & ~F.col("__a").eqNullSafe(target)
    judged = written(placed.select(key, second, "__seq", *(f"__{c}" for c in names), target.alias("__target"), two.alias("__two")), "judged")
    good_rows = judged.filter("not __two")
    value = [F.max_by(F.col(f"__{c}"), F.when(F.col(f"__{c}").isNotNull(), F.col("__seq"))).alias(f"__{c}") for c in names]
    update = good_rows.groupBy(second).agg(F.max_by(key, "__seq").alias("__key"), F.max("__target").alias("__target"), *value).withColumnRenamed(second, "__second")
    update = written(update, "update")
    both = stored.join(update.filter("__target is not null").hint("merge"), F.col(key) == F.col("__target"), "left")
    columns = dict.fromkeys([*stored.columns, *names])
    shown = {key: F.coalesce("__key", key), second: F.coalesce("__second", second)}
    shown |= {c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in stored.columns else F.col(f"__{c}") for c in names}
    inserted = update.filter("__target is null").select(F.col("__key").alias(key), F.col("__second").alias(second), *(F.col(f"__{c}").alias(c) for c in names))
    merged = both.select(*(shown.get(c, F.col(c)).alias(c) for c in columns)).unionByName(inserted, allowMissingColumns=True)
    clash = rows.filter(complete).join(judged.filter("__two").select(F.col(key).alias("__bad")), F.col(key) == F.col("__bad"), "left_semi").withColumn("reason", F.lit("keys of two rows"))
    rejects = clash.unionByName(rows.filter(~complete).withColumn("reason", F.lit("no key"))).drop("__seq")
    return merged, rejects
