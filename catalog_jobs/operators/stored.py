"""Large stored tables: bucketed by key, so that only a batch is shuffled; digests by key range, so that equal ranges aren't read; ids that are never given out again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_jobs.operators.changes import mark_changed
from catalog_jobs.operators.export import delta, snapshot_diff
from catalog_jobs.sources.tables import create_new, delete, new_path, written

if TYPE_CHECKING:
    from catalog_jobs.plans.forum import Merged


def upsert_joined(stored: DataFrame, batch: DataFrame, key: str, order: list[str], buckets: int | None = None) -> DataFrame:
    """upsert_merge() where `stored` has each key once: of each column the batch's last value that isn't null, else the stored one.

    The stored side is joined and not aggregated, so that it stays where it lies if it is bucketed by the key; buckets: deals the batch to as many.
    """
    seq = F.struct(*order)
    names = [c for c in batch.columns if c != key and (c not in order or c in stored.columns)]
    # one row a key, by partial maxima, before the batch is dealt to the buckets: common keys don't gather
    last = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(f"__{c}") for c in names))
    last = last.repartition(buckets, key) if buckets else last
    both = stored.join(last.withColumnRenamed(key, "__key").hint("merge"), F.col(key) == F.col("__key"), "full_outer")
    columns = dict.fromkeys([*stored.columns, *names])
    shown = {key: F.coalesce(key, "__key")}
    shown |= {c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in stored.columns else F.col(f"__{c}") for c in names}
    return both.select(*(shown.get(c, F.col(c)).alias(c) for c in columns))


class BucketedTable:
    """A table of the catalogue in buckets of its key, sorted within each.

    Merges and change tests read it as it lies: batches are dealt to its buckets, and the stored side has no exchange; Spark sorts each bucket again, since it
    doesn't rely on stored order. Choose the number of buckets for the table's size, a few hundred MB each; it holds until the table is saved anew.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets

    def save(self, df: DataFrame) -> None:
        """df as the table, one file a bucket; rows without a key are left out. df must not read the table itself: save a merge under a new name."""
        rows = df.filter(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)
        rows.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").mode("errorifexists").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def dealt(self, batch: DataFrame) -> DataFrame:
        """A batch in the table's partitioning."""
        return batch.filter(F.col(self.key).isNotNull()).repartition(self.buckets, self.key)

    def upsert(self, batch: DataFrame, order: list[str]) -> DataFrame:
        """What upsert_merge() of the table and the batch gives."""
        return upsert_joined(self.read(), batch, self.key, order, self.buckets)

    def changed(self, listing: DataFrame, stamp: str = "last_thread_comment") -> DataFrame:
        """The changed or new rows of a listing; those without a key are new."""
        found = mark_changed(self.dealt(listing), self.read().hint("merge"), self.key, stamp)
        return found.filter("changed").drop("changed").unionByName(listing.filter(F.col(self.key).isNull()))


RANGE = "__range"
#: Folders of a snapshot, about: where there are more key ranges, neighbouring ones share a folder.
FOLDERS = 256


def _digests(rows: DataFrame, stamp: str | None) -> DataFrame:
    """(range, n, total, mixed, top): rows, sum and exclusive or of their 64-bit hashes, and latest stamp, by key range."""
    names = sorted(c for c in rows.columns if c != RANGE)
    # a null hashes to the seed: whether a column is null is hashed too; so are the names
    row = F.xxhash64(F.lit(",".join(names)), *(F.col(c).cast("string") for c in names), *(F.col(c).isNull() for c in names))
    top = F.max(stamp).cast("long") if stamp else F.lit(None).cast("long")
    return rows.groupBy(RANGE).agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("mixed"), top.alias("top"))


def write_snapshot(df: DataFrame, path: str, key: str = "catalog_id", width: int = 1_000_000, stamp: str | None = "last_record_update") -> None:
    """df below path/rows in folders by ranges of `width` whole-number keys (null keys in one of their own), and beside them path/digests, a row for each range.

    A folder holds one range, or as many neighbouring ones as keep the folders to about FOLDERS, and is named by the first. Rows are dealt by key range, those of a range over
    several tasks if they are many. df is computed once: its rows are written aside first, since bounds and quantiles of the keys are asked for before they are dealt.
    """
    spark, aside = df.sparkSession, new_path(df.sparkSession, "rows")
    df.write.parquet(aside)
    rows, number = spark.read.schema(df.schema).parquet(aside), F.floor(F.col(key) / width)
    least, most = rows.agg(F.min(number), F.max(number)).first()
    per = 1 if least is None else (most - least) // FOLDERS + 1
    folder = F.floor(number / per) * per
    rows.withColumn(RANGE, folder).repartitionByRange(RANGE, key).write.partitionBy(RANGE).parquet(f"{path}/rows")
    digests = _digests(_rows(spark, path, df).withColumn(RANGE, number), stamp)
    digests.withColumns({"folder": F.floor(F.col(RANGE) / per) * per, "per": F.lit(per).cast("long"), "width": F.lit(width).cast("long")}).write.parquet(f"{path}/digests")
    delete(spark, aside)


def _rows(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Rows with their folder's range."""
    schema = spark.read.parquet(f"{path}/rows").schema if like is None else like.schema
    schema = T.StructType([*(f for f in schema if f.name != RANGE), T.StructField(RANGE, T.LongType())])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests; snapshots of before folders were shared have a folder for each range."""
    digests = spark.read.parquet(f"{path}/digests")
    return digests if "folder" in digests.columns else digests.withColumns({"folder": F.col(RANGE), "per": F.lit(1).cast("long"), "width": F.lit(None).cast("long")})


def _differing(spark: SparkSession, prev: str, curr: str) -> DataFrame:
    a, b = (_read_digests(spark, p).select(RANGE, F.struct("n", "total", "mixed").alias(name)) for p, name in ((prev, "a"), (curr, "b")))
    both = a.join(b.withColumnRenamed(RANGE, "other"), F.col(RANGE).eqNullSafe(F.col("other")), "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(F.when(F.col("a").isNull(), F.col("other")).otherwise(F.col(RANGE)).alias("r"))


def differing_ranges(spark: SparkSession, prev: str, curr: str) -> list[int | None]:
    """Key ranges whose digests differ, or that only one snapshot has: a number for each. Equal hashes stand for equal rows: two sums of 64 bits and the count must agree by chance to hide a change."""
    return [r["r"] for r in _differing(spark, prev, curr).collect()]


def _of_folders(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """Rows of the folders of some digests: those alone are listed and read."""
    folders = [r["folder"] for r in digests.select("folder").distinct().collect()]  # FOLDERS or so
    known = F.col(RANGE).isin([f for f in folders if f is not None])
    return rows.filter(known | F.col(RANGE).isNull() if None in folders else known).drop(RANGE)


def _some(spark: SparkSession, path: str, ranges: DataFrame, key: str) -> DataFrame:
    """Rows of some ranges."""
    digests = _read_digests(spark, path)
    rows = _of_folders(_rows(spark, path), digests.join(ranges, F.col(RANGE).eqNullSafe(F.col("r")), "left_semi"))
    shared = digests.filter("per > 1").select("width").first()  # other ranges lie in the same folders
    return rows.join(ranges, F.floor(F.col(key) / shared["width"]).eqNullSafe(F.col("r")), "left_semi") if shared else rows


def snapshot_diff_stored(spark: SparkSession, prev: str, curr: str, key: str = "catalog_id") -> DataFrame:
    """snapshot_diff() of two snapshots of write_snapshot() of one width: only folders with ranges that differ are read."""
    ranges = written(_differing(spark, prev, curr), "ranges")
    return snapshot_diff(_some(spark, prev, ranges, key), _some(spark, curr, ranges, key), key)


def delta_stored(spark: SparkSession, path: str, start_time: int, key: str = "catalog_id", stamp: str = "last_record_update", global_order: bool = True) -> DataFrame:
    """delta() of a snapshot: only folders with a later stamp are read."""
    late = _read_digests(spark, path).filter(F.col("top") > start_time)
    return delta(_of_folders(_rows(spark, path), late), start_time, key, stamp, global_order)


class IdMark:
    """The largest id ever given out, in a folder with a file for each reservation: ids of deleted rows aren't given out again, and two jobs never get the same ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _last(self) -> tuple[int, int]:
        try:
            r = self.spark.read.schema("seq long, top long").json(self.path).agg(F.max("seq").alias("seq"), F.max("top").alias("top")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, 0
        return r["seq"] or 0, r["top"] or 0

    def top(self) -> int:
        return self._last()[1]

    def reserve(self, n: int, above: int = 0) -> int:
        """The first of n ids, all larger than `above` and than any reserved before. A job that fails afterwards leaves a gap."""
        while True:
            seq, top = self._last()
            first = max(top, above) + 1
            if create_new(self.spark, f"{self.path}/{seq + 1:012d}.json", json.dumps({"seq": seq + 1, "top": first + n - 1}) + "\n"):
                return first


class CatalogStore:
    """The catalogue and a listing as bucketed tables of successive versions, and a log with a file for each: `<path>/<version>.json` names the two tables.

    A run merges into the latest version and saves the next one; it counts once its log file exists, which only one run can create. A run that another
    one gets ahead of starts again from that one's version. New ids come from a mark beside the log, so that they stay unique. Stored rows are read in the partitioning that they were saved in.
    """

    def __init__(self, spark: SparkSession, path: str, catalog_schema: str, listing_schema: str, key: str = "thread_id", entity: str = "id_name", buckets: int = 200):
        self.spark, self.path, self.buckets, self.keys = spark, path.rstrip("/"), buckets, {"catalog": entity, "listing": key}
        self.schemas = {"catalog": catalog_schema, "listing": listing_schema}
        self.mark = IdMark(spark, f"{self.path}/ids")

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version long, catalog string, listing string").json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def latest(self) -> int:
        log = self._versions()
        return 0 if log is None else log.agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> dict[str, DataFrame]:
        """The catalogue and listing of a version, the latest by default; empty ones before the first."""
        version = self.latest() if version is None else version
        if not version:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        named = self._versions().filter(F.col("version") == version).first()
        return {name: self.spark.table(named[name]) for name in self.keys}

    def apply(self, merge: Callable[[DataFrame, DataFrame, IdMark], Merged]) -> tuple[int, DataFrame]:
        """(version, rejects) of one run: merge(catalog, listing, mark) gives .catalog, .listing and .rejects, as the jobs of plans/forum.py do."""
        while True:
            version = self.latest()
            stored = self.read(version)
            made = merge(stored["catalog"], stored["listing"], self.mark)
            tables = {name: BucketedTable(self.spark, f"{name}_{uuid.uuid4().hex}", key, self.buckets) for name, key in self.keys.items()}
            for name, table in tables.items():
                table.save(getattr(made, name))
            entry = {"version": version + 1} | {name: table.name for name, table in tables.items()}
            if create_new(self.spark, f"{self.path}/log/{version + 1:012d}.json", json.dumps(entry) + "\n"):
                return version + 1, made.rejects
            for table in tables.values():
                table.drop()

    def forget(self, before: int) -> None:
        """Drops the tables of versions before one: those can't be read any more."""
        for r in self._versions().filter(F.col("version") < before).collect():  # a row for each version
            for name in self.keys:
                self.spark.sql(f"DROP TABLE IF EXISTS {r[name]}")
