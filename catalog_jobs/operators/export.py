"""Packages, backups, checksums and the manifest; deltas and differences between snapshots."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_jobs.operators.upsert import upsert_merge
from catalog_jobs.sources.tables import create_new

MANIFEST = "date long, name string, md5 string"
MIN_VERSION = "0.0.0"


def delta(table: DataFrame, start_time: int, key: str = "catalog_id", stamp: str = "last_record_update", global_order: bool = True) -> DataFrame:
    """Rows changed after start_time, by key; a null stamp is never exported. Without global_order the files are sorted in key ranges."""
    rows = table.filter(F.col(stamp) > start_time)
    return rows.orderBy(key) if global_order else rows.repartitionByRange(key).sortWithinPartitions(key)


def write_package(tables: dict[str, DataFrame], path: str, start_time: int, keys: dict[str, str], codec: str = "gzip", rows_per_file: int = 1_000_000) -> None:
    """Compressed JSON Lines of each table's delta under path/<table>, and a header with min_ver."""
    for name, df in tables.items():
        delta(df, start_time, keys[name], global_order=False).write.option("compression", codec).option("maxRecordsPerFile", rows_per_file).json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(MIN_VERSION).alias("min_ver")).coalesce(1).write.json(f"{path}/header")


def write_backup(tables: dict[str, DataFrame], folder: str, day: str) -> str:
    """Plain JSON of whole tables in folder/<yyyyMMdd>; dates and other types as text. day: yyyy-MM-dd."""
    path = f"{folder}/{day.replace('-', '')}"
    for name, df in tables.items():
        plain = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz", "decimal", "binary") else F.col(f.name) for f in df.schema]
        df.select(*plain).write.json(f"{path}/{name}")
    return path


def package_checksum(spark: SparkSession, path: str) -> DataFrame:
    """(md5, n_rows) of all lines of the part files below path, each with the name of its table's folder.

    Files are read as streams of lines, so that their size doesn't matter and large plain ones are hashed in pieces. Each line's MD5 is taken as four numbers;
    their sums over all lines, with their count, are the digest's text. So it doesn't depend on how rows lie in files or on their compression,
    and tells any lost, added or changed row. It guards against faults, not against forgery.
    """
    table = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/part-[^/]*$", 1)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(path).select(F.md5(F.concat(table, F.lit(":"), "value")).alias("m"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("m", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]
    return lines.agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), *sums)).alias("md5"), F.count("*").alias("n_rows"))


def register_package(manifest: DataFrame, date: int, name: str, md5: str) -> DataFrame:
    """The manifest with one more package; of two in one second the later counts. See publish_package() for a stored one."""
    new = manifest.sparkSession.createDataFrame([(date, name, md5, 0)], MANIFEST + ", seq int")
    return upsert_merge(manifest, new, "date", ["seq"])


def read_manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(version, rows) of the latest manifest that publish_package() wrote below path; version 0 and no rows if there is none."""
    empty = spark.createDataFrame([], MANIFEST)
    try:
        rows = spark.read.schema(MANIFEST).json(path).withColumn("file", F.col("_metadata.file_name"))
        last = rows.agg(F.max("file").alias("f")).first()["f"]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (0, empty) if last is None else (int(last.partition(".")[0]), rows.filter(F.col("file") == last).drop("file"))


def publish_package(spark: SparkSession, path: str, date: int, name: str, md5: str, only: bool = False) -> int:
    """The manifest's next version, with one more package, or with it alone after a rebuild: one whole file, which readers see at once. Of two jobs at a time the later one starts from the other's version.

    A manifest has a row for each package, a few a day, and is written by the driver.
    """
    while True:
        version, manifest = read_manifest(spark, path)
        rows = register_package(manifest.limit(0) if only else manifest, date, name, md5).orderBy("date").collect()
        if create_new(spark, f"{path}/{version + 1:012d}.json", "".join(json.dumps(r.asDict()) + "\n" for r in rows)):
            return version + 1


def package_kind(manifest: DataFrame) -> list[str]:
    """What a run makes, in order: the first a base package, then a backup; later ones a backup, then a daily package."""
    return ["base", "backup"] if manifest.isEmpty() else ["backup", "daily"]


def rebuild_master(tables: dict[str, DataFrame], path: str, date: int, name: str, keys: dict[str, str]) -> DataFrame:
    """A full package (every stamped row) and a new manifest that lists only it."""
    spark = next(iter(tables.values())).sparkSession
    write_package(tables, path, 0, keys)
    return register_package(spark.createDataFrame([], MANIFEST), date, name, package_checksum(spark, path).first()["md5"])


def snapshot_diff(prev: DataFrame, curr: DataFrame, key: str = "catalog_id") -> DataFrame:
    """(key, change, field, old, new): added and removed rows once, changed ones for each field that differs; nulls are equal."""
    fields = [c for c in prev.columns if c in curr.columns and c != key]
    old, new = (df.select(F.col(key).alias(f"{side}_key"), F.struct(*(F.col(c).cast("string").alias(c) for c in fields)).alias(side)) for side, df in (("old", prev), ("new", curr)))
    both = old.join(new, F.col("old_key") == F.col("new_key"), "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")) | F.col("old_key").isNull() | F.col("new_key").isNull())
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"old.{c}").alias("old"), F.col(f"new.{c}").alias("new")) for c in fields))
    differ = F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
    one = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").otherwise("changed")
    rows = both.select(F.coalesce("old_key", "new_key").alias(key), change.alias("change"), F.explode(F.when(change == "changed", differ).otherwise(one)).alias("d"))
    return rows.select(key, "change", "d.field", "d.old", "d.new")
