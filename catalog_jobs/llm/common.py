"""What the text operators share: reading tables, word splitting and written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_jobs.sources.tables import new_path

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: What separates words made of ASCII letters, ASCII digits and everything beyond ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Shuffle files of a finished statement go at its end; a job of many steps would else keep all of them on the executors' disks.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empties one of this module's own tables that is no longer read, to free its disk space."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empties written() tables that nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            remove(table.sparkSession, files[0].rpartition("/")[0], table.schema)


def without(table: DataFrame, *columns: str) -> DataFrame:
    """A written() table without some columns, written again; the old one is emptied."""
    new = written(table.drop(*columns), "part")
    discard(table)
    return new


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() does the same, faster, where no character beyond ASCII has a lower case of its own."""
    plain = ~c.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Zs}]")
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def split_words(c: Column, separator: str = BLANKS) -> Column:
    """The words of a text, none of them empty; a null text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separator), "")
