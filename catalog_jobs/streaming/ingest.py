"""New crawl files, each once, into a versioned table that several writers may share."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalog_jobs.operators.changes import changed_threads
from catalog_jobs.operators.upsert import upsert_merge
from catalog_jobs.sources.tables import create_new, delete, written

#: One file for each version: the run and batch that it came from, and the folder and key ranges that it wrote.
LOG = "version long, source string, batch long, folder string, parts array<long>"


class Conflict(Exception):
    """Another writer's version has changed a key range that this one was made from."""


class VersionedTable:
    """Parquet folders base/data/<name>/__part=<key range>, and a log with a file for each version.

    A version writes only the key ranges that it changes and is read with the latest folder of all others. Each try writes a folder of its own; it counts once its
    log file exists, which only one writer can create for a version. What the log doesn't name isn't read, so that a try that failed, at
    whatever step, counts for nothing. A log file names the ranges of its version: keep ranges wide.
    """

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str = "thread_id", width: int = 1_000_000):
        self.spark, self.base, self.schema, self.key, self.width = spark, base.rstrip("/"), schema, key, width

    def versions(self) -> DataFrame:
        """LOG: a row for each version."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.base}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        """versions() with a row for each key range."""
        return self.versions().select("version", "source", "batch", "folder", F.explode("parts").alias("part"))

    def part(self):
        return F.floor(F.col(self.key) / self.width)

    def latest(self) -> int:
        """The last version, -1 if there is none."""
        return self.versions().agg(F.coalesce(F.max("version"), F.lit(-1)).alias("v")).first()["v"]

    def has(self, source: str, batch: int) -> bool:
        """Whether a version came from this batch of this run already."""
        return not self.versions().filter((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """A version, the latest by default: all of it, or some key ranges."""
        log = self.log()
        if version is not None:
            log = log.filter(F.col("version") <= version)
        if parts is not None:
            log = log.filter(F.col("part").isin(parts))
        last = log.groupBy("part").agg(F.max_by("folder", "version").alias("folder")).collect()  # a row for each key range
        if not last:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.base}/data/{r['folder']}/__part={r['part']}" for r in last))

    def write(self, df: DataFrame, source: str, batch: int, since: int | None = None) -> int:
        """The new version, whose rows replace the key ranges that they lie in, or an earlier one of the same batch.

        since: the version that df was made from, the latest by default. Versions of other writers since then that share no key range with df don't matter; Conflict if one does.
        """
        since = self.latest() if since is None else since
        folder = uuid.uuid4().hex
        df.withColumn("__part", self.part()).write.partitionBy("__part").parquet(f"{self.base}/data/{folder}")
        parts = sorted(r["__part"] for r in self.spark.read.parquet(f"{self.base}/data/{folder}").select("__part").distinct().collect())  # key ranges
        while True:
            newer = self.versions().filter(F.col("version") > since).orderBy("version").collect()  # other writers' versions of this moment
            for r in newer:
                if (r["source"], r["batch"]) == (source, batch):
                    return r["version"]
                if {*r["parts"]} & {*parts}:
                    raise Conflict(f"version {r['version']} changed the same key ranges")
            version = newer[-1]["version"] + 1 if newer else since + 1
            entry = {"version": version, "source": source, "batch": batch, "folder": folder, "parts": parts}
            if create_new(self.spark, f"{self.base}/log/{version:012d}.json", json.dumps(entry) + "\n"):
                return version


    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders of failed tries, and those that the last `keep` versions don't read; run it while no writer is at work. Returns their names.

        Older versions can't be read afterwards; the log stays whole, so that no batch counts twice.
        """
        log, last = self.log(), self.latest()
        live = set()
        for version in range(max(0, last - keep + 1), last + 1):
            live |= {r["folder"] for r in log.filter(F.col("version") <= version).groupBy("part").agg(F.max_by("folder", "version").alias("folder")).collect()}  # a row for each key range
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.base}/data").select(F.regexp_extract("path", "/data/([^/]+)/", 1).alias("folder"))
        old = sorted(r["folder"] for r in files.distinct().collect() if r["folder"] not in live)  # a name for each try
        for folder in old:
            delete(self.spark, f"{self.base}/data/{folder}")
        return old


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: a new checkpoint at an old path is another run."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").filter("value like '{%'").first()["value"])["id"]


def ingest_stream(spark: SparkSession, crawl_dir: str, crawl_schema: str, table: VersionedTable, checkpoint: str, stamp: str = "last_thread_comment", order: list[str] = ("fetched_at",), files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a run over all new files: changed rows are merged into the next version of the table.

    A version records the run, by the id in its checkpoint, and the batch that it came from, so that a repeated batch is left out, and a run with a fresh
    checkpoint, at whatever path, goes on from the latest version. A batch that another writer got ahead of in one of its key ranges is merged again, from
    that writer's version. Only key ranges that a batch has rows in are read, and only those with changed rows written. Late rows lose
    by the change test. Of one batch's rows for a key the last by `order` counts.
    """
    def merge(batch: DataFrame, n: int) -> None:
        run = run_id(spark, checkpoint)

        def ranges(df: DataFrame) -> list[int]:
            return [r["p"] for r in df.select(table.part().alias("p")).distinct().collect()]

        here = ranges(batch)
        while not table.has(run, n):
            since = table.latest()
            rows = written(changed_threads(batch, table.read(since, here), table.key, stamp), "changed")
            if not (parts := ranges(rows)):
                return
            stored = table.read(since, parts)
            try:
                table.write(upsert_merge(stored, rows, table.key, list(order)).select(*stored.columns), run, n, since)
            except Conflict:
                continue

    source = spark.readStream.schema(crawl_schema).option("maxFilesPerTrigger", files_per_batch).parquet(crawl_dir)
    return source.filter(F.col(table.key).isNotNull()).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
