"""Substring dedup with a log-structured fingerprint index: sorted runs of window fingerprints are merge-joined with each new batch."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_jobs.llm import repeats
from catalog_jobs.llm.common import discard, remove, written
from catalog_jobs.llm.repeats import WORDS20, Unit
from catalog_jobs.sources.tables import create_new, new_path

PLACE = ["ord", "tie", "start"]
#: A row of the index: windows around one anchor m, the digest rh of their words, the place where that content came first, how many windows.
ENTRY = T.StructType().add("m", "long").add("rh", "long").add("ord", "long").add("tie", "long").add("start", "integer").add("n", "integer").add("tied", "boolean")

#: A row of the stored texts.
TEXTS = T.StructType().add("ord", "long").add("tie", "long").add("t", "string")
#: What a stored index consists of.
MANIFEST = "version int, n_buckets int, size int, gram int, runs array<struct<level: int, path: string>>, texts array<string>"


@contextmanager
def _joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Joins by (m, rh) meet in buckets by m, without a shuffle."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(rows: DataFrame, name: str, by: list[str], n_buckets: int, dealt: bool = False, base: str | None = None) -> tuple[str, str]:
    """(table, folder) of rows in buckets by some columns, sorted by them; rows that are dealt by these already stay where they are. base: where the folder is made, the shared one by default."""
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{base}/{table}" if base else new_path(spark, name)
    with _joined_by_bucket(spark):
        rows = rows if dealt else rows.repartition(n_buckets, *by)
        rows.write.bucketBy(n_buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(table)
    return table, path


def attached(spark: SparkSession, path: str, schema: T.StructType, by: list[str], n_buckets: int) -> str:
    """The name of a new table over a folder of bucketed(), in whatever session that was written."""
    table = f"{path.rpartition('/')[2].partition('_')[0]}_{uuid.uuid4().hex}"
    columns, keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), ", ".join(by)  # an empty run has no files to tell
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {n_buckets} BUCKETS LOCATION '{path}'")
    return table


def drop(spark: SparkSession, table: str, path: str) -> None:
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")  # leaves the files
    remove(spark, path, schema)


@dataclass
class FingerprintIndex:
    """Immutable runs of ENTRY rows, each in buckets by m and sorted by it; a content is in one run only, under its first place.

    All runs have the same buckets, so that they meet each other and a new batch in merge joins without being shuffled. When `fan_in` runs have
    piled up on a level, they are merged into one run on the next level.
    """

    spark: SparkSession
    fan_in: int = 2
    #: (level, table, folder) of each run.
    runs: list[tuple[int, str, str]] = field(default_factory=list)
    n_buckets: int = 0
    #: Where runs are kept; the shared folder if it is None.
    base: str | None = None
    #: Merged runs, to be dropped once nothing names them.
    retired: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.n_buckets = self.n_buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables(), self.spark.createDataFrame([], ENTRY))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for _, t, _ in self.runs]

    def bucketed(self, rows: DataFrame, name: str, dealt: bool = False) -> tuple[str, str]:
        return bucketed(rows, name, ["m"], self.n_buckets, dealt, self.base if name.startswith("run") else None)

    def near(self, batch: DataFrame) -> DataFrame:
        """The index's rows around the anchors of a batch (a bucketed table): the one meeting of each run with it."""
        anchors = batch.select("m").distinct().hint("merge")
        return reduce(DataFrame.unionByName, (run.join(anchors, "m", "left_semi").select(*ENTRY.names) for run in self.tables()), self.spark.createDataFrame([], ENTRY))

    def meet(self, batch: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """batch (a bucketed table of m, rh and more) with `old`: the place where the index has its content, null for new ones. near: near() of the batch, as a bucketed table."""
        near = self.spark.table(self.bucketed(self.near(batch), "near", dealt=True)[0]) if near is None else near
        return batch.join(near.select("m", "rh", F.struct(*PLACE).alias("old")).hint("merge"), ["m", "rh"], "left")

    def disputed(self, fresh: DataFrame, near: DataFrame) -> DataFrame:
        """(m, ord, tie, start, n): new contents (fresh, a bucketed table) whose anchor has others, or occurs twice inside, with those others of the index (near, a bucketed table).

        New contents differ from the index's, so those of an anchor that the index has are always disputed, and the index's with them.
        """
        own = fresh.groupBy("m").agg(F.count("*").alias("k"), F.max("tied").alias("t"))
        known = near.select("m").distinct().withColumn("known", F.lit(True))
        anchors = own.join(known.hint("merge"), "m", "left").filter((F.col("k") > 1) | F.col("t") | F.col("known")).select("m")
        parts = [fresh.join(anchors.hint("merge"), "m").select("m", *PLACE, "n"), near.join(own.select("m").hint("merge"), "m", "left_semi").select("m", *PLACE, "n")]
        with _joined_by_bucket(self.spark):
            return written(reduce(DataFrame.unionByName, parts), "disputed")

    def add(self, table: str, path: str) -> None:
        """One more run: a bucketed() table of ENTRY rows."""
        self.runs.append((0, table, path))

    def compact(self) -> None:
        """Merges the runs of a level that has fan_in of them, level by level."""
        level = 0
        while any(at >= level for at, _, _ in self.runs):
            full = [r for r in self.runs if r[0] == level]
            if len(full) >= self.fan_in:
                merged = reduce(DataFrame.unionByName, (self.spark.table(t) for _, t, _ in full))
                made = self.bucketed(merged, f"run{level + 1}")
                self.runs = [r for r in self.runs if r not in full] + [(level + 1, *made)]
                self.retired += [(table, path) for _, table, path in full]
            level += 1


class SubstringDedup:
    """Removes, batch by batch in the order of documents, each word in a window whose words also start earlier.

    Batches must come in the order of doc_id. Null and empty texts have no words; texts shorter than a window lose
    nothing; repeated rows of one doc_id and text are one document and get equal results; a null doc_id comes before all others. A
    very long text is read whole by one task.

    Only a batch's own texts are fingerprinted and shuffled: they are stored in buckets by document, each once. What the index matches is verified on the words: contents are the same if their words have one BLAKE2b
    digest. Where contents of one anchor differ, their words are fetched, from older texts too, and compared in pieces in the same way, down to single windows.

    With a path, the index outlives the session: runs and texts are kept below it, and after each batch a new manifest names those that hold. A batch that fails before its manifest
    leaves the index as it was, and is added again; see open(). Without one, the index lies in the shared folder and ends with the session.
    """

    def __init__(self, spark: SparkSession, unit: Unit = WORDS20, fan_in: int = 2, path: str | None = None):
        self.path = path.rstrip("/") if path else None
        self.unit, self.index = unit, FingerprintIndex(spark, fan_in, base=self.path and f"{self.path}/data")
        self.texts: list[tuple[str, str]] = []  # (table, folder) of (ord, tie, t) in buckets by document for each batch so far
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, unit: Unit = WORDS20, fan_in: int = 2) -> SubstringDedup:
        """The index that another session left below path, or a new one if there is none; its buckets stay as many as they were."""
        job = cls(spark, unit, fan_in, path)
        try:
            manifests = spark.read.schema(MANIFEST).json(f"{job.path}/manifest")
            last = manifests.filter(F.col("version") == manifests.agg(F.max("version")).first()[0]).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return job
        if (last["size"], last["gram"]) != (unit.size, unit.gram):
            raise ValueError(f"the index has windows of {last['size']} units with anchors of {last['gram']}")
        job.version, job.index.n_buckets = last["version"], last["n_buckets"]
        job.index.runs = [(r["level"], attached(spark, r["path"], ENTRY, ["m"], job.index.n_buckets), r["path"]) for r in last["runs"]]
        job.texts = [(attached(spark, p, TEXTS, ["ord", "tie"], job.index.n_buckets), p) for p in last["texts"]]
        return job

    def _commit(self) -> None:
        """The manifest of the index as it is now, which only one session can write; then merged runs go."""
        index = self.index
        if self.path:
            runs = [{"level": level, "path": path} for level, _, path in index.runs]
            entry = {"version": self.version + 1, "n_buckets": index.n_buckets, "size": self.unit.size, "gram": self.unit.gram, "runs": runs, "texts": [p for _, p in self.texts]}
            if not create_new(index.spark, f"{self.path}/manifest/{self.version + 1:012d}.json", json.dumps(entry) + "\n"):
                raise RuntimeError("another session has added a batch to this index: open it again")
            self.version += 1
        for table, path in index.retired:
            drop(index.spark, table, path)
        index.retired.clear()

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_units, n_removed, n_spans, kept_sha256) for each row of docs, a new batch, as a table."""
        spark, by, n = docs.sparkSession, ["ord", "tie"], self.index.n_buckets
        documents = repeats.keyed(docs)
        store = bucketed(documents.groupBy(*by).agg(F.first("t").alias("t")), "texts", by, n, dealt=True, base=self.index.base)
        self.texts.append(store)
        prints = written(repeats.text_runs(documents, self.unit), "prints")
        runs = prints.select("ord", "tie", F.explode("runs").alias("r")).select("ord", "tie", "r.*")
        contents = runs.groupBy("m", "rh").agg(F.min(F.struct(*PLACE)).alias("first"), F.max("n").alias("n"), F.max("tied").alias("tied"), F.count("*").alias("c"))
        batch = self.index.bucketed(contents.select("m", "rh", "first.*", "n", "tied", "c"), "batch")
        near = self.index.bucketed(self.index.near(spark.table(batch[0])), "near", dealt=True)
        met = self.index.bucketed(self.index.meet(spark.table(batch[0]), spark.table(near[0])), "met", dealt=True)
        drop(spark, *batch)
        found = spark.table(met[0])
        fresh = self.index.bucketed(found.filter("old is null").select(*ENTRY.names), "run0", dealt=True)
        wanted = self.index.disputed(spark.table(fresh[0]), spark.table(near[0]))
        drop(spark, *near)
        again = found.filter("c > 1 or old is not null").select("m", "rh", F.coalesce("old", F.struct(*PLACE)).alias("first"))
        later = runs.join(again.hint("merge"), ["m", "rh"]).filter(F.struct(*PLACE) != F.col("first"))
        gone = [written(later.select(*PLACE, "n"), "later")]
        drop(spark, *met)
        narrow = written(prints.drop("runs"), "prints")
        discard(prints)

        holders = bucketed(repeats.runs_by_document(wanted), "holders", by, n, dealt=True)
        discard(wanted)
        fetched = [repeats.run_contents(spark.table(t).hint("merge"), spark.table(holders[0]), self.unit) for t, _ in self.texts]
        contents = written(reduce(DataFrame.unionByName, fetched), "contents")
        drop(spark, *holders)
        for step in self.unit.steps:
            more, left = repeats.settle(contents, self.unit, step)
            gone.append(more)
            discard(contents)
            contents = left
        out = written(repeats.removed_report(spark.table(store[0]), narrow, reduce(DataFrame.unionByName, gone), self.unit), "report")
        discard(narrow, *gone)
        self.index.add(*fresh)
        self.index.compact()
        self._commit()
        return out


def dedup_in_batches(docs: DataFrame, n_batches: int = 3, unit: Unit = WORDS20) -> DataFrame:
    """SubstringDedup over docs, in n_batches ranges of doc_id: doc_id, n_units, n_removed, n_spans, kept_sha256.

    Null and empty texts, very long ones, ties and repeated rows are as there; an empty table gives an empty report.
    """
    at = F.col("doc_id").cast("long")
    cuts = docs.select(F.percentile_approx(at, [i / n_batches for i in range(1, n_batches)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    job, out = SubstringDedup(docs.sparkSession, unit), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs
        if low is not None:
            batch = batch.filter(at > low)
        if high is not None:
            batch = batch.filter(at.isNull() | (at <= high) if low is None else at <= high)
        part = job.add(batch)
        out = part if out is None else out.unionByName(part)
    return out
