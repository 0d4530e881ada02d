"""Tables that a job of several steps writes for itself, in the folder that driver and executors share, and files that only one writer can create."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, where spark.checkpoint.dir is unset in local mode.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset, in local mode: one for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _FOLDERS.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _FOLDERS[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


#: Folder of the current job by application, inside temporary_tables().
_JOBS: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    job = _JOBS.get(spark.sparkContext.applicationId)
    return f"{shared_folder(spark)}/{job + '/' if job else ''}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """All that a job writes for itself inside this block goes at its end: results must be written or collected by then. One job of an application at a time."""
    job, app = f"job-{uuid.uuid4().hex}", spark.sparkContext.applicationId
    before = _JOBS.get(app)
    _JOBS[app] = job
    try:
        yield
    finally:
        if before is None:
            del _JOBS[app]
        else:
            _JOBS[app] = before
        delete(spark, f"{shared_folder(spark)}/{job}")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches; nothing if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with its content at once, and only if no other writer has: true for the one that did.

    Local files are linked, those of other stores renamed without overwriting, which their file system must do in one step (HDFS does). Names that begin with _ aren't read by Spark.
    """
    folder, name = path.rpartition("/")[::2]
    spare = f"{folder}/_{name}-{uuid.uuid4().hex}"
    at = urlparse(path)
    if at.scheme in ("", "file"):
        folder, spare, path = (unquote(urlparse(p).path) for p in (folder, spare, path))
        os.makedirs(folder, exist_ok=True)
        with open(spare, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(spare, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(spare)
        return True
    jvm = spark.sparkContext._jvm  # no Spark reader or writer has such a step
    source, target = jvm.org.apache.hadoop.fs.Path(spare), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(source, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, False)
    return False
