import subprocess
import sys
import textwrap
from pathlib import Path

import pytest

from catalog_jobs.llm import repeats, substring_dedup
from tests.llm import brute
from tests.llm.data import documents, frame, rows

DOCS = [d for d in documents() if d[0] is not None]
REPO = Path(__file__).resolve().parents[2]


def forget_tables(spark):
    """What the end of a session does to its catalogue: the folders stay."""
    for t in spark.catalog.listTables():
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")


def test_a_second_session_adds_to_the_first_ones_index(spark, tmp_path, monkeypatch):
    got = []
    for start in range(0, 90, 30):
        job = substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index")
        got += rows(job.add(frame(spark, sorted(DOCS, key=lambda d: d[0])[start : start + 30])), "doc_id", "n_units", "n_removed", "kept_sha256")
        assert job.version == start // 30 + 1
        forget_tables(spark)
    want = brute.substring_report(sorted(DOCS, key=lambda d: d[0])[:90])
    assert sorted(got, key=repr) == want

    again = substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index")
    levels = [level for level, *_ in again.index.runs]
    assert levels == [1, 0] and len(again.texts) == 3  # three batches: merged runs are named by the manifest, and read in their buckets
    batch = spark.table(again.index.bucketed(again.index.tables()[0], "batch")[0])
    with substring_dedup._joined_by_bucket(spark):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = again.index.meet(batch)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert all(any(Path(p).glob("*.parquet")) for _, _, p in again.index.runs)
    with pytest.raises(ValueError, match="windows of 20"):
        substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index", repeats.BYTES100)


def test_a_batch_that_fails_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs = sorted(DOCS, key=lambda d: d[0])
    job = substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index")
    first = rows(job.add(frame(spark, docs[:30])), "doc_id", "n_units", "n_removed", "kept_sha256")
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "create_new", lambda *a: 1 / 0)  # after the runs were merged, before the manifest
        with pytest.raises(ZeroDivisionError):
            job.add(frame(spark, docs[30:60]))
    forget_tables(spark)
    job = substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index")
    assert job.version == 1
    second = rows(job.add(frame(spark, docs[30:60])), "doc_id", "n_units", "n_removed", "kept_sha256")
    assert sorted(first + second, key=repr) == brute.substring_report(docs[:60])


def test_two_sessions_do_not_add_at_once(spark, tmp_path):
    one, two = (substring_dedup.SubstringDedup.open(spark, f"{tmp_path}/index") for _ in range(2))
    one.add(frame(spark, DOCS[:5]))
    with pytest.raises(RuntimeError, match="another session"):
        two.add(frame(spark, DOCS[5:10]))


def test_an_operator_without_a_checkpoint_folder(tmp_path):
    """In local mode nothing has to be set."""
    import os

    code = f"""
        from pyspark.sql import SparkSession
        from catalog_jobs.llm import queries
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/w").getOrCreate()
        spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet("{tmp_path}/conversations.parquet")
        print(queries.op13_conversation_repair(spark, "{tmp_path}").count(), "fine")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("1 fine"), done.stderr[-2000:]
