import hashlib
import json
import random
import shutil
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from catalog_jobs.operators import changes, contracts, export, serve, stored, upsert
from catalog_jobs.plans import forum
from catalog_jobs.sources import readers
from catalog_jobs.sources.tables import create_new, new_path, temporary_tables, written
from catalog_jobs.streaming import ingest
from catalog_jobs.streaming.ingest import Conflict, VersionedTable, ingest_stream, run_id
from tests.test_jobs import rows

REPO = Path(__file__).resolve().parents[1]
ROWS, CRAWL = "thread_id long, last_thread_comment long, title string", "thread_id long, last_thread_comment long, title string, fetched_at long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def put(spark, path, *values):
    spark.createDataFrame(list(values), CRAWL).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path, table, checkpoint="cp", source="in"):
    ingest_stream(spark, f"{tmp_path}/{source}", CRAWL, table, f"{tmp_path}/{checkpoint}").awaitTermination(120)
    return rows(table.read())


def test_a_new_run_at_an_old_checkpoint_path(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10)
    put(spark, tmp_path / "in", (1, 5, "a", 1))
    assert run(spark, tmp_path, table) == [(1, 5, "a")]
    old = run_id(spark, f"{tmp_path}/cp")
    shutil.rmtree(tmp_path / "cp")
    put(spark, tmp_path / "in2", (2, 5, "b", 1))
    assert run(spark, tmp_path, table, source="in2") == [(1, 5, "a"), (2, 5, "b")]  # batch 0 of another run counts
    assert run_id(spark, f"{tmp_path}/cp") != old and table.latest() == 1


def test_a_batch_that_fails_between_data_and_log(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10)
    put(spark, tmp_path / "in", (1, 5, "a", 1), (15, 5, "b", 1))

    def lost(*args):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(ingest, "create_new", lost)
        with pytest.raises(StreamingQueryException):
            run(spark, tmp_path, table)
    assert (table.latest(), rows(table.read()), len(list((tmp_path / "t" / "data").iterdir()))) == (-1, [], 1)
    assert run(spark, tmp_path, table) == [(1, 5, "a"), (15, 5, "b")]  # the batch is done again, and the folder of the first try isn't read
    assert table.latest() == 0 and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_a_batch_that_is_logged_but_not_checkpointed(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10)
    put(spark, tmp_path / "in", (1, 5, "a", 1))
    run(spark, tmp_path, table)
    for p in (tmp_path / "cp" / "commits").iterdir():  # as if the driver had died after the log's file
        p.unlink()
    assert run(spark, tmp_path, table) == [(1, 5, "a")] and table.latest() == 0


def test_folders_that_nothing_reads_go(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10)
    frame = lambda *v: spark.createDataFrame(list(v), ROWS)
    with monkeypatch.context() as m:
        m.setattr(ingest, "create_new", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.write(frame((1, 1, "failed")), "x", 0)
    for n, v in enumerate([(1, 1, "a"), (15, 1, "b"), (1, 2, "c"), (1, 3, "d")]):
        table.write(frame(v), "x", n)
    assert len(table.vacuum(keep=2)) == 2  # the failed try, and the first version's
    assert rows(table.read()) == [(1, 3, "d"), (15, 1, "b")] and rows(table.read(2)) == [(1, 2, "c"), (15, 1, "b")]
    assert table.vacuum(keep=2) == [] and table.has("x", 0)


def test_tables_of_a_job_go_at_its_end(spark):
    with temporary_tables(spark):
        kept = rows(written(spark.range(3), "a"))
        folder = new_path(spark, "b").rpartition("/")[0]
        assert Path(folder).is_dir()
    assert kept == [(0,), (1,), (2,)] and not Path(folder).exists() and new_path(spark, "b").count("/job-") == 0


def test_two_writers_of_one_table(spark, tmp_path):
    one, two = (VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10) for _ in range(2))
    frame = lambda *v: spark.createDataFrame(list(v), ROWS)
    assert one.write(frame((1, 1, "a"), (15, 1, "b")), "x", 0) == 0
    assert two.write(frame((25, 1, "c")), "y", 0, since=-1) == 1  # other key ranges: the next version
    with pytest.raises(Conflict):
        two.write(frame((2, 1, "d")), "y", 1, since=-1)
    assert one.write(frame((2, 1, "d")), "x", 0, since=-1) == 0  # the same batch again
    assert rows(one.read()) == rows(two.read()) == [(1, 1, "a"), (15, 1, "b"), (25, 1, "c")]


def test_a_stream_that_another_writer_gets_ahead_of(spark, tmp_path, monkeypatch):
    table, other = (VersionedTable(spark, f"{tmp_path}/t", ROWS, width=10) for _ in range(2))
    put(spark, tmp_path / "in", (1, 5, "mine", 1), (2, 5, "late", 1), (3, 5, "new", 1))
    write, seen = table.write, []

    def slow(*args):
        if not seen:  # the other one's version comes between this one's read and its log file
            seen.append(other.write(spark.createDataFrame([(1, 3, "theirs"), (2, 9, "theirs"), (4, 1, "theirs")], ROWS), "other", 0))
        return write(*args)

    monkeypatch.setattr(table, "write", slow)
    assert run(spark, tmp_path, table) == [(1, 5, "mine"), (2, 9, "theirs"), (3, 5, "new"), (4, 1, "theirs")]
    assert table.latest() == 1


@pytest.mark.parametrize("store", ["", "file://", "viewfs://store"])
def test_a_file_is_created_once(spark, tmp_path, store):
    folder = "/in" if store.startswith("viewfs") else str(tmp_path)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    path = f"{store}{folder}/log/00001.json"
    assert [create_new(spark, path, t) for t in ('{"a": "é"}\n', "no")] == [True, False]
    assert (tmp_path / "log" / "00001.json").read_text() == '{"a": "é"}\n'
    assert spark.read.json(f"{store}{folder}/log").count() == 1
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".")] == ["00001.json"]


def test_no_checkpoint_folder_is_needed_in_local_mode(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from catalog_jobs.operators import upsert
        from catalog_jobs.sources.tables import shared_folder
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{tmp_path}/w").getOrCreate()
        new = spark.createDataFrame([("b",), ("a",)], "id_name string")
        ids = upsert.assign_catalog_ids(spark.createDataFrame([("z", 7)], "id_name string, catalog_id long"), new)
        assert sorted(map(tuple, ids.collect())) == [("a", 8), ("b", 9)]
        assert shared_folder(spark) == shared_folder(spark)
        print("fine")
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=REPO, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(REPO), "TMPDIR": str(tmp_path), **_java()}, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def _java():
    import os

    return {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "HOME", "SPARK_HOME", "PATH", "PYSPARK_PYTHON", "SPARK_LOCAL_IP")}


LISTING, BATCH = "thread_id long, catalog_id long, banner_url string, views long", "thread_id long, catalog_id long, banner_url string, views long, seq int"


def two_keys(spark, old, new):
    merged, rejects = upsert.merge_two_keys(spark.createDataFrame(old, LISTING), spark.createDataFrame(new, BATCH), "thread_id", ["seq"])
    return rows(merged), rows(rejects, "thread_id", "reason")


def test_a_second_thread_of_a_stored_entity_takes_its_row_over(spark):
    assert two_keys(spark, [(1, 10, "b", 5)], [(2, 10, None, 7, 0)]) == ([(2, 10, "b", 7)], [])


def test_a_row_that_hits_two_stored_rows_changes_none(spark):
    old = [(1, 10, "a", 1), (2, 20, "b", 2)]
    assert two_keys(spark, old, [(1, 20, "x", 9, 0)]) == (old, [(1, "keys of two rows")])
    assert two_keys(spark, old, [(1, 20, "x", 9, 0), (1, 10, None, 8, 1)]) == ([(1, 10, "x", 8), (2, 20, "b", 2)], [])  # of one thread the last entity counts


def test_moves_chains_and_rows_without_keys(spark):
    old = [(1, 10, "a", 1), (2, 20, "b", 2), (3, 30, "c", 3)]
    new = [(1, 40, None, 5, 0), (4, 10, None, 6, 1), (5, 50, "n", 7, 2), (6, 50, None, 8, 3), (2, 60, None, 9, 4), (3, 60, None, 9, 5), (None, 70, "x", 0, 6), (7, 0, "x", 0, 7), (8, None, "x", 0, 8)]
    merged, rejects = two_keys(spark, old, new)
    assert merged == [(1, 40, "a", 5), (2, 60, "b", 9), (3, 30, "c", 3), (4, 10, None, 6), (6, 50, "n", 8)]
    assert rejects == [(3, "keys of two rows"), (7, "no key"), (8, "no key"), (None, "no key")]


@pytest.mark.parametrize("seed", range(3))
def test_both_keys_stay_unique(spark, seed):
    rng = random.Random(seed)
    old = [(t, 100 + t, f"b{t}", t) for t in range(20)]
    new = [(rng.randrange(30), 100 + rng.randrange(30), rng.choice([None, "n"]), rng.choice([None, s]), s) for s in range(25)]
    merged, rejects = two_keys(spark, old, new)
    assert len({r[0] for r in merged}) == len({r[1] for r in merged}) == len(merged)
    last = {r[0]: r for r in new}
    bad = {r[0] for r in rejects}
    clash = {t for t, r in last.items() if t < 20 and r[1] - 100 < 20 and r[1] - 100 != t}
    assert clash <= bad  # keys of two rows, as they were before the batch
    untouched = [r for r in old if r[0] not in last and r[1] not in {x[1] for x in last.values()}]
    assert set(untouched) <= set(merged)
    assert not rows(two_keys_again(spark, merged, new, bad), "thread_id", "catalog_id")


def two_keys_again(spark, merged, new, bad):
    """What a repeated batch changes of its accepted rows' keys: nothing, since merged keys are those of the batch."""
    df = spark.createDataFrame(merged, LISTING)
    own = df.withColumn("seq", F.lit(0))
    again, _ = upsert.merge_two_keys(df, own, "thread_id", ["seq"])
    return again.exceptAll(df)


def test_a_merge_keeps_the_banner_of_an_entity(spark):
    catalog, listing = spark.createDataFrame([], forum.CATALOG), spark.createDataFrame([], forum.FORUM_LISTING)
    feed = "thread_id long, title string, creator string, version string, views long, likes long, rating double, banner_url string, site_url string, screens string, short_name string, id_name string, n int"
    game = lambda t, banner, n: (t, "A", "B", "v1", n, None, None, banner, f"/t/{t}", None, "A", "A_B", n)
    first = forum.latest_feed(catalog, listing, spark.createDataFrame([game(1, "/x.jpg", 1)], feed), 100, ["n"])
    second = forum.latest_feed(first.catalog, first.listing, spark.createDataFrame([game(2, "", 2)], feed), 200, ["n"])
    assert rows(second.listing, "thread_id", "catalog_id", "banner_url", "site_url", "views") == [(2, 1, "/x.jpg", "/t/2", 2)]
    assert rows(second.rejects) == []


@pytest.fixture
def table(spark):
    t = stored.BucketedTable(spark, f"buckets_{random.randrange(1 << 40)}", "k", 5)
    yield t
    t.drop()


def test_only_the_batch_is_shuffled(spark, table):
    old = spark.createDataFrame([(i, f"a{i}", i) for i in range(200)] + [(None, "none", 0)], "k long, a string, stamp long")
    table.save(old)
    batch = spark.createDataFrame([(5, None, 7, 1), (5, "x", None, 0), (900, "new", 1, 2), (None, "z", 1, 3)], "k long, a string, stamp long, seq int")
    merged = table.upsert(batch, ["seq"])
    assert rows(merged) == rows(upsert.upsert_merge(old, batch, "k", ["seq"]))
    listing = spark.createDataFrame([(3, 3), (4, 5), (901, 1), (None, 2)], "k long, stamp long")
    found = table.changed(listing, "stamp")
    assert rows(found, "k") == rows(changes.changed_threads(listing, old, "k", "stamp"), "k") == [(4,), (901,), (None,)]
    for df in (merged, found):  # from the scan of the stored side up to the join there is no exchange
        lines = plan(df).split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
        depth, above = lines[at].index("FileScan") if "FileScan" in lines[at] else len(lines[at]), []
        for x in reversed(lines[:at]):
            indent = len(x) - len(x.lstrip(" :+-*(0123456789)"))
            if indent < depth:
                depth = indent
                above.append(x)
            if "SortMergeJoin" in x and indent == depth:
                break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_a_merge_is_saved_as_the_next_table(spark, table):
    table.save(spark.createDataFrame([(1, "a")], "k long, a string"))
    after = stored.BucketedTable(spark, f"{table.name}_2", "k", 5)
    after.save(table.upsert(spark.createDataFrame([(2, "b", 0)], "k long, a string, seq int"), ["seq"]))
    assert rows(after.read()) == [(1, "a"), (2, "b")]
    after.drop()


def test_contracts_take_one_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a|b", "c", 1), (1, "a", "b|c", 9), (2, None, None, None)], "k int, v string, w string, r int").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    a, b = spark.createDataFrame([(1,), (9,), (None,)], "x int"), spark.createDataFrame([(1,)], "x int")
    found = contracts.check_contract(t, "t", unique=[["v", "w"], ["k"]], required=["v", "w", "k"], references=[("r", a, "x"), ("r", b, "x")], max_bytes={"v": 2})
    assert rows(found) == sorted([("t", "unique", "k", "1", 2), ("t", "not_null", "v", None, 1), ("t", "not_null", "w", None, 1), ("t", "reference", "r", "9", 1), ("t", "max_bytes", "v", "3", 1)], key=repr)
    odd = spark.createDataFrame([("a\x00\x01b", "c"), ("a", "b\x00\x01c"), ("a\x00\x01b", "c")], "v string, w string")
    assert rows(contracts.check_contract(odd, "odd", unique=[["v", "w"]])) == [("odd", "unique", "v,w", "a\x00\x01b|c", 2)]
    assert plan(found).split("== Initial Plan ==")[0].count("FileScan") == 1
    assert plan(found).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_equal_ranges_are_not_read(spark, tmp_path):
    schema = "catalog_id long, title string, last_record_update long"
    old = [(i, f"t{i}", i) for i in range(100)] + [(None, "no key", None)]
    new = [(i, "changed" if i == 42 else f"t{i}", 1000 if i == 42 else i) for i in range(95)] + [(None, "no key", None), (205, "new", 7)]
    for name, values in (("a", old), ("b", new), ("c", old)):
        stored.write_snapshot(spark.createDataFrame(values, schema).repartition(3), f"{tmp_path}/{name}", width=10)
    a, b, c = (f"{tmp_path}/{x}" for x in "abc")
    assert sorted(stored.differing_ranges(spark, a, b)) == [4, 9, 20] and stored.differing_ranges(spark, a, c) == []
    for name in ("a", "b"):  # what isn't to be read is gone
        for folder in (tmp_path / name / "rows").glob("__range=*"):
            if folder.name not in ("__range=4", "__range=9", "__range=20"):
                shutil.rmtree(folder)
    found = stored.snapshot_diff_stored(spark, a, b)
    frames = [spark.createDataFrame([r for r in v if r[0] is not None], schema) for v in (old, new)]
    assert rows(found) == rows(export.snapshot_diff(*frames))
    for folder in ("__range=9", "__range=20"):
        shutil.rmtree(tmp_path / "b" / "rows" / folder)
    late = stored.delta_stored(spark, b, 500)
    assert rows(late) == [(42, "changed", 1000)] and "PartitionFilters: [isnotnull(__range" in plan(late)
    assert stored.snapshot_diff_stored(spark, a, c).count() == 0
    stored.write_snapshot(spark.createDataFrame([(1, None, "x")], "catalog_id long, a string, b string"), f"{tmp_path}/d", width=10, stamp=None)
    stored.write_snapshot(spark.createDataFrame([(1, "x", None)], "catalog_id long, a string, b string"), f"{tmp_path}/e", width=10, stamp=None)
    assert stored.differing_ranges(spark, f"{tmp_path}/d", f"{tmp_path}/e") == [0]  # a value that moves to another column is a change


def test_neighbouring_ranges_share_a_folder_where_there_are_many(spark, tmp_path):
    schema = "catalog_id long, title string, last_record_update long"
    old = [(i, f"t{i}", i) for i in range(5000)] + [(None, "no key", None)]
    new = [(i, "changed" if i == 4321 else f"t{i}", 9000 if i == 4321 else i) for i in range(6000)] + [(None, "no key", None)]
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    stored.write_snapshot(spark.createDataFrame(old, schema), a, width=1)
    stored.write_snapshot(spark.createDataFrame(new, schema), b, width=1)
    for name in ("a", "b"):
        assert 200 < len(list((tmp_path / name / "rows").glob("__range=*"))) < 260
    differ = [4321, *range(5000, 6000)]
    assert sorted(stored.differing_ranges(spark, a, b)) == differ
    for name, per in (("a", 20), ("b", 24)):  # folders of equal ranges aren't read
        for folder in (tmp_path / name / "rows").glob("__range=*"):
            at = folder.name.partition("=")[2]
            if at.startswith("__") or not any(int(at) <= r < int(at) + per for r in differ):
                shutil.rmtree(folder)
    frames = [spark.createDataFrame([r for r in v if r[0] is not None], schema) for v in (old, new)]
    assert rows(stored.snapshot_diff_stored(spark, a, b)) == rows(export.snapshot_diff(*frames))
    assert rows(stored.delta_stored(spark, b, 8000)) == [(4321, "changed", 9000)]


def test_ids_of_deleted_rows_are_not_given_out_again(spark, tmp_path):
    mark = stored.IdMark(spark, f"{tmp_path}/mark")
    new = lambda *keys: spark.createDataFrame([(k,) for k in keys], "id_name string")
    catalog = upsert.assign_catalog_ids(spark.createDataFrame([("z", 3)], "id_name string, catalog_id long"), new("a", "b", "z"), mark=mark)
    assert rows(catalog) == [("a", 4), ("b", 5)]
    assert rows(upsert.assign_catalog_ids(catalog.filter("catalog_id < 5"), new("c"), mark=mark)) == [("c", 6)]
    assert rows(upsert.assign_catalog_ids(catalog.limit(0), new("c", "d"), mark=mark)) == [("c", 7), ("d", 8)]
    assert (mark.top(), mark.reserve(3), mark.reserve(1, above=50)) == (8, 9, 51)
    schema = "thread_id long, title string, creator string, version string, views long, likes long, rating double, banner_url string, site_url string, screens string, short_name string, id_name string, n int"
    games = spark.createDataFrame([(1, "A", "B", "v1", 1, None, None, None, "/t", None, "A", "A_B", 1)], schema)
    made = forum.merge_rows(spark.createDataFrame([], forum.CATALOG), spark.createDataFrame([], forum.FORUM_LISTING), games, ["n"], 1, catalog_fields=["id_name", "title"], listing_fields=["thread_id", "id_name", "views"], mark=mark)
    assert rows(made.catalog, "catalog_id") == [(52,)]


def test_two_jobs_reserve_different_ids(spark, tmp_path, monkeypatch):
    one, two = (stored.IdMark(spark, f"{tmp_path}/mark") for _ in range(2))
    last, seen = one._last, []

    def raced():
        found = last()
        if not seen:
            seen.append(two.reserve(10))
        return found

    monkeypatch.setattr(one, "_last", raced)
    assert (one.reserve(5), seen) == (11, [1])


def test_checksums_are_of_rows(spark, tmp_path):
    t = spark.createDataFrame([(i, f"t{i} é", i * 10) for i in range(50)], "catalog_id long, title string, last_record_update long")
    key = {"catalog": "catalog_id"}
    export.write_package({"catalog": t}, f"{tmp_path}/a", 0, key)
    export.write_package({"catalog": t.repartition(7)}, f"{tmp_path}/b", 0, key, codec="none", rows_per_file=3)
    export.write_package({"catalog": t.withColumn("title", F.when(F.col("catalog_id") == 7, "x").otherwise(F.col("title")))}, f"{tmp_path}/c", 0, key)
    export.write_package({"other": t}, f"{tmp_path}/d", 0, {"other": "catalog_id"})
    a, b, c, d = (tuple(export.package_checksum(spark, f"{tmp_path}/{x}").first()) for x in "abcd")
    lines = [f"catalog:{json.dumps({'catalog_id': i, 'title': f't{i} é', 'last_record_update': i * 10}, separators=(',', ':'), ensure_ascii=False)}" for i in range(1, 50)] + ['header:{"min_ver":"0.0.0"}']
    sums = [sum(int(hashlib.md5(x.encode()).hexdigest()[8 * i : 8 * i + 8], 16) for x in lines) for i in range(4)]
    assert a == (hashlib.md5(":".join(map(str, [len(lines), *sums])).encode()).hexdigest(), 50)
    assert a == b and len({a, c, d}) == 3


def test_manifests_are_published_as_versions(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/manifest"
    assert export.publish_package(spark, path, 100, "base", "a") == 1
    create, seen = export.create_new, []

    def raced(*args):
        if not seen:
            seen.append(1)
            assert export.publish_package(spark, path, 150, "daily", "c") == 2  # another job's package comes first
        return create(*args)

    monkeypatch.setattr(export, "create_new", raced)
    assert export.publish_package(spark, path, 200, "daily", "b") == 3
    version, manifest = export.read_manifest(spark, path)
    assert version == 3 and rows(manifest) == [(100, "base", "a"), (150, "daily", "c"), (200, "daily", "b")]
    export.publish_package(spark, path, 300, "base", "d", only=True)
    assert rows(export.read_manifest(spark, path)[1]) == [(300, "base", "d")]


def test_database_ranges_hold_about_equally_many_rows(spark):
    url, driver = "jdbc:derby:memory:sparse;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    ids = [*range(1, 101), *(10**9 + i for i in range(20))]
    t = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none"), (None, "nil")], "id long, title string")
    t.write.format("jdbc").options(url=url, dbtable="sparse", driver=driver).save()
    read = lambda **o: readers.read_table(spark, url=url, table="sparse", key="id", partitions=4, driver=driver, **o)
    sizes = lambda df: sorted(df.groupBy(F.spark_partition_id()).count().toDF("p", "n").select("n").toPandas()["n"])
    found = read(balanced=True)
    assert rows(found) == rows(t) and max(sizes(found)) - min(sizes(found)) <= 2 and len(sizes(found)) == 4
    assert max(sizes(read(bounds=(1, 10**9)))) == 102
    assert len(readers.key_ranges(spark, url, "sparse", "id", 1, driver=driver)) == 1
    t.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", driver=driver).save()
    assert readers.read_table(spark, url=url, table="nothing", key="id", balanced=True, driver=driver).count() == 0


def test_feed_rejects(spark):
    good = '{"msg": {"data": [{"thread_id": 3, "title": "A"}, {"title": "none"}, {"thread_id": 4, "views": "many"}], "pagination": {"total": 2}}}'
    df = spark.createDataFrame([(1, good, "x"), (2, "{broken", "x"), (3, None, "x"), (4, '{"msg": {"data": []}}', "x"), (5, '{"msg": {}}', "x"), (6, "[]", "x"), (7, '"text"', "x"), (8, "", "x")], "n int, html string, pos_ string")
    games, rejects = readers.split_latest_feed(df)
    assert rows(games, "n", "pos", "thread_id") == [(1, 0, 3), (1, 2, 4)]
    found = rows(rejects, "n", "reason", "pos")
    assert [r for r in found if r[0] != 6] == [(1, "no thread", 1), (1, "unread fields", None), (2, "broken", None), (3, "no body", None), (5, "no list", None), (7, "broken", None), (8, "broken", None)]
    seen = {r[0] for r in found} | {r[0] for r in rows(games, "n")} | {4}
    assert seen == set(range(1, 9))  # every row is accounted for; an empty list is neither
    assert rows(games) == [r for r in rows(readers.read_latest_feed(df)) if r[3] is not None]


def test_deep_pages_read_few_rows(spark, tmp_path):
    catalog = spark.range(60_000).select(F.col("id").alias("catalog_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    listing = catalog.select("catalog_id", (F.col("catalog_id") * 2).alias("thread_id"), F.sha2("title", 512).alias("text"))
    serve.write_browse(serve.ranked_browse(catalog, listing, ["catalog_id", "title", "thread_id", "text"]), f"{tmp_path}/ranks", group_bytes=1 << 16)
    ranks = spark.read.parquet(f"{tmp_path}/ranks")
    titles = [r.title for r in catalog.orderBy("title").select("title").collect()]

    def scanned(df):
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan keeps its scan
    page = serve.stored_page(ranks, 2000)
    assert [r.title for r in page.collect()] == titles[1999 * 25 : 2000 * 25] and "GreaterThanOrEqual(rank" in plan(page)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scanned(page) <= 6000  # of 60,000
    last = page.collect()[-1]
    after = serve.page_after(ranks, last["title"], last["catalog_id"])
    assert [r.title for r in after.collect()] == titles[2000 * 25 : 2001 * 25]
    gone = serve.page_after(ranks.filter(F.col("catalog_id") != last["catalog_id"]), last["title"], last["catalog_id"])
    assert [r.title for r in gone.collect()] == titles[2000 * 25 : 2001 * 25]
    assert serve.page_after(ranks, "z", 0).count() == 0 and serve.stored_page(ranks, 2401).count() == 0


def test_a_browse_page_filters_both_scans(spark, tmp_path):
    spark.createDataFrame([(i % 7, f"T{i % 7}", "C") for i in range(7)], "catalog_id long, title string, creator string").write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([(i % 7, i) for i in range(70)], "catalog_id long, thread_id long").write.parquet(f"{tmp_path}/l")
    catalog, listing = (spark.read.parquet(f"{tmp_path}/{x}") for x in "cl")
    page = serve.browse(catalog, listing, 2, per_page=8, tie=["thread_id"])
    assert [(r.title, r.thread_id) for r in page.collect()] == [(f"T{i % 7}", i) for i in sorted(range(70), key=lambda i: (i % 7, i))][8:16]
    assert plan(page).count("PushedFilters: [In(catalog_id") + plan(page).count("In(catalog_id, [") >= 2
    assert serve.browse(catalog, listing, 100, tie=["thread_id"]).count() == 0


FEED = "thread_id long, title string, creator string, version string, views long, likes long, rating double, banner_url string, site_url string, screens string, short_name string, id_name string, n int"


def games(spark, *values):
    return spark.createDataFrame([(t, name, "B", "v1", n, None, None, banner, f"/t/{t}", None, name.upper(), f"{name.upper()}_B", n) for t, name, banner, n in values], FEED)


def test_runs_over_stored_versions(spark, tmp_path):
    store = stored.CatalogStore(spark, f"{tmp_path}/store", forum.CATALOG, forum.FORUM_LISTING, buckets=5)
    runs = [games(spark, (1, "a", "/x", 1), (2, "b", None, 2)), games(spark, (3, "a", None, 3), (4, "c", "/y", 4)), games(spark, (2, "c", None, 5))]
    catalog, listing, plans = (spark.createDataFrame([], s) for s in (forum.CATALOG, forum.FORUM_LISTING)), None, []
    catalog, listing = catalog
    for k, batch in enumerate(runs):
        def merge(c, o, mark, batch=batch, k=k):
            made = forum.latest_feed(c, o, batch, 100 * k, ["n"], mark)
            plans.append(made)
            return made

        version, rejects = store.apply(merge)
        plain = forum.latest_feed(catalog, listing, batch, 100 * k, ["n"])
        catalog, listing = plain.catalog, plain.listing
        now = store.read()
        assert version == k + 1 and rows(rejects) == rows(plain.rejects)
        assert rows(now["catalog"], "catalog_id", "id_name", "title") == rows(catalog, "catalog_id", "id_name", "title") and rows(now["listing"]) == rows(listing)
    assert rows(now["listing"], "thread_id", "catalog_id", "banner_url", "views") == [(2, 2, None, 2), (3, 1, "/x", 3), (4, 3, "/y", 4)]
    assert rows(rejects) == [("2", "keys of two rows")]
    assert len(rows(store.read(1)["listing"])) == 2
    store.forget(3)
    assert len(rows(store.read()["listing"])) == 3


def test_a_run_that_another_gets_ahead_of(spark, tmp_path):
    one, two = (stored.CatalogStore(spark, f"{tmp_path}/store", forum.CATALOG, forum.FORUM_LISTING, buckets=3) for _ in range(2))
    tries = []

    def merge(c, o, mark):
        tries.append(1)
        if len(tries) == 1:
            assert two.apply(lambda c, o, mark: forum.latest_feed(c, o, games(spark, (1, "a", "/x", 1)), 1, ["n"], mark))[0] == 1
        return forum.latest_feed(c, o, games(spark, (2, "b", None, 2)), 2, ["n"], mark)

    assert one.apply(merge)[0] == 2 and len(tries) == 2
    assert rows(one.read()["listing"], "thread_id") == [(1,), (2,)]
    assert len({r[0] for r in rows(one.read()["catalog"], "catalog_id")}) == 2


def test_a_stored_catalogue_is_not_shuffled_by_a_merge(spark, tmp_path):
    table = stored.BucketedTable(spark, f"catalog_{random.randrange(1 << 40)}", "id_name", 4)
    table.save(spark.createDataFrame([(i, f"N{i}_B") for i in range(50)], "catalog_id long, id_name string"))
    batch = spark.createDataFrame([("N3_B", "t", None, 1), ("NEW_B", "u", 77, 2)], "id_name string, title string, catalog_id long, n int")
    found = stored.upsert_joined(table.read(), batch, "id_name", ["n"])
    assert rows(found.filter("title is not null"), "catalog_id", "id_name", "title") == [(3, "N3_B", "t"), (77, "NEW_B", "u")]
    top = plan(found).split("== Initial Plan ==")[0]
    assert "Exchange" not in top[top.index("SortMergeJoin") : top.index("Bucketed: true")]
    table.drop()
