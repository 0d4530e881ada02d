import gc
import json
import random

import pytest
from pyspark.sql import functions as F

from catalog_jobs.operators import changes, contracts, export, layout, serve, upsert
from catalog_jobs.plans import forum, queries
from catalog_jobs.sources import frontier, html, readers
from catalog_jobs.streaming.ingest import VersionedTable, ingest_stream, run_id


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_upserts(spark):
    target = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    batch = upsert.drop_blank(spark.createDataFrame([(1, "", "z", 0), (1, "w", None, 1), (2, "n", None, 2), (None, "q", "q", 3)], "k int, a string, b string, seq int"))
    merged, replaced = upsert.upsert_merge(target, batch, "k", ["seq"]), upsert.upsert_replace(target, batch, "k", ["seq"])
    assert rows(merged) == [(1, "w", "z"), (2, "n", None)]
    assert rows(replaced) == [(1, "w", None), (2, "n", None)]
    assert rows(upsert.upsert_merge(merged, batch, "k", ["seq"])) == rows(merged)
    assert rows(upsert.upsert_replace(replaced, batch, "k", ["seq"])) == rows(replaced)
    one_by_one = target
    for i in range(3):
        one_by_one = upsert.upsert_merge(one_by_one, batch.filter(F.col("seq") == i), "k", ["seq"])
    assert rows(one_by_one) == rows(merged)


def test_ids_are_dense_and_stable(spark):
    catalog = spark.createDataFrame([(f"K{i}", i + 1) for i in range(10)], "id_name string, catalog_id long")
    keys = [f"K{i}" for i in range(500)] + ["K7", None]
    random.Random(0).shuffle(keys)
    new = spark.createDataFrame([(k,) for k in keys], "id_name string").repartition(7)
    got = rows(upsert.assign_catalog_ids(catalog, new))
    assert [r[0] for r in got] == sorted(f"K{i}" for i in range(10, 500))
    assert [r[1] for r in got] == list(range(11, 501))
    assert upsert.assign_catalog_ids(catalog, catalog.select("id_name")).count() == 0
    plan = upsert.assign_catalog_ids(catalog, new)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_change_test_and_prefix(spark):
    listing = spark.createDataFrame(
        [(1, 0, 1, "VN", 5), (1, 1, 2, "README", 5), (1, 2, 3, "VN", 9), (1, 3, 4, "VN", 7), (1, 4, 5, "VN", 5), (2, 0, 6, "VN", 8)],
        "page_no int, pos int, thread_id long, category string, last_thread_comment long",
    )
    stored = spark.createDataFrame([(3, 7), (4, 7), (6, 1)], "thread_id long, last_thread_comment long")
    marked = changes.mark_changed(listing, stored)
    assert rows(changes.page_prefix_until_stale(marked), "thread_id") == [(1,), (3,), (6,)]
    assert rows(changes.changed_threads(listing, stored), "thread_id") == [(1,), (2,), (3,), (5,), (6,)]


def test_delta_and_diff(spark):
    t = spark.createDataFrame([(1, 5), (2, 10), (3, None), (4, 11)], "catalog_id long, last_record_update long")
    assert rows(export.delta(t, 10), "catalog_id") == [(4,)]
    assert rows(export.delta(t, 0), "catalog_id") == [(1,), (2,), (4,)]
    later = spark.createDataFrame([(1, 5), (2, 12), (5, None)], "catalog_id long, last_record_update long")
    assert rows(export.snapshot_diff(t, later)) == sorted([(2, "changed", "last_record_update", "10", "12"), (3, "removed", None, None, None), (4, "removed", None, None, None), (5, "added", None, None, None)], key=repr)


def test_packages(spark, tmp_path):
    t = spark.createDataFrame([(i, f"t{i}", i * 10) for i in range(20)], "catalog_id long, title string, last_record_update long")
    empty = spark.createDataFrame([], export.MANIFEST)
    assert export.package_kind(empty) == ["base", "backup"]
    manifest = export.rebuild_master({"catalog": t}, f"{tmp_path}/p0", 100, "base", {"catalog": "catalog_id"})
    assert export.package_kind(manifest) == ["backup", "daily"]
    assert spark.read.json(f"{tmp_path}/p0/catalog").count() == 19  # a stamp of 0 isn't after 0
    assert spark.read.json(f"{tmp_path}/p0/header").first()["min_ver"] == "0.0.0"
    export.write_package({"catalog": t}, f"{tmp_path}/p1", 150, {"catalog": "catalog_id"})
    sums = [export.package_checksum(spark, f"{tmp_path}/p{i}").first()["md5"] for i in (0, 1)]
    assert len({*sums}) == 2 and rows(manifest)[0][2] == sums[0]
    both = export.register_package(export.register_package(manifest, 200, "daily", "a"), 200, "daily", "b")
    assert [r.md5 for r in serve.list_packages(both).collect()] == ["b", sums[0]]
    path = export.write_backup({"catalog": t.withColumn("day", F.lit("2024-01-05").cast("date"))}, str(tmp_path), "2024-01-05")
    assert path.endswith("/20240105") and spark.read.json(f"{path}/catalog").filter("day = '2024-01-05'").count() == 20


def test_serving(spark):
    catalog = spark.createDataFrame([(i, f"T{i:02d}", "C") for i in range(51)], "catalog_id long, title string, creator string")
    listing = spark.createDataFrame([(i, i * 2) for i in range(51)], "catalog_id long, thread_id long")
    assert [r.title for p in (1, 2, 3) for r in serve.browse(catalog, listing, p).collect()] == [f"T{i:02d}" for i in range(51)]
    assert rows(serve.page_total(catalog, 0)) == [(51, 3, 1)]
    assert [r["rank"] for r in serve.ranked_browse(catalog, listing, ["title", "catalog_id"]).orderBy("title").collect()] == list(range(51))
    assert serve.lookup(catalog, listing).count() == 0
    assert serve.lookup(catalog, listing, creator="C").first()["catalog_id"] == 0
    assert serve.lookup(catalog, listing, id_=5, creator="X").first()["listings"][0]["thread_id"] == 10
    stats = serve.catalog_stats(catalog.withColumn("last_record_update", F.lit(3)))
    body = json.loads(serve.response_json(serve.lookup(catalog, listing, id_=5).select("catalog_id", "title"), stats).first()["body"])
    assert body == {"games": [{"catalog_id": 5, "title": "T05"}], "status": "ok", "titles": 51, "last_update": 3}
    assert rows(serve.detail(catalog, 0)) == [("catalog_id", ""), ("creator", "C"), ("title", "T00")]


def test_contracts(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "bb", 9), (2, None, None)], "k int, v string, r int")
    got = rows(contracts.check_contract(t, "t", unique=[["k"]], required=["v"], references=[("r", t, "k")], max_bytes={"v": 1}))
    assert got == sorted([("t", "max_bytes", "v", "2", 1), ("t", "not_null", "v", None, 1), ("t", "reference", "r", "9", 1), ("t", "unique", "k", "1", 2)], key=repr)


def test_unique_per_catalog(spark):
    listing = spark.createDataFrame([(1, 7, 1), (2, 7, 3), (3, 0, 1), (4, 8, 1)], "thread_id long, catalog_id long, stamp int")
    one, rejects = upsert.unique_per_catalog(listing, "thread_id", ["stamp"])
    assert (rows(one, "thread_id"), rows(rejects, "thread_id")) == ([(2,), (4,)], [(1,), (3,)])


def test_frontier(spark):
    assert [r.url for r in frontier.frontier_pages(spark, 1, 2, "/l/", "o=1").collect()] == ["/l/?o=1", "/l/page-2?o=1"]
    assert [r.product_id for r in frontier.frontier_products(spark, "RJ", 1704, 1705, "/").union(frontier.frontier_products(spark, "", 20000, 20001, "/")).union(frontier.frontier_products(spark, "", 1234567, 1234568, "/")).collect()] == ["RJ001704", "020000", "1234567"]
    assert frontier.frontier_makers(spark, ["a", "b"], ["x", "y", "z"], "/", "/by/").count() == 6


def test_layouts(spark, tmp_path):
    (tmp_path / "Engine.One.txt").write_text("/Data/C4.pak\nLib/renpy\nrun.exe\nrun.exe/below\n\n")
    lines = readers.read_engine_layouts(spark, f"{tmp_path}/Engine.*.txt")
    made = layout.normalise_layout(lines)
    assert ("One", "Data\\C4.pak", "file", "Data", "C4.pak", False) in rows(made)
    assert ("One", "Lib\\renpy", "folder", "Lib", "renpy", False) in rows(made)
    assert [r for r in rows(made) if r[-1]] == [("One", "run.exe\\below", "file", "run.exe", "below", True)]
    games = spark.createDataFrame([("One", "g"), ("Unknown", "h")], "engine string, folder string")
    assert ("g", "g\\Data", "folder", False) in rows(layout.plan_layout(games, made))
    assert layout.plan_layout(games, made).filter("folder = 'h'").count() == 0


@pytest.mark.parametrize(
    ("page", "labels", "value"),
    [
        ("<b>Release Date</b>: 2023-1-5", ["Release Date", "Year:"], "2023-1-5"),
        ("<b>Censorship:</b> No", ["Censored", "Censorship:"], "No"),
        ("<b>OS</b>:<br><b>Platforms:</b> Windows", ["OS", "Platforms:"], ""),
        ("<b>OS</b><i>x</i><b>Platforms:</b> Windows", ["OS", "Platforms:"], "Windows"),
        ("<p><b>a<br><p>OS</b> x", ["OS"], None),
        (None, ["OS"], None),
    ],
)
def test_labelled_field(spark, page, labels, value):
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(html.labelled_field(F.col("html"), labels).alias("v")).first()["v"] == value


ITEM = """<div class="structItem a"><div class="structItem-title"><a href="/l/">VN</a><a href="/threads/{0}.{1}/">{0} [v1] [Fox]</a></div>
<ul><li class="structItem-startDate"><a><time datetime="2023-01-05T12:00:00+0000">x</time></a></li></ul><time class="structItem-latestDate" datetime="{2}T00:00:00+0000"></time>
<div class="structItem-cell--meta"><dl><dd>12</dd></dl><dl><dd>1.5K</dd></dl></div><span class="ratingStars">4.50 star(s)</span></div>"""
POST = """<div class="message-userExtras"><dl><dd>1</dd></dl><dl><dd>2</dd></dl><dl><dd>1,234</dd></dl></div><span class="js-tagList"><a> x </a><a>y</a></span>
<div class="bbWrapper"><div>Overview: A tale.</div><img class="bbImage" src="/thumb/i.jpg"><b>Release Date</b>: 2023-1-5<br><b>OS</b>: Win<br><a href="/attachments/1">s</a></div>"""


def test_forum_crawl(spark):
    catalog, listing = spark.createDataFrame([], forum.CATALOG), spark.createDataFrame([], forum.FORUM_LISTING)
    pages = spark.createDataFrame([(1, ITEM.format("alpha", 11, "2024-01-01") + ITEM.format("beta", 12, "2024-01-02") + '<div class="structItem">bad</div>')], "page_no int, html string")
    details = spark.createDataFrame([("/threads/alpha.11/", POST), ("/threads/gone.13/", POST)], "url string, html string")
    first = forum.forum_crawl(catalog, listing, pages, details, now=1000)
    got = {r.title: r for r in first.catalog.collect()}
    assert set(got) == {"alpha ", "beta "} and got["alpha "].overview == "A tale." and got["alpha "].os == "Win" and got["alpha "].release_date == 1672876800
    line = {r.thread_id: r for r in first.listing.collect()}
    assert (line[11].likes, line[11].views, line[11].rating, line[11].tags, line[11].screens, line[11].banner_url) == (1234, 1500, 4.5, "x,y", "/attachments/1", "/i.jpg")
    assert line[11].catalog_id == got["alpha "].catalog_id and line[12].likes is None
    assert first.rejects.count() == 1
    for df in (first.catalog, first.listing, first.rejects):  # pages are parsed into tables, once, and not by the branches that read those
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    again = forum.forum_crawl(first.catalog, first.listing, pages, details, now=2000)
    assert rows(again.catalog) == rows(first.catalog)  # nothing has changed
    newer = spark.createDataFrame([(1, ITEM.format("alpha", 11, "2024-02-01"))], "page_no int, html string")
    third = forum.forum_crawl(first.catalog, first.listing, newer, details.limit(0), now=3000)
    alpha = third.catalog.filter("title = 'alpha '").first()
    assert (alpha.overview, alpha.last_record_update, alpha.catalog_id) == ("A tale.", 3000, got["alpha "].catalog_id)
    assert export.delta(third.catalog, 2000).count() == 1


def test_store_feed(spark):
    body = '{"RJ000001": {"maker_id": "RG1", "down_url": "/d", "work_name": "A b", "work_image": "i", "work_type": "T", "regist_date": "2024"}}'
    df = spark.createDataFrame([(1, body), (2, "{broken"), (3, None)], "n int, html string")
    products, rejects = readers.read_product_json(df)
    assert rows(rejects, "n") == [(2,), (3,)]
    makers = spark.createDataFrame([("RG2", "Other")], "maker_id string, name string")
    got = forum.store_feed(spark.createDataFrame([], forum.CATALOG), spark.createDataFrame([], forum.STORE_LISTING), products, makers, 5, ["n"])
    assert rows(got.catalog, "id_name", "creator", "catalog_id") == [("AB_RG1", "RG1", 1)]
    assert rows(got.listing, "product_id", "catalog_id") == [("RJ000001", 1)]


def test_maker_rows(spark):
    page = '<div id="maker_list_body"><table><tbody><tr><td>RG1</td><td>Name</td><td><a href="/u"><img src="/i"></a></td></tr><tr><td>short</td></tr></tbody></table></div>'
    assert rows(html.maker_rows(spark.createDataFrame([(page,), (page,), (None,)], "html string"))) == [("RG1", "Name", "/u", "/i")]


def test_stream(spark, tmp_path):
    schema, crawl = "thread_id long, last_thread_comment long, title string", "thread_id long, last_thread_comment long, title string, fetched_at long"
    table = VersionedTable(spark, f"{tmp_path}/t", schema, width=10)

    def put(*values):
        spark.createDataFrame(list(values), crawl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(checkpoint="cp"):
        ingest_stream(spark, f"{tmp_path}/in", crawl, table, f"{tmp_path}/{checkpoint}").awaitTermination(120)
        return sorted(rows(table.read()))

    assert (table.latest(), rows(table.read())) == (-1, [])
    put((1, 5, "a", 1), (1, 6, "b", 2), (2, 1, "c", 1), (15, 1, "e", 1), (None, 1, "x", 1))
    assert run() == [(1, 6, "b"), (2, 1, "c"), (15, 1, "e")]
    put((1, 4, "late", 3), (2, 2, "d", 3))
    assert run() == [(1, 6, "b"), (2, 2, "d"), (15, 1, "e")]
    assert rows(table.log(), "version", "part") == [(0, 0), (0, 1), (1, 0)]  # the range without a row of the batch isn't written again
    assert sorted(rows(table.read(0))) == [(1, 6, "b"), (2, 1, "c"), (15, 1, "e")]
    assert run() == [(1, 6, "b"), (2, 2, "d"), (15, 1, "e")]  # each file counts once
    put((30, 9, "new", 4))
    assert run("fresh") == [(1, 6, "b"), (2, 2, "d"), (15, 1, "e"), (30, 9, "new")]  # a fresh checkpoint reads all files again and goes on from the table
    cp, fresh = (run_id(spark, f"{tmp_path}/{c}") for c in ("cp", "fresh"))
    assert table.latest() == 2 and table.has(cp, 0) and table.has(fresh, 0) and not table.has(fresh, 1)


def test_crawl_pages_are_filtered_in_the_scan(spark, tmp_path):
    values = [("/a", "listing", 1, 200, 5, "x"), ("/b", "listing", 2, 404, 5, None), ("/c", "detail", None, 200, 5, "y")]
    spark.createDataFrame(values, readers.CRAWL).write.parquet(f"{tmp_path}/crawl")
    assert rows(readers.read_crawl(spark, f"{tmp_path}/crawl"), "url") == [("/a",), ("/c",)]
    found = readers.read_crawl(spark, f"{tmp_path}/crawl", "listing")
    assert rows(found, "url") == [("/a",)]
    assert "EqualTo(status,200)" in found._jdf.queryExecution().executedPlan().toString()


def test_tables_of_a_database_are_read_in_ranges(spark):
    url, t = "jdbc:derby:memory:games;create=true", spark.createDataFrame([(i, f"t{i}") for i in range(50)], "catalog_id long, title string")
    t.write.format("jdbc").options(url=url, dbtable="catalog", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    whole = readers.read_table(spark, url=url, table="catalog", driver="org.apache.derby.jdbc.EmbeddedDriver")
    ranges = readers.read_table(spark, url=url, table="catalog", bounds=(0, 50), partitions=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert rows(whole) == rows(ranges) == rows(t)
    assert (whole.rdd.getNumPartitions(), ranges.rdd.getNumPartitions()) == (1, 4)


def test_latest_feed(spark):
    body = '{"msg": {"data": [{"thread_id": 3, "title": "A b", "creator": "Blue Fox", "version": "v2", "views": 7, "cover": "/preview/x"}, {"thread_id": 4, "title": "a B", "creator": "bluefox", "version": "", "views": 9}]}}'
    games = readers.read_latest_feed(spark.createDataFrame([(1, body), (2, "{broken"), (3, None)], "n int, html string"), base_url="/threads/")
    got = forum.latest_feed(spark.createDataFrame([], forum.CATALOG), spark.createDataFrame([], forum.FORUM_LISTING), games, 50, ["n", "pos"])
    assert rows(got.catalog, "catalog_id", "id_name", "title", "version", "creator") == [(1, "AB_BLUEFOX", "a B", "v2", "bluefox")]  # a blank version overwrites nothing
    assert rows(got.listing, "thread_id", "catalog_id", "views", "site_url") == [(4, 1, 9, "/threads/4")]
    assert rows(got.rejects) == [("3", "entity has another row")]


def test_numeric_texts_of_responses(spark):
    found = spark.createDataFrame([(1, "4.50"), (2, "12"), (3, 'a "b"'), (4, ""), (5, None), (6, "1e3"), (7, " -7 "), (8, "0x1A")], "catalog_id int, rating string")
    body = json.loads(serve.response_json(found.orderBy("catalog_id").coalesce(1), spark.sql("SELECT 1 AS titles"), ["rating"]).first()["body"])
    assert [g.get("rating") for g in body["games"]] == [4.5, 12, 'a "b"', "", None, 1000.0, -7, "0x1A"]


def test_feed_pages_are_bounded(spark, tmp_path, monkeypatch):
    from catalog_jobs.plans import queries

    rows = [(i, None if i % 3 == 0 else 5, "click", '{"k": 1}') for i in range(2500)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").withColumn("ts", F.lit("2024-01-05").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    read, most = readers.read_latest_feed, []

    def watched(feed, **options):
        most.append(feed.agg(F.max(F.length("html"))).first()[0])
        return read(feed, **options)

    monkeypatch.setattr(readers, "read_latest_feed", watched)
    got = queries.feed_explode(spark, str(tmp_path)).select("source_id", "total", "thread_id").collect()
    assert sorted((r.thread_id, r.source_id, r.total) for r in got) == [(i, u, 834 if u is None else 1666) for i, u, *_ in rows]
    assert most[0] < 1000 * 260


def test_makers_of_all_headers(spark):
    urls = [r.url for r in frontier.frontier_makers(spark, ["a", "b"], None, "/", "/by/").collect()]
    assert len(set(urls)) == 2 * 72
    assert {"/a/by/Z", "/b/by/ん"} <= set(urls)


@pytest.mark.parametrize(("closed", "title", "href"), [(True, "a & b&amp", "/?x=1&copy=2&y"), (False, "a & b&", None)])
def test_references_without_a_semicolon(spark, closed, title, href):
    page = '<h1>a &amp; b&amp</h1><a href="/?x=1&copy=2&amp;y">t</a>'
    found = spark.createDataFrame([(page,)], "html string").select(html.page_links(F.col("html"), closed).alias("p")).select("p.title", "p.links").first()
    assert found["title"] == title and (href is None or found["links"][0]["href"] == href)


def test_page_labels_keep_a_cut_reference(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<h1>x &amp; y&amp</h1><b>x</b>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(queries.QUERIES["page_labels"](spark, str(tmp_path)).select("title", "n_bold")) == [("x & y&amp", 1)]


def test_a_parsed_page_leaves_nothing_to_collect():
    gc.collect()
    gc.disable()
    try:
        for page in (ITEM.format("a", 1, "2024-01-01"), POST, "<!DOCTYPE html><h1>x</h1><a href='/u'>t</a>"):
            html._listing_items(page), html._details(page), html._makers(page), html._links(page)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_plain_pages_are_read_as_the_parser_reads_them():
    def shape(page):
        return [(n.tag, n.attrs, n.up, n.end, [c if isinstance(c, str) else c.at for c in n.children]) for n in page.nodes]

    bits = ["<div>", "</div>", '<a href="/x" class="a b">', "</a>", "<b>", "</b>", "t &amp; u", "&lt", "<br>", "<p>", "</p>", "<td>", "<i><i>", "</u>", '<a href="1" href="2">', "\r\n", "é"]
    dice, read = random.Random(3), 0
    for odd in (["<!-- c -->", "<script>", "</script>", "< x", "<BR/>", "<a href='q'>", "<title>", '<a  href="?a=1&b=2">', "<"], []):
        for _ in range(300):
            page = "".join(dice.choices(bits + odd, k=dice.randrange(12)))
            slow = html._Builder()
            slow.feed(page)
            slow.close()
            fast = html._plain(page)
            read += fast is not None
            assert shape(html.parse(page)) == shape(slow.page.finish())
    assert read > 300


def test_pages_of_one_split_are_parsed_by_all_cores(spark, tmp_path):
    spark.range(1000).selectExpr("id as c_custkey", "'n' as c_name", "'B' as c_mktsegment", "1 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = queries.QUERIES["page_fields"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() > 4 and plan.count("ArrowEvalPython") == 1  # one parse a page
    assert df.filter("os is null").count() == 143


def test_only_asked_fields_are_extracted():
    assert html._links("<b>a<b>b", fields=["links"]) == {"links": []} and html._links("<b>a<b>b")["bold"] == ["ab", "b"]


def test_listing_pages_are_made_after_their_rows_are_dealt(spark, tmp_path):
    spark.range(1000).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2024-01-05 00:00:00' as o_orderdate", "'1-URGENT' as o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    pages = queries._listing_pages(spark, str(tmp_path))
    below = pages._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(page_no")[2]
    assert below and "structItem" not in below and "Exchange " not in below  # the one exchange carries no page texts
    assert pages.rdd.getNumPartitions() > 4 and pages.count() == 50
