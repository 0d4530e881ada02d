"""Fetched pages, JSON feeds, layout lists and stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_jobs.functions import text as tx

CRAWL = "url string, kind string, page_no int, status int, fetched_at long, html string"
FEED = (
    "struct<msg: struct<data: array<struct<thread_id: bigint, title: string, creator: string, version: string, views: bigint, likes: bigint, "
    "rating: double, cover: string, screens: array<string>>>, pagination: struct<total: int>>>"
)
PRODUCTS = "map<string, struct<maker_id: string, down_url: string, work_name: string, work_image: string, work_type: string, regist_date: string>>"
APPS = "map<string, struct<data: struct<name: string, developers: array<string>, screenshots: array<struct<id: bigint, path_full: string>>>>>"


def read_crawl(spark: SparkSession, path: str, kind: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Fetched pages with status 200; filters reach the scan."""
    pages = spark.read.schema(CRAWL).format(fmt).load(path).filter("status = 200")
    return pages.filter(F.col("kind") == kind) if kind else pages


def _feed_games(df: DataFrame, body: str, games: Column, base_url: str) -> DataFrame:
    rest = [c for c in df.columns if c != body]
    rows = df.select(*rest, F.posexplode(games).alias("pos", "g"))
    return rows.select(
        *rest, "pos", F.col("g.thread_id"), F.col("g.title"), F.col("g.creator"), F.col("g.version"), F.col("g.views"), F.col("g.likes"), F.col("g.rating"),
        tx.rewrite_media_url(F.col("g.cover")).alias("banner_url"), tx.thread_url(base_url, F.col("g.thread_id")).alias("site_url"), tx.media_list(F.col("g.screens")).alias("screens"),
        tx.short_name(F.col("g.title")).alias("short_name"), tx.entity_key(F.col("g.title"), F.col("g.creator"), "drop_spaces").alias("id_name"),
    )


def read_latest_feed(df: DataFrame, body: str = "html", base_url: str = "") -> DataFrame:
    """A row for each game of feed JSON `body`; rows with broken JSON have no games: see split_latest_feed()."""
    return _feed_games(df, body, F.from_json(body, FEED)["msg"]["data"], base_url)


def split_latest_feed(df: DataFrame, body: str = "html", base_url: str = "") -> tuple[DataFrame, DataFrame]:
    """(games, rejects): every row of df has games, an empty list of them, or a reject with the row and its reason.

    Reasons: "no body" (null), "broken" (not JSON of the feed's shape), "no list" (JSON without a list of games), "unread fields" (some values aren't of the feed's types: those are null, and the row
    counts on both sides). Games without a thread_id are rejects too ("no thread"), one for each with its place in `pos`; of the others pos is null. Each body is parsed once.
    """
    parsed = F.from_json(body, f"{FEED.removesuffix('>')}, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = df.withColumn("__feed", parsed)
    data = F.col("__feed.msg.data")
    whole = F.col("__feed._corrupt").isNull()
    reason = F.when(F.col(body).isNull(), "no body").when(data.isNull() & (~whole | F.col("__feed").isNull()), "broken").when(data.isNull(), "no list").when(~whole, "unread fields")
    all_games = _feed_games(rows, body, data, base_url).drop("__feed")
    no_thread = F.posexplode(F.transform(data, lambda g: g["thread_id"].isNull())).alias("pos", "__none")
    nameless = rows.select(*df.columns, no_thread).filter("__none").drop("__none").withColumn("reason", F.lit("no thread"))
    rejects = rows.withColumn("reason", reason).filter("reason is not null").withColumn("pos", F.lit(None).cast("int")).drop("__feed")
    return all_games.filter("thread_id is not null"), rejects.unionByName(nameless)


def feed_page_count(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.msg.pagination.total").try_cast("int"), F.lit(0))


def read_product_json(df: DataFrame, body: str = "html") -> tuple[DataFrame, DataFrame]:
    """(products, rejects) of JSON objects keyed by product id; rejects are rows with broken or empty JSON."""
    parsed = df.withColumn("products", F.from_json(body, PRODUCTS))
    rest = [c for c in df.columns if c != body]
    good = parsed.filter(F.size("products") > 0).select(*rest, F.explode("products").alias("product_id", "p")).filter("p is not null")
    products = good.select(
        *rest, "product_id", F.col("p.maker_id"), F.col("p.down_url").alias("site_url"), F.col("p.work_name").alias("title"), F.col("p.work_image").alias("banner_url"),
        F.lit("N/A").alias("version"), F.col("p.work_type"), F.col("p.regist_date").alias("register_date"),
    )
    return products, parsed.filter("coalesce(size(products), 0) < 1").select(*df.columns)


def read_app_json(df: DataFrame, body: str = "html") -> DataFrame:
    """(app_id, name, developer, screenshots) of JSON objects keyed by app id."""
    apps = df.select(F.explode(F.from_json(body, APPS)).alias("app_id", "a")).select("app_id", "a.data.*")
    return apps.select("app_id", tx.clean_app_name(F.col("name")).alias("name"), F.get("developers", 0).alias("developer"), "screenshots")


def read_engine_layouts(spark: SparkSession, glob: str) -> DataFrame:
    """(engine, path, line) of text files, or folders of them, named Engine.<engine>.txt, one path a line."""
    lines = spark.read.text(glob).select("*", F.url_decode("_metadata.file_path").alias("path"))
    return lines.select(F.regexp_extract("path", r"/Engine\.([^/]+)\.txt(?:/[^/]*)?$", 1).alias("engine"), "path", F.col("value").alias("line"))


def key_ranges(spark: SparkSession, url: str, table: str, key: str, partitions: int, **options: str) -> list[str]:
    """Conditions that cut a database table into ranges of about equally many rows, however its keys are spread; the first one has null keys too.

    The key column alone is read, in even ranges between its least and largest value, for its quantiles.
    """
    key = f"`{key}`" if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else f'"{key}"'  # as Spark's own reader quotes it
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    ends = reader().option("query", f"SELECT MIN({key}) AS A, MAX({key}) AS B FROM {table}").load().first()
    if ends[0] is None:
        return ["1 = 1"]
    keys = reader().options(dbtable=f"(SELECT {key} AS K FROM {table}) t", partitionColumn="K", lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(partitions)).load().toDF("k")
    at = [i / partitions for i in range(1, partitions)]
    cuts = sorted({*(keys.agg(F.percentile_approx("k", F.array(*map(F.lit, at)), 100 * partitions).alias("q")).first()["q"] if at else [])} - {ends[0]})
    low = [None, *cuts]
    parts = [(a, b) for a, b in zip(low, [*cuts, None], strict=True)]
    return [" AND ".join(x for x in (a is not None and f"{key} >= {a}", b is not None and f"{key} < {b}") if x) or "1 = 1" for a, b in parts[1:]] + [f"{key} < {cuts[0]} OR {key} IS NULL" if cuts else "1 = 1"]


def read_table(spark: SparkSession, path: str | None = None, url: str | None = None, table: str | None = None, key: str = "catalog_id", bounds: tuple[int, int] | None = None, partitions: int = 8, balanced: bool = False, **options: str) -> DataFrame:
    """A stored table: Parquet at `path`, or a database table over JDBC: whole, in even ranges of its key if bounds are given, or in ranges of about equally many rows if balanced."""
    if path is not None:
        return spark.read.parquet(path)
    if balanced:
        return spark.read.jdbc(url, table, predicates=key_ranges(spark, url, table, key, partitions, **options), properties=options)
    options |= {"url": url, "dbtable": table}
    if bounds is not None:
        options |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()
