"""Folder layouts of engines and image assets, planned as tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Layout lists are broadcast up to this number of lines.
BROADCAST_LINES = 100_000


def normalise_layout(layouts: DataFrame, line: str = "line") -> DataFrame:
    r"""layouts(engine, line) -> engine, item, kind, parent, base_name, conflict.

    One leading / goes, other separators become \; blank lines go. An item with a dot is a file, else a folder. A path below
    an item that is itself a file has conflict = true.
    """
    item = F.replace(F.regexp_replace(F.regexp_replace(line, r"[\r\n]+$", ""), "^/", ""), F.lit("/"), F.lit("\\"))
    rows = layouts.select("engine", item.alias("item")).filter("trim(item) <> ''")
    depth = F.size(F.split("item", r"\\"))
    rows = rows.select(
        "engine", "item", F.when(F.contains("item", F.lit(".")), "file").otherwise("folder").alias("kind"),
        F.when(depth > 1, F.expr(r"substring(item, 1, length(item) - length(substring_index(item, '\\', -1)) - 1)")).otherwise("").alias("parent"),
        F.substring_index("item", "\\", -1).alias("base_name"),
    )
    files = F.collect_set(F.when(F.col("kind") == "file", F.col("item"))).over(Window.partitionBy("engine"))  # an engine's list has a few dozen lines
    above = F.exists("__files", lambda f: F.startswith(F.col("item"), F.concat(f, F.lit("\\"))))
    return rows.withColumn("__files", files).withColumn("conflict", above).drop("__files")


def ancestors(path: Column) -> Column:
    r"""All folders above a path: a\\b\\c -> [a, a\\b]."""
    parts = F.split(path, r"\\")
    return F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))


def plan_layout(games: DataFrame, layouts: DataFrame) -> DataFrame:
    """games(engine, folder) x normalise_layout() rows of their engine -> folder, path, kind, conflict: files, folders and all folders above them, each once.

    The layouts are few and broadcast, so games stay where they are; a game's own rows are made distinct before the join.
    """
    up = layouts.select("engine", F.explode(ancestors(F.col("item"))).alias("item")).withColumns({"kind": F.lit("folder"), "conflict": F.lit(False)})
    rows = layouts.select("engine", "item", "kind", "conflict").unionByName(up.select("engine", "item", "kind", "conflict"))
    rows = rows.groupBy("engine", "item").agg(F.max("kind").alias("kind"), F.max("conflict").alias("conflict"))
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_LINES else rows
    return games.select("engine", "folder").join(rows, "engine").select("folder", F.concat_ws("\\", "folder", "item").alias("path"), "kind", "conflict")


def asset_path(root: Column, developer: Column, name: Column, app_id: Column) -> Column:
    return F.concat_ws("/", root, developer, name, app_id)


def plan_assets(apps: DataFrame, root: str, base_url: str) -> DataFrame:
    """apps of read_app_json() -> app_id, url, path: a row for each screenshot and four templated images."""
    folder = asset_path(F.lit(root), F.col("developer"), F.col("name"), F.col("app_id").cast("string"))
    shots = apps.select("app_id", folder.alias("folder"), F.explode("screenshots").alias("s")).select(
        "app_id", F.col("s.path_full").alias("url"), F.concat(F.col("folder"), F.lit("/previews/"), F.col("s.id").cast("string"), F.lit(".jpg")).alias("path")
    )
    images = F.array(*(F.struct(F.lit(a).alias("remote"), F.lit(b).alias("local")) for a, b in (("header.jpg", "banner.jpg"), ("library_600x900.jpg", "cover.jpg"), ("library_hero.jpg", "banner_w.jpg"), ("logo.png", "logo.jpg"))))
    fixed = apps.select("app_id", folder.alias("folder"), F.explode(images).alias("i")).select(
        "app_id", F.concat(F.lit(base_url), F.col("app_id").cast("string"), F.lit("/"), F.col("i.remote")).alias("url"), F.concat_ws("/", "folder", "i.local").alias("path")
    )
    return shots.unionByName(fixed)
