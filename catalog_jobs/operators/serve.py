"""Serving queries: browse pages, details, lookups, statistics and JSON responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.functions.text import csv_to_array, display_title
from catalog_jobs.operators.upsert import dense_numbers

LIST_COLUMNS = ["tags", "language", "translations", "genre", "voice", "os", "preview_urls"]


def browse(catalog: DataFrame, listing: DataFrame, page: int | None = None, per_page: int = 25, columns: list[str] | None = None, title: str = "title", key: str = "catalog_id", collation: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """One page of the catalogue with its listing rows, by title, then key (or the columns of tie, which with the key identify a row); page 0 or none is the first.

    Shallow pages are a top-k of offset + page rows over the keys alone, which is run at once; its per_page keys then filter both scans. For deep pages see write_browse().
    """
    order, tie = F.collate(F.col(title), collation) if collation else F.col(title), tie or [key]
    own = [c for c in tie if c in listing.columns and c not in catalog.columns]
    keys = catalog.select(key, *dict.fromkeys([title, *(c for c in tie if c in catalog.columns)])).join(listing.select(key, *own), key)
    page_keys = [r.asDict() for r in keys.orderBy(order, *tie).offset((max(page or 1, 1) - 1) * per_page).limit(per_page).select(key, *own).collect()]  # per_page rows at most

    def there(df: DataFrame, names: list[str]) -> DataFrame:
        for c in names:  # these reach the scan
            df = df.filter(F.col(c).isin(list({r[c] for r in page_keys if r[c] is not None})) | (F.col(c).isNull() if any(r[c] is None for r in page_keys) else F.lit(False)))
        return df

    rows = there(listing, [key, *own])
    if own and page_keys:
        rows = rows.filter(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(r[c])) for c in (key, *own))) for r in page_keys)))
    joined = rows.join(there(catalog, [key]), key)
    if columns:
        joined = joined.select(*columns)
    return joined.orderBy(order, *tie).limit(per_page)


def ranked_browse(catalog: DataFrame, listing: DataFrame, columns: list[str], title: str = "title", key: str = "catalog_id", tie: list[str] | None = None) -> DataFrame:
    """The whole browse order, by title, then key (or the columns of tie), with a `rank` from 0; see write_browse()."""
    return dense_numbers(catalog.join(listing, key).select(*columns), [title, *(tie or [key])], "rank")


def write_browse(ranked: DataFrame, path: str, group_bytes: int = 1 << 20) -> None:
    """ranked_browse() rows as a table in order of rank, in small row groups: their statistics lead a page's filter to a few of them."""
    rows = ranked.repartitionByRange("rank").sortWithinPartitions("rank")
    rows.write.option("parquet.block.size", str(group_bytes)).option("parquet.page.size", str(group_bytes // 16)).parquet(path)


def stored_page(ranks: DataFrame, page: int | None = None, per_page: int = 25) -> DataFrame:
    """One page, however deep, of a write_browse() table: a range of ranks, no sort of other rows."""
    first = (max(page or 1, 1) - 1) * per_page
    return ranks.filter(F.col("rank").between(first, first + per_page - 1)).orderBy("rank")


def page_after(ranks: DataFrame, last_title: object, last_key: object, per_page: int = 25, title: str = "title", key: str = "catalog_id") -> DataFrame:
    """The page after a row, by its title and key: the row's rank is looked up by statistics of the title, which lies in the same order. If the row is gone, what comes next after its place follows."""
    found = ranks.filter((F.col(title) == last_title) & (F.col(key) == last_key)).select((F.col("rank") + 1).alias("r")).first()
    if found is None:
        after = (F.col(title) > last_title) | ((F.col(title) == last_title) & (F.col(key) > last_key))
        found = ranks.filter((F.col(title) >= last_title) & after).agg(F.min("rank").alias("r")).first()
    if found["r"] is None:
        return ranks.limit(0)
    return ranks.filter(F.col("rank").between(found["r"], found["r"] + per_page - 1)).orderBy("rank")


def page_total(catalog: DataFrame, page: int | None = None, per_page: int = 25) -> DataFrame:
    """(rows, pages, page): all catalogue rows count."""
    return catalog.agg(F.count("*").alias("rows")).select("rows", F.ceil(F.col("rows") / per_page).alias("pages"), F.lit(max(page or 1, 1)).cast("long").alias("page"))


def detail(catalog: DataFrame, catalog_id: int, key: str = "catalog_id") -> DataFrame:
    """One entity as (field, value) rows; null and 0 are blank, titles lose apostrophes."""
    row = catalog.filter(F.col(key) == catalog_id)
    shown = {}
    for c in catalog.columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        text = F.when(text.isin("0", "0.0"), "").otherwise(text)
        shown[c] = display_title(text) if c == "title" else text
    return row.select(*(v.alias(c) for c, v in shown.items())).unpivot([], list(catalog.columns), "field", "value")


def _match(id_: int | None, title: str | None, creator: str | None, key: str, titles: str, creators: str) -> Column | None:
    """What a lookup filters by: the id, else the title, else the creator."""
    for column, value in ((key, id_), (titles, title), (creators, creator)):
        if value is not None:
            return F.col(column) == value
    return None


def lookup(catalog: DataFrame, listing: DataFrame, id_: int | None = None, title: str | None = None, creator: str | None = None, key: str = "catalog_id", titles: str = "title", creators: str = "creator", first: bool = True) -> DataFrame:
    """The first match (least id) with its listing rows nested, or all matches; no argument finds nothing.

    The filter comes first, and only the matches' listing rows are joined.
    """
    match = _match(id_, title, creator, key, titles, creators)
    found = catalog.filter(match if match is not None else F.lit(False))
    if first:
        found = found.orderBy(key).limit(1)
    rows = listing.join(found.select(key), key, "left_semi")
    # one listing row for each entity (see unique_per_catalog), so the arrays are short
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in listing.columns if c != key)))).alias("listings"))
    return found.join(nested, key, "left").withColumn("listings", F.coalesce("listings", F.array()))


def lookup_all(catalog: DataFrame, listing: DataFrame, columns: list[str], lists: list[str] = LIST_COLUMNS, **match: object) -> DataFrame:
    """All matches joined with their listing rows, comma lists as arrays."""
    key = match.pop("key", "catalog_id")
    where = _match(match.get("id_"), match.get("title"), match.get("creator"), match.get("by_id", key), match.get("titles", "title"), match.get("creators", "creator"))
    joined = catalog.join(listing, key)
    joined = joined.filter(where if where is not None else F.lit(False))
    return joined.select(*(csv_to_array(F.col(c)).alias(c) if c in lists else F.col(c) for c in columns))


def catalog_stats(catalog: DataFrame, title: str = "title", stamp: str = "last_record_update") -> DataFrame:
    return catalog.agg(F.count(title).alias("titles"), F.max(stamp).alias("last_update"))


def _numeric_text(text: Column) -> Column:
    """JSON of a text: a number if it reads as one, else the text in quotes; null for null."""
    trimmed = F.trim(text)
    quoted = F.to_json(F.array(text))
    return (
        F.when(trimmed.rlike(r"^[+-]?[0-9]{1,18}$"), trimmed.try_cast("bigint").cast("string"))
        .when(trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?$"), trimmed.try_cast("double").cast("string"))
        .otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    )


def response_json(found: DataFrame, stats: DataFrame, numeric: list[str] = ()) -> DataFrame:
    """One JSON text: games, status and totals. Texts of the columns in `numeric` that read as numbers become numbers, others stay texts.

    `found` is the bounded result of a lookup.
    """
    fields = [F.parse_json(_numeric_text(F.col(c).cast("string"))).alias(c) if c in numeric else F.col(c) for c in found.columns]
    games = found.agg(F.collect_list(F.struct(*fields)).alias("games"))
    both = games.crossJoin(stats)  # one row each
    body = F.struct("games", F.when(F.size("games") > 0, "ok").otherwise("not found").alias("status"), *stats.columns)
    return both.select(F.to_json(body).alias("body"))


def list_packages(manifest: DataFrame) -> DataFrame:
    """Manifest rows, newest first, with their JSON."""
    return manifest.withColumn("body", F.to_json(F.struct(*manifest.columns))).orderBy(F.desc("date"))
