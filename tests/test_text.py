import pytest
from pyspark.sql import functions as F

from catalog_jobs.functions import text as tx


def one(spark, column, *values, types="string"):
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(types.split(",")))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


C = lambda i=0: F.col(f"c{i}")


@pytest.mark.parametrize(
    ("text", "title", "version", "creator", "short", "key"),
    [
        ("Night Harbor [v0.4] [Blue Fox]", "Night Harbor ", "v0.4", "Blue Fox", "NIGHTHARBOR", "NIGHTHARBOR_BLUE FOX"),
        ("Night Harbor [Final]", "Night Harbor ", "Final", None, "NIGHTHARBOR", "NIGHTHARBOR_"),
        ("Night Harbor [v0.1]", "Night Harbor ", None, "v0.1", "NIGHTHARBOR", "NIGHTHARBOR_V0.1"),
        ("Night Harbor [Ch. 2]", "Night Harbor ", None, "Ch. 2", "NIGHTHARBOR", "NIGHTHARBOR_CH. 2"),
        ("Night Harbor", "Night Harbor", None, None, "NIGHTHARBOR", "NIGHTHARBOR_"),
        ("A [b] [c] [d]", "A ", None, None, "A", "A_"),
        ("½ a²b", "½ a²b", None, None, "½A²B", "½A²B_"),
    ],
)
def test_titles(spark, text, title, version, creator, short, key):
    t = tx.split_title(C())
    got = one(spark, F.struct(t.alias("t"), tx.short_name(t["title"]).alias("s"), tx.entity_key(t["title"], t["creator"]).alias("k")), text)
    assert (got.t.title, got.t.version, got.t.creator, got.s, got.k) == (title, version, creator, short, key)


def test_title_options(spark):
    assert one(spark, tx.split_title(C(), "prefix"), "Night Harbor [v0.1]").version == "v0.1"
    assert one(spark, tx.split_title(C(), "prefix"), "Night Harbor [Ch. 2]").version == "Ch. 2"
    assert one(spark, tx.entity_key(F.lit("Night Harbor"), C(), "drop_spaces"), "Blue Fox") == "NIGHTHARBOR_BLUEFOX"


def labels(spark, texts, **kw):
    anchors = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(f"/t/{i}").alias("href")) for i, t in enumerate(texts)))
    return spark.range(1).select(tx.parse_thread_labels(anchors, **kw).alias("x")).first()["x"]


def test_labels(spark):
    got = labels(spark, ["VN", "Unity", "Completed", "Night Harbor [v1] [Blue Fox]"])
    assert (got.category, got.engine, got.status, got.title, got.version, got.creator, got.href) == ("VN", "Unity", "Completed", "Night Harbor ", "v1", "Blue Fox", "/t/3")
    assert (labels(spark, ["[Unity]"]).title, labels(spark, ["[Unity]"]).creator) == ("", "Unity")
    assert labels(spark, ["[Unity]", "A"], label_brackets=True).engine == "Unity"


@pytest.mark.parametrize(("text", "n"), [("12,345", 12345), ("12K", 12000), ("12k", 12000), ("1.5M", 1500000), ("0", 0), (None, None), ("none", None), ("", None)])
def test_counts(spark, text, n):
    assert one(spark, tx.compact_count(C()), text) == n


@pytest.mark.parametrize(
    ("text", "n"),
    [("2023-1-5", 1672876800), ("2023-01-05 3:4:5", 1672887845), *((t, 0) for t in ("2022", "2023-02-30", " 2023-01-05", "2023-01-05 ", "2023-01-05T1:2:3", None, ""))],
)
def test_epoch(spark, text, n):
    assert one(spark, tx.to_epoch(C()), text) == n


def test_small_functions(spark):
    assert one(spark, tx.thread_id_from_url(C()), "https://host/threads/some-name.154250/") == "154250"
    assert one(spark, tx.iso_to_text(C()), "2023-01-05T12:00:00+0000") == "2023-01-05 12:00:00"
    assert one(spark, tx.iso_to_text(C()), None) == ""
    assert [one(spark, tx.rating_text(C()), t) for t in ("4.50 star(s)", "0.00 star(s)", None)] == [4.5, 0.0, None]
    assert [one(spark, tx.csv_to_array(C()), t) for t in ("a,b", "", None)] == [["a", "b"], [""], [""]]
    assert [one(spark, tx.page_count(C()), t) for t in ("1 of 723", "x", None)] == [723, 0, 0]
    assert one(spark, tx.clean_app_name(C()), "A: B") == "AB"
    assert one(spark, tx.overview(C(), C(1)), "Overview:\n", "Overview: long\n\n\nrest", types="string,string") == "long"
    nested = F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.lit(1), F.lit("priceless"), F.lit(2)))
    assert spark.range(1).select(tx.drop_nested_key(nested, "priceless").alias("x")).first()["x"] == {"a": {"x": 1}}
    assert one(spark, tx.null_if_blank(C()), "0") == "0"
    assert one(spark, tx.null_if_blank(C(), epoch=True), 0, types="long") is None
