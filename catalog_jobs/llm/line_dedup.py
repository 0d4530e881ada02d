"""Line dedup: overlapping windows of three lines that also occur earlier are removed, whole lines at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written
from catalog_jobs.llm.repeats import keyed, order_of

LINES = 3


def _windows(documents: DataFrame) -> DataFrame:
    """(h1, h2, ord, tie, i) for each window of three consecutive lines with a word in one of them; 128 bits of hash."""
    at = documents.select("ord", "tie", F.split("t", "\n").alias("ls")).select("ord", "tie", "ls", F.posexplode("ls").alias("i", "line"))
    here = [F.get("ls", F.col("i") + j) for j in range(LINES)]
    said = here[0].rlike(r"[^\x20\x09-\x0D]") | here[1].rlike(r"[^\x20\x09-\x0D]") | here[2].rlike(r"[^\x20\x09-\x0D]")
    return at.filter(F.col("i") + LINES <= F.size("ls")).filter(said).select(F.xxhash64(*here).alias("h1"), F.xxhash64(F.lit(3), *here).alias("h2"), "ord", "tie", "i")


def _kept_lines(lines: Column, starts: Column) -> Column:
    """The lines that no window covers; windows are merged as a set of places."""
    covered = F.flatten(F.transform(starts, lambda s: F.array(*(s + j for j in range(LINES)))))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    return F.transform(places, lambda p: F.get(lines, p))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` cut and two more columns, n_lines and n_lines_removed; one row for each row.

    A line ends at each \\n. A window is three consecutive lines, not all blank; each line in a window that also
    starts earlier (smaller doc_id, or the same document and an earlier line) is removed. Windows are judged on the input and may overlap. Texts
    of under three lines lose nothing; a null text has no lines and stays null; texts without a removed line stay as they are; repeated rows of one doc_id
    and text are one document and get equal results. Null doc_ids come first. A very long text is one row for each of its lines on the way.
    """
    windows = _windows(keyed(docs, text))
    place = F.struct("ord", "tie", "i")
    firsts = written(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "first_windows")
    later = windows.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
    starts = written(later.groupBy("ord", "tie").agg(F.collect_set("i").alias("starts")), "starts")
    names = docs.columns
    ord_, tie = order_of(text)
    marked = docs.select("*", ord_.alias("__ord"), tie.alias("__tie"))
    # always the same join: the list of cut documents grows with the input, and a broadcast of it would hold at small sizes only
    marked = marked.join(starts.hint("merge").select(F.col("ord").alias("__ord"), F.col("tie").alias("__tie"), F.col("starts").alias("__starts")), ["__ord", "__tie"], "left")
    lines = F.split(F.col(text), "\n")
    marked = marked.withColumn("__kept", F.when(F.col("__starts").isNotNull(), _kept_lines(lines, F.col("__starts"))))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col("__kept").isNull(), 0).otherwise(n_lines - F.size("__kept"))
    cut = F.when(F.col("__kept").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))
    return marked.select(*(cut.alias(c) if c == text else F.col(c) for c in names), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_lines_removed"))
