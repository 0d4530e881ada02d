"""Benchmark decontamination: a prefix-filtered join of item windows with whole documents.

DataFrame operations only. A window is contained in a document only if all its shingles are, so the prefix that must be
joined is its rarest shingle alone; the place of that shingle bounds where the window can start, and the window's words are
then compared with the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm.common import NON_WORD, lower_ascii, split_words, written

#: Words in a window, and in a shingle (windows of fewer words have one shingle, all of their words).
WINDOW, SHINGLE = 13, 4
#: Index rows up to this number are broadcast (about 300 bytes each); more are joined by a shuffle on the shingle, with
#: the documents' keys alone; their words follow by key.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, A-Z in lower case."""
    return split_words(lower_ascii(text), NON_WORD)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window of `window` consecutive words, with the ids of its items as sorted strings.

    An item of fewer words is one window; items without words have none. Items with equal texts are brought together first.
    """
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    texts = texts.groupBy("w").agg(F.collect_set("item").alias("same"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = texts.select("same", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("items"))


def _shingle(words: Column | str, at: Column | int, n: int) -> Column:
    return F.xxhash64(*(F.get(words, F.lit(at) + j if isinstance(at, int) else at + j) for j in range(n)))


def _document_shingles(docs: DataFrame, lengths: list[int], end: bool = False) -> DataFrame:
    """A row for each place and each shingle length that fits there: all columns of docs with pos and token.

    With `end`, one more row for each document, at the place behind its last word, with token 0 and length 0.
    """
    at = docs.select("*", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    here = [F.when(F.col("pos") + n <= F.size("w"), _shingle("w", F.col("pos"), n)) for n in lengths]
    if end:
        here[0] = F.when(F.col("pos") == F.size("w"), F.lit(0).cast("long")).otherwise(here[0])
    if len(here) == 1:
        return at.drop("word").withColumn("token", here[0])
    return at.drop("word").withColumn("token", F.explode(F.array(*here)))


def window_index(windows: DataFrame, documents: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """(token, offset, words, items): each window under its rarest shingle, and the shingle lengths in use.

    A shingle's rarity is its number of places in all documents (documents: w). Ties go to the first place in the window.
    """
    w = windows.withColumn("n", F.least(F.size("words"), F.lit(shingle)))
    lengths = sorted(r["n"] for r in w.select("n").distinct().collect())  # 1 to `shingle`, so a few
    if not lengths:
        return w.select(F.lit(0).cast("long").alias("token"), F.lit(0).alias("offset"), "words", "items"), [shingle]
    offsets = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("offset")
    token = F.coalesce(*(F.when(F.col("n") == n, _shingle("words", F.col("offset"), n)) for n in lengths))
    tokens = w.select("*", offsets).withColumn("token", token)
    vocabulary = tokens.select("token").distinct()
    small = vocabulary.count() <= BROADCAST_ROWS * 10
    places = _document_shingles(documents.select("w"), lengths).select("token")
    places = places.join(F.broadcast(vocabulary) if small else vocabulary, "token").groupBy("token").count()
    best = F.min_by(F.struct("token", "offset"), F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset")).alias("best")
    chosen = tokens.join(places, "token", "left").groupBy("words").agg(best, F.first("items").alias("items"))
    return chosen.select("best.token", "best.offset", "words", "items"), lengths


def _met_by_broadcast(keyed: DataFrame, index: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, h, w, copies, start, words, items): the windows that documents may hold, of an index that each task holds whole.

    Every document also meets one row behind its last word, without words and with copies = 1, so that those without a hit stay.
    """
    places = _document_shingles(keyed, lengths, end=True)
    tail = keyed.sparkSession.createDataFrame([(0, 0, [], [])], "token long, offset int, words array<string>, items array<string>")
    met = places.join(F.broadcast(index.unionByName(tail)), "token")
    return met.select("doc_id", "h", "w", F.when(F.size("words") == 0, 1).alias("copies"), (F.col("pos") - F.col("offset")).alias("start"), "words", "items")


def _met_by_shuffle(keyed: DataFrame, index: DataFrame, lengths: list[int]) -> DataFrame:
    """As _met_by_broadcast, for an index of any size: places go to it by shingle, and only their documents' keys go with them.

    The words are brought back by the document's key, once for each doc_id and text; copies counts the rows, once in each of a document's rows here.
    """
    places = _document_shingles(keyed, lengths).select("doc_id", "h", "pos", "token")
    near = places.join(index.hint("merge"), "token").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), (F.col("pos") - F.col("offset")).alias("start"), "words", "items")
    each = keyed.groupBy("doc_id", "h").agg(F.first("w").alias("w"), F.count("*").alias("copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    return each.join(near.hint("merge"), same, "left").select("doc_id", "h", "w", "copies", "start", "words", "items")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, share: int) -> DataFrame:
    """(doc_id, h, copies, n_words, n_hit, n_items, items_sha256, contaminated) for each doc_id and text (h: its hash).

    Null texts count as empty, but for h, which is that of a null; rows of one doc_id and text are one row with their number as copies. A very long text
    gives a row for each of its words before the join, which meets only those whose shingle is some window's rarest.
    """
    documents = docs.select("doc_id", "text", words_of(F.col("text")).alias("w"))
    index, lengths = window_index(item_windows(benchmark, window), documents, shingle)
    index = written(index, "windows")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    small = index.count() <= BROADCAST_ROWS
    met = (_met_by_broadcast if small else _met_by_shuffle)(keyed, index, lengths)
    copies = F.count("copies") if small else F.max("copies")

    start, size = F.col("start"), F.size("words")
    fits = (start >= 0) & (start + size <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("words"))
    real = (size > 0) & fits
    rows = met.filter(fits) if small else met  # by shuffle, a document without a hit stays as a row of nulls
    found = rows.select("doc_id", "h", "copies", F.size("w").cast("long").alias("n_words"), F.when(real, F.struct(start.alias("s"), (start + size).alias("e"))).alias("span"), F.when(real, F.col("items")).alias("items"))
    by_doc = found.groupBy("doc_id", "h").agg(
        F.max("n_words").alias("n_words"), copies.alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("n"), F.greatest(x["e"], a["end"]).alias("end")),
        lambda a: a["n"],
    )
    out = by_doc.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "copies")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs: doc_id, text; benchmark: item_id, text; other columns aren't read. A word is hit inside any occurrence of a window; a document
    is contaminated if share * n_hit >= n_words and n_hit > 0. Null and empty texts have no words and aren't
    contaminated; an empty benchmark hits nothing; rows with equal doc_id and text give equal rows, as many as there are. A very long text
    gives a row for each of its words before the join.
    """
    found = _hits(docs, benchmark, window, shingle, share).drop("h")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns.

    Null and empty texts stay, as do all rows if the benchmark is empty; rows with equal doc_id and text stay or go together; a null doc_id is a value like others.
    """
    found = _hits(docs, benchmark, window, shingle, share).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__h"))
    return docs.join(found, same, "left_anti")
