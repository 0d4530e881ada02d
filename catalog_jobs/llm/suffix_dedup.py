"""Suffix-array dedup of bytes: Burrows-Wheeler transforms of shards are merged by refining their interleave.

Texts are cut down to what can repeat first (see repeats): the different runs of windows around an anchor that several runs share. Equal
runs are one content, held under its first place. All other runs are dealt by their anchor into buckets of bounded size, and by document
into a bucket's shards; only where one anchor has more different runs than a bucket should hold are they cut to pieces first, which share more bytes around it. The
suffixes of each shard are sorted on their own, and the shards' transforms are merged without sorting suffixes again: the interleave by
the first h bytes, and the links of each suffix to the one h bytes later, which the transforms hold, give the interleave by the first
2 h bytes. Block bounds are the places with common prefixes shorter than h; a block of one suffix is settled and isn't refined.
At `size` bytes the blocks of two or more suffixes are the repeated intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm import repeats
from catalog_jobs.llm.common import discard, without, written
from catalog_jobs.llm.repeats import BYTES100, Unit

SHARDS = 4
#: Bytes of different runs or pieces in a bucket, about.
BUCKET_BYTES = 1_000_000
#: Bytes of different runs of one anchor that go into a bucket as they are; more are cut to what shares more bytes around the anchor.
KEY_BYTES = 500_000


def _settled(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a block of equal keys begins, which rows are a block of their own) of sorted keys."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)), new & np.append(new[1:], True)


def shard_transform(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix array) of segments, each ended by a 0 before all bytes, which count from 1 here; ties by segment.

    The suffix array has places in the segments laid one after another with their ends. The transform of a segment's first
    suffix is 0. A byte of 255, which UTF-8 doesn't have, isn't allowed.
    """
    text = np.frombuffer(b"".join(s + b"\xff" for s in segments), np.uint8) + np.uint8(1)
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text))  # symbols before the end
    key = text.astype(np.uint64)
    for h in (1, 2, 4):  # the first eight symbols as one number
        key <<= np.uint64(8 * h)
        key[:-h] |= np.where(left[:-h] >= h, key[h:] >> np.uint64(8 * h), np.uint64(0))
    order = np.argsort(key)
    head, alone = _settled(key[order])
    rank = np.empty(len(text), np.int64)
    rank[order] = head
    open_ = np.flatnonzero(~alone)
    h, longest = 8, int(np.diff(ends, prepend=-1).max())
    while h < longest and len(open_):
        at = order[open_]
        key = (rank[at] << 32) + np.where(left[at] >= h, rank[np.minimum(at + h, len(text) - 1)] + 1, 0)
        by = np.argsort(key)
        at = order[open_] = at[by]
        head, alone = _settled(key[by])
        rank[at] = open_[head]
        open_ = open_[~alone]
        h *= 2
    if len(open_):  # equal suffixes: by segment
        at = order[open_]
        order[open_] = at[np.argsort((rank[at] << 32) + at)]
    return np.append(np.uint8(0), text[:-1])[order], order.astype(np.int32)


def merge_transforms(transforms: list[np.ndarray], size: int) -> np.ndarray:
    """The block of each suffix, shard after shard in each one's order: the number of suffixes whose first `size` bytes are less.

    Suffixes that consist of an end are one block at the front and go on to themselves.
    """
    links, base = [], 0
    for t in transforms:
        link = np.argsort(t, kind="stable")  # the suffix one byte later, by rank
        n_ends = int(np.count_nonzero(t == 0))
        link[:n_ends] = np.arange(n_ends)
        links.append(link + base)
        base += len(t)
    later = {1: np.concatenate(links).astype(np.int32)}
    first = np.concatenate([np.sort(t, kind="stable") for t in transforms])
    counts = np.bincount(first, minlength=256)
    block = (np.cumsum(counts) - counts)[first]
    many = counts > 1
    many[0] = False
    open_, slots = np.flatnonzero(many[first]), np.flatnonzero(np.repeat(many, counts))

    def refine(by: np.ndarray) -> None:
        """From blocks of equal h bytes to those of h + k, where `by` leads k bytes on; only blocks of several suffixes are touched."""
        nonlocal open_, slots
        key = (block[open_] << 32) + block[by[open_]]
        order = np.argsort(key, kind="stable")  # each shard's part is in order already: a merge
        head, alone = _settled(key[order])
        block[open_[order]] = slots[head]
        open_, slots = np.sort(open_[order][~alone]), slots[~alone]

    h = 1
    while 2 * h <= size and len(open_):
        refine(later[h])
        later[2 * h] = later[h][later[h]]
        h *= 2
    rest = [1 << i for i in range(h.bit_length()) if size - h >> i & 1]
    if rest and len(open_):
        by = later[rest[0]]
        for k in rest[1:]:
            by = later[k][by]
        refine(by)
    return block


def _bucket(size: int):
    def merge(table: pa.Table) -> pa.Table:
        """The runs or pieces of one bucket (ord, tie, start, n, seg) -> (ord, tie, start, n) of the windows that start earlier elsewhere, neighbours as one row."""
        dealt = pa.array(table.column("tie").to_numpy() % SHARDS)
        shards = [t for i in range(SHARDS) if (t := table.filter(pc.equal(dealt, i))).num_rows]
        made = [shard_transform(t.column("seg").to_pylist()) for t in shards]
        ranked = merge_transforms([t for t, _ in made], size)
        bounds = np.cumsum([0] + [len(t) for t, _ in made])
        block = np.empty(bounds[-1], np.int64)  # by place in the shards' texts
        block[np.concatenate([a + b for (_, a), b in zip(made, bounds, strict=False)])] = ranked
        table = pa.concat_tables(shards)
        ord_, tie, start, n = (table.column(c).to_numpy() for c in ("ord", "tie", "start", "n"))
        lengths = n.astype(np.int64) + size  # n - 1 + size bytes and the end
        begin = np.cumsum(lengths) - lengths
        at = np.flatnonzero(np.arange(bounds[-1]) - np.repeat(begin, lengths) < np.repeat(n, lengths))
        # windows of one document are in one run only, so that runs in order of documents give windows in that order
        by = np.lexsort((start, tie, ord_))
        moved = np.empty(len(n), np.int64)
        moved[by] = np.cumsum(lengths[by]) - lengths[by]
        place = at + np.repeat(moved - begin, n)
        least = np.full(bounds[-1], bounds[-1])
        np.minimum.at(least, block[at], place)
        gone = np.zeros(bounds[-1] + 1, np.int8)
        gone[at[place != least[block[at]]]] = 1
        edge = np.diff(gone, prepend=np.int8(0))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.searchsorted(begin, first, "right") - 1
        return pa.table({"ord": ord_[run], "tie": tie[run], "start": (start[run] + first - begin[run]).astype(np.int32), "n": (end - first).astype(np.int32)})

    return merge


def _n_buckets(rows: DataFrame, unit: Unit) -> Column:
    """How many buckets hold the bytes of rows (n, size) whose key isn't cut again."""
    n_bytes = rows.filter(F.col("size") <= KEY_BYTES).agg(F.sum(F.col("n").cast("long") + unit.size)).first()[0] or 0
    return F.lit(n_bytes // BUCKET_BYTES + 1)


def merged_buckets(rows: DataFrame, unit: Unit) -> DataFrame:
    """(ord, tie, start, n) of the windows of rows (bucket, ord, tie, start, n, seg) that start earlier in another place of their bucket."""
    return rows.select("bucket", "ord", "tie", "start", "n", "seg").groupBy("bucket").applyInArrow(_bucket(unit.size), "ord long, tie long, start int, n int")


def dealt_runs(firsts: DataFrame, unit: Unit) -> DataFrame:
    """differing() runs of firsts with m replaced by the bucket of their anchor, or -1 for those of anchors with more than KEY_BYTES of different runs."""
    runs = repeats.differing(firsts)
    sizes = runs.groupBy("m").agg(F.sum(F.col("n").cast("long") - 1 + unit.size).alias("size"))
    runs = written(runs.join(sizes, "m"), "wanted")
    bucket = F.pmod(F.xxhash64("m"), _n_buckets(runs, unit))
    return runs.select(F.when(F.col("size") <= KEY_BYTES, bucket).otherwise(-1).alias("m"), "ord", "tie", "start", "n")


def dedup_bytes(docs: DataFrame, unit: Unit = BYTES100) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256) for each row of docs: bytes in a window that also starts earlier are removed.

    Null and empty texts have no bytes; texts shorter than a window lose nothing; repeated rows of one doc_id and text are
    one document and get equal results; a null doc_id comes before all others. A very long text is read whole by one task, in
    some hundred bytes of memory for each of its own.
    """
    documents = repeats.keyed(docs)
    prints = written(repeats.fingerprints(documents, unit), "prints")
    texts = written(repeats.first_texts(prints), "texts")
    prints = without(prints, "ms")
    anchors = texts.select(F.explode("ms").alias("m"), repeats.document_key("first."))
    again = written(anchors.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "again")
    rows = repeats.suspects(documents, anchors.join(again, "m").groupBy("k").agg(F.collect_set("m").alias("ms")))
    discard(again)
    texts = without(texts, "ms")
    found = written(repeats.repeated_runs(rows, unit), "found")
    firsts = repeats.first_runs(found)
    gone = written(repeats.later_runs(found, firsts), "later")
    discard(found)

    texts_of = rows.select("ord", "tie", "t").dropDuplicates(["ord", "tie"])
    contents = written(repeats.run_contents(texts_of, repeats.runs_by_document(dealt_runs(firsts, unit)), unit), "contents")
    discard(firsts)
    gone = gone.unionByName(written(merged_buckets(contents.filter("m >= 0").withColumnRenamed("m", "bucket"), unit), "merged"))
    contents = contents.filter("m < 0")
    for step in unit.steps:
        if contents.isEmpty():
            break
        more, left = repeats.settle(contents, unit, step)
        gone = gone.unionByName(more)
        if left is not None:
            small = F.col("size") <= KEY_BYTES
            dealt = left.filter(small).withColumn("bucket", F.pmod(F.xxhash64("key"), _n_buckets(left, unit)))
            gone = gone.unionByName(merged_buckets(dealt, unit))
            contents = left.filter(~small)
    return repeats.removed_report(rows, prints, gone, unit, texts)
