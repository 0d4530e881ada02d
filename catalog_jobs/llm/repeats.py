"""Repeated windows of words or bytes over all documents: the shared steps of the substring operators.

A window can only repeat where its least gram (an anchor) occurs at two places. So all documents give their anchors,
the anchors that occur twice choose the runs of windows to look at, and equal runs fall together: equal in the hash of their anchor
and in a BLAKE2b digest of the words or bytes themselves. Runs that share an anchor but differ are cut into pieces by the distance of a
window from its anchor, and compared piece by piece in the same way; only pieces that still differ
from others around the same bytes go further. Exact copies of a text are settled by its SHA-256.

Documents are ordered by (ord, tie): ord is doc_id with null first, tie a hash of the text, so that repeated rows of one
doc_id and text are one document, and rows of one doc_id with other texts follow each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm import winnow
from catalog_jobs.llm.common import discard, written

NO_ID = -(1 << 63)
RUNS = "m long, rh long, ord long, tie long, start int, n int, tied boolean"
PIECES = "key long, ch long, ord long, tie long, run int, start int, n int, done boolean"


@dataclass(frozen=True)
class Unit:
    """What a window consists of: `size` units each, anchored by grams of `gram` units."""

    size: int
    gram: int
    #: Distances from the anchor in one piece, from coarse to single windows.
    steps: tuple[int, ...]
    #: Bytes of text handled at once.
    batch_bytes: int
    #: A batch of texts -> (64-bit units of all texts, where each text's units begin and the last ones end).
    units: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    #: A text -> its units as bytes, and what joins the kept ones.
    split: Callable[[bytes], list[bytes] | bytes]
    joint: bytes
    #: Column type of a part of a text, and (part, units to skip, units to take) -> part.
    part: str
    cut: Callable[[Column, Column, Column], Column]

    @property
    def width(self) -> int:
        return self.size - self.gram + 1

    def whole(self, text: bytes) -> bytes:
        """The text as its units joined."""
        return self.joint.join(self.split(text)) if self.joint else text

    def parts(self, texts: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Units start to start + n - 1 of texts[doc], for each row; a row's text is joined units already."""
        if not self.joint:
            return [texts[d][s:e] for d, s, e in zip(doc.tolist(), start.tolist(), (start + n).tolist(), strict=True)]
        split = {d: texts[d].split() for d in np.unique(doc).tolist()}
        return [self.joint.join(split[d][s:e]) for d, s, e in zip(doc.tolist(), start.tolist(), (start + n).tolist(), strict=True)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    chunks = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(chunks)
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
    coded = words.dictionary_encode()
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)
    bounds = np.concatenate([[0], np.cumsum(there)])[offsets]
    return (hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.uint64))[there], bounds


_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return _BYTE[np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)], bounds


def _cut_words(part: Column, skip: Column, take: Column) -> Column:
    return F.array_join(F.slice(F.split(part, " "), skip + 1, take), " ")


def _cut_bytes(part: Column, skip: Column, take: Column) -> Column:
    return F.substring(part, skip + 1, take)


WORDS20 = Unit(20, 6, (5, 1), 2_000_000, _words, bytes.split, b" ", "string", _cut_words)
BYTES100 = Unit(100, 37, (16, 4, 1), 500_000, _bytes, lambda text: text, b"", "binary", _cut_bytes)


def order_of(text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """(ord, tie) of each row. A null doc_id comes before the least number: it has the negative ties of that ord, and the number the others."""
    key, tie = F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    half = F.when(key.isNull(), F.lit(NO_ID)).otherwise(F.lit(0).cast("long")).bitwiseOR(tie.bitwiseAND(F.lit((1 << 63) - 1)))
    return F.coalesce(key, F.lit(NO_ID)), F.when(key.isNull() | (key == NO_ID), half).otherwise(tie)


def doc_id_of(ord_: str = "ord", tie: str = "tie") -> Column:
    """The doc_id of (ord, tie)."""
    return F.when((F.col(ord_) != NO_ID) | (F.col(tie) >= 0), F.col(ord_))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(ord, tie, t): the place of each row in the order of documents, and its text, empty for null."""
    ord_, tie = order_of(text)
    return docs.select(ord_.alias("ord"), tie.alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def document_key(of: str = "") -> Column:
    """k: 32 bits for (ord, tie), which stand for a document where its anchors are gathered.

    Documents that share one are looked at for each other's anchors too, which changes no result.
    """
    return F.hash(f"{of}ord", f"{of}tie").alias("k")


def _parts(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about `most` bytes of text; a longer text is a slice of its own."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            took = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, took + most, "right")) - at)
            yield b.slice(at, n)
            at += n


def _whole(column: pa.Array) -> pa.Array:
    """A slice as an array of its own that begins at offset 0."""
    return pa.concat_arrays([column])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def fingerprints(documents: DataFrame, unit: Unit) -> DataFrame:
    """keyed() rows -> (ord, tie, blob, n_units, whole_sha256, ms): whole-text hashes and all anchors of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", unit.batch_bytes):
            texts = _whole(b.column("t"))
            units, bounds = unit.units(texts)
            w, grams = winnow.windows(units, bounds, unit.size, unit.gram)
            places = winnow.anchors(w, grams, unit.width)
            counts = np.diff(np.searchsorted(places, bounds))
            raw = texts.cast(pa.binary()).to_pylist()
            blobs = [hashlib.sha256(x) for x in raw]
            shas = [hashlib.sha256(unit.whole(x)) for x in raw] if unit.joint else blobs
            yield pa.RecordBatch.from_arrays(
                [b.column("ord"), b.column("tie"), pa.array([x.digest() for x in blobs]), pa.array(np.diff(bounds)), pa.array([x.hexdigest() for x in shas]), _lists(grams[places].view(np.int64), counts)],
                ["ord", "tie", "blob", "n_units", "whole_sha256", "ms"],
            )

    return documents.mapInArrow(scan, "ord long, tie long, blob binary, n_units long, whole_sha256 string, ms array<long>")


def first_texts(prints: DataFrame) -> DataFrame:
    """(blob, first, ms): the first document of each text, as struct(ord, tie)."""
    return prints.groupBy("blob").agg(F.min(F.struct("ord", "tie")).alias("first"), F.first("ms").alias("ms"))


def suspects(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The keyed() rows with their anchors in chosen(k, ms), as a table: only these are read again."""
    return written(documents.withColumn("k", document_key()).join(chosen, "k").drop("k"), "suspects")


def _digests(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=8).digest() for p in parts]), np.int64)


def text_runs(documents: DataFrame, unit: Unit) -> DataFrame:
    """keyed() rows -> (ord, tie, n_units, whole_sha256, runs): all runs of each row's windows, array of struct(m, rh, start, n, tied)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", unit.batch_bytes):
            texts = _whole(b.column("t"))
            units, bounds = unit.units(texts)
            raw = texts.cast(pa.binary()).to_pylist()
            w, grams = winnow.windows(units, bounds, unit.size, unit.gram)
            first, n = winnow.runs(w)
            rh = _digests(unit.parts(raw, w.doc[first], w.place[first], n - 1 + unit.size))
            fields = {"m": w.least[first].view(np.int64), "rh": rh, "start": w.place[first].astype(np.int32), "n": n.astype(np.int32), "tied": winnow.tied(w, grams, first, n, unit.width)}
            runs = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
            ends = np.searchsorted(w.doc[first], np.arange(len(raw) + 1)).astype(np.int32)
            shas = pa.array([hashlib.sha256(unit.whole(x)).hexdigest() for x in raw])
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("tie"), pa.array(np.diff(bounds)), shas, pa.ListArray.from_arrays(pa.array(ends), runs)], ["ord", "tie", "n_units", "whole_sha256", "runs"])

    return documents.mapInArrow(scan, "ord long, tie long, n_units long, whole_sha256 string, runs array<struct<m: long, rh: long, start: int, n: int, tied: boolean>>")


def repeated_runs(rows: DataFrame, unit: Unit) -> DataFrame:
    """Runs of windows of suspects() rows whose anchor is in their ms; rh is the digest of all units that a run covers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", unit.batch_bytes):
            texts = _whole(b.column("t"))
            units, bounds = unit.units(texts)
            w, grams = winnow.windows(units, bounds, unit.size, unit.gram)
            first, n = winnow.runs(w)
            wanted = np.unique(pc.list_flatten(_whole(b.column("ms"))).to_numpy(zero_copy_only=False)).view(np.uint64)
            keep = np.isin(w.least[first], wanted)
            first, n = first[keep], n[keep]
            row = pa.array(w.doc[first])
            rh = _digests(unit.parts(texts.cast(pa.binary()).to_pylist(), w.doc[first], w.place[first], n - 1 + unit.size))
            cols = [pa.array(w.least[first].view(np.int64)), pa.array(rh), b.column("ord").take(row), b.column("tie").take(row), pa.array(w.place[first].astype(np.int32)), pa.array(n.astype(np.int32))]
            cols.append(pa.array(winnow.tied(w, grams, first, n, unit.width)))
            yield pa.RecordBatch.from_arrays(cols, ["m", "rh", "ord", "tie", "start", "n", "tied"])

    return rows.mapInArrow(scan, RUNS)


def first_runs(found: DataFrame) -> DataFrame:
    """(m, rh, first, n, tied, c): the first of the runs of each content, and how many there are, as a table."""
    return written(found.groupBy("m", "rh").agg(F.min(F.struct("ord", "tie", "start")).alias("first"), F.max("n").alias("n"), F.max("tied").alias("tied"), F.count("*").alias("c")), "firsts")


def later_runs(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(ord, tie, start, n) of the runs whose content begins earlier elsewhere. firsts: m, rh, first, c."""
    here = F.struct("ord", "tie", "start")
    known = firsts.filter("c > 1").select("m", "rh", "first")
    return found.select("m", "rh", "ord", "tie", "start", "n").join(known, ["m", "rh"]).filter(here != F.col("first")).select("ord", "tie", "start", "n")


def differing(firsts: DataFrame) -> DataFrame:
    """(m, ord, tie, start, n): the rows of firsts whose anchor has runs of two or more contents, or occurs twice inside a run."""
    shared = written(firsts.groupBy("m").agg(F.count("*").alias("k"), F.max("tied").alias("t")).filter("k > 1 or t").select("m"), "shared")
    return firsts.join(shared, "m").select("m", "first.*", "n")


def runs_by_document(runs: DataFrame) -> DataFrame:
    """(ord, tie, runs) for runs (m, ord, tie, start, n): each document's own."""
    return runs.groupBy("ord", "tie").agg(F.collect_list(F.struct("m", "start", "n")).alias("runs"))


def run_contents(texts: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """(m, ord, tie, start, n, seg) for runs_by_document() of texts (ord, tie, t: each document once): the units that each run covers, joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", unit.batch_bytes):
            raw, lists = _whole(b.column("t")).cast(pa.binary()).to_pylist(), _whole(b.column("runs"))
            flat = lists.flatten()
            row = np.repeat(np.arange(len(raw)), lists.value_lengths().to_numpy())
            start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            segs = pa.array(unit.parts(raw, row, start, n - 1 + unit.size), pa.binary())
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("m"), b.column("ord").take(row), b.column("tie").take(row), flat.field("start"), flat.field("n"), segs.cast(pa.string()) if unit.part == "string" else segs],
                ["m", "ord", "tie", "start", "n", "seg"],
            )

    return texts.join(wanted, ["ord", "tie"]).mapInArrow(scan, f"m long, ord long, tie long, start int, n int, seg {unit.part}")


def pieces(contents: DataFrame, unit: Unit, step: int) -> DataFrame:
    """PIECES of run_contents() rows: neighbouring windows with one anchor, whose distances from it fall in one range of `step`.

    Equal windows lie at one distance from their anchor, so in pieces of one range; and what all windows of a range cover, `size` - step + 1 units around the anchor,
    is then equal too: its hash is the key. ch is the digest of all units of the piece. Pieces that occur again
    in their own run are `done`: they go, neighbouring ones as one row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "seg", unit.batch_bytes):
            segs = _whole(b.column("seg"))
            units, bounds = unit.units(segs)
            w, grams = winnow.windows(units, bounds, unit.size, unit.gram)
            distance = winnow.anchor_distance(w, grams, bounds)
            range_ = distance // step
            first, n = winnow.groups((w.doc, w.start + distance, range_))
            doc, place, low = w.doc[first], w.place[first], range_[first] * step
            length = unit.size + 1 - np.minimum(step, unit.width - low)
            shared = w.start[first] + distance[first] - low
            key = np.zeros(len(first), np.uint64)
            for size, hashes in winnow.span_hashes(units, np.unique(length).tolist()).items():
                key[length == size] = hashes[shared[length == size]]
            key = winnow.mix(key, low.astype(np.uint64)).view(np.int64)
            ch = _digests(unit.parts(segs.cast(pa.binary()).to_pylist(), doc, place, n - 1 + unit.size))
            order = np.lexsort((place, ch, key, doc))
            done = np.zeros(len(first), bool)
            done[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (key[order[1:]] == key[order[:-1]]) & (ch[order[1:]] == ch[order[:-1]])
            at, joined = winnow.groups((doc, np.where(done, 0, np.arange(1, len(first) + 1))))
            n = np.add.reduceat(n, at) if len(at) else n
            row, run = pa.array(doc[at]), b.column("start").to_numpy()[doc[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at]), pa.array(ch[at]), b.column("ord").take(row), b.column("tie").take(row), pa.array(run), pa.array((run + place[at]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(done[at])],
                ["key", "ch", "ord", "tie", "run", "start", "n", "done"],
            )

    return contents.select("ord", "tie", "start", "seg").mapInArrow(scan, PIECES)


def settle(contents: DataFrame, unit: Unit, step: int) -> tuple[DataFrame, DataFrame | None]:
    """(windows that go: ord, tie, start, n; what is left: m, ord, tie, start, n, seg, key, size) of run_contents() rows; tables, all three.

    Of pieces with one content all but the first go. What is left is the first of each content, where several contents share their key; size sums the units
    of a key's contents. At step 1 a key is a whole window, and nothing is left.
    """
    table = written(pieces(contents, unit, step), "pieces")
    live, place = table.filter("not done"), ["ord", "tie", "start"]
    firsts = written(live.groupBy("key", "ch").agg(F.min(F.struct(*place, "run", "n")).alias("first"), F.count("*").alias("c")), "first_pieces")
    known = firsts.filter("c > 1").select("key", "ch", F.struct(*(F.col(f"first.{c}").alias(c) for c in place)).alias("first"))
    later = live.join(known, ["key", "ch"]).filter(F.struct(*place) != F.col("first")).select(*place, "n")
    gone = written(table.filter("done").select(*place, "n").unionByName(later), "gone")
    discard(table)
    if step == 1:
        return gone, None
    units = F.col("first.n") - 1 + unit.size
    several = firsts.groupBy("key").agg(F.count("*").alias("k"), F.sum(units).alias("size")).filter("k > 1").select("key", "size")
    left = firsts.select("key", "first.*").join(several, "key")
    whole = contents.select("m", "ord", "tie", F.col("start").alias("run"), "seg")
    part = unit.cut(F.col("seg"), F.col("start") - F.col("run"), F.col("n") - 1 + unit.size)
    rest = written(left.join(whole, ["ord", "tie", "run"]).select("m", *place, "n", part.alias("seg"), "key", "size"), "left")
    discard(firsts)
    return gone, rest


def removed_report(documents: DataFrame, prints: DataFrame, removed: DataFrame, unit: Unit, copies: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, kept_sha256) for each row of prints.

    removed: (ord, tie, start, n), windows that go with all their units; copies(blob, first), if given: the first document of each text; the
    texts of other documents go whole if they have a window. Texts are read again only where something goes in part.
    """
    places = removed.groupBy("ord", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", unit.batch_bytes):
            rows = []
            for text, starts, ns in zip(_whole(b.column("t")).cast(pa.binary()).to_pylist(), b.column("starts"), b.column("ns"), strict=True):
                units = unit.split(text)
                gone = winnow.cover(starts.values.to_numpy(), ns.values.to_numpy(), unit.size, len(units))
                kept = unit.joint.join(itertools.compress(units, ~gone)) if unit.joint else np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("tie"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["ord", "tie", "gone", "spans", "sha"])

    parts = documents.join(places, ["ord", "tie"]).mapInArrow(cut, "ord long, tie long, gone long, spans long, sha string").dropDuplicates(["ord", "tie"])
    rows = prints.select("ord", "tie", "n_units", "whole_sha256", *([] if copies is None else ["blob"])).join(parts, ["ord", "tie"], "left")
    whole = F.lit(False)
    if copies is not None:
        rows = rows.join(copies.select("blob", "first"), "blob")
        whole = (F.struct("ord", "tie") != F.col("first")) & (F.col("n_units") >= unit.size)
    return rows.select(
        doc_id_of().alias("doc_id"), "n_units",
        F.when(whole, F.col("n_units")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
    )
