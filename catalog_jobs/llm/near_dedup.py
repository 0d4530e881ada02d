"""Near-duplicate documents by chosen-path set similarity join.

A document's set of word shingles is reduced to a class (equal sets) and a sketch. In each of several independent
trees, a node's documents branch by their two minwise tokens of the next level; small nodes are compared
exhaustively, and nodes that stay large at full depth, which hold many copies of one text, against pivots and, for what no pivot reaches,
in blocks. Candidates are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written
from catalog_jobs.llm.components import components
from catalog_jobs.llm.repeats import _parts, _whole, doc_id_of, keyed, order_of
from catalog_jobs.llm.winnow import mix, span_hashes


@dataclass(frozen=True)
class Join:
    """Parameters of the join. A pair of similarity 0.8 shares one of two minwise tokens at a level with probability 0.97,
    so that six trees of three levels miss it with probability 0.09 ** 6, 5.3e-7; the sketch loses 6.2e-08 more (see agree),
    together under one in a million; more alike pairs less.
    """

    words: int = 5
    percent: int = 80
    trees: int = 6
    levels: int = 3
    #: Documents of a node that are compared exhaustively.
    small: int = 16
    #: Pivots of a node that stays large.
    pivots: int = 3
    #: Of 32 minwise tokens, how many must agree (4 bits each) for a pair to be confirmed: 26 are expected at 0.8, and fewer than 13 have probability 6.2e-08.
    agree: int = 13
    block: int = 256


PERMS = 32
_rng = np.random.default_rng(11)
_ODD, _XOR = (_rng.integers(1, 1 << 63, PERMS, np.uint64) | np.uint64(1) for _ in range(2))
NODE = "node long, cid long, n int, s1 long, s2 long"


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, bounds of each text). A-Z count as a-z; a text of fewer words, but not none, is one shingle."""
    lower = pa.array([t.lower() for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    chunks = pc.ascii_split_whitespace(lower)
    flat = pc.list_flatten(chunks)
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    hashes = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    units = hashes[coded.indices.to_numpy(zero_copy_only=False)][there] if len(flat) else hashes
    bounds = np.concatenate([[0], np.cumsum(there)])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
    sizes = np.diff(bounds)
    n = np.where(sizes >= words, sizes - words + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    grams = span_hashes(units, [words])[words]
    values = grams[bounds[doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    whole = np.array([int.from_bytes(hashlib.blake2b(units[bounds[i] : bounds[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
    doc, values = np.concatenate([doc, short]), np.concatenate([values, whole])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(len(n) + 1))


def sketch(values: np.ndarray, bounds: np.ndarray, n_two: int) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: ([set, 2 * n_two] two least hashes of the first n_two permutations, [set, 2] 32 least hashes of 4 bits)."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    two = np.zeros((len(starts), 2 * n_two), np.int32)
    bits = np.zeros((len(starts), 2), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(PERMS):
        h = mix(values ^ _XOR[k], np.zeros(1, np.uint64)) * _ODD[k]
        least = np.minimum.reduceat(h, starts)
        bits[:, k // 16] |= (least >> np.uint64(20) & np.uint64(15)) << np.uint64(4 * (k % 16))
        if k < n_two:
            h[h == np.repeat(least, sizes)] = top
            second = np.minimum.reduceat(h, starts)
            second = np.where(second == top, least, second)
            for j, v in enumerate((least, second)):
                two[:, 2 * k + j] = (v >> np.uint64(7)).astype(np.uint32).view(np.int32)
    return two, bits


def sketches(documents: DataFrame, join: Join) -> DataFrame:
    """keyed() rows -> (ord, tie, n, digest, s1, s2, sk): set size, digest of the set (null if empty) and sketch."""
    n_two = join.trees * join.levels

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", 8_000_000):
            values, bounds = shingle_sets(_whole(b.column("t")), join.words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            two, bits = np.zeros((len(sizes), 2 * n_two), np.int32), np.zeros((len(sizes), 2), np.uint64)
            if len(full):
                two[full], bits[full] = sketch(values, np.append(bounds[:-1][full], bounds[-1]), n_two)
            digests = [hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            sk = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * 2 * n_two, pa.int32()), pa.array(two.ravel()))
            bits = bits.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("tie"), pa.array(sizes.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), sk], ["ord", "tie", "n", "digest", "s1", "s2", "sk"])

    return documents.mapInArrow(scan, "ord long, tie long, n int, digest binary, s1 long, s2 long, sk array<int>")


def _alike(a: dict[str, np.ndarray], b: dict[str, np.ndarray], join: Join) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose sketches agree enough."""
    out = 100 * np.minimum(a["n"], b["n"]).astype(np.int64) >= join.percent * np.maximum(a["n"], b["n"]).astype(np.int64)
    agree = np.zeros(len(out), np.int64)
    for s in ("s1", "s2"):
        x = a[s].view(np.uint64) ^ b[s].view(np.uint64)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        agree += 16 - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int64)
    return out & (agree >= join.agree)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: b.column(c).to_numpy() for c in ("node", "cid", "n", "s1", "s2")}


def _exhaustive(nodes: DataFrame, join: Join) -> DataFrame:
    """Alike pairs in nodes of at most join.small documents: rows of a node lie together, and each is compared with those after it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: dict[str, np.ndarray] | None = None
        for b in batches:
            x = _columns(b)
            if tail is not None:
                x = {c: np.concatenate([tail[c], v]) for c, v in x.items()}
            for by in range(1, join.small):
                i = np.flatnonzero(x["node"][by:] == x["node"][:-by]) if len(x["node"]) > by else np.zeros(0, np.int64)
                if not len(i):
                    break
                p, q = ({c: v[k] for c, v in x.items()} for k in (i, i + by))
                ok = _alike(p, q, join)
                yield _pairs(p["cid"][ok], q["cid"][ok])
            # the last node may go on in the next batch; its pairs may come twice
            tail = {c: v[max(0, len(v) - join.small) :] for c, v in x.items()}

    return nodes.select("node", "cid", "n", "s1", "s2").repartition("node").sortWithinPartitions("node").mapInArrow(scan, "a long, b long")


def _against(rows: DataFrame, join: Join) -> DataFrame:
    """Alike pairs of each row (cid, n, s1, s2) with the documents of its array `others`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, others = _columns(b), _whole(b.column("others"))
            sizes = pc.list_value_length(others).to_numpy(zero_copy_only=False)
            flat = others.flatten()
            q = {"cid": flat.field("cid"), "n": flat.field("n"), "s1": flat.field("s1"), "s2": flat.field("s2")}
            q = {c: v.to_numpy(zero_copy_only=False) for c, v in q.items()}
            p = {c: np.repeat(v, sizes) for c, v in x.items()}
            ok = _alike(p, q, join) & (p["cid"] != q["cid"])
            yield _pairs(p["cid"][ok], q["cid"][ok])

    return rows.select("node", "cid", "n", "s1", "s2", "others").mapInArrow(scan, "a long, b long")


def candidates(classes: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs a < b, nodes that stayed large: NODE) of classes (cid, n, s1, s2, sk)."""
    width = 2 * join.levels
    trees = F.transform(F.sequence(F.lit(0), F.lit(join.trees - 1)), lambda t: F.struct(t.alias("t"), F.slice("sk", t * width + 1, F.lit(width)).alias("sk")))
    rows = classes.select("cid", "n", "s1", "s2", F.explode(trees).alias("tree")).select(F.col("tree.t").cast("long").alias("node"), "cid", "n", "s1", "s2", "tree.sk")
    pairs = None
    for level in range(join.levels):
        tokens = F.array_distinct(F.slice("sk", 2 * level + 1, 2))
        rows = rows.withColumn("token", F.explode(tokens)).withColumn("node", F.xxhash64("node", "token")).drop("token")
        sizes = written(rows.groupBy("node").count().filter("count > 1"), "sizes")
        rows = written(rows.join(sizes, "node"), "nodes")
        found = _exhaustive(rows.filter(F.col("count") <= join.small), join)
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = rows.filter(F.col("count") > join.small).drop("count")
    me = F.struct("cid", "n", "s1", "s2")
    chosen = rows.groupBy("node").agg(F.array_distinct(F.array(*(F.min_by(me, F.xxhash64("cid", F.lit(q))) for q in range(join.pivots)))).alias("others"))
    pairs = pairs.unionByName(_against(rows.join(written(chosen, "pivots"), "node"), join))
    return written(pairs.distinct(), "pairs"), rows


def confirmed(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets (cid, set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= join.percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep))

    rows = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _full_sets(documents: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(cid, set) for wanted(cid, ord, tie)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, "t", 8_000_000):
            values, bounds = shingle_sets(_whole(b.column("t")), join.words)
            yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["cid", "set"])

    return documents.join(wanted, ["ord", "tie"]).select("cid", "t").mapInArrow(scan, "cid long, set binary").dropDuplicates(["cid"])


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components so far (labels: v, root)."""
    out = pairs.select("a", "b")
    for end in ("a", "b"):
        out = out.join(labels.select(F.col("v").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return out.filter("root_a <> root_b").select("a", "b")


def _apart(large: DataFrame, labels: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) in large nodes of documents outside the main component with documents of other components.

    A node's main component is that of its first pivot; nodes with one main component are one group here, since they hold mostly the same copies. Its
    documents outside are compared with all of its documents on the full sets, in blocks: no pair is a row unless it is a link,
    and no task holds more than join.block documents outside and four times as many others.
    """
    held = written(large.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")), "held")
    main = written(held.groupBy("node").agg(F.min_by("root", F.xxhash64("cid", F.lit(0))).alias("main")), "main")
    members = written(held.join(main, "node").select("main", "cid", "root").distinct(), "members")
    sizes = members.groupBy("main").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("n_out")).filter("n_out > 0")
    sizes = written(sizes.select("main", F.ceil(F.col("n") / (4 * join.block)).cast("int").alias("chunks"), F.ceil(F.col("n_out") / join.block).cast("int").alias("parts")), "blocks")
    rows = written(members.join(sizes, "main").join(sets, "cid"), "members")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(n: str):
        return F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")

    both = rows.select("main", "cid", "root", "set", F.lit(False).alias("out"), one("chunks").alias("chunk"), every("parts").alias("part"))
    out = rows.filter("root <> main").select("main", "cid", "root", "set", F.lit(True).alias("out"), every("chunks").alias("chunk"), one("parts").alias("part"))

    def compare(table: pa.Table) -> pa.Table:
        out = np.array(table.column("out").to_pylist())
        cid, root = (table.column(c).to_numpy() for c in ("cid", "root"))
        full = [np.frombuffer(v, np.uint64) for v in table.column("set").to_pylist()]
        ours, others = np.flatnonzero(out), np.flatnonzero(~out)
        found: list[tuple[int, int]] = []
        if len(ours) and len(others):
            sizes = np.array([len(full[i]) for i in ours])
            tokens, owner = np.concatenate([full[i] for i in ours]), np.repeat(np.arange(len(ours)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            for j in others:
                low, high = np.searchsorted(tokens, full[j], "left"), np.searchsorted(tokens, full[j], "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(ours))
                near = (100 * common >= join.percent * (sizes + len(full[j]) - common)) & (root[ours] != root[j])
                found += [(int(cid[ours[k]]), int(cid[j])) for k in np.flatnonzero(near)]
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return both.unionByName(out).groupBy("main", "chunk", "part").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """(ord, tie, n_shingles, root) for each row of docs: root is the least struct(ord, tie) of all documents linked to it.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Null texts and texts without words have
    no set and are linked with nothing. Documents with equal sets are one class from the start, so that copies
    cost one row; repeated rows of one doc_id are linked like other documents; a null doc_id comes first. A very long text is read
    whole by one task, in some hundred bytes of memory for each of its words.
    """
    documents = keyed(docs)
    rows = written(sketches(documents, join), "sketches")
    grouped = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("ord", "tie")).alias("first"), *(F.first(c).alias(c) for c in ("n", "s1", "s2", "sk")))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "digest", "first.ord", "first.tie", "n", "s1", "s2", "sk"), "classes")
    pairs, large = candidates(classes, join)

    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).unionByName(large.select("cid")).distinct()
    sets = written(_full_sets(documents, classes.select("cid", "ord", "tie").join(ends, "cid"), join), "sets")

    # one partner for each document first: most other pairs of a group are then in one component and need no test
    first = pairs.groupBy("a").agg(F.min("b").alias("b")).unionByName(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct()
    edges = written(confirmed(first, sets, join), "links")
    labels = components(edges)
    edges = edges.unionByName(written(confirmed(_between(pairs, labels), sets, join), "links"))
    labels = components(edges)

    more = written(_apart(large.select("node", "cid"), labels, sets, join), "links")
    if not more.isEmpty():
        edges = edges.unionByName(more)
        labels = components(edges)

    by_class = classes.select("cid", "digest", F.struct("ord", "tie").alias("first")).join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = by_class.groupBy("root").agg(F.min("first").alias("least"))
    known = written(by_class.join(roots, "root").select("digest", F.col("least").alias("root")), "roots")
    return rows.join(known, "digest", "left").select("ord", "tie", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", F.struct("ord", "tie")).alias("root"))


def component_report(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs; a null doc_id comes before all others."""
    found = near_duplicates(docs, join)
    doc_id, component = doc_id_of(), doc_id_of("root.ord", "root.tie")
    return found.select(doc_id.alias("doc_id"), "n_shingles", component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"))


def one_of_each_group(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """The rows of docs that come first in their group of linked documents, with all their columns, each once; rows without words all stay."""
    names = docs.columns
    found = near_duplicates(docs, join).filter(F.struct("ord", "tie") == F.col("root"))
    first = found.groupBy("ord", "tie").agg(F.max(F.col("n_shingles") > 0).alias("__set")).withColumnsRenamed({"ord": "__ord", "tie": "__tie"})
    ord_, tie = order_of()
    marked = docs.select("*", ord_.alias("__ord"), tie.alias("__tie"))
    copy = F.row_number().over(Window.partitionBy("__ord", "__tie").orderBy("__ord", "__tie"))
    return marked.join(first, ["__ord", "__tie"]).withColumn("__copy", copy).filter((F.col("__copy") == 1) | ~F.col("__set")).select(*names)
