"""Sharding by histogram sort: exact bytes below probe keys are counted again and again, then rows move once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of the first probes and of each refinement, and of a whole key.
FIRST, STEP, WHOLE = 3, 2, 55


@dataclass
class Cell:
    """Rows whose key starts with `prefix`."""

    prefix: str
    n_rows: int
    n_bytes: int


def sort_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, k): k orders rows by a hash of the text, then by key, then by where the row lies, as 55 hexadecimal digits.

    Equal texts are neighbours in the order, and stay in one shard unless a boundary must cut their group. Rows with
    equal key and text differ in their last digits, so that a group of them, however large, can be cut: write the keys before use, which fixes
    those digits. A null text counts as empty, a null key as one more value; a very long text is read once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digits = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(t), F.xxhash64(F.lit(7), F.coalesce(F.col(key).cast("string"), F.lit(""))))]
    exact = F.lpad(F.hex(F.coalesce(F.col(key).cast("long"), F.lit(0))), 16, "0")
    place = F.substring(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"), 1, 7)
    return docs.select(key, (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.concat(*digits, exact, place).alias("k"))


def _histogram(keys: DataFrame, length: int) -> dict[str, Cell]:
    rows = keys.groupBy(F.substring("k", 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return {r["prefix"]: Cell(r["prefix"], r["n"], r["b"]) for r in rows}


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.002, cell_share: float = 1 / 256) -> list[Cell]:
    """Cells in key order such that each splitter of n_shards equal shares of the bytes is within tolerance of a cell's start.

    Each round counts rows and bytes below finer probes, inside the cells that straddle a splitter by more than tolerance
    times a shard's bytes, and inside those that hold over cell_share of all rows (they would make large tasks). A cell of
    rows with one key can't be cut. Counts reach the driver for at most n_shards + 1 / cell_share cells times 256 a round.
    """
    cells = _histogram(keys, FIRST)
    total, rows = sum(c.n_bytes for c in cells.values()), sum(c.n_rows for c in cells.values())
    length = FIRST
    while length < WHOLE:
        below, coarse = 0, []
        for c in sorted(cells.values(), key=lambda c: c.prefix):
            if len(c.prefix) == length and c.n_rows > 1:
                ends = (below, below + c.n_bytes)
                splitters = (i * total / n_shards for i in range(ends[0] * n_shards // total, ends[1] * n_shards // total + 1))
                far = any(min(s - ends[0], ends[1] - s) > tolerance * total / n_shards for s in splitters)
                if far or c.n_rows > max(1000, cell_share * rows):
                    coarse.append(c.prefix)
            below += c.n_bytes
        if not coarse:
            break
        finer = _histogram(keys.filter(F.substring("k", 1, length).isin(coarse)), length + STEP)
        cells = {p: c for p, c in cells.items() if p not in set(coarse)} | finer
        length += STEP
    return sorted(cells.values(), key=lambda c: c.prefix)


def deal(cells: list[Cell], n_shards: int) -> list[tuple[str, int, int]]:
    """(prefix, shard, slots before it in the shard) for each cell; a cell goes to the shard that holds its middle byte."""
    total = sum(c.n_bytes for c in cells) or 1
    below, slots, out = 0, [0] * n_shards, []
    for c in cells:
        shard = min(n_shards - 1, int((below + c.n_bytes / 2) * n_shards / total))
        out.append((c.prefix, shard, slots[shard]))
        slots[shard] += c.n_rows
        below += c.n_bytes
    return out


def shard_by_bytes(keys: DataFrame, n_shards: int, tolerance: float = 0.002) -> DataFrame:
    """keys of sort_keys() -> the same rows with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Sizes of shards are equal but for twice the tolerance and one row's size at each bound. An empty table gives an empty one.
    `keys` is read several times: give a written table. The rows are exchanged once, by cell, and numbered inside it; slots
    follow from the counts, so that no task holds a whole shard.
    """
    spark = keys.sparkSession
    dealt = deal(find_splitters(keys, n_shards, tolerance), n_shards)
    placed = keys.withColumn("cell", F.lit(None).cast("struct<prefix:string,shard:int,before:bigint>"))
    for length in sorted({len(p) for p, _, _ in dealt}):
        part = spark.createDataFrame([x for x in dealt if len(x[0]) == length], "prefix string, shard int, before bigint")
        part = F.broadcast(part.select(F.col("prefix").alias("at"), F.struct("prefix", "shard", "before").alias("found")))  # a few thousand cells at most
        placed = placed.join(part, F.substring("k", 1, length) == F.col("at"), "left").withColumn("cell", F.coalesce("cell", "found")).drop("at", "found")
    slot = F.col("cell.before") + F.row_number().over(Window.partitionBy("cell.prefix").orderBy("k")) - 1
    return placed.withColumn("slot", slot.cast("long")).withColumn("shard", F.col("cell.shard")).drop("cell")
