"""Fill-in-middle documents: prefix, middle and suffix cut at unit boundaries that a Fenwick tree over blocks of the text finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block of text.
BLOCK = 4096
#: Blocks that are counted at a time, so that masks stay small for very long texts.
STRETCH = 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def marks(data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit starts, code point starts) of UTF-8 bytes start to stop: a unit is a run of ASCII letters or any other code point."""
    part = data[start:stop]
    letter = ((part | 0x20) - np.uint8(97)) < 26
    follows = np.empty_like(letter)
    follows[1:] = letter[:-1]
    follows[0] = start > 0 and 97 <= data[start - 1] | 0x20 <= 122 and data[start - 1] < 128
    point = (part & 0xC0) != 0x80
    return point & ~(letter & follows), point


class BlockTree:
    """Fenwick trees of the units and code points that start in each block of a text."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(text, np.uint8), block
        self.size = -(-len(text) // block)
        counts = np.zeros((2, self.size + 1), np.int64)
        for first in range(0, self.size, STRETCH):
            start, stop = first * block, min(len(text), (first + STRETCH) * block)
            edges = np.arange(0, stop - start, block)
            for k, mask in enumerate(marks(self.data, start, stop)):
                counts[k, first + 1 : first + 1 + len(edges)] = np.add.reduceat(mask, edges, dtype=np.int64)
        sums = counts.cumsum(axis=1)
        node = np.arange(self.size + 1)
        self.tree = (sums - sums[:, node - (node & -node)]).tolist()  # node i sums the blocks i - lowbit(i) + 1 to i
        self.units, self.points = sums[:, -1].tolist()

    def cut(self, n: int) -> tuple[int, int]:
        """(bytes, code points) of the first n units."""
        if n >= self.units:
            return len(self.data), self.points
        units, points = self.tree
        at, left, before, step = 0, n, 0, 1 << max(self.size.bit_length() - 1, 0)
        while step:  # the most whole blocks that hold n units at most
            if at + step <= self.size and units[at + step] <= left:
                at += step
                left -= units[at]
                before += points[at]
            step >>= 1
        start = at * self.block
        unit, point = marks(self.data, start, min(len(self.data), start + self.block))
        offset = int(np.flatnonzero(unit)[left])
        return start + offset, before + int(np.count_nonzero(point[:offset]))


def transform(text: bytes, draw: str, fim_percent: int = 90, spm_percent: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix and of middle, output). draw: 32 hexadecimal digits, four numbers that choose the two cuts and the form."""
    tree = BlockTree(text)
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(x.encode() in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= fim_percent:
        return tree.units, "plain", None, None, text
    (a, a_points), (b, b_points) = (tree.cut(k) for k in sorted((h1 % (tree.units + 1), h2 % (tree.units + 1))))
    prefix, middle, suffix = PREFIX.encode() + text[:a], text[a:b], SUFFIX.encode() + text[b:]
    spm = h4 % 100 < spm_percent
    output = b"".join((suffix, prefix, MIDDLE.encode(), middle) if spm else (prefix, suffix, MIDDLE.encode(), middle))
    return tree.units, "spm" if spm else "psm", a_points, b_points - a_points, output


def draws(key: Column, seed: int = 1) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of `<seed>:<key>`; a null key is written as nothing."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 32)


NEW = T.StructType().add("n_units", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


def fim_documents(docs: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs with n_units, form (plain, psm, spm), prefix_chars, middle_chars and output; columns of docs with these names are replaced.

    A null text counts as empty and, like one that holds a sentinel, stays plain; repeated rows are cut alike; an empty table gives an empty one. A text is one value of
    a row: a task holds one and its output at a time, besides the Arrow batch, and nothing is shuffled.
    """
    rest = [f for f in docs.schema if f.name not in NEW.names]
    names = [f.name for f in rest]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [transform(t.as_py() or b"", d.as_py(), fim_percent, spm_percent) for t, d in zip(b.column("__text"), b.column("__draw"), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            new[-1] = new[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *new], names=[*names, *NEW.names])

    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(text).cast("binary").alias("__text"), draws(F.col(key), seed).alias("__draw"))
    return rows.mapInArrow(cut, T.StructType([*rest, *NEW]))


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text that a transformed document was made from, by its form and output alone."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.split(F.substring(output, F.lit(len(first) + 1), F.length(output)), second, 2)
        tail = F.split(F.get(head, 1), MIDDLE, 2)
        return F.get(head, 0), F.get(tail, 0), F.get(tail, 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    spm_suffix, spm_prefix, spm_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output)
