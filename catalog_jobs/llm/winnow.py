"""Window fingerprints of token sequences in numpy: the least gram hash of every window, shared by equal windows anywhere.

Several documents lie one after another in one array; windows never cross a document's end. All hashes have 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: An odd number and its inverse modulo 2 ** 64: base of the polynomial hash.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs."""
    x = a * _A
    x ^= x >> np.uint64(32)
    x += b
    x *= _B
    x ^= x >> np.uint64(29)
    return x


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1); the longest made so far is kept, as batches are of bounded size."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def span_hashes(units: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """size -> hash of the `size` units from each place (shorter by size - 1): differences of one running polynomial."""
    n = len(units)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(units * _powers_of(_BASE, n), out=total[1:])
    back = _powers_of(_INVERSE, n)
    return {size: scramble((total[size:] - total[:-size]) * back[: n - size + 1]) if size <= n else np.zeros(0, np.uint64) for size in sizes}


def slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of values[i : i + width], for each i where that fits."""
    done = 1
    while done < width:
        by = min(done, width - done)
        values = best(values[:-by], values[by:]) if len(values) > by else values[:0]
        done += by
    return values


@dataclass
class Windows:
    """The windows of some documents: by start, doc and start in the doc; least gram hash of each."""

    start: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    least: np.ndarray


def windows(units: np.ndarray, bounds: np.ndarray, size: int, gram: int) -> tuple[Windows, np.ndarray]:
    """(all windows of `size` units, gram hashes). bounds[d] to bounds[d + 1] are the places of document d."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[doc] + place
    grams = span_hashes(units, [gram])[gram]
    return Windows(start, doc, place, slide(grams, size - gram + 1, np.minimum)[start]), grams


def anchors(w: Windows, grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the grams that are the least of some window (all of them where several are equal)."""
    most = np.zeros(len(grams), np.uint64)
    most[w.start] = w.least
    most = slide(np.concatenate([np.zeros(width - 1, np.uint64), most]), width, np.maximum)
    return np.flatnonzero((most == grams) & (most > 0))


def runs(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of each run of neighbouring windows of one document with one least gram."""
    return groups((w.doc, w.least))


def groups(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number of rows) of each run of neighbouring rows that are equal in all columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(new))


def tied(w: Windows, grams: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which runs hold their anchor at two places, so that a window may repeat inside the run."""
    places = anchors(w, grams, width)
    low = np.searchsorted(places, w.start[first])
    counts = np.searchsorted(places, w.start[first] + n - 1 + width) - low  # one at least: the run's own anchor
    at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    same = grams[places[at]] == np.repeat(w.least[first], counts)
    return np.add.reduceat(same, np.cumsum(counts) - counts, dtype=np.int64) > 1 if len(first) else np.zeros(0, bool)


def anchor_distance(w: Windows, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How far behind each window's start its anchor begins, the first of equal ones, where all windows of a document share their anchor."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    own = np.zeros(len(bounds) - 1, np.uint64)
    own[w.doc] = w.least
    places = np.flatnonzero(grams == np.repeat(own, np.diff(bounds))[: len(grams)])
    return places[np.searchsorted(places, w.start)] - w.start


def cover(starts: np.ndarray, n: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of `length` places lie in a window of `size` that starts in one of starts[i] to starts[i] + n[i] - 1."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n - 1 + size, -1)
    return np.cumsum(edge)[:length] > 0
