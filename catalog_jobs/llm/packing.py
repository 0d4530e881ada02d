"""Best-fit packing: a configuration linear program over the length histogram decides which lengths share a sequence.

Texts become token ids in Arrow batches, by words: a worker tokenizes each distinct word once, and keeps what it made, up to a bound, for
its next batches and tasks. The histogram of piece
lengths (at most `capacity` numbers) is all that the driver sees; multiplicative weights with a knapsack
dynamic program solve the program, its rounding gives runs of equal sequences, and every piece finds its place from its
rank among pieces of its length.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written

#: Pieces of one length that are ranked together, about; a length that more pieces have is ranked in parts.
RANKED = 50_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What may follow a word's letters in a chunk and is one more word; neither an apostrophe nor a <, which begin words of their own rules.
_TAIL = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
#: Bytes of text for which one batch is tokenized at once.
BATCH_BYTES = 6_000_000
#: Distinct words, of some 30 bytes with their ids, that a worker keeps.
KEPT_WORDS = 1_000_000


class WordTokenizer:
    """Token ids of whole texts, equal to those of the tokenizer for each text, but made once for each distinct word.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its chunks between
    ASCII blanks, one after another; and it reads a chunk of plain letters with a tail of ASCII signs as two words, the
    letters in lower case. Such words are tokenized many at once; where one ends follows from the tokens that end
    a word. All other chunks are tokenized each on their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known = pa.array([""])  # words so far; the first has no ids
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.array([i for e in ids for i in e], np.uint32), np.array([len(e) for e in ids], np.int64)

    def _many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) for words that end with an end token."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 50_000):
            some = words.slice(at, 50_000).to_pylist()
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            bounds = np.flatnonzero(self.ends[got]) + 1
            n = np.diff(bounds, prepend=0)
            if len(bounds) != len(some) or bounds[-1] != len(got):
                got, n = self._each(some)
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each word, ids, sizes): words that aren't known are made, and kept while there is room."""
        at = pc.index_in(words, value_set=self.known)
        lacking = pc.is_null(at).to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(lacking)).unique()
        got, n = self._many(new)
        known, ids, sizes = pa.concat_arrays([self.known, new]), np.concatenate([self.ids, got]), np.concatenate([self.sizes, n])
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[lacking] = len(self.known) + pc.index_in(words.filter(pa.array(lacking)), value_set=new).to_numpy()
        if len(self.known) < KEPT_WORDS:
            self.known, self.ids, self.sizes = known, ids, sizes
        return place, ids, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last ones end); texts has no nulls."""
        chunks = pc.ascii_split_whitespace(texts)
        coded = pc.list_flatten(chunks).dictionary_encode()
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, f"^[{_LETTERS}]+[{_TAIL}]*$")
        other = distinct.filter(pc.invert(plain))
        is_plain, distinct = plain.to_numpy(zero_copy_only=False), distinct.filter(plain)
        letters = pc.utf8_lower(pc.replace_substring_regex(distinct, f"[{_TAIL}]+$", ""))
        tails = pc.replace_substring_regex(distinct, f"^[{_LETTERS}]+", "")
        place, ids, sizes = self._words(pa.concat_arrays([letters, tails]))
        more, n = self._each(other.to_pylist())
        begin = np.concatenate([np.cumsum(sizes) - sizes, len(ids) + np.cumsum(n) - n])
        ids, sizes = np.concatenate([ids, more]), np.concatenate([sizes, n])
        # two parts for each chunk: letters and tail, or the whole chunk and nothing
        parts = np.zeros((len(is_plain), 2), np.int64)
        parts[is_plain] = place.reshape(2, -1).T
        parts[~is_plain, 0] = len(sizes) - len(n) + np.arange(len(n))
        chunk_ids, ends = _gather(ids, begin[parts.ravel()], sizes[parts.ravel()])
        chunk_size = sizes[parts].sum(axis=1)
        chunk_begin = np.cumsum(chunk_size) - chunk_size
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, ends = _gather(chunk_ids, chunk_begin[index], chunk_size[index])
        return flat, np.concatenate([[0], ends])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]


def _gather(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[begin[i] : begin[i] + n[i]] one after another, where each ends)."""
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + n, n)], ends


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker, which outlives its tasks."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every piece of every document: its ids, then end_id, cut where longer than capacity.

    Null and empty texts are the end id alone. Only the last piece of a document may be shorter than capacity. Repeated rows give repeated
    pieces; a very long text is tokenized whole by one task.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = np.cumsum(pc.binary_length(batch.column(1).slice(at)).to_numpy(zero_copy_only=False))
                take = max(1, int(np.searchsorted(sizes, BATCH_BYTES)))
                part = batch.slice(at, take)
                at += take
                texts = pa.concat_arrays([part.column(1)])
                ids, bounds = tokenizer.encode(texts)
                rows = []
                for i in range(part.num_rows):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(i, p, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity].tobytes())) for p, s in enumerate(range(0, len(own), capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    [key, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(cut, f"`{key}` {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c], and the length chosen last, for sequences of at most c tokens; values[l - 1] is what a piece of length l is worth."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(values > 0) + 1
    worth = values[lengths - 1]
    for c in range(1, capacity + 1):
        k = np.searchsorted(lengths, c, "right")
        if k:
            total = worth[:k] + best[c - lengths[:k]]
            j = int(total.argmax())
            best[c], last[c] = total[j], lengths[j]
    return best, last


def solve_configurations(histogram: np.ndarray, capacity: int, rounds: int = 40, step: float = 0.125, rate: float = 3.0) -> dict[tuple[int, ...], float]:
    """Multiplicative weights for: cover every length's count by the fewest sequences, each a configuration of lengths.

    A length's price is its share of the capacity times exp(-rate * how far it is covered). Each round prices all
    configurations in one knapsack table and raises the best one that starts with each length, best first, as far as no
    length's cover grows by more than `step` in the round. histogram[l - 1]: pieces of length l. Returns a
    weight for each configuration (lengths, longest first).
    """
    have = np.flatnonzero(histogram) + 1
    covered = np.zeros(capacity)
    x: Counter = Counter()
    for _ in range(rounds):
        prices = np.zeros(capacity)
        prices[have - 1] = have / capacity * np.exp(-rate * covered[have - 1])
        prices[covered >= 1 - 1e-9] = 0
        if not prices.any():
            break
        best, last = _knapsack(prices, capacity)
        first = np.flatnonzero(prices) + 1
        allowed = np.minimum(step, 1 - covered) * histogram
        for length in first[np.argsort(-(prices[first - 1] + best[capacity - first]), kind="stable")].tolist():
            config, room = [length], capacity - length
            while room > 0 and last[room]:
                config.append(int(last[room]))
                room -= config[-1]
            counts = Counter(config)
            by = min(allowed[k - 1] / n for k, n in counts.items())
            if by > 0:
                x[tuple(sorted(config, reverse=True))] += by
                for k, n in counts.items():
                    allowed[k - 1] -= by * n
                    covered[k - 1] += by * n / histogram[k - 1]
    return x


def round_configurations(x: dict[tuple[int, ...], float], histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), covering the histogram exactly.

    Fullest configurations first, each as often as its rounded weight and what is left allow; the rest is placed by
    best fit, longest first, into sequences that are counted by their content, so that the work depends on distinct lengths, not on pieces.
    """
    left = histogram.astype(np.int64).copy()
    made: Counter = Counter()
    for config in sorted(x, key=lambda c: (-sum(c), c)):
        counts = Counter(config)
        n = min(int(x[config] + 0.5), *(int(left[k - 1]) // m for k, m in counts.items()))
        if n > 0:
            made[config] += n
            for k, m in counts.items():
                left[k - 1] -= n * m
    # sequences with room, by room: content -> number
    rooms: dict[int, Counter] = {}
    for config, n in made.items():
        if sum(config) < capacity:
            rooms.setdefault(capacity - sum(config), Counter())[config] += n
    made = Counter({c: n for c, n in made.items() if sum(c) == capacity})
    for length in (np.flatnonzero(left) + 1)[::-1].tolist():
        n = int(left[length - 1])
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                config, have, room, fit = (), n, capacity, capacity // length
            else:
                config, have = next(iter(rooms[room].items()))
                fit = room // length
            fit = min(fit, n)
            take = min(have, n // fit)
            if config:
                rooms[room][config] -= take
                if not rooms[room][config]:
                    del rooms[room][config]
                    if not rooms[room]:
                        del rooms[room]
            n -= take * fit
            config, room = (*config, *[length] * fit), room - length * fit
            if room:
                rooms.setdefault(room, Counter())[config] += take
            else:
                made[config] += take
    for full in rooms.values():
        made.update(full)
    return sorted(made.items(), key=lambda c: (-sum(c[0]), c[0]))


def _runs(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: (length, first rank) -> first sequence, pieces of that length in a sequence, first offset."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for config, n in made:
        offset = 0
        for length, m in sorted(Counter(config).items(), reverse=True):
            rows.append((length, used[length], sequence, m, offset))
            used[length] += n * m
            offset += length * m
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return {"code": (cols[0] << 44) + cols[1], "rank": cols[1], "sequence": cols[2], "per": cols[3], "offset": cols[4]}


def in_parts(pieces: DataFrame, parts: np.ndarray) -> DataFrame:
    """pieces with salt, the part of its length that a piece belongs to: parts[l] parts for length l."""
    common = [(length, int(parts[length])) for length in np.flatnonzero(parts > 1).tolist()]  # capacity rows at most
    joined = pieces.join(F.broadcast(pieces.sparkSession.createDataFrame(common, "length long, parts long")), "length", "left")
    return joined.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("place"), "parts"), F.lit(0)).cast("int")).drop("parts")


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces of token_pieces() with sequence_id and offset: sequences of at most capacity tokens, gapless from offset 0.

    `pieces` has one more column, place: numbers that differ from row to row, so that any group of rows can be ranked in parts. It is read
    three times: give a written table, which fixes them. Pieces of equal length change places freely. A length is ranked in as many
    parts as its count asks for, so that no task ranks much more than RANKED pieces; the driver sees a count for each length and
    part. An empty table gives an empty one.
    """
    histogram = np.zeros(capacity, np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        histogram[r["length"] - 1] = r["count"]
    parts = np.append(0, -(-histogram // RANKED))
    base = np.cumsum(parts) - parts  # where a length's parts begin
    salted = in_parts(pieces, parts)
    counts = np.zeros(int(parts.sum()), np.int64)
    for r in salted.groupBy("length", "salt").count().collect():
        counts[base[r["length"]] + r["salt"]] = r["count"]
    total = np.cumsum(counts) - counts
    before = total - np.repeat(total[base[parts > 0]], parts[parts > 0])
    made = round_configurations(solve_configurations(histogram, capacity), histogram, capacity)
    runs = _runs(made, capacity)
    names = [c for c in pieces.columns if c != "place"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = before[base[length] + salt] + rank - 1
            at = np.searchsorted(runs["code"], (length.astype(np.int64) << 44) + rank, "right") - 1
            n = rank - runs["rank"][at]
            sequence = runs["sequence"][at] + n // runs["per"][at]
            offset = runs["offset"][at] + n % runs["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("place")).cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "place")
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): tokenizes and packs docs; the texts are read once.

    A null or empty text is one token, its end; a text of over capacity tokens is cut, and is tokenized whole by one task; repeated rows, and
    rows with a null key, are packed each on their own; an empty table gives an empty one. Other columns aren't returned.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, key=key).withColumn("place", F.monotonically_increasing_id())
    return pack(written(pieces, "pieces"), capacity)
