"""Repair of conversations: cheapest edits to alternating roles, by the auction algorithm for shortest paths over a lattice of rows and states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_jobs.llm.common import written

#: States between rows: nothing yet, after a system row, after a user row, after an assistant row. Only BEGIN and ASSISTANT may end a conversation.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INF = 1 << 60
END = (0, INF, INF, 0)
#: Rows of one lattice: longer conversations are solved lattice by lattice, from the last to the first.
ROWS = 64
#: A row's code: class of its role's initial (s, u, a, other), then flags.
OTHER, IS_TRUNCATED, MUST_GO = 3, 4, 8
_NAMES = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its ends of sentences, 3 repeats it, 4 makes its role user. Nulls of role and text are one space, as they are in the hashed text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    rows = rows.filter("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


class Lattice:
    """Rows `codes` between states: arcs for the edits, and one from each state after the last row to the goal, at the cost `after` of all that follows.

    Prices start at what rows cost in any case, and rise by the auction algorithm: a path from the entry is extended along an arc whose cost is
    the difference of its ends' prices, or else its last node's price rises to the least possible one and the path contracts. States that can't reach the goal have no arcs.
    """

    def __init__(self, codes: bytes, after: tuple[int, ...], last: bool):
        n = self.n = len(codes)
        self.goal = 4 * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(self.goal + 1)]
        self.price = [0] * (self.goal + 1)
        alive = [False] * self.goal + [True]
        must = 0
        for i in range(n, -1, -1):
            at = 4 * i
            if i == n:
                for s in range(4):
                    if after[s] < INF:
                        self.arcs[at + s].append(("", after[s], self.goal))
            else:
                code = codes[i]
                must += DELETE if code & MUST_GO else TRUNCATED if code & IS_TRUNCATED else 0
                for s in range(4):
                    self._row(at, s, code)
            if i < n or last:
                for s in range(4):
                    self.arcs[at + s].append(("I", INSERT, at + (ASSISTANT if s == USER else USER)))
            for _ in range(3):  # inserted rows lead to states of the same place
                for s in range(4):
                    alive[at + s] = any(alive[j] for *_, j in self.arcs[at + s])
            for s in range(4):
                self.price[at + s] = must
        self.arcs = [[a for a in arcs if alive[a[2]]] for arcs in self.arcs]

    def _row(self, at: int, s: int, code: int) -> None:
        arcs, cls = self.arcs[at + s], code & 3
        arcs.append(("D", DELETE, at + 4 + s))
        if code & MUST_GO:
            return
        stays = TRUNCATED if code & IS_TRUNCATED else 0
        wanted = ASSISTANT if s == USER else USER
        if cls + 1 == wanted or (cls == 0 and s == BEGIN):
            arcs.append(("K", stays, at + 4 + cls + 1))
        arcs.append(("R", REROLE + stays, at + 4 + wanted))

    def auction(self, entry: int) -> int:
        """The cost of the cheapest path from a state before the first row; prices are then exact for all of its cheapest paths."""
        if not self.arcs[entry]:
            return INF
        price, path = self.price, [entry]
        while path[-1] != self.goal:
            node = path[-1]
            least, to = min((cost + price[j], j) for _, cost, j in self.arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[entry]

    def trace(self, entry: int) -> tuple[list[str], list[str], int]:
        """(edits by row, roles they give, state after) along tight arcs that lead to the goal, the ASCII-least edit each time; call auction(entry) first.

        Rows inserted before a row are part of its edits, and those after the last row of the last one's.
        """
        leads = [False] * self.goal + [True]
        for at in range(4 * self.n, -1, -4):
            for _ in range(3):
                for s in range(at, at + 4):
                    leads[s] = any(leads[j] and self.price[s] == cost + self.price[j] for _, cost, j in self.arcs[s])
        edits, roles, node = [""] * self.n, [""] * self.n, entry
        while True:
            label, cost, to = min(a for a in self.arcs[node] if leads[a[2]] and self.price[node] == a[1] + self.price[a[2]])
            if to == self.goal:
                return edits, roles, node % 4
            row = min(node // 4, self.n - 1)
            edits[row] += label
            roles[row] += "-" if label == "D" else "k" if label == "K" else "ua"[to % 4 - USER]
            node = to


def _eased(after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """(least, after less it): prices then rise by differences only, however long the conversation goes on."""
    least = min(after)
    return least, tuple(c - least if c < INF else INF for c in after)


@lru_cache(8192)
def distances(codes: bytes, after: tuple[int, ...], last: bool) -> tuple[int, ...]:
    """Costs of the cheapest edits of these rows and of what follows, by the state before them."""
    lattice = Lattice(codes, after, last)
    return tuple(lattice.auction(s) for s in range(4))


@lru_cache(8192)
def traced(codes: bytes, after: tuple[int, ...], last: bool, entry: int) -> tuple[list[str], list[str], int]:
    lattice = Lattice(codes, after, last)
    lattice.auction(entry)
    return lattice.trace(entry)


def costs_before(codes: bytes, after: tuple[int, ...], last: bool) -> list[tuple[int, ...]]:
    """For each lattice of these rows, the costs of all that follows it, by state; the first entry is for the state before the first row."""
    found = [after]
    for start in range((len(codes) - 1) // ROWS * ROWS, -1, -ROWS):
        least, eased = _eased(found[-1])
        costs = distances(codes[start : start + ROWS], eased, last and start + ROWS >= len(codes))
        found.append(tuple(c + least if c < INF else INF for c in costs))
    return found[::-1]


def repaired(codes: bytes, after: tuple[int, ...] = END, last: bool = True, entry: int = BEGIN) -> tuple[list[str], list[str], int]:
    """(edits by row, roles they give, state after) of the cheapest edits, the ASCII-least of equal cost."""
    costs, edits, roles = costs_before(codes, after, last) if len(codes) > ROWS else [END, after], [], []
    for k, start in enumerate(range(0, len(codes), ROWS)):
        e, r, entry = traced(codes[start : start + ROWS], _eased(costs[k + 1])[1], last and start + ROWS >= len(codes), entry)
        edits += e
        roles += r
    return edits, roles, entry


class Run(NamedTuple):
    """The rows of one conversation in one key range; first and last: whether the range begins or ends with it."""

    part: int
    conv: object
    pos: list[int]
    codes: bytes
    first: bool
    last: bool


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of (part, pos, conv_id, code) rows that are sorted by part and pos; one run is held at a time."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
    held, part = None, None
    for (p, conv), own in groupby(rows, key=lambda r: (r[0], r[2])):
        pos, codes = zip(*((r[1], r[3]) for r in own), strict=True)
        if held is not None:
            yield held._replace(last=p != held.part)
        held, part = Run(p, conv, list(pos), bytes(codes), p != part, False), p
    if held is not None:
        yield held._replace(last=True)


def by_part(codes: DataFrame) -> DataFrame:
    return codes.select("part", "pos", "conv_id", "code").repartition("part").sortWithinPartitions("part", "pos")


def open_ends(codes: DataFrame) -> dict[tuple[int, bool], tuple[tuple[int, ...], bool, int, int]]:
    """For runs of conversations that go on in the next key range, by (part, whether it is the first run of it): costs after it, whether it is the last piece, the state before it and the class of the row before.

    Two runs a key range at most meet its ends, and come to the driver as four times four costs and four states each.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            if run.first or run.last:
                # by the state that the run must end in: the costs for each state before it; a last piece may have rows inserted after it
                ends = [tuple(0 if s == e else INF for s in range(4)) for e in range(4)]
                costs = [costs_before(run.codes, after, False)[0] for after in ends] + [costs_before(run.codes, END, True)[0]]
                row = [run.part, run.first, run.last, run.codes[0] & 3, run.codes[-1] & 3, [c for x in costs for c in x]]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:3]] + [pa.array([v], pa.int32()) for v in row[3:5]] + [pa.array([row[5]], pa.list_(pa.int64()))], names=["part", "first", "last", "head", "tail", "costs"])

    heads = codes.groupBy("part").agg(F.min_by("conv_id", "pos").alias("head_conv"), F.max_by("conv_id", "pos").alias("tail_conv"))
    found = {r["part"]: r for r in heads.collect()}  # a row for each key range
    order = sorted(found)
    joined = {a for a, b in zip(order, order[1:], strict=False) if found[a]["tail_conv"] == found[b]["head_conv"]}
    if not joined:
        return {}
    after = dict(zip(order, order[1:], strict=False))
    touched = by_part(codes.filter(F.col("part").isin(sorted(joined | {after[p] for p in joined}))))
    pieces = {(r["part"], r["first"]): r for r in touched.mapInArrow(summed, "part long, first boolean, last boolean, head int, tail int, costs array<long>").collect()}

    def last_of(p):
        return pieces.get((p, False)) or pieces[p, True]

    chains: list[list[tuple[int, bool]]] = []
    for p in order:
        if p in joined:
            here = last_of(p)
            key = (here["part"], here["first"])
            if not chains or chains[-1][-1] != key:
                chains.append([key])
            chains[-1].append((after[p], True))
    ends: dict = {}
    for chain in chains:
        costs, last = END, True
        for key in reversed(chain):
            ends[key] = (costs, last)
            table = pieces[key]["costs"]
            costs = tuple(table[16:]) if last else tuple(min(min(table[4 * e + s] + costs[e], INF) for e in range(4)) for s in range(4))
            last = False

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            if (run.first or run.last) and (run.part, run.first) in ends:
                costs, last = ends[run.part, run.first]
                reach = costs_before(run.codes, costs, last)[0]
                state = [repaired(run.codes, costs, last, s)[2] if reach[s] < INF else -1 for s in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([run.part]), pa.array([run.first]), pa.array([state], pa.list_(pa.int32()))], names=["part", "first", "state"])

    leads = {(r["part"], r["first"]): r["state"] for r in touched.mapInArrow(exits, "part long, first boolean, state array<int>").collect()}
    out = {}
    for chain in chains:
        state, before = BEGIN, -1
        for key in chain:
            out[key] = (*ends[key], state, before)
            state, before = leads[key][state], pieces[key]["tail"]
    return out


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, part), a table in the order of conversation and turn, nulls first; equal turns by role and text.

    Key ranges split a conversation of any size, and equal rows too, by their place in the input.
    """
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "tie")]
    some = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    placed = some.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumns({"pos": F.monotonically_increasing_id(), "part": F.spark_partition_id().cast("long")})
    return written(placed, "rows")


def coded_rows(rows: DataFrame) -> DataFrame:
    """(part, pos, conv_id, code, fault), a table: a row's first fault is blank, duplicate (its role and text occur earlier) or truncated.

    Equal rows are grouped by their hash within a conversation, with partial minima; the first of each is joined back by its place, so that no common row gathers.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = rows.groupBy("conv_id", same.alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    flags = rows.select("part", "pos", "conv_id", F.instr(F.lit("sua"), F.substring("role", 1, 1)).alias("at"), F.length("role").alias("n"), (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("open"))
    found = flags.join(firsts, "pos", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("open"), "truncated")
    cls = F.when((F.col("at") > 0) & (F.col("n") > 0), F.col("at") - 1).otherwise(OTHER)
    code = cls + F.when(F.col("fault") == "truncated", IS_TRUNCATED).when(F.col("fault").isNotNull(), MUST_GO).otherwise(0)
    return written(found.withColumn("fault", fault).select("part", "pos", "conv_id", code.cast("int").alias("code"), "fault"), "codes")


def repair_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, seq, edit, role, text, fault, row_cost, illegal): the edits of every conversation, in order of pos and seq.

    conversations: (conv_id, turn, role, text). Kept, reroled and inserted rows have a role and a text, deleted ones (edit D) have none. fault, row_cost and illegal (the row before doesn't lead to
    this one) stand at a row's own edit, and are null at inserted rows; a row's cost holds its inserted ones'. Null conv_ids are one conversation; an empty table has no edits.
    """
    rows = ordered_rows(conversations)
    codes = coded_rows(rows)
    ends = open_ends(codes)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            after, last, entry, before = ends.get((run.part, run.first), (END, True, BEGIN, -1)) if run.first or run.last else (END, True, BEGIN, -1)
            edits, roles, _ = repaired(run.codes, after, last, entry)
            classes = [before, *(c & 3 for c in run.codes)]
            illegal = [int(a >= 0 and (a, b) not in ((0, 1), (1, 2), (2, 1))) for a, b in zip(classes, classes[1:], strict=False)]
            costs = [INSERT * e.count("I") + (DELETE if "D" in e else REROLE * e.count("R") + (TRUNCATED if c & IS_TRUNCATED else 0)) for e, c in zip(edits, run.codes, strict=True)]
            for i in range(0, len(edits), 10_000):
                some = slice(i, i + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(run.pos[some], pa.int64()), pa.array(edits[some]), pa.array(roles[some]), pa.array(costs[some], pa.int64()), pa.array(illegal[some], pa.int64())], names=["pos", "edits", "roles", "row_cost", "illegal"])

    solved = by_part(codes).mapInArrow(solve, "pos long, edits string, roles string, row_cost long, illegal long")
    full = rows.join(codes.select("pos", "fault"), "pos").join(solved, "pos")
    each = F.posexplode(F.arrays_zip(F.split("edits", "").alias("edit"), F.split("roles", "").alias("new"))).alias("seq", "e")
    out = full.select("conv_id", "turn", "pos", "role", "text", "fault", "row_cost", "illegal", each).filter("e.edit <> ''")
    own = F.col("e.edit") != "I"
    role = F.when(F.col("e.new") == "k", F.col("role")).when(F.col("e.new") == "u", _NAMES["u"]).when(F.col("e.new") == "a", _NAMES["a"])
    text = F.when(~own, "").when(F.col("e.edit") != "D", F.col("text"))
    return out.select("conv_id", "turn", "pos", "seq", F.col("e.edit").alias("edit"), role.alias("role"), text.alias("text"), *(F.when(own, F.col(c)).alias(c) for c in ("fault", "row_cost", "illegal")))


REPORT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]


def repair_report(edits: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: counts of gaps and faults, cost, the edits' initials and a digest of the repaired rows.

    A conversation's rows are streamed in order through its digest, which can't be taken in pieces: a task holds one row of it and its edits' initials, a byte each.
    Conversations without edits have zeros, an empty audit and the empty text's digest.
    """
    schema = T.StructType([T.StructField("conv_id", edits.schema["conv_id"].dataType)])
    for name, kind in REPORT:
        schema.add(name, kind)
    names = schema.names

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held = [], []

        def each() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for conv, own in groupby(each(), key=lambda r: r[0]):
            turns, low, high, seen, audit, digest, some = 0, None, None, None, bytearray(), hashlib.sha256(), False
            counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            illegal = cost = 0
            for _, turn, edit, role, text, fault, row_cost, wrong in own:
                audit += edit.encode()
                if edit != "D":
                    digest.update(("\n" * some + f"{role}:{text}").encode())
                    some = True
                if edit != "I":
                    illegal, cost = illegal + wrong, cost + row_cost
                    if fault:
                        counts[fault] += 1
                    if turn is not None and turn != seen:  # rows come by turn
                        turns, low, high, seen = turns + 1, turn if low is None else low, turn, turn
            held.append((conv, 0 if low is None else high - low + 1 - turns, *counts.values(), illegal, cost, audit.decode(), digest.hexdigest()))
            if len(held) == 5_000:
                yield made()
                held.clear()
        if held:
            yield made()

    streamed = edits.select("conv_id", "turn", "edit", "role", "text", "fault", "row_cost", "illegal", "pos", "seq").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos", "seq")
    found = streamed.select("conv_id", "turn", "edit", "role", "text", "fault", "row_cost", "illegal").mapInArrow(report, schema)
    every = conversations.select(F.col("conv_id").alias("asked")).distinct()
    joined = every.join(found, F.col("asked").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("asked", "conv_id")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in names[1:7]}
    return joined.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}).select(*names)
