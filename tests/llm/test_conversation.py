import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from catalog_jobs.llm import conversation, queries
from tests.llm.data import clashing, rows

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
BLANK = " \t\n\x0b\x0c\r"


def damage(table):
    out = []
    for conv, turn, role, text in table:
        space = lambda v: " " if v is None else v
        role, text, fault = space(role), space(text), zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(faults, initials):
    """(cost, audit, roles) by value iteration over all edits: exact, for any costs; the label that is ASCII-least first."""
    n, inf = len(faults), (1 << 40, "", ())
    best = [[inf] * 4 for _ in range(n + 1)]
    best[n][0] = best[n][3] = (0, "", ())
    for i in range(n, -1, -1):
        for _ in range(4):
            for s in range(4):
                found = [best[i][s]] if i == n else []
                wanted = 3 if s == 2 else 2
                found.append(tuple(map(lambda a, b: a + b, (3, "I", ("ua"[wanted - 2],)), best[i][wanted])))
                if i < n:
                    stays = 3 if faults[i] == "truncated" else 0
                    found.append(tuple(map(lambda a, b: a + b, (4, "D", ("-",)), best[i + 1][s])))
                    if faults[i] not in ("blank", "duplicate"):
                        found.append(tuple(map(lambda a, b: a + b, (3 + stays, "R", ("ua"[wanted - 2],)), best[i + 1][wanted])))
                        to = {"s": 1, "u": 2, "a": 3}.get(initials[i])
                        if to == wanted or (to == 1 and s == 0):
                            found.append(tuple(map(lambda a, b: a + b, (stays, "K", ("k",)), best[i + 1][to])))
                found = [f for f in found if f[0] < inf[0]]
                best[i][s] = min(found, key=lambda f: f[:2]) if found else inf
    return best[0][0]


def brute(table, spoil=damage):
    out = []
    left = spoil(table)
    for conv in {r[0] for r in table}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            shown = text.rstrip(BLANK)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, roles = cheapest(faults, initials)
        lines, it = [], iter(own)
        for edit, new in zip(audit, roles, strict=True):
            row = None if edit == "I" else next(it)
            if edit != "D":
                lines.append(f"{row[2] if edit == 'K' else {'u': 'user', 'a': 'assistant'}[new]}:{'' if row is None else row[3]}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed, n_convs=60, longest=9):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "User"]
    texts = ["Hello there.", "What?", "no end", "", " \n", None, "Same text.", "Ok! ", "é…", "x:y\nz."]
    made = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n_convs) for t in range(rng.randint(1, longest))]
    made += [(None, t, "user", "Null conversation.") for t in range(5)] + [(900, None, "assistant", "No turn."), (900, None, None, None), (901, None, "user", "Only null."), (902, 7, "user", "Far."), (902, 900, "assistant", "Gap.")]
    rng.shuffle(made)
    return made


def test_repairs_equal_brute_force(spark, tmp_path):
    made = table(1)
    clashing(spark.createDataFrame(made, SCHEMA)).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows(queries.op13_conversation_repair(spark, str(tmp_path)), *NAMES)
    assert got == brute(made)


@pytest.mark.parametrize("seed", range(4))
def test_conversations_across_key_ranges(spark, monkeypatch, seed):
    """Long conversations, one of them most of the rows, cut into lattices of five rows and many key ranges."""
    monkeypatch.setattr(conversation, "ROWS", 5)
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool"], [f"Text {i}." for i in range(400)] + ["cut", "", "Same."]
    sizes = {1: 3, 2: 170, 3: 1, 4: 90, 5: 2, None: 40}
    made = [(c, t, rng.choice(roles if rng.random() < 0.5 else roles[1:3]), rng.choice(texts)) for c, n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(made, SCHEMA)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    seen = []
    ends = conversation.open_ends
    monkeypatch.setattr(conversation, "open_ends", lambda codes: seen.append(ends(codes)) or seen[-1])
    try:
        edits = conversation.repair_rows(df)
        got = rows(conversation.repair_report(edits, df), *NAMES)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(made, lambda t: t)
    assert len(seen[0]) >= 5  # pieces that the key ranges cut


@pytest.mark.parametrize("seed", range(40))
def test_lattices_equal_brute_force(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 70) if seed % 4 == 0 else rng.randint(1, 8)
    faults = [rng.choice([None, None, "blank", "truncated", "duplicate"]) for _ in range(n)]
    initials = [rng.choice("suuaax") for _ in range(n)]
    codes = bytes("sua".find(i) % 4 | (conversation.IS_TRUNCATED if f == "truncated" else conversation.MUST_GO if f else 0) for f, i in zip(faults, initials, strict=True))
    edits, new, state = conversation.repaired(codes)
    cost, audit, roles = cheapest(faults, initials)
    assert ("".join(edits), tuple("".join(new))) == (audit, roles) and state in (conversation.BEGIN, conversation.ASSISTANT)
    assert conversation.costs_before(codes, conversation.END, True)[0][0] == cost


def test_prices_stay_dual_feasible():
    """No arc costs less than its ends' prices differ, and those of the cheapest paths cost just that."""
    rng = random.Random(9)
    lattice = conversation.Lattice(bytes(rng.choice([0, 1, 2, 3, 5, 9]) for _ in range(30)), conversation.END, True)
    cost = lattice.auction(0)
    assert all(lattice.price[i] <= c + lattice.price[j] for i, arcs in enumerate(lattice.arcs) for _, c, j in arcs)
    edits, _, _ = lattice.trace(0)
    assert cost == lattice.price[0] and "".join(edits)


def test_a_long_conversation_takes_time_in_proportion():
    """Lattices are solved one after another: no price is counted up through the cost of the whole conversation."""
    codes = bytes([1] * 20_000)
    edits, _, state = conversation.repaired(codes)
    assert len(edits) == 20_000 and state == conversation.ASSISTANT


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation.repair_report(conversation.repair_rows(conversation.damaged(df)), df).count() == 0


def test_repaired_rows_alternate(spark):
    df = spark.createDataFrame(table(5), SCHEMA)
    kept = conversation.repair_rows(df).filter("edit <> 'D'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seq", "role"))), lambda r: F.substring(r["role"], 1, 1)), "").alias("s"))
    assert kept.filter("not s rlike '^(s?(ua)+)?$'").count() == 0
