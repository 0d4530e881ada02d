"""Plain versions of the operators, for a few documents."""

import hashlib
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from itertools import pairwise

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def windows_removed(docs, split, size):
    """{(doc_id, text): (units, which are removed)} of distinct documents in order."""
    seen, out = set(), {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        units = split(t)
        gone = [False] * len(units)
        for i in range(len(units) - size + 1):
            k = tuple(units[i : i + size])
            if k in seen:
                gone[i : i + size] = [True] * size
            seen.add(k)
        out[d, t] = units, gone
    return out


def substring_report(docs):
    found = windows_removed(docs, words, 20)
    return sorted(((d, len(found[d, t][0]), sum(found[d, t][1]), sha(" ".join(w for w, g in zip(*found[d, t], strict=True) if not g))) for d, t in docs), key=repr)


def byte_report(docs):
    found = windows_removed(docs, lambda t: (t or "").encode(), 100)
    return sorted(((d, len(u), sum(g), sum(b and not a for a, b in pairwise([False, *g])), sha(bytes(x for x, y in zip(u, g, strict=True) if not y))) for d, t in docs for u, g in [found[d, t]]), key=repr)


def line_report(docs):
    seen, out = set(), {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        gone = [False] * len(lines)
        for i in range(len(lines) - 2):
            k = tuple(lines[i : i + 3])
            if not any(map(words, k)):
                continue
            if k in seen:
                gone[i : i + 3] = [True] * 3
            seen.add(k)
        out[d, t] = None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
    return out


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, percent=80):
    """{index of docs: least index linked to it}; docs in order."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(docs))], sets


def contamination(docs, items, window=13, share=20):
    wins = {}
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for d, t in docs:
        w, hit, got = alnum_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    got |= wins[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


KINDS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), 0, 1),
]


def secrets(docs):
    out = []
    for d, t in docs:
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(KINDS) for m in p.finditer(t or "") if m.end(g) - m.start(g) >= least)
        spans = [f"{KINDS[k][0]}:{a}:{b}" for a, k, b in found]
        base = [s for s, (_, k, _) in zip(spans, found, strict=True) if k < 3]
        out.append((d, *(sum(f[1] == k for f in found) for k in range(3)), sha(",".join(base)), ",".join(spans)))
    return sorted(out, key=repr)


def stats(docs):
    out = []
    for d, t in docs:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep)))
    return sorted(out, key=repr)


def features(text):
    """{feature: value} of a text, in the order in which ties are settled."""
    _, n, chars, symbols, dup, repeat = stats([(0, text)])[0]
    upper, digits = (len(re.findall(c, text or "")) for c in ("[A-Z]", "[0-9]"))
    return {"n_words": float(n), "word_length": chars / max(n, 1), "symbol_share": symbols / max(n, 1), "dup_lines": float(dup), "repeat_share": repeat / max(n, 1), "upper_share": upper / max(chars, 1), "digit_share": digits / max(chars, 1)}


def quantiles(values, n):
    """The values at which a share of i / n of all values is reached, and the least one."""
    values = sorted(float(Decimal(repr(v)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in values)
    return {next(v for k, v in enumerate(values, 1) if k * n // len(values) >= i) for i in range(1, n + 1)} | set(values[:1]) if values else set()


def decision_list(rows, n_bins=12, max_rules=6, max_tests=4, least=8, precision=0.9):
    """[[(feature, above, bound)]] learned from rows (features, bad, prune) by sequential covering."""
    names = list(rows[0][0]) if rows else []
    bounds = {f: sorted(quantiles([r[0][f] for r in rows], n_bins) | quantiles([r[0][f] for r in rows if r[1]], n_bins)) for f in names}

    def fits(x, rule):
        return all((x[f] > b) == above for f, above, b in rule)

    def counts(some):
        return sum(r[1] for r in some), sum(not r[1] for r in some)

    rules = []
    while len(rules) < max_rules:
        rule = []
        while len(rule) < max_tests:
            some = [r for r in rows if not r[2] and fits(r[0], rule)]
            p0, n0 = counts(some)
            if p0 < least or n0 == 0:
                break
            best, most = None, 1e-9
            for f in names:
                for b in bounds[f]:
                    for above in (False, True):
                        p, n = counts([r for r in some if (r[0][f] > b) == above])
                        if p >= least and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > most:
                            best, most = (f, above, b), gain
            if best is None:
                break
            rule.append(best)
        tried = [(rule[: i + 1], *counts([r for r in rows if r[2] and fits(r[0], rule[: i + 1])])) for i in range(len(rule))]
        if not tried:
            break
        rule, p, n = max(tried, key=lambda t: ((t[1] - t[2]) / max(1, t[1] + t[2]), -len(t[0])))
        if p + n < least / 2 or p < precision * (p + n):
            break
        rules.append(rule)
        rows = [r for r in rows if not fits(r[0], rule)]
    return rules


def quality_kept(docs, labels, prune):
    """[kept] for docs [(doc_id, text)]; labels [(doc_id, quality)]; prune {doc_id: whether its rows prune rules}."""
    base = [s[1] >= 10 and 100 * s[5] <= 20 * s[1] for d, t in docs for s in stats([(d, t)])]
    values = [features(t) for _, t in docs]
    rules = decision_list([(x, q == 0, prune[d]) for (d, _), x, ok in zip(docs, values, base, strict=True) if ok for e, q in labels if e == d and d is not None and q is not None])
    return [ok and not any(all((x[f] > b) == above for f, above, b in r) for r in rules) for ok, x in zip(base, values, strict=True)], rules
