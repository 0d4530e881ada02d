"""Quality rules: an ordered list of threshold conjunctions learned by sequential covering, as Spark conditional expressions.

Everything here is DataFrame operations: the statistics of a text are column expressions, and the learner asks
for counts by grouping the labelled rows; only counts by feature and bin reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_jobs.llm.common import split_words, written

#: Words in a window of the repetition count.
WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: the statistics as shares, so that a rule means the same in a long and in a short text.
FEATURES = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "double(n_dup_lines)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def text_stats(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(*keys, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_digits), one row for each row of docs.

    Null and empty texts have 0 of everything. Windows are compared by a 64-bit hash within one text. One pass, no
    shuffle: a text's windows are compared inside its row, in n log n steps and only where two are equal.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(*keys, t.alias("t"), split_words(F.col(text)).alias("w"))
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(WINDOW))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.select(
        *keys,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _removed(F.col("t"), r"[A-Z]+").cast("long").alias("n_upper"),
        _removed(F.col("t"), r"[0-9]+").cast("long").alias("n_digits"),
        lines.alias("lines"),
        F.when(F.size("w") >= WINDOW, gram).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    step = step.select(
        *keys, *STATS[:3], "n_upper", "n_digits",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
    )
    twice = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    step = step.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))))
    covered = F.aggregate(
        "p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return step.select(*keys, *STATS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_upper", "n_digits")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.bound if self.above else value <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of tests that rejects; what no rule rejects is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def rejects(self) -> Column:
        verdict = F.lit(False)
        for rule in reversed(self.rules):
            hit = F.lit(True)
            for test in rule:
                hit = hit & test.column()
            verdict = F.when(hit, F.lit(True)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join(f"{'if' if i == 0 else 'else if'} {' and '.join(map(str, r))}: reject" for i, r in enumerate(self.rules)) + "\nelse keep"


def _rounded(feature: str) -> Column:
    """A feature to three significant decimals at most, so that its distinct values are few and exact counts by value are narrow."""
    return F.round(F.expr(FEATURES[feature]), 3)


def _bins(stats: DataFrame, n_bins: int) -> dict[str, list[float]]:
    """Thresholds of each feature: exact quantiles of its rounded values over all labelled rows and over the low-quality ones.

    Values are counted by group first, so that the result doesn't depend on how rows lie in partitions; a window over the
    counts of one feature's distinct values finds where each quantile falls.
    """
    long_ = stats.select("bad", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _rounded(f).alias("x")) for f in FEATURES))).alias("v")).select("v.f", "v.x", "bad")
    counts = long_.groupBy("f", "x").agg(F.count("*").alias("all"), F.count_if("bad").alias("low"))
    kinds = counts.select("f", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in ("all", "low")))).alias("c")).select("f", "x", "c.k", "c.n").filter("n > 0")
    own = Window.partitionBy("f", "k")
    below = kinds.withColumns({"upto": F.sum("n").over(own.orderBy("x")), "total": F.sum("n").over(own)})
    # the i-th quantile is the first value with at least i / n_bins of the rows up to it
    edge = F.floor(F.col("upto") * n_bins / F.col("total")) > F.floor((F.col("upto") - F.col("n")) * n_bins / F.col("total"))
    lowest = F.col("upto") == F.col("n")
    rows = below.filter(edge | lowest).select("f", "x").distinct().collect()  # 2 * (n_bins + 1) for each feature at most
    return {f: sorted(r["x"] for r in rows if r["f"] == f) for f in FEATURES}


def learn_rules(labelled: DataFrame, n_bins: int = 12, max_rules: int = 6, max_tests: int = 4, least_rows: int = 8, precision: float = 0.9) -> DecisionList:
    """Sequential covering over labelled statistics: columns of text_stats, row_key and bad (boolean).

    All labelled rows count; two thirds, by a hash of row_key, grow rules and the rest prune them. A rule starts empty and takes
    the test with the best information gain until it covers no good row or max_tests is reached; then its last tests
    are pruned while (bad - good) / (bad + good) on the pruning rows doesn't fall. Rules that cover fewer than
    least_rows or are less precise than `precision` on the pruning rows end the learning. Rows without a label aren't
    given to it; without bad rows the list is empty and keeps everything. Ties go to the first feature and bound.
    """
    cuts = _bins(labelled, n_bins)
    bins = [sum((F.when(F.expr(e) > x, 1).otherwise(0) for x in cuts[f]), F.lit(0)).alias(f) for f, e in FEATURES.items()]
    prune = F.pmod(F.xxhash64("row_key"), F.lit(3)) == 0
    # rows with the same bins count as one cell from here on
    cells = written(labelled.select(prune.alias("prune"), "bad", *bins).groupBy("prune", *FEATURES).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")), "cells")

    def holds(test: Test) -> Column:
        cut = cuts[test.feature].index(test.bound)  # x > bound[cut] puts x in a bin beyond cut
        return F.col(test.feature) > cut if test.above else F.col(test.feature) <= cut

    def conjunction(tests: tuple[Test, ...]) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & holds(t)
        return out

    rules: list[tuple[Test, ...]] = []
    left = cells
    while len(rules) < max_rules:
        rule: tuple[Test, ...] = ()
        while len(rule) < max_tests:
            rows = (
                left.filter(~F.col("prune")).filter(conjunction(rule))
                .select("p", "n", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES))).alias("x"))
                .groupBy("x.f", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
            )
            counts = {f: {r["b"]: (r["p"], r["n"]) for r in rows if r["f"] == f} for f in FEATURES}
            p0, n0 = (sum(c[i] for c in counts["n_words"].values()) for i in (0, 1))
            if p0 < least_rows or n0 == 0:
                break
            best, gain = None, 1e-9
            for f in FEATURES:
                low = [0, 0]
                for k, bound in enumerate(cuts[f]):
                    low = [a + b for a, b in zip(low, counts[f].get(k, (0, 0)), strict=True)]
                    for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                        if p >= least_rows and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Test(f, above, bound), g
            if best is None:
                break
            rule += (best,)
        if not rule:
            break
        tried = [rule[: i + 1] for i in range(len(rule))]
        got = left.filter("prune").agg(*(F.sum(F.when(conjunction(t), F.col(c)).otherwise(0)).alias(f"{c}{i}") for i, t in enumerate(tried) for c in ("p", "n"))).first()
        worth = [((got[f"p{i}"] or 0), (got[f"n{i}"] or 0)) for i in range(len(tried))]
        at = max(range(len(tried)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), -i))
        p, n = worth[at]
        if p + n < least_rows / 2 or p < precision * (p + n):
            break
        rules.append(tried[at])
        left = left.filter(~conjunction(tried[at]))
    return DecisionList(tuple(rules))


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))


def judged(docs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DecisionList]:
    """(*keys, statistics, base_failed, kept) for every row of docs, and the list learned from labels (doc_id, quality).

    Labels with a null quality or of no document aren't used; a document with several labels counts once for each. Null and empty
    texts have no words, so that they fail the base rules; repeated rows are judged each on their own, alike; a row with a null doc_id has no
    label but is judged; without labels the list is empty. A very long text is one row of work, n log n in its words. The texts are read once: their statistics are written as a narrow table, which the learner and the verdicts read.
    """
    stats = written(text_stats(docs, keys), "stats")
    labelled = stats.join(labels.filter("quality is not null").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    # what the base rules reject needs no learned rule
    rules = learn_rules(labelled.filter(~base_failed()).withColumn("row_key", F.col("doc_id")))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rules.rejects()), rules


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rules nor the learned list reject, with all their columns.

    As judged(): null and empty texts go, repeated rows stay or go together, an empty table gives an empty one.
    """
    marked = docs.withColumn("__tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    stats, _ = judged(marked.select("doc_id", "text", "__tie"), labels, ("doc_id", "__tie"))
    kept = stats.filter("kept").select(F.col("doc_id").alias("__id"), F.col("__tie").alias("__t"))
    return marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tie") == F.col("__t")), "left_semi").drop("__tie")
