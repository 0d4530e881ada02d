"""Secret scans through a ledger of content-addressed blobs: each blob is scanned once for each version of the rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_jobs.llm.common import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of `pattern` are leftmost and non-overlapping; those whose group has under `least` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int
    #: A pattern that Java and Python read alike and that occurs in every text with a kept match.
    gate: str
    base: bool = True
    #: A pattern with the same kept matches as `pattern` that is found faster, if there is one.
    quick: str | None = None


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = RuleSet(
    "2",
    (
        Rule("assign", rf"{_ASSIGN}([A-Za-z0-9+/_.=-]+)", 1, 12, rf"{_ASSIGN}[A-Za-z0-9+/_.=-]{{12}}"),
        Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14}"),
        Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}", quick=r"[0-9a-f]{16,}"),
        Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", base=False),
    ),
)
#: One finding: place of the kind in the rule set, first code point, end (exclusive).
FINDINGS = "array<struct<kind:int,start:int,end:int>>"


def find_secrets(text: str, compiled: list[tuple[re.Pattern, int, int]]) -> list[dict]:
    """The findings of one text, by start, then kind."""
    found = [
        {"kind": k, "start": m.start(), "end": m.end()}
        for k, (pattern, group, least) in enumerate(compiled)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return sorted(found, key=lambda f: (f["start"], f["kind"]))


def compile_rules(rules: RuleSet) -> list[tuple[re.Pattern, int, int]]:
    return [(re.compile(r.quick or r.pattern, re.ASCII), r.group, r.least) for r in rules.rules]


def _gate(rules: RuleSet) -> str:
    return "|".join(f"(?:{r.gate})" for r in rules.rules)


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def blob_paths(docs: DataFrame, rules: RuleSet = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, content), a table: the path and the content address of every row.

    content is the text where a rule's gate occurs in it, so that it may hold a finding, else null: both are asked once for each row, in the JVM. A
    null text counts as empty.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    return written(docs.select(F.col(key).alias("key"), _blob(text).alias("blob"), F.when(content.rlike(_gate(rules)), content).alias("content")), "paths")


def scan_unseen(paths: DataFrame, rules: RuleSet = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows (blob, rule_version, findings): every blob of blob_paths() that the ledger lacks for this version of the rules.

    A blob without content can't hold a finding and is entered with none; the contents of the others are deduplicated by
    blob, so that copies are scanned once, and scanned whole in Arrow batches. Of blobs that the ledger has, no text is moved or scanned.
    """
    # copies of a blob, however common, are one row before any join
    clean, suspect = paths.filter("content is null").select("blob").distinct(), paths.filter("content is not null").select("blob", "content").dropDuplicates(["blob"])
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rules.version).select("blob").hint("merge")
        clean, suspect = clean.join(seen, "blob", "left_anti"), suspect.join(seen, "blob", "left_anti")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [find_secrets(t.as_py(), compiled) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["blob", "findings"])

    scanned = suspect.mapInArrow(scan, f"blob binary, findings {FINDINGS}")
    return scanned.unionByName(clean.withColumn("findings", F.array().cast(FINDINGS))).select("blob", F.lit(rules.version).alias("rule_version"), "findings")


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: RuleSet = RULES, key: str = "doc_id") -> DataFrame:
    """(key, findings) for every row of blob_paths(): the ledger's findings joined back to all paths of a blob.

    A path whose blob the ledger lacks has no findings, like one with an empty, null or clean text. Only entries with findings are joined, so that
    the blob of an empty text, however common, is no key of the join.
    """
    entries = ledger.filter((F.col("rule_version") == rules.version) & (F.size("findings") > 0)).select("blob", "findings")
    suspect = paths.filter("content is not null").select("key", "blob").join(entries.hint("merge"), "blob", "left").select("key", "findings")
    clean = paths.filter("content is null").select("key", F.lit(None).cast(FINDINGS).alias("findings"))
    return suspect.unionByName(clean).select(F.col("key").alias(key), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def scan_versions(versions: list[DataFrame], rules: RuleSet = RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) of historical versions, oldest first: each is scanned for what the ledger of those before it lacks."""
    ledger, paths = None, None
    for docs in versions:
        here = blob_paths(docs, rules, key, text)
        new = written(scan_unseen(here, rules, ledger), "ledger")
        ledger, paths = (new, here) if ledger is None else (ledger.unionByName(new), paths.unionByName(here))
    return paths, ledger


def secret_report(found: DataFrame, rules: RuleSet = RULES, key: str = "doc_id") -> DataFrame:
    """Counts for each base kind, the digest of the base spans and all spans, as text kind:start:end.

    Null and empty texts have no findings; equal texts have equal findings; repeated rows are reported each on their own.
    """
    names = F.array(*(F.lit(r.kind) for r in rules.rules))
    n_base = sum(r.base for r in rules.rules)  # base rules come first in a rule set

    def spans(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"] < n_base)
    def count(i):
        return F.size(F.filter("findings", lambda f: f["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules.rules) if r.base]
    return found.select(key, *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
