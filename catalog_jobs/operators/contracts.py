"""Data contracts: keys, references, required columns and text lengths, as one table of violations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between the values of a key of several columns, and what stands for its first character inside a value.
_MARK, _NEXT, _MARKED = "\x00", "\x00\x01", "\x00\x02"


def check_contract(df: DataFrame, table: str, unique: Iterable[list[str]] = (), required: Iterable[str] = (), references: Iterable[tuple[str, DataFrame, str]] = (), max_bytes: dict[str, int] | None = None) -> DataFrame:
    """(table, rule, column, value, n): n rows violate a rule with one value.

    unique: key columns without repeated values (nulls don't count); required: columns without nulls; references: (column, other
    table, its column) where every value must exist; max_bytes: most UTF-8 bytes of a text.

    The table is scanned once: a row becomes one item for each rule that it can break, and all items meet the keys of all referenced tables in one aggregation, which
    sums up within tasks before its one shuffle. Values are compared as texts; those of several key columns are kept apart.
    """
    rules: list[tuple[str, str]] = []
    items, known = [], []

    def item(rule: str, column: str, key: Column, holds: Column) -> None:
        items.append(F.when(holds, F.struct(F.lit(len(rules)).alias("rule_no"), key.alias("key"))))
        rules.append((rule, column))

    def joined(columns: list[str]) -> Column:
        """A text that stands for the values of some columns and no others."""
        texts = [F.col(c).cast("string") for c in columns]
        return texts[0] if len(texts) == 1 else F.concat_ws(_NEXT, *(F.replace(t, F.lit(_MARK), F.lit(_MARKED)) for t in texts))

    for key in unique:
        item("unique", ",".join(key), joined(key), reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in key)))
    for c in required:
        item("not_null", c, F.lit(None).cast("string"), F.col(c).isNull())
    for c, other, key in references:  # numbered: one column may have to exist in two tables
        known.append(other.filter(F.col(key).isNotNull()).select(F.lit(len(rules)).alias("rule_no"), F.col(key).cast("string").alias("key"), F.lit(0).alias("own")))
        item("reference", c, F.col(c).cast("string"), F.col(c).isNotNull())
    for c, most in (max_bytes or {}).items():
        item("max_bytes", c, F.octet_length(c).cast("string"), F.octet_length(c) > most)
    own = df.select(F.explode(F.array_compact(F.array(*items))).alias("i")).select("i.*", F.lit(1).alias("own"))
    counts = reduce(DataFrame.unionByName, [own, *known]).groupBy("rule_no", "key").agg(F.sum("own").alias("n"), F.min("own").alias("least"))
    name = F.get(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column")) for r, c in rules)), F.col("rule_no"))
    broken = counts.withColumn("r", name).filter((F.col("n") >= F.when(F.col("r.rule") == "unique", 2).otherwise(1)) & (F.col("least") > 0))
    several = F.replace(F.replace("key", F.lit(_NEXT), F.lit("|")), F.lit(_MARKED), F.lit(_MARK))
    value = F.when((F.col("r.rule") == "unique") & F.contains(F.col("r.column"), F.lit(",")), several).otherwise(F.col("key"))
    return broken.select(F.lit(table).alias("table"), "r.rule", "r.column", value.alias("value"), F.col("n").cast("long").alias("n"))
