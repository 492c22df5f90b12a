"""Keys, references and value domains as reports; a clean table gives no or zero rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DOMAINS, FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, UNIQUE


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once; NULL never counts as a repeat."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    keys = parent.select(F.col(parent_key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per rule of the given tables: ``(table_name, rule, violations)``.

    The NOT NULL and domain rules of a table share one scan.
    """
    reports = []

    def report(df: DataFrame, table: str, rule: str) -> None:
        reports.append(df.agg(F.count("*").alias("violations")).select(
            F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"))

    for name, df in tables.items():
        row_rules = {}
        for column in [PRIMARY_KEYS[name], *NOT_NULL.get(name, [])]:
            row_rules[f"{column} is set"] = F.col(column).isNull()
        for column, allowed in DOMAINS.get(name, {}).items():
            row_rules[f"{column} in domain"] = ~F.col(column).isin(*allowed)
        counted = df.agg(*[F.count(F.when(c, 1)).alias(f"r{i}") for i, c in enumerate(row_rules.values())])
        pairs = ", ".join(f"'{rule}', r{i}" for i, rule in enumerate(row_rules))
        reports.append(counted.select(
            F.lit(name).alias("table_name"), F.expr(f"stack({len(row_rules)}, {pairs}) AS (rule, violations)")))
        for column in [PRIMARY_KEYS[name], *UNIQUE.get(name, [])]:
            report(repeated_keys(df, column), name, f"{column} is unique")
        if name in FOREIGN_KEYS:
            column, parent, parent_key = FOREIGN_KEYS[name]
            if parent in tables:
                # Counted per key first: the join sees each key once, however many rows a key has.
                counts = df.groupBy(column).agg(F.count("*").alias("n"))
                lost = orphans(counts, column, tables[parent], parent_key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
                reports.append(lost.select(F.lit(name).alias("table_name"), F.lit(f"{column} is in {parent}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, reports)
