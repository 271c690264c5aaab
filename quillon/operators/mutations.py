"""Changes to keyed tables as joins: every function gives the table as it is afterwards.

A table of files isn't changed in place; the result is written as the next version. Changes of one key are reduced to the last
one before they meet the table, so a key that is changed very often isn't a hot key of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import optional


def last_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, "last.*")


def inserted(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The table with more rows: texts without blanks around them, null for blank ones, and defaults where nothing is given."""
    for name, default in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    for f in rows.schema:
        if f.dataType.simpleString() == "string":
            rows = rows.withColumn(f.name, optional(F.col(f.name), 2**31 - 1))
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def updated(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], touched: str | None = None, at: str | None = None) -> DataFrame:
    """The table with the columns of the changes (one a key) where these aren't null; touched takes the time `at` of the change."""
    new = changes.select(*keys, F.lit(True).alias("is new"), *[F.col(c).alias(f"new {c}") for c in columns], *([F.col(at).alias("new time")] if at else []))
    rows = table.join(new, keys, "left")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(F.col(f"`new {c}`"), F.col(c)))
    if touched:
        rows = rows.withColumn(touched, F.coalesce("`new time`", touched))
    return rows.select(*table.columns)


def deleted(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The table without the rows of the keys; rows whose key is null stay, and no keys change nothing."""
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the last row of each key in place of the one it has, and with the keys that are new."""
    last = last_changes(rows, keys, order)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*table.columns))
