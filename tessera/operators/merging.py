"""Upserts, deletes and optional predicates as DataFrame functions: each returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, **equal: object) -> DataFrame:
    """Equality on each column whose value is given. None and '' mean any, and then no predicate is planned at all."""
    for column, value in equal.items():
        if value is None or value == "":
            continue
        df = df.filter(F.col(column).isin(*value)) if isinstance(value, (list, tuple, set)) else df.filter(F.col(column) == value)
    return df


def within(df: DataFrame, column: str, after: object = None, before: object = None) -> DataFrame:
    """Inclusive bounds, each optional."""
    if after is not None:
        df = df.filter(F.col(column) >= F.lit(after))
    if before is not None:
        df = df.filter(F.col(column) <= F.lit(before))
    return df


def upsert(old: DataFrame, new: DataFrame, keys: list[str], combine: Mapping[str, Callable[[Column, Column], Column]] | None = None, keep: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; others are added.

    ``keep`` names columns whose old value survives; ``combine`` gives (old, new) -> value for others. One shuffle on the
    keys. ``new`` has one row for each key at most.
    """
    combine = dict(combine or {}) | {c: (lambda o, n: o) for c in keep}
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    had, has = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    out = []
    for c in old.columns:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        merged = combine[c](before, after) if c in combine else after
        out.append(F.when(had & has, merged).when(has, after).otherwise(before).alias(c))
    return both.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose keys it does not have (each key once)."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows for which the condition is not true (null keeps the row, as DELETE does)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def update_where(df: DataFrame, condition: Column, **values: object) -> DataFrame:
    """``df`` with the given columns set where the condition is true."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    """A window of a total order; TakeOrderedAndProject where there is a limit."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
