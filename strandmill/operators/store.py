"""Fact-store semantics on plain tables: copy-on-write upserts, conditional updates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(table: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is not in ``delta``, and all of ``delta``."""
    return table.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta.select(*table.columns))


def remove_keys(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def conditional_upsert(table: DataFrame, delta: DataFrame, key: str, may_replace: Column) -> DataFrame:
    """Insert what is new; replace a stored row (columns prefixed old_) only where ``may_replace`` holds."""
    rest = [c for c in table.columns if c != key]
    old = table.select(key, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("was"))
    new = delta.select(key, *rest, F.lit(True).alias("now"))
    both = old.join(new, key, "full_outer")
    take = F.col("now").isNotNull() & (F.col("was").isNull() | F.coalesce(may_replace, F.lit(False)))
    return both.select(key, *[F.when(take, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in rest], take.alias("changed"))


def newest(log: DataFrame, seq: str, keep: int) -> DataFrame:
    """The ``keep`` rows with the largest ``seq``: a top-k, so no task sorts the log."""
    return log.orderBy(F.desc(seq)).limit(keep)


def prune(log: DataFrame, at: Column, cutoff: Column) -> DataFrame:
    return log.where(at >= cutoff)


def keyed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows with a key of ``keys``; no keys, no rows."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def unchanged_skipped(scan: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Scanned rows whose key and digest are not known yet."""
    return scan.join(known.select(*keys).distinct(), keys, "left_anti")


def first_per(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
