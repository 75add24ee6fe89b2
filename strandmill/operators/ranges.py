"""Total orders and running state over sorted ranges: no task holds a whole key.

Rows are sorted into ranges of about equal size, so a key with a third of all rows fills many of them.  A first pass
folds each (range, key) to one row, a window over these few rows carries totals and ends from range to range, and a
second pass scans every range by itself.  Equal keys of the order fall into one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.graph import kept

RANGE = "__range"


def spread(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with its range; ranges follow ``order``, and rows equal in it share one."""
    return kept(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def _key(df: DataFrame, key: list[str]) -> list[str]:
    return [*key, RANGE]


def _carry(folded: DataFrame, key: list[str]):
    """The window over earlier ranges of a key; without a key, over one row per range."""
    over = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    return over.orderBy(RANGE)


def _join(rows: DataFrame, folded: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with what ``folded`` has for their range and key; null keys are equal."""
    named = folded.withColumnsRenamed({c: f"__of_{c}" for c in _key(folded, key)})
    same = [F.col(f"__of_{c}").eqNullSafe(F.col(c)) for c in key] + [F.col(f"__of_{RANGE}") == F.col(RANGE)]
    return rows.join(named, same, "left").drop(*[f"__of_{c}" for c in _key(folded, key)])


def running_sum(rows: DataFrame, key: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """``rows`` of ``spread`` with the sum of ``value`` over the key's rows up to and with each row."""
    rows = rows.withColumn("__value", value)
    sums = rows.groupBy(*key, RANGE).agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(_carry(sums, key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = rows.withColumn("__here", F.sum("__value").over(local))
    return _join(scanned, sums.select(*key, RANGE, before.alias("__before")), key).withColumn(out, F.col("__here") + F.coalesce("__before", F.lit(0))).drop("__value", "__here", "__before")


def neighbour(rows: DataFrame, key: list[str], order: list[str], value: Column, out: str, next_: bool = False, descending: list[str] = ()) -> DataFrame:
    """``rows`` of ``spread`` with ``value`` of the key's row before (or after) each row, null at the end.

    ``order`` are columns without ties inside a key, those in ``descending`` from high to low.
    """
    columns = [F.desc(c) if c in descending else F.asc(c) for c in order]
    rows = rows.withColumn("__value", F.struct(value.alias("v")))
    local = Window.partitionBy(*key, RANGE).orderBy(*columns)
    first, last = F.first("__value").over(local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("__value").over(local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scanned = rows.withColumns({"__near": (F.lead if next_ else F.lag)("__value").over(local), "__end": first if next_ else last})
    ends = scanned.groupBy(*key, RANGE).agg(F.first("__end").alias("__end"))
    far = (F.lead if next_ else F.lag)("__end").over(_carry(ends, key))
    joined = _join(scanned.drop("__end"), ends.select(*key, RANGE, far.alias("__far")), key)
    return joined.withColumn(out, F.coalesce("__near", "__far")["v"]).drop("__value", "__near", "__far")


def consecutive(events: DataFrame, order: list[str], value: str) -> DataFrame:
    """(src, dst): each row's ``value`` and the next one's in the total order of the columns ``order``."""
    rows = spread(events, [F.asc(c) for c in order])
    return neighbour(rows, [], order, F.col(value), "dst", next_=True).select(F.col(value).alias("src"), "dst").where("dst IS NOT NULL")
