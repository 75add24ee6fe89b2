"""Running totals in which no task holds a whole group.

Rows are dealt to bins, bins to super-bins.  Totals are taken bin by bin, then over the bins of a
super-bin, then over super-bins, so the widest single window runs over rows / (bin * FAN) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAN = 1024


def bin_offsets(bins: DataFrame, group: list[str], bin_col: str, total: str, out: str) -> DataFrame:
    """``bins`` has one row per (group, bin).  Adds ``out``: the sum of ``total`` over smaller bins of the group."""
    over = bins.withColumn("__sm_super", F.floor(F.col(bin_col) / FAN))
    supers = over.groupBy(*group, "__sm_super").agg(F.sum(total).alias("__sm_sum"))
    upto = Window.partitionBy(*group).orderBy("__sm_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.withColumn("__sm_upto", F.coalesce(F.sum("__sm_sum").over(upto), F.lit(0))).drop("__sm_sum")
    within = Window.partitionBy(*group, "__sm_super").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    local = over.withColumn("__sm_local", F.coalesce(F.sum(total).over(within), F.lit(0)))
    return (
        local.join(supers, [*group, "__sm_super"])
        .withColumn(out, F.col("__sm_upto") + F.col("__sm_local"))
        .drop("__sm_super", "__sm_upto", "__sm_local")
    )
