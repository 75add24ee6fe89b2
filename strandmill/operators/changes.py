"""Drift against a baseline, dead exports, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGED, REMOVED, DEAD, DEAD_DYNAMIC = 0.97, 0.98, 0.86, 0.55


def api_drift(baseline: DataFrame, current: DataFrame, keys: list[str], signature: str = "signature") -> DataFrame:
    """Signatures of the baseline that changed or went; what is new is no drift."""
    now = current.select(*keys, F.col(signature).alias("after"))
    both = baseline.select(*keys, F.col(signature).alias("before")).join(now, keys, "left").where("after IS NULL OR after <> before")
    gone = F.col("after").isNull()
    return both.select(
        *keys, "before", F.coalesce("after", F.lit("<removed>")).alias("after"),
        F.when(gone, REMOVED).otherwise(CHANGED).alias("confidence"), F.lit("error").alias("severity"),
    )


def dead_exports(exports: DataFrame, live: DataFrame, dynamic: DataFrame, key: str) -> DataFrame:
    """Exports whose owner is not live; those with a dynamic way in are only noted."""
    risky = dynamic.select(key).distinct().withColumn("dynamic_risk", F.lit(True))
    dead = exports.join(live.select(key).distinct(), key, "left_anti").join(risky, key, "left")
    risk = F.coalesce("dynamic_risk", F.lit(False))
    return dead.withColumn("dynamic_risk", risk).withColumns({"severity": F.when(risk, "info").otherwise("warn"), "confidence": F.when(risk, DEAD_DYNAMIC).otherwise(DEAD)})


def snapshot_diff(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, change): added, unchanged or removed."""
    b = baseline.select(key).distinct().withColumn("was", F.lit(True))
    c = current.select(key).distinct().withColumn("now", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("unchanged")
    return c.join(b, key, "full_outer").select(key, change.alias("change"))


def first_match(edges: DataFrame, files: DataFrame, candidates, edge_keys: list[str]) -> DataFrame:
    """Resolve each edge to the first of its ordered candidate paths that exists; else null."""
    tried = edges.select(*edge_keys, F.posexplode_outer(candidates).alias("rank", "path"))
    found = tried.join(files.select(F.col("path"), F.lit(1).alias("there")), "path", "left")
    best = F.min(F.when(F.col("there") == 1, F.struct("rank", "path")))
    return found.groupBy(*edge_keys).agg(best.alias("best")).select(*edge_keys, F.col("best.path").alias("to_path"))
