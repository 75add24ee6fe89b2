"""Fact tables on shared storage, replaced path by path.

Every table lies in hash parts of its key; an update rewrites only the parts that it touches, and writes them again with the
same rows if it is repeated.  What is read is checkpointed before it is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators.graph import kept
from strandmill.operators.store import remove_keys

#: Fact tables and the column that holds the path of the file that a row comes from.
FACTS = {"files": "path", "imports": "src", "exports": "path", "prints": "grp", "shapes": "path"}
PART = "__part"


class FactStore:
    """Tables below ``root``: the facts by path, and named tables of the last row by key."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether the table has rows."""
        fs, path = self._fs(name), self._path(name)
        return fs.exists(path) and any(s.getPath().getName().startswith(PART) for s in fs.listStatus(path))

    def load(self, name: str) -> DataFrame | None:
        """The table, or None if nothing has been written yet."""
        return self.spark.read.parquet(f"{self.root}/{name}").drop(PART, "__key") if self.has(name) else None

    def keyed(self, name: str, keys: DataFrame, key: str) -> DataFrame | None:
        """Rows with a key of ``keys``; only their parts are read.  No keys, no rows."""
        if not self.has(name):
            return None
        wanted = keys.select(key).distinct().withColumn(PART, self._part(key))
        whole = self.spark.read.parquet(f"{self.root}/{name}")
        return whole.join(wanted, [key, PART], "left_semi").drop(PART)

    def _part(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.parts)).cast("int")

    def replace(self, name: str, rows: DataFrame, key: str, keys: DataFrame | None = None) -> None:
        """Rows of ``keys`` (by default those of ``rows``) go and ``rows`` come; parts without such keys stay untouched."""
        rows = kept(rows.withColumn(PART, self._part(key)))
        gone = kept((rows if keys is None else keys).select(key).distinct().withColumn(PART, self._part(key)))
        new = rows
        if self.has(name):
            old = self.spark.read.parquet(f"{self.root}/{name}")
            touched = gone.select(PART).union(rows.select(PART)).distinct()
            rest = remove_keys(old.join(F.broadcast(touched), PART, "left_semi"), gone, key)  # at most one row per part
            new = kept(rest.select(*rows.columns).union(rows))
            left = {r[0] for r in new.select(PART).distinct().collect()}
            for part in {r[0] for r in touched.collect()} - left:
                self._fs(name).delete(self._path(f"{name}/{PART}={part}"), True)
            if not left:
                return
        new.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.root}/{name}")

    def upsert(self, name: str, rows: DataFrame, key: str | list[str], at: str) -> None:
        """Of rows with one key, of one column or several, the one with the largest ``at`` stays."""
        keys = [key] if isinstance(key, str) else key
        stored = keys[0] if len(keys) == 1 else "__key"
        rows = rows if len(keys) == 1 else rows.withColumn(stored, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        old = self.keyed(name, rows, stored)
        both = rows if old is None else old.select(*rows.columns).union(rows)
        rest = [c for c in rows.columns if c != stored]
        last = both.groupBy(stored).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("r"))
        self.replace(name, last.select(stored, *[F.col(f"r.{c}").alias(c) for c in rest]), stored)

    def applied(self, stream: str, batch: int) -> bool:
        """Whether micro-batch ``batch`` of ``stream`` has been applied as a whole."""
        done = self.load("applied")
        return done is not None and done.where((F.col("stream") == stream) & (F.col("batch") >= batch)).limit(1).count() > 0

    def apply_once(self, stream: str, batch: int, step) -> bool:
        """Run ``step`` unless the batch has been applied, and note it when it has ended; a repeat after a failure runs it again."""
        if self.applied(stream, batch):
            return False
        step()
        self.upsert("applied", self.spark.createDataFrame([(stream, batch)], "stream string, batch long"), "stream", "batch")
        return True

    def overwrite(self, name: str, rows: DataFrame, key: str) -> None:
        """The table holds ``rows`` and nothing else."""
        rows = kept(rows.withColumn(PART, self._part(key)))
        rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(f"{self.root}/{name}")

    def clear(self, *names: str) -> None:
        for name in names:
            self._fs(name).delete(self._path(name), True)


def clear_index(facts: FactStore) -> None:
    """Remove the facts and the cached findings; baselines, sessions and logs stay."""
    facts.clear(*FACTS, "findings_cache")


def cache_findings(facts: FactStore, cache_key: str, found: DataFrame, now_ms: int) -> None:
    """Keep ``found`` under a name; it replaces what had the name before."""
    rows = kept(found).withColumns({"cache_key": F.lit(cache_key), "cached_at": F.lit(now_ms)})
    keys = rows.sparkSession.createDataFrame([(cache_key,)], "cache_key string")
    facts.replace("findings_cache", rows, "cache_key", keys)


def write_baseline(facts: FactStore, exports: DataFrame, snapshot: str) -> None:
    """Replace the whole API baseline by ``exports`` (path, export_name, signature)."""
    facts.overwrite("api_baseline", exports.withColumn("snapshot", F.lit(snapshot)), "path")


def bootstrap_baseline(facts: FactStore) -> bool:
    """Write the baseline from the stored exports if there is none yet and there are exports; whether it was written."""
    old, exports = facts.load("api_baseline"), facts.load("exports")
    if (old is not None and old.limit(1).count()) or exports is None or not exports.limit(1).count():
        return False
    write_baseline(facts, exports, "bootstrap")
    return True


def prune(log: DataFrame, sessions: DataFrame, at: str, now_ms: int, retain_days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, sessions, counts): rows of the last ``retain_days`` days, one day at least, and how many of each went."""
    cutoff = now_ms - max(retain_days, 1) * 86_400_000
    went = lambda df, name: df.agg(F.coalesce(F.sum((F.col(at) < cutoff).cast("long")), F.lit(0)).alias("n")).select(F.lit(name).alias("name"), "n")
    return log.where(F.col(at) >= cutoff), sessions.where(F.col(at) >= cutoff), went(log, "log").union(went(sessions, "sessions"))
