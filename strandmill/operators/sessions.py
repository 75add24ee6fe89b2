"""Sessions: latest snapshot, time to live, conflicts, change batches, turns and latency percentiles."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import graph, ranges, setjoin
from strandmill.operators.graph import kept, pinned


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row of each key; one value per key crosses the shuffle from each task."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def conflicts(touched: DataFrame, least: float = 0.25, common: bool = False) -> DataFrame:
    """Pairs of sessions (a < b) by overlap coefficient of their files; ``touched`` is (session, file, direct).

    Common direct touches make an error.  ``least`` is above 0.  With ``common`` also the files of both.  Pairs may be many more than
    sessions, so they leave the join complete and are not shuffled.
    """
    return Conflicts(touched, least).rows(common)


class Conflicts:
    """The conflicts of ``conflicts`` before they are paired: as rows, as numbers of pairs, or as rows with their places.

    With ``only``, a boolean column of files, common files have to include one for which it holds.
    """

    def __init__(self, touched: DataFrame, least: float = 0.25, only: str | None = None, **how):
        self.sets = setjoin.Overlaps(touched, "session", "file", least, mark="direct", only=only, **how)

    def rows(self, common: bool = False, least: float | None = None) -> DataFrame:
        return self._judged(self.sets.pairs(common, least), ["a", "b", "overlap"], ["common"] if common else [])

    def tallies(self) -> DataFrame:
        """(a, overlap, n, marked, coefficient, severity, confidence, pairs): pairs by their first session and what makes the finding."""
        return self._judged(self.sets.tallies().withColumn("coefficient", F.col("overlap") / F.col("n")), ["a", "overlap", "n", "marked"], ["pairs"])

    def numbered(self, starts: DataFrame, common: bool = False) -> DataFrame:
        """``rows`` with ``position``; ``starts`` are ``tallies`` with where the numbers of their pairs start."""
        found = self.sets.numbered(starts.withColumnRenamed("confidence", "score"), common)
        severity = F.when(F.col("marked"), "error").otherwise("warn").alias("severity")
        return found.select("a", "b", "overlap", F.round(F.col("overlap") / F.col("n"), 6).alias("coefficient"), severity, F.col("score").alias("confidence"), "position", *(["common"] if common else []))

    def numberable(self) -> bool:
        """Whether pairs meet in blocks and a name can be told from what follows it in an id."""
        return self.sets.dense and not self.sets.table.where(F.contains(F.col("__o").cast("string"), F.lit(":"))).limit(1).count()

    @staticmethod
    def _judged(pairs: DataFrame, first: list[str], more: list[str]) -> DataFrame:
        severity = F.when(F.col("marked"), "error").otherwise("warn").alias("severity")
        return pairs.select(*first, F.round("coefficient", 6).alias("coefficient"), severity, F.round(F.least("coefficient", F.lit(0.99)), 6).alias("confidence"), *more)


def snapshots(touches: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(session, at, file, direct): what each session's last batch touched and what lies within ``depth`` import steps of it.

    ``touches`` is (session, at, path).  A later batch replaces an earlier one; blank sessions are left out.
    """
    real = touches.where("session IS NOT NULL AND trim(session) <> ''")
    last = real.groupBy("session").agg(F.max("at").alias("at"))
    own = kept(real.join(last, ["session", "at"]).select("session", "at", F.col("path").alias("file")).distinct())
    around = graph.cones(own.select(F.col("session").alias("owner"), F.col("file").alias("node")), edges, depth)
    whole = around.select(F.col("owner").alias("session"), F.col("node").alias("file")).join(last, "session")
    direct = own.select("session", "file", F.lit(True).alias("direct"))
    return whole.join(direct, ["session", "file"], "left").select("session", "at", "file", F.coalesce("direct", F.lit(False)).alias("direct"))


def active(found: DataFrame, now_ms: int, ttl_ms: int = 900_000) -> DataFrame:
    """Rows (session, at, ...) that are at most ``ttl_ms`` old."""
    return found.where(F.lit(now_ms) - F.col("at") <= ttl_ms)


def stale(found: DataFrame, now_ms: int, ttl_ms: int = 900_000) -> DataFrame:
    return found.where(F.lit(now_ms) - F.col("at") > ttl_ms)


def first_named(pairs: DataFrame, present: DataFrame, session: str | None) -> DataFrame:
    """``pairs`` (a, b, ...) with ``session`` first where it takes part; none at all if it is not among ``present`` (session)."""
    if session is None:
        return pairs
    there = present.where(F.col("session") == session).select(F.lit(1).alias("__there")).limit(1)
    turned = F.col("b") == session
    both = {"a": F.when(turned, F.col("b")).otherwise(F.col("a")), "b": F.when(turned, F.col("a")).otherwise(F.col("b"))}
    return pairs.withColumns(both).crossJoin(F.broadcast(there)).drop("__there")  # one row or none


def debounce(events: DataFrame, key: str, at: str, order: str, gap_ms: int) -> DataFrame:
    """(key, batch, started, ended, n): runs of events with gaps of at most ``gap_ms``; ``at`` is in milliseconds.

    Gaps and batch numbers are carried from range to range of (key, at, order), so a frequent key fills many tasks.
    """
    rows = ranges.spread(events, [F.asc(c) for c in (key, at, order)])
    rows = ranges.neighbour(rows, [key], [at, order], F.col(at), "__at")
    rows = kept(rows.withColumn("__new", F.when(F.col(at) - F.col("__at") <= gap_ms, 0).otherwise(1)))
    runs = ranges.running_sum(rows, [key], [F.asc(at), F.asc(order)], F.col("__new"), "batch")
    return runs.groupBy(key, "batch").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def turns(events: DataFrame, key: str, at: str, order: str, out: str = "turn") -> DataFrame:
    """``events`` with turn-1, turn-2 ... in order of (at, order) of each key, counted over ranges."""
    rows = ranges.spread(events, [F.asc(c) for c in (key, at, order)])
    counted = ranges.running_sum(rows, [key], [F.asc(at), F.asc(order)], F.lit(1), "__n")
    return counted.withColumn(out, F.concat(F.lit("turn-"), F.col("__n").cast("string"))).drop("__n", ranges.RANGE)


def _chain_ends(times: np.ndarray, quiet_ms: int) -> list[tuple[int, int]]:
    """(due, last) of one key's sorted distinct times: an emitter that is ready at most at ``due`` lets ``last`` through last.

    Whatever comes before ``times``, the first event let through is one of the first quiet time.
    """
    after = np.searchsorted(times, times + quiet_ms).tolist()
    end = list(range(len(times)))
    for k in range(len(times) - 1, -1, -1):
        if after[k] < len(times):
            end[k] = end[after[k]]
    starts = end[: after[0] + 1]
    return [(int(times[k]), int(times[e])) for k, e in enumerate(starts) if k + 1 == len(starts) or starts[k + 1] != e]


def cooldown(events: DataFrame, key: str, at: str, order: str, quiet_ms: int) -> DataFrame:
    """Events that a per-key emitter lets through: at least ``quiet_ms`` after the last one that it let through.

    Greedy over times sorted into ranges of (key, time), so a frequent key fills many ranges.  A range with one key alone
    says how it would end for any state before it; the driver follows these, and then every range is folded by itself
    from its own state.  Of events at one time only the first in order can pass.  Events without a time all pass.
    """
    rows = events.select(key, F.col(order).alias(order), F.col(at).alias(at))
    if quiet_ms <= 0:
        return rows
    timed = rows.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.min(F.struct(order)).alias("first"))
    timed = timed.select(key, F.col(f"first.{order}").alias(order), F.col(at).cast("long").alias(at))
    ranges = pinned(timed.repartitionByRange(key, at).sortWithinPartitions(key, at))

    def ends(batches):
        first, now, last, alone, times = None, None, None, True, []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first is None:
                    first, now = (k,), k
                elif k != now:
                    now, last, alone, times = k, None, False, []
                if alone:
                    times.append(t)
                elif last is None or t - last >= quiet_ms:
                    last = t
        if first is not None:
            found = _chain_ends(np.array(times, np.int64), quiet_ms) if alone else [(None, last)]
            part = TaskContext.get().partitionId()
            cols = [[part] * len(found), [first[0]] * len(found), [now] * len(found), [d for d, _ in found], [e for _, e in found]]
            kinds = [pa.int32(), batch.column(0).type, batch.column(0).type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["part", "first", "final", "due", "last"])

    kind = ranges.schema[key].dataType.simpleString()
    told = ranges.mapInArrow(ends, f"part int, first {kind}, final {kind}, due long, last long")
    before, state = {}, None  # state: key and last time let through at the end of the range before
    for part, found in itertools.groupby(told.toLocalIterator(), key=lambda r: r["part"]):
        found = list(found)
        known = state[1] if state and state[0] == found[0]["first"] else None
        if known is not None:
            before[part] = known
        if found[0]["due"] is None:
            last = found[0]["last"]
        else:
            last = next((r["last"] for r in found if known is None or r["due"] >= known + quiet_ms), known)
        state = (found[0]["final"], last)

    def fold(batches):
        last, now, begun = before.get(TaskContext.get().partitionId()), None, False
        for batch in batches:
            passed = []
            for n, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if begun and k != now:
                    last = None
                begun, now = True, k
                if last is None or t - last >= quiet_ms:
                    last = t
                    passed.append(n)
            yield batch.take(pa.array(passed, pa.int64()))

    return ranges.mapInArrow(fold, ranges.schema).union(rows.where(F.col(at).isNull()))


def percentiles(samples: DataFrame, key: str, value: str, order: list[str], keep: int = 512) -> DataFrame:
    """count, p50, p95 and max of each key's ``keep`` newest samples, at rank ceil((n - 1) * p)."""
    newest = samples.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where(F.col("nth") <= keep)
    held = newest.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("xs"))  # at most ``keep`` values
    at = lambda p: F.element_at("xs", (F.ceil((F.size("xs") - 1) * p) + 1).cast("int"))
    return held.select(key, F.size("xs").cast("long").alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.element_at("xs", -1).alias("most"))
