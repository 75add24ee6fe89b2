"""Streams of change notifications: debounced batches, retention by age, keyed upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, key: str, at: str, item: str, gap: str = "175 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, started, ended, items, n): per key, events with less than ``gap`` between them.

    Works on batches and on streams; a stream emits a batch once the watermark has passed it.
    """
    stamped = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("__at", late)
    w = F.session_window("__at", gap)
    out = stamped.groupBy(key, w.alias("w")).agg(F.array_sort(F.collect_set(item)).alias("items"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "items", "n")


def upsert_stream(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every micro-batch to ``apply``, one after the other; a batch id repeats after a failure and must be applied idempotently."""
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_stream(events: DataFrame, facts, read: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "session", at: str = "at", item: str = "path", gap: str = "175 milliseconds", late: str = "10 minutes", name: str = "index") -> StreamingQuery:
    """Bring the stored facts up to date with a stream of changed paths (key, at, item).

    Changes are debounced; of each micro-batch the paths named are read by ``read(paths)`` -> (path, source, digest), and those that
    are no more lose their facts.  A batch that has been applied as a whole is not applied again; one that broke off is repeated
    and ends in the same tables, since digests are written last.
    """
    from strandmill.plans import codebase

    def apply(batch: DataFrame, number: int) -> None:
        def step():
            paths = batch.select(F.explode("items").alias("path")).distinct().persist()
            codebase.index_changes(facts, read(paths), paths)
            paths.unpersist()

        facts.apply_once(name, number, step)

    return upsert_stream(debounced(events, key, at, item, gap, late), apply, checkpoint)


def watched(events: DataFrame) -> DataFrame:
    """(session, path) of editor and watcher events (type, file, change): edits, additions and changes of named files; deletions are left out."""
    kind = F.when(F.col("type") == "file.edited", "event").when((F.col("type") == "file.watcher.updated") & F.col("change").isin("add", "change"), "watcher")
    return events.where("file IS NOT NULL").select(kind.alias("session"), F.col("file").alias("path")).where("session IS NOT NULL")


def session_states(touches: DataFrame, ttl_ms: int = 900_000) -> DataFrame:
    """Stream of (session, last_seen, files, status) from a stream of (session, at, path), ``at`` in milliseconds.

    A session's state is its last batch alone, and it is dropped with status ``stale`` when nothing came for ``ttl_ms``.
    Rows without a session name, a time or a path are passed over.  Run it with a processing-time trigger, since timeouts
    need batches without data; ``availableNow`` may not end.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            seen, files = state.get
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "last_seen": [seen], "files": [list(files)], "status": ["stale"]})
            return
        seen, files = state.get if state.exists else (-1, [])
        for rows in batches:
            last = int(rows["at"].max())
            if last >= seen:
                own = sorted(set(rows.loc[rows["at"] == last, "path"]))
                seen, files = last, sorted({*files, *own}) if last == seen else own
        state.update((seen, files))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session": [key[0]], "last_seen": [seen], "files": [list(files)], "status": ["active"]})

    real = touches.where("session IS NOT NULL AND trim(session) <> '' AND at IS NOT NULL AND path IS NOT NULL")
    return real.groupBy("session").applyInPandasWithState(step, "session string, last_seen long, files array<string>, status string", "seen long, files array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)
