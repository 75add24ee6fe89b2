"""Findings: one schema, canonical order, neighbour dedup, truncation, risk reasons, score and focus, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import graph, ranges

COLUMNS = ["id", "kind", "severity", "confidence", "target"]
#: What a finding carries besides, where it is asked for.
DETAILS = ["files", "symbols", "action", "evidence"]
#: Ids of findings that are shown for a reason.
FIRST_IDS = 12
#: How many findings a row of ``ranked`` stands for.
PAIRS = "__pairs"
EVIDENCE = "array<struct<kind:string,file:string,symbol:string,detail:string,score:double>>"
# What a finding of a kind advises.
ACTIONS = {
    "exact_clone": "Merge duplicate implementations behind one canonical helper, then redirect callers.",
    "near_clone": "Inspect both implementations and extract a shared helper or delete the weaker copy.",
    "type_shape_duplicate": "Replace parallel DTO/type aliases with a shared canonical type or explicitly document why the duplication is intentional.",
    "cycle": "Break the cycle by extracting an interface boundary or relocating shared contracts to a lower layer.",
    "package_cycle": "Reassign ownership so package dependencies flow in one direction only.",
    "dead_code": "Delete the export, move it behind a lazy boundary, or add the real entrypoint to the configuration.",
    "api_changed": "Update callers, add compatibility shims, or refresh the API baseline intentionally.",
    "api_removed": "Restore the export, add a migration path, or intentionally refresh baseline after updating dependents.",
    "session_conflict": "Coordinate ownership before applying edits, or narrow both sessions to disjoint subgraphs.",
}


def rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warn", 1).otherwise(0)


def named(severity_rank: Column) -> Column:
    return F.when(severity_rank == 2, "error").when(severity_rank == 1, "warn").otherwise("info")


def finding(df: DataFrame, kind: str, key: Column, target: Column, *more: str) -> DataFrame:
    return df.select(*more, F.concat_ws(":", F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), "severity", F.col("confidence").cast("double").alias("confidence"), target.cast("string").alias("target"))


def detailed(df: DataFrame, kind: str, key: Column, target: Column, files: Column, symbols: Column, action: Column, evidence: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Findings with the files that they touch, their symbols, the advice and up to four pieces of evidence."""
    strings = "array<string>"
    proof = F.slice(evidence, 1, 4) if evidence is not None else F.array()
    return df.select(
        *more, F.concat_ws(":", F.lit(kind), key).alias("id"), F.lit(kind).alias("kind"), "severity", F.col("confidence").cast("double").alias("confidence"), target.cast("string").alias("target"),
        F.array_sort(F.array_distinct(files)).cast(strings).alias("files"), symbols.cast(strings).alias("symbols"), action.alias("action"), proof.cast(EVIDENCE).alias("evidence"),
    )


def proof(kind: str, file: Column, symbol: Column, detail: Column, score: Column) -> Column:
    """One piece of evidence."""
    return F.struct(F.lit(kind).alias("kind"), file.alias("file"), symbol.alias("symbol"), detail.alias("detail"), score.cast("double").alias("score"))


def pair_key(left: Column, right: Column) -> Column:
    """One key for two lists of names, whichever comes first."""
    return F.array_join(F.array_sort(F.concat(left, right)), "|")


def order() -> list[Column]:
    return [F.desc(rank(F.col("severity"))), F.desc("confidence"), F.asc("id")]


def ranked(found: DataFrame) -> DataFrame:
    """``found`` in canonical order with its ``position``, of neighbours with one id the first only.

    Neighbours may differ in severity and confidence; equal ids with another finding between them both stay.  The order is cut
    into ranges, the last row of each is carried to the next, and positions are totals of ranges and places in them.  Rows are shuffled
    into their range and read once from there; only a row per range is carried.
    A row with a number in the column ``PAIRS``, if there is one, stands for as many and ends at its position.
    """
    rest = [c for c in found.columns if c not in ("id", "severity", "confidence")]
    in_order = [F.desc("__rank"), F.desc("confidence"), F.asc("id"), F.asc("severity")]
    rows = ranges.spread(found.withColumn("__rank", rank(F.col("severity"))), in_order)
    # The unnamed columns decide between rows that are equal in the order; equal rows share a range and are folded there.
    one = rows.repartition(ranges.RANGE).groupBy(ranges.RANGE, "__rank", "confidence", "id", "severity").agg(F.min(F.struct(*rest)).alias("__rest"))
    many = F.col(f"__rest.{PAIRS}") if PAIRS in rest else F.lit(None).cast("long")
    here = Window.partitionBy(ranges.RANGE).orderBy(*in_order)
    again = F.coalesce(F.col("id") == F.lag("id").over(here), F.lit(False)) & many.isNull()
    scanned = one.withColumns({"__again": again, "__n": F.row_number().over(here)}).where("NOT __again").drop("__again")
    stands_for = F.coalesce(many, F.lit(1))
    kept_ = graph.kept(scanned.withColumn("__here", F.sum(stands_for).over(here.rowsBetween(Window.unboundedPreceding, 0))))
    # A row per range: whether its first row repeats the last id of the range before, and how many stand before it.
    ends = kept_.groupBy(ranges.RANGE).agg(F.sum(stands_for).alias("all"), F.min_by(F.struct("id", many.isNull().alias("one")), "__n").alias("first"), F.max_by(F.struct("id"), "__n").alias("last"))
    over = Window.partitionBy(F.lit(0)).orderBy(ranges.RANGE)
    met = F.coalesce(F.col("first.one") & (F.col("first.id") == F.lag("last.id").over(over)), F.lit(False)).cast("int")
    ends = ends.withColumn("__met", met).withColumn("__before", F.coalesce(F.sum(F.col("all") - F.col("__met")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = kept_.join(F.broadcast(graph.kept(ends.select(ranges.RANGE, "__met", "__before"))), ranges.RANGE).where("__n > __met")
    position = (F.col("__here") - F.col("__met") + F.col("__before")).cast("long").alias("position")
    return out.select(*[F.col(f"__rest.{c}").alias(c) if c in rest else F.col(c) for c in found.columns], position)


def ranked_with(found: DataFrame, conflicts, as_findings, common: bool = False) -> DataFrame:
    """``ranked`` of ``found`` and the findings of ``conflicts`` (sessions.Conflicts), of which none is sorted.

    ``as_findings`` makes findings of rows of conflicts, with more columns if named; their ids are session_conflict:a:b, and no other
    id begins so.  Pairs of one first session, severity and confidence then stand together in the order: one row stands for them
    among the other findings, and the task that finds the pairs numbers them on.
    """
    if not conflicts.numberable():
        return ranked(found.unionByName(as_findings(conflicts.rows(common))))
    placed, starts = _placed(found, conflicts)
    pairs = as_findings(conflicts.numbered(starts, common), "position")
    return placed.where(F.col(PAIRS).isNull()).drop(PAIRS).unionByName(pairs)


def _placed(found: DataFrame, conflicts) -> tuple[DataFrame, DataFrame]:
    """``found`` ranked among groups of conflicts, and the conflicts' tallies with the position before each group's first."""
    tallies = graph.kept(conflicts.tallies())
    group = F.concat(F.lit("session_conflict:"), F.col("a").cast("string"), F.lit(":"))
    groups = tallies.groupBy(group.alias("id"), "severity", "confidence").agg(F.sum("pairs").alias(PAIRS))
    placed = ranked(found.unionByName(groups, allowMissingColumns=True))
    starts = placed.where(F.col(PAIRS).isNotNull()).select(F.col("id").alias("__id"), "severity", "confidence", (F.col("position") - F.col(PAIRS)).alias("start"))
    return placed, tallies.withColumn("__id", group).join(starts, ["__id", "severity", "confidence"]).select("a", "overlap", "n", "marked", "confidence", "start")


def distinct_with(found: DataFrame, conflicts) -> DataFrame:
    """What ``distinct`` leaves of ``found`` where the findings of ``conflicts`` stand among them; their ids are as in ``ranked_with``."""
    return _placed(found, conflicts)[0].where(F.col(PAIRS).isNull()).drop(PAIRS, "position")


def distinct(found: DataFrame) -> DataFrame:
    """Findings without those that stand beside an equal id in canonical order."""
    return ranked(found).drop("position")


def _first(found: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows in the order of ``ranked``, before any is folded; a task keeps as many."""
    rest = [c for c in found.columns if c not in ("id", "severity", "confidence")]
    return found.orderBy(*order(), F.asc("severity"), F.asc(F.struct(*rest))).limit(rows)


def top(found: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` findings in canonical order without equal neighbours, numbered, and whether more were cut.

    What stays of the order's beginning does not depend on what follows, so only a beginning is sorted, and a longer one
    where neighbours of equal id leave too few.
    """
    rows = 4 * limit + 64
    while True:
        part = graph.kept(_first(found, rows))
        whole = graph.kept(ranked(part))
        more = whole.count() > limit
        if more or part.count() < rows:
            break
        rows *= 8
    kept_ = [c for c in [*COLUMNS, *DETAILS] if c in found.columns]
    return shown(whole.where(F.col("position") <= limit).select(*kept_, "position", F.lit(more).alias("truncated")))


def shown(found: DataFrame, most: int = 12) -> DataFrame:
    """``found`` as it is displayed: of a session conflict's files the first ``most``.  Filters see the whole lists."""
    if "files" not in found.columns:
        return found
    return found.withColumn("files", F.when(F.col("kind") == "session_conflict", F.slice("files", 1, most)).otherwise(F.col("files")))


def count(found: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """One row (total): how many findings ``distinct`` leaves of ``found`` and ``single``, counted without sorting them.

    Of equal rank and confidence an id counts once; where the greatest id of one confidence is the least of the next, the two are
    neighbours and count once.  A missing id counts with each severity.  ``single`` are findings whose ids come once in all, none missing.
    """
    cut = lambda df: df.select(rank(F.col("severity")).alias("r"), F.col("confidence").cast("double").alias("c"), "id", "severity")
    often = cut(found).groupBy("r", "c", "id", F.when(F.col("id").isNull(), F.col("severity")).alias("s")).agg(F.lit(1).alias("one"))
    ends = [F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("none")]
    groups = often.groupBy("r", "c").agg(*ends)
    if single is not None:
        groups = groups.union(cut(single).groupBy("r", "c").agg(*ends))
    groups = groups.groupBy("r", "c").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("none").alias("none"))
    # A missing id stands first, so it parts its group from the one before.
    before = F.lag("high").over(Window.orderBy(F.desc("r"), F.desc("c")))  # a row per rank and confidence
    joined = groups.withColumn("met", (before == F.col("low")) & (F.col("none") == 0))
    return joined.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count_if("met")).cast("long").alias("total"))


def omitted(found: DataFrame, limit: int, single: DataFrame | None = None) -> DataFrame:
    """One row: how many findings there are, how many of them ``top`` returns and how many it leaves out; ``single`` as in ``count``."""
    total = count(found, single)
    shown = F.least("total", F.lit(limit))
    return total.select("total", shown.alias("shown"), (F.col("total") - shown).alias("omitted"), (F.col("total") > limit).cast("long").alias("truncated_outputs"))


def touching(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings with a file among ``paths`` (path)."""
    hit = found.select("id", F.explode("files").alias("path")).join(paths.select("path").distinct(), "path", "left_semi").select("id").distinct()
    return found.join(hit, "id", "left_semi")


def of_kinds(found: DataFrame, *kinds: str) -> DataFrame:
    return found.where(F.col("kind").isin(*kinds))


def at_least(found: DataFrame, severity: str = "info", confidence: float = 0.0) -> DataFrame:
    """Findings that are as severe and as certain as asked for."""
    return found.where((rank(F.col("severity")) >= rank(F.lit(severity))) & (F.col("confidence") >= confidence))


def without_evidence(found: DataFrame) -> DataFrame:
    return found.withColumn("evidence", F.array().cast(EVIDENCE))


def files_of(found: DataFrame, fallback: DataFrame | None = None, most: int = 12) -> DataFrame:
    """(path): the first ``most`` files of the findings by name; without any, those of ``fallback`` (path)."""
    own = found.select(F.explode("files").alias("path")).distinct().orderBy("path").limit(most)
    if fallback is None:
        return own
    none = own.agg(F.count("*").alias("n")).where("n = 0")
    return own.union(fallback.select("path").distinct().orderBy("path").limit(most).crossJoin(F.broadcast(none)).select("path"))  # none: one row or no row


def findings_limit(asked: int, configured: int) -> int:
    """Findings to return: 0 asks for the configured number, which is also the most; one at least."""
    return max(1, min(asked or configured, max(1, configured)))


def files_limit(asked: int | None, configured: int) -> int:
    """Files to return: 50 unless asked, one at least, and at most the configured findings or 200."""
    return min(max(1, 50 if asked is None else asked), max(configured, 200))


# Points for each, most points, number from which it is a warning (None: never by number), severity.
REASONS = {
    "dependency_cone": (4, 30, 8, None),
    "reverse_dependents": (8, 30, 4, None),
    "public_exports": (10, 30, None, "warn"),
    "dynamic_imports": (10, 20, None, "warn"),
    "api_drift": (20, 40, None, "error"),
    "cycles": (15, 30, None, "warn"),
    "session_conflicts": (20, 40, None, "error"),
    "nearby_findings": (6, 18, None, "warn"),
}


def reasons(counts: DataFrame) -> DataFrame:
    """``counts`` (kind, n, and if known highest, the rank of the worst finding counted) with score and severity, without kinds that count nothing."""
    score, severity = F.lit(None).cast("long"), F.lit("info")
    for kind, (each, most, warn_at, fixed) in REASONS.items():
        here = F.col("kind") == kind
        score = F.when(here, F.least(each * F.col("n"), F.lit(most))).otherwise(score)
        severity = F.when(here, F.lit(fixed) if fixed else F.when(F.col("n") >= warn_at, "warn").otherwise("info")).otherwise(severity)
    if "highest" in counts.columns:
        severity = F.when(F.col("highest").isNotNull(), named(F.col("highest"))).otherwise(severity)
    return counts.where("n > 0").select("kind", F.col("n").cast("long").alias("n"), score.cast("long").alias("score"), severity.alias("severity"))


def reason_order() -> list[Column]:
    return [F.desc(rank(F.col("severity"))), F.desc("score"), F.asc("kind")]


def in_order(found: DataFrame) -> DataFrame:
    """Reasons, of which there are eight at most, with their place: severity, then score, then kind."""
    return found.withColumn("position", F.row_number().over(Window.orderBy(*reason_order())).cast("long"))


def risk(found: DataFrame) -> DataFrame:
    """One row: score capped at 100 and its level."""
    total = found.agg(F.least(F.coalesce(F.sum("score"), F.lit(0)), F.lit(100)).cast("long").alias("score"), F.count("*").alias("reasons"))
    return total.withColumn("level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def safe_to_edit(total: DataFrame, strict: bool = True) -> DataFrame:
    """``total`` of ``risk`` with safe_to_edit: the level is low, or, unless ``strict``, not high."""
    return total.withColumn("safe_to_edit", F.col("level") == "low" if strict else F.col("level") != "high")


def first_ids(found: DataFrame, reason: Column, most: int = FIRST_IDS) -> DataFrame:
    """(kind, finding_ids): for each ``reason`` of findings the first ``most`` ids in canonical order; a task keeps ``most`` rows of each."""
    nth = F.row_number().over(Window.partitionBy("__reason").orderBy(*order()))
    first = found.withColumn("__reason", reason).where("__reason IS NOT NULL").withColumn("__nth", nth).where(F.col("__nth") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("__nth", "id"))), lambda x: x["id"])  # ``most`` at most
    return first.groupBy(F.col("__reason").alias("kind")).agg(ids.alias("finding_ids"))


def focus(points: DataFrame, limit: int) -> DataFrame:
    """``points`` (target, kind, severity, score) by target: worst severity, capped score, kinds, confidence; the first ``limit``.

    Where points have ``position``, ``n`` and ``finding_ids``, a target also gets evidence of its first four reasons and the distinct
    ids of all of them; a target has a point per reason, eight at most.
    """
    more = []
    if "position" in points.columns:
        said = F.format_string("%d counted as %s", "n", "kind")
        shown_ = F.struct("position", proof("graph_edge", F.col("target"), F.lit(None).cast("string"), said, F.col("score")).alias("proof"))
        more = [F.slice(F.transform(F.array_sort(F.collect_list(shown_)), lambda x: x["proof"]), 1, 4).cast(EVIDENCE).alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("finding_ids", F.array().cast("array<string>")))))).alias("finding_ids")]
    out = points.groupBy("target").agg(
        F.max(rank(F.col("severity"))).alias("severity_rank"), F.least(F.sum("score"), F.lit(100)).cast("long").alias("score"),
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), *more,
    )
    out = out.withColumn("confidence", F.round(F.least(F.lit(0.99), 0.5 + F.least("score", F.lit(50)) / 100), 6))
    return out.orderBy(F.desc("severity_rank"), F.desc("score"), "target").limit(limit)
