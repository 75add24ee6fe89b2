"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source owns a piecewise-linear weight schedule over training time t in [0, 1].  Its integral is
the source's cumulative share of demand.  A source's documents form a stream in seeded hash order, and a
document copy sits at one place of the stream, counted in words; inverting the integral at that
place gives the copy's training position, by which the mix is range-sorted.

Targets share ``budget`` times all words by weight; a target stops at ``most`` times its source's words
and the excess is shared again by weight until none is above, which is the level where
sum(min(weight * level, most * size)) meets the budget.

A copy is taken when its middle lies below the target, so a source's taken words differ from the
target by at most half a document per pass.

Nulls: a null source is a source of its own, last in order; a null text has size 0 (never taken).
Repeated rows are separate documents.  An empty table gives an empty mix.  Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.prefix import bin_offsets
from strandmill.llm.scratch import save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BIN_ROWS = 512
# Multipliers of a source's weight at times 0, 1/2 and 1, one row per weight class.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))


def targets(sizes: DataFrame, budget: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` has (source, source_size), one row per source.  Adds weight, class and target.

    The windows run over the sources alone, one row each.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("class", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("class") + 1))
    whole = Window.partitionBy(F.lit(0))
    full = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    # Sources fill up in order of most * size / weight; the level is the first at which the rest does not.
    filled = (
        ranked.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum(most * F.col("source_size")).over(full), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
        .withColumn("level", (budget * F.col("all_words") - F.col("capped")) / F.col("weight_left"))
        .withColumn("open_level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    )
    capped = most * F.col("source_size")
    target = F.when(F.col("ratio") < F.coalesce("open_level", F.lit(float("inf"))), capped).otherwise(F.least(F.col("weight") * F.col("open_level"), capped))
    return filled.select("source", "source_size", "class", "weight", target.cast("double").alias("target"))


def _schedule(kind, schedules):
    """Knots of the normalised integral of a class's weight: array of (t, w, share up to t)."""
    chosen = None
    for k, w in enumerate(schedules):
        step, areas = 1.0 / (len(w) - 1), [0.0]
        for a, b in zip(w, w[1:], strict=False):
            areas.append(areas[-1] + (a + b) / 2 * step)
        knots = F.array(*[F.struct(F.lit(i * step).alias("t"), F.lit(x / areas[-1]).alias("w"), F.lit(areas[i] / areas[-1]).alias("share")) for i, x in enumerate(w)])
        chosen = F.when(kind == k, knots) if chosen is None else chosen.when(kind == k, knots)
    return chosen


def invert(share, knots):
    """Training time at which the integral of the schedule reaches ``share`` (0 to 1)."""
    i = F.least(F.greatest(F.size(F.filter(knots, lambda k: k["share"] <= share)), F.lit(1)), F.size(knots) - 1)
    a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
    slope = (b["w"] - a["w"]) / (b["t"] - a["t"])
    rest = F.greatest(share - a["share"], F.lit(0.0))
    # a.w * x + slope / 2 * x^2 = rest, in the form that holds for slope 0.
    root = F.sqrt(F.greatest(a["w"] * a["w"] + 2 * slope * rest, F.lit(0.0)))
    return F.least(a["t"] + F.when(rest == 0, F.lit(0.0)).otherwise(2 * rest / (a["w"] + root)), F.lit(1.0))


def curriculum(df: DataFrame, seed: int = 7, budget: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES, bin_rows: int = BIN_ROWS, extra=("text",)) -> DataFrame:
    """``df`` (doc_id, source, __sm_size, ...) with __sm_source_size, __sm_target and __sm_at: the training positions
    of the copies that the mix takes (none, one or more).

    Order in a source is that of md5(seed, doc_id, hash of the row), then doc_id.  Hash bins of about ``bin_rows`` rows carry the
    running totals, so a source of any size, and one id of many different rows, is spread over all tasks.
    """
    n_bins = max(1, -(-df.count() // bin_rows))
    tie = F.xxhash64(*[F.col(c) for c in ("doc_id", "source", "__sm_size", *[c for c in extra if c in df.columns])])
    draw = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), tie.cast("string")), "UTF-8"))
    rows = df.withColumns({"__sm_draw": draw, "__sm_tie": tie, "__sm_src": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    # The bin is the draw's leading 52 bits scaled to the number of bins: bins follow the order of draws.
    lead = F.conv(F.substring("__sm_draw", 1, 13), 16, 10).cast("double")
    rows = rows.withColumn("__sm_bin", F.floor(lead / F.lit(2.0**52) * n_bins).cast("long"))

    bins = rows.groupBy("__sm_src", "__sm_bin").agg(F.sum("__sm_size").alias("__sm_words"), F.first("source", ignorenulls=True).alias("__sm_name"))
    bins = save(bins, "mixing-bins")  # a row per bin_rows documents; read for sizes, targets and starts
    sizes = bins.groupBy("__sm_src").agg(F.sum("__sm_words").alias("source_size"), F.first("__sm_name", ignorenulls=True).alias("source"))
    plan = targets(sizes.drop("__sm_src"), budget, most, weights)
    plan = plan.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__sm_src"), F.col("source_size").alias("__sm_source_size"), F.col("target").alias("__sm_target"), F.col("class").alias("__sm_class"))
    starts = bin_offsets(bins.drop("__sm_name"), ["__sm_src"], "__sm_bin", "__sm_words", "__sm_start").drop("__sm_words")
    starts = starts.join(plan, "__sm_src")

    upto = Window.partitionBy("__sm_src", "__sm_bin").orderBy("__sm_draw", "doc_id", "__sm_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__sm_local", F.coalesce(F.sum("__sm_size").over(upto), F.lit(0)))
    placed = local.join(starts, ["__sm_src", "__sm_bin"])
    middle = F.col("__sm_start") + F.col("__sm_local") + F.col("__sm_size") / 2
    passes = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda e: e * F.col("__sm_source_size") + middle)
    taken = F.filter(F.when(F.col("__sm_size") > 0, passes).otherwise(F.array().cast("array<double>")), lambda at: at < F.col("__sm_target"))
    knots = _schedule(F.col("__sm_class"), schedules)
    placed = placed.withColumn("__sm_knots", knots)
    placed = placed.withColumn("__sm_at", F.transform(taken, lambda at: invert(at / F.col("__sm_target"), F.col("__sm_knots"))))
    return placed.select(*df.columns, "__sm_source_size", "__sm_target", "__sm_at")


def words_in(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def in_training_order(mixed: DataFrame, partitions: int) -> DataFrame:
    """One row per copy, range-sorted by training position (column __sm_position)."""
    copies = mixed.withColumn("__sm_position", F.explode("__sm_at"))
    return copies.repartitionByRange(partitions, "__sm_position").sortWithinPartitions("__sm_position", "doc_id")


def op7(spark, sf_dir: str) -> DataFrame:
    """What each document gives to the mix, counted in the range-sorted copies as they were written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    row = F.monotonically_increasing_id().alias("__sm_row")  # tells rows of one id apart
    light = docs.select("doc_id", "source", words_in(F.col("text")).alias("__sm_size"), F.xxhash64("text").alias("__sm_text"), row)
    light = save(light, "mixing-sizes")  # texts are read and counted once
    mixed = save(curriculum(light, extra=("__sm_text",)), "mixing-placed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = save(in_training_order(mixed, parts).select("__sm_row", "__sm_size", "__sm_position"), "mixing-order")
    given = order.groupBy("__sm_row").agg(F.sum("__sm_size").alias("taken"), F.min("__sm_position").alias("first"))
    return mixed.join(given, "__sm_row", "left").select(
        "doc_id",
        F.col("__sm_size").alias("size"),
        F.col("__sm_source_size").cast("long").alias("source_size"),
        F.round("__sm_target", 6).alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.round("first", 9).alias("first_position"),
    )
