"""Clone detection on token fingerprints: exact buckets, SimHash lanes, banded candidates, near misses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.md5 import halves
from strandmill.operators.graph import kept

MIN_TOKENS, SHINGLE, LANES, LANE_BITS = 24, 5, 4, 16
#: Rows of one lane value that meet in one task; more are cut into parts.
LANE_ROWS = 2048
MIN_JACCARD, MIN_RATIO, MIN_CONFIDENCE = 0.72, 0.6, 0.78


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def fingerprints(files: DataFrame, key: str, text: str, group: str, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, grp, tokens, n_tokens, hash) of the texts with enough tokens."""
    # A generated column: the condition on its size is not moved below it, where it would cut each text into tokens once more.
    out = files.select(F.col(key).alias("id"), F.col(group).alias("grp"), F.explode(F.array(word_tokens(F.col(text)))).alias("tokens"))
    out = out.withColumn("n_tokens", F.size("tokens").cast("long")).where(F.col("n_tokens") >= min_tokens)
    return out.withColumn("hash", F.sha2(F.array_join("tokens", " "), 256))


def exact_buckets(prints: DataFrame) -> DataFrame:
    """Buckets of at least two members with one hash; more than two groups make it an error."""
    out = prints.groupBy("hash").agg(
        F.countDistinct("id").alias("members"),
        F.countDistinct("grp").alias("groups"),
        F.min("id").alias("first_id"),
        F.max("n_tokens").alias("n_tokens"),
    )
    return out.where("members >= 2").withColumn("severity", F.when(F.col("groups") > 2, "error").otherwise("warn"))


def shingles(tokens: Column) -> Column:
    """Sliding runs of SHINGLE tokens; fewer tokens make one run."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, SHINGLE), " "))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))


def simhash(prints: DataFrame, *more: str) -> DataFrame:
    """(id, l0 .. l3, more): sixteen bits each of the signed vote over shingle hashes; a tie sets the bit.

    The lanes are the first 64 bits of each shingle's MD5; a text's votes are counted in its task, so no shingle is shuffled.
    Tokens hold no blanks.
    """

    def lanes_of(texts: pa.Array) -> np.ndarray:
        """A row of lanes for each text."""
        raw = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        some = np.diff(offsets) > 0
        blanks = np.flatnonzero(data == 32)
        starts, ends = np.sort(np.concatenate([offsets[:-1][some], blanks + 1])), np.sort(np.concatenate([offsets[1:][some], blanks]))
        tokens = np.diff(np.searchsorted(blanks, offsets)) + some
        runs = np.where(some, np.maximum(tokens - (SHINGLE - 1), 1), 0)
        text = np.repeat(np.arange(len(runs)), runs)
        until = np.cumsum(tokens)
        first = np.arange(len(text)) + np.repeat(until - tokens - (np.cumsum(runs) - runs), runs)
        ones = np.zeros((len(runs), LANES * LANE_BITS), np.int64)
        for at, digests in halves(data, starts[first], ends[np.minimum(first + SHINGLE, until[text]) - 1]):
            here = text[at : at + len(digests)]
            new = np.flatnonzero(np.diff(here, prepend=-1))
            ones[here[new]] += np.add.reduceat(np.unpackbits(digests, axis=1), new, axis=0, dtype=np.int64)
        return np.packbits(2 * ones >= runs[:, None], axis=1).view(">u2").astype(np.int32)  # lane k holds the bits from 16 k on, the highest first

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                found = lanes_of(part.column(1))
                lanes = [pa.array(found[:, k]) for k in range(LANES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lanes, *part.columns[2:]], names=["id", *names, *more])

    names = [f"l{k}" for k in range(LANES)]
    kinds = [f"{c} {prints.schema[c].dataType.simpleString()}" for c in ("id", *more)]
    schema = ", ".join([kinds[0], *[f"{c} int" for c in names], *kinds[1:]])
    return prints.select("id", F.array_join("tokens", " ").alias("text"), *more).mapInArrow(run, schema)


def representative_hashes(prints: DataFrame) -> DataFrame:
    """(id, l0 .. l3) of the smallest id of each hash, written: texts are hashed where they are read, and only lanes are shuffled."""
    lanes = [f"l{k}" for k in range(LANES)]
    best = simhash(prints, "hash").groupBy("hash").agg(F.min(F.struct("id", *lanes)).alias("r"))
    return kept(best.select("r.id", *[f"r.{c}" for c in lanes]))


def distinct_representatives(prints: DataFrame) -> DataFrame:
    """One row per hash, the smallest id; ``members`` says which ids it stands for."""
    rest = [c for c in prints.columns if c != "hash"]
    best = prints.groupBy("hash").agg(F.min_by(F.struct(*rest), "id").alias("r"))
    return best.select(*[F.col(c) if c == "hash" else F.col(f"r.{c}").alias(c) for c in prints.columns])


def members(prints: DataFrame) -> DataFrame:
    """(id, representative) of every text with enough tokens: with it, pairs of representatives stand for all pairs."""
    best = prints.groupBy("hash").agg(F.min("id").alias("representative"))
    return prints.select("id", "hash").distinct().join(best, "hash").select("id", "representative")


def between_members(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) of representatives as pairs of all their members, the smaller id first."""
    of = members(prints)
    x, y = of.select(F.col("id").alias("x"), F.col("representative").alias("a")), of.select(F.col("id").alias("y"), F.col("representative").alias("b"))
    both = pairs.join(x, "a").join(y, "b").where("x <> y")
    return both.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")}).drop("x", "y")


def _meetings(hashes: DataFrame, lane_rows: int) -> DataFrame:
    """Pairs x, y (x.id < y.id) of rows (id, l0 .. l3) that share a lane, each in the first lane that they share.

    Equal lane values of different lanes do not meet: the band number is part of the key.  A lane value of more than
    ``lane_rows`` rows is cut into parts that meet pairwise, so no task holds all of it.
    """
    lanes = [f"l{k}" for k in range(LANES)]
    bands = hashes.select("id", *lanes, F.posexplode(F.array(*lanes)).alias("band", "value"))
    often = bands.groupBy("band", "value").agg(F.count("*").alias("m")).where(F.col("m") > lane_rows)
    often = often.select("band", "value", F.ceil(F.col("m") / lane_rows).cast("int").alias("parts"))
    cut = bands.join(F.broadcast(often), ["band", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    facing = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = cut.select("*", facing.alias("facing")).withColumnsRenamed({"part": "px", "facing": "py"}).alias("x")
    y = cut.select("*", facing.alias("facing")).withColumnsRenamed({"part": "py", "facing": "px"}).alias("y")
    met = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "value", "px", "py")]).where("x.id < y.id")
    earlier = [(F.col("x.band") > k) & (F.col(f"x.l{k}") == F.col(f"y.l{k}")) for k in range(LANES - 1)]
    return met.where(~(earlier[0] | earlier[1] | earlier[2]))


def band_candidates(hashes: DataFrame, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Distinct pairs (a < b) that share the value of at least one lane."""
    return _meetings(hashes, lane_rows).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def hamming(left: str, right: str) -> Column:
    return sum((F.bit_count(F.col(f"{left}.l{k}").bitwiseXOR(F.col(f"{right}.l{k}"))) for k in range(LANES)), F.lit(0))


def near_misses(prints: DataFrame, radius: int, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Pairs with different hashes within ``radius`` bits, with token overlap, size ratio and confidence.

    Pairs of representatives: ``between_members`` makes them the pairs of all texts.
    """
    pairs = _meetings(representative_hashes(prints), lane_rows).withColumn("hamming", hamming("x", "y")).where(F.col("hamming") <= radius)
    pairs = kept(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "hamming"))
    # Only texts that stand in a pair are read again.
    met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    reps = distinct_representatives(prints.join(met, "id", "left_semi"))
    sets = kept(reps.select("id", F.array_distinct("tokens").alias("kinds"), "n_tokens"))
    x, y = sets.alias("x"), sets.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    shared = F.size(F.array_intersect("x.kinds", "y.kinds"))
    jaccard = shared / (F.size("x.kinds") + F.size("y.kinds") - shared)
    ratio = F.least("x.n_tokens", "y.n_tokens") / F.greatest("x.n_tokens", "y.n_tokens")
    both = both.withColumns({"jaccard": jaccard, "ratio": ratio})
    both = both.withColumn("confidence", (1 - F.col("hamming") / 64) * 0.55 + F.col("jaccard") * 0.45)
    passed = both.where((F.col("jaccard") >= MIN_JACCARD) & (F.col("ratio") >= MIN_RATIO) & (F.col("confidence") >= MIN_CONFIDENCE))
    return passed.select("a", "b", F.col("hamming").cast("long").alias("hamming"), F.round("jaccard", 6).alias("jaccard"), F.round("ratio", 6).alias("ratio"), F.round("confidence", 6).alias("confidence"))
