"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters records by a seeded hash into buckets of about ``bucket_bytes``, small enough for one
task's memory.  Pass two shuffles each bucket by Fisher-Yates: a fold over the swap positions
``n-1 .. 1`` whose draws are seeded hashes of (seed, bucket, position), so a lost task repeats the same
permutation; since the fold copies its array of places for every swap, a bucket has about ``bucket_rows`` rows at most.
Bucket offsets turn the place inside a bucket into a global place; place modulo the number of shards is the shard, so shard
sizes differ by one row at most (law ``rows``), and the quotient is the slot, gapless from 0.  ``write_shards``
writes each bucket's records where they belong.

Rows with equal keys are told apart by a hash of their other columns.  Rows equal in all columns are interchangeable
and share a bucket; those with more copies than an eighth of a bucket's rows are folded into one row with a count and dealt out
again by their number, so that repeats, however many, fill no bucket.  (With a map or variant column, rows cannot be
compared and are not folded.)

Nulls: a null id hashes like the text ``null``; a null text counts as none.  Repeated rows each get a
slot of their own.  An empty table gives an empty result.  Columns named ``shard`` or ``slot`` are replaced, others
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.prefix import bin_offsets
from strandmill.llm.scratch import fresh_path, save

BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 2048
#: Repeated rows that are broadcast to tell them from the others; more are joined.
BROADCAST_ROWS = 200_000
#: Buckets whose permutations a task makes.
BUCKETS = 16
#: Copies of a row that one task makes.
COPIES = 4096


def _draw(seed: int, bucket: Column, i: Column, bound: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), bucket, i), bound.cast("long")).cast("int")


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """Permutation of 0 .. n-1 as an array; ``n`` is the bucket's number of rows."""
    start = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def swap(a: Column, i: Column) -> Column:
        j = _draw(seed, bucket, i, i + 1)
        at = lambda k: F.element_at(a, k + 1)
        cut = lambda x, y: F.slice(a, x + 1, y - x)  # noqa: E731  from x up to y, y excluded
        moved = F.concat(cut(F.lit(0), j), F.array(at(i)), cut(j + 1, i), F.array(at(j)), F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))))
        return F.when(j == i, a).otherwise(moved)

    steps = F.when(n > 1, F.sequence(n.cast("int") - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def _bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts and binaries, and 8 for every other column."""
    sized = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return sum(sized[1:], sized[0]).cast("long")


def _numbered(df: DataFrame, key: str, tie: Column, times: DataFrame) -> DataFrame:
    """``df`` with __sm_key, __sm_tie and __sm_copy: for the rows of ``times`` (__sm_key, __sm_tie, ...) their number among equal rows, else 0."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    whole = df.withColumns({"__sm_key": name, "__sm_tie": tie})
    single = whole.withColumn("__sm_copy", F.lit(0).cast("long"))
    repeats = times.select("__sm_key", "__sm_tie")
    if not repeats.limit(1).count():
        return single
    few = repeats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = F.broadcast(repeats) if few else repeats
    on = ["__sm_key", "__sm_tie"]
    folded = whole.join(known, on, "left_semi").groupBy(*df.columns, *on).agg(F.count("*").alias("__sm_n"))
    parts = folded.withColumn("__sm_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__sm_n") - 1) / COPIES))))
    spread = parts.repartition(*on, "__sm_part")
    first = F.col("__sm_part") * COPIES
    copies = spread.withColumn("__sm_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("__sm_n")) - 1)))
    return single.join(known, on, "left_anti").select(*df.columns, *on, "__sm_copy").union(copies.select(*df.columns, *on, "__sm_copy"))


def external_shuffle(df: DataFrame, key: str, n_shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a seeded uniform permutation dealt to ``n_shards`` shards.

    The number of buckets comes from the table's rows and bytes, so a bucket keeps its size at any scale.
    """
    tie = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith(("map", "variant"))])
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    light = save(df.select(name.alias("__sm_key"), tie.alias("__sm_tie"), _bytes(df).alias("__sm_bytes")), "sharding-light")
    n, size = light.agg(F.count("*"), F.sum("__sm_bytes")).first()
    n_buckets = max(1, -(-n // bucket_rows), -(-(size or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "__sm_key", "__sm_tie", "__sm_copy"), F.lit(n_buckets))
    alike = light.groupBy("__sm_key", "__sm_tie").agg(F.count("*").alias("c"))
    mapped = any(k in kind for _, kind in df.dtypes for k in ("map<", "variant"))
    most = F.lit(max(1, bucket_rows // 8))
    often = save(alike.where(F.lit(not mapped) & (F.col("c") > most)), "sharding-often")
    whole = _numbered(df, key, tie, often).withColumn("__sm_bucket", bucket)

    parts = often.withColumn("__sm_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES))))
    first = F.col("__sm_part") * COPIES
    each = parts.select("__sm_key", "__sm_tie", F.explode(F.sequence(first, F.least(first + COPIES, F.col("c")) - 1)).alias("__sm_copy"), F.lit(1).cast("long").alias("c"))
    rest = alike.where(F.lit(mapped) | (F.col("c") <= most)).select("__sm_key", "__sm_tie", F.lit(0).cast("long").alias("__sm_copy"), "c")
    counts = rest.union(each).groupBy(bucket.alias("__sm_bucket")).agg(F.sum("c").alias("__sm_n"))
    counts = save(counts, "sharding-buckets").withColumn("__sm_all", F.lit(0))
    places = bin_offsets(counts, ["__sm_all"], "__sm_bucket", "__sm_n", "__sm_before")
    perm = fisher_yates(F.col("__sm_n"), seed + 1, F.col("__sm_bucket"))
    # Buckets are few bytes and much work: a fixed number of tasks shares them, whatever their size, and what they give is written.
    tasks = max(1, -(-n_buckets // BUCKETS))
    perms = save(places.repartition(tasks, "__sm_bucket").select("__sm_bucket", "__sm_before", perm.alias("__sm_perm")), "sharding-perms")

    in_bucket = Window.partitionBy("__sm_bucket").orderBy("__sm_key", "__sm_tie", "__sm_copy")
    ranked = whole.withColumn("__sm_rank", F.row_number().over(in_bucket))
    place = F.col("__sm_before") + F.element_at("__sm_perm", F.col("__sm_rank"))
    placed = ranked.join(perms, "__sm_bucket").withColumn("__sm_place", place)
    shard = F.pmod("__sm_place", F.lit(n_shards)).cast("int")
    slot = F.floor(F.col("__sm_place") / n_shards).cast("long")
    return placed.select(*[F.col(c) for c in df.columns if c not in ("shard", "slot")], shard.alias("shard"), slot.alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard.  A task writes the rows of its buckets, in slot order, without another shuffle."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, like: DataFrame) -> DataFrame:
    """The shards at ``path`` as a table with the columns of ``like``."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shuffled = external_shuffle(docs, "doc_id", 24)
    path = fresh_path(spark, "shards")
    write_shards(shuffled, path)
    text = F.coalesce("text", F.lit(""))
    return read_shards(spark, path, shuffled).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
