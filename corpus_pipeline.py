"""Training-corpus pipeline: language, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``docs``.  Rows with nulls, empty texts, repeated rows and further columns pass as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import curriculum, decontaminate, langid, neardup, sharding
from strandmill.llm.scratch import save
from strandmill.ship import ship


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no language model accepts: without a letter, or unlike any learnt language."""
    ship(spark)
    models = langid.fit(docs, "text", "lang")
    named = {c: f"__sm_{c}" for c in ("lang_pred", "score", "cross_entropy", "rejected") if c in docs.columns}
    found = langid.identify(docs.withColumnsRenamed(named), "text", models)
    kept = found.where(~F.col("rejected")).drop("lang_pred", "score", "cross_entropy", "rejected")
    return kept.withColumnsRenamed({v: k for k, v in named.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every near-duplicate component; of rows with that id, one by text and columns."""
    ship(spark)
    return neardup.keep_one(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, "text", items, "item_id", "text").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, range-sorted by training position."""
    ship(spark)
    mixed = curriculum.curriculum(docs.withColumn("__sm_size", curriculum.words_in(F.col("text"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return curriculum.in_training_order(mixed, parts).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard (0 to 23) and slot."""
    ship(spark)
    return sharding.external_shuffle(docs, "doc_id", 24)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The near-duplicate, language and mixing stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
