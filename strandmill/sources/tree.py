"""Source trees as tables: scan with filters and digests, lockfiles, findings baselines, config."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.paths import glob_pattern

# What a scan takes and leaves.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts")
IGNORE = (
    "node_modules/**", "**/node_modules/**", ".opencode/**", "dist/**", "**/dist/**", "build/**", ".next/**", "coverage/**",
    "**/*.generated.ts", "**/*.generated.tsx", "**/*.gen.ts", "**/*.gen.tsx",
)
LOCKFILES = ("bun.lock", "bun.lockb", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock")
KINDS = ("semantic_clone", "type_shape_duplicate", "api_drift", "dead_code", "cycle", "session_conflict")


def scan(spark: SparkSession, root: str, ignore=IGNORE) -> DataFrame:
    """(path, source, digest, mtime_ms, size_bytes) of the code files below ``root``, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = re.escape(re.sub(r"^file:/*", "/", root).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}/", "")
    out = files.select(rel.alias("path"), F.decode("content", "UTF-8").alias("source"), F.sha2("content", 256).alias("digest"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size_bytes"))
    return out.where(~F.col("path").rlike(glob_pattern(list(ignore))))


def lockfiles(spark: SparkSession, root: str) -> DataFrame:
    """(name, digest, size_bytes, position) of the known lockfiles at ``root``."""
    found = spark.read.format("binaryFile").load(root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size_bytes"))
    return found.where(F.col("name").isin(*LOCKFILES)).withColumn("position", F.array_position(F.array(*map(F.lit, LOCKFILES)), F.col("name")))


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, problems (place, problem)) of a baseline document, checked field by field.

    A document that is no object, of another version, without a time in numbers or without a list has one problem; of the list
    every finding with a wrong field has one, its first.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = lambda c: F.schema_of_variant(c)
    get = lambda v, name, type_: F.try_variant_get(v, f"$.{name}", type_)
    version, when = F.try_variant_get("v", "$.version", "variant"), F.try_variant_get("v", "$.generatedAtUnixMs", "variant")
    numbers = r"^(BIGINT|DOUBLE|DECIMAL)"
    whole = (
        F.when(F.col("v").isNull() | ~kind(F.col("v")).startswith("OBJECT"), "must be an object")
        .when(~F.coalesce(kind(version).rlike(numbers) & (F.try_variant_get("v", "$.version", "double") == 1), F.lit(False)), "unsupported version")
        .when(~F.coalesce(kind(when).rlike(numbers), F.lit(False)), "generatedAtUnixMs must be a number")
        .when(~F.coalesce(kind(F.try_variant_get("v", "$.findings", "variant")).startswith("ARRAY"), F.lit(False)), "findings must be an array")
    )
    checked = doc.withColumn("problem", whole)
    each = checked.where("problem IS NULL").select(F.posexplode(F.try_variant_get("v", "$.findings", "array<variant>")).alias("n", "f"))
    text = lambda name: F.coalesce(kind(F.try_variant_get("f", f"$.{name}", "variant")) == "STRING", F.lit(False))
    problem = (
        F.when(F.col("f").isNull() | ~kind(F.col("f")).startswith("OBJECT"), "must be an object")
        .when(~text("id"), "id must be a string")
        .when(~text("kind") | ~F.coalesce(get("f", "kind", "string").isin(*KINDS), F.lit(False)), "kind is invalid")
        .when(~text("severity") | ~F.coalesce(get("f", "severity", "string").isin("info", "warn", "error"), F.lit(False)), "severity is invalid")
        .when(~text("action"), "action must be a string")
    )
    rows = each.select("n", problem.alias("problem"), *[get("f", c, "string").alias(c) for c in ("id", "kind", "severity", "action")])
    problems = checked.where("problem IS NOT NULL").select(F.lit("$").alias("place"), "problem").union(rows.where("problem IS NOT NULL").select(F.format_string("$.findings[%d]", "n"), "problem"))
    return rows.where("problem IS NULL").select("id", "kind", "severity", "action"), problems


def baseline(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Findings of a baseline document; one with a problem as a whole is an error.

    ``strict``: a finding with a problem is an error too, that names the first; else such findings are read as they are.
    """
    found, problems = read_baseline(spark, path)
    wrong = problems if strict else problems.where("place = '$'")
    if first := wrong.orderBy("place").first():
        raise ValueError(f"baseline {first.place}: {first.problem}")
    if strict:
        return found
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.findings", "array<variant>")).alias("f"))
    return doc.select(*[F.try_variant_get("f", f"$.{c}", "string").alias(c) for c in ("id", "kind", "severity", "action")])


def write_baseline(found: DataFrame, path: str, now_ms: int) -> None:
    rows = found.select(F.struct("id", "kind", "severity", F.coalesce("action", F.lit("")).alias("action")).alias("f")).orderBy("f.id")
    rows.agg(F.collect_list("f").alias("findings")).select(F.lit(1).alias("version"), F.lit(now_ms).alias("generatedAtUnixMs"), "findings").coalesce(1).write.json(path)


def load_config(text: str) -> dict:
    """JSON with comments and trailing commas."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept))
