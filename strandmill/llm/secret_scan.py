"""Secret scans: pattern matches plus strings that look random, in DataFrame functions only.

Two first-order character models over ``ALPHABET``, one of random strings and one of ordinary
identifiers, are trained from labelled samples and compared by log-likelihood ratio.  A candidate
token whose ratio passes ``threshold`` (natural log) is a secret of kind ``markov``; base patterns always stay.

Labels come from the text itself: what the base patterns match is random, the other long words of all
sampled documents are identifiers.  Training reads about ``sample_docs`` documents, chosen by a hash of their text; the model
has at most two counts per pair of characters, taken over distinct strings.  Everything else reads all documents.

Nulls: a null text is empty and has no spans.  Repeated rows are scanned each for itself.  An empty
table gives an empty result (and an untrained, uniform model).  A column ``secrets`` is replaced, others are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SAMPLE_DOCS = 10_000
#: Counts that a character's own successors need to outweigh those of all characters.
BACKOFF = 8.0
#: One secret per ten thousand long tokens is expected, so the ratio has to outweigh that.
THRESHOLD = math.log(1e4)

SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def spans(text: Column, pattern: str, kind: str, order: int, keep, test: Column) -> Column:
    """Leftmost non-overlapping matches as (start, ord, end, kind), in code points, end exclusive.

    The text between matches comes from ``split`` and the matches from ``regexp_extract_all``; one fold
    over both gives the places.  ``keep`` turns the list of matches into booleans; ``test`` is a cheap
    condition that holds wherever a kept match exists.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), keep(found).alias("k"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["b"])
        end = start + F.char_length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["k"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(test, out).otherwise(F.array().cast(SPAN))


def _long(least: int):
    return lambda found: F.transform(found, lambda m: F.char_length(m) >= least)


def may_assign(text: Column) -> Column:
    return (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN)


def may_access(text: Column) -> Column:
    return text.contains("AKIA")


def may_hex(text: Column) -> Column:
    return text.rlike("[0-9a-f]{32}")


def base_spans(text: Column) -> Column:
    value_long = lambda _: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= 8)
    return F.concat(
        spans(text, ASSIGN, "assign", 0, value_long, may_assign(text)),
        spans(text, ACCESS, "access", 1, _long(16), may_access(text)),
        spans(text, HEX, "hex", 2, _long(32), may_hex(text)),
    )


def train(texts: DataFrame, text_col: str, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio of each (previous, next) pair of ALPHABET, row 0 and column 0 for any other character."""
    n = max(1, texts.count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = texts.select(text.alias("t")).where(F.pmod(F.xxhash64(F.lit(10), "t"), F.lit(n)) < sample_docs)
    none, t = F.array().cast("array<string>"), F.col("t")
    found = lambda pattern, group, least: F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v: F.char_length(v) >= least)
    values = F.concat(
        F.when(may_assign(t), found(ASSIGN, 2, 8)).otherwise(none),
        F.when(may_access(t), found(ACCESS, 0, 16)).otherwise(none),
        F.when(may_hex(t), found(HEX, 0, 32)).otherwise(none),
    )
    lone = lambda known: F.filter(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: w.rlike("[A-Za-z]") & ~F.exists(known, lambda v: F.contains(v, w)))
    words = F.get(F.transform(F.array(values), lone), F.lit(0))  # bound once: the values are found once a text, not once a word
    samples = chosen.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), values.alias("s")), F.struct(F.lit(0).alias("y"), words.alias("s")))).alias("x"))
    samples = samples.select("x.y", F.explode("x.s").alias("s")).where(F.char_length("s") > 1).distinct()
    pairs = samples.select("y", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("s") - 1), lambda i: F.substring(F.col("s"), i, 2))).alias("p"))
    size = len(ALPHABET) + 1
    counts = [[0.0] * (size * size) for _ in range(2)]
    for row in pairs.groupBy("y", "p").count().collect():  # at most 2 * size^2 rows: one per pair of characters
        # A word is no evidence for itself: one secret among the words would else teach that it is an identifier.
        seen = row["count"] - (row["y"] == 0)
        counts[row["y"]][(ALPHABET.find(row["p"][0]) + 1) * size + ALPHABET.find(row["p"][1]) + 1] += seen
    log_p = []
    for y in (0, 1):  # a character after another falls back on the characters at large
        seen = [sum(counts[y][b::size]) for b in range(size)]
        large = [(c + 0.5) / (sum(seen) + 0.5 * size) for c in seen]
        rows = [counts[y][a * size : (a + 1) * size] for a in range(size)]
        log_p.append([math.log((r[b] + BACKOFF * large[b]) / (sum(r) + BACKOFF)) for r in rows for b in range(size)])
    return [x - z for z, x in zip(*log_p, strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: random against identifier."""
    table, size = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>"), len(ALPHABET) + 1
    place = lambda i: F.call_function("locate", F.substring(token, i, 1), F.lit(ALPHABET))
    return F.aggregate(
        F.sequence(F.lit(2), F.char_length(token)),
        F.lit(0.0),
        lambda acc, i: acc + F.element_at(table, place(i - 1) * size + place(i) + 1),
    )


def scan(df: DataFrame, text_col: str, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``secrets``: base spans and those that the models add, sorted by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    random = lambda found: F.transform(found, lambda m: m.rlike("[A-Za-z]") & (ratio(m, model) > threshold))
    with_base = df.withColumn("__sm_base", base_spans(text)).withColumn("__sm_more", spans(text, CANDIDATE, "markov", 3, random, text.rlike(CANDIDATE)))
    return with_base.withColumn("secrets", together(F.col("__sm_base"), F.col("__sm_more"))).drop("__sm_base", "__sm_more")


def together(base: Column, more: Column) -> Column:
    """Base spans and those of ``more`` that overlap none of them, sorted by start, then kind.

    Over the sorted spans one fold drops what an earlier base span reaches into, and one from the end what reaches into a later one.
    """
    none, is_base = F.array().cast(SPAN), lambda x: x["ord"] < 3

    def fold(found: Column, edge: int, moved, clear) -> Column:
        def step(acc: Column, x: Column) -> Column:
            stays = is_base(x) | clear(acc["edge"], x)
            return F.struct(F.when(is_base(x), moved(acc["edge"], x)).otherwise(acc["edge"]).alias("edge"), F.when(stays, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(found, F.struct(F.lit(edge).alias("edge"), none.alias("out")), step, lambda acc: acc["out"])

    every = F.array_sort(F.concat(base, more))
    forward = fold(every, 0, lambda edge, x: F.greatest(edge, x["end"]), lambda edge, x: edge <= x["start"])
    backward = fold(F.reverse(forward), 2**31 - 1, lambda edge, x: F.least(edge, x["start"]), lambda edge, x: edge >= x["end"])
    return F.when((F.size(base) == 0) | (F.size(more) == 0), every).otherwise(F.array_sort(backward))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, "text", train(docs, "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["ord"] < 3)
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("markov").alias("n_markov"),
    )
