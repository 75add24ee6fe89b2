"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order ``ORDER`` over code points of the lower-cased text.  A model is a few sorted arrays:
64-bit hashes of n-grams with their interpolated log-probabilities, and hashes of contexts with their
back-off weights.  The language with the lowest cross-entropy per character wins.  A text is rejected
where even that entropy is above what held-out texts of the language show: mean plus ``SIGMAS``
deviations, wider for short texts.  Texts without a letter are ``und``.

Training reads about ``SAMPLE_DOCS`` documents per language, chosen by a hash of the text and without repeats, one
group per language, so a group and a model are bounded.  There may be any number of languages: their models are a
table, of which ``BLOCK_MODELS`` are sent to the tasks at a time.  Scoring reads every whole text.

Nulls and texts without a letter: ``und``, score 0, rejected.  Null labels are not learnt from.  Repeated rows
score alike; an empty table gives an empty result; with nothing to learn from, all is ``und``.  Columns that the
table has already under the names of the result (lang_pred, score, cross_entropy, rejected) are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import tokens
from strandmill.llm.scratch import drop_saved, save
from strandmill.llm.tokens import U, mix

ORDER, SAMPLE_DOCS, SIGMAS = 4, 1500, 6.0
#: Models that a task holds at a time; more languages mean more passes over the texts.
BLOCK_MODELS = 64
#: Labels whose counts are broadcast; more are joined.
BROADCAST_LABELS = 100_000
#: Characters that a task holds as arrays at a time.
CHUNK_CHARS = 500_000
#: Nats per character; clean texts of other topics than the sample's must pass.
LEAST_SPREAD = 0.1
_STEP = 0xD6E8FEB86659FD93
_START = 0x110000  # stands before the first character


def code_points(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points with order - 1 start marks before each text, and the offsets of the texts in them."""
    mark = [np.full(order - 1, _START, np.uint64)]
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in texts]
    sizes = np.array([len(p) + order - 1 for p in parts], np.int64)
    flat = np.concatenate([x for p in parts for x in (mark[0], p)]) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def gram_codes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """codes[k][i]: the k points that end at i, as one number; codes[0] is 0."""
    out, factor, shifted = [np.zeros(len(points), np.uint64)], 1, points + U(1)
    for k in range(1, order + 1):
        part = np.zeros(len(points), np.uint64)
        part[k - 1 :] = shifted[: len(points) - k + 1]
        out.append(out[-1] + part * U(factor))
        factor = factor * _STEP % 2**64
    return out


def _hash(codes: np.ndarray, k: int) -> np.ndarray:
    return mix(codes + U(k * 0x9E3779B97F4A7C15 % 2**64))


@dataclass
class Model:
    """Sorted hash arrays of one language."""

    lang: str
    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    floor: float
    mean: float = 0.0
    spread: float = 0.0
    per_char: float = 0.0

    def score(self, now: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log P of n-grams: ``now[k]`` hashes the last k points, ``before[k]`` the k points before the last."""
        out, weight, open_ = np.full(len(now[1]), self.floor), np.zeros(len(now[1])), np.arange(len(now[1]))
        for k in range(len(now) - 1, 0, -1):
            at = np.searchsorted(self.grams, now[k][open_])
            at[at == len(self.grams)] = 0
            hit = self.grams[at] == now[k][open_]
            out[open_[hit]] = weight[open_[hit]] + self.logp[at[hit]]
            open_ = open_[~hit]
            at = np.searchsorted(self.contexts, before[k - 1][open_])
            at[at == len(self.contexts)] = 0
            known = self.contexts[at] == before[k - 1][open_]
            weight[open_[known]] += self.backoff[at[known]]
        out[open_] = weight[open_] + self.floor
        return out


def _chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _distinct_grams(texts: list[str], order: int) -> list[tuple[np.ndarray, ...]]:
    """By length: sorted hashes of the distinct n-grams, of their contexts and of their last length - 1 points, and counts.

    Texts are taken a chunk at a time, so what is held follows the distinct n-grams.
    """
    found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order + 1)]
    for part in _chunks(texts):
        points, offsets = code_points(part, order)
        real = np.ones(len(points), bool)
        for k in range(order - 1):
            real[offsets[:-1] + k] = False
        at = np.flatnonzero(real)
        codes = gram_codes(points, order)
        for k in range(1, order + 1):
            keys, first, count = np.unique(_hash(codes[k][at], k), return_index=True, return_counts=True)
            place = at[first]
            found[k].append((keys, _hash(codes[k - 1][place - 1], k - 1), _hash(codes[k - 1][place], k - 1), count))
    out: list[tuple[np.ndarray, ...]] = [()]
    for parts in found[1:]:
        keys, contexts, lows, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        out.append((keys, contexts[first], lows[first], np.bincount(where, counts, len(keys)).astype(np.int64)))
    return out


def _train(texts: list[str], order: int) -> tuple[np.ndarray, ...]:
    found = _distinct_grams(texts, order)
    grams, logps, contexts, backoffs = [], [], [], []
    floor = math.log(1.0 / (len(found[1][0]) + 1))
    lower_keys, lower_p = np.zeros(0, np.uint64), np.zeros(0)
    for k in range(1, order + 1):
        keys, before, low, count = found[k]
        if k < order:  # continuation counts: in how many ways the gram is preceded
            count = np.zeros(len(keys), np.int64)
            np.add.at(count, np.searchsorted(keys, found[k + 1][2]), 1)
            count = np.maximum(count, 1)
        ones, twos = int((count == 1).sum()), int((count == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, where = np.unique(before, return_inverse=True)
        total = np.bincount(where, count)
        spare = discount * np.bincount(where) / total
        p_low = np.full(len(keys), math.exp(floor)) if k == 1 else lower_p[np.searchsorted(lower_keys, low)]
        p = (count - discount) / total[where] + spare[where] * p_low
        lower_keys, lower_p = keys, p
        grams.append(keys)
        logps.append(np.log(p))
        contexts.append(ctx)
        backoffs.append(np.log(spare))
    g, c = np.concatenate(grams), np.concatenate(contexts)
    og, oc = np.argsort(g), np.argsort(c)
    return g[og], np.concatenate(logps)[og], c[oc], np.concatenate(backoffs)[oc], np.array([floor])


def _entropies(models: list[Model], texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(nats per character by text and model, characters by text); distinct n-grams are scored once."""
    points, offsets = code_points(texts, order)
    sizes = np.diff(offsets) - (order - 1)
    codes = gram_codes(points, order)
    _, first, back = np.unique(codes[order], return_index=True, return_inverse=True)
    prior = np.maximum(first - 1, 0)
    now = [_hash(c[first], k) for k, c in enumerate(codes)]
    before = [_hash(c[prior], k) for k, c in enumerate(codes)]
    out = np.zeros((len(texts), len(models)))
    full = np.flatnonzero(sizes > 0)
    if len(full):
        marks = offsets[:-1, None] + np.arange(order - 1)
        for m, model in enumerate(models):
            logp = model.score(now, before)[back]
            logp[marks.ravel()] = 0.0
            out[full, m] = -np.add.reduceat(logp, offsets[:-1])[full] / sizes[full]
    return out, sizes


_MODEL = "lang string, grams binary, logp binary, contexts binary, backoff binary, floor double, mean double, spread double, per_char double"


def fit(df: DataFrame, text_col: str, label_col: str, order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """A table with a model for every label of ``df``, learnt on the executors from a bounded sample per label."""
    rows = df.select(F.col(text_col).alias("t"), F.col(label_col).alias("lang")).where("t IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = save(sizes, "language-sizes")
    few = sizes.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    chosen = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(F.pmod(F.xxhash64(F.lit(6), "t"), F.col("n")) < sample_docs)
    sample = chosen.select("lang", "t").distinct()

    def train(table: pa.Table) -> pa.Table:
        texts = sorted({t.lower() for t in table.column("t").to_pylist()})  # sorted: the same model whatever the order of rows
        held = texts[::10] if len(texts) >= 20 else texts
        learn = [t for k, t in enumerate(texts) if k % 10] if len(texts) >= 20 else texts
        lang = table.column("lang")[0].as_py()
        arrays = _train([t for t in learn if t] or [" "], order)
        model = Model(lang, *arrays[:4], floor=float(arrays[4][0]))
        shown = [_entropies([model], part, order) for part in _chunks([t for t in held if t] or [" "])]
        entropy, sizes = (np.concatenate(x) for x in zip(*shown, strict=True))
        long = entropy[sizes >= 200, 0] if (sizes >= 200).sum() >= 10 else entropy[:, 0]
        mean, spread = float(np.median(long)), float(1.4826 * np.median(np.abs(long - np.median(long))))
        bits = [pa.array([x.tobytes()], pa.binary()) for x in arrays[:4]]
        numbers = [pa.array([x], pa.float64()) for x in (model.floor, mean, max(spread, LEAST_SPREAD), 2.0)]
        names = [c.split()[0] for c in _MODEL.split(", ")]
        return pa.Table.from_arrays([pa.array([lang]), *bits, *numbers], names=names)

    return save(sample.groupBy("lang").applyInArrow(train, _MODEL), "language-models")


def _loaded(rows: list) -> list[Model]:
    kinds = (np.uint64, np.float64, np.uint64, np.float64)
    return sorted((Model(r[0], *[np.frombuffer(x, k) for x, k in zip(r[1:5], kinds, strict=True)], *r[5:]) for r in rows), key=lambda m: m.lang)


#: What the models seen so far leave open: the best language, its entropy, the entropy above which it is rejected, and
#: the sum over the models of exp(-(entropy - best) * min(characters, 50)).
_STATE = [T.StructField("__sm_lang", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("__sm_entropy", "__sm_limit", "__sm_total")]]


def _better(texts: list[str | None], state: list[tuple], models: list[Model], order: int) -> list[tuple]:
    """``state`` of the texts after ``models``; of equal entropies the first language by name wins."""
    use = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    entropy, sizes = _entropies(models, [texts[k].lower() for k in use], order)
    for j, k in enumerate(use):
        e, n = entropy[j], int(sizes[j])
        best = int(np.argmin(e))
        m, least = models[best], float(e[best])
        total = float(np.exp(np.clip((least - e) * min(n, 50), -60, 0)).sum())
        lang, old, limit, weight = state[k]
        if lang is not None:
            low, part = min(old, least), lambda x: math.exp(max(-60.0, (low - x) * min(n, 50)))  # noqa: B023
            total = total * part(least) + weight * part(old)
            if (old, lang) < (least, m.lang):
                state[k] = (lang, old, limit, total)
                continue
        state[k] = (m.lang, least, m.mean + SIGMAS * max(m.spread, m.per_char / math.sqrt(n)), total)
    return state


def identify(df: DataFrame, text_col: str, models: DataFrame, order: int = ORDER) -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy and rejected, by the table ``models``."""
    spark, n = df.sparkSession, models.count()
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "cross_entropy", "rejected")]
    rows = df.select(*[F.col(c) for c in dict.fromkeys([*keep, text_col])], *[F.lit(None).cast(f.dataType).alias(f.name) for f in _STATE])
    blocks = -(-n // BLOCK_MODELS)
    for b in range(blocks):
        part = models.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).collect()
        if not part:
            continue
        shared, schema = spark.sparkContext.broadcast(_loaded(part)), rows.schema

        def run(batches, shared=shared, schema=schema):
            for batch in batches:
                for part in tokens.slices(batch, text_col, CHUNK_CHARS * 2):
                    state = list(zip(*(part.column(f.name).to_pylist() for f in _STATE), strict=True))
                    got = _better(part.column(text_col).to_pylist(), state, shared.value, order)
                    cols = [pa.array([g[k] for g in got], pa.float64() if k else pa.string()) for k in range(len(_STATE))]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in schema.names[: -len(_STATE)]], *cols], names=schema.names)

        old, rows = rows, rows.mapInArrow(run, schema)
        if blocks > 1:  # one block's models at a time, in tasks and on the driver
            rows = save(rows, "language-states")
            shared.destroy()
            if hasattr(old, "saved_at"):
                drop_saved(old)
    score = F.coalesce(F.round(1 / F.col("__sm_total"), 6), F.lit(0.0))
    rejected = F.coalesce(F.col("__sm_entropy") > F.col("__sm_limit"), F.lit(True))
    return rows.select(*keep, F.coalesce("__sm_lang", F.lit("und")).alias("lang_pred"), score.alias("score"), F.round("__sm_entropy", 6).alias("cross_entropy"), rejected.alias("rejected"))


def remainder(id_col: str, by: int):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(by))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", remainder("doc_id", 5).alias("r"))
    models = fit(docs.where("r != 0"), "text", "lang")
    found = identify(docs.select("doc_id", F.coalesce(F.col("r") == 0, F.lit(False)).alias("held_out"), "text"), "text", models)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
