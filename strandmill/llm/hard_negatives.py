"""Hard negatives by product quantisation with stored residual norms; results are exact.

A vector of whole numbers is cut into pairs of components; each pair is coded by the nearest of 256 centroids, which are fitted
on ``SAMPLE`` vectors at most, chosen by a hash.  The norm of what the codes leave over is stored beside them.  An anchor's
lookup table gives the inner product with every centroid, so the sum of a row's entries is the score less the product with
its residual, which is at most norm times norm: every score lies between known bounds.

A window asks for the first rows, by score, with scores from a low to a high end and the same label or another.  Rows whose
bounds cannot reach the window, or only below the rows found so far, are left out, rigorously; the others are scored in whole
numbers.  The first search has one window per anchor (its positives), the second one for each of its positive scores.

Anchors go in blocks of ``BLOCK`` against all rows.  A task keeps the first rows of each window of the block, so what is shuffled
is bounded by windows and tasks; driver and tasks hold one block of anchors.  No pair becomes a row before it is a result.

Rows with a null label, a null vector or a null or non-finite component take no part.  Components beyond 2^24 are
taken as 2^24, so that scores fit 64 bits; shorter vectors count as padded with zeros.  A null id is never an anchor, comes after all others in
ties and is returned as null.  Rows with equal ids are different rows: each is mined as an anchor and can be found by the others;
ties between them go by place in the input.  Empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.scratch import drop_saved, save

WIDTH, CENTROIDS, SAMPLE, TURNS = 2, 256, 8192, 8
#: Anchors in a block, anchors and rows that are scored together, and pairs that are scored exactly at once.
BLOCK, TOGETHER, ROWS, PAIRS = 32_768, 128, 2048, 200_000
MOST = 1 << 24
LAST = 2**63 - 1  # stands for a null id


def fit(vectors: np.ndarray, width: int = WIDTH, centroids: int = CENTROIDS, turns: int = TURNS) -> np.ndarray:
    """Centroids [part, centroid, component] of the parts of ``vectors`` [row, component], by Lloyd's method."""
    parts = vectors.reshape(len(vectors), vectors.shape[1] // width, width).astype(np.float64)
    found = np.zeros((parts.shape[1], centroids, width))
    rng = np.random.default_rng(11)
    for m in range(parts.shape[1]):
        x = parts[:, m]
        if not len(x):
            continue
        c = x[rng.permutation(len(x))[np.arange(centroids) % len(x)]]
        for _ in range(turns):
            near = nearest(x, c)
            n = np.bincount(near, minlength=centroids)
            sums = np.stack([np.bincount(near, x[:, d], centroids) for d in range(width)], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        found[m] = c
    return found


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """[row, component] of packed whole numbers, padded with zeros."""
    rows = [np.frombuffer(v.as_buffer(), np.int32) for v in column]
    out = np.zeros((len(rows), dim), np.int64)
    if rows and all(len(r) == dim for r in rows):
        out[:] = np.stack(rows)
    else:
        for k, r in enumerate(rows):
            out[k, : len(r)] = r
    return out


def quantise(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(rid, id, label, q, dim) of the rows that take part; q holds the whole numbers."""
    whole = F.transform(vector_col, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    fits = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(label.isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fits, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("q"), F.size(vector_col).alias("dim"))


def build_index(rows: DataFrame, width: int = WIDTH, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """All rows with their codes and residual norms, saved, and the centroids."""
    first = save(rows, "vectors")
    dim = first.agg(F.max("dim")).first()[0] or 0
    dim = max(width, -(-dim // width) * width)
    chosen = first.select("q", F.xxhash64("q").alias("h")).orderBy("h").limit(sample).collect()
    seen = np.zeros((len(chosen), dim), np.int64)
    for k, r in enumerate(chosen):
        seen[k, : len(r.q)] = r.q
    centroids = fit(seen, width)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("q")
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
                packed = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                q = _vectors(pa.array(packed, pa.binary()), dim)
                cut = q.reshape(len(q), -1, width).astype(np.float64)
                codes = np.stack([nearest(cut[:, m], centroids[m]) for m in range(len(centroids))], axis=1)
                rest = cut - centroids[np.arange(len(centroids)), codes]
                size = lambda x: np.sqrt((x * x).reshape(len(q), -1).sum(1))
                norm = size(rest) * (1 + 1e-9) + 1e-9 * (size(cut) + 1)  # more than the sum over a lookup table can be wrong by
                cols = [*(part.column(c) for c in ("rid", "id", "label")), pa.array(packed, pa.binary()), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(cols, names=["rid", "id", "label", "q", "codes", "norm"])

    index = save(first.mapInArrow(run, "rid long, id long, label long, q binary, codes binary, norm double"), "vectors-index")
    drop_saved(first)
    return index, centroids


class Windows:
    """The first ``most`` rows, by (score, id, rid), of every window [anchor, place]: the whole numbers from ``low`` to ``high``."""

    def __init__(self, anchors: np.ndarray, rids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray, same: bool, most: int):
        self.anchors, self.rids, self.labels, self.low, self.high, self.same, self.most = anchors, rids, labels, low, high, same, most
        self.centroids = centroids
        self.size = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
        self.least = np.full(low.shape, -np.inf)  # the score that a row needs beside those found
        self.score, self.id, self.rid = (np.zeros((low.size, most), np.int64) for _ in range(3))
        self.count = np.zeros(low.size, np.int64)  # rows found of each window

    def add(self, rid: np.ndarray, ids: np.ndarray, label: np.ndarray, q: np.ndarray, codes: np.ndarray, norm: np.ndarray) -> None:
        width = self.centroids.shape[2]
        for a in range(0, len(self.anchors), TOGETHER):
            part = slice(a, a + TOGETHER)
            cut = self.anchors[part].reshape(-1, len(self.centroids), width).astype(np.float64)
            table = np.einsum("amw,mcw->mca", cut, self.centroids)
            score = np.zeros((len(q), table.shape[2]))
            for m in range(len(table)):
                score += table[m][codes[:, m]]
            error = norm[:, None] * self.size[part] + 1e-6
            lower, upper = score - error, score + error
            meant = ((label[:, None] == self.labels[part]) == self.same) & (rid[:, None] != self.rids[part])
            for w in range(self.low.shape[1]):
                low, high = self.low[part, w], self.high[part, w]
                live = np.flatnonzero(low <= high)
                if not len(live):
                    continue
                at = slice(None) if len(live) == table.shape[2] else live
                lo, up, fits, need = lower[:, at], upper[:, at], meant[:, at], self.least[part, w][at]
                low, high = low[at], high[at]
                if len(q) > self.most and np.isinf(need).any():
                    sure = np.where(fits & (up <= high) & (lo >= low), lo, -np.inf)
                    need = np.maximum(need, np.partition(sure, len(q) - self.most, axis=0)[len(q) - self.most])
                rows, cols = np.nonzero(fits & (lo <= high) & (up >= np.maximum(low, need)))
                cols = live[cols] + a
                for k in range(0, len(rows), PAIRS):
                    self._rerank(w, rows[k : k + PAIRS], cols[k : k + PAIRS], rid, ids, q)

    def _rerank(self, w: int, rows: np.ndarray, cols: np.ndarray, rid: np.ndarray, ids: np.ndarray, q: np.ndarray) -> None:
        score = np.einsum("ij,ij->i", q[rows], self.anchors[cols])
        good = (score >= self.low[cols, w]) & (score <= self.high[cols, w])
        rows, cols, score = rows[good], cols[good], score[good]
        new = cols * self.low.shape[1] + w
        seen = np.unique(new)
        old, nth = np.nonzero(np.arange(self.most) < self.count[seen][:, None])
        old = seen[old]
        window = np.concatenate((old, new))
        score, ids, rid = (np.concatenate((x[old, nth], y)) for x, y in ((self.score, score), (self.id, ids[rows]), (self.rid, rid[rows])))
        order = np.lexsort((rid, ids, -score, window))
        window = window[order]
        first = np.flatnonzero(np.diff(window, prepend=-1))
        nth = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
        order, window, nth = order[nth < self.most], window[nth < self.most], nth[nth < self.most]
        self.score[window, nth], self.id[window, nth], self.rid[window, nth] = score[order], ids[order], rid[order]
        self.count[seen] = np.bincount(np.searchsorted(seen, window), minlength=len(seen))
        full = seen[self.count[seen] == self.most]
        self.least.ravel()[full] = self.score[full, self.most - 1]

    def rows(self) -> tuple[np.ndarray, ...]:
        """(window, score, id, rid) of all rows found."""
        window, nth = np.nonzero(np.arange(self.most) < self.count[:, None])
        return window, self.score[window, nth], self.id[window, nth], self.rid[window, nth]


_FOUND = "anchor long, place int, score long, id long, rid long"


def search(index: DataFrame, block: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, centroids: np.ndarray, same: bool, most: int) -> DataFrame:
    """(anchor, place, score, id, rid, nth): the first ``most`` rows of the windows of a block of anchors."""
    held = index.sparkSession.sparkContext.broadcast((block, low, high, centroids))
    dim = centroids.shape[0] * centroids.shape[2]

    def run(batches):
        block, low, high, centroids = held.value
        windows = Windows(block["q"], block["rid"], block["label"], low, high, centroids, same, most)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("id").fill_null(LAST).to_numpy(zero_copy_only=False)
                codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in part.column("codes")])
                windows.add(part.column("rid").to_numpy(), ids, part.column("label").to_numpy(), _vectors(part.column("q"), dim), codes, part.column("norm").to_numpy())
        window, score, ids, rid = windows.rows()
        for at in range(0, len(window), 100_000):
            w, s, i, r = (x[at : at + 100_000] for x in (window, score, ids, rid))
            cols = [pa.array(block["rid"][w // low.shape[1]]), pa.array((w % low.shape[1]).astype(np.int32)), pa.array(s), pa.array(i, mask=i == LAST), pa.array(r)]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "place", "score", "id", "rid"])

    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return index.mapInArrow(run, _FOUND).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def mine(df: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is a column of ``df``, ``is_anchor`` one of ``id``.  Negatives have share[0] * positive score <= share[1] * own score <= share[1] * positive score.
    """
    index, centroids = build_index(quantise(df, id_col, vector_col, label))
    dim = centroids.shape[0] * centroids.shape[2]
    anchors = index.where(F.coalesce(is_anchor, F.lit(False)))
    n_blocks = max(1, -(-anchors.count() // block))
    found = []
    for b in range(n_blocks):
        own = anchors.where(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)) == b).select("rid", "label", "q").toArrow()
        n = len(own)
        held = {"rid": own.column("rid").to_numpy(), "label": own.column("label").to_numpy(), "q": _vectors(own.column("q").combine_chunks() if n else pa.array([], pa.binary()), dim)}
        wide = np.iinfo(np.int64)
        first = save(search(index, held, np.full((n, 1), wide.min), np.full((n, 1), wide.max), centroids, True, positives), "negatives-positives")
        place = {int(r): k for k, r in enumerate(held["rid"])}
        low, high = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
        for r in first.select("anchor", "nth", "score").toLocalIterator():
            # Of equal scores the first has the window for all; a negative score has none.
            k, score = place[r.anchor], r.score
            if score >= 0 and score not in high[k][low[k] <= high[k]]:
                low[k, r.nth - 1], high[k, r.nth - 1] = -(-share[0] * score // share[1]), score
        second = save(search(index, held, low, high, centroids, False, negatives), "negatives-found")
        tops = save(index.sparkSession.createDataFrame(pa.table({"anchor": np.repeat(held["rid"], positives), "place": np.tile(np.arange(positives, dtype=np.int32), n), "top": high.ravel(), "live": (low <= high).ravel()})).where("live"), "negatives-tops")
        pairs = first.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        close = second.join(tops, ["anchor", "place"]).select("anchor", F.col("top").alias("positive_score"), F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found.append(pairs.join(close, ["anchor", "positive_score"]))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    names = index.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return rows.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, "vec_id", "embedding", label, F.col("id") % 100 == 0)


#: The same rows by all products of anchors and rows.
OP11_SQL = """
WITH
part AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.vec_id AS id, b.rid, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.rid <> b.rid
),
positives AS (SELECT anchor, anchor_id, id AS positive_id, rid, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id NULLS LAST, rid) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER near)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW near AS (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.id NULLS LAST, s.rid)
QUALIFY row_number() OVER near <= 5
"""
