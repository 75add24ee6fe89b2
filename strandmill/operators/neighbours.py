"""Nearest vectors by cosine over an inverted file of coarse cells, with an exact rerank and an exact bound.

Centroids are chosen from at most ``SAMPLE`` rows; every row belongs to the cell of its nearest centroid, whose widest angle is
known.  Angles obey the triangle inequality: a query farther from a centroid than the threshold's angle and the cell's
widest angle together has no neighbour in the cell.  What is left is compared exactly, so nothing is missed.

Rows are sorted by cell into ranges, so a cell of many rows fills many tasks.  Queries go in blocks of ``BLOCK`` against all
rows; a task keeps the first ``most`` rows of a query, and driver and tasks hold one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.graph import kept

SAMPLE, CELLS, BLOCK = 16_384, 1024, 16_384
THRESHOLD, MOST = 0.88, 16
#: Rows that are compared with a block at once.
ROWS = 1024


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]].reshape(-1, dim)


def _units(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, n): vectors of length one; rows with null, empty, zero or non-finite vectors or a null id are left out."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf")))
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").alias("n"))


def inverted_file(rows: DataFrame, cells: int = CELLS) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(rows with their cell, sorted into ranges; centroids; widest angle of each cell) of ``rows`` (id, v)."""
    chosen = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).collect()
    n = min(cells, max(1, int(len(chosen) ** 0.5)))
    sample = np.array([r.v for r in chosen])
    centroids = sample[:n].copy()
    for _ in range(5):
        near = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    dim = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                close = _matrix(part.column("v"), dim) @ centroids.T
                cell = close.argmax(1)
                yield part.append_column("cell", pa.array(cell, pa.int64())).append_column("angle", pa.array(np.arccos(np.clip(close[np.arange(len(cell)), cell], -1, 1))))

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, cell long, angle double")
    placed = kept(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
    wide = np.full(len(centroids), -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("wide")).collect():  # a row per cell
        wide[r.cell] = r.wide
    return placed, centroids, wide


def neighbours(df: DataFrame, id_col: str, vector_col: str, is_query: Column, threshold: float = THRESHOLD, most: int = MOST, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, cosine, rank): of each row of ``is_query`` (a column of ``id``) the first ``most`` other rows at ``threshold`` or more.

    Higher cosines first, ties by id.  Vectors of another length than most of ``df`` are left out.
    """
    rows = _units(df, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    sizes = rows.groupBy("n").count().orderBy(F.desc("count"), "n").first()
    schema = f"id {kind}, neighbour {kind}, cosine double, rank int"
    if sizes is None:
        return df.sparkSession.createDataFrame([], schema)
    placed, centroids, wide = inverted_file(kept(rows.where(F.col("n") == sizes.n)), cells)
    dim = centroids.shape[1]
    queries = placed.where(F.coalesce(is_query, F.lit(False)))
    n_blocks = max(1, -(-queries.count() // block))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9
    found = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).select("id", "v").toArrow()
        q = _matrix(own.column("v").combine_chunks(), dim) if len(own) else np.zeros((0, dim))
        held = df.sparkSession.sparkContext.broadcast((own.column("id").to_pylist(), q, np.arccos(np.clip(q @ centroids.T, -1, 1)) <= wide + reach))

        def run(batches):
            names, q, may = held.value
            best: list[list] = [[] for _ in names]
            for batch in batches:
                for at in range(0, len(batch), ROWS):
                    part = batch.slice(at, ROWS)
                    ids, cell, v = part.column("id").to_pylist(), part.column("cell").to_numpy(), _matrix(part.column("v"), dim)
                    for c in np.unique(cell).tolist():
                        asked = np.flatnonzero(may[:, c])
                        inside = np.flatnonzero(cell == c)
                        close = q[asked] @ v[inside].T
                        for a, i in zip(*np.nonzero(close >= threshold), strict=True):
                            k, other = int(asked[a]), ids[inside[i]]
                            if other != names[k]:
                                best[k].append((-float(close[a, i]), other))
                                if len(best[k]) > 8 * most:
                                    best[k] = sorted(best[k])[:most]
            rows = [(names[k], o, -c) for k, found in enumerate(best) for c, o in sorted(found)[:most]]
            cols = [pa.array([r[0] for r in rows], own.schema.field("id").type), pa.array([r[1] for r in rows], own.schema.field("id").type), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "neighbour", "cosine"])

        near = placed.mapInArrow(run, f"id {kind}, neighbour {kind}, cosine double")
        nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
        near = kept(near.withColumn("rank", nth).where(F.col("rank") <= most).select("id", "neighbour", F.round("cosine", 6).alias("cosine"), "rank"))
        found = near if found is None else found.union(near)
    return found
