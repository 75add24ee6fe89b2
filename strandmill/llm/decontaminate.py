"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so whole-document Jaccard similarity says little.  Items are
partitioned by the size of their shingle sets, powers of two; for a partition with sizes up to s, a document
is cut into windows of s shingles, whose sets are of the items' own size.  Windows and items are
sketched by the same ``perms`` minimum hashes, and one equal minimum makes the document a candidate for the
item.  With containment of 0.75 or more, wherever in the document the shared shingles stand, the chance to
miss is below (1 - 0.25) ** perms, about 1e-16 for 128.  Minima of larger windows are minima of smaller ones.
Candidates are verified on the shingle strings themselves.

Distinct (id, text) items are taken in blocks of about ``block`` items and ``BLOCK_BYTES`` of text.  A block's items are
broadcast and sketched in the tasks; with several blocks each pass is written before the next begins, so
the driver and a task hold one block, whatever the size of the benchmark.  Documents are never shuffled.

Nulls: a null text is empty, and an item or document without words matches nothing; ids may be null.  An
item of fewer than five words matches documents that consist of the same words.  Repeated documents are
matched each for itself, items with equal id and text count once; empty tables give an empty result.
Other columns of the documents pass through, whatever their names (but for ``__sm_hits``).
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandmill.llm import tokens
from strandmill.llm.scratch import drop_saved, save

WIDTH, THRESHOLD, PERMS, BLOCK, BLOCK_BYTES = 5, 0.75, 128, 8_000, 32 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = bytes.maketrans(_SPACE, b" " * 6)


def shingle_set(text: str | None, width: int = WIDTH) -> set[bytes]:
    """Distinct shingles as byte strings; this is the definition that the search is verified by."""
    w = [x for x in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_SPACE).split(b" ") if x]
    if 0 < len(w) < width:
        return {b" ".join(w)}
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


class _Sketches:
    """Minimum hashes of a block of items, by size class."""

    def __init__(self, ids: list, texts: list[str | None], perms: int, seed: int = 5):
        self.ids, self.sets, self.factors = ids, [shingle_set(t) for t in texts], tokens.multipliers(perms, seed)
        values, offsets = tokens.distinct(*tokens.shingles(pa.array(texts, pa.string()), WIDTH))
        by_class = defaultdict(list)
        for k, n in enumerate(np.diff(offsets).tolist()):
            if n:
                by_class[(n - 1).bit_length()].append(k)
        self.classes = []
        full = np.flatnonzero(np.diff(offsets))
        place = np.zeros(len(texts), np.int64)
        place[full] = np.arange(len(full))
        for bits, members in sorted(by_class.items()):
            items = np.array(members)
            table, flag_bits = [], max(12, (32 * len(items)).bit_length())
            for f in self.factors:
                mins = tokens.min_by_run(values, f, offsets[full])[place[items]]
                order = np.argsort(mins, kind="stable")
                flags = np.zeros(1 << flag_bits, bool)
                flags[(mins >> np.uint64(64 - flag_bits)).astype(np.int64)] = True
                table.append((mins[order], items[order], flags))
            self.classes.append((bits, np.uint64(64 - flag_bits), table))

    def candidates(self, values: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) with an equal minimum in some window."""
        out: set[tuple[int, int]] = set()
        if not len(values) or not self.classes:
            return out
        small = self.classes[0][0]
        counts = np.diff(offsets)
        cells = -(-counts >> small)
        cell_offsets = np.concatenate(([0], np.cumsum(cells)))
        text_of = np.repeat(np.arange(len(counts)), cells)
        starts = offsets[text_of] + ((np.arange(cell_offsets[-1]) - cell_offsets[text_of]) << small)
        levels = []
        for bits, shift, _ in self.classes:
            n = -(-counts >> bits)
            o = np.concatenate(([0], np.cumsum(n)))
            t = np.repeat(np.arange(len(counts)), n)
            levels.append((t, cell_offsets[t] + ((np.arange(o[-1]) - o[t]) << (bits - small)), shift))
        for p, f in enumerate(self.factors):
            base = tokens.min_by_run(values, f, starts)
            for (t, at, shift), (_, _, table) in zip(levels, self.classes, strict=True):
                mins, items, flags = table[p]
                own = np.minimum.reduceat(base, at)
                near = np.flatnonzero(flags[(own >> shift).astype(np.int64)])
                if len(near):
                    lo, hi = np.searchsorted(mins, own[near], "left"), np.searchsorted(mins, own[near], "right")
                    for k in np.flatnonzero(hi > lo).tolist():
                        out.update((int(t[near[k]]), int(i)) for i in items[lo[k] : hi[k]])
        return out


_made: list[tuple[str, _Sketches]] = []


def _sketched(name: str, handle, perms: int) -> _Sketches:
    """Sketches of the broadcast block ``name``; a Python worker makes them once and keeps the last block's."""
    if not _made or _made[0][0] != name:
        _made[:] = [(name, _Sketches(*handle.value, perms))]
    return _made[0][1]


def _search_block(df: DataFrame, text_col: str, keep: list[str], block, perms: int, item_type: T.DataType, threshold: float) -> DataFrame:
    hit = T.StructType([T.StructField("item", item_type), T.StructField("size", T.LongType()), T.StructField("shared", T.LongType())])
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("__sm_hits", T.ArrayType(hit))])
    arrow = to_arrow_type(schema["__sm_hits"].dataType)

    name = uuid.uuid4().hex

    def run(batches):
        sketches = _sketched(name, block, perms)
        for batch in batches:
            for part in tokens.slices(batch, text_col):
                texts = part.column(text_col)
                hits: list[list[dict]] = [[] for _ in range(len(part))]
                own: tuple[int, set] = (-1, set())
                for t, i in sorted(sketches.candidates(*tokens.shingles(texts, WIDTH))):
                    if own[0] != t:
                        own = (t, shingle_set(texts[t].as_py()))
                    size, shared = len(sketches.sets[i]), len(sketches.sets[i] & own[1])
                    if shared >= threshold * size:
                        hits[t].append({"item": sketches.ids[i], "size": size, "shared": shared})
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(hits, arrow)], names=schema.names)

    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def _blocks(items: DataFrame, item_id: str, item_text: str, block: int):
    """(broadcast (ids, texts), whether it is the only one) of the distinct items, a bounded block at a time."""
    context = items.sparkSession.sparkContext
    rows = save(items.select(item_id, item_text).distinct(), "decontaminate-items")
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length(item_text))).first()
    n_blocks = max(1, -(-n // block), -(-(size or 0) // BLOCK_BYTES))
    for k in range(n_blocks):
        own = rows.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(n_blocks)) == k).collect()  # about ``block`` rows
        yield context.broadcast(([r[0] for r in own], [r[1] for r in own])), n_blocks == 1


def search(df: DataFrame, text_col: str, keep: list[str], items: DataFrame, item_id: str, item_text: str, threshold: float = THRESHOLD, perms: int = PERMS, block: int = BLOCK) -> DataFrame:
    """Columns ``keep`` of ``df`` with ``__sm_hits``: (item, size, shared) of every item that the text contains.

    With several blocks of items, each is searched in all documents and a document has a row per block.
    """
    kind, out = items.schema[item_id].dataType, None
    for shared, only in _blocks(items, item_id, item_text, block):
        found = _search_block(df, text_col, keep, shared, perms, kind, threshold)
        if not only:
            found = save(found, "decontaminate-hits")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(df: DataFrame, text_col: str, items: DataFrame, item_id: str, item_text: str, block: int = BLOCK) -> DataFrame:
    """``df`` without the documents that contain an item."""
    for shared, only in _blocks(items, item_id, item_text, block):
        found = _search_block(df, text_col, df.columns, shared, PERMS, items.schema[item_id].dataType, THRESHOLD)
        old, df = df, found.where(F.size("__sm_hits") == 0).drop("__sm_hits")
        if not only:
            df = save(df, "decontaminate-kept")
            shared.destroy()
            if hasattr(old, "saved_at") and old.saved_at.rsplit("/", 1)[1].startswith("decontaminate-kept"):
                drop_saved(old)
    return df


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = search(docs, "text", ["doc_id"], items, "item_id", "text").select("doc_id", F.explode("__sm_hits").alias("h"))
    return hits.select(
        "doc_id",
        F.col("h.item").alias("item_id"),
        F.col("h.size").alias("item_shingles"),
        F.col("h.shared").alias("shared_shingles"),
        F.round(F.col("h.shared") / F.col("h.size"), 6).alias("containment"),
    )


OP5_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) END) AS sh FROM w
), i AS (SELECT id, sh, count(*) OVER (PARTITION BY id) AS n FROM s WHERE side = 'i')
SELECT d.id AS doc_id, i.id AS item_id, max(i.n)::BIGINT AS item_shingles, count(*)::BIGINT AS shared_shingles, round(count(*) / max(i.n), 6) AS containment
FROM s d JOIN i ON d.sh = i.sh WHERE d.side = 'd' GROUP BY d.id, i.id HAVING count(*) >= 0.75 * max(i.n)
"""
