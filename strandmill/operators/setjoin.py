"""Set-similarity joins by prefix filtering over a frequency-ordered inverted index.

The overlap coefficient of two sets is what they share over the size of the smaller one.  Items are ordered rare first.  If a pair
reaches the threshold, the smaller set shares at least k = ceil(threshold * size) items, so the first shared one is among
its first size - k + 1: only these are looked up, and frequent items, being last, mostly are not.  A pair is taken at
its first shared item and nowhere else, checked there on whole sets, so pairs below the threshold never leave the join
and none comes twice.  An item of many sets is cut into blocks on both sides that meet pairwise, so no task holds it.

Where items are so frequent that prefixes would meet about every pair of sets, several times over, sets are packed into blocks instead
and every two blocks meet once.  A packed block meets about sixty-four others up to 100,000 sets; beyond, blocks grow with the root of the
number of sets, so a meeting looks at as many pairs for each set however many there are.  Pairs leave their task only as results.
Blocks are broadcast to their meetings while they are small together, so only numbers of blocks are shuffled and disk grows with the sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.graph import kept

#: Sets that hold an item and meet in one task; more are cut into blocks.
ITEM_ROWS = 2048
#: Items that sets are multiplied by at a time.
COLUMNS = 2048
#: Sets of a packed block at least and at most, and items of one about at most.
LEAST_BLOCK, MOST_BLOCK, BLOCK_ITEMS = 1024, 16_384, 4_000_000
#: A block has at most this times the root of all sets, and a meeting its square of pairs to look at for each set.
BLOCK_ROOT = 5
#: Tasks in which blocks meet; up to about 2.5 million sets each has one meeting.
MEETINGS = 50_000
#: Cells of a product of two blocks that a task holds, and cells whose pairs leave it together.
CELLS, BATCH = 8_000_000, 500_000
#: Counts that a task holds before it sums those of one key.
TALLIES = 4_000_000
#: Frequent items that are broadcast; more are joined.
BROADCAST_ROWS = 100_000
#: Bytes of packed blocks that are broadcast to their meetings; more are shuffled, each as often as it meets another.
BROADCAST_BYTES = 64 << 20
#: What a packed block holds.
HELD = ["owners", "items", "sizes", "codes", "marks", "hot"]


def _least(n: Column, threshold: float) -> Column:
    """Items that a set of ``n`` has to share, one at least; rounding at nine decimals keeps 0.25 * 4 at 1."""
    return F.greatest(F.lit(1), F.ceil(F.round(n * F.lit(threshold), 9))).cast("int")


def block_of(n: int) -> int:
    """Sets of a packed block, where there are ``n``."""
    return min(MOST_BLOCK, max(LEAST_BLOCK, min(n // 64, BLOCK_ROOT * math.isqrt(n))))


def tasks_of(parts: int) -> int:
    """Tasks for the meetings of every two of ``parts`` blocks, and of each with itself."""
    return min(MEETINGS, parts * (parts + 1) // 2)


def ordered_sets(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, items, n): the distinct items of each owner, rarest first, ties by item."""
    pairs = rows.where(F.col(item).isNotNull() & F.col(owner).isNotNull()).select(owner, item).distinct()
    return _rare_first(pairs.withColumn("mark", F.lit(False)), owner, item).drop("marks")


def _rare_first(pairs: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, items, marks, n) of distinct ``pairs`` (owner, item, mark)."""
    often = pairs.groupBy(item).agg(F.count("*").alias("__f"))
    held = pairs.join(often, item).groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("__f", F.col(item).alias("i"), "mark"))).alias("items"))
    return held.select(owner, F.transform("items", lambda x: x["i"]).alias("items"), F.transform("items", lambda x: x["mark"]).alias("marks"), F.size("items").alias("n"))


def overlaps(rows: DataFrame, owner: str, item: str, threshold: float, item_rows: int = ITEM_ROWS, mark: str | None = None, common: bool = False, dense: bool | None = None, block: int | None = None) -> DataFrame:
    """(a, b, overlap, coefficient) of owners a < b of ``rows`` (owner, item) whose overlap coefficient is at least ``threshold`` (above 0).

    With ``mark``, a boolean column, also ``marked``: whether both mark an item that they share.  With ``common`` also the shared items, sorted.
    Rows with a null owner or item are left out.  ``dense`` says whether blocks of sets meet instead of prefixes, ``block`` how many sets
    one has; if not given, both go by the numbers of sets and of meetings.
    """
    return Overlaps(rows, owner, item, threshold, mark, item_rows=item_rows, dense=dense, block=block).pairs(common)


class Overlaps:
    """The join of ``overlaps`` over one written table: its pairs, its numbers of pairs, or its pairs numbered.

    With ``only``, a boolean column that says the same in all rows of an item, a pair has to share an item for which it holds.
    """

    def __init__(self, rows: DataFrame, owner: str, item: str, threshold: float, mark: str | None = None, only: str | None = None, item_rows: int = ITEM_ROWS, dense: bool | None = None, block: int | None = None):
        flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
        cut = rows.where(F.col(item).isNotNull() & F.col(owner).isNotNull()).select(F.col(owner).alias("__o"), F.col(item).alias("__i"), flag(mark).alias("mark"), flag(only).alias("only"))
        self.table = kept(cut.groupBy("__o", "__i").agg(F.max("mark").alias("mark"), F.max("only").alias("only")))
        self.threshold, self.mark, self.only, self.item_rows = threshold, bool(mark), bool(only), item_rows
        self.n = self.table.select("__o").distinct().count()
        often = self.table.groupBy("__i").agg(F.count("*").cast("double").alias("f"))
        self.total, met = (x or 0.0 for x in often.agg(F.sum("f"), F.sum(F.col("f") * F.col("f"))).first())
        # Prefixes do not know ``only``.
        self.dense = self.only or (dense if dense is not None else (1 - threshold) * met >= self.n * self.n / 4)
        self.block = block or block_of(self.n)

    @property
    def parts(self) -> int:
        return max(1, math.ceil(self.n / self.block), math.ceil(self.total / BLOCK_ITEMS))

    def pairs(self, common: bool = False, least: float | None = None) -> DataFrame:
        """(a, b, overlap, coefficient, ...) as ``overlaps`` tells; with ``least`` those of a higher threshold."""
        threshold = max(self.threshold, least or 0)
        if self.dense:
            found = _by_blocks(self.table, "__o", "__i", threshold, self.parts, self.mark, common, self.only)
        else:
            found = _by_prefixes(self.table, "__o", "__i", threshold, self.item_rows, self.mark, common)
        more = [c for c, asked in (("marked", self.mark), ("common", common)) if asked]
        return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", (F.col("overlap") / F.col("n")).alias("coefficient"), *more)

    def _ranges(self, order: Column) -> DataFrame:
        """Packed blocks (block, ...) of owners next to each other in ``order``."""
        owners = self.table.select("__o").distinct()
        owners = kept(owners.repartitionByRange(self.parts, order).select("__o", F.spark_partition_id().alias("block")))
        return _packed_blocks(self.table.join(owners, "__o").select("block", F.col("__o").alias("o"), F.col("__i").alias("i"), "mark", "only"))

    def _units(self, blocks: DataFrame, from_block: Column, starts: DataFrame | None = None) -> DataFrame:
        """Each block, first alone (``facing`` -1) with its ``starts`` (block, starts), then all that it faces in their order, in one task."""
        numbers = blocks.select(F.col("block").alias("unit")).crossJoin(F.broadcast(blocks.agg(F.collect_list("block").alias("all"))))  # numbers of blocks
        faced = numbers.select("unit", F.explode("all").alias("block")).where(from_block).withColumn("facing", F.col("block"))
        own = blocks.select(F.col("block").alias("unit"), "block", F.lit(-1).alias("facing"))
        own = own.withColumn("starts", F.lit(None).cast("binary")) if starts is None else own.join(starts, "block", "left")
        units = _beside(own.unionByName(faced, allowMissingColumns=True), blocks, self.parts, "unit", "facing")
        return units.select("unit", "facing", *HELD, "starts")

    def tallies(self) -> DataFrame:
        """(a, overlap, n, marked, pairs): how many similar pairs a < b an owner has, by what they share and the smaller set's size.

        Pairs are counted in their task: at most a row per owner and way to share leaves it.
        """
        kind = self.table.schema["__o"].dataType.simpleString()
        if not self.dense:
            found = _by_prefixes(self.table, "__o", "__i", self.threshold, self.item_rows, True, False)
            return found.groupBy(F.least("x", "y").alias("a"), "overlap", "n", "marked").agg(F.count("*").alias("pairs"))
        units = self._units(self._ranges(F.col("__o").asc()), F.col("block") >= F.col("unit"))
        return units.mapInArrow(_tally(self.threshold, self.mark, self.only), f"a {kind}, overlap long, n int, marked boolean, pairs long")

    def partners(self, of: DataFrame) -> DataFrame:
        """(a, b, overlap, n): the similar pairs a < b of the few owners ``of`` (a)."""
        size = self.table.groupBy("__o").agg(F.count("*").cast("int").alias("n"))
        own = of.join(self.table, F.col("a") == F.col("__o")).select("a", "__i")
        shared = self.table.join(F.broadcast(own), "__i").where(F.col("a") < F.col("__o")).groupBy("a", F.col("__o").alias("b")).agg(F.count("*").alias("overlap"))
        both = shared.join(size.select(F.col("__o").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("__o").alias("b"), "n"), "b")
        both = both.withColumn("n", F.least("na", "n")).select("a", "b", "overlap", "n")
        return both.where(F.col("overlap") >= _least(F.col("n"), self.threshold))

    def numbered(self, starts: DataFrame, common: bool = False) -> DataFrame:
        """(a, b, overlap, n, marked, score, position, ...): the pairs a < b, numbered by their tasks.

        ``starts`` (a, overlap, n, marked, score, start) has the rows of ``tallies``, a score and a start for each: an owner's pairs of
        one ``start`` get the numbers after it in order of b as text.
        """
        kind, of = (self.table.schema[c].dataType.simpleString() for c in ("__o", "__i"))
        blocks = self._ranges(F.col("__o").cast("string").asc())
        place = blocks.select("block", F.explode("owners").alias("a"))
        cols = starts.join(place, "a").select("block", "a", "overlap", "n", "marked", "score", "start")
        told = cols.groupBy("block").applyInArrow(_starts, "block int, starts binary")
        units = self._units(blocks, F.lit(True), told)
        schema = f"a {kind}, b {kind}, overlap long, n int, marked boolean, score double, position long" + (f", common array<{of}>" if common else "")
        return units.mapInArrow(_number(self.threshold, self.mark, self.only, common), schema)


def _result(pairs: DataFrame, owner: str, item: str, mark: bool, common: bool) -> str:
    kind, of = (pairs.schema[c].dataType.simpleString() for c in (owner, item))
    return f"x {kind}, y {kind}, overlap long, n int" + (", marked boolean" if mark else "") + (f", common array<{of}>" if common else "")


def _by_prefixes(pairs: DataFrame, owner: str, item: str, threshold: float, item_rows: int, mark: bool, common: bool) -> DataFrame:
    """A set travels once for each of its items."""
    sets = kept(_rare_first(pairs, owner, item))
    each = sets.select(F.col(owner).alias("o"), "items", "marks", "n", F.posexplode("items").alias("at", "item"))
    prefix = F.col("at") <= F.col("n") - _least(F.col("n"), threshold)
    counts = each.groupBy("item").agg(F.count("*").alias("all"), F.count_if(prefix).alias("few"))
    often = kept(counts.where(F.col("all") > item_rows).select("item", F.ceil(F.col("all") / item_rows).cast("int").alias("wide"), F.ceil(F.col("few") / item_rows).cast("int").alias("narrow")))
    known = F.broadcast(often) if often.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else often
    cut = each.join(known, "item", "left").withColumns({"wide": F.coalesce("wide", F.lit(1)), "narrow": F.greatest(F.coalesce("narrow", F.lit(1)), F.lit(1))})
    facing = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda parts: F.pmod(F.xxhash64("o"), F.col(parts)).cast("int")
    held = ("o", "items", *(["marks"] if mark else []), "n", "at")
    small = cut.where(prefix).select("item", own("narrow").alias("p"), facing("wide").alias("q"), F.lit(False).alias("large"), *held)
    large = cut.select("item", facing("narrow").alias("p"), own("wide").alias("q"), F.lit(True).alias("large"), *held)
    units = small.union(large).repartition("item", "p", "q").sortWithinPartitions("item", "p", "q")
    return units.mapInArrow(_meet(threshold, mark, common), _result(pairs, owner, item, mark, common))


def _packed_blocks(cut: DataFrame) -> DataFrame:
    """``cut`` (block, o, i, mark, only) with one row per block."""
    kind, of = (cut.schema[c].dataType.simpleString() for c in ("o", "i"))
    return kept(cut.groupBy("block").applyInArrow(_packed, f"block int, owners array<{kind}>, items array<{of}>, sizes binary, codes binary, marks binary, hot binary"))


def _beside(numbers: DataFrame, blocks: DataFrame, tasks: int, *order: str) -> DataFrame:
    """``numbers`` (unit, block, ...) with what their blocks hold, a unit in one of ``tasks`` tasks, in ``order``."""
    names = sum(F.octet_length(F.array_join(F.col(c).cast("array<string>"), "")) for c in HELD[:2])
    held = blocks.agg(F.sum(names + sum(F.octet_length(c) for c in HELD[2:]))).first()[0] or 0
    deal = lambda df: df.repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int"))
    met = deal(numbers).join(F.broadcast(blocks), "block") if held <= BROADCAST_BYTES else deal(numbers.join(blocks, "block"))
    return met.sortWithinPartitions(*order)


def _by_blocks(pairs: DataFrame, owner: str, item: str, threshold: float, parts: int, mark: bool, common: bool, only: bool = False) -> DataFrame:
    """``parts`` blocks of sets, of which every two meet in one task."""
    cut = pairs.select(F.pmod(F.xxhash64(owner), F.lit(parts)).cast("int").alias("block"), F.col(owner).alias("o"), F.col(item).alias("i"), "mark", "only")
    blocks = _packed_blocks(cut)
    if parts == 1:
        units = blocks.select(F.lit(0).alias("unit"), F.lit(True).alias("same"), *HELD)
    else:
        p, q = F.least("block", "facing"), F.greatest("block", "facing")
        unit = (p * (2 * parts - 1 - p) / 2).cast("long") + q  # numbers of pairs p <= q, without gaps
        numbers = pairs.sparkSession.range(parts).select(F.col("id").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("facing"))
        units = _beside(numbers.select(unit.alias("unit"), "block", (p == q).alias("same")), blocks, tasks_of(parts), "unit", "block")
    return units.mapInArrow(_meet_blocks(threshold, mark, common, only), _result(pairs, owner, item, mark, common))


def _packed(key, table):
    """The sets of a block in one row: owners, sorted items, and for each owner its items' places as steps from one to the next."""
    o, i, m, h = (table.column(c).combine_chunks() for c in ("o", "i", "mark", "only"))
    owners, items = o.unique(), i.unique()
    items = items.take(pc.sort_indices(items))
    row, code = (pc.index_in(x, value_set=of).to_numpy().astype(np.int64) for x, of in ((o, owners), (i, items)))
    order = np.lexsort((code, row))
    width = next(w for w in (np.uint8, np.uint16, np.uint32) if len(items) <= np.iinfo(w).max + 1)
    steps = np.diff(code[order].astype(width), prepend=width(0))
    squeezed = [zstandard.compress(x.tobytes(), 3) for x in (np.bincount(row, minlength=len(owners)).astype(np.int32), steps, np.packbits(m.to_numpy(zero_copy_only=False)[order]))]
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    hot = np.zeros(len(items), bool)
    hot[code[h.to_numpy(zero_copy_only=False)]] = True
    cols = [pa.array([key[0].as_py()], pa.int32()), whole(owners), whole(items), *[pa.array([x], pa.binary()) for x in (*squeezed, np.packbits(hot).tobytes())]]
    return pa.Table.from_arrays(cols, names=["block", "owners", "items", "sizes", "codes", "marks", "hot"])


class _Sets:
    """Sets as flat arrays: ``row`` and ``code`` of every item held, ascending in each row, ``mark`` of each, ``n`` items of each row; ``hot`` items."""

    def __init__(self, owners: pa.Array, items: pa.Array, n: np.ndarray, code: np.ndarray, mark: np.ndarray | None, hot: np.ndarray | None = None):
        self.owners, self.items, self.n, self.code, self.mark, self.hot = owners, items, n, code, mark, hot
        self.row = np.repeat(np.arange(len(n)), n)

    @classmethod
    def unpacked(cls, batch: pa.RecordBatch, k: int) -> _Sets:
        owners, items = (batch.column(c)[k].values for c in ("owners", "items"))
        sizes, codes, marks = (zstandard.decompress(batch.column(c)[k].as_py()) for c in ("sizes", "codes", "marks"))
        width = next(w for w in (np.uint8, np.uint16, np.uint32) if len(items) <= np.iinfo(w).max + 1)
        code = np.cumsum(np.frombuffer(codes, width), dtype=width).astype(np.int64)
        hot = np.unpackbits(np.frombuffer(batch.column("hot")[k].as_py(), np.uint8), count=len(items)).astype(bool)
        return cls(owners, items, np.frombuffer(sizes, np.int32), code, np.unpackbits(np.frombuffer(marks, np.uint8), count=len(code)).astype(bool), hot)

    def ordered(self, by: np.ndarray) -> _Sets:
        """These sets with their rows in the order ``by``."""
        ends = np.concatenate(([0], np.cumsum(self.n)))
        at = np.repeat(ends[by] - np.concatenate(([0], np.cumsum(self.n[by])[:-1])), self.n[by]) + np.arange(len(self.code))
        return _Sets(self.owners.take(pa.array(by)), self.items, self.n[by], self.code[at], self.mark[at], self.hot)

    def in_terms_of(self, items: pa.Array) -> _Sets:
        """These sets with codes by ``items``, and only what they hold of them; ``n`` stays."""
        place = pc.fill_null(pc.index_in(self.items, value_set=items), -1).to_numpy().astype(np.int64)[self.code]
        there = place >= 0
        out = _Sets(self.owners, items, self.n, place, self.mark, self.hot)
        out.row, out.code, out.mark = self.row[there], place[there], self.mark[there]
        return out

    def matrix(self, low: int, high: int, first: int, width: int, marked: bool) -> np.ndarray:
        """0-1 matrix of rows ``low`` to ``high`` and ``width`` items from ``first`` on."""
        a, b = np.searchsorted(self.row, (low, high))
        row, code = self.row[a:b], self.code[a:b]
        here = (code >= first) & (code < first + width)
        if marked:
            here &= self.mark[a:b]
        out = np.zeros((high - low, width), np.float32)
        out[row[here] - low, code[here] - first] = 1
        return out


def _common(x: _Sets, y: _Sets, i: np.ndarray, j: np.ndarray) -> pa.ListArray:
    """The items that the rows ``i`` of ``x`` share with the rows ``j`` of ``y``, both with the same codes; ``i`` ascends."""
    counts, codes = [], []
    holds = np.zeros(len(x.items), bool)
    ends = np.searchsorted(y.row, np.arange(len(y.n) + 1))
    cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        own = x.code[slice(*np.searchsorted(x.row, (i[a], i[a] + 1)))]
        holds[own] = True
        sizes = ends[j[a:b] + 1] - ends[j[a:b]]
        places = np.repeat(ends[j[a:b]] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        found = y.code[places]
        shared = holds[found]
        codes.append(found[shared])
        counts.append(np.bincount(np.repeat(np.arange(b - a), sizes)[shared], minlength=b - a))
        holds[own] = False
    flat = np.concatenate([*codes, np.zeros(0, np.int64)])
    offsets = np.concatenate(([0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x.items.take(pa.array(flat)))


def _batch(x: _Sets, y: _Sets, i: np.ndarray, j: np.ndarray, shared: np.ndarray, marked: np.ndarray | None, common: bool) -> pa.RecordBatch:
    cols = {"x": x.owners.take(pa.array(i)), "y": y.owners.take(pa.array(j)), "overlap": pa.array(shared.astype(np.int64)), "n": pa.array(np.minimum(x.n[i], y.n[j]).astype(np.int32))}
    if marked is not None:
        cols["marked"] = pa.array(marked)
    if common:
        cols["common"] = _common(x, y, i, j)
    return pa.RecordBatch.from_pydict(cols)


def _need(sets: _Sets, threshold: float) -> np.ndarray:
    return np.maximum(1, np.ceil(np.round(sets.n * threshold, 9))).astype(np.float32)


def _products(x: _Sets, y: _Sets, low: int, high: int, mark: bool, only: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """What rows ``low`` to ``high`` of ``x`` share with those of ``y`` (in terms of x's items), and of marked items; 0 where no shared item is hot."""
    shared = np.zeros((high - low, len(y.n)), np.float32)
    direct = np.zeros_like(shared) if mark else None
    hot = np.zeros_like(shared) if only else None
    for first in range(0, len(x.items), COLUMNS):
        width = min(COLUMNS, len(x.items) - first)
        left, right = x.matrix(low, high, first, width, False), y.matrix(0, len(y.n), first, width, False)
        shared += left @ right.T
        if only and (some := np.flatnonzero(x.hot[first : first + width])).size:
            hot += left[:, some] @ right[:, some].T
        if mark:
            direct += x.matrix(low, high, first, width, True) @ y.matrix(0, len(y.n), first, width, True).T
    if only:
        shared[hot == 0] = 0
    return shared, direct


def pairs_of_blocks(x: _Sets, y: _Sets, same: bool, threshold: float, mark: bool, common: bool, only: bool = False):
    """Batches (x, y, overlap, n, ...) of the similar pairs of two blocks, or of one with itself."""
    y = y.in_terms_of(x.items)
    need = [_need(s, threshold) for s in (x, y)]  # the smaller set needs fewer
    step = max(1, CELLS // max(1, len(y.n)))
    for low in range(0, len(x.n), step):
        high = min(low + step, len(x.n))
        shared, direct = _products(x, y, low, high, mark, only)
        rows = max(1, BATCH // max(1, len(y.n)))
        for a in range(0, high - low, rows):
            part = shared[a : a + rows]
            near = part >= np.minimum(need[0][low + a : low + a + len(part), None], need[1])
            if same:
                near &= np.arange(low + a, low + a + len(part))[:, None] < np.arange(len(y.n))
            i, j = np.nonzero(near)
            if len(i):
                yield _batch(x, y, i + low + a, j, part[i, j], direct[a + i, j] > 0 if mark else None, common)


def _facing(batches, text: bool):
    """(x, y, rank, extra): the block of a unit with each that it faces, rows in order (of their text), y's codes by x's items.

    ``rank`` are two arrays of numbers in which owners of both compare; ``extra`` is the last column of the unit's own row.
    """
    own = None
    for batch in batches:
        for k in range(len(batch)):
            sets = _Sets.unpacked(batch, k)
            sets = sets.ordered(pc.sort_indices(pc.cast(sets.owners, pa.string()) if text else sets.owners).to_numpy())
            if batch.column("facing")[k].as_py() < 0:
                own, extra = sets, batch.column(batch.num_columns - 1)[k].as_py()
                yield own, None, None, extra
                continue
            rank = pc.rank(pa.concat_arrays([own.owners, sets.owners]), tiebreaker="dense").to_numpy().astype(np.int64)
            yield own, sets.in_terms_of(own.items), (rank[: len(own.n)], rank[len(own.n) :]), extra


def _similar(x: _Sets, y: _Sets, rank, threshold: float, mark: bool, only: bool, cells: int):
    """(i, j, overlap, n, marked) of similar pairs of rows with the owner of y after that of x, by rows, about ``cells`` cells at a time."""
    need = [_need(s, threshold) for s in (x, y)]
    step = max(1, cells // max(1, len(y.n)))
    for low in range(0, len(x.n), step):
        high = min(low + step, len(x.n))
        if not len(y.n) or rank[0][low:high].min() >= rank[1].max():
            continue
        shared, direct = _products(x, y, low, high, mark, only)
        near = shared >= np.minimum(need[0][low:high, None], need[1])
        if rank[0][low:high].max() >= rank[1].min():
            near &= rank[0][low:high, None] < rank[1]
        flat = np.flatnonzero(near)
        i, j = np.divmod(flat, len(y.n))
        yield i + low, j, shared.ravel()[flat].astype(np.int64), np.minimum(x.n[i + low], y.n[j]).astype(np.int64), direct.ravel()[flat] > 0 if mark else np.zeros(len(i), bool)


def _codes(i: np.ndarray, overlap: np.ndarray, n: np.ndarray, marked: np.ndarray, most: int) -> np.ndarray:
    """One number for a row and a way to share, where sets of x have ``most`` items at most."""
    return ((i * (most + 1) + n) * (most + 1) + overlap) * 2 + marked


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([*counts, np.zeros(0, np.int64)]), len(found)).astype(np.int64)


def _tally(threshold: float, mark: bool, only: bool):
    def told(x, keys, counts):
        most = int(x.n.max(initial=0))
        key, pairs = _summed(keys, counts)
        i, rest = np.divmod(key, 2 * (most + 1) ** 2)
        n, rest = np.divmod(rest, 2 * (most + 1))
        cols = {"a": x.owners.take(pa.array(i)), "overlap": pa.array(rest // 2), "n": pa.array(n.astype(np.int32)), "marked": pa.array(rest % 2 == 1), "pairs": pa.array(pairs)}
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        x, keys, counts = None, [], []
        for own, y, rank, _ in _facing(batches, False):
            if y is None:
                if keys:
                    yield told(x, keys, counts)
                x, keys, counts = own, [], []
                continue
            most = int(x.n.max(initial=0))
            for i, _, overlap, n, marked in _similar(x, y, rank, threshold, mark, only, CELLS):
                if not len(i):
                    continue
                low = int(i[0])
                key, wide = _codes(i - low, overlap, n, marked, most), (int(i[-1]) - low + 1) * 2 * (most + 1) ** 2
                if wide <= CELLS:
                    all_ = np.bincount(key, minlength=wide)
                    key = np.flatnonzero(all_)
                    all_ = all_[key]
                else:
                    key, all_ = np.unique(key, return_counts=True)
                keys.append(key + low * 2 * (most + 1) ** 2)
                counts.append(all_)
                if len(keys) > 8 and sum(map(len, keys)) > TALLIES:
                    key, all_ = _summed(keys, counts)
                    keys, counts = [key], [all_]
        if keys:
            yield told(x, keys, counts)

    return run


def _starts(key, table):
    """The starts of a block's owners in one row."""
    sink = pa.BufferOutputStream()
    part = table.select(["a", "overlap", "n", "marked", "score", "start"]).combine_chunks()
    with pa.ipc.new_stream(sink, part.schema) as out:
        out.write_table(part)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "starts"])


def _number(threshold: float, mark: bool, only: bool, common: bool):
    def slots(x: _Sets, extra: bytes | None):
        """Sorted keys of the rows' ways to share, the score and slot of each, and the slots' starts, which go on as pairs come."""
        if extra is None:
            return None
        told = pa.ipc.open_stream(extra).read_all().combine_chunks()
        row = pc.index_in(told.column("a").combine_chunks(), value_set=x.owners).to_numpy().astype(np.int64)
        overlap, n, score, start = (told.column(c).to_numpy() for c in ("overlap", "n", "score", "start"))
        key = _codes(row, overlap.astype(np.int64), n.astype(np.int64), told.column("marked").combine_chunks().to_numpy(zero_copy_only=False), int(x.n.max(initial=0)))
        by = np.lexsort((start, row))  # slots of a row stand together
        new = np.concatenate(([True], (row[by][1:] != row[by][:-1]) | (start[by][1:] != start[by][:-1])))
        slot = np.empty(len(by), np.int64)
        slot[by] = np.cumsum(new) - 1
        sorted_ = np.argsort(key)
        return key[sorted_], score[sorted_], slot[sorted_], start[by][new].astype(np.int64)

    def place_of(x: _Sets, keys: np.ndarray):
        """Finds keys that are there: by a table where that is small."""
        wide = len(x.n) * 2 * (int(x.n.max(initial=0)) + 1) ** 2
        if wide > CELLS:
            return lambda key: np.searchsorted(keys, key)
        of = np.zeros(wide, np.int32)
        of[keys] = np.arange(len(keys))
        return lambda key: of[key]

    def run(batches):
        x = told = None
        for own, y, rank, extra in _facing(batches, True):
            if y is None:
                x, told = own, slots(own, extra)
                place = told and place_of(x, told[0])
                continue
            if told is None:  # no pair of the block
                continue
            _, score, slot, next_ = told
            for i, j, overlap, n, marked in _similar(x, y, rank, threshold, mark, only, BATCH):
                if not len(i):
                    continue
                key = place(_codes(i, overlap, n, marked, int(x.n.max())))
                at = slot[key]
                least = int(at.min())
                by = np.argsort((at - least).astype(np.uint16) if int(at.max()) - least < 1 << 16 else at, kind="stable")  # few values sort fast
                at = at[by]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                sizes = np.diff(np.append(first, len(at)))
                position = np.empty(len(at), np.int64)
                position[by] = np.repeat(next_[at[first]] + 1 - first, sizes) + np.arange(len(at))
                next_[at[first]] += sizes
                cols = {"a": x.owners.take(pa.array(i)), "b": y.owners.take(pa.array(j)), "overlap": pa.array(overlap), "n": pa.array(n.astype(np.int32)), "marked": pa.array(marked), "score": pa.array(score[key]), "position": pa.array(position)}
                if common:
                    cols["common"] = _common(x, y, i, j)
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _meet_blocks(threshold: float, mark: bool, common: bool, only: bool = False):
    def run(batches):
        first = unit = None  # the one of two blocks that has come
        for batch in batches:
            for k in range(len(batch)):
                sets, of = _Sets.unpacked(batch, k), batch.column("unit")[k].as_py()
                if batch.column("same")[k].as_py():
                    yield from pairs_of_blocks(sets, sets, True, threshold, mark, common, only)
                elif first is None or unit != of:  # the other one may hold no sets
                    first, unit = sets, of
                else:
                    yield from pairs_of_blocks(first, sets, False, threshold, mark, common, only)
                    first = None

    return run


def _shared(codes: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Number of codes that each of ``codes`` shares with each of ``others``, by products of 0-1 matrices, some columns at a time."""
    most = 1 + max((int(c.max()) for c in (*codes, *others) if len(c)), default=-1)
    out = np.zeros((len(codes), len(others)), np.float32)
    flat = [(np.repeat(np.arange(len(x)), [len(c) for c in x]), np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (codes, others)]
    for low in range(0, most, COLUMNS):
        parts = []
        for (row, code), n in zip(flat, (len(codes), len(others)), strict=True):
            here = (code >= low) & (code < low + COLUMNS)
            part = np.zeros((n, min(COLUMNS, most - low)), np.float32)
            part[row[here], code[here] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def pairs_of_unit(table: pa.Table, threshold: float, mark: bool = False, common: bool = False) -> pa.RecordBatch:
    """(x, y, overlap, n, ...) of the sets of one item that are similar enough and share no item before it; x is the smaller set of n items."""
    items = table.column("items").combine_chunks()
    offsets = items.offsets.to_numpy()
    held = items.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    kinds = held.unique()
    kinds = kinds.take(pc.sort_indices(kinds))
    codes = pc.index_in(held, value_set=kinds).to_numpy().astype(np.int64)
    at, n, large = table.column("at").to_numpy(), table.column("n").to_numpy(), table.column("large").to_numpy()
    owner = table.column("o").combine_chunks()
    rank = pc.rank(owner, tiebreaker="dense").to_numpy().astype(np.int64)
    whole = [codes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    s, l = np.flatnonzero(~large), np.flatnonzero(large)  # noqa: E741
    of = lambda rows, cut: [whole[r][: at[r]] if cut else whole[r] for r in rows.tolist()]
    least = np.maximum(1, np.ceil(np.round(n[s] * threshold, 9)))
    ordered = (n[s][:, None] < n[l]) | ((n[s][:, None] == n[l]) & (rank[s][:, None] < rank[l]))
    shared = _shared(of(s, False), of(l, False))
    first = _shared(of(s, True), of(l, True)) == 0
    x, y = np.nonzero(ordered & first & (shared >= least[:, None]))
    marked = None
    if mark:
        flags = np.concatenate([np.zeros(0, bool), *[np.array(m, bool) for m in table.column("marks").to_pylist()]])
        direct = [codes[a:b][flags[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        marked = _shared([direct[r] for r in s.tolist()], [direct[r] for r in l.tolist()])[x, y] > 0
    order = np.lexsort((codes, np.repeat(np.arange(len(n)), np.diff(offsets))))
    sets = _Sets(owner, kinds, n, codes[order], None)
    return _batch(sets, sets, s[x], l[y], shared[x, y], marked, common)


def _meet(threshold: float, mark: bool = False, common: bool = False):
    def run(batches):
        held: list[pa.RecordBatch] = []  # of the unit that has not ended

        def key(batch, k):
            return tuple(batch.column(c)[k].as_py() for c in ("item", "p", "q"))

        for batch in batches:
            item, p, q = (batch.column(c).dictionary_encode().indices.to_numpy() for c in ("item", "p", "q"))
            new = np.flatnonzero((np.diff(item) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            cuts = [0, *new.tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and key(held[0], 0) != key(batch, a):
                    yield pairs_of_unit(pa.Table.from_batches(held), threshold, mark, common)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield pairs_of_unit(pa.Table.from_batches(held), threshold, mark, common)

    return run


def contained(queries: DataFrame, corpus: DataFrame, query: str, document: str, item: str, threshold: float) -> DataFrame:
    """(query, document, overlap, n, coefficient): queries of which a document holds at least ``threshold`` of the items.

    Both tables are (id, item).  Only items of queries are looked for in the corpus; pairs are found by the queries' rare prefixes
    and confirmed on the items that the document shares with any query.
    """
    sets = kept(ordered_sets(queries, query, item))
    each = sets.select(query, "n", F.posexplode("items").alias("at", item))
    wanted = each.select(item).distinct()
    found = kept(corpus.select(document, item).where(F.col(document).isNotNull()).distinct().join(wanted, item, "left_semi"))
    rare = each.where(F.col("at") <= F.col("n") - _least(F.col("n"), threshold)).select(query, item)
    pairs = rare.join(found, item).select(query, document).distinct()
    held = found.groupBy(document).agg(F.collect_set(item).alias("held"))
    both = pairs.join(sets, query).join(held, document).withColumn("overlap", F.size(F.array_intersect("items", "held")))
    return both.where(F.col("overlap") >= _least(F.col("n"), threshold)).select(query, document, F.col("overlap").cast("long").alias("overlap"), F.col("n").cast("long").alias("n"), F.round(F.col("overlap") / F.col("n"), 6).alias("coefficient"))
