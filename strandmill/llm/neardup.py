"""MinHash near-duplicates with odd sketches for candidate verification.

A document's set holds its distinct five-word shingles.  Documents with equal sets form a class and are
handled once.  Each class has ``BANDS * ROWS`` minimum hashes; bands of them propose candidates.
The samples are also folded into an odd sketch, a bitmap in which every (sample number, minimum) flips
one bit: the population count of two sketches' XOR estimates the samples that differ and so a high
similarity precisely.  Pairs whose estimate is far below the threshold go no further; the rest are
confirmed on the full sets.

No pair of a bucket becomes a row, but for the first step:

1. A member of a bucket meets its leaders (smallest nodes in three seeded orders); of all the leaders that it met
   it tries the ``TRIES`` that it shares most buckets with.  Links join components, and buckets that lie in one
   component are done.
2. The members of the other buckets are dealt to blocks of about ``BLOCK`` classes with one home (the smallest node
   met in such buckets), similar sizes and, where it is large, one component.  Blocks that share a bucket and differ in
   component and not too much in size make a unit; a task compares the sketches of a unit at once, confirms the open pairs, best
   first, and returns links that join components of the unit, never more than it has members.

Pairs inside a component need no test, and every other pair that shares a bucket lies in one unit, so
no link between components is lost but by the chances in README.

Nulls and texts without words have an empty set, are linked with nothing and keep their own id; null ids are a value like any other, and
the smallest id of a component is null only if all its ids are.  Repeated rows fall into one class.  Columns of
``docs`` other than the two named are not looked at.  Empty tables give an empty result.  A class is named by 63 bits of a 128-bit hash of its set.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.components import components
from strandmill.llm.scratch import drop_saved, save

BANDS, ROWS, SAMPLES, SKETCH_BITS = 56, 5, 560, 1024
#: A pair goes on if its sketches estimate at least the threshold less this; of pairs at a similarity of 0.75 it stops 1.7e-8.
MARGIN = 0.15
#: Seeds of the orders whose first members lead a bucket.
LEADERS = (0, 0x2545F4914F6CDD1D, 0x4A8BE9229ECDBA3A)
#: Leaders that a member tries.
TRIES = 4
#: Ids below which a set of needed texts is broadcast to filter the scan; above, a join does it.
BROADCAST_IDS = 200_000
#: Classes and shingles that a block should have; a larger class makes a block of its own.
BLOCK, BLOCK_SHINGLES = 96, 1 << 18
U = np.uint64


def odd_count(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """Expected population count of the XOR of two odd sketches."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


def class_of(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=16).digest()[:8], "little") >> 1


def sketch(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, node, bands array, odd sketch array); node, bands and sketch are null for empty sets."""
    factors = tokens.multipliers(max(SAMPLES, bands * rows), 8)
    names = ["id", "n_shingles", "node", "bands", "odd"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "t"):
                values, offsets = tokens.distinct(*tokens.shingles(part.column("t")))
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                keys, odd = np.zeros((bands, len(full)), np.uint64), np.zeros((len(full), SKETCH_BITS), np.uint8)
                if len(full):
                    at = np.arange(len(full))
                    for k, f in enumerate(factors):
                        least = tokens.min_by_run(values, f, offsets[full])
                        band = k // rows
                        if band < bands:  # the samples after the bands serve the sketch alone
                            keys[band] = tokens.mix(keys[band] * U(31) + least + U(band + 1))
                        odd[at, (tokens.mix(least ^ U(k * 0x9E3779B97F4A7C15 % 2**64)) % U(SKETCH_BITS)).astype(np.int64)] ^= 1
                packed = np.packbits(odd, axis=1).view(np.int64)
                signed = keys.T.astype(np.int64) if not len(full) else np.ascontiguousarray(keys.T).view(np.int64)
                where = {int(k): j for j, k in enumerate(full)}
                cut = [values[offsets[k] : offsets[k + 1]] for k in range(len(n))]
                cols = [
                    n.tolist(),
                    [class_of(c) if len(c) else None for c in cut],
                    [signed[where[k]] if k in where else None for k in range(len(n))],
                    [packed[where[k]] if k in where else None for k in range(len(n))],
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return light.mapInArrow(run, f"id {kind}, n_shingles long, node long, bands array<long>, odd array<long>")


def with_class(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """``docs`` with the class of each text; null for an empty set."""

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, text_col):
                values, offsets = tokens.distinct(*tokens.shingles(part.column(text_col)))
                found = [class_of(values[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield part.append_column(out, pa.array(found, pa.int64()))

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("long")).schema)


def with_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (distinct, one column ``__sm_rep``); few are broadcast, more are joined."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col).eqNullSafe(F.col("__sm_rep")), "left_semi")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles binary) of the classes ``wanted`` (node, rep), read from the texts under their ids."""

    def run(batches):
        for batch in batches:
            for part in tokens.slices(batch, "t"):
                values, offsets = tokens.distinct(*tokens.shingles(part.column("t")))
                cut = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(c) for c in cut], pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["node", "shingles"])

    texts = with_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", wanted.select(F.col("rep").alias("__sm_rep")).distinct())
    found = texts.select("t").mapInArrow(run, "node long, shingles binary")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets are as similar as ``threshold``, without rounding at two decimals."""
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return round(100 * threshold, 9) * (len(x) + len(y) - shared) <= 100 * shared


def _confirm(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of ``pairs`` (a, b, set_a, set_b) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("set_a", "set_b")]
            good = [k for k, (x, y) in enumerate(zip(*sets, strict=True)) if _linked(x, y, threshold)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def links_of_unit(block: np.ndarray, node: np.ndarray, comp: np.ndarray, odd: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the components of a unit's members: between its two blocks, or within the only one."""
    side = block != block[0]
    first, second = (np.flatnonzero(~side), np.flatnonzero(side)) if side.any() else (np.arange(len(node)),) * 2
    size = np.array([len(s) for s in sets])
    low, high = np.minimum(size[first][:, None], size[second]), np.maximum(size[first][:, None], size[second])
    differ = np.bitwise_count(odd[first][:, None, :] ^ odd[second]).sum(2, dtype=np.int64)
    open_ = (comp[first][:, None] != comp[second]) & (low >= threshold * high - 1e-9) & (differ <= odd_count(threshold - MARGIN))
    if not side.any():
        open_ = np.triu(open_, 1)
    rows, cols = np.nonzero(open_)
    order = np.argsort(differ[rows, cols], kind="stable")
    above: dict[int, int] = {}

    def root(c: int) -> int:
        while c in above:
            c = above[c]
        return c

    found = []
    for i, j in zip(first[rows[order]].tolist(), second[cols[order]].tolist(), strict=True):
        a, b = root(int(comp[i])), root(int(comp[j]))
        if a != b and _linked(sets[i], sets[j], threshold):
            above[a] = b
            found.append((int(node[i]), int(node[j])))
    return found


def _compare(units: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of units (unit, block, node, comp, odd, shingles); rows of a unit stand together."""

    def flush(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("block", "node", "comp")}
        odd = np.array(t.column("odd").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("shingles")]
        return links_of_unit(**cols, odd=odd, sets=sets, threshold=threshold)

    def run(batches):
        held: list[pa.RecordBatch] = []  # of the unit that has not ended yet
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(batch)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and b > a and held[0].column("unit")[0].as_py() != int(unit[a]):
                    out += flush(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
        out = flush(held) if held else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return units.mapInArrow(run, "a long, b long")


def _label(df: DataFrame, node: str, out: str, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias(f"__{out}"), F.col("comp").alias(out))
    return df.join(named, F.col(node) == F.col(f"__{out}"), "left").withColumn(out, F.coalesce(out, node)).drop(f"__{out}")


def _star(members: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between members and those leaders that they share most buckets with."""
    met = members.groupBy("node").agg(F.flatten(F.collect_list("leads")).alias("met"))
    others = met.select(F.col("node").alias("b"), F.filter("met", lambda x: x != F.col("node")).alias("met"))
    hits = F.transform(F.array_distinct("met"), lambda x: F.struct((-F.size(F.filter("met", lambda y: y == x))).alias("few"), x.alias("a")))
    tried = others.select("b", F.explode(F.slice(F.sort_array(hits), 1, TRIES)).alias("hit")).select(F.col("hit.a").alias("a"), "b")
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    texts = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = tried.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    pairs = both.where(sizes & (differ <= odd_count(threshold - MARGIN))).select("a", "b")
    return _confirm(pairs.join(texts("a"), "a").join(texts("b"), "b"), threshold)


def _blocks(mixed: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(node, comp, step, one, block) of the members of ``mixed``: ``step`` is a class of sizes, ``one`` the component of a block that has one only."""
    size = F.floor(F.log("n") / math.log(1 / threshold)) if threshold < 1 else F.col("n")
    homes = mixed.groupBy("node").agg(F.first("comp").alias("comp"), F.min("low").alias("home")).join(classes.select("node", "n"), "node").withColumn("step", size)
    counts = homes.groupBy("home", "step", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    counts = counts.withColumn("one", F.when(F.col("c") >= BLOCK, F.col("comp")))
    wide = counts.groupBy("home", "step", "one").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    parts = wide.select("home", "step", F.col("one").alias("__one"), F.ceil(F.greatest(F.col("c") / BLOCK, F.col("s") / BLOCK_SHINGLES)).alias("parts"))
    dealt = counts.select("home", "step", "comp", "one").join(parts, ["home", "step"]).where(F.col("one").eqNullSafe(F.col("__one"))).drop("__one")
    block = F.xxhash64("home", "step", "one", F.pmod(F.xxhash64("node"), "parts"))
    return homes.join(dealt, ["home", "step", "comp"]).select("node", "comp", "step", "one", block.alias("block"))


def _units(mixed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(unit, block) of the pairs of blocks, a block with itself included, that share a bucket and may hold a new link."""
    there = mixed.select("key", "node").join(blocks, "node").select("key", "block", "step", "one").distinct()
    side = lambda x: there.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "step", "one")])
    may = (F.col("block_a") <= F.col("block_b")) & (F.abs(F.col("step_a") - F.col("step_b")) <= 1)
    new = F.coalesce(F.col("one_a") != F.col("one_b"), F.lit(True))
    pairs = side("a").join(side("b"), "key").where(may & new).select("block_a", "block_b").distinct()
    return pairs.select(F.xxhash64("block_a", "block_b").alias("unit"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))


def _search(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """(node, comp) of the classes that are linked with others, and the saved tables that this reads."""
    spark = docs.sparkSession
    buckets = classes.select("node", F.explode("bands").alias("key"))
    leads = [F.min(F.col("node").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)) for s in LEADERS]
    shared = buckets.groupBy("key").agg(F.count("*").alias("m"), F.array_distinct(F.array(*leads)).alias("leads")).where("m > 1")
    members = save(buckets.join(shared.select("key", "leads"), "key"), "neardup-members")
    wanted = save(members.select("node").distinct().join(classes.select("node", "rep"), "node"), "neardup-wanted")
    sets = save(_sets(docs, id_col, text_col, wanted), "neardup-sets")
    star = save(_star(members, classes, sets, threshold), "neardup-star")
    labels = components(star, "neardup-labels")
    named = _label(members.select("key", "node"), "node", "comp", labels)
    several = named.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("node").alias("low")).where("least != most")
    mixed = save(named.join(several.select("key", "low"), "key"), "neardup-mixed")
    blocks = save(_blocks(mixed, classes, threshold), "neardup-blocks")
    units = save(_units(mixed, blocks), "neardup-units")
    payload = blocks.select("block", "node", "comp").join(classes.select("node", "odd"), "node").join(sets, "node")
    rows = units.join(payload, "block").select("unit", "block", "node", "comp", "odd", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _compare(rows.repartition(parts, "unit").sortWithinPartitions("unit", "block"), threshold)
    more = save(_label(_label(found, "a", "ca", labels), "b", "cb", labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "neardup-more")
    joined = components(more, "neardup-joined")
    drop_saved(members, sets, star, mixed, blocks, units, more)
    return _label(_label(wanted.select("node"), "node", "first", labels), "first", "comp", joined).select("node", "comp"), [wanted, labels, joined]


def _decide(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows with id, n_shingles and node; node, component and its smallest id) of ``docs``."""
    sketched = save(sketch(docs, id_col, text_col), "neardup-sketches")
    full = sketched.where("node IS NOT NULL")
    firsts = [F.first(c).alias(a) for c, a in (("n_shingles", "n"), ("bands", "bands"), ("odd", "odd"))]
    classes = save(full.groupBy("node").agg(F.min("id").alias("rep"), *firsts), "neardup-classes")
    labels, inner = _search(docs, id_col, text_col, classes, threshold)
    named = save(_label(classes.select("node", "rep"), "node", "comp", labels), "neardup-named")
    drop_saved(classes, *inner)
    rows = save(sketched.select("id", "n_shingles", "node"), "neardup-rows")
    drop_saved(sketched)
    best = named.groupBy("comp").agg(F.min("rep").alias("component"))
    return rows, named.join(best, "comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of ``docs``; component_id is the smallest id that links reach."""
    rows, final = _decide(docs, id_col, text_col, threshold)
    rows = rows.join(final.select("node", "component"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """One row of every group of near-duplicates, with all columns of ``docs``, and every row with an empty set.

    The row has the smallest id of its group.  Where several rows have that id, the text decides (its class has the
    smallest name), then the smallest text, then the other columns in their order (those that cannot be ordered: their text),
    nulls first.  Only rows whose id occurs more than once are compared so, and copies of one row are folded before the shuffle.
    """
    rows, final = _decide(docs, id_col, text_col, threshold)
    first = final.where(F.col("rep").eqNullSafe(F.col("component"))).groupBy("comp")
    chosen = save(first.agg(F.min("node").alias("__sm_node"), F.first("component").alias("__sm_rep")).drop("comp"), "neardup-chosen")
    times = rows.groupBy("id").agg(F.count("*").alias("times"), F.bool_or(F.col("node").isNull()).alias("empty"))
    single = times.where("times = 1")
    stay = single.join(chosen, F.col("id").eqNullSafe(F.col("__sm_rep")) & ~F.col("empty"), "left_semi").union(single.where("empty"))
    plain = docs.join(stay.select(F.col("id").alias("__sm_id")), F.col(id_col).eqNullSafe(F.col("__sm_id")), "left_semi")

    several = save(times.where("times > 1").select(F.col("id").alias("__sm_rep")), "neardup-several")
    rest = with_class(with_ids(docs, id_col, several), text_col, "__sm_class")
    ordered = [F.to_json(c) if docs.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in docs.columns if c != text_col]
    group = rest.join(chosen, (F.col("__sm_class") == F.col("__sm_node")) & F.col(id_col).eqNullSafe(F.col("__sm_rep")))
    smallest = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col), *ordered))
    one = group.groupBy("__sm_node").agg(smallest.alias("__sm_row")).select("__sm_row.*")
    return plain.union(one).union(rest.where("__sm_class IS NULL").select(*docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same rows by an inverted index over all shingles, for small tables: links between classes of equal sets, then what they reach.
OP8_SQL = r"""
WITH RECURSIVE
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS shingles
  FROM worded
),
classed AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN min(doc_id) OVER (PARTITION BY shingles) ELSE doc_id END AS rep, shingles FROM sets),
postings AS (SELECT doc_id AS rep, n, unnest(shingles) AS shingle FROM classed WHERE doc_id = rep),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach AS (
  SELECT DISTINCT rep AS root, rep AS node FROM classed
  UNION
  SELECT reach.root, links.b FROM reach JOIN links ON links.a = reach.node
),
named AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM classed JOIN named ON named.node = classed.rep
"""
