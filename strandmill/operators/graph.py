"""Graph operators over (src, dst) edges: expansion, cones, reachability, cycles, package projection."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Steps of plain search before shortcuts are built, and parts of a growing table before they are written as one.
PLAIN_STEPS, COMPACT = 6, 8
#: Rows of a frontier that are broadcast to the edges; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Edges of a graph, or of what is left of one, that a single task finishes; more are worked on by joins.
SMALL = 200_000


def _folder(spark: SparkSession) -> str:
    """The shared folder for what loops write; a local one is made only where none is configured and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strandmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop: write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/strandmill/{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """As ``kept``, with the partitions and their order as they are."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def expand(frontier: DataFrame, edges: DataFrame, reverse: bool = False) -> DataFrame:
    """Distinct neighbours of the nodes in ``frontier``."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return frontier.select(F.col("node").alias(a)).join(edges.where("dst IS NOT NULL"), a).select(F.col(b).alias("node")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    full = edges.where("dst IS NOT NULL").select("src", "dst")
    return full.union(full.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def cone(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` undirected steps of the seeds, with the fewest steps."""
    start = kept(seeds.select("node").distinct())
    both, out, frontier = kept(undirected(edges)), start.withColumn("depth", F.lit(0)), start
    for d in range(1, depth + 1):
        frontier = kept(expand(frontier, both).join(out.select("node"), "node", "left_anti"))
        if not frontier.limit(1).count():
            break
        out = out.union(frontier.withColumn("depth", F.lit(d)))
        if d % COMPACT == 0:
            out = kept(out)
    return out


def cones(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(owner, node): for each owner of ``seeds`` (owner, node), the nodes within ``depth`` undirected steps of its seeds."""
    both = kept(undirected(edges).withColumnsRenamed({"src": "node", "dst": "next"}))
    out = frontier = kept(seeds.select("owner", "node").distinct())
    for d in range(1, depth + 1):
        frontier = kept(frontier.join(both, "node").select("owner", F.col("next").alias("node")).distinct().join(out, ["owner", "node"], "left_anti"))
        if not frontier.limit(1).count():
            break
        out = out.union(frontier)
        if d % COMPACT == 0:
            out = kept(out)
    return out


def callers(of: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(node, callers): for each node of ``of``, nodes that lead to it, nearest first, then by name, ``most`` of them."""
    back = edges.where("dst IS NOT NULL").select(F.col("dst").alias("at"), F.col("src").alias("caller")).distinct()
    start = of.select("node").distinct()
    first = Window.partitionBy("node").orderBy("steps", "caller")
    found = kept(start.join(back, F.col("node") == F.col("at")).select("node", "caller", F.lit(1).alias("steps")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most))
    for step in range(2, most + 1):  # ``most`` callers lie within as many steps
        next_ = found.where(F.col("steps") == step - 1).join(back.withColumnRenamed("caller", "more"), F.col("caller") == F.col("at"))
        new = next_.select("node", F.col("more").alias("caller"), F.lit(step).alias("steps")).distinct().join(found, ["node", "caller"], "left_anti")
        if not new.limit(1).count():
            break
        all_ = found.drop("nth").union(new).withColumn("nth", F.row_number().over(first))
        found = kept(all_.where(F.col("nth") <= most))
    return found.groupBy("node").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


def cycle_edges(cycles: DataFrame, column: str) -> DataFrame:
    """(src, dst) of neighbours in the arrays ``column``."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(column) - 1), lambda i: F.struct(F.element_at(column, i).alias("src"), F.element_at(column, i + 1).alias("dst")))
    return cycles.where(F.size(column) > 1).select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


def shortcuts(edges: DataFrame) -> list[DataFrame]:
    """Jumps (node, to) of 1, 2, 4 ... steps along one chosen edge of each node, until no path along them is longer.

    Every table has a row per node at most.  Chosen edges may close cycles, so steps end at the number of nodes.
    """
    one = edges.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct(F.xxhash64("src", "dst"), "dst")).alias("to"))
    jumps = [kept(one)]
    n = jumps[0].count()
    while n and 1 << len(jumps) <= 2 * n:
        last = jumps[-1]
        longer = kept(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        if not longer.limit(1).count():
            break
        jumps.append(longer)
    return jumps


def _along(frontier: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``frontier`` and all nodes on the chosen paths from it: a jump of every length, longest first, meets each distance."""
    for jump in reversed(jumps):
        frontier = kept(frontier.union(_near(frontier, jump, "node").select(F.col("to").alias("node"))).distinct())
    return frontier


def _near(frontier: DataFrame, edges: DataFrame, on: str) -> DataFrame:
    """``edges`` from the nodes of ``frontier`` (node); a small frontier goes to the edges, not they to it."""
    there = frontier.select(F.col("node").alias(on))
    return edges.join(F.broadcast(there) if there.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else there, on, "left_semi")


def _is_small(edges: DataFrame, small: int) -> bool:
    return edges.limit(small + 1).count() <= small


def _in_one_task(rows: DataFrame, schema: str, solve) -> DataFrame:
    """``solve(list of (src, dst))`` over all of ``rows``, whose number has been checked."""

    def run(batches):
        pairs = [p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found = solve(pairs)
        kinds = [f.type for f in fields]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=[f.name for f in fields])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = list(to_arrow_schema(_parse_datatype_string(schema)))
    return rows.repartition(1).mapInArrow(run, schema)


def _spread(pairs: list[tuple]) -> list[tuple]:
    """Nodes that edges lead to from the sources of pairs without an end."""
    ways, seen = defaultdict(list), dict.fromkeys(a for a, b in pairs if b is None)
    for a, b in pairs:
        if b is not None:
            ways[a].append(b)
    waiting = list(seen)
    while waiting:
        for b in ways[waiting.pop()]:
            if b not in seen:
                seen[b] = None
                waiting.append(b)
    return [(n,) for n in seen]


def _components(pairs: list[tuple]) -> list[tuple]:
    """(node, smallest node) of components with several nodes: search forward for an order of leaving, then back in that order."""
    out, back = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
        back[b].append(a)
    left, seen = [], set()
    for start in list(out):
        path = [(start, iter(out[start]))] if start not in seen else []
        seen.add(start)
        while path:
            for b in path[-1][1]:
                if b not in seen:
                    seen.add(b)
                    path.append((b, iter(out.get(b, ()))))
                    break
            else:
                left.append(path.pop()[0])
    found, taken = [], set()
    for start in reversed(left):
        if start in taken:
            continue
        taken.add(start)
        group, waiting = [], [start]
        while waiting:
            n = waiting.pop()
            group.append(n)
            for a in back.get(n, ()):
                if a not in taken:
                    taken.add(a)
                    waiting.append(a)
        if len(group) > 1:
            least = min(group)
            found += [(n, least) for n in group]
    return found


def reachable(seeds: DataFrame, edges: DataFrame, reverse: bool = False, small: int = SMALL) -> DataFrame:
    """Nodes that edges lead to from the seeds, the seeds included.

    A graph of at most ``small`` edges is walked by one task.  In a larger one a few plain steps settle shallow searches.  What is
    left goes on with shortcuts: each step over all edges is followed by jumps along chosen paths, so a chain of n nodes takes
    about log n rounds.  Only emptiness and sizes reach the driver, and what has been seen is not written again but for a
    merge of its parts now and then.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    plain = kept(edges.where("dst IS NOT NULL AND src IS NOT NULL").select(F.col(a).alias("src"), F.col(b).alias("dst")))
    frontier = kept(seeds.select("node").where("node IS NOT NULL").distinct())
    kind = plain.schema["src"].dataType
    if _is_small(plain, small) and _is_small(frontier, small):
        begun = frontier.select(F.col("node").cast(kind).alias("src"), F.lit(None).cast(kind).alias("dst"))
        return kept(_in_one_task(plain.union(begun), f"node {kind.simpleString()}", _spread))
    seen, parts, jumps, step = frontier, 1, None, 0
    while frontier.limit(1).count():
        if step == PLAIN_STEPS:
            jumps = shortcuts(plain)
        new = _near(frontier, plain, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = kept(new)
        if jumps:
            frontier = kept(_along(frontier, jumps).join(seen, "node", "left_anti"))
        seen, parts, step = seen.union(frontier), parts + 1, step + 1
        if parts == COMPACT:
            seen, parts = kept(seen), 1
    return seen


def _dead_ends(rest: DataFrame) -> DataFrame:
    """(node): nodes of ``rest`` that cannot lie on a cycle: without a way on, or with only ways on that lead, one by one, to such a node."""
    out = kept(rest.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ways"), F.min("dst").alias("to")))
    final = kept(rest.select(F.col("dst").alias("node")).distinct().join(out, "node", "left_anti"))
    at = kept(out.where("ways = 1").select("node", "to"))
    n = at.count()
    for _ in range(n.bit_length()):
        onward = at.select(F.col("node").alias("to"), F.col("to").alias("next"))
        at = kept(at.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not at.where("moved").limit(1).count():
            break
        at = at.select("node", "to")
    return final.union(at.join(final.withColumnRenamed("node", "to"), "to", "left_semi").select("node"))


def _without(rest: DataFrame, gone: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        rest = rest.join(gone.select(F.col("node").alias(side)), side, "left_anti")
    return rest.select("src", "dst")


def _coloured(rest: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that leads to each node.

    Steps over all edges alternate with the running minimum along one chosen way back from each node, by doubling.
    """
    colour = kept(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("colour", F.col("node")))
    jumps, step = None, 0
    while True:
        if step == PLAIN_STEPS:
            jumps = shortcuts(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        heard = rest.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("low"))
        new = kept(colour.join(heard, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "low").alias("colour")))
        if not new.where("old <> colour").limit(1).count():
            return new.select("node", "colour")
        colour = new.select("node", "colour")
        for jump in jumps or ():
            back = jump.join(colour.withColumnsRenamed({"node": "to", "colour": "low"}), "to").select("node", "low")
            colour = kept(colour.join(back, "node", "left").select("node", F.least("colour", "low").alias("colour")))
        step += 1


def strong_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, comp) of the strongly connected components with two nodes or more; comp is their smallest node.

    Nodes that no cycle can hold are trimmed, whole chains at once.  The smallest node that leads to a node is its colour;
    what leads back to the node that names a colour, inside the colour, is that node's component: so every colour is a
    pivot with its forward set, and one search gives all backward sets.  Components are taken out and the rest goes on;
    as soon as at most ``small`` edges are left, one task finishes them.
    """
    rest = kept(edges.where("dst IS NOT NULL AND src <> dst").select("src", "dst").distinct())
    kind = edges.schema["src"].dataType.simpleString()
    found, n = [], rest.count()
    while n > small:
        for turned in (False, True):
            ways = rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if turned else rest
            rest = kept(_without(rest, _dead_ends(ways)))
        left = rest.count()
        if left < n:  # new dead ends may have come up
            n = left
            continue
        colour = _coloured(rest)
        inside = rest.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2").select("src", "dst")
        comp = reachable(colour.where("node = colour").select("node"), inside, reverse=True, small=small)
        comp = kept(comp.join(colour, "node").select("node", F.col("colour").alias("comp")))
        several = comp.groupBy("comp").count().where("count > 1").select("comp")
        found.append(kept(comp.join(several, "comp").select("node", "comp")))
        rest = kept(_without(rest, comp))
        n = rest.count()
    out = kept(_in_one_task(rest, f"node {kind}, comp {kind}", _components))
    for comp in found:
        out = out.union(comp)
    return out


def package_edges(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct edges between different packages; ``packages`` is (node, package)."""
    a = packages.select(F.col("node").alias("src"), F.col("package").alias("p"))
    b = packages.select(F.col("node").alias("dst"), F.col("package").alias("q"))
    both = edges.join(a, "src").join(b, "dst").where("p <> q")
    return both.select(F.col("p").alias("src"), F.col("q").alias("dst")).distinct()


def consecutive(events: DataFrame, order: list[str], bucket: str, value: str) -> DataFrame:
    """(src, dst): each row's ``value`` and the next one's in the order of (bucket, order), over sorted ranges."""
    from strandmill.operators import ranges

    return ranges.consecutive(events, [bucket, *order], value)
