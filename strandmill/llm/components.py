"""Connected components by contraction; every round is written out.

In a round each root that still has neighbours looks at them and itself and follows the one whose hash,
seeded by the round, is smallest; pointers are then followed twice more.  Since the order of the hashes
changes with the round, an ordered chain contracts as fast as any other: the number of roots falls by
a constant factor a round, whatever the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.scratch import drop_saved, save


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every end of ``edges`` (a, b); comp is the same for all nodes of a component and one of them.

    Ends of an edge are not null; repeated edges, loops and empty tables are allowed.  Only whether edges
    between different roots are left reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = save(both.where("a != b").distinct(), f"{name}-edges")
    labels = save(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), name)
    turn = 0
    while live.limit(1).count():
        order = lambda x: F.xxhash64(x, F.lit(turn))  # noqa: E731, B023
        nearest = live.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("at"))).alias("low"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("at"))
        steps = save(nearest.select(F.col("a").alias("root"), F.least("low", own)["at"].alias("to")), f"{name}-steps")
        for _ in range(2):
            onward = steps.select(F.col("root").alias("to"), F.col("to").alias("next"))
            steps = steps.join(onward, "to").select("root", F.col("next").alias("to"))
        jumps = save(steps, f"{name}-jumps")
        moved = labels.join(jumps, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        end = lambda x: jumps.select(F.col("root").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731, B023
        left = live.join(end("a"), "a").join(end("b"), "b").where("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct()
        old = (labels, live, jumps)
        labels, live = save(moved, name), save(left, f"{name}-edges")
        drop_saved(*old)
        turn += 1
    drop_saved(live)
    return labels
