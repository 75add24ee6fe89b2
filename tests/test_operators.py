"""Operators against plain Python on small tables."""

import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.operators import changes, clones, findings, graph, sessions, store
from strandmill.sources import tree
from strandmill.streaming import changes as streams


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def closure(pairs):
    out = set(pairs)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def test_components_match_mutual_reachability(spark):
    random.seed(3)
    pairs = [(random.randrange(12), random.randrange(12)) for _ in range(18)]
    reach = closure(pairs)
    mutual = {a: min([a, *[b for b in range(12) if (a, b) in reach and (b, a) in reach]]) for a in range(12) if any((a, b) in reach and (b, a) in reach and a != b for b in range(12))}
    assert {r["node"]: r["comp"] for r in graph.strong_components(edges(spark, pairs)).collect()} == mutual


def test_self_loops_are_no_cycles(spark):
    assert graph.strong_components(edges(spark, [(1, 1), (1, 2)])).count() == 0


def test_cone_depths_and_reachability(spark):
    e = edges(spark, [(1, 2), (2, 3), (4, 3), (5, 6)])
    one = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.cone(one, e, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r[0] for r in graph.reachable(one, e).collect()} == {1, 2, 3}


def test_consecutive_crosses_buckets(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (2, 3, "c"), (1, 4, "d")], "day int, at int, who string")
    assert {tuple(r) for r in graph.consecutive(rows, ["at"], "day", "who").collect()} == {("a", "b"), ("b", "d"), ("d", "c")}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=20))
def test_percentile_rank(spark, xs):
    df = spark.createDataFrame([("k", x, i) for i, x in enumerate(xs)], "k string, v int, i int")
    row = sessions.percentiles(df, "k", "v", ["i"]).first()
    s = sorted(xs)
    assert (row["p50"], row["p95"], row["most"]) == (s[math.ceil((len(s) - 1) * 0.5)], s[math.ceil((len(s) - 1) * 0.95)], s[-1])


def test_conflicts(spark):
    rows = [(1, "a", True), (1, "b", False), (2, "a", True), (3, "b", False), (3, "c", False), (3, "d", False), (3, "e", False), (4, "z", True)]
    got = {(r["a"], r["b"]): (r["overlap"], r["severity"]) for r in sessions.conflicts(spark.createDataFrame(rows, "session int, file string, direct boolean")).collect()}
    assert got == {(1, 2): (1, "error"), (1, 3): (1, "warn")}


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("u", t, t) for t in (0, 1, 2, 3, 4, 5, 9)], "u string, at long, id long")
    assert sorted(r["at"] for r in sessions.cooldown(df, "u", "at", "id", 2).collect()) == [0, 2, 4, 9]


def test_store(spark):
    t = spark.createDataFrame([("a", 10), ("b", 20)], "name string, until int")
    d = spark.createDataFrame([("a", 99), ("b", 99), ("c", 99)], "name string, until int")
    got = {r["name"]: (r["until"], r["changed"]) for r in store.conditional_upsert(t, d, "name", F.col("old_until") <= 15).collect()}
    assert got == {"a": (99, True), "b": (20, False), "c": (99, True)}
    assert sorted(r["until"] for r in store.replace_by_key(t, d.where("name = 'a'"), "name").collect()) == [20, 99]
    assert store.keyed(t, t.limit(0), "name").count() == 0


def test_snapshot_diff_partitions_keys(spark):
    b, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in changes.snapshot_diff(b, c, "k").collect()} == {(1, "removed"), (2, "unchanged"), (3, "added")}


def test_finding_order_and_truncation(spark):
    rows = [("b", "k", "warn", 0.9, "t"), ("a", "k", "warn", 0.9, "t"), ("a", "k", "warn", 0.9, "t"), ("c", "k", "error", 0.1, "t"), ("d", "k", "info", 1.0, "t")]
    got = findings.top(spark.createDataFrame(rows, "id string, kind string, severity string, confidence double, target string"), 3).orderBy("position").collect()
    assert [r["id"] for r in got] == ["c", "a", "b"] and got[0]["truncated"]


def test_equal_findings_do_not_use_up_the_limit(spark):
    rows = [("a", "k", "warn", 0.9, "t")] * 90 + [(f"b{i:03}", "k", "warn", 0.5, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "id string, kind string, severity string, confidence double, target string")
    got = findings.top(df, 50).collect()
    assert len(got) == 50 and all(r["truncated"] for r in got) and findings.omitted(df, 50).first()[:] == (201, 50, 151, 1)


def test_debounce_in_a_stream_equals_batch(spark, tmp_path):
    rows = [("s", f"2024-01-01 00:00:0{i // 4}.{(i % 4) * 150:03d}", f"f{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "s string, at string, f string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["started"], tuple(r["items"]), r["n"]) for r in streams.debounced(df, "s", "at", "f").collect()}
    stream = streams.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "s", "at", "f", late="0 seconds")
    seen = []
    q = streams.upsert_stream(stream, lambda b, i: seen.extend((r["started"], tuple(r["items"]), r["n"]) for r in b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(batch) == 3 and set(seen) <= batch and len(seen) >= 2  # the last batch waits for the watermark


def test_tree_scan_baseline_and_config(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("src/a.ts", "src/b.txt", "node_modules/c.js", "yarn.lock"):
        (tmp_path / name).write_text("x")
    assert [r["path"] for r in tree.scan(spark, str(tmp_path)).collect()] == ["src/a.ts"]
    assert [r["name"] for r in tree.lockfiles(spark, str(tmp_path)).collect()] == ["yarn.lock"]
    found = spark.createDataFrame([("i", "k", "warn", "fix")], "id string, kind string, severity string, action string")
    tree.write_baseline(found, str(tmp_path / "base"), 5)
    assert tree.baseline(spark, str(tmp_path / "base")).first()["id"] == "i"
    assert tree.load_config('{ // c\n "a": [1, 2,], /* x */ "b": "// no",}') == {"a": [1, 2], "b": "// no"}


def test_handoff_of_empty_tables(spark):
    e = edges(spark, [])
    assert graph.strong_components(e).count() == 0 and graph.undirected(e).count() == 0
    assert list(itertools.chain(graph.reachable(spark.createDataFrame([], "node long"), e).collect())) == []


def near_copies():
    base = [f"{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"] * 2
    near = base.copy()
    near[150] = "changed"
    return [(i, " ".join(near if i in (2, 5) else base), "g") for i in range(7)]


def test_near_misses_name_every_copy(spark):
    df = spark.createDataFrame(near_copies(), "id long, t string, g string")
    prints = clones.fingerprints(df, "id", "t", "g")
    pairs = clones.near_misses(prints, 12)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 2)}
    assert {tuple(r) for r in clones.members(prints).collect()} == {(i, 2 if i in (2, 5) else 0) for i in range(7)}
    every = [(r["a"], r["b"]) for r in clones.between_members(pairs, prints).collect()]
    assert sorted(every) == sorted((min(i, j), max(i, j)) for i in (0, 1, 3, 4, 6) for j in (2, 5))


def test_cut_lanes_lose_no_pair(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), rng.randrange(3), rng.randrange(40), rng.randrange(40)) for i in range(60)]
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and any(p == q for p, q in zip(x[1:], y[1:], strict=True)))
    got = clones.band_candidates(spark.createDataFrame(rows, "id long, l0 int, l1 int, l2 int, l3 int"), lane_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cooldown_of_a_frequent_key_fills_many_ranges(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.8 else f"u{rng.randrange(9)}", rng.randrange(4000), i) for i in range(3000)]
    want, last = set(), {}
    for u, t, i in sorted(rows):
        if u not in last or t - last[u] >= 37:
            last[u] = t
            want.add((u, t, i))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows stay in several ranges
    try:
        got = sessions.cooldown(spark.createDataFrame(rows, "u string, at long, id long"), "u", "at", "id", 37)
        assert {(r["u"], r["at"], r["id"]) for r in got.collect()} == want
        assert got.where("u = 'hot'").groupBy(F.spark_partition_id()).count().count() > 1  # not folded in one task
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
