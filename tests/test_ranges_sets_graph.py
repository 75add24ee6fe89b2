"""Range scans, set joins, graph searches, ranking and neighbours against plain computations, with hot keys and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import findings, graph, neighbours, ranges, sessions, setjoin


def _events(rng, n=400):
    # One user has a third of all rows; times repeat; one id and one time are null.
    rows = [(k, "hot" if k % 3 == 0 else f"u{rng.randrange(9)}", rng.randrange(0, 900) * 10) for k in range(n)]
    return [*rows, (n, None, 5), (n + 1, "u1", 5)]


def test_turns_and_debounce_over_ranges(spark):
    rows = _events(random.Random(1))
    frame = spark.createDataFrame(rows, "event_id long, user string, at long").repartition(5)
    got = {r.event_id: r.turn for r in sessions.turns(frame, "user", "at", "event_id").collect()}
    batches = sorted((r.user or "", r.batch, r.started, r.ended, r.n) for r in sessions.debounce(frame, "user", "at", "event_id", 20).collect())
    want, runs = {}, []
    for user in {r[1] for r in rows}:
        before, batch = None, 0
        for n, (i, _, at) in enumerate(sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))):
            want[i] = f"turn-{n + 1}"
            if before is None or at - before > 20:
                batch += 1
                runs.append([user or "", batch, at, at, 0])
            runs[-1][3:] = [at, runs[-1][4] + 1]
            before = at
    assert got == want
    assert batches == sorted(map(tuple, runs))


def test_neighbours_in_order_cross_ranges(spark):
    rows = _events(random.Random(2))
    frame = spark.createDataFrame(rows, "event_id long, user string, at long").repartition(5)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    want = sorted((a[0], b[0]) for a, b in zip(order[:-1], order[1:]))
    assert sorted(map(tuple, ranges.consecutive(frame, ["at", "event_id"], "event_id").collect())) == want
    assert ranges.consecutive(frame.limit(0), ["at", "event_id"], "event_id").collect() == []


def test_equal_neighbours_collapse_whatever_their_severity(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), "k", rng.choice(["error", "warn", "info"]), rng.choice([0.5, 0.7, 0.9]), str(n)) for n in range(120)]
    rows += [("x", "k", "error", 0.95, "t"), ("x", "k", "error", 0.94, "t"), (None, "k", "warn", 0.1, "t")]
    frame = spark.createDataFrame(rows, "id string, kind string, severity string, confidence double, target string").repartition(7)
    rank = {"error": 2, "warn": 1, "info": 0}
    one = {}
    for r in rows:
        one[r[2], r[3], r[0]] = min(one.get((r[2], r[3], r[0]), r[4]), r[4])
    order = sorted(one, key=lambda k: (-rank[k[0]], -k[1], k[2] is not None, k[2] or ""))
    want = [k for n, k in enumerate(order) if n == 0 or k[2] is None or order[n - 1][2] != k[2]]
    got = sorted(findings.ranked(frame).collect(), key=lambda r: r.position)
    assert [(r.severity, r.confidence, r.id) for r in got] == want and [r.position for r in got] == list(range(1, len(want) + 1))
    top = sorted(findings.top(frame, 3).collect(), key=lambda r: r.position)
    assert [(r.severity, r.confidence, r.id) for r in top] == want[:3] and all(r.truncated for r in top)
    assert sum(k[2] == "x" for k in want) == 1


@pytest.mark.parametrize("item_rows", [3, 4096])
@pytest.mark.parametrize("threshold", [0.25, 0.5, 1.0])
def test_overlap_join(spark, item_rows, threshold):
    rng = random.Random(4)
    sets = {k: set(rng.sample(range(40), rng.randrange(1, 14))) | ({99} if k % 3 == 0 else set()) for k in range(60)}
    rows = [(k, i) for k, s in sets.items() for i in s for _ in range(1 + (i == 99))] + [(None, 1), (1, None)]
    got = sorted((r.a, r.b, r.overlap, round(r.coefficient, 9)) for r in setjoin.overlaps(spark.createDataFrame(rows, "o long, i long"), "o", "i", threshold, item_rows).collect())
    want = [(a, b, len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 9)) for a in sets for b in sets if a < b]
    assert got == sorted(w for w in want if w[2] and w[3] >= threshold)


def test_contained(spark):
    rng = random.Random(5)
    items = {k: set(rng.sample(range(60), rng.randrange(1, 9))) for k in range(30)}
    docs = {k: set(rng.sample(range(80), rng.randrange(0, 50))) for k in range(40)}
    flat = lambda d: spark.createDataFrame([(k, i) for k, s in d.items() for i in s], "id long, item long")
    found = setjoin.contained(flat(items).withColumnRenamed("id", "q"), flat(docs).withColumnRenamed("id", "d"), "q", "d", "item", 0.75)
    want = sorted((q, d, len(s & t), len(s)) for q, s in items.items() for d, t in docs.items() if 4 * len(s & t) >= 3 * len(s))
    assert sorted((r.q, r.d, r.overlap, r.n) for r in found.collect()) == want


def _closure(edges):
    reach = {n: {n} for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n, r in reach.items():
                if a in r and b not in r:
                    r.add(b)
                    changed = True
    return reach


@pytest.mark.parametrize("small", [0, 200_000])
def test_reachable_and_components(spark, small):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(34)] + [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("c12", "c9"), ("c9", "c9")]
    frame = spark.createDataFrame([*edges, ("n1", None)], "src string, dst string")
    reach = _closure(edges)
    seeds = spark.createDataFrame([("n1",), ("c2",), ("alone",)], "node string")
    got = {r.node for r in graph.reachable(seeds, frame, small=small).collect()}
    assert got == reach["n1"] | reach["c2"] | {"alone"}
    comps = {r.node: r.comp for r in graph.strong_components(frame, small=small).collect()}
    want = {n: min(m for m in r if n in reach[m]) for n, r in reach.items() if sum(n in reach[m] for m in r) > 1}
    assert comps == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    written = []
    plain = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: (written.append(1), plain(df))[1])
    seed = spark.createDataFrame([(0,)], "node long")
    assert graph.reachable(seed, chain, small=0).count() == n + 1
    assert len(written) < 80
    written.clear()
    assert graph.strong_components(chain, small=0).count() == 0
    assert len(written) < 80


def test_depth_is_honoured(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(15)], "src long, dst long")
    assert max(r.depth for r in graph.cone(spark.createDataFrame([(0,)], "node long"), chain, 12).collect()) == 12


def test_neighbours_are_exact(spark):
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 0.15) for x in base[k % 12]]) for k in range(300)]
    rows += [(500 + k, base[0]) for k in range(30)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0]), (None, base[1]), (904, [None] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<double>, cosine string")
    found = neighbours.neighbours(frame, "vec_id", "v", F.col("id") % 10 == 0, 0.9, 5, block=7)
    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 6 and v[0] is not None and 0 < sum(x * x for x in v) < 1e9}
    want = []
    for q in good:
        if q % 10 == 0:
            norm = lambda v: sum(x * x for x in v) ** 0.5
            near = sorted((-round(sum(x * y for x, y in zip(good[q], v)) / norm(good[q]) / norm(v), 9), i) for i, v in good.items() if i != q)
            want += [(q, i, round(-c, 6), k + 1) for k, (c, i) in enumerate([n for n in near if -n[0] >= 0.9][:5])]
    got = [(r.id, r.neighbour, r.cosine, r.rank) for r in found.collect()]
    # Equal vectors differ in the last bit of their cosine, so ranks among them are not compared.
    assert sorted(g[::2] for g in got) == sorted(w[::2] for w in want)
    assert len(set(got)) == len(want)
    assert neighbours.neighbours(frame.limit(0), "vec_id", "v", F.col("id") % 10 == 0).collect() == []
