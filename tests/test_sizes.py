"""What must not grow faster than the input: joins of sets, short lists of findings."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import clones, findings, graph, sessions, setjoin


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("dense, block", [(False, None), (True, 7), (True, 1000)])
@pytest.mark.parametrize("threshold", [0.25, 1.0])
def test_marks_and_common_items(spark, threshold, dense, block, kind):
    rng = random.Random(8)
    name = (lambda k: k) if kind == "long" else (lambda k: f"é{k}")
    sets = {name(k): {name(i): rng.random() < 0.2 for i in rng.sample(range(30), rng.randrange(1, 12))} for k in range(40)}
    rows = [(k, i, m) for k, s in sets.items() for i, m in s.items()] + [(name(3), None, True), (None, name(1), True)]
    rows += [(name(5), name(40), None), (name(6), name(40), True), (name(6), name(40), False), (name(7), name(40), True)]
    sets[name(5)][name(40)], sets[name(6)][name(40)], sets[name(7)][name(40)] = False, True, True
    df = spark.createDataFrame(rows, f"o {kind}, i {kind}, m boolean")
    found = setjoin.overlaps(df, "o", "i", threshold, 3, mark="m", common=True, dense=dense, block=block)
    got = sorted((r.a, r.b, r.overlap, round(r.coefficient, 9), r.marked, tuple(r.common)) for r in found.collect())
    want = []
    for a in sets:
        for b in sets:
            both = sorted(set(sets[a]) & set(sets[b]))
            share = len(both) / min(len(sets[a]), len(sets[b]))
            if a < b and both and share >= threshold:
                want.append((a, b, len(both), round(share, 9), any(sets[a][i] and sets[b][i] for i in both), tuple(both)))
    assert got == sorted(want)


@pytest.mark.parametrize("dense", [False, True])
def test_no_sets(spark, dense):
    none = spark.createDataFrame([], "o long, i long, m boolean")
    assert setjoin.overlaps(none, "o", "i", 0.5, mark="m", common=True, dense=dense).collect() == []


def test_tasks_of_blocks_grow_with_the_sets(spark):
    """What a task looks at grows no faster than the number of sets."""
    n = 200_000
    sets = setjoin.Overlaps(spark.range(n).selectExpr("id AS o", "id % 2 AS i"), "o", "i", 0.25)
    meetings, tasks = sets.parts * (sets.parts + 1) // 2, sets.pairs().rdd.getNumPartitions()  # no blocks meet for that
    assert sets.dense and -(-meetings // tasks) * sets.block**2 <= 25 * n


@pytest.mark.parametrize("tasks", [1, 5])
def test_several_meetings_in_a_task(spark, monkeypatch, tasks):
    rng = random.Random(5)
    sets = {k: set(rng.sample(range(20), rng.randrange(1, 9))) for k in range(40)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "o long, i long")
    monkeypatch.setattr(setjoin, "MEETINGS", tasks)
    found = setjoin.overlaps(df, "o", "i", 0.5, dense=True, block=7)
    assert found.rdd.getNumPartitions() == tasks
    want = [(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= min(len(sets[a]), len(sets[b]))]
    assert sorted((r.a, r.b, r.overlap) for r in found.collect()) == sorted(want)


def test_items_beyond_one_product(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "COLUMNS", 8)
    monkeypatch.setattr(setjoin, "CELLS", 40)
    monkeypatch.setattr(setjoin, "BATCH", 20)
    rng = random.Random(9)
    sets = [sorted(rng.sample(range(50), rng.randrange(1, 20))) for _ in range(30)]
    n = [len(s) for s in sets]
    import numpy as np
    import pyarrow as pa

    def side(rows):
        return setjoin._Sets(pa.array(rows), pa.array(range(50)), np.array([n[r] for r in rows]), np.concatenate([np.array(sets[r]) for r in rows]), np.concatenate([np.array(sets[r]) % 7 == 0 for r in rows]))

    got = [tuple(r.values()) for b in setjoin.pairs_of_blocks(side(list(range(12))), side(list(range(12, 30))), False, 0.25, True, False) for r in b.to_pylist()]
    both = lambda a, b: set(sets[a]) & set(sets[b])
    want = [(a, b, len(both(a, b)), min(n[a], n[b]), any(i % 7 == 0 for i in both(a, b))) for a in range(12) for b in range(12, 30) if both(a, b) and 4 * len(both(a, b)) >= min(n[a], n[b])]
    assert sorted(got) == sorted(want)


def test_conflicts_leave_their_task_complete(spark):
    """Pairs are not joined with anything: they may be the square of the sessions."""
    df = spark.range(200).select((F.col("id") % 40).alias("session"), (F.col("id") % 9).alias("file"), (F.col("id") % 5 == 0).alias("direct"))
    found = sessions.conflicts(df)
    files = [{(k + 40 * t) % 9 for t in range(5)} for k in range(40)]
    assert "Join" not in _plan(found)
    assert found.count() == sum(4 * len(files[a] & files[b]) >= min(len(files[a]), len(files[b])) and bool(files[a] & files[b]) for b in range(40) for a in range(b))


def _random_findings(rng, n):
    return [(rng.choice(["a", "b", "c", None]), rng.choice("kl"), rng.choice(["error", "warn", "info", "other"]), rng.choice([0.1, 0.5, 0.9]), rng.choice("tu")) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 3, 12, 40])
def test_counts_without_sorting(spark, n):
    rng = random.Random(n)
    schema = "id string, kind string, severity string, confidence double, target string"
    for _ in range(3):
        rows = _random_findings(rng, n)
        single = [(f"s{k}" if k % 2 else f"b{k}", "m", rng.choice(["error", "warn"]), rng.choice([0.1, 0.5, 0.7]), "t") for k in range(n // 3)]
        some, ones = spark.createDataFrame(rows, schema), spark.createDataFrame(single, schema)
        assert findings.count(some).first()[0] == findings.distinct(some).count()
        assert findings.count(some, ones).first()[0] == findings.distinct(some.union(ones)).count()


def test_top_sorts_a_beginning_only(spark, monkeypatch):
    """Of 4,000 equal findings and three others the first three are found, and ``ranked`` never sees all rows where the first will do."""
    schema = "id string, kind string, severity string, confidence double, target string"
    rows = [("x", "k", "error", 0.9, str(k)) for k in range(4000)] + [("y", "k", "error", 0.8, "t"), ("z", "k", "warn", 0.9, "t"), ("w", "k", "warn", 0.8, "t")]
    got = sorted(findings.top(spark.createDataFrame(rows, schema), 3).collect(), key=lambda r: r.position)
    assert [(r.id, r.target) for r in got] == [("x", "0"), ("y", "t"), ("z", "t")] and all(r.truncated for r in got)
    assert not any(r.truncated for r in findings.top(spark.createDataFrame(rows[3999:], schema), 4).collect())
    seen, ranked = [], findings.ranked
    monkeypatch.setattr(findings, "ranked", lambda df: seen.append(df.count()) or ranked(df))
    many = spark.range(5000).selectExpr("concat('i', id) AS id", "'k' AS kind", "'warn' AS severity", "id % 7 / 7 AS confidence", "'t' AS target")
    assert findings.top(many, 5).count() == 5 and max(seen) < 200


def test_codes_of_a_block_take_little_memory():
    """Six workers of an executor hold such arrays at once."""
    import tracemalloc

    import numpy as np
    import zstandard

    from strandmill.llm import ppm

    sizes, data = np.full(4000, 2000, np.int64), np.random.default_rng(1).integers(97, 123, 8_000_000, np.uint8).tobytes()
    blob = zstandard.compress(data, 1)
    tracemalloc.start()
    found = sum(len(ppm.gram_codes(part, offsets, ppm.ORDER)[0]) for _, _, part, offsets in ppm._pieces(sizes, blob))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000 * 2001 and peak < 60_000_000


def _touches(rng, n, files, kind):
    name = (lambda k: k) if kind == "long" else (lambda k: f"s{k}")
    return [(name(k), f, rng.random() < 0.3) for k in range(n) for f in rng.sample(range(files), rng.randrange(1, files // 2))]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("how", [{"dense": False}, {"dense": True, "block": 7}, {"dense": True, "block": 1000}])
def test_conflicts_by_number(spark, how, kind, monkeypatch):
    """Tallies and partners say of all pairs what the pairs themselves say, and no pair leaves its task to be counted."""
    monkeypatch.setattr(setjoin, "TALLIES", 50)
    df = spark.createDataFrame(_touches(random.Random(3), 40, 14, kind), f"session {kind}, file long, direct boolean")
    found = sessions.Conflicts(df, **how)
    rows = found.rows().collect()
    want, got = {}, {}
    for r in rows:
        want[r.a, r.severity, r.confidence] = want.get((r.a, r.severity, r.confidence), 0) + 1
    for r in found.tallies().collect():
        got[r.a, r.severity, r.confidence] = got.get((r.a, r.severity, r.confidence), 0) + r.pairs
    assert got == want
    some = sorted({r.a for r in rows})[:2]
    partners = found.sets.partners(spark.createDataFrame([(a,) for a in some], f"a {kind}"))
    assert sorted((r.a, r.b, r.overlap) for r in partners.collect()) == sorted((r.a, r.b, r.overlap) for r in rows if r.a in some)
    assert sorted(found.rows(least=0.6).collect()) == sorted(r for r in rows if r.coefficient >= 0.6)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("block", [7, 1000])
def test_conflicts_are_numbered_not_sorted(spark, block, kind, monkeypatch):
    """Positions are those of ``ranked``, with other findings before, among and behind, and only sums of pairs are sorted."""
    rng = random.Random(4)
    df = spark.createDataFrame(_touches(rng, 45, 12, kind), f"session {kind}, file long, direct boolean")
    ids = [None, "a", "b", "semantic_clone:1", "t", "zz"]
    others = [(rng.choice(ids), "k", rng.choice(["error", "warn", "info"]), rng.choice([0.25, 0.5, 0.99, 0.33]), "t") for _ in range(60)]
    some = spark.createDataFrame(others, "id string, kind string, severity string, confidence double, target string")
    as_findings = lambda rows, *more: findings.finding(rows, "session_conflict", F.concat_ws(":", "a", "b"), F.col("a"), *more)
    conflicts = sessions.Conflicts(df, dense=True, block=block)
    want = sorted(findings.ranked(some.unionByName(as_findings(conflicts.rows()))).collect(), key=lambda r: r.position)
    monkeypatch.setattr(setjoin, "BATCH", 60)
    seen, ranked = [], findings.ranked
    monkeypatch.setattr(findings, "ranked", lambda df: seen.append(df.count()) or ranked(df))
    got = findings.ranked_with(some, conflicts, as_findings).select(*want[0].__fields__)
    assert sorted(got.collect(), key=lambda r: r.position) == want
    assert max(seen) < len(want)


def _dealt(node) -> list[str]:
    """The columns of each step of a plan that deals rows out."""
    below = [node.children().apply(k) for k in range(node.children().size())]
    return [node.output().mkString(",")] * ("Repartition" in node.nodeName()) + [part for child in below for part in _dealt(child)]


def test_blocks_are_not_shuffled_to_their_meetings(spark, monkeypatch):
    """A block meets the root of the sets: only numbers of blocks are dealt out, and blocks too many to be broadcast meet as well."""
    df = spark.createDataFrame(_touches(random.Random(6), 60, 12, "long"), "session long, file long, direct boolean")
    conflicts = sessions.Conflicts(df, dense=True, block=7)
    found, counted = conflicts.rows(), conflicts.tallies()
    for df in (found, counted):
        dealt = _dealt(df._jdf.queryExecution().optimizedPlan())
        assert dealt and not any("codes" in part for part in dealt)
    monkeypatch.setattr(setjoin, "BROADCAST_BYTES", 0)
    assert sorted(conflicts.rows().collect()) == sorted(found.collect())
    assert sorted(conflicts.tallies().collect()) == sorted(counted.collect())


def test_ranked_findings_are_read_from_their_ranges(spark, monkeypatch):
    """Findings are dealt out by order and by range, and not again: what comes back is written rows and a row per range."""
    dealt, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: dealt.extend(_dealt(df._jdf.queryExecution().optimizedPlan())) or kept(df))
    found = spark.createDataFrame(_random_findings(random.Random(9), 40), "id string, kind string, severity string, confidence double, target string")
    out = findings.ranked(found)
    assert len(dealt) <= 1 and "Window" not in _plan(out) and "Aggregate" not in _plan(out)
    assert sorted(r.position for r in out.collect()) == list(range(1, out.count() + 1))


def test_only_pairs_that_share_a_chosen_item(spark):
    rows = [(*r, r[1] in (2, 5)) for r in _touches(random.Random(5), 40, 14, "long")]
    df = spark.createDataFrame(rows, "session long, file long, direct boolean, near boolean")
    for block in (7, 1000):
        got = sessions.Conflicts(df, only="near", block=block).rows(common=True).collect()
        want = [r for r in sessions.Conflicts(df, dense=False).rows(common=True).collect() if {2, 5} & set(r.common)]
        assert sorted(got) == sorted(want)
        assert sum(r.pairs for r in sessions.Conflicts(df, only="near", block=block).tallies().collect()) == len(want)


def test_a_component_is_named_once():
    """The smallest node is sought once per component, not once per node."""
    compared = []

    class Node(int):
        __hash__ = int.__hash__

        def __lt__(self, other):
            compared.append(1)
            return int(self) < int(other)

    nodes = [Node(k) for k in range(300)]
    found = graph._components([(nodes[k], nodes[(k + 1) % 300]) for k in range(300)])
    assert sorted(found, key=lambda f: int(f[0])) == [(k, 0) for k in range(300)]
    assert len(compared) < 600


def test_texts_are_hashed_once(spark, tmp_path):
    """Candidates come from written lanes: no plan over them hashes texts again, and pieces of any length are hashed as by hashlib."""
    from hashlib import md5

    import numpy as np

    from strandmill.functions.md5 import halves
    from strandmill.plans import bindings

    words = ["".join(random.Random(k).choices("abcdefgh", k=k % 23 + 1)) for k in range(60)]
    docs = [(k, " ".join(random.Random(k // 2).sample(words, 30)), "s") for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = bindings.lsh_candidates(spark, str(tmp_path))
    assert "MapInArrow" not in _plan(found)
    lanes = {r.id: (r.l0, r.l1, r.l2, r.l3) for r in bindings.simhash_lanes(spark, str(tmp_path)).collect()}

    def plain(text):
        w = text.split()
        marks = [int.from_bytes(md5(" ".join(w[i : i + 5]).encode()).digest()[:8], "big") for i in range(len(w) - 4)]
        voted = sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) >= len(marks))
        return tuple(voted >> 48 - 16 * k & 0xFFFF for k in range(4))

    assert lanes == {k: plain(t) for k, t, _ in docs}
    first = {plain(t): k for k, t, _ in reversed(docs)}
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for x, a in first.items() for y, b in first.items() if a < b and any(p == q for p, q in zip(x, y, strict=True)))
    data = bytes(random.Random(1).randrange(256) for _ in range(400))
    starts = np.array([0, 5, 5, 7, 11, 0, 400, 390])
    ends = np.array([0, 5, 6, 62, 67, 400, 400, 400])
    got = np.concatenate([d for _, d in halves(np.frombuffer(data, np.uint8), starts, ends)])
    assert [g.tobytes() for g in got] == [md5(data[a:b]).digest()[:8] for a, b in zip(starts, ends, strict=True)]


def test_texts_are_cut_into_tokens_once(spark):
    docs = spark.createDataFrame([(1, "a " * 24, "s"), (2, "a " * 23, "s"), (3, None, "s"), (4, "", None)], "k long, t string, g string")
    found = clones.fingerprints(docs, "k", "t", "g")
    assert [(r.id, r.grp, r.n_tokens, r.tokens) for r in found.collect()] == [(1, "s", 24, ["a"] * 24)]
    assert _plan(found).count("regexp_extract_all") == 1
