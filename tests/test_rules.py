"""Rules of the code-base checks: tokens, layers, limits, keys, health, baselines, change streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandmill.functions import paths
from strandmill.functions import source_text as text
from strandmill.operators import factstore, findings, graph, sessions
from strandmill.plans import codebase
from strandmill.sources import tree
from strandmill.streaming import changes as streams

ONE = 'import { two } from "./two";\nexport type Pair = { left: string; right: number; both: boolean };\nexport function one(a: number) {\n  if (a) { return two; }\n  let b = a; b++; return b ?? two;\n}\n'
TWO = 'import { one } from "./one";\nexport const two: number = 2;\n'


def test_operators_are_tokens(spark):
    said = "i++; --j; a ?? b; f(...c); d ^ ~e; 0xFF + 1.5; 'it\\'s' + \"x\" + `t\\`u`; $n === m => !== 'open"
    got = spark.createDataFrame([(said,)], "s string").select(text.normal_tokens(F.col("s"))).first()[0]
    want = "ID ++ ; -- ID ; ID ?? ID ; ID ( ... ID ) ; ID ^ ~ ID ; LIT + LIT ; LIT + LIT + LIT ; ID === ID => !== ID"
    assert got == want.split()
    long_ = spark.createDataFrame([("'" + "x\\n" * 30_000 + "'",)], "s string").select(text.normal_tokens(F.col("s"))).first()[0]
    assert long_ == ["LIT"]


def test_layers_that_are_off_are_not_extracted(spark):
    files = spark.createDataFrame([("one.ts", ONE), ("two.ts", TWO)], "path string, source string")
    off = codebase.Layers(exact_clones=False, near_clones=False, type_shapes=False, cycles=True, dead_code=False, api_drift=False, session_conflicts=False)
    f = codebase.index(files, 1, 1, off)
    assert f.imports.count() == 2 and f.exports.count() == f.prints.count() == f.shapes.count() == 0
    options = codebase.Options(layers=off)
    assert {r.kind for r in codebase.all_findings(f, options).collect()} == {"cycle"}
    none = codebase.Layers(*[False] * 7)
    assert codebase.index(files, 1, 1, none).imports.count() == 0 and codebase.all_findings(f, codebase.Options(layers=none)).count() == 0


def test_limits_and_evidence(spark):
    assert [findings.findings_limit(a, c) for a, c in ((0, 40), (10, 40), (90, 40), (0, 0), (5, 0))] == [40, 10, 40, 1, 1]
    assert [findings.files_limit(a, c) for a, c in ((None, 10), (0, 10), (500, 10), (500, 300))] == [50, 1, 200, 300]
    f = codebase.index(spark.createDataFrame([("one.ts", ONE), ("two.ts", TWO)], "path string, source string"), 1, 1)
    whole = codebase.check(f, [], limit=0, options=codebase.Options(("none",), max_findings=2))
    assert whole.count() == 2 and whole.where("truncated").count() == 2
    shown = codebase.check(f, ["none"], evidence=False)
    assert shown.count() and shown.where(F.size("evidence") > 0).count() == 0
    assert codebase.check(f, ["none"]).where(F.size("evidence") > 0).count() == 1
    row = spark.createDataFrame([(["b", "c"], ["a"])], "l array<string>, r array<string>").select(findings.pair_key(F.col("l"), F.col("r")), findings.pair_key(F.col("r"), F.col("l"))).first()
    assert row[:] == ("a|b|c", "a|b|c")


def test_extensions_are_case_sensitive(spark):
    got = paths.candidate_files(spark.createDataFrame([("a.TS",), ("b.ts",)], "path string"), "/r", [], ["ts"])
    assert [r.path for r in got.collect()] == ["b.ts"]


def test_conflicts_are_filtered_by_whole_file_lists(spark):
    rows = [(s, 0, f"f{k:02}.ts", True) for s in ("x", "y") for k in range(20)]
    seen = spark.createDataFrame(rows, "session string, at long, file string, direct boolean")
    found = graph.kept(codebase.session_findings(seen, 0))
    late = spark.createDataFrame([("f19.ts",)], "path string")
    assert len(found.first().files) == 20 and findings.touching(found, late).count() == 1
    assert len(findings.top(found, 5).first().files) == 12
    old = seen.withColumn("at", F.lit(-900_001))
    assert sessions.stale(old, 0).count() == 40 and sessions.active(old, 0).count() == 0


def test_health_of_index_jobs(spark):
    f = codebase.index(spark.createDataFrame([("one.ts", ONE)], "path string, source string"))
    told = lambda **n: {r.name: r.status for r in codebase.health(f, spark.createDataFrame(list(n.items()), "status string, n long"), 10).collect()}
    assert told(queued=12, done=2) == {"queue_depth": "fail", "queue_drops": "ok", "index_failures": "ok", "index_state": "ok"}
    assert told(queued=9, done=3, failed=1, dropped=2) == {"queue_depth": "warn", "queue_drops": "warn", "index_failures": "warn", "index_state": "ok"}
    checks = codebase.health(f, spark.createDataFrame([("failed", 1)], "status string, n long"))
    assert codebase.healthy(checks).first()[:] == (True, ["index_failures"])


GOOD = {"id": "a", "kind": "cycle", "severity": "warn", "action": "x"}
BASELINES = [
    ([GOOD], None),
    ("no json {", ("$", "must be an object")),
    ([1], ("$.findings[0]", "must be an object")),
    ({"version": 2, "generatedAtUnixMs": 1, "findings": []}, ("$", "unsupported version")),
    ({"version": "1", "generatedAtUnixMs": 1, "findings": []}, ("$", "unsupported version")),
    ({"version": 1, "generatedAtUnixMs": "1", "findings": []}, ("$", "generatedAtUnixMs must be a number")),
    ({"version": 1, "generatedAtUnixMs": 1, "findings": {}}, ("$", "findings must be an array")),
    ([GOOD, {**GOOD, "id": 3}], ("$.findings[1]", "id must be a string")),
    ([{**GOOD, "kind": "other"}], ("$.findings[0]", "kind is invalid")),
    ([{**GOOD, "severity": "fatal"}], ("$.findings[0]", "severity is invalid")),
    ([{k: v for k, v in GOOD.items() if k != "action"}], ("$.findings[0]", "action must be a string")),
]


def test_baselines_are_checked_field_by_field(spark, tmp_path):
    for n, (doc, problem) in enumerate(BASELINES):
        path = tmp_path / f"{n}.json"
        whole = {"version": 1, "generatedAtUnixMs": 5, "findings": doc} if isinstance(doc, list) else doc
        path.write_text(whole if isinstance(whole, str) else json.dumps(whole, indent=1))
        found, problems = tree.read_baseline(spark, str(path))
        assert [tuple(r) for r in problems.collect()] == ([problem] if problem else []), doc
        if problem:
            with pytest.raises(ValueError, match=problem[1].split()[0]):
                tree.baseline(spark, str(path), strict=True)
        else:
            assert [r.asDict() for r in tree.baseline(spark, str(path), strict=True).collect()] == [GOOD]


def test_upsert_by_two_columns(spark, tmp_path):
    store = factstore.FactStore(spark, str(tmp_path / "s"))
    put = lambda *rows: store.upsert("correlations", spark.createDataFrame(list(rows), "kind string, owner string, fleet string, at long"), ["kind", "owner"], "at")
    put(("job", "1", "a", 5), ("run", "1", "b", 5))
    put(("job", "1", "c", 4), ("run", "1", "d", 6), ("run", None, "e", 1))
    assert sorted(map(tuple, store.load("correlations").select("kind", "owner", "fleet").collect()), key=repr) == [("job", "1", "a"), ("run", "1", "d"), ("run", None, "e")]


def test_change_stream_reaches_the_store_through_a_failure(spark, tmp_path, monkeypatch):
    sources = {"one.ts": ONE, "two.ts": TWO, "gone.ts": "export const gone = 1;\n"}
    scan = lambda names: spark.createDataFrame([(p, s, hashlib.sha256(s.encode()).hexdigest()) for p, s in sources.items() if p in names], "path string, source string, digest string")
    store = factstore.FactStore(spark, str(tmp_path / "store"))
    codebase.index_changes(store, scan(["one.ts", "gone.ts"]), min_tokens=1, min_statements=1)
    del sources["gone.ts"]
    sources["one.ts"] = ONE.replace("one(", "uno(")
    schema = "session string, at timestamp, path string"
    events = spark.createDataFrame([("s", f"2024-01-01 00:00:0{k}", p) for k, p in enumerate(["one.ts", "two.ts", "gone.ts", "one.ts"])], "session string, at string, path string").select("session", F.col("at").cast("timestamp").alias("at"), "path")
    events.union(spark.createDataFrame([("end", "x")], "session string, path string").select("session", F.lit("2024-01-02").cast("timestamp"), "path")).coalesce(1).write.parquet(str(tmp_path / "in"))

    reads = []

    def read(paths):
        names = [r.path for r in paths.collect()]
        reads.append(sorted(names))
        return scan(names)

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.index_stream(stream, store, read, str(tmp_path / "checkpoint"), gap="2 seconds").awaitTermination()

    plain, calls = factstore.FactStore.replace, []

    def broken(self, name, *more):
        calls.append(name)
        if len(calls) == 4:
            raise OSError("lost between two tables")
        return plain(self, name, *more)

    monkeypatch.setattr(factstore.FactStore, "replace", broken)
    with pytest.raises(Exception, match="lost between two tables"):
        run()
    monkeypatch.setattr(factstore.FactStore, "replace", plain)
    run()
    got = codebase.load(store)
    want = codebase.index(scan(["one.ts", "two.ts"]).select("path", "source"), 24, 3)
    for name in ("imports", "exports", "prints", "shapes"):
        columns = [c for c in getattr(want, name).columns if c in getattr(got, name).columns]
        assert sorted(map(str, getattr(got, name).select(*columns).collect())) == sorted(map(str, getattr(want, name).select(*columns).collect())), name
    n = len(reads)
    assert n >= 2 and store.applied("index", 0)
    run()
    assert len(reads) == n
