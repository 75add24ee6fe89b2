"""Checks over small source trees."""

from pyspark.sql import functions as F

from strandmill.functions import paths
from strandmill.functions import source_text as text
from strandmill.operators import factstore, findings, sessions
from strandmill.plans import codebase

A = """import { bValue } from "./b";

export interface UserShape {
  id: string;
  name: string;
  age: number;
}

export function publicApi(input: string) {
  if (input) { return bValue + 1; }
  const x = input.length; const y = x * 2;
  return x + y + bValue;
}
"""
B = """import { publicApi } from "./a";
export interface AccountShape {
  id: string;
  name: string;
  age: number;
}
export const bValue: number = 1;
"""
C = "export const c = 1;\n"


def facts(spark, *rows):
    return codebase.index(spark.createDataFrame(list(rows), "path string, source string"))


def test_facts_of_two_files(spark):
    f = facts(spark, ("src/a.ts", A), ("src/b.ts", B))
    assert {tuple(r) for r in f.imports.select("src", "dst", "line").collect()} == {("src/a.ts", "src/b.ts", 1), ("src/b.ts", "src/a.ts", 1)}
    got = {tuple(r) for r in f.exports.collect()}
    assert ("src/a.ts", "publicApi", "fn(string)") in got and ("src/b.ts", "bValue", "value:number") in got
    members = {tuple(r[0]) for r in f.shapes.select("members").collect()}
    assert members == {("prop:age:rw:req:number", "prop:id:rw:req:string", "prop:name:rw:req:string")}
    assert [r[0] for r in f.prints.select("id").collect()] == ["src/a.ts::publicApi"]


def test_check_and_risk(spark):
    f = facts(spark, ("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))
    base = spark.createDataFrame([("publicApi", "src/a.ts", "fn(number)")], "export_name string, path string, signature string")
    kinds = [r["kind"] for r in codebase.check(f, ["src/c.ts"], base).orderBy("position").collect()]
    assert kinds[:3] == ["api_drift", "cycle", "type_shape_duplicate"] and kinds.count("dead_code") == 4
    assert codebase.change_risk(f, ["src/a.ts"], ["src/c.ts"])[1].first()["score"] > 10
    assert [r["node"] for r in codebase.impact_cone(f, ["src/a.ts"]).collect()] == ["src/a.ts", "src/b.ts"]


def test_resolution_of_parents_extensions_and_indexes(spark):
    rows = [("lib/x.ts", "import '../util/y';\nimport './z.js';\nimport 'react';\nimport('./sub');\n"), ("util/y.ts", ""), ("lib/z.ts", ""), ("lib/sub/index.ts", "")]
    got = {(r["specifier"], r["dst"], r["is_dynamic"]) for r in facts(spark, *rows).imports.collect()}
    assert got == {("../util/y", "util/y.ts", False), ("./z.js", "lib/z.ts", False), ("react", None, False), ("./sub", "lib/sub/index.ts", True)}


def test_braces_in_strings_and_comments():
    s = 'function f() { const a = "}"; /* } */ return `{`; } // }'
    assert [b["body"] for b in text.file_facts(s)["blocks"]] == [s[s.index("{") : s.rindex("} //") + 1]]
    assert text.syntax_problem(s) is None and text.syntax_problem("a {\n(\n") == "unmatched { in line 1; unmatched ( in line 2"


def test_declarations():
    s = """import a, { b } from 'm1';
import type { T } from "m2";
import "m3";
import type from 'm4';
export * from "m5";
export { x, y as z } from './m6';
// import no from 'm7';
const lazy = () => { return import('./m8'); };
export default async function go(a: string | number, b) { return 1; }
export const n: readonly string[] = [], m = 2;
export const f = async (q: string) => { if (q) { return "}"; } };
export class Box { }
export interface Face<T> { }
export type Pair = Record<string, User>;
export {
  one,
  two as three,
};
"""
    found = text.file_facts(s)
    assert [(i["specifier"], i["is_type_only"], i["is_dynamic"], i["line"]) for i in found["imports"]] == [
        ("m1", False, False, 1), ("m2", True, False, 2), ("m3", False, False, 3), ("m4", False, False, 4), ("m5", False, False, 5), ("./m6", False, False, 6), ("./m8", False, True, 8),
    ]
    assert {e["export_name"]: e["signature"] for e in found["exports"]} == {
        "x": "reexport", "z": "reexport", "go": "fn(string|number,unknown)", "n": "value:Tstring[]", "f": "value:unknown", "Box": "class", "Face": "interface",
        "Pair": "type:record<string,T>", "one": "reexport", "three": "reexport",
    }
    assert [(b["symbol"], b["kind"], b["start_line"]) for b in found["blocks"]] == [("go", "function", 9), ("lazy", "arrow", 8), ("f", "arrow", 11)]


def test_members():
    s = """export interface A extends B {
  readonly id: string;
  'quoted name'?: number | Foo | Bar;
  run(x: string, y): Promise<void>;
  [key: string]: unknown;
  nested: { a: string };
}
type One = { id: string; name: string };
class C {
  public readonly a: string = "x";
  constructor(q: string): void {}
  public async load(n: number): Promise<Foo> {
    return n;
  }
}
type NotAShape = string;
"""
    found = {x["symbol"]: x["members"] for x in text.file_facts(s)["shapes"]}
    assert found["A"] == ["index:unknown", "method:run:req:string,unknown->promise<void>", "prop:id:ro:req:string", "prop:nested:rw:req:{T:string}", "prop:quoted name:rw:opt:T|number"]
    assert found["One"] == ["prop:id:rw:req:string"] and found["C"] == ["method:load:req:number->promise<T>", "prop:a:ro:req:string"] and len(found) == 3


def test_an_isolated_file_is_a_low_risk(spark):
    f = facts(spark, ("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))
    base = f.exports.select("export_name", "path", "signature")
    few = codebase.Layers(near_clones=False, session_conflicts=False)
    risk = codebase.assess(f, ["src/c.ts"], codebase.Options(("src/*.ts",), layers=few), baseline=base)
    assert risk.total.first()[:] == (10, 1, "low") and [r["kind"] for r in risk.reasons.collect()] == ["public_exports"]
    assert findings.safe_to_edit(risk.total).first()["safe_to_edit"]
    more = codebase.assess(f, ["src/a.ts"], codebase.Options(("src/c.ts",), layers=few), baseline=base)
    got = {r["kind"]: (r["n"], r["severity"]) for r in more.reasons.orderBy("position").collect()}
    assert got["cycles"] == (1, "warn") and got["nearby_findings"][1] == "warn" and "api_drift" not in got
    assert [r["target"] for r in more.focus.collect()][0] == "src/a.ts"


def test_options_paths_and_drift_callers(spark):
    f = facts(spark, ("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))
    base = spark.createDataFrame([("bValue", "src/b.ts", "value:string"), ("gone", "src/c.ts", "class")], "export_name string, path string, signature string")
    options = codebase.Options(("src/c.ts",), (("src/a*", "pa"), ("src/b*", "pb")))
    found = codebase.all_findings(f, options, base)
    rows = {r["id"]: r for r in found.collect()}
    drift = rows["api_drift:src/b.ts:bValue:value:string:value:number"]
    assert drift["files"] == ["src/a.ts", "src/b.ts"] and len(drift["evidence"]) == 2
    assert rows["cycle:package:pa|pb"]["severity"] == "error" and rows["cycle:package:pa|pb"]["files"] == ["pa", "pb"]
    only = spark.createDataFrame([("src/c.ts",)], "path string")
    assert {r["id"] for r in codebase.all_findings(f, options, base, paths=only).collect()} == {"api_drift:src/c.ts:gone:class:<removed>"}
    off = codebase.Layers(*[False] * 7)
    assert codebase.all_findings(f, codebase.Options(layers=off), base).count() == 0
    assert codebase.layer_boundaries(f, options.packages)[1].count() == 1
    nodes, edges = codebase.drift_map(f, found)
    ids, kinds = {r["id"]: r["severity"] for r in nodes.collect()}, {(r["from_id"], r["to_id"], r["kind"]) for r in edges.collect()}
    assert ids["package:pa"] == "error" and ids["export:src/c.ts:gone"] == "error" and ids["file:src/b.ts"] == "error"
    assert {("file:src/a.ts", "export:src/b.ts:bValue", "depends_on"), ("package:pa", "package:pb", "imports"), ("file:src/c.ts", "export:src/c.ts:gone", "exports"), ("file:src/a.ts", "file:src/b.ts", "imports")} <= kinds
    assert codebase.api_surface(f, 2).count() == 2 and codebase.healthy(codebase.health(f)).first()[:] == (True, [])


def test_sessions_over_files(spark):
    f = facts(spark, ("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))
    touches = spark.createDataFrame([("s1", 1, "src/c.ts"), ("s1", 5, "src/a.ts"), ("s2", 6, "src/b.ts"), ("s3", 7, "src/c.ts"), (" ", 7, "src/c.ts")], "session string, at long, path string")
    seen = sessions.snapshots(touches, f.edges)
    assert {(r["session"], r["file"], r["direct"]) for r in seen.collect()} == {("s1", "src/a.ts", True), ("s1", "src/b.ts", False), ("s2", "src/b.ts", True), ("s2", "src/a.ts", False), ("s3", "src/c.ts", True)}
    found = codebase.session_findings(seen, 10).collect()
    assert [(r["id"], r["severity"], r["confidence"], r["files"]) for r in found] == [("session_conflict:s1:s2", "warn", 0.99, ["src/a.ts", "src/b.ts"])]
    assert codebase.session_findings(seen, 10, session="s2").first()["symbols"] == ["s2", "s1"] and codebase.session_findings(seen, 10, session="sx").count() == 0
    assert codebase.session_findings(seen, 10**9).count() == 0


def test_incremental_index_and_store(spark, tmp_path):
    scan = lambda *rows: spark.createDataFrame([(p, s, str(hash(s))) for p, s in rows], "path string, source string, digest string")
    st = factstore.FactStore(spark, str(tmp_path / "facts"), 4)
    assert codebase.index_changes(st, scan(("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))) == 3
    assert codebase.index_changes(st, scan(("src/a.ts", A), ("src/b.ts", B), ("src/c.ts", C))) == 0
    assert {tuple(r) for r in codebase.load(st).imports.select("src", "dst").collect()} == {("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")}
    assert codebase.index_changes(st, scan(("src/a.ts", A), ("src/c.ts", C + "export const d = 2;\n"))) == 1
    now = codebase.load(st)
    assert {r["path"] for r in now.files.collect()} == {"src/a.ts", "src/c.ts"} and {tuple(r) for r in now.imports.select("src", "dst").collect()} == {("src/a.ts", "src/b.ts")}
    assert {r["export_name"] for r in now.exports.collect()} == {"publicApi", "UserShape", "c", "d"}
    base = st.load("api_baseline")
    assert base.count() == 5 and not factstore.bootstrap_baseline(st)
    factstore.cache_findings(st, "k", codebase.all_findings(now, codebase.Options(("src/c.ts",))), 1)
    factstore.cache_findings(st, "k", codebase.all_findings(now, codebase.Options(("src/*",))), 2)
    assert st.load("findings_cache") is None  # the second result, which is empty, replaces the first
    st.upsert("correlations", spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "owner string, at long, v string"), "owner", "at")
    st.upsert("correlations", spark.createDataFrame([("x", 2, "c"), ("y", 0, "d")], "owner string, at long, v string"), "owner", "at")
    assert {tuple(r) for r in st.load("correlations").select("owner", "v").collect()} == {("x", "c"), ("y", "b")}
    codebase.observe(st, spark.createDataFrame([("s", 3, "src/a.ts")], "session string, at long, path string"))
    assert st.load("sessions").count() == 2
    day = 86_400_000
    st.overwrite("log", spark.createDataFrame([(k, k * day) for k in range(9)], "seq long, at long"), "seq")
    assert codebase.maintain(st, "log", 8 * day, 2, 3) == [("log", 5), ("sessions", 2), ("ring", 2)] and st.load("log").count() == 9
    codebase.maintain(st, "log", 8 * day, 2, 3, dry_run=False)
    assert {r["seq"] for r in st.load("log").collect()} == {7, 8} and st.load("sessions") is None
    assert codebase.rebuild(st, scan(("src/c.ts", C))) == 1 and st.load("files").count() == 2
    codebase.rebuild(st, scan(("src/c.ts", C)), dry_run=False)
    assert st.load("files").count() == 1 and not st.has("findings_cache") and st.load("api_baseline").count() == 5
    assert codebase.load(st).shapes.count() == 0 and codebase.load(st).exports.count() == 1


def test_paths(spark):
    rows = [("/r/src/./a.ts",), ("src/b/../a.ts",), ("/other/x.ts",), ("../x.ts",), ("src/n.md",), ("node_modules/y.ts",), ("src/c.tsx",), ("ts",)]
    got = paths.candidate_files(spark.createDataFrame(rows, "path string"), "/r", ["node_modules/**"], ["ts", "tsx"])
    assert {r["path"] for r in got.collect()} == {"src/a.ts", "src/c.tsx"}


def test_generated_files_have_no_blocks(spark):
    f = facts(spark, ("g.ts", "// @generated\n" + A))
    assert f.prints.count() == 0 and f.shapes.count() == 0 and f.exports.count() == 2


def test_tokens_and_suppression(spark):
    df = spark.createDataFrame([("const x = 'a' + 12;", ["prop:code:rw:req:string", "prop:message:rw:req:string", "prop:status:rw:req:number"])], "s string, m array<string>")
    row = df.select(text.normal_tokens(F.col("s")), text.suppressed(F.col("m"))).first()
    assert row[0] == ["const", "ID", "=", "LIT", "+", "LIT", ";"] and row[1]


def test_a_copy_in_other_files_is_reported_for_each(spark):
    body = "export function work(input: string) {\n" + "".join(f"  const v{i} = input.length + {i}; if (v{i}) {{ call{i}(input); }}\n" for i in range(40))
    near = body + "  other(input, input);\n}\n"
    rows = [("a.ts", body + "}\n"), ("b.ts", body + "}\n"), ("c.ts", body + "}\n"), ("d.ts", near), ("e.ts", near)]
    found = codebase.check(facts(spark, *rows), []).where("kind = 'semantic_clone' AND id LIKE '%|%'").collect()
    assert {r["id"].split(":", 1)[1] for r in found} == {f"{x}.ts::work|{y}.ts::work" for x in "abc" for y in "de"}
