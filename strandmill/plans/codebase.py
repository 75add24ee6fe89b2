"""A code base as fact tables, and the checks over them: clones, shapes, cycles, dead code, drift, sessions, risk, maps."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import source_text as text
from strandmill.functions.paths import candidates, glob_pattern
from strandmill.operators import changes, clones, factstore, findings, graph, sessions, store


@dataclass(frozen=True)
class Facts:
    """files (path, source, problem), imports, exports, prints (function fingerprints), shapes."""

    files: DataFrame
    imports: DataFrame
    exports: DataFrame
    prints: DataFrame
    shapes: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.imports.select("src", "dst")


@dataclass(frozen=True)
class Layers:
    """Kinds of findings to look for; one that is off contributes nothing and costs nothing."""

    exact_clones: bool = True
    near_clones: bool = True
    type_shapes: bool = True
    cycles: bool = True
    dead_code: bool = True
    api_drift: bool = True
    session_conflicts: bool = True


@dataclass(frozen=True)
class Options:
    """What a check goes by: entry points and packages as globs, thresholds, layers."""

    entrypoints: tuple[str, ...] = ()
    packages: tuple[tuple[str, str], ...] = ()  # (glob, package), the first that fits
    radius: int = 6
    overlap: float = 0.25
    layers: Layers = Layers()
    max_findings: int = 200


def parts_for(layers: Layers) -> tuple[str, ...]:
    """What has to be read from files for ``layers``; what none of them needs is not extracted."""
    needed = {
        "imports": layers.cycles or layers.dead_code or layers.api_drift or layers.session_conflicts,
        "exports": layers.dead_code or layers.api_drift,
        "blocks": layers.exact_clones or layers.near_clones,
        "shapes": layers.type_shapes,
    }
    return tuple(part for part, need in needed.items() if need)


def _scanned(files: DataFrame, known: DataFrame, min_tokens: int, min_statements: int, layers: Layers = Layers()) -> Facts:
    """Facts of ``files``; specifiers are resolved among the paths of ``known``."""
    found = graph.kept(text.facts(files, parts_for(layers)))  # the files are read once for all five tables
    raw = found.select("path", F.explode("imports").alias("i")).select(F.col("path").alias("src"), "i.*")
    resolved = changes.first_match(raw.select("src", "specifier").distinct(), known.select("path"), candidates(F.col("src"), F.col("specifier")), ["src", "specifier"])
    imports = raw.join(resolved, ["src", "specifier"], "left").select("src", F.col("to_path").alias("dst"), "specifier", "is_dynamic", "is_type_only", "line")
    exports = found.select("path", F.explode("exports").alias("e")).select("path", "e.*")
    blocks = found.select("path", F.explode("blocks").alias("b")).select("path", "b.*")
    prints = blocks.withColumn("tokens", text.normal_tokens(F.col("body"))).withColumn("statements", text.statements(F.col("body")).cast("long"))
    prints = prints.withColumns({"n_tokens": F.size("tokens").cast("long"), "hash": text.token_hash(F.col("tokens"))}).drop("body")
    prints = prints.where((F.col("n_tokens") >= min_tokens) & (F.col("statements") >= min_statements))
    prints = prints.select(F.concat_ws("::", "path", "symbol").alias("id"), F.col("path").alias("grp"), "symbol", "kind", "start_line", "end_line", "tokens", "n_tokens", "statements", "hash")
    shapes = found.select("path", F.explode("shapes").alias("s")).select(F.concat_ws("::", "path", "s.symbol").alias("id"), "path", "s.members")
    shapes = shapes.where(F.size("members") >= 3).withColumns({"shape_hash": text.token_hash(F.col("members")), "suppressed": text.suppressed(F.col("members"))})
    shapes = shapes.withColumns({"depth": text.depth(F.col("members")).cast("int"), "preview": text.preview(F.col("members"))})
    return Facts(found.select("path", "source", "problem"), imports, exports, prints, shapes)


def index(files: DataFrame, min_tokens: int = 24, min_statements: int = 3, layers: Layers = Layers()) -> Facts:
    """Fact tables of ``files`` (path, source), as far as ``layers`` need them."""
    return _scanned(files, files, min_tokens, min_statements, layers)


def index_changes(facts: factstore.FactStore, scan: DataFrame, asked: DataFrame | None = None, min_tokens: int = 24, min_statements: int = 3) -> int:
    """Bring stored facts up to date with ``scan`` (path, source, digest); the number of files that were read again.

    Files whose digest is known are skipped; paths of ``asked`` (default: all stored ones) that the scan lacks lose the rows of
    all five tables, while edges of other files to them stay.  A repeat after a failure ends in the same tables.
    """
    old = facts.load("files")
    paths = scan.select("path")
    new = graph.kept(scan if old is None else store.unchanged_skipped(scan, old, ["path", "digest"]))
    known = paths if old is None else paths.union(old.select("path")).distinct()
    if old is not None:
        gone = graph.kept((old if asked is None else asked).select("path").distinct().join(paths, "path", "left_anti"))
        known = known.join(gone, "path", "left_anti")
        if gone.limit(1).count():
            for name, key in factstore.FACTS.items():
                if facts.has(name):
                    facts.replace(name, facts.load(name).limit(0), key, gone.select(F.col("path").alias(key)))
    n = new.count()
    if n:
        found = _scanned(new, known, min_tokens, min_statements)
        for field in fields(Facts):
            key, rows = factstore.FACTS[field.name], getattr(found, field.name)
            if field.name != "files":
                facts.replace(field.name, rows, key, new.select(F.col("path").alias(key)))
        # The digests come last: until they are written, a repeat reads the files again.
        facts.replace("files", found.files.join(new.select("path", "digest"), "path"), "path")
    factstore.bootstrap_baseline(facts)
    return n


def load(facts: factstore.FactStore) -> Facts:
    """The stored facts; a table without rows is empty."""
    found = {f.name: facts.load(f.name) for f in fields(Facts)}
    if any(table is None for table in found.values()):
        none = facts.spark.createDataFrame([], "path string, source string")
        empty = _scanned(none, none, 1, 1)
        found = {name: getattr(empty, name) if table is None else table for name, table in found.items()}
    return Facts(**found)


def rebuild(facts: factstore.FactStore, scan: DataFrame, dry_run: bool = True) -> int:
    """Clear the stored facts and read all files again; a dry run only counts them."""
    if dry_run:
        return scan.count()
    factstore.clear_index(facts)
    return index_changes(facts, scan)


def maintain(facts: factstore.FactStore, log: str, now_ms: int, keep: int, retain_days: int, dry_run: bool = True) -> list[tuple[str, int]]:
    """(what, rows that go) for the log (seq, at, ...) by number and age and for the sessions by age; applied unless a dry run."""
    rows = facts.load(log)
    seen = facts.load("sessions")
    if rows is None:
        return []
    young, seen_young, counts = factstore.prune(rows, rows.limit(0) if seen is None else seen, "at", now_ms, retain_days)
    ring = store.newest(young, "seq", keep)
    out = [(r[0], r[1]) for r in counts.collect()] + [("ring", max(0, young.count() - keep))]
    if not dry_run:
        facts.overwrite(log, ring, "seq")
        if seen is not None:
            facts.overwrite("sessions", seen_young, "session")
    return out


def observe(facts: factstore.FactStore, touches: DataFrame) -> None:
    """Keep the last batch of each session of ``touches`` (session, at, path) with the files around it."""
    imports = facts.load("imports")
    edges = touches.sparkSession.createDataFrame([], "src string, dst string") if imports is None else imports.select("src", "dst")
    facts.replace("sessions", sessions.snapshots(touches, edges), "session")


def shape_duplicates(shapes: DataFrame) -> DataFrame:
    out = shapes.where("NOT suppressed").groupBy("shape_hash").agg(F.array_sort(F.collect_set("id")).alias("symbols"))
    return out.where(F.size("symbols") >= 2).withColumns({"severity": F.lit("warn"), "confidence": F.lit(0.93)})


def glob_entrypoints(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files named by ``patterns``; none given: the first file."""
    if not patterns:
        return files.select(F.col("path").alias("node")).orderBy("node").limit(1)
    return files.where(F.col("path").rlike(glob_pattern(list(patterns)))).select(F.col("path").alias("node"))


def packages_of(files: DataFrame, packages) -> DataFrame:
    """(node, package): the first package whose glob fits; files without one are left out."""
    name = F.lit(None).cast("string")
    for glob, package in reversed(packages):
        name = F.when(F.col("path").rlike(glob_pattern([glob])), package).otherwise(name)
    return files.select(F.col("path").alias("node"), name.alias("package")).where("package IS NOT NULL")


def _cycles(edges: DataFrame, package_level: bool) -> DataFrame:
    found = graph.strong_components(edges).groupBy("comp").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    severity = F.lit("error") if package_level else F.when(F.size("nodes") > 3, "error").otherwise("warn")
    found = found.withColumns({"severity": severity, "confidence": F.lit(0.98 if package_level else 0.95), "package_level": F.lit(package_level)})
    said = "one of several packages that need each other" if package_level else "a file on a loop of imports"
    proof = F.transform("nodes", lambda n: findings.proof("graph_edge", n, F.lit(None), F.lit(said), F.col("confidence")))
    key = F.concat_ws(":", F.lit("package" if package_level else "file"), F.array_join("nodes", "|"))
    action = F.lit(findings.ACTIONS["package_cycle" if package_level else "cycle"])
    return findings.detailed(found, "cycle", key, F.array_join("nodes", "|"), F.col("nodes"), F.col("nodes"), action, proof)


def package_cycles(facts: Facts, packages) -> DataFrame:
    """Cycles among packages as findings: files named by package globs, edges between different packages."""
    return _cycles(graph.package_edges(facts.edges, packages_of(facts.files, packages)), True)


def layer_boundaries(facts: Facts, packages, limit: int = 50) -> tuple[list[tuple[str, str]], DataFrame]:
    """The package globs and the first ``limit`` cycles across them."""
    return list(packages), findings.top(package_cycles(facts, packages), limit)


def session_findings(seen: DataFrame, now_ms: int, overlap: float = 0.25, session: str | None = None, ttl_ms: int = 900_000) -> DataFrame:
    """Conflicts of the active sessions of ``seen`` (session, at, file, direct) as findings."""
    live = sessions.active(seen, now_ms, ttl_ms)
    both = sessions.first_named(sessions.conflicts(live.select("session", "file", "direct"), overlap, common=True), live.select("session").distinct(), session)
    return as_session_findings(both)


def as_session_findings(both: DataFrame, *more: str) -> DataFrame:
    """Rows of ``sessions.Conflicts`` as findings; without their common files as findings without details."""
    key = F.concat_ws(":", F.least("a", "b"), F.greatest("a", "b"))
    if "common" not in both.columns:
        return findings.finding(both, "session_conflict", key, F.col("a"), *more)
    said = F.format_string("%s and %s work on the same files: %s of the smaller set", "a", "b", F.format_number("coefficient", 2))
    proof = F.array(findings.proof("session_overlap", F.get("common", F.lit(0)), F.lit(None), said, F.col("coefficient")))
    return findings.detailed(both, "session_conflict", key, F.col("a"), F.col("common"), F.array("a", "b"), F.lit(findings.ACTIONS["session_conflict"]), proof, more)


@dataclass(frozen=True)
class Sessions:
    """The sessions of ``session_findings`` before they are paired: pairs may be the square of them, so they are not written."""

    seen: DataFrame
    now_ms: int
    overlap: float = 0.25
    ttl_ms: int = 900_000

    def conflicts(self, near: DataFrame | None = None) -> sessions.Conflicts:
        """With ``near`` (path) those whose common files include one of it."""
        live = sessions.active(self.seen, self.now_ms, self.ttl_ms).select("session", "file", "direct")
        if near is None:
            return sessions.Conflicts(live, self.overlap)
        return sessions.Conflicts(live.join(near.select(F.col("path").alias("file")).distinct().withColumn("near", F.lit(True)), "file", "left"), self.overlap, only="near")


def drift_findings(facts: Facts, baseline: DataFrame) -> DataFrame:
    """What changed or went against ``baseline`` (path, export_name, signature), with the nearest callers."""
    drift = changes.api_drift(baseline, facts.exports, ["export_name", "path"])
    used = graph.callers(drift.select(F.col("path").alias("node")), facts.edges)
    both = drift.join(used, F.col("path") == F.col("node"), "left").withColumn("callers", F.coalesce("callers", F.array().cast("array<string>")))
    action = F.when(F.col("after") == "<removed>", findings.ACTIONS["api_removed"]).otherwise(findings.ACTIONS["api_changed"])
    proof = lambda c: findings.proof("signature", F.col("path"), F.col("export_name"), F.concat(F.lit(f"{c}: "), c), F.col("confidence"))
    key = F.concat_ws(":", "path", "export_name", "before", "after")
    return findings.detailed(both, "api_drift", key, F.col("path"), F.concat(F.array("path"), "callers"), F.array("export_name"), action, F.array(proof("before"), proof("after")))


def all_findings(facts: Facts, options: Options = Options(), baseline: DataFrame | None = None, conflicts: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Findings of all layers with their details; with ``paths`` (path) those that touch one of them.

    Clones and shapes are then looked for among these paths only; cycles, drift and dead code need the whole code base.
    """
    layers, parts = options.layers, []
    within = lambda df, c: df if paths is None else df.join(paths.select(F.col("path").alias(c)).distinct(), c, "left_semi")
    prints, shapes = within(facts.prints, "grp"), within(facts.shapes, "path")
    file_of = lambda s: F.substring_index(s, "::", 1)
    if layers.exact_clones:
        exact = clones.exact_buckets(prints).withColumn("confidence", F.lit(0.99))
        where = prints.groupBy("hash").agg(F.array_sort(F.collect_set("id")).alias("ids"))
        exact = exact.join(where, "hash")
        parts.append(findings.detailed(exact, "semantic_clone", F.col("hash"), F.col("first_id"), F.transform("ids", file_of), F.col("ids"), F.lit(findings.ACTIONS["exact_clone"])))
    if layers.near_clones:
        near = clones.between_members(clones.near_misses(prints, options.radius), prints).withColumn("severity", F.lit("warn"))
        proof = F.array(findings.proof("simhash", file_of(F.col("a")), F.col("a"), F.format_string("hamming distance %d", "hamming"), F.col("confidence")))
        parts.append(findings.detailed(near, "semantic_clone", findings.pair_key(F.array("a"), F.array("b")), F.col("a"), F.array(file_of(F.col("a")), file_of(F.col("b"))), F.array("a", "b"), F.lit(findings.ACTIONS["near_clone"]), proof))
    if layers.type_shapes:
        same = graph.kept(shape_duplicates(shapes))
        key = F.concat_ws(":", "shape_hash", F.array_join("symbols", "|"))
        parts.append(findings.detailed(same, "type_shape_duplicate", key, F.element_at("symbols", 1), F.transform("symbols", file_of), F.col("symbols"), F.lit(findings.ACTIONS["type_shape_duplicate"])))
    if layers.cycles:
        parts.append(_cycles(facts.edges, False))
        if options.packages:
            parts.append(package_cycles(facts, options.packages))
    if layers.dead_code:
        live = graph.reachable(glob_entrypoints(facts.files, list(options.entrypoints)), facts.edges).withColumnRenamed("node", "path")
        dynamic = facts.imports.where("is_dynamic").select(F.col("dst").alias("path"))
        dead = changes.dead_exports(facts.exports, live, dynamic, "path")
        parts.append(findings.detailed(dead, "dead_code", F.concat_ws(":", "path", "export_name"), F.col("path"), F.array("path"), F.array("export_name"), F.lit(findings.ACTIONS["dead_code"])))
    if layers.api_drift and baseline is not None:
        parts.append(drift_findings(facts, baseline))
    if layers.session_conflicts and conflicts is not None:
        parts.append(conflicts)
    if not parts:
        none = findings.detailed(facts.files.limit(0).withColumns({"severity": F.lit(""), "confidence": F.lit(0.0)}), "", F.col("path"), F.col("path"), F.array("path"), F.array("path"), F.lit(""))
        return none
    out = reduce(DataFrame.unionByName, parts)
    if paths is None:
        return out
    out = graph.kept(out)
    # A drift shows its nearest callers; it touches a path that leads to it however far.
    led = graph.reachable(paths.select(F.col("path").alias("node")), facts.edges)
    drifts = findings.of_kinds(out, "api_drift").join(led.withColumnRenamed("node", "target"), "target", "left_semi").select(*out.columns)
    return findings.touching(out.where("kind <> 'api_drift'"), paths).select(*out.columns).union(drifts)


def check(facts: Facts, entrypoints: list[str], baseline: DataFrame | None = None, radius: int = 6, limit: int = 50, options: Options | None = None, conflicts: DataFrame | None = None, paths: DataFrame | None = None, evidence: bool = True) -> DataFrame:
    """Findings of all layers in canonical order, the first ``limit``: 0 for all that the options allow, which is also the most."""
    options = options or Options(tuple(entrypoints), radius=radius)
    found = findings.top(all_findings(facts, options, baseline, conflicts, paths), findings.findings_limit(limit, options.max_findings))
    return found if evidence else findings.without_evidence(found)


def impact_cone(facts: Facts, paths: list[str], depth: int = 2, limit: int | None = None, options: Options = Options()) -> DataFrame:
    """(node, depth, omitted): files within ``depth`` import steps of ``paths``, the first ``limit`` by name, and how many more there are.

    ``limit`` is 50 if not given.  A path that is not indexed is an error.
    """
    limit = findings.files_limit(limit, options.max_findings)
    seeds = facts.files.where(F.col("path").isin(paths)).select(F.col("path").alias("node"))
    known = {r[0] for r in seeds.collect()}  # at most the paths asked for
    if lost := sorted(set(paths) - known):
        raise ValueError(f"not indexed: {', '.join(lost)}")
    whole = graph.kept(graph.cone(seeds, facts.edges, depth))
    left = F.greatest(F.lit(0), whole.count() - F.lit(limit)).cast("long")
    return whole.orderBy("node").limit(limit).withColumn("omitted", left)


@dataclass(frozen=True)
class Risk:
    """reasons (kind, n, score, severity, position), total (score, reasons, level), focus, impacted (path)."""

    reasons: DataFrame
    total: DataFrame
    focus: DataFrame
    impacted: DataFrame


def assess(facts: Facts, paths: list[str], options: Options = Options(), depth: int = 2, baseline: DataFrame | None = None, conflicts: DataFrame | None = None, limit: int = 12) -> Risk:
    """What changing ``paths`` risks: cone, dependents, exports, dynamic ways in, drift, cycles, sessions, findings nearby.

    Every count is of all rows; only the focus is cut to ``limit`` files.
    """
    spark, edges = facts.files.sparkSession, facts.edges
    changed = spark.createDataFrame([(p,) for p in sorted(set(paths))], "node string")
    near = graph.cone(changed.join(facts.files.select(F.col("path").alias("node")), "node", "left_semi"), edges, depth).select(F.col("node").alias("path"))
    near = graph.kept(near)
    users = graph.kept(graph.reachable(changed, edges, reverse=True).join(changed, "node", "left_anti").select(F.col("node").alias("path")))
    exported = facts.exports.join(changed.withColumnRenamed("node", "path"), "path", "left_semi")
    loaded = facts.imports.where("is_dynamic").select(F.col("dst").alias("path")).distinct().join(near, "path", "left_semi")
    pairs = conflicts.conflicts(near) if isinstance(conflicts, Sessions) and options.layers.session_conflicts else None
    found = all_findings(facts, options, baseline, None if isinstance(conflicts, Sessions) else conflicts, near)
    if pairs is not None and not pairs.numberable():
        found, pairs = found.unionByName(as_session_findings(pairs.rows(common=True))), None
    found = graph.kept(findings.distinct(found) if pairs is None else findings.distinct_with(found, pairs))
    kinds = {"api_drift": ("api_drift",), "cycles": ("cycle",), "session_conflicts": ("session_conflict",), "nearby_findings": ("semantic_clone", "type_shape_duplicate", "dead_code")}

    sized = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(None).cast("int").alias("highest"))
    cone = near.agg(F.count("*").alias("n")).select(F.lit("dependency_cone").alias("kind"), F.when(F.col("n") > len(set(paths)), F.col("n")).otherwise(0).alias("n"), F.lit(None).cast("int").alias("highest"))
    counts = [cone, sized(users, "reverse_dependents"), sized(exported, "public_exports"), sized(loaded, "dynamic_imports")]
    one = found.select("kind", "severity", F.lit(1).cast("long").alias("pairs"))
    if pairs is not None:
        one = one.union(pairs.tallies().select(F.lit("session_conflict"), "severity", "pairs"))
    for kind, own in kinds.items():
        part = findings.of_kinds(one, *own)
        counts.append(part.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"), F.max(findings.rank(F.col("severity"))).alias("highest")).select(F.lit(kind).alias("kind"), "n", "highest"))
    why = graph.kept(findings.in_order(findings.reasons(reduce(DataFrame.union, counts))))

    some = lambda df, kind: df.select("path").distinct().orderBy("path").limit(12).select(F.lit(kind).alias("kind"), "path")
    files = [some(near, "dependency_cone"), some(users, "reverse_dependents"), exported.select(F.lit("public_exports").alias("kind"), "path").distinct(), loaded.select(F.lit("dynamic_imports").alias("kind"), "path")]
    named = found if pairs is None else found.select("kind", "files").union(pairs.rows(common=True).select(F.lit("session_conflict"), "common"))
    files += [findings.files_of(findings.of_kinds(named, *own), near).select(F.lit(kind).alias("kind"), "path") for kind, own in kinds.items()]
    reason = F.lit(None).cast("string")
    for kind, own in kinds.items():
        reason = F.when(F.col("kind").isin(*own), kind).otherwise(reason)
    shown = found.select("id", "kind", "severity", "confidence")
    if pairs is not None:
        shown = shown.union(as_session_findings(pairs.rows()).select("id", "kind", "severity", "confidence").orderBy(*findings.order()).limit(findings.FIRST_IDS))
    ids = findings.first_ids(shown, reason)
    points = reduce(DataFrame.union, files).join(why, "kind").join(ids, "kind", "left").select(F.col("path").alias("target"), "kind", "severity", "score", "n", "position", "finding_ids")
    return Risk(why, findings.risk(why), findings.focus(points, limit), near)


def change_risk(facts: Facts, paths: list[str], entrypoints: list[str], depth: int = 2, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reasons, total) of ``assess``."""
    risk = assess(facts, paths, Options(tuple(entrypoints)), depth, baseline)
    return risk.reasons, risk.total


def before_edit(facts: Facts, paths: list[str], options: Options = Options(), strict: bool = True, **more) -> DataFrame:
    """One row: score, reasons, level and whether it is safe to edit ``paths``."""
    return findings.safe_to_edit(assess(facts, paths, options, **more).total, strict)


def api_surface(facts: Facts, limit: int = 50, path: str | None = None) -> DataFrame:
    """The first ``limit`` exports by file and name, with how many there are."""
    rows = facts.exports if path is None else facts.exports.where(F.col("path") == path)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("path", "export_name").limit(max(1, limit)).crossJoin(F.broadcast(total))  # one row


def change_delta(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, change) of findings against an earlier list of them: added, removed or unchanged."""
    return changes.snapshot_diff(baseline, found, "id")


def drift_map(facts: Facts, found: DataFrame, conflicts: sessions.Conflicts | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, label, kind, severity), edges (from_id, to_id, kind, is_dynamic)) of detailed findings and the imports among their files.

    A node has the worst severity of the findings that name it, and none if they only mention it.  ``conflicts`` are what ``found`` lacks
    of session conflicts: only what they name leaves their pairs.
    """
    named = F.lit(None).cast("string")
    node = lambda kind, label, severity: F.struct(F.concat(F.lit(f"{kind}:"), label).alias("id"), label.alias("label"), F.lit(kind).alias("kind"), severity.cast("string").alias("severity"))
    of = lambda c, kind, severity: F.transform(c, lambda x: node(kind, x, severity))
    s, package = F.col("severity"), F.startswith("id", F.lit("cycle:package:"))
    export = F.struct(F.concat_ws(":", F.lit("export"), "target", F.get("symbols", F.lit(0))).alias("id"), F.get("symbols", F.lit(0)).alias("label"), F.lit("export").alias("kind"), s.alias("severity"))
    kind = F.col("kind")
    nodes = (
        F.when(kind == "semantic_clone", F.concat(of("files", "file", s), of("symbols", "type", s)))
        .when(kind == "type_shape_duplicate", of("symbols", "type", s))
        .when(kind == "api_drift", F.concat(F.array(node("file", F.col("target"), s), export), of(F.array_remove("files", F.col("target")), "file", named)))
        .when(kind == "dead_code", of("files", "file", s))
        .when((kind == "cycle") & package, of("files", "package", s))
        .when(kind == "cycle", of("files", "file", s))
        .otherwise(F.concat(of("symbols", "session", s), of("files", "file", named)))
    )
    rows = found.select(F.explode(nodes).alias("n")).select("n.*")
    if conflicts is not None:
        ends = conflicts.rows().select(F.explode(F.array("a", "b")).alias("label"), findings.rank(s).alias("r")).groupBy("label").agg(F.max("r").alias("r"))
        files = conflicts.rows(common=True).select(F.explode("common").alias("label")).distinct()
        rows = rows.union(ends.select(node("session", F.col("label"), findings.named(F.col("r"))).alias("n")).select("n.*")).union(files.select(node("file", F.col("label"), named).alias("n")).select("n.*"))
    rows = rows.groupBy("id", "label", "kind").agg(F.max(F.when(F.col("severity").isNotNull(), findings.rank(F.col("severity")))).alias("r"))
    rows = graph.kept(rows.select("id", "label", "kind", F.when(F.col("r").isNotNull(), findings.named(F.col("r"))).alias("severity")))

    first = lambda prefix, c: F.struct(F.concat(F.lit(prefix), F.get(c, F.lit(0))).alias("from_id"), F.concat(F.lit(prefix), F.get(c, F.lit(1))).alias("to_id"))
    edge = lambda df, kind: df.select("e.from_id", "e.to_id", F.lit(kind).alias("kind"), F.lit(False).alias("is_dynamic"))
    twins = [found.where((kind == k) & (F.size(c) >= 2)).select(first(prefix, c).alias("e")) for k, prefix, c in (("semantic_clone", "file:", "files"), ("type_shape_duplicate", "type:", "symbols"))]
    drifted = found.where(kind == "api_drift").withColumn("x", F.concat_ws(":", F.lit("export"), "target", F.get("symbols", F.lit(0))))
    exports = drifted.select(F.struct(F.concat(F.lit("file:"), "target").alias("from_id"), F.col("x").alias("to_id")).alias("e"))
    used = drifted.select(F.explode(F.transform(F.array_remove("files", F.col("target")), lambda f: F.struct(F.concat(F.lit("file:"), f).alias("from_id"), F.col("x").alias("to_id")))).alias("e"))
    loops = found.where(kind == "cycle").withColumn("ids", F.transform("files", lambda f: F.concat(F.when(package, "package:").otherwise("file:"), f)))
    loops = graph.cycle_edges(loops, "ids").select(F.struct(F.col("src").alias("from_id"), F.col("dst").alias("to_id")).alias("e"))
    inner = facts.imports.where("dst IS NOT NULL").select(F.concat(F.lit("file:"), "src").alias("from_id"), F.concat(F.lit("file:"), "dst").alias("to_id"), F.lit("imports").alias("kind"), "is_dynamic")
    for side in ("from_id", "to_id"):
        inner = inner.join(rows.select(F.col("id").alias(side)), side, "left_semi")
    parts = [edge(twins[0], "duplicates"), edge(twins[1], "duplicates"), edge(exports, "exports"), edge(used, "depends_on"), edge(loops, "imports"), inner.select("from_id", "to_id", "kind", "is_dynamic")]
    return rows, reduce(DataFrame.union, parts).distinct()


def health(facts: Facts, jobs: DataFrame | None = None, capacity: int = 256) -> DataFrame:
    """(name, status): four checks; fail where the queue is full, warn where it is half full, work was lost or failed, or nothing is indexed.

    ``jobs`` (status, n) counts index jobs: queued, done, failed and dropped ones; what is queued and neither done nor failed waits.
    """
    indexed = facts.files.agg(F.when(F.count("*") > 0, "ok").otherwise("warn").alias("status")).select(F.lit("index_state").alias("name"), "status")
    if jobs is None:
        return indexed
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0))
    sums = jobs.agg((n("queued") - n("done", "failed")).alias("waiting"), n("dropped").alias("dropped"), n("failed").alias("failed"))
    row = lambda name, status: F.struct(F.lit(name).alias("name"), status.alias("status"))
    bad = lambda c: F.when(F.col(c) > 0, "warn").otherwise("ok")
    depth = F.when(F.col("waiting") >= capacity, "fail").when(2 * F.col("waiting") >= capacity, "warn").otherwise("ok")
    told = sums.select(F.explode(F.array(row("queue_depth", depth), row("queue_drops", bad("dropped")), row("index_failures", bad("failed")))).alias("r"))
    return told.select("r.*").union(indexed)


def healthy(checks: DataFrame) -> DataFrame:
    """One row: whether no check fails, and the names of those that warn."""
    return checks.agg(F.coalesce(F.every(F.col("status") != "fail"), F.lit(True)).alias("healthy"), F.array_sort(F.collect_list(F.when(F.col("status") == "warn", F.col("name")))).alias("warnings"))
