"""The checks of ``codebase`` over a web site: the driver's pages as files, with SQL for the same rows.

A page is a file; the words of its title are its exports, with the page's language as signature; a link imports the first page
whose title has the link's word, dynamically if the link ends in a comma; paragraphs are blocks, tags and their numbers a shape.
Sessions are the users of ``events`` who were active in the last hour, with the pages numbered by their events' k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import source_text
from strandmill.operators import clones, findings, graph
from strandmill.plans import codebase
from strandmill.plans.bindings import _MS, _RANK, table, timed

QUERIES: dict = {}
SQL: dict[str, str] = {}

OPTIONS = codebase.Options(("page/1?.html", "page/2?.html"), (("page/1*", "one"), ("page/2*", "two"), ("page/*", "rest")), layers=codebase.Layers(near_clones=False))
CHANGED = ["page/3.html", "page/7.html", "page/12.html"]
ACTIVE_MS = 3_600_000


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def facts(spark: SparkSession, d: str) -> codebase.Facts:
    """The five fact tables, each written once."""
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)), F.lit("[a-z]{3,}"), F.lit(0)))
    named = graph.kept(pages.select("path", "page_id", F.explode(words).alias("export_name"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("signature")))
    home = named.groupBy(F.col("export_name").alias("word")).agg(F.min_by("path", "page_id").alias("dst"))
    links = pages.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("specifier"))
    links = links.withColumn("word", F.regexp_extract(F.lower("specifier"), "[a-z]{3,}", 0)).join(home, "word", "left")
    imports = links.select("src", "dst", "specifier", F.endswith("specifier", F.lit(",")).alias("is_dynamic"))
    blocks = pages.select("path", F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1))).alias("i", "text"))
    blocks = blocks.select(F.concat(F.col("path"), F.lit("::p"), (F.col("i") + 1).cast("string")).alias("id"), "text", "path")
    tags = pages.select("path", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))).alias("tag")).groupBy("path", "tag").agg(F.count("*").alias("n"))
    shapes = tags.groupBy("path").agg(F.array_sort(F.collect_set(F.concat_ws(":", "tag", F.col("n").cast("string")))).alias("members")).where(F.size("members") >= 3)
    shapes = shapes.select(F.concat(F.col("path"), F.lit("::page")).alias("id"), "path", "members", source_text.token_hash(F.col("members")).alias("shape_hash"), F.lit(False).alias("suppressed"))
    return codebase.Facts(graph.kept(pages.select("path", F.col("html").alias("source"))), graph.kept(imports), named.drop("page_id"), graph.kept(clones.fingerprints(blocks, "id", "text", "path")), graph.kept(shapes))


def baseline(spark: SparkSession, d: str, found: codebase.Facts) -> DataFrame:
    """Exports of every fourth page as they were: some in another language, some under another name."""
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    old = found.exports.where(number % 4 == 0)
    name = F.when(number % 20 == 4, F.concat("export_name", F.lit("_old"))).otherwise(F.col("export_name"))
    return old.select("path", name.alias("export_name"), F.when(number % 8 == 0, "xx").otherwise(F.col("signature")).alias("signature"))


def active(spark: SparkSession, d: str) -> codebase.Sessions:
    e = timed(spark, d).where("user_id IS NOT NULL AND k IS NOT NULL")
    now = e.agg(F.max("at").alias("now"))
    last = e.groupBy("user_id").agg(F.max("at").alias("last")).crossJoin(F.broadcast(now)).select("user_id", (F.col("last") - F.col("now")).alias("at"))  # one row
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    seen = e.join(last.withColumnRenamed("at", "age"), "user_id").groupBy(name.alias("session"), F.col("age").alias("at"), F.concat(F.lit("page/"), F.col("k").cast("string"), F.lit(".html")).alias("file")).agg(F.max(F.col("event_type") == "purchase").alias("direct"))
    return codebase.Sessions(seen, 0, OPTIONS.overlap, ACTIVE_MS)


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return codebase.as_session_findings(active(spark, d).conflicts().rows(common=True))


_BASE = f"""pg AS (SELECT page_id, 'page/' || page_id || '.html' AS path, coalesce(html, '') AS html FROM pages),
 ex AS (SELECT path, page_id, unnest(list_distinct(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)', 1)), '[a-z]{{3,}}'))) AS export_name, regexp_extract(html, 'lang="([a-z]+)"', 1) AS signature FROM pg),
 home AS (SELECT export_name AS word, arg_min(path, page_id) AS dst FROM ex GROUP BY export_name),
 im0 AS (SELECT path AS src, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS specifier FROM pg),
 im AS (SELECT src, dst, specifier, specifier LIKE '%,' AS is_dynamic FROM im0 LEFT JOIN home ON word = regexp_extract(lower(specifier), '[a-z]{{3,}}')),
 e AS (SELECT DISTINCT src, dst FROM im WHERE dst IS NOT NULL),
 near AS (SELECT node AS path FROM (SELECT node, min(depth) FROM cone GROUP BY node)),
 u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 cone AS (SELECT path AS node, 0 AS depth FROM pg WHERE path IN ({", ".join(map(repr, CHANGED))}) UNION SELECT u.dst, depth + 1 FROM cone JOIN u ON u.src = cone.node WHERE depth < 2)"""
# A recursive table has to stand before what reads it.
_parts = _BASE.split(",\n ")
_BASE = ",\n ".join([*_parts[:6], *_parts[7:], _parts[6]])


def _findings_sql(near: bool) -> str:
    within = lambda c: f"WHERE {c} IN (SELECT path FROM near)" if near else ""
    touches = "WHERE list_has_any(files, (SELECT list(path) FROM near))" if near else ""
    drift_touches = "WHERE target IN (SELECT path FROM led)" if near else ""
    package = "CASE WHEN regexp_matches(path, '^page/1') THEN 'one' WHEN regexp_matches(path, '^page/2') THEN 'two' ELSE 'rest' END"
    closure = lambda c, e: f"{c} AS (SELECT src AS a, dst AS b FROM {e} WHERE src <> dst UNION SELECT {c}.a, {e}.dst FROM {c} JOIN {e} ON {e}.src = {c}.b)"
    loops = lambda c: f"SELECT list_sort(list(node)) AS nodes FROM (SELECT x.a AS node, least(min(x.b), x.a) AS comp FROM {c} x JOIN {c} y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a) GROUP BY comp"
    return f"""{_BASE},
 pr0 AS (SELECT path, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT path, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pg {within("path")})),
 pr AS (SELECT path, path || '::p' || i AS id, regexp_extract_all(lower(ps[i]), '[a-z]+') AS tokens FROM pr0),
 tg AS (SELECT path, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pg {within("path")}),
 sp AS (SELECT path || '::page' AS id, path, sha256(array_to_string(list_sort(list(m)), chr(1))) AS hash FROM (SELECT path, tag || ':' || count(*) AS m FROM tg GROUP BY path, tag) GROUP BY path HAVING count(*) >= 3),
 {closure("ca", "e")}, pe AS (SELECT DISTINCT x.p AS src, y.p AS dst FROM e JOIN (SELECT path, {package} AS p FROM pg) x ON x.path = src JOIN (SELECT path, {package} AS p FROM pg) y ON y.path = dst WHERE x.p <> y.p), {closure("cp", "pe")},
 live AS (SELECT path FROM pg WHERE regexp_matches(path, '^page/[12].[.]html$') UNION SELECT dst FROM live JOIN e ON src = path),
 led AS (SELECT path FROM near UNION SELECT dst FROM led JOIN e ON src = path),
 bl AS (SELECT path, CASE WHEN page_id % 20 = 4 THEN export_name || '_old' ELSE export_name END AS export_name, CASE WHEN page_id % 8 = 0 THEN 'xx' ELSE signature END AS before FROM ex WHERE page_id % 4 = 0),
 dr AS (SELECT bl.*, ex.signature AS after FROM bl LEFT JOIN ex ON ex.path = bl.path AND ex.export_name = bl.export_name WHERE ex.signature IS NULL OR ex.signature <> before),
 bc AS (SELECT dst AS node, src AS caller, 1 AS steps FROM e UNION SELECT node, e.src, steps + 1 FROM bc JOIN e ON e.dst = caller WHERE steps < 12),
 cl AS (SELECT node, list(caller) AS callers FROM (SELECT node, caller FROM (SELECT node, caller, min(steps) AS steps FROM bc GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY node ORDER BY steps, caller) <= 12) GROUP BY node),
 ev AS (SELECT 'u' || user_id AS session, 'page/' || (props->>'k')::INT || '.html' AS file, event_type = 'purchase' AS direct, max({_MS}) OVER (PARTITION BY user_id) AS last, max({_MS}) OVER () AS now FROM events WHERE user_id IS NOT NULL AND props->>'k' IS NOT NULL),
 sx AS (SELECT session, file, bool_or(direct) AS direct FROM ev WHERE now - last <= {ACTIVE_MS} GROUP BY ALL), sn AS (SELECT session, count(*) AS n FROM sx GROUP BY session),
 sc AS (SELECT p.session AS a, r.session AS b, count(*) / least(max(na.n), max(nb.n)) AS c, bool_or(p.direct AND r.direct) AS direct, list_sort(list(p.file)) AS files FROM sx p JOIN sx r ON p.file = r.file AND p.session < r.session JOIN sn na ON na.session = p.session JOIN sn nb ON nb.session = r.session GROUP BY 1, 2),
 cf AS (SELECT 'session_conflict:' || a || ':' || b AS id, 'session_conflict' AS kind, CASE WHEN direct THEN 'error' ELSE 'warn' END AS severity, round(least(c, 0.99), 6)::DOUBLE AS confidence, a AS target, files, [a, b] AS symbols FROM sc WHERE c >= 0.25),
 fu AS (
  SELECT 'semantic_clone:' || hash AS id, 'semantic_clone' AS kind, CASE WHEN count(DISTINCT path) > 2 THEN 'error' ELSE 'warn' END AS severity, 0.99::DOUBLE AS confidence, min(id) AS target, list_sort(list(DISTINCT path)) AS files, list_sort(list(DISTINCT id)) AS symbols FROM (SELECT *, sha256(array_to_string(tokens, ' ')) AS hash FROM pr WHERE len(tokens) >= 24) {touches.replace("files", "[path]")} GROUP BY hash HAVING count(DISTINCT id) >= 2
  UNION ALL SELECT 'type_shape_duplicate:' || hash || ':' || array_to_string(ids, '|'), 'type_shape_duplicate', 'warn', 0.93, ids[1], files, ids FROM (SELECT hash, list_sort(list(id)) AS ids, list_sort(list(DISTINCT path)) AS files FROM sp GROUP BY hash HAVING count(*) >= 2)
  UNION ALL SELECT 'cycle:file:' || array_to_string(files, '|'), 'cycle', CASE WHEN len(files) > 3 THEN 'error' ELSE 'warn' END, 0.95, array_to_string(files, '|'), files, files FROM (SELECT nodes AS files FROM ({loops("ca")})) {touches}
  UNION ALL SELECT 'cycle:package:' || array_to_string(files, '|'), 'cycle', 'error', 0.98, array_to_string(files, '|'), files, files FROM (SELECT nodes AS files FROM ({loops("cp")})) {touches}
  UNION ALL SELECT 'dead_code:' || path || ':' || export_name, 'dead_code', CASE WHEN dyn THEN 'info' ELSE 'warn' END, CASE WHEN dyn THEN 0.55 ELSE 0.86 END, path, files, [export_name] FROM (SELECT path, export_name, [path] AS files, path IN (SELECT dst FROM im WHERE is_dynamic AND dst IS NOT NULL) AS dyn FROM ex WHERE path NOT IN (SELECT path FROM live)) {touches}
  UNION ALL SELECT * FROM (SELECT 'api_drift:' || path || ':' || export_name || ':' || before || ':' || coalesce(after, '<removed>'), 'api_drift', 'error', CASE WHEN after IS NULL THEN 0.98 ELSE 0.97 END, path AS target, list_sort(list_distinct([path] || coalesce(callers, []))), [export_name] FROM dr LEFT JOIN cl ON cl.node = dr.path) {drift_touches}
  UNION ALL SELECT * FROM cf {touches}),
 og AS (SELECT severity, confidence, id, min(struct_pack(kind := kind, target := target, files := files, symbols := symbols)) AS rest FROM fu GROUP BY ALL),
 oa AS (SELECT *, lag(id) OVER (ORDER BY {_RANK} DESC, confidence DESC, id, severity) AS before FROM og),
 o AS (SELECT id, rest.kind AS kind, severity, confidence, rest.target AS target, rest.files AS files, rest.symbols AS symbols, row_number() OVER (ORDER BY {_RANK} DESC, confidence DESC, id, severity) AS position FROM oa WHERE before IS DISTINCT FROM id)"""


_WHOLE, _NEAR = f"WITH RECURSIVE {_findings_sql(False)}", f"WITH RECURSIVE {_findings_sql(True)}"


def whole(spark, d) -> tuple[codebase.Facts, DataFrame]:
    """The facts, and all findings but the conflicts of sessions."""
    found = facts(spark, d)
    return found, codebase.all_findings(found, OPTIONS, baseline(spark, d, found))


@query(f"{_WHOLE} SELECT id, kind, severity, confidence, target, array_to_string(files, '|') AS files, position FROM o")
def site_check(spark, d):
    """Findings of all layers but one that is off, in canonical order."""
    found = findings.ranked_with(whole(spark, d)[1], active(spark, d).conflicts(), codebase.as_session_findings, common=True)
    return found.select("id", "kind", "severity", "confidence", "target", F.array_join("files", "|").alias("files"), "position")


@query(f"{_WHOLE} SELECT id, kind, array_to_string(CASE WHEN kind = 'session_conflict' THEN files[1:12] ELSE files END, '|') AS files, position, (SELECT count(*) > 50 FROM o) AS truncated FROM o WHERE position <= 50")
def site_report(spark, d):
    """The first 50 as they are shown."""
    found, options = facts(spark, d), OPTIONS
    return codebase.check(found, [], baseline(spark, d, found), options=options, conflicts=conflicts(spark, d)).select("id", "kind", F.array_join("files", "|").alias("files"), "position", "truncated")


@query(f"{_NEAR} SELECT id, severity, confidence, target FROM fu")
def site_check_near(spark, d):
    """Findings that touch the pages around three changed ones; a drift is touched by whatever leads to it."""
    found = facts(spark, d)
    seeds = found.files.where(F.col("path").isin(CHANGED)).select(F.col("path").alias("node"))
    near = graph.cone(seeds, found.edges, 2).select(F.col("node").alias("path"))
    near = graph.kept(near)
    code = codebase.all_findings(found, OPTIONS, baseline(spark, d, found), paths=near)
    both = codebase.as_session_findings(active(spark, d).conflicts(near).rows())
    return code.select("id", "severity", "confidence", "target").union(both.select("id", "severity", "confidence", "target"))


@query(f"{_WHOLE} SELECT id, severity, confidence, target, array_to_string(files, '|') AS files, array_to_string(symbols, '|') AS sessions FROM cf")
def site_conflicts(spark, d):
    return conflicts(spark, d).select("id", "severity", "confidence", "target", F.array_join("files", "|").alias("files"), F.array_join("symbols", "|").alias("sessions"))


@query(f"WITH RECURSIVE {_BASE}, n AS (SELECT node, min(depth)::INT AS depth FROM cone GROUP BY node) SELECT node, depth, greatest(0, (SELECT count(*) FROM n) - 50)::BIGINT AS omitted FROM n ORDER BY node LIMIT 50")
def site_impact(spark, d):
    return codebase.impact_cone(facts(spark, d), CHANGED)


_RISK = f"""{_NEAR}, us AS (SELECT src AS path FROM e WHERE dst IN ({", ".join(map(repr, CHANGED))}) UNION SELECT e.src FROM us JOIN e ON e.dst = us.path),
 rc AS (SELECT 'dependency_cone' AS kind, CASE WHEN (SELECT count(*) FROM near) > {len(CHANGED)} THEN (SELECT count(*) FROM near) ELSE 0 END AS n, NULL::INT AS highest
  UNION ALL SELECT 'reverse_dependents', (SELECT count(*) FROM us WHERE path NOT IN ({", ".join(map(repr, CHANGED))})), NULL UNION ALL SELECT 'public_exports', (SELECT count(*) FROM ex WHERE path IN ({", ".join(map(repr, CHANGED))})), NULL
  UNION ALL SELECT 'dynamic_imports', (SELECT count(DISTINCT dst) FROM im WHERE is_dynamic AND dst IN (SELECT path FROM near)), NULL
  UNION ALL SELECT 'api_drift', count(*), max({_RANK}) FROM o WHERE kind = 'api_drift' UNION ALL SELECT 'cycles', count(*), max({_RANK}) FROM o WHERE kind = 'cycle'
  UNION ALL SELECT 'session_conflicts', count(*), max({_RANK}) FROM o WHERE kind = 'session_conflict' UNION ALL SELECT 'nearby_findings', count(*), max({_RANK}) FROM o WHERE kind IN ('semantic_clone', 'type_shape_duplicate', 'dead_code'))"""
_CASE = lambda k: "CASE kind " + " ".join(f"WHEN '{name}' THEN {v[k]}" for name, v in findings.REASONS.items()) + " END"
_RISK += f""", rs AS (SELECT kind, n::BIGINT AS n, least(n * {_CASE(0)}, {_CASE(1)})::BIGINT AS score,
 CASE WHEN highest = 2 THEN 'error' WHEN highest = 1 THEN 'warn' WHEN highest = 0 THEN 'info' WHEN kind = 'dependency_cone' THEN CASE WHEN n >= 8 THEN 'warn' ELSE 'info' END WHEN kind = 'reverse_dependents' THEN CASE WHEN n >= 4 THEN 'warn' ELSE 'info' END ELSE 'warn' END AS severity FROM rc WHERE n > 0)"""


def risk(spark, d) -> codebase.Risk:
    found = facts(spark, d)
    return codebase.assess(found, CHANGED, OPTIONS, baseline=baseline(spark, d, found), conflicts=active(spark, d))


@query(f"{_RISK} SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, score DESC, kind) AS position FROM rs")
def site_change_risk(spark, d):
    return risk(spark, d).reasons


@query(f"{_RISK}, tot AS (SELECT least(coalesce(sum(score), 0), 100)::BIGINT AS score, count(*)::BIGINT AS reasons FROM rs) SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level, score < 25 AS safe_to_edit FROM tot")
def site_before_edit(spark, d):
    found = facts(spark, d)
    return codebase.before_edit(found, CHANGED, OPTIONS, baseline=baseline(spark, d, found), conflicts=active(spark, d))


@query(f"WITH RECURSIVE {_BASE} SELECT path, export_name, signature, (SELECT count(*)::BIGINT FROM ex) AS total FROM ex ORDER BY path, export_name LIMIT 50")
def site_exports(spark, d):
    return codebase.api_surface(facts(spark, d))


@query(f"{_WHOLE}, pk AS (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) AS position FROM o WHERE id LIKE 'cycle:package:%') SELECT id, position, (SELECT count(*) > 50 FROM pk) AS truncated FROM pk WHERE position <= 50")
def site_layers(spark, d):
    return codebase.layer_boundaries(facts(spark, d), OPTIONS.packages)[1].select("id", "position", "truncated")


_NODE = lambda kind, label, severity: f"struct_pack(id := '{kind}:' || {label}, label := {label}, kind := '{kind}', severity := {severity})"
_OF = lambda c, kind, severity: f"list_transform({c}, lambda x: {_NODE(kind, 'x', severity)})"
_NODES = f"""{_WHOLE}, nd AS (SELECT unnest(CASE
  WHEN kind = 'semantic_clone' THEN {_OF("files", "file", "severity")} || {_OF("symbols", "type", "severity")} WHEN kind = 'type_shape_duplicate' THEN {_OF("symbols", "type", "severity")}
  WHEN kind = 'api_drift' THEN [{_NODE("file", "target", "severity")}, struct_pack(id := 'export:' || target || ':' || symbols[1], label := symbols[1], kind := 'export', severity := severity)] || {_OF("list_filter(files, lambda f: f <> target)", "file", "NULL::VARCHAR")}
  WHEN kind = 'dead_code' THEN {_OF("files", "file", "severity")} WHEN id LIKE 'cycle:package:%' THEN {_OF("files", "package", "severity")} WHEN kind = 'cycle' THEN {_OF("files", "file", "severity")}
  ELSE {_OF("symbols", "session", "severity")} || {_OF("files", "file", "NULL::VARCHAR")} END) AS n FROM o),
 nodes AS (SELECT n.id AS id, n.label AS label, n.kind AS kind, CASE max(CASE n.severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 WHEN 'info' THEN 0 END) WHEN 2 THEN 'error' WHEN 1 THEN 'warn' WHEN 0 THEN 'info' END AS severity FROM nd GROUP BY ALL)"""


def _map(spark, d):
    found, code = whole(spark, d)
    pairs = active(spark, d).conflicts()
    if not pairs.numberable():
        return codebase.drift_map(found, graph.kept(findings.distinct(code.unionByName(codebase.as_session_findings(pairs.rows(common=True))))))
    return codebase.drift_map(found, graph.kept(findings.distinct_with(code, pairs)), pairs)


@query(f"{_NODES} SELECT * FROM nodes")
def site_drift_nodes(spark, d):
    return _map(spark, d)[0]


@query(f"""{_NODES}, loop_ AS (SELECT list_transform(files, lambda f: CASE WHEN id LIKE 'cycle:package:%' THEN 'package:' ELSE 'file:' END || f) AS ids FROM o WHERE kind = 'cycle'),
 dx AS (SELECT target, 'export:' || target || ':' || symbols[1] AS x, files FROM o WHERE kind = 'api_drift')
 SELECT DISTINCT 'file:' || files[1] AS from_id, 'file:' || files[2] AS to_id, 'duplicates' AS kind, false AS is_dynamic FROM o WHERE kind = 'semantic_clone' AND len(files) >= 2
 UNION SELECT 'type:' || symbols[1], 'type:' || symbols[2], 'duplicates', false FROM o WHERE kind = 'type_shape_duplicate' AND len(symbols) >= 2
 UNION SELECT 'file:' || target, x, 'exports', false FROM dx UNION SELECT 'file:' || unnest(list_filter(files, lambda f: f <> target)), x, 'depends_on', false FROM dx
 UNION SELECT unnest(ids[:-2]), unnest(ids[2:]), 'imports', false FROM loop_
 UNION SELECT 'file:' || src, 'file:' || dst, 'imports', is_dynamic FROM im WHERE dst IS NOT NULL AND 'file:' || src IN (SELECT id FROM nodes) AND 'file:' || dst IN (SELECT id FROM nodes)""")
def site_drift_edges(spark, d):
    return _map(spark, d)[1]


@query("""WITH j AS (SELECT count(*) FILTER (event_type = 'signup') - count(*) FILTER (event_type IN ('purchase', 'error')) AS waiting, count(*) FILTER (event_type = 'error') AS failed FROM events)
 SELECT 'index_state' AS name, CASE WHEN (SELECT count(*) FROM pages) > 0 THEN 'ok' ELSE 'warn' END AS status UNION ALL SELECT 'queue_depth', CASE WHEN waiting >= 256 THEN 'fail' WHEN 2 * waiting >= 256 THEN 'warn' ELSE 'ok' END FROM j
 UNION ALL SELECT 'queue_drops', 'ok' UNION ALL SELECT 'index_failures', CASE WHEN failed > 0 THEN 'warn' ELSE 'ok' END FROM j""")
def site_health(spark, d):
    """Events as index jobs: signups are queued, purchases done, errors failed."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("other")
    jobs = table(spark, d, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return codebase.health(facts(spark, d), jobs)


_CH = ", ".join(map(repr, CHANGED))
_KINDS = {"api_drift": "'api_drift'", "cycles": "'cycle'", "session_conflicts": "'session_conflict'", "nearby_findings": "'semantic_clone', 'type_shape_duplicate', 'dead_code'"}
_FILES_OF = " UNION ALL ".join(
    f"SELECT '{kind}', path FROM (SELECT DISTINCT unnest(files) AS path FROM o WHERE kind IN ({own}) ORDER BY path LIMIT 12) UNION ALL SELECT '{kind}', path FROM (SELECT path FROM near ORDER BY path LIMIT 12) WHERE NOT EXISTS (SELECT 1 FROM o WHERE kind IN ({own}))"
    for kind, own in _KINDS.items()
)


@query(f"""{_RISK}, ro AS (SELECT *, row_number() OVER (ORDER BY {_RANK} DESC, score DESC, kind) AS position FROM rs),
 fi AS (SELECT CASE {" ".join(f"WHEN kind IN ({own}) THEN '{kind}'" for kind, own in _KINDS.items())} END AS reason, id, position FROM o),
 ids AS (SELECT reason AS kind, list(id ORDER BY position) AS finding_ids FROM (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY reason ORDER BY position) <= 12) GROUP BY reason),
 pt(kind, target) AS (SELECT 'dependency_cone', path FROM (SELECT path FROM near ORDER BY path LIMIT 12) UNION ALL SELECT 'reverse_dependents', path FROM (SELECT DISTINCT path FROM us WHERE path NOT IN ({_CH}) ORDER BY path LIMIT 12)
  UNION ALL SELECT DISTINCT 'public_exports', path FROM ex WHERE path IN ({_CH}) UNION ALL SELECT DISTINCT 'dynamic_imports', dst FROM im WHERE is_dynamic AND dst IN (SELECT path FROM near) UNION ALL {_FILES_OF}),
 pj AS (SELECT pt.target, ro.*, coalesce(finding_ids, []) AS finding_ids FROM pt JOIN ro USING (kind) LEFT JOIN ids ON ids.kind = ro.kind)
 SELECT target, max({_RANK})::INT AS severity_rank, least(sum(score), 100)::BIGINT AS score, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, round(least(0.99, 0.5 + least(sum(score), 50) / 100), 6)::DOUBLE AS confidence,
  array_to_string(list(n || ' counted as ' || kind ORDER BY position)[1:4], ';') AS evidence, array_to_string(list_sort(list_distinct(flatten(list(finding_ids)))), '|') AS finding_ids
 FROM pj GROUP BY target ORDER BY severity_rank DESC, score DESC, target LIMIT 12""")
def site_focus(spark, d):
    """The twelve pages to look at first, with evidence of four reasons and the first findings of each."""
    said = F.array_join(F.transform("evidence", lambda e: e["detail"]), ";")
    return risk(spark, d).focus.select("target", "severity_rank", "score", "kinds", "confidence", said.alias("evidence"), F.array_join("finding_ids", "|").alias("finding_ids"))
