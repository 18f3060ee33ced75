"""Queries of the scan: resolved imports, ignored files, lexed bodies, places and silencers, over sources made of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import bodies, context, diff, moves, occurrences, search
from coppice.queries import _CLOSURE, Tables, one, query
from coppice.sources import env_sources, ignore, lexing, resolution

# Imports -------------------------------------------------------------------------------------

_SPECS = """
SELECT DISTINCT src AS path, 'static' AS kind, CASE
  WHEN src LIKE '%.ts' OR src LIKE '%.tsx' THEN CASE length(dst) % 4
    WHEN 0 THEN concat(CASE WHEN src LIKE '%/tests/%' THEN '../' ELSE './' END, regexp_replace(substr(dst, instr(dst, '/') + 1), '[.](ts|tsx)$', ''))
    WHEN 1 THEN concat('@own/', regexp_replace(substr(dst, instr(dst, '/') + 1), '[.](ts|tsx)$', ''))
    WHEN 2 THEN concat('#', regexp_replace(substr(dst, instr(dst, '/') + 1), '[.](ts|tsx)$', ''), '!x')
    ELSE regexp_replace(substr(dst, instr(dst, '/') + 1), '[.](ts|tsx)$', '') END
  WHEN src LIKE '%.py' THEN replace(regexp_replace(dst, '[.]py$', ''), '/', '.')
  WHEN src LIKE '%.rs' THEN concat('crate::', replace(regexp_replace(substr(dst, instr(dst, '/') + 1), '[.]rs$', ''), '/', '::'), '::Item')
  ELSE 'outside' END AS name, dst FROM {edges}"""
_CONFIG = '{ "extends": "../base", // per folder\n "compilerOptions": {"paths": {"@own/*": ["./*"], "#*!x": ["missing/*", "./*"],}}}'
_BASE = '{"compilerOptions": {"baseUrl": ".", "paths": {"@own/*": ["nowhere/*"]}}}'


def _sources(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Imports, files and configurations: a script configuration and a crate in every top folder."""
    specs = t.spark.sql(_SPECS, edges=t.edges)
    folders = t.files.select("dir").distinct()
    texts = folders.select(F.concat("dir", F.lit("/tsconfig.json")).alias("path"), F.lit(_CONFIG).alias("content")).union(folders.select(F.concat("dir", F.lit("/Cargo.toml")), F.lit("")))
    base = folders.agg(F.lit("base.json").alias("path"), F.lit(_BASE).alias("content"))
    return specs, t.files.select("path").union(texts.select("path")), texts.union(base)


def _resolved(t: Tables) -> DataFrame:
    imports, files, texts = _sources(t)
    return resolution.resolve(imports.select("path", "kind", "name").distinct(), files, texts).select("path", "name", "resolved_path", "via")


query("resolved_imports", f"""
s AS ({_SPECS.replace('{edges}', 'edges')})
SELECT path, name, CASE WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN dst WHEN path LIKE '%.py' AND dst LIKE '%.py' THEN dst WHEN path LIKE '%.rs' AND dst LIKE '%.rs' THEN dst END AS resolved_path,
  CASE WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN CASE length(dst) % 4 WHEN 0 THEN 'relative' WHEN 3 THEN 'base' ELSE 'alias' END
    WHEN path LIKE '%.py' AND dst LIKE '%.py' THEN 'package' WHEN path LIKE '%.rs' AND dst LIKE '%.rs' THEN 'crate' END AS via
FROM (SELECT path, name, min(dst) AS dst FROM s GROUP BY ALL)""")(_resolved)  # fmt: skip


# Ignore files --------------------------------------------------------------------------------


def _rules(t: Tables) -> DataFrame:
    """A top file, and one in every folder whose name ends in 1 or 3."""
    rules = F.when(F.col("dir").like("%1"), "# styles stay\n!*.css\n").when(F.col("dir").like("%3"), "*7.go\n")
    nested = t.files.select("dir").distinct().select(F.concat("dir", F.lit("/.gitignore")).alias("path"), rules.alias("content")).where("content IS NOT NULL")
    return nested.union(nested.agg(F.lit(".gitignore").alias("path"), F.lit("*.css\n/brand_2?/tests/\n").alias("content")))


query("ignored_files", one("""
SELECT path, CASE WHEN regexp_matches(path, '^brand_2[0-9]/tests/') THEN dir || '/tests' ELSE path END AS cause FROM files
WHERE regexp_matches(path, '^brand_2[0-9]/tests/') OR (path LIKE '%.css' AND dir NOT LIKE '%1') OR (path LIKE '%7.go' AND dir LIKE '%3')"""))(
    lambda t: ignore.ignored(t.files, ignore.rules(_rules(t))))


# Lexed sources -------------------------------------------------------------------------------

#: A source per part: a comment of size % 7 + 1 lines, a function with a block of size % 5 lines, a template over two lines, a constant; « and » stand for braces.
_CODE = """
SELECT concat(regexp_replace(path, '[.][a-z]+$', ''), '.ts') AS path, loc % 7 AS a, loc % 5 AS b, replace(replace(concat(
  '/* open «', chr(10), repeat(concat(' * track "', chr(10)), CAST(loc % 7 AS INT)), ' */', chr(10),
  'export function f', CAST(id AS STRING), '(x: string) «', chr(10), repeat(concat('  if (x === "»") « track("«"); » // » noqa', chr(10)), CAST(loc % 5 AS INT)),
  '  return `a $«x» «', chr(10), 'track »`;', chr(10), '»', chr(10), 'const c = 1', chr(10), 'type T = « k: number »;', chr(10), '// @ts-ignore', chr(10), 'const s = "@ts-ignore track";'
  ), '«', chr(123)), '»', chr(125)) AS content
FROM {files}"""


def _texts(t: Tables) -> DataFrame:
    return t.spark.sql(_CODE, files=t.dealt_files()).select("path", "content")


_CODED = f"s AS ({_CODE.replace('{files}', 'files').replace('CAST(id AS STRING)', 'CAST(id AS VARCHAR)')}), k AS (SELECT path, a, b, regexp_extract(content, 'function (f[0-9]+)', 1) AS f FROM s)"


def _found_bodies(t: Tables) -> DataFrame:
    lines = lexing.lexed(_texts(t))
    return bodies.bodies(bodies.definitions(lines), lines)


query("symbol_bodies", _CODED + """
SELECT path, f AS name, a + 3 AS line, a + b + 6 AS last_line FROM k UNION ALL SELECT path, 'c', a + b + 7, a + b + 7 FROM k UNION ALL
SELECT path, 'T', a + b + 8, a + b + 8 FROM k UNION ALL SELECT path, 's', a + b + 10, a + b + 10 FROM k""")(_found_bodies)
query("lexed_places", _CODED + """
SELECT path, n + 1 AS line, 'comment' AS kind FROM k, unnest(range(1, a + 1)) AS u(n) UNION ALL SELECT path, a + 3 + n, 'identifier' FROM k, unnest(range(1, b + 1)) AS u(n) UNION ALL
SELECT path, a + b + 5, 'string_literal' FROM k UNION ALL SELECT path, a + b + 10, 'string_literal' FROM k""")(
    lambda t: occurrences.classified(occurrences.occurrences(_texts(t), ["track"]), lexing.lexed(_texts(t))).select("path", "line", "kind"))
query("silencer_places", _CODED + """
SELECT path, a + b + 9 AS line, 'ts-ignore' AS kind FROM k""")(lambda t: search.silencer_places(lexing.lexed(_texts(t))).where("kind <> 'noqa'"))


# Context -------------------------------------------------------------------------------------

_SCOPE = """
d0 AS (SELECT path AS source, path AS node, 0 AS depth FROM files UNION SELECT w.source, e.dst, w.depth + 1 FROM d0 w JOIN edges e ON e.src = w.node WHERE w.depth < 2),
rx AS (SELECT DISTINCT src FROM edges WHERE label = 'reexport'),
c0 AS (SELECT path AS source, path AS node FROM files UNION SELECT w.source, e.src FROM c0 w JOIN edges e ON e.dst = w.node WHERE w.node = w.source OR w.node IN (SELECT src FROM rx)),
cs AS (SELECT source AS target, node AS path FROM c0 WHERE node <> source),
sc AS (SELECT path AS target, path, 'target' AS role, 0 AS depth FROM files UNION ALL
  SELECT source, node, 'dependency', min(depth) FROM d0 WHERE node <> source GROUP BY source, node UNION ALL SELECT target, path, 'consumer', NULL FROM cs)"""
query("context_files", _SCOPE + " SELECT target, sc.path, role, depth::BIGINT AS depth, language, loc FROM sc JOIN files ON files.path = sc.path")(
    lambda t: context.context_files(t.kept_edges(), t.files, t.files.select("path")))
query("consumer_links", _SCOPE + """,
l AS (SELECT src, dst, bool_and(label = 'reexport') AS again FROM edges GROUP BY src, dst),
u AS (SELECT DISTINCT cs.target, cs.path, i.name FROM cs JOIN imports i ON i.path = cs.path WHERE i.resolved_path = cs.target OR EXISTS (SELECT 1 FROM exports x WHERE x.path = cs.target AND x.name = i.name)),
n AS (SELECT target, path, string_agg(name, ',' ORDER BY name) AS names FROM u GROUP BY target, path)
SELECT cs.target, cs.path, CASE WHEN again THEN 'reexport' WHEN again IS NOT NULL THEN 'direct' ELSE 'transitive' END AS kind, coalesce(names, '') AS imports_used
FROM cs LEFT JOIN l ON l.src = cs.path AND l.dst = cs.target LEFT JOIN n ON n.target = cs.target AND n.path = cs.path""")(
    lambda t: context.consumer_links(t.kept_edges(), t.files.select("path"), t.imports, t.exports).withColumn("imports_used", F.array_join("imports_used", ",")))
query("context_risks", _SCOPE + """,
i AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM edges GROUP BY dst),
r AS (SELECT target, s.path, importers, row_number() OVER (PARTITION BY target ORDER BY importers DESC, s.path) AS place FROM (SELECT DISTINCT target, path FROM sc) s JOIN i ON i.path = s.path)
SELECT target, path, importers, CASE WHEN place <= 5 THEN place END AS place, importers >= 10 AS high_fan_in FROM r""")(lambda t: _risks(t))
query("next_steps", """
u AS (SELECT DISTINCT dst AS path FROM edges WHERE src <> dst), x AS (SELECT path, min_by(name, (coalesce(line, 0), name)) AS symbol FROM exports GROUP BY path),
s AS (SELECT path AS target, 1 AS o, 'slice' AS step, path AS subject FROM files UNION ALL SELECT path, 2, 'impact', path FROM u UNION ALL SELECT path, 3, 'body', symbol FROM x UNION ALL
  SELECT path, 4, 'literal', symbol FROM x UNION ALL SELECT path, 5, 'occurrences', symbol FROM x UNION ALL SELECT path, 6, 'follow', '' FROM files)
SELECT target, row_number() OVER (PARTITION BY target ORDER BY o) AS place, step, subject FROM s WHERE target IN (SELECT path FROM files)""")(
    lambda t: context.next_steps(t.files, t.kept_edges(), t.exports))
_BUDGET = 200_000
query("budgeted_files", f"""
i AS (SELECT dst AS path, count(DISTINCT src) AS n FROM edges GROUP BY dst),
r AS (SELECT f.path, loc, coalesce(n, 0)::BIGINT AS importers, CASE WHEN coalesce(n, 0) >= 3 THEN 'shared' WHEN n >= 1 THEN 'used' ELSE 'leaf' END AS section FROM files f LEFT JOIN i ON i.path = f.path),
t AS (SELECT section, sum(loc) AS total FROM r GROUP BY section),
a AS (SELECT {_BUDGET // 2} AS shared), b AS (SELECT {_BUDGET * 3 // 10} + greatest(0, shared - coalesce((SELECT total FROM t WHERE section = 'shared'), 0)) AS used FROM a),
c AS (SELECT {_BUDGET // 5} + greatest(0, used - coalesce((SELECT total FROM t WHERE section = 'used'), 0)) AS leaf FROM b),
p AS (SELECT path, section, importers, loc, (sum(loc) OVER (PARTITION BY section ORDER BY importers DESC, path))::BIGINT AS through FROM r)
SELECT path, section, importers, loc, through FROM p WHERE through <= CASE section WHEN 'shared' THEN (SELECT shared FROM a) WHEN 'used' THEN (SELECT used FROM b) ELSE (SELECT leaf FROM c) END""")(lambda t: _budgeted(t))


def _risks(t: Tables) -> DataFrame:
    edges = t.kept_edges()
    return context.context_risks(context.context_files(edges, t.files, t.files.select("path")), edges)


def _budgeted(t: Tables) -> DataFrame:
    importers = t.edges.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n"))
    rows = t.files.select("path", "loc").join(importers, "path", "left").select("path", "loc", F.coalesce("n", F.lit(0)).alias("importers"))
    rows = rows.withColumn("section", F.when(F.col("importers") >= 3, "shared").when(F.col("importers") >= 1, "used").otherwise("leaf"))
    return context.within_budget(rows, "section", [F.desc("importers"), F.col("path")], "loc", _BUDGET, {"shared": 0.5, "used": 0.3, "leaf": 0.2})


# Environment ---------------------------------------------------------------------------------

#: What a nation's suppliers declare: a format by nation % 5, a line or item per name.
_FORMATS = {
    0: (".env.production", "# live\n", "export {n}='{v} # x'"), 1: ("docker-compose.yml", "services:\n  web:\n    environment:\n", '      {n}: "{v} # x"'), 2: ("config.yaml", "kind: Service\n---\nkind: ConfigMap\ndata:\n", "  {n}: {v} # x"),
    3: ("values.yaml", "app:\n  env:\n", "    - name: {n}\n      value: {v}"), 4: (".github/workflows/ci.yml", "jobs:\n  a:\n    steps:\n      - run: x\n        env:\n", "          {n}: ${{{{ secrets.S_{n} }}}}"),
}
_DECLARED = "SELECT DISTINCT s_nationkey AS nation, concat('VAR_', CAST(s_suppkey % 61 AS STRING)) AS name, concat('v', CAST(s_suppkey % 7 AS STRING)) AS v FROM {supplier}"


def _env_files(t: Tables) -> DataFrame:
    rows = t.spark.sql(_DECLARED, supplier=t.raw("supplier")).groupBy("nation", "name").agg(F.min("v").alias("v"))
    text, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (file, head, line) in _FORMATS.items():
        # An item's text around its name and value.
        built, rest = [], line.replace("{{", "\1").replace("}}", "\2")
        for part in rest.replace("{n}", "\0n\0").replace("{v}", "\0v\0").split("\0"):
            built.append(F.col("name") if part == "n" else F.col("v") if part == "v" else F.lit(part.replace("\1", "{").replace("\2", "}")))
        mine = F.col("nation") % 5 == k
        text = F.when(mine, F.concat(*built)).otherwise(text)
        path = F.when(mine, F.concat(F.lit("n"), F.col("nation").cast("string"), F.lit("/" + file))).otherwise(path)
    lines = rows.select("nation", path.alias("path"), text.alias("text")).groupBy("nation", "path").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("body"))
    head = F.element_at(F.create_map(*[F.lit(x) for k, (_, h, _) in _FORMATS.items() for x in (k, h)]), (F.col("nation") % 5).cast("int"))
    return lines.select("path", F.concat(head, "body").alias("content"))


_FILE_CASE = "CASE nation % 5 " + " ".join(f"WHEN {k} THEN '{f}'" for k, (f, _, _) in _FORMATS.items()) + " END"
query("declared_environment", f"""
d AS ({_DECLARED.replace('{supplier}', 'supplier')}), m AS (SELECT nation, name, min(v) AS v FROM d GROUP BY ALL), r AS (SELECT *, 'n' || nation || '/' || {_FILE_CASE} AS path FROM m)
SELECT name, CASE nation % 5 WHEN 0 THEN 'dotenv' WHEN 1 THEN 'docker_compose' WHEN 2 THEN 'k8s_config_map' WHEN 3 THEN 'helm_values' ELSE 'github_actions_env' END AS source_kind, path,
  CASE WHEN nation % 5 = 4 THEN 'from' ELSE 'plain' END AS presence,
  CASE WHEN nation % 5 < 2 THEN substr(sha256(v || ' # x'), 1, 12) WHEN nation % 5 < 4 THEN substr(sha256(v), 1, 12) END AS value_hash FROM r
UNION ALL SELECT 'S_' || name, 'github_actions_secret', path, 'from', NULL FROM r WHERE nation % 5 = 4""")(
    lambda t: env_sources.declarations(_env_files(t)).select("name", "source_kind", "path", "presence", "value_hash"))


# Order of moves --------------------------------------------------------------------------------


def _layer_sql(c: str) -> str:
    low = f"lower({c})"
    return (
        f"CASE WHEN regexp_matches({low}, '{moves.TEST}') THEN 'test' WHEN regexp_matches({low}, '{moves.UI}') AND NOT regexp_matches({low}, 'use|store') THEN 'ui' "
        f"WHEN regexp_matches({low}, '{moves.APP}') OR regexp_matches({c}, '(^|/)use[A-Z][^/]*$') THEN 'app' WHEN regexp_matches({low}, '{moves.KERNEL}') THEN 'kernel' WHEN regexp_matches({low}, '{moves.INFRA}') THEN 'infra' ELSE 'unknown' END"
    )


_FOLDER = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in moves.FOLDERS.items()) + " END"
_MOVES = """
w AS (SELECT path AS source, path AS node FROM files UNION SELECT w.source, e.src FROM w JOIN edges e ON e.dst = w.node),
d AS (SELECT source, count(*) FILTER (node <> source) AS dependents FROM w GROUP BY source), k AS (SELECT dst, count(DISTINCT src) AS consumers FROM edges GROUP BY dst),
""" + _CLOSURE.format("3", "true").strip() + f""",
li AS (SELECT src, {_layer_sql('dst')} AS l FROM edges ), ln AS (SELECT src, l, count(*) AS n FROM li WHERE l <> 'unknown' GROUP BY src, l), lm AS (SELECT src, min_by(l, (-n, l)) AS most FROM ln GROUP BY src),
r AS (SELECT f.path, f.loc, f.dir AS base, {_layer_sql('f.path')} AS layer, most, coalesce(consumers, 0) AS consumers, coalesce(dependents, 0) - coalesce(consumers, 0) AS further, m.path IS NOT NULL AS cyclic
  FROM files f LEFT JOIN d ON d.source = f.path LEFT JOIN k ON k.dst = f.path LEFT JOIN scc3 m ON m.path = f.path LEFT JOIN lm ON lm.src = f.path),
q AS (SELECT *, CASE WHEN layer <> 'unknown' THEN layer ELSE coalesce(most, 'infra') END AS target_layer,
  CASE WHEN cyclic OR consumers >= 10 OR further >= 50 OR loc >= 500 THEN 'high' WHEN consumers >= 5 OR further >= 20 OR loc >= 200 THEN 'medium' ELSE 'low' END AS risk
  FROM r WHERE layer = 'unknown' OR NOT contains(path, {_FOLDER.format('layer')})),
p AS (SELECT *, CASE risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS level FROM q),
plan AS (SELECT base, path AS source, base || '/' || {_FOLDER.format('target_layer')} || '/' || regexp_extract(path, '[^/]*$') AS target, layer, target_layer, risk, consumers, further, loc,
  CASE WHEN layer = 'unknown' AND cyclic THEN 'unclassified to ' || target_layer || ', in a cycle' WHEN layer = 'unknown' THEN 'unclassified to ' || target_layer WHEN cyclic THEN 'in a cycle' ELSE 'misplaced' END AS reason,
  consumers > 3 AS shim, dense_rank() OVER (PARTITION BY base ORDER BY level) AS phase, row_number() OVER (PARTITION BY base ORDER BY level, consumers, loc, path) AS place FROM p)"""
query("move_plan", _MOVES + " SELECT * FROM plan")(lambda t: moves.move_plan(t.dealt_files(), t.kept_edges()))
query("move_shims", _MOVES + """
SELECT source AS old_path, target AS new_path, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM exports x WHERE x.path = source) AS symbols, consumers AS importers FROM plan WHERE shim""")(
    lambda t: moves.shims(moves.move_plan(t.dealt_files(), t.kept_edges()), t.exports).withColumn("symbols", F.array_join("symbols", ",")))


# Staleness -------------------------------------------------------------------------------------


def _scans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two scans: of every ninth file the path changes, of every eleventh the content."""
    mark = F.concat_ws(":", "loc", "name")
    old = t.files.select("path", mark.alias("fingerprint"), "id")
    path = F.when(F.col("id") % 9 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    new = old.select(path.alias("path"), F.when(F.col("id") % 11 == 0, F.concat("fingerprint", F.lit("!"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return old.select("path", "fingerprint"), new


query("changed_contents", one("""
SELECT path, CASE WHEN id % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM files WHERE id % 9 = 0 OR id % 11 = 0 UNION ALL SELECT 'moved/' || path, 'added' FROM files WHERE id % 9 = 0"""))(
    lambda t: diff.changed_contents(*_scans(t)))
query("changed_directories", """
d AS (SELECT path, id, unnest(CASE WHEN is_test THEN ['.', dir, dir || '/tests'] ELSE ['.', dir] END) AS dir FROM files),
m AS (SELECT unnest(CASE WHEN is_test THEN ['moved', 'moved/' || dir, 'moved/' || dir || '/tests'] ELSE ['moved', 'moved/' || dir] END) AS dir FROM files WHERE id % 9 = 0),
o AS (SELECT dir, count(*) AS n, count(*) FILTER (id % 9 = 0) AS gone, count(*) FILTER (id % 9 = 0 OR id % 11 = 0) AS other FROM d GROUP BY dir)
SELECT dir, CASE WHEN gone = n AND dir <> '.' THEN 'removed' ELSE 'changed' END AS change FROM o WHERE other > 0 UNION SELECT dir, 'added' FROM m""")(
    lambda t: diff.changed_directories(*map(diff.directory_digests, _scans(t))))
