"""Further named queries: dead code with reasons, defects and health, lookups, places of literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators import bridges, explore, facts, graph, occurrences, symbols, truth
from coppice.plans.storage import materialize
from coppice.queries import (
    _BRIDGE, _CLASSES, _CLOSURE, _KIND, _PAGES, _REGISTRY, _SNAKE, _TAG, Tables, _marked, _pages, _shaped, _signed, one, query,
)

# Dead code ------------------------------------------------------------------------------


def _reached(t: Tables, edges: DataFrame) -> DataFrame:
    return graph.dynamic_reach(edges.where("src LIKE '%.ts'")).select("path")


def _handled(t: Tables) -> DataFrame:
    return t.own_exports.where("language = 'rs' AND line % 31 = 0").select("path", "name")


def _verdicts(t: Tables) -> DataFrame:
    edges = t.kept_edges()
    uses = t.own_exports.where("id % 23 = 0").select("path", "name")
    return truth.dead_verdicts(t.own_exports, t.own_imports, uses, _handled(t), _reached(t, edges), facts.idiom_tags(t.own_exports), ("brand_7/**/*.css",))


_KEYS = """
regexp_replace({0}, '[.](ts|tsx|py|rs|css)$', '') || ':' || CASE regexp_extract({0}, '[.](ts|tsx|py|rs|css)$', 1) WHEN 'tsx' THEN 'ts' ELSE regexp_extract({0}, '[.](ts|tsx|py|rs|css)$', 1) END"""
_VERDICTS = f"""
u AS (SELECT DISTINCT {_KEYS.format('resolved_path')} AS module, name FROM own_imports ),
dyn AS (SELECT dst AS node FROM edges WHERE label = 'lazy_import' AND src LIKE '%.ts' UNION SELECT e.dst FROM dyn JOIN edges e ON e.src = dyn.node WHERE e.src LIKE '%.ts'),
xp AS (SELECT path, name, kind, language, coalesce(min(line), 0)::BIGINT AS line, {_KEYS.format('path')} AS module FROM own_exports GROUP BY path, name, kind, language),
verdicts AS (SELECT x.path, x.name, kind, line, CASE WHEN contains(x.path, '/tests/') THEN 'skipped: test' WHEN language = 'go' THEN 'skipped: public_language'
  WHEN EXISTS (SELECT 1 FROM u WHERE u.module = x.module AND u.name = x.name) THEN 'imported' WHEN EXISTS (SELECT 1 FROM u WHERE u.module = x.module AND u.name = '*') THEN 'imported whole'
  WHEN EXISTS (SELECT 1 FROM own_exports l WHERE l.id % 23 = 0 AND l.path = x.path AND l.name = x.name) THEN 'used in its file'
  WHEN EXISTS (SELECT 1 FROM own_exports h WHERE h.path = x.path AND h.name = x.name AND h.language = 'rs' AND h.line % 31 = 0) THEN 'handler'
  WHEN x.path IN (SELECT node FROM dyn) THEN 'reached dynamically' WHEN {_TAG.replace('name', 'x.name').replace('(path', '(x.path')} IS NOT NULL THEN 'called by convention'
  WHEN x.name IN (SELECT name FROM u WHERE name <> '*') THEN 'imported by name' WHEN regexp_matches(x.path, '^brand_7/(.*/)?[^/]*[.]css$') THEN 'allowed' END AS reason FROM xp x)"""
query("dead_verdicts", _VERDICTS + " SELECT path, name, kind, line, reason, CASE WHEN reason IS NULL THEN 'high' END AS confidence FROM verdicts")(_verdicts)


def _sources(t: Tables) -> DataFrame:
    """A text for every fifth file: it names the file's export and quotes the stem of a file that it starts."""
    content = F.concat(F.lit("use "), F.replace("name", F.lit(" "), F.lit("_")), F.lit(' spawn("'), F.regexp_extract("path", "([^/]+)[.][a-z]+$", 1), F.lit('")'))
    return t.own_exports.where("id % 5 = 0").select(F.concat(F.lit("src/"), "path").alias("path"), content.alias("content"))


def _named_verdicts(t: Tables) -> DataFrame:
    return _verdicts(t).withColumn("name", F.replace("name", F.lit(" "), F.lit("_")))


def _dead(t: Tables) -> DataFrame:
    return materialize(truth.dead_truth(_named_verdicts(t), _sources(t), t.entry_points), "dead-truth")


_TRUTH = _VERDICTS + """,
src AS (SELECT 'src/' || path AS path, replace(name, ' ', '_') AS word, regexp_extract(path, '([^/]+)[.][a-z]+$', 1) AS stem FROM own_exports WHERE id % 5 = 0),
own AS (SELECT *, replace(name, ' ', '_') AS word, regexp_extract(path, '([^/]+)[.][a-z]+$', 1) AS stem FROM verdicts WHERE reason IS NULL),
nm AS (SELECT word, count(DISTINCT path) AS named_in FROM src GROUP BY word), st AS (SELECT stem, count(DISTINCT path) AS started_in FROM src GROUP BY stem),
truth AS (SELECT o.path, o.word AS name, kind, line, coalesce(named_in, 0)::BIGINT AS named_in, coalesce(started_in, 0)::BIGINT AS started_in, o.path IN (SELECT path FROM entry_points ) AS entry_point
  FROM own o LEFT JOIN nm ON nm.word = o.word LEFT JOIN st ON st.stem = o.stem),
dead AS (SELECT *, CASE WHEN named_in > 0 OR started_in > 0 OR entry_point THEN 'low' ELSE 'high' END AS confidence FROM truth)"""
query("dead_truth", _TRUTH + " SELECT * FROM dead")(_dead)
query("dead_truth_by_reason", _VERDICTS + " SELECT coalesce(reason, 'dead') AS reason, count(*) AS n FROM verdicts GROUP BY 1")(
    lambda t: _verdicts(t).groupBy(F.coalesce("reason", F.lit("dead")).alias("reason")).agg(F.count("*").alias("n")))

# Twins, smells and health -----------------------------------------------------------------


def _tags(t: Tables) -> DataFrame:
    """Every file of a brand that is named in the plural as a handler of its names."""
    return t.exports.where("name LIKE 'green%'").select("path", "name", F.lit("handler").alias("tag"))


_SIGNED = _REGISTRY + f""",
sg AS (SELECT r.*, x.language, {_KIND} AS kind, list_sort(list_concat(string_split(x.name, ' '), [{_KIND}, x.language])) AS signature FROM registry r JOIN exports x ON x.path = r.path AND x.name = r.name),
rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY import_count DESC, length(path), path) AS rank FROM sg WHERE name NOT IN ('new', 'run')),
tw AS (SELECT rk.name, h.path AS canonical, rk.path, len(list_intersect(rk.signature, h.signature)) / len(list_distinct(list_concat(rk.signature, h.signature))) AS sim
  FROM rk JOIN rk h ON h.name = rk.name AND h.rank = 1 WHERE rk.rank > 1),
mx AS (SELECT name FROM rk GROUP BY name HAVING count(DISTINCT kind) > 1),
twins AS (SELECT name, canonical, path, round(sim, 6) AS similarity, CASE WHEN name IN (SELECT name FROM mx) THEN 'NAME_COLLISION' WHEN sim >= 0.999 THEN 'EXACT' WHEN sim >= 0.4 THEN 'SHAPE_SIMILAR' ELSE 'NAME_COLLISION' END AS class FROM tw)"""
query("idiom_free_twins", _SIGNED + " SELECT * FROM twins WHERE name NOT LIKE 'green%'")(
    lambda t: truth.idiom_twins(symbols.exact_twins(_signed(t), t.imports), t.exports, _tags(t)))
_CROWDS = """
cc AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM edges GROUP BY dst),
cr AS (SELECT DISTINCT x.name, x.path, coalesce(importers, 0)::BIGINT AS importers FROM exports x LEFT JOIN cc ON cc.path = x.path),
cg AS (SELECT name, max(importers) AS primary_, count(*) AS members FROM cr GROUP BY name HAVING members > 1),
cu AS (SELECT cg.name, cg.members, cg.primary_, count(*) FILTER (primary_ > 0 AND importers <= floor(primary_ / 3)) AS underused FROM cr JOIN cg ON cg.name = cr.name GROUP BY ALL),
crowds AS (SELECT name, round(least(least(members - 1, 3) + 1.5 * ((underused > 0)::INT + (members >= 3)::INT) + 0.5 * underused, 10.0)::DOUBLE, 6) AS score FROM cu)"""
query("sniff", _SIGNED + "," + _CROWDS + """
SELECT name, 'twin' AS smell, count(*) AS n FROM twins GROUP BY name UNION ALL
SELECT name, 'parrot', count(*) FROM registry WHERE import_count = 0 AND name NOT IN (SELECT name FROM imports ) GROUP BY name UNION ALL
SELECT name, 'crowd', count(*) FROM crowds WHERE score >= 4 GROUP BY name""")(
    lambda t: truth.sniff(symbols.exact_twins(_signed(t), t.imports), symbols.dead_parrots(t.exports, t.imports), symbols.crowds(t.exports, t.edges)))
query("zombies", _TRUTH + "," + _REGISTRY + """,
sh AS (SELECT name FROM registry GROUP BY name HAVING count(*) FILTER (import_count > 0) > 0 AND count(*) FILTER (import_count = 0) > 0)
SELECT 'orphan_file' AS kind, path, loc::VARCHAR AS detail FROM files WHERE NOT is_test AND path NOT IN (SELECT dst FROM edges ) UNION
SELECT 'dead_export', path, name FROM dead UNION SELECT 'shadow_export', path, name FROM registry WHERE import_count = 0 AND name IN (SELECT name FROM sh)""")(
    lambda t: truth.zombies(_dead(t), symbols.orphan_files(t.files, t.edges), symbols.shadow_exports(t.exports, t.imports), symbols.symbol_registry(t.exports, t.imports)))


def _defects(t: Tables) -> DataFrame:
    edges, exports, imports = t.kept_edges(), materialize(t.exports, "exports"), materialize(t.imports, "imports")
    issues = truth.barrel_issues(symbols.missing_barrels(t.files, edges), symbols.reexport_chains(edges), symbols.inconsistent_paths(imports))
    twins = materialize(symbols.exact_twins(_shaped(exports), imports), "twins")
    plain = lambda df: df.withColumn("name", F.replace("name", F.lit("_"), F.lit(" ")))
    return truth.structural_defects(
        t.files, graph.classified_cycles(edges, strict=True), plain(_dead(t)), symbols.dead_parrots(exports, imports), twins, exports, issues,
        symbols.reexport_cascades(edges), symbols.duplicate_exports(exports), bridges.command_bridges(t.calls, t.handlers), bridges.unregistered_handlers(t.handlers),
    )


_DEFECTS = _TRUTH + "," + _SIGNED + "," + _BRIDGE + "," + _CLOSURE.format("", "label <> 'lazy_import'") + "," + _CLASSES.format("e.label <> 'lazy_import'") + f""",
mb AS (SELECT a.directory FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS directory FROM files GROUP BY 1 HAVING count(*) > 1) a
  JOIN (SELECT DISTINCT src, dst, regexp_replace(dst, '/[^/]*$', '') AS directory FROM edges WHERE regexp_replace(src, '/[^/]*$', '') <> regexp_replace(dst, '/[^/]*$', '')) b ON a.directory = b.directory GROUP BY 1 HAVING count(*) >= 3),
ch0 AS (SELECT src, min(dst) AS nxt FROM edges WHERE label = 'reexport' GROUP BY src),
ch AS (SELECT src, [src, nxt] AS chain, nxt AS at_ FROM ch0 UNION ALL SELECT ch.src, list_append(ch.chain, ch0.nxt), ch0.nxt FROM ch JOIN ch0 ON ch0.src = ch.at_ WHERE NOT list_contains(ch.chain, ch0.nxt)),
ic0 AS (SELECT name, source, count(*) AS n FROM imports WHERE name <> '*' GROUP BY ALL), ic1 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, source) AS rank FROM ic0),
shaped AS (SELECT DISTINCT name FROM twins WHERE class IN ('EXACT', 'SHAPE_SIMILAR')), gone AS (SELECT DISTINCT replace(name, '_', ' ') AS name FROM dead WHERE confidence = 'high' AND NOT entry_point),
defects AS (SELECT (SELECT count(*) FROM files ) AS files, (SELECT sum(loc)::BIGINT FROM files ) AS loc, (SELECT count(*) FROM bridge WHERE status = 'missing') AS missing_handlers,
  (SELECT count(*) FROM (SELECT {_SNAKE} AS command FROM handlers GROUP BY 1 HAVING NOT bool_or(registered))) AS unregistered_handlers,
  (SELECT count(*) FROM classes WHERE kind = 'hard_bidirectional') AS breaking_cycles, (SELECT count(*) FROM bridge WHERE status = 'unused') AS unused_handlers,
  (SELECT count(*) FROM dead WHERE confidence = 'high' AND NOT entry_point) AS dead_exports,
  (SELECT count(*) FROM registry WHERE import_count = 0 AND name NOT IN (SELECT name FROM imports ) AND name IN (SELECT name FROM gone)) AS twins_dead_parrots,
  (SELECT count(*) FROM shaped WHERE name IN (SELECT name FROM exports GROUP BY name HAVING count(DISTINCT language) = 1)) AS twins_same_language,
  (SELECT count(*) FROM mb) + (SELECT count(*) FROM (SELECT src FROM ch GROUP BY src HAVING max(len(chain)) > 3)) +
    (SELECT count(*) FROM (SELECT name FROM ic1 GROUP BY name HAVING count(*) > 1 AND coalesce(max(n) FILTER (rank > 1), 0) > 1)) AS barrel_chaos,
  (SELECT count(*) FROM classes WHERE kind = 'unknown') AS structural_cycles,
  (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges WHERE label = 'reexport' AND dst IN (SELECT src FROM edges WHERE label = 'reexport'))) AS cascade_imports,
  (SELECT count(*) FROM (SELECT name FROM exports GROUP BY name HAVING count(DISTINCT path) > 1) WHERE name IN (SELECT name FROM shaped) OR name NOT IN (SELECT name FROM twins)) AS duplicate_exports)"""
query("structural_defects", _DEFECTS + " SELECT * FROM defects")(_defects)
query("health_score", _DEFECTS + """,
hs AS (SELECT files, loc, missing_handlers + unregistered_handlers + breaking_cycles AS certain, unused_handlers + dead_exports + twins_dead_parrots AS high,
  twins_same_language + barrel_chaos + structural_cycles + cascade_imports + duplicate_exports // 5 AS smell FROM defects)
SELECT *, round(greatest(0, 100 - 50 * least(1, ln(1 + certain) / ln(1 + loc)) - 30 * least(1, ln(1 + high) / ln(1 + loc)) - 20 * least(1, ln(1 + smell) / ln(1 + loc))))::BIGINT AS score,
  round(least(1, ln(1 + certain + high + smell) / ln(1 + loc))::DOUBLE, 6) AS density FROM hs""")(lambda t: truth.health(_defects(t)))  # fmt: skip

# Environment and events ---------------------------------------------------------------------

_RANKS = "CASE source_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bridges.SOURCE_RANK.items()) + " ELSE 0 END"
query("env_warnings", f"""
r AS (SELECT *, source_kind IN {bridges.ENCRYPTED} AS enc, row_number() OVER (PARTITION BY name ORDER BY {_RANKS} DESC, path) AS place FROM env_declarations ),
f AS (SELECT name, path, enc, age_days AS a FROM r WHERE place = 1)
SELECT DISTINCT name, 'orphan_code_reference' AS warning, NULL AS path FROM env_reads WHERE name NOT IN (SELECT name FROM env_declarations ) UNION ALL
SELECT DISTINCT name, 'orphan_declaration', NULL FROM env_declarations WHERE name NOT IN (SELECT name FROM env_reads ) UNION ALL
SELECT name, 'multi_source_value_mismatch', NULL FROM r WHERE NOT enc GROUP BY name HAVING count(*) > 1 AND count(DISTINCT value_hash) > 1 UNION ALL
SELECT f.name, 'stale_overrides_fresh', f.path FROM f JOIN r ON r.name = f.name AND r.place = 2 WHERE a - age_days >= 30 UNION ALL
SELECT f.name, 'sealed_secret_suspected_stale', f.path FROM f JOIN (SELECT name, min(age_days) AS b FROM r WHERE place > 1 AND NOT enc GROUP BY name) y ON y.name = f.name WHERE f.enc AND a - b >= 30 UNION ALL
SELECT name, 'encrypted_decode_blocked', path FROM r WHERE enc""")(lambda t: bridges.env_warnings(t.env_declarations, t.env_reads))


def _event_calls(t: Tables) -> DataFrame:
    return t.emits.where("line % 11 = 0").select("path", "line")


def _literals(t: Tables) -> DataFrame:
    return t.listens.where("line % 13 = 0").select("path", F.upper("name").alias("value"))


def _listened(t: Tables) -> DataFrame:
    return t.listens.withColumn("name", F.when(F.col("line") % 17 == 0, F.concat(F.lit("late:"), "name")).when(F.col("line") % 19 == 0, F.upper("name")).otherwise(F.col("name")))


_K = "regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g')"
query("event_risks", f"""
e AS (SELECT {_K} AS event, name, path FROM emits ),
l0 AS (SELECT path, line, awaited, CASE WHEN line % 17 = 0 THEN 'late:' || name WHEN line % 19 = 0 THEN upper(name) ELSE name END AS name FROM listens ),
l AS (SELECT {_K} AS event, name, path, line, awaited FROM l0), s AS (SELECT DISTINCT event, path FROM l WHERE event NOT IN (SELECT event FROM e)),
q AS (SELECT DISTINCT {_K} AS event, path FROM listens WHERE line % 13 = 0), k AS (SELECT DISTINCT s.event FROM s JOIN q ON q.event = s.event AND q.path = s.path),
c AS (SELECT path, min(line) AS call_line FROM emits WHERE line % 11 = 0 GROUP BY path),
d AS (SELECT event, min(name) AS a, max(name) AS b, min(path) AS p FROM e GROUP BY event), h AS (SELECT event, min(name) AS a, max(name) AS b FROM l GROUP BY event)
SELECT 'orphan' AS kind, event, path FROM s WHERE event NOT IN (SELECT event FROM k) UNION ALL SELECT 'name_mismatch', d.event, d.p FROM d JOIN h ON h.event = d.event WHERE d.a <> h.a OR d.b <> h.b UNION ALL
SELECT DISTINCT 'listen_not_awaited', event, path FROM l WHERE NOT awaited UNION ALL
SELECT 'call_before_listen', event, x.path FROM (SELECT path, event, min(line) AS n FROM l GROUP BY ALL) x JOIN c ON c.path = x.path WHERE call_line < n UNION ALL
SELECT 'awaited_listen_late', event, x.path FROM (SELECT path, event, min(line) AS n FROM l WHERE awaited GROUP BY ALL) x JOIN c ON c.path = x.path WHERE call_line < n""")(
    lambda t: bridges.event_risks(t.emits, _listened(t), _event_calls(t), _literals(t)))

# Lookups ---------------------------------------------------------------------------------


def _asked(t: Tables) -> DataFrame:
    """Every file asked for by its name, every third by its full path, and some that aren't there."""
    names = t.files.select(F.when(F.col("id") % 3 == 0, F.col("path")).when(F.col("id") % 7 == 0, F.concat(F.lit("gone_"), "path")).otherwise(F.regexp_extract("path", "([^/]*)$", 1)).alias("asked"))
    return names.union(t.files.select(F.concat("name", F.lit(".ts"))))


query("resolved_targets", """
q AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN path WHEN id % 7 = 0 THEN 'gone_' || path ELSE regexp_extract(path, '[^/]*$') END AS asked FROM files UNION SELECT name || '.ts' FROM files ),
s AS (SELECT path, regexp_extract(path, '[^/]*$') AS tail FROM files UNION SELECT path, 'tests/' || regexp_extract(path, '[^/]*$') FROM files WHERE is_test UNION SELECT path, path FROM files ),
h AS (SELECT asked, count(path) AS n, max(path) FILTER (path = asked) AS exact, min(path) AS only_ FROM q LEFT JOIN s ON s.tail = q.asked GROUP BY asked)
SELECT asked, coalesce(exact, CASE WHEN n = 1 THEN only_ END) AS path, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state, n AS matches FROM h""")(
    lambda t: explore.resolve_targets(t.files, _asked(t)))
query("slice_report", """
sd0 AS (SELECT path AS source, path AS node, 0 AS depth FROM files UNION SELECT w.source, e.dst, w.depth + 1 FROM sd0 w JOIN edges e ON e.src = w.node WHERE w.depth < 2),
sd AS (SELECT source, count(*) AS deps, sum(loc)::BIGINT AS deps_loc FROM (SELECT DISTINCT source, node FROM sd0 WHERE node <> source) x JOIN files ON files.path = node GROUP BY source),
rx AS (SELECT DISTINCT src FROM edges WHERE label = 'reexport'),
sc0 AS (SELECT path AS source, path AS node FROM files UNION SELECT w.source, e.src FROM sc0 w JOIN edges e ON e.dst = w.node WHERE w.node = w.source OR w.node IN (SELECT src FROM rx)),
sc AS (SELECT source, count(*) AS consumers, sum(loc)::BIGINT AS consumers_loc FROM sc0 JOIN files ON files.path = node WHERE node <> source GROUP BY source),
su AS (SELECT owner, count(DISTINCT path) AS n FROM symbol_uses WHERE owner <> path GROUP BY owner)
SELECT f.path AS target, f.loc, coalesce(deps, 0)::BIGINT AS deps, coalesce(deps_loc, 0)::BIGINT AS deps_loc, coalesce(consumers, 0)::BIGINT AS consumers, coalesce(consumers_loc, 0)::BIGINT AS consumers_loc,
  0::BIGINT AS handlers, coalesce(su.n, 0)::BIGINT AS symbol_consumers, 1 + coalesce(deps, 0) + coalesce(consumers, 0) AS total_files, f.loc + coalesce(deps_loc, 0) + coalesce(consumers_loc, 0) AS total_loc
FROM files f LEFT JOIN sd ON sd.source = f.path LEFT JOIN sc ON sc.source = f.path LEFT JOIN su ON su.owner = f.path""")(
    lambda t: explore.slice_report(t.kept_edges(), t.files, t.files.select("path"), t.handlers, t.symbol_uses))
query("symbol_consumers", one("SELECT DISTINCT owner, name, path FROM symbol_uses WHERE owner <> path"))(lambda t: explore.symbol_consumers(t.symbol_uses))
query("where_symbol", """
k AS (SELECT path, name, line, 0 AS rank, 'export ' || kind || ' ' || name AS context FROM exports WHERE line IS NOT NULL UNION ALL SELECT path, name, id % 97, 1, 'local name ' || name FROM files WHERE id % 4 = 0),
n AS (SELECT * FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.path = s.path AND k.name = s.name AND k.line BETWEEN s.start_line AND s.end_line)),
r AS (SELECT * FROM k UNION ALL SELECT path, name, start_line, 2, 'node ' || name FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY path, name, line ORDER BY rank, context) AS place FROM r)
SELECT name, path, line, context FROM o WHERE place = 1""")(
    lambda t: explore.where_symbol(t.exports, t.files.where("id % 4 = 0").select("path", "name", (F.col("id") % 97).alias("line"), F.lit("name").alias("kind")), t.symbols))
query("callers", one("SELECT DISTINCT d.name, d.path, s.name AS caller, s.path AS caller_path FROM symbol_edges e JOIN symbols s ON s.id = e.src JOIN symbols d ON d.id = e.dst WHERE e.kind = 'calls'"))(
    lambda t: explore.callers(t.symbol_edges, t.symbols))
query("references", """
o AS (SELECT owner || '::' || name AS symbol_id, path, 'reference' AS role FROM symbol_uses UNION ALL SELECT id, path, 'definition' FROM symbols )
SELECT symbol_id, s.name, count(DISTINCT o.path) AS files, count(*) FILTER (role = 'definition') AS definitions, count(*) FILTER (role = 'reference') AS "references" FROM o JOIN symbols s ON s.id = o.symbol_id GROUP BY ALL""")(
    lambda t: explore.references(t.symbol_uses.select(F.concat_ws("::", "owner", "name").alias("symbol_id"), "path", F.lit("reference").alias("role")).union(t.symbols.select("id", "path", F.lit("definition"))), t.symbols))
query("merged_graphs", """
a AS (SELECT src, dst, label, 1 AS source FROM edges_before UNION ALL SELECT src, dst, label, 2 FROM edges_after ),
b AS (SELECT src, dst, min((source, label)) AS x FROM a GROUP BY ALL)
SELECT src, dst, x[2] AS label, x[1] AS source FROM b""")(lambda t: explore.merged_graphs(t.edges_before, t.edges_after, ["src", "dst"]))
query("power_path", """
w AS (SELECT path AS node, 0 AS depth FROM files WHERE name LIKE 'blue%' UNION SELECT u.b, w.depth + 1 FROM w JOIN (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges ) u ON u.a = w.node WHERE w.depth < 2),
r AS (SELECT node AS path, min(depth)::BIGINT AS depth FROM w GROUP BY node), i AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM edges GROUP BY dst)
SELECT r.path, depth, coalesce(importers, 0)::BIGINT AS importers, loc, (100 - 30 * depth + least(coalesce(importers, 0), 25))::BIGINT AS score FROM r JOIN files f ON f.path = r.path LEFT JOIN i ON i.path = r.path""")(
    lambda t: explore.power_path(t.kept_edges(), t.files, t.files.where("name LIKE 'blue%'").select("path")))
query("focused_groups", """
m AS (SELECT DISTINCT name, path FROM exports WHERE NOT regexp_matches(path, '^(.*/)?tests/.*$')), k AS (SELECT name FROM m GROUP BY name HAVING count(*) > 1 AND bool_or(regexp_matches(path, '^brand_1[^/]*/(.*/)?[^/]*[.]py$')))
SELECT name, path FROM m WHERE name IN (SELECT name FROM k)""")(
    lambda t: explore.focused(t.exports.select("name", "path").distinct(), ("brand_1*/**/*.py",), ("**/tests/**",)))

# Places of literals --------------------------------------------------------------------------

_PLACES = _PAGES + """
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM pg),
pa AS (SELECT path, line, string_split_regex(text, '\\btrack\\b') AS parts FROM ln WHERE regexp_matches(text, '\\btrack\\b')),
pl AS (SELECT path, line, unnest(list_transform(range(1, len(parts)), lambda k: length(array_to_string(list_slice(parts, 1, k), 'track')))) + 1 AS "column" FROM pa)"""
query("literal_places", _PLACES + """ SELECT path, line, "column", 'track' AS term FROM pl""")(
    lambda t: occurrences.occurrences(_pages(t), ["track"]).select("path", "line", "column", "term"))


def _classified(t: Tables) -> DataFrame:
    return occurrences.classified(occurrences.occurrences(_marked(t), ["track", "class"]))


query("classified_places")(_classified)
query("ranked_places")(lambda t: occurrences.first_page(_classified(t), 50))
query("enriched_places")(lambda t: occurrences.enriched(_classified(t), _classified(t).where("line % 5 = 0").select("path", F.col("term").alias("name"), "line")).groupBy("role", "confidence").agg(F.count("*").alias("n")))
query("combined_search", """
s AS (SELECT 'symbol' AS kind, path, name || CASE WHEN line IS NULL THEN ' (dead)' ELSE '' END AS detail FROM (SELECT path, name, min(line) AS line FROM exports WHERE regexp_matches(name, '(?i)ring|blue') GROUP BY ALL)),
m AS (SELECT DISTINCT 'param' AS kind, path, name AS detail FROM imports WHERE regexp_matches(name, '(?i)ring|blue')),
h AS (SELECT DISTINCT path, split_part(name, ' ', 1) AS term FROM imports WHERE name <> '*')
SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT 'silencer', path, 'noqa:' || loc FROM files WHERE id % 50 = 0 UNION ALL
SELECT 'cross_match', path, count(DISTINCT term)::VARCHAR FROM h GROUP BY path HAVING count(DISTINCT term) > 1""")(
    lambda t: occurrences.combined_search(
        "ring blue x", t.exports, t.imports.select("path", "name"), t.exports.where("line IS NULL").select("path", "name"),
        t.files.where("id % 50 = 0").select("path", F.col("loc").alias("line"), F.lit("noqa").alias("kind")),
        t.imports.where("name <> '*'").select("path", F.substring_index("name", " ", 1).alias("term"))))
query("tagmap", """
r AS (SELECT 'path' AS "where", path FROM files WHERE contains(lower(path), 'ring') UNION ALL SELECT 'export', path FROM exports WHERE contains(lower(name), 'ring') UNION ALL
  SELECT 'import', path FROM imports WHERE contains(lower(name), 'ring') UNION ALL SELECT 'literal', path FROM local_uses WHERE contains(lower(name), 'ring') UNION ALL
  SELECT 'dead', path FROM exports WHERE line IS NULL AND contains(lower(name), 'ring'))
SELECT "where", count(*) AS rows, count(DISTINCT path) AS files FROM r GROUP BY "where\"""")(
    lambda t: occurrences.tagmap("ring", t.files.select("path"), t.imports, t.exports, t.local_uses, t.exports.where("line IS NULL")))
query("production_files", one("SELECT path, loc FROM files WHERE NOT contains(path, '/tests/')"))(lambda t: truth.production(t.files.select("path", "loc")))
