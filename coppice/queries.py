"""Named queries over the given tables, each with SQL that another engine can check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions import paths
from coppice.operators import bridges, coverage, diff, facts, graph, metrics, search, symbols
from coppice.plans.storage import dealt, join_by_size, materialize, table
from coppice.sources import extract
from coppice.sources import projection as p
from coppice.streaming import patch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The projected tables of a directory, made when asked for; what they share is written once a query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._links = spark, sf_dir, None
        join_by_size(spark)

    def __getattr__(self, name: str) -> DataFrame:
        select = getattr(p, name.upper())
        if "{links}" in select and self._links is None:
            self._links = materialize(p.brand_links(self.spark, self.sf_dir), "links")
        return p.project(self.spark, self.sf_dir, select, self._links)

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def dealt_files(self) -> DataFrame:
        """The files, for what takes long per file: the table they are made of may be one partition."""
        return self.spark.sql(p.FILES, part=dealt(self.raw("part"), "p_partkey"))

    def kept_edges(self) -> DataFrame:
        """The edges as a table of the shared folder, for operators that walk them many times."""
        return materialize(self.edges, "edges")


def query(name: str, sql: str | None = None):
    """Registers a query of the projected tables; `sql` names these tables as if they existed."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_tables(sql)
        return build

    return register


NAMES = ("own_exports", "own_imports", "symbol_edges", "symbol_uses", "symbols", "local_uses", "constants", "entry_points", "files", "edges_before", "edges_after", "edges", "exports", "imports", "calls", "handlers", "emits", "listens", "env_declarations", "env_reads", "texts")


def with_tables(sql: str) -> str:
    """The SQL after the definitions of the projected tables that it uses."""
    words = re.split(r"[\s,()]+", sql)
    used = [n for n in NAMES if n in words]
    tables = {n: getattr(p, n.upper()) for n in used}
    if any("{links}" in select for select in tables.values()):
        tables = {"links": p.LINKS} | tables
    return "WITH RECURSIVE " + ",\n".join([*(f"{n} AS MATERIALIZED ({p.plain(select)})" for n, select in tables.items()), sql.strip()])


def one(select: str) -> str:
    """A SELECT as the last definition and the query for it."""
    return f"answer AS ({select}) SELECT * FROM answer"


# Directories, metrics and degrees ---------------------------------------------------

query("repository_metrics", one("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT sum(loc)::BIGINT FROM files ) AS total_loc"))(
    lambda t: metrics.repository_metrics(t.files, t.edges))

_INCOMING = """
c AS (SELECT dst AS path, count(DISTINCT src) AS importers_direct, count(*) AS import_edges FROM edges GROUP BY dst),
incoming AS (SELECT coalesce(f.path, c.path) AS path, coalesce(loc, 0)::BIGINT AS loc, coalesce(importers_direct, 0)::BIGINT AS importers_direct,
  coalesce(import_edges, 0)::BIGINT AS import_edges, 0::BIGINT AS importers_implicit FROM files f FULL JOIN c ON f.path = c.path)"""
query("incoming_imports", _INCOMING + " SELECT * FROM incoming")(lambda t: metrics.incoming_imports(t.files, t.edges))
query("top_hubs", _INCOMING + " SELECT * FROM incoming WHERE importers_direct > 0 ORDER BY importers_direct DESC, import_edges DESC, path LIMIT 20")(
    lambda t: metrics.top_hubs(t.files, t.edges))
query("hotspots", """
i AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS path, count(*) AS n FROM edges GROUP BY 1),
r AS (SELECT coalesce(i.path, o.path) AS path, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM i FULL JOIN o ON i.path = o.path)
SELECT *, CASE WHEN in_degree >= 10 THEN 'CORE' WHEN in_degree >= 3 THEN 'SHARED' WHEN in_degree >= 1 THEN 'PERIPHERAL' ELSE 'LEAF' END AS tier FROM r""")(
    lambda t: metrics.hotspots(t.edges))
query("hub_scores", """
s AS (SELECT f.path, (SELECT count(*) FROM edges e WHERE e.src = f.path) AS imports, (SELECT count(*) FROM exports x WHERE x.path = f.path) AS exports,
  (SELECT count(DISTINCT src) FROM edges e WHERE e.dst = f.path) AS importers, 0::BIGINT AS commands FROM files f),
top AS (SELECT *, imports + 2 * exports + 3 * importers + 2 * commands AS score FROM s ORDER BY score DESC, path LIMIT 30)
SELECT * FROM top WHERE score > 5""")(lambda t: metrics.hub_scores(t.files, t.edges, t.exports, t.handlers))
query("directory_tree", """
d AS (SELECT '.' AS directory, path, loc FROM files UNION ALL SELECT dir, path, loc FROM files UNION ALL SELECT dir || '/tests', path, loc FROM files WHERE is_test)
SELECT directory, count(*) AS files, sum(loc)::BIGINT AS loc, count(*) FILTER (loc >= 900) AS large_files FROM d GROUP BY directory""")(
    lambda t: metrics.directory_tree(t.files))
query("bounded_files", one("SELECT path, loc, 25::BIGINT AS emitted, (SELECT count(*) FROM files ) AS total, (SELECT count(*) FROM files ) > 25 AS truncated FROM files ORDER BY loc DESC, path LIMIT 25"))(
    lambda t: metrics.bounded(t.files.select("path", "loc"), [F.desc("loc"), "path"], 25))
query("paged_files", one("SELECT path, loc, (SELECT count(*) FROM files ) AS total, CASE WHEN (SELECT count(*) FROM files ) > 80 THEN 80::BIGINT END AS next_offset FROM files ORDER BY path LIMIT 40 OFFSET 40"))(
    lambda t: metrics.page(t.files.select("path", "loc"), ["path"], 40, 40))

# Symbols ----------------------------------------------------------------------------

query("duplicate_exports", """
r AS (SELECT DISTINCT name, path, dir, language, contains(path, '/tests/') AS dev FROM exports),
g AS (SELECT name, count(*) AS files, 2 * count(*) FILTER (NOT dev) + count(*) FILTER (dev) AS score, min_by(path, (dev::INT::VARCHAR || path)) AS canonical,
  count(DISTINCT dir) AS packages, count(DISTINCT language) AS languages FROM r GROUP BY name)
SELECT *, CASE WHEN languages > 1 THEN 'cross_language' WHEN packages >= 3 THEN 'cross_package' ELSE 'same_package' END AS severity FROM g WHERE files > 1""")(
    lambda t: symbols.duplicate_exports(t.exports))
_KEY = "regexp_replace({0}, '[.](ts|tsx|py|rs|css)$', '') || ':' || CASE regexp_extract({0}, '[.](ts|tsx|py|rs|css)$', 1) WHEN 'tsx' THEN 'ts' ELSE regexp_extract({0}, '[.](ts|tsx|py|rs|css)$', 1) END"
_DEAD = f"""
u AS (SELECT DISTINCT {_KEY.format('resolved_path')} AS module, name FROM imports),
dead AS (SELECT path, name, kind, coalesce(line, 0)::BIGINT AS line,
  CASE WHEN name IN (SELECT name FROM u WHERE name <> '*') THEN 'low' WHEN kind = 'const' THEN 'high' ELSE 'very-high' END AS confidence
FROM (SELECT *, {_KEY.format('path')} AS module FROM exports WHERE NOT contains(path, '/tests/')) x
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.module = x.module AND (u.name = x.name OR u.name = '*')))"""
query("dead_exports", _DEAD + " SELECT * FROM dead")(lambda t: symbols.dead_exports(t.exports, t.imports))
query("dead_confidence_counts", _DEAD + " SELECT confidence, kind, count(*) AS n FROM dead GROUP BY ALL")(
    lambda t: symbols.dead_exports(t.exports, t.imports).groupBy("confidence", "kind").agg(F.count("*").alias("n")))
_REGISTRY = """
ic AS (SELECT resolved_path AS path, name, count(*) AS n FROM imports GROUP BY ALL),
registry AS (SELECT DISTINCT x.path, x.name, coalesce(n, 0)::BIGINT AS import_count FROM exports x LEFT JOIN ic ON ic.path = x.path AND ic.name = x.name)"""
query("symbol_registry", _REGISTRY + " SELECT * FROM registry")(lambda t: symbols.symbol_registry(t.exports, t.imports))
query("dead_parrots", _REGISTRY + " SELECT path, name FROM registry WHERE import_count = 0 AND name NOT IN (SELECT name FROM imports )")(
    lambda t: symbols.dead_parrots(t.exports, t.imports))
query("shadow_exports", _REGISTRY + """ SELECT name, count(*) FILTER (import_count > 0) AS used, count(*) FILTER (import_count = 0) AS unused,
  min(path) FILTER (import_count > 0) AS canonical FROM registry GROUP BY name HAVING used > 0 AND unused > 0""")(lambda t: symbols.shadow_exports(t.exports, t.imports))


def _shaped(exports: DataFrame) -> DataFrame:
    """Exports with a fingerprint; names of even length are of one kind wherever they stand."""
    kind = F.when(F.length("name") % 2 == 0, "class").otherwise(F.col("kind"))
    return exports.withColumn("kind", kind).withColumn("signature", F.array_sort(F.concat(F.split("name", " "), F.array("kind", "language"))))


def _signed(t: Tables) -> DataFrame:
    return _shaped(t.exports)


_KIND = "CASE WHEN length(x.name) % 2 = 0 THEN 'class' ELSE x.kind END"
query("exact_twins", _REGISTRY + f""",
s AS (SELECT r.*, {_KIND} AS kind, list_sort(list_concat(string_split(x.name, ' '), [{_KIND}, x.language])) AS signature FROM registry r JOIN exports x ON x.path = r.path AND x.name = r.name),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY import_count DESC, length(path), path) AS rank FROM s),
j AS (SELECT k.name, h.path AS canonical, k.path, len(list_intersect(k.signature, h.signature)) / len(list_distinct(list_concat(k.signature, h.signature))) AS sim
  FROM k JOIN k h ON h.name = k.name AND h.rank = 1 WHERE k.rank > 1),
mx AS (SELECT name FROM k GROUP BY name HAVING count(DISTINCT kind) > 1)
SELECT name, canonical, path, round(sim, 6) AS similarity, CASE WHEN name IN (SELECT name FROM mx) THEN 'NAME_COLLISION' WHEN sim >= 0.999 THEN 'EXACT' WHEN sim >= 0.4 THEN 'SHAPE_SIMILAR' ELSE 'NAME_COLLISION' END AS class FROM j""")(
    lambda t: symbols.exact_twins(_signed(t), t.imports))


def _routes(t: Tables) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ("get", " GET", "post", "put"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.raw("orders").select(
        F.concat(F.lit("api_"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("path"), F.col("o_orderstatus").alias("framework"),
        method.alias("method"), F.concat(F.lit("/orders/"), (F.col("o_custkey") % 300).cast("string")).alias("route_path"),
    )


query("route_twins", """
r AS (SELECT 'api_' || (o_custkey % 50) || '.py' AS path, o_orderstatus AS framework, upper(trim(['get', ' GET', 'post', 'put'][o_orderkey % 4 + 1])) AS method,
  '/orders/' || (o_custkey % 300) AS route_path FROM orders)
SELECT framework, method, route_path, count(*) AS n, count(DISTINCT path) AS files, CASE WHEN count(*) > count(DISTINCT path) THEN 'high' ELSE 'medium' END AS severity
FROM r GROUP BY framework, method, route_path HAVING count(*) > 1""")(lambda t: symbols.route_twins(_routes(t)))
query("missing_barrels", """
d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS files FROM files GROUP BY 1 HAVING count(*) > 1),
e AS (SELECT DISTINCT src, dst, regexp_replace(dst, '/[^/]*$', '') AS directory FROM edges WHERE regexp_replace(src, '/[^/]*$', '') <> regexp_replace(dst, '/[^/]*$', ''))
SELECT d.directory, d.files, count(*) AS external_imports FROM d JOIN e ON d.directory = e.directory GROUP BY ALL HAVING count(*) >= 3""")(
    lambda t: symbols.missing_barrels(t.files, t.edges))


def _spelled(t: Tables) -> DataFrame:
    return t.imports.withColumn("source", F.concat("source", F.when(F.length("path") % 3 == 0, ".js").otherwise("")))


query("inconsistent_paths", """
c AS (SELECT name, source || CASE WHEN length(path) % 3 = 0 THEN '.js' ELSE '' END AS source, count(*) AS n FROM imports WHERE name <> '*' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, source) AS rank FROM c)
SELECT name, count(*) AS sources, max(source) FILTER (rank = 1) AS canonical, coalesce(max(n) FILTER (rank > 1), 0) AS next_use FROM k GROUP BY name HAVING sources > 1 AND next_use > 1""")(
    lambda t: symbols.inconsistent_paths(_spelled(t)))
query("barrels", one("SELECT src AS path, count(*) FILTER (label = 'reexport') AS reexports, count(DISTINCT dst) FILTER (label = 'reexport') AS targets, bool_or(label <> 'reexport') AS mixed FROM edges GROUP BY src HAVING reexports > 0"))(
    lambda t: symbols.barrels(t.edges))
query("reexport_cascades", one("SELECT DISTINCT src, dst FROM edges WHERE label = 'reexport' AND dst IN (SELECT src FROM edges WHERE label = 'reexport')"))(
    lambda t: symbols.reexport_cascades(t.edges))
query("reexport_chains", """
n AS (SELECT src, min(dst) AS nxt FROM edges WHERE label = 'reexport' GROUP BY src),
w AS (SELECT src, [src, nxt] AS chain, nxt AS at_ FROM n UNION ALL
  SELECT w.src, list_append(w.chain, n.nxt), n.nxt FROM w JOIN n ON n.src = w.at_ WHERE NOT list_contains(w.chain, n.nxt)),
m AS (SELECT src, max_by(chain, len(chain)) AS chain FROM w GROUP BY src)
SELECT src, array_to_string(chain, '>') AS chain, len(chain) - 1 AS steps FROM m WHERE len(chain) > 3""")(lambda t: symbols.reexport_chains(materialize(t.edges, "edges")))
query("orphan_files", one("SELECT path, loc FROM files WHERE NOT is_test AND path NOT IN (SELECT dst FROM edges )"))(lambda t: symbols.orphan_files(t.files, t.edges))


def _uses(t: Tables) -> DataFrame:
    return t.imports.where("name <> '*'").select("path", "name")


query("implicit_edges", """
u AS (SELECT name, min(path) AS dst FROM exports GROUP BY name HAVING count(DISTINCT path) = 1)
SELECT DISTINCT i.path AS src, u.dst FROM imports i JOIN u ON i.name = u.name WHERE i.name <> '*' AND i.path <> u.dst""")(
    lambda t: symbols.implicit_edges(_uses(t), t.exports))
query("stem_matches", """
s AS (SELECT regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '_[0-9]+$', '') AS stem, language FROM files)
SELECT stem, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) AS files FROM s GROUP BY stem HAVING count(DISTINCT language) > 1""")(
    lambda t: symbols.stem_matches(t.files))
query("pattern_words", """
w AS (SELECT lower(unnest(regexp_extract_all(name, '([A-Z][a-z]+|[a-z]+)', 1))) AS word FROM exports)
SELECT word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY word HAVING n >= 3 ORDER BY n DESC, word LIMIT 10""")(lambda t: symbols.pattern_words(t.exports))
query("crowds", """
c AS (SELECT dst AS path, count(DISTINCT src) AS importers FROM edges GROUP BY dst),
r AS (SELECT DISTINCT x.name, x.path, coalesce(importers, 0)::BIGINT AS importers FROM exports x LEFT JOIN c ON c.path = x.path),
g AS (SELECT name, max(importers) AS primary_, count(*) AS members FROM r GROUP BY name HAVING members > 1),
u AS (SELECT g.name, g.members, g.primary_, count(*) FILTER (primary_ > 0 AND importers <= floor(primary_ / 3)) AS underused FROM r JOIN g ON g.name = r.name GROUP BY ALL)
SELECT name, members, primary_ AS "primary", underused,
  round(least(least(members - 1, 3) + 1.5 * ((underused > 0)::INT + (members >= 3)::INT) + 0.5 * underused, 10.0)::DOUBLE, 6) AS score FROM u""")(
    lambda t: symbols.crowds(t.exports, t.edges))
query("similar_files", """
r AS (SELECT DISTINCT path, resolved_path FROM imports ), z AS (SELECT path, list_sort(list(resolved_path)) AS m FROM r GROUP BY path),
k AS (SELECT m, min(path) AS path, count(*) AS files FROM z GROUP BY m),
s AS (SELECT x.path AS a, y.path AS b, x.files AS a_files, y.files AS b_files, len(list_intersect(x.m, y.m)) / len(list_distinct(list_concat(x.m, y.m))) AS j FROM k x JOIN k y ON x.path < y.path)
SELECT a, b, a_files, b_files, round(j, 6) AS similarity FROM s WHERE j > 0.3""")(
    lambda t: symbols.similar_files(t.imports))

# Bridges ----------------------------------------------------------------------------

_SNAKE = "regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]', '', 'g')"
_BRIDGE = f"""
c AS (SELECT {_SNAKE} AS command, count(*) AS calls, min(name) AS call_name FROM calls GROUP BY 1),
h AS (SELECT {_SNAKE} AS command, count(*) AS handlers, min(name) AS handler_name, min(path) AS handler_path FROM handlers WHERE registered GROUP BY 1),
bridge AS (SELECT coalesce(c.command, h.command) AS command, coalesce(handler_name, call_name) AS name, coalesce(calls, 0)::BIGINT AS calls, coalesce(handlers, 0)::BIGINT AS handlers,
  handler_path, CASE WHEN handlers IS NULL THEN 'missing' WHEN calls IS NULL THEN 'unused' ELSE 'connected' END AS status FROM c FULL JOIN h ON c.command = h.command)"""
query("command_bridges", _BRIDGE + " SELECT * FROM bridge")(lambda t: bridges.command_bridges(t.calls, t.handlers))
query("unregistered_handlers", one(f"SELECT {_SNAKE} AS command, count(*) AS handlers FROM handlers GROUP BY 1 HAVING NOT bool_or(registered)"))(
    lambda t: bridges.unregistered_handlers(t.handlers))
ASKED = ["getCustomer7", "get_customer_1050", "GetCustomer30000", "get_customer_12"]
query("trace_handler", _BRIDGE + f""", a AS (SELECT unnest({ASKED}) AS name), b AS (SELECT name AS asked, {_SNAKE} AS command FROM a)
SELECT asked, CASE status WHEN 'connected' THEN 'CONNECTED' WHEN 'unused' THEN 'UNUSED' WHEN 'missing' THEN 'MISSING' ELSE 'NOT FOUND' END AS verdict
FROM b LEFT JOIN bridge ON b.command = bridge.command""")(lambda t: bridges.trace_handler(t.calls, t.handlers, ASKED))
query("event_bridges", """
e AS (SELECT name AS event, count(*) AS n, bool_and(path LIKE '%.ts') AS script FROM emits GROUP BY 1), l AS (SELECT name AS event, count(*) AS n, bool_and(path LIKE '%.ts') AS script FROM listens GROUP BY 1),
b AS (SELECT DISTINCT x.name AS event FROM emits x JOIN listens y ON x.name = y.name AND x.path = y.path)
SELECT coalesce(e.event, l.event) AS event, coalesce(e.n, 0)::BIGINT AS emits, coalesce(l.n, 0)::BIGINT AS listens, coalesce(e.script AND l.script, false) AS is_fe_sync, b.event IS NOT NULL AS same_file_sync
FROM e FULL JOIN l ON e.event = l.event LEFT JOIN b ON b.event = coalesce(e.event, l.event)""")(lambda t: bridges.event_bridges(t.emits, t.listens))
query("pipelines", """
e AS (SELECT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g') AS event, count(*) AS emits FROM emits GROUP BY 1),
l AS (SELECT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g') AS event, count(*) AS listens, count(*) FILTER (NOT awaited) AS not_awaited FROM listens GROUP BY 1)
SELECT coalesce(e.event, l.event) AS event, coalesce(emits, 0)::BIGINT AS emits, coalesce(listens, 0)::BIGINT AS listens, coalesce(not_awaited, 0)::BIGINT AS not_awaited,
  CASE WHEN listens IS NULL THEN 'ghost' WHEN emits IS NULL THEN 'orphan' ELSE 'ok' END AS status FROM e FULL JOIN l ON e.event = l.event""")(
    lambda t: bridges.pipelines(t.emits, t.listens))
query("emits_before_listens", """
e AS (SELECT path, name, min(line) AS first_emit FROM emits GROUP BY ALL), l AS (SELECT path, name, min(line) AS first_listen FROM listens GROUP BY ALL)
SELECT e.path, e.name, first_emit, first_listen FROM e JOIN l ON e.path = l.path AND e.name = l.name WHERE first_emit < first_listen""")(
    lambda t: bridges.emits_before_listens(t.emits, t.listens))


def _starred(events: DataFrame) -> DataFrame:
    """Every third event with a star for its last digit."""
    return events.withColumn("name", F.when(F.col("line") % 3 == 0, F.regexp_replace("name", "[0-9]$", "*")).otherwise(F.col("name")))


_STAR = "CASE WHEN line % 3 = 0 THEN regexp_replace(name, '[0-9]$', '*') ELSE name END"
_EVENT = f"regexp_replace(lower({_STAR}), '[^a-z0-9*]', '_', 'g')"
query("wildcard_events", f"""
e AS (SELECT {_EVENT} AS pattern, count(*) AS emits FROM emits WHERE contains({_STAR}, '*') GROUP BY 1),
l AS (SELECT {_EVENT} AS pattern, count(*) AS listens FROM listens WHERE contains({_STAR}, '*') GROUP BY 1)
SELECT e.pattern, emits, listens FROM e JOIN l ON e.pattern = l.pattern""")(lambda t: bridges.wildcard_events(_starred(t.emits), _starred(t.listens)))
query("matching_events", f"""
e AS (SELECT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g') AS event, count(*) AS emits FROM emits GROUP BY 1),
l AS (SELECT {_EVENT} AS pattern, count(*) AS listens FROM listens WHERE contains({_STAR}, '*') GROUP BY 1)
SELECT pattern, event, emits, listens FROM e JOIN l ON length(event) >= length(pattern) - 1 AND starts_with(event, split_part(pattern, '*', 1)) AND suffix(event, split_part(pattern, '*', 2))""")(
    lambda t: bridges.matching_events(t.emits, _starred(t.listens)))
query("handler_chains", f"""
c AS (SELECT {_SNAKE} AS command, count(*) AS calls FROM calls WHERE NOT contains(name, '.') GROUP BY 1), h AS (SELECT DISTINCT {_SNAKE} AS command, path FROM handlers ),
v AS (SELECT 'api_' || (line % 25) || '.rs' AS path, count(DISTINCT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g')) AS n FROM emits GROUP BY 1),
k AS (SELECT command, count(*) AS handlers, min(h.path) AS handler_path, coalesce(sum(n), 0)::BIGINT AS emitted_events FROM h LEFT JOIN v ON v.path = h.path GROUP BY command)
SELECT coalesce(c.command, k.command) AS command, coalesce(calls, 0)::BIGINT AS calls, coalesce(handlers, 0)::BIGINT AS handlers, handler_path, coalesce(emitted_events, 0)::BIGINT AS emitted_events,
  CASE WHEN handlers IS NULL THEN 'missing' WHEN calls IS NULL THEN 'unused' ELSE 'ok' END AS status FROM c FULL JOIN k ON c.command = k.command""")(
    lambda t: bridges.handler_chains(t.calls, t.handlers, t.emits.withColumn("path", F.concat(F.lit("api_"), (F.col("line") % 25).cast("string"), F.lit(".rs")))))
query("command_listing", f"""
r AS (SELECT DISTINCT {_SNAKE} AS command, path, 'call' AS side FROM calls UNION SELECT DISTINCT {_SNAKE}, path, 'handler' FROM handlers )
SELECT command, count(*) FILTER (side = 'call') AS calling_files, count(*) FILTER (side = 'handler') AS handling_files, 0::BIGINT AS test_files FROM r GROUP BY command""")(
    lambda t: bridges.command_listing(t.calls, t.handlers))
query("event_listing", """
r AS (SELECT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g') AS event, path, 'emit' AS side, awaited FROM emits UNION ALL SELECT regexp_replace(lower(name), '[^a-z0-9*]', '_', 'g'), path, 'listen', awaited FROM listens )
SELECT event, count(DISTINCT path) FILTER (side = 'emit') AS emitting_files, count(DISTINCT path) FILTER (side = 'listen') AS listening_files,
  coalesce(bool_or(awaited) FILTER (side = 'listen'), false) AS awaited FROM r GROUP BY event""")(lambda t: bridges.event_listing(t.emits, t.listens))
query("route_listing", """
r AS (SELECT DISTINCT 'api_' || (o_custkey % 50) || '.py' AS path, o_orderstatus AS framework, upper(trim(['get', ' GET', 'post', 'put'][o_orderkey % 4 + 1])) AS method, '/orders/' || (o_custkey % 300) AS route_path FROM orders)
SELECT framework, route_path, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, count(DISTINCT path) AS files FROM r GROUP BY ALL""")(lambda t: bridges.route_listing(_routes(t)))
query("resolved_event_constants", """
k AS (SELECT name AS constant, min(value) AS value FROM constants GROUP BY name HAVING count(DISTINCT value) = 1),
u AS (SELECT path, 'EVENT_' || (line % 30) || '_' || upper(substr(name, 1, 2)) AS name, line FROM emits )
SELECT path, coalesce(value, name) AS name, line, value IS NOT NULL AS resolved FROM u LEFT JOIN k ON k.constant = u.name""")(
    lambda t: bridges.resolved_constants(t.emits.select("path", F.concat(F.lit("EVENT_"), (F.col("line") % 30).cast("string"), F.lit("_"), F.upper(F.substring("name", 1, 2))).alias("name"), "line"), t.constants))
_RANK = "CASE source_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bridges.SOURCE_RANK.items()) + " ELSE 0 END"
query("env_truth", f"""
r AS (SELECT *, {_RANK} AS rk FROM env_declarations ),
o AS (SELECT *, row_number() OVER w AS place, lead(path) OVER w AS next_path, lead(age_days) OVER w AS next_age FROM r WINDOW w AS (PARTITION BY name ORDER BY rk DESC, path)),
s AS (SELECT name, count(*) AS sources, count(DISTINCT value_hash) AS hashes FROM env_declarations GROUP BY name)
SELECT o.name, path AS winner, source_kind AS kind, next_path, sources, hashes > 1 AS value_mismatch, coalesce(age_days - next_age >= 30, false) AS stale_overrides_fresh
FROM o JOIN s ON s.name = o.name WHERE place = 1""")(lambda t: bridges.env_truth(t.env_declarations))
query("env_orphans", """
d AS (SELECT DISTINCT name FROM env_declarations ), r AS (SELECT name, count(DISTINCT path) AS readers FROM env_reads GROUP BY name)
SELECT coalesce(d.name, r.name) AS name, CASE WHEN d.name IS NULL THEN 'orphan_read' ELSE 'orphan_declaration' END AS finding, coalesce(readers, 0)::BIGINT AS readers
FROM d FULL JOIN r ON d.name = r.name WHERE d.name IS NULL OR r.name IS NULL""")(lambda t: bridges.env_orphans(t.env_declarations, t.env_reads))
query("template_drift", """
r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, name, source_kind = 'dotenv' AS template FROM env_declarations ),
g AS (SELECT directory, name, bool_or(template) AS i, bool_or(NOT template) AS o FROM r GROUP BY ALL)
SELECT directory, name, CASE WHEN i THEN 'missing' ELSE 'extra' END AS drift FROM g WHERE i <> o AND directory IN (SELECT directory FROM r WHERE template)""")(
    lambda t: bridges.template_drift(t.env_declarations))

# Graph ------------------------------------------------------------------------------

_REVERSE = """
w AS (SELECT path AS source, path AS node, 0 AS depth FROM files UNION
  SELECT w.source, e.src, w.depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges ) e ON e.dst = w.node WHERE w.depth < 40),
r AS (SELECT source, node, min(depth) AS depth FROM w GROUP BY ALL)"""
_COUNTED = " SELECT source AS target, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 0) AS dependents, max(depth)::BIGINT AS deepest FROM r GROUP BY source"
query("impact_counts", _REVERSE + _COUNTED)(lambda t: graph.all_impact_counts(t.kept_edges(), t.files))
query("impact_chains", _REVERSE + """,
k AS (SELECT path AS source, path AS node, 0 AS depth, [path] AS chain FROM files UNION ALL
  SELECT k.source, e.src, k.depth + 1, list_append(k.chain, e.src) FROM k JOIN (SELECT DISTINCT src, dst FROM edges ) e ON e.dst = k.node
  JOIN r ON r.source = k.source AND r.node = e.src AND r.depth = k.depth + 1)
SELECT source AS target, node AS path, depth, array_to_string(min(chain), ' <- ') AS chain FROM k WHERE depth > 0 GROUP BY source, node, depth""")(
    lambda t: graph.impact(t.kept_edges(), t.files.select("path")))
query("slice_dependencies", """
w AS (SELECT path AS source, path AS node, 0 AS depth FROM files UNION SELECT w.source, e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 2),
r AS (SELECT source, node, min(depth) AS depth FROM w GROUP BY ALL)
SELECT source AS target, node AS path, depth, loc FROM r JOIN files ON files.path = node WHERE depth > 0""")(
    lambda t: graph.dependencies(t.kept_edges(), t.files.select("path"), t.files))
_CONSUMERS = """
b AS (SELECT DISTINCT src FROM edges WHERE label = 'reexport'),
w AS (SELECT path AS source, path AS node FROM files UNION
  SELECT w.source, e.src FROM w JOIN edges e ON e.dst = w.node WHERE w.node = w.source OR w.node IN (SELECT src FROM b))"""
query("slice_consumers", _CONSUMERS + " SELECT source AS target, node AS path FROM w WHERE node <> source")(lambda t: graph.consumers(t.kept_edges(), t.files.select("path")))
query("focus_directory", """
core AS (SELECT path FROM files WHERE path LIKE 'brand\\_12/tests/%' ESCAPE '\\'),
w AS (SELECT path AS node, 0 AS depth FROM core UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 2 AND e.dst NOT IN (SELECT path FROM core)),
r AS (SELECT node, min(depth) AS depth FROM w GROUP BY node)
SELECT path, 'core' AS layer, 0::BIGINT AS depth FROM core UNION ALL SELECT node, 'deps', depth::BIGINT FROM r WHERE depth > 0
UNION ALL SELECT DISTINCT src, 'consumers', 1::BIGINT FROM edges WHERE dst IN (SELECT path FROM core) AND src NOT IN (SELECT path FROM core)""")(
    lambda t: graph.focus(t.kept_edges(), t.files, "brand_12/tests"))
_WHO = """
x AS (SELECT DISTINCT src, dst FROM edges WHERE label = 'reexport'),
w AS (SELECT path AS source, path AS node FROM files UNION SELECT w.source, x.src FROM w JOIN x ON x.dst = w.node),
who AS (SELECT DISTINCT w.source AS target, e.src AS path FROM w JOIN edges e ON e.dst = w.node WHERE e.src <> w.source)"""
query("who_imports", _WHO + " SELECT * FROM who")(lambda t: graph.who_imports(t.kept_edges(), t.files.select("path")))
query("transitive_importers", _WHO + " SELECT target, count(*) AS importers FROM who GROUP BY target")(lambda t: graph.transitive_importers(t.kept_edges(), t.files))
query("blast_radius", _REVERSE.replace("FROM edges )", "FROM edges WHERE label IN ('import', 'reexport'))") + _COUNTED)(
    lambda t: graph.all_impact_counts(t.kept_edges().where("label IN ('import', 'reexport')"), t.files))
query("dynamic_reach", """
w AS (SELECT dst AS node, 0 AS depth FROM edges WHERE label = 'lazy_import' UNION SELECT e.dst, w.depth + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 30)
SELECT node AS path, min(depth)::BIGINT AS depth FROM w GROUP BY node""")(lambda t: graph.dynamic_reach(t.kept_edges()))
query("graph_components", """
u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges ),
w AS (SELECT path AS node, path AS seen FROM files UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen),
k AS (SELECT node, min(seen) AS component FROM w GROUP BY node)
SELECT component, count(*) AS files, sum(loc)::BIGINT AS loc FROM k JOIN files ON path = node GROUP BY component""")(lambda t: graph.components(t.files, t.edges))
_CLOSURE = """
x{0} AS (SELECT DISTINCT src, dst FROM edges WHERE {1} ),
w{0} AS (SELECT src AS a, dst AS b FROM x{0} UNION SELECT w{0}.a, x{0}.dst FROM w{0} JOIN x{0} ON x{0}.src = w{0}.b),
scc{0} AS (SELECT p.a AS path, min(p.b) AS component FROM w{0} p JOIN w{0} q ON q.a = p.b AND q.b = p.a GROUP BY p.a)"""
query("import_cycles", _CLOSURE.format("", "true") + " SELECT * FROM scc")(lambda t: graph.import_cycles(t.kept_edges()))
query("strict_cycles", _CLOSURE.format("", "label <> 'lazy_import'") + " SELECT * FROM scc")(lambda t: graph.import_cycles(t.kept_edges(), strict=True))
_CLASSES = """
yi AS (SELECT m.component, e.src, e.dst, e.label FROM edges e JOIN scc m ON m.path = e.src JOIN scc n ON n.path = e.dst AND n.component = m.component WHERE {0}),
yz AS (SELECT component, count(*) AS size, max(path) AS last, bool_and(contains(path, '/tests/')) AS fixture FROM scc GROUP BY component),
yd AS (SELECT component, path, sum(a)::BIGINT AS a, sum(o)::BIGINT AS o FROM (SELECT component, dst AS path, 1 AS a, 0 AS o FROM yi UNION ALL SELECT component, src, 0, 1 FROM yi) GROUP BY ALL),
yk AS (SELECT yz.component, size, fixture, bool_or(a >= size // 2 AND o <= 2) AS fan, bool_or(a >= 2 AND o <= 1) AS shared, last FROM yd JOIN yz ON yz.component = yd.component GROUP BY ALL),
ym AS (SELECT component, count(*) AS edges, bool_or(label = 'import') AS plain FROM yi GROUP BY component),
yc AS (SELECT yk.component, size, edges, fixture, shared, plain, CASE WHEN size >= 3 AND fan THEN 'fan_pattern' WHEN size >= 2 THEN 'hard_bidirectional' ELSE 'unknown' END AS kind FROM yk JOIN ym ON ym.component = yk.component),
classes AS (SELECT component, size, edges, kind, CASE kind WHEN 'fan_pattern' THEN 0 WHEN 'hard_bidirectional' THEN 3 ELSE 2 END AS severity,
  CASE WHEN kind = 'fan_pattern' OR kind = 'hard_bidirectional' AND NOT plain AND size >= 3 AND shared THEN 'diamond' ELSE 'structural' END AS compilability, fixture FROM yc)"""
query("classified_cycles", _CLOSURE.format("", "true") + "," + _CLASSES.format("true") + " SELECT *, CASE WHEN compilability = 'diamond' THEN 'none' WHEN size > 5 THEN 'medium' ELSE 'low' END AS risk FROM classes")(
    lambda t: graph.classified_cycles(t.kept_edges()))
query("lazy_cycles", _CLOSURE.format("", "true") + "," + _CLOSURE.format("2", "label <> 'lazy_import'") + """,
g AS (SELECT component, count(*) AS size FROM scc GROUP BY component), h AS (SELECT component, count(*) AS size FROM scc2 GROUP BY component)
SELECT * FROM g EXCEPT SELECT * FROM h""")(lambda t: graph.lazy_cycles(t.kept_edges()))
query("simple_cycles", _CLOSURE.format("", "true") + """,
s AS (SELECT DISTINCT e.src, e.dst, m.component FROM edges e JOIN scc m ON m.path = e.src JOIN scc n ON n.path = e.dst AND n.component = m.component),
c AS (SELECT component, src AS start, [src] AS cycle, dst AS last FROM s WHERE src <= dst UNION ALL
  SELECT c.component, c.start, list_append(c.cycle, c.last), s.dst FROM c JOIN s ON s.src = c.last WHERE c.last > c.start AND NOT list_contains(c.cycle, c.last)),
k AS (SELECT cycle, row_number() OVER (PARTITION BY component ORDER BY len(cycle), cycle) AS place FROM c WHERE last = start)
SELECT array_to_string(cycle, '>') AS cycle, len(cycle) AS length FROM k WHERE place <= 10""")(lambda t: graph.simple_cycles(t.kept_edges()))
query("refactor_plan", """
w AS (SELECT path AS source, path AS node FROM files UNION SELECT w.source, e.src FROM w JOIN edges e ON e.dst = w.node),
d AS (SELECT source, count(*) FILTER (node <> source) AS dependents FROM w GROUP BY source), k AS (SELECT dst, count(DISTINCT src) AS consumers FROM edges GROUP BY dst),
""" + _CLOSURE.format("3", "true").strip() + """,
r AS (SELECT f.path, f.loc, coalesce(consumers, 0)::BIGINT AS consumers, coalesce(dependents, 0)::BIGINT AS dependents, m.path IS NOT NULL AS cyclic
  FROM files f LEFT JOIN d ON d.source = f.path LEFT JOIN k ON k.dst = f.path LEFT JOIN scc3 m ON m.path = f.path),
q AS (SELECT *, CASE WHEN consumers > 20 OR loc > 500 AND cyclic THEN 'high' WHEN consumers > 5 OR loc > 500 OR cyclic THEN 'medium' ELSE 'low' END AS risk FROM r)
SELECT path, consumers, dependents, cyclic, consumers > 3 AS needs_shim, risk, CASE risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END::BIGINT AS phase FROM q""")(
    lambda t: graph.refactor_plan(t.files, t.kept_edges()))

# Differences, scopes and overlaps ----------------------------------------------------

_DIFF = """
changes AS (SELECT *, 'added' AS change FROM (SELECT * FROM edges_after EXCEPT SELECT * FROM edges_before ) UNION ALL
  SELECT *, 'removed' FROM (SELECT * FROM edges_before EXCEPT SELECT * FROM edges_after ))"""
_EDGE_KEY = ["src", "dst", "label"]
query("edge_diff", _DIFF + " SELECT * FROM changes")(lambda t: diff.set_diff(t.edges_before, t.edges_after, _EDGE_KEY))
query("change_summary", _DIFF + " SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, round(least(1.0, 0.05 * count(*) FILTER (change = 'removed'))::DOUBLE, 6) AS risk FROM changes")(
    lambda t: diff.change_summary(diff.set_diff(t.edges_before, t.edges_after, _EDGE_KEY)))
query("diff_impact", _DIFF + " SELECT DISTINCT src AS path FROM edges_after WHERE dst IN (SELECT src FROM changes)")(
    lambda t: diff.diff_impact(diff.set_diff(t.edges_before, t.edges_after, _EDGE_KEY), t.edges_after))
query("prism", """
p AS (SELECT 'before' AS task, src AS path FROM edges_before UNION SELECT 'after', src FROM edges_after UNION SELECT 'tests', path FROM files WHERE is_test),
g AS (SELECT path, count(DISTINCT task) AS n FROM p GROUP BY path)
SELECT count(*) AS union_files, count(*) FILTER (n = 3) AS shared_by_all, count(*) FILTER (n >= 2) AS shared FROM g""")(
    lambda t: diff.prism(t.edges_before.select(F.lit("before").alias("task"), F.col("src").alias("path")).union(t.edges_after.select(F.lit("after"), "src")).union(t.files.where("is_test").select(F.lit("tests"), "path"))))


def _rules(t: Tables) -> DataFrame:
    names = t.exports.where("line IS NULL").select(F.lit("dead").alias("kind"), F.col("name").alias("symbol"), "path")
    return names.union(t.exports.where("name LIKE 'red%'").select(F.lit("dead"), "name", F.lit(None).cast("string")).distinct())


query("suppressed_findings", _DEAD + """ SELECT 'dead' AS kind, name AS symbol, path FROM dead d WHERE name NOT LIKE 'red%'
  AND NOT EXISTS (SELECT 1 FROM exports x WHERE x.line IS NULL AND x.path = d.path AND x.name = d.name)""")(
    lambda t: diff.suppress(symbols.dead_exports(t.exports, t.imports).select(F.lit("dead").alias("kind"), F.col("name").alias("symbol"), "path"), _rules(t)))
query("scope_selection", """
s AS (SELECT path, 'path:brand_3/**/*.py' AS sel FROM files WHERE regexp_matches(path, '^brand_3/(.*/)?[^/]*[.]py$') UNION
  SELECT path, 'reach:blue ring' FROM exports WHERE name = 'blue ring')
SELECT path, string_agg(DISTINCT sel, ',' ORDER BY sel) AS selectors FROM s GROUP BY path""")(
    lambda t: diff.scope(t.files, t.edges, t.exports, globs=["brand_3/**/*.py"], reach=["blue ring"]))
query("changed_files", one("SELECT path, 'changed' AS state FROM files WHERE mtime % 7 = 0 AND id % 50 <> 49 UNION ALL SELECT path, 'gone' FROM files WHERE id % 50 = 49"))(
    lambda t: diff.changed_files(t.files, t.files.where("id % 50 <> 49").withColumn("mtime", F.when(F.col("mtime") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))))

# Coverage and health ------------------------------------------------------------------

query("covered_exports", one("""SELECT DISTINCT path, name FROM exports x WHERE NOT is_test AND EXISTS (SELECT 1 FROM imports i
  WHERE i.is_test AND i.resolved_path = x.path AND (i.name = x.name OR i.name = '*'))"""))(lambda t: coverage.covered_exports(t.exports, t.imports))
query("coverage_report", """
r AS (SELECT DISTINCT dir, path, name, EXISTS (SELECT 1 FROM imports i WHERE i.is_test AND i.resolved_path = x.path AND (i.name = x.name OR i.name = '*')) AS c FROM exports x WHERE NOT is_test)
SELECT dir, count(*) AS exports, count(*) FILTER (c) AS covered, round(100 * count(*) FILTER (c) / count(*), 6) AS percent FROM r GROUP BY dir""")(
    lambda t: coverage.coverage_report(t.exports, t.imports))
query("coverage_gaps", """
tested AS (SELECT DISTINCT name FROM imports WHERE is_test), used AS (SELECT name, count(DISTINCT path) AS users FROM imports WHERE NOT is_test AND name <> '*' GROUP BY name)
SELECT DISTINCT 'critical' AS severity, 'handler' AS kind, name AS target FROM handlers WHERE name IN (SELECT name FROM calls ) AND name NOT IN (SELECT name FROM tested)
UNION ALL SELECT DISTINCT 'medium', 'export', x.name FROM exports x JOIN used u ON u.name = x.name WHERE NOT x.is_test AND users >= 2 AND x.name NOT IN (SELECT name FROM tested)
UNION ALL SELECT DISTINCT 'low', 'export', name FROM exports WHERE NOT is_test AND name IN (SELECT name FROM tested) AND name NOT IN (SELECT name FROM used)""")(
    lambda t: coverage.coverage_gaps(t.exports, t.imports, t.handlers, t.calls))
query("insights", _BRIDGE + """,
k AS (SELECT 'huge_files' AS insight, count(*) AS n, 0 AS above FROM files WHERE loc > 2000 UNION ALL
  SELECT 'many_duplicates', count(*), 10 FROM (SELECT name FROM exports GROUP BY name HAVING count(DISTINCT path) > 1) UNION ALL
  SELECT 'many_cascades', count(*), 20 FROM (SELECT DISTINCT src, dst FROM edges WHERE label = 'reexport' AND dst IN (SELECT src FROM edges WHERE label = 'reexport')) UNION ALL
  SELECT 'missing_handlers', count(*), 0 FROM bridge WHERE status = 'missing')
SELECT insight, n FROM k WHERE n > above""")(
    lambda t: coverage.insights(t.files, symbols.duplicate_exports(t.exports), symbols.reexport_cascades(t.edges), bridges.command_bridges(t.calls, t.handlers)))


def _findings(t: Tables) -> DataFrame:
    twins = symbols.exact_twins(_signed(t), t.imports).where("class = 'EXACT'")
    return coverage.findings(symbols.dead_exports(t.exports, t.imports), symbols.orphan_files(t.files, t.edges), twins)


query("findings_by_kind", _DEAD + "," + _REGISTRY + """,
f AS (SELECT 'dead_export' AS kind, path AS target FROM dead UNION ALL SELECT 'orphan_file', path FROM files WHERE NOT is_test AND path NOT IN (SELECT dst FROM edges ))
SELECT kind, count(*) AS n, min(target) AS first FROM f GROUP BY kind""")(
    lambda t: _findings(t).where("kind <> 'twin'").groupBy("kind").agg(F.count("*").alias("n"), F.min("target").alias("first")))
query("sarif_results")(lambda t: coverage.sarif(_findings(t)))
query("quick_wins", _DEAD + """,
f AS (SELECT 'orphan_file' AS kind, path AS target FROM files WHERE NOT is_test AND path NOT IN (SELECT dst FROM edges ) UNION ALL SELECT DISTINCT 'dead_export', path FROM dead),
k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY target) AS n FROM f)
SELECT kind, target, (CASE kind WHEN 'dead_export' THEN 1000 ELSE 2000 END + n)::BIGINT AS priority FROM k WHERE n <= CASE kind WHEN 'dead_export' THEN 10 ELSE 15 END""")(
    lambda t: metrics.quick_wins(coverage.findings(symbols.dead_exports(t.exports, t.imports), symbols.orphan_files(t.files, t.edges), t.files.where("false").withColumn("class", F.lit(""))).select("kind", "target").distinct(), {"dead_export": 10, "orphan_file": 15}))

# Text ---------------------------------------------------------------------------------

NEEDLES = ["the", "der", "License"]
_LINES = "ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM texts )"
_COUNTS = " UNION ALL ".join(f"SELECT path, line, '{n}' AS term, len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: w = '{n}')) AS hits FROM ln WHERE contains(text, '{n}')" for n in NEEDLES)
query("literal_scan", _LINES + f", h AS ({_COUNTS}) SELECT path, line, term, hits FROM h WHERE hits > 0")(lambda t: search.literal_hits(t.texts, NEEDLES).drop("column"))
query("literal_rollup", _LINES + f", h AS ({_COUNTS}) SELECT path, term, count(*) AS lines, sum(hits)::BIGINT AS hits, min(line) AS first_line FROM h WHERE hits > 0 GROUP BY ALL")(
    lambda t: search.rollup(search.literal_hits(t.texts, NEEDLES)))
query("cross_match", _LINES + f", h AS ({_COUNTS}) SELECT path, count(DISTINCT term) AS terms, count(*) AS hits FROM h WHERE hits > 0 GROUP BY path HAVING terms >= 2")(
    lambda t: diff.cross_match(search.literal_hits(t.texts, NEEDLES)))
query("regex_scan", _LINES + " SELECT path, line, len(regexp_extract_all(text, '[0-9]{3,}')) AS hits FROM ln WHERE regexp_matches(text, '[0-9]{3,}')")(
    lambda t: search.regex_hits(t.texts, "[0-9]{3,}"))
query("search_universe", """
j AS (SELECT f.path, t.content FROM (SELECT path FROM texts UNION ALL SELECT path FROM files ) f LEFT JOIN texts t ON t.path = f.path)
SELECT CASE WHEN content IS NULL THEN 'no_text' ELSE 'scanned' END AS state, count(*) AS files FROM j GROUP BY 1""")(
    lambda t: search.universe(t.texts.select("path").union(t.files.select("path")), t.texts))
query("symbol_search", """
m AS (SELECT 'export' AS kind, name FROM exports UNION ALL SELECT 'import', name FROM imports UNION ALL SELECT 'handler', name FROM handlers )
SELECT kind, name, count(*) AS places FROM m WHERE regexp_matches(name, '(?i)ring|customer_1[0-9]$') GROUP BY ALL""")(
    lambda t: search.symbol_search("ring|customer_1[0-9]$", export=(t.exports, "name"), **{"import": (t.imports, "name")}, handler=(t.handlers, "name")))
query("fuzzy_names", """
s AS (SELECT DISTINCT name, round(1 - levenshtein(lower(name), 'blue widgit') / greatest(length(name), 11), 6) AS score FROM exports )
SELECT * FROM s WHERE score > 0.4 ORDER BY score DESC, name LIMIT 20""")(lambda t: search.fuzzy(t.exports, "blue widgit"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _inventory_sql(source: str, patterns: dict[str, str]) -> str:
    """Per kind, lines and files; RE2 has no look-around, so kinds are counted by what needs none."""
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS kind, path FROM ln WHERE regexp_matches(text, {_quoted(v)})" for k, v in patterns.items())
    return f"ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM {source}), k AS ({kinds}) SELECT kind, count(*) AS lines, count(DISTINCT path) AS files FROM k GROUP BY kind"


#: Directives in the data's own comments: every page's script lines, with what a checker would look for put behind some.
_MARKED = """pg AS (SELECT 'page/' || page_id AS path, string_split(html, chr(10)) AS w FROM pages),
mk AS (SELECT path, array_to_string(list_transform(w, lambda x, i: CASE i % 9 WHEN 1 THEN x || ' // eslint-disable-line' WHEN 2 THEN x || ' # noqa: E501' WHEN 3 THEN x || ' // @ts-ignore' WHEN 4 THEN x || ' # type: ignore[arg]'
  WHEN 5 THEN x || ' unsafe {' WHEN 6 THEN x || ' setInterval(f)' WHEN 7 THEN x || ' : any' ELSE x END), chr(10)) AS content FROM pg), """


def _marked(t: Tables) -> DataFrame:
    marks = {1: " // eslint-disable-line", 2: " # noqa: E501", 3: " // @ts-ignore", 4: " # type: ignore[arg]", 5: " unsafe {", 6: " setInterval(f)", 7: " : any"}

    def marked(x, i):
        out = F.when((i + 1) % 9 == 0, x)
        for k, mark in marks.items():
            out = out.when((i + 1) % 9 == k, F.concat(x, F.lit(mark)))
        return out.otherwise(x)

    return t.raw("pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.array_join(F.transform(F.split("html", "\n"), marked), "\n").alias("content"))


_PAGES = "pg AS (SELECT 'page/' || page_id AS path, html AS content FROM pages), "


def _pages(t: Tables) -> DataFrame:
    return t.raw("pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))


_PLAIN_SILENCERS = {k: v for k, v in search.SILENCERS.items() if "(?!" not in v} | {"unsafe": r"\bunsafe\s*\{"}
query("silencer_inventory", _MARKED + _inventory_sql("mk", _PLAIN_SILENCERS))(lambda t: search.inventory(_marked(t), search.SILENCERS))
query("style_map", _PAGES + r"""
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM pg),
d AS (SELECT path, line, unnest(regexp_extract_all(text, '(?i)(z-index|position|display)\s*:\s*([^;}"''<]+)')) AS declared FROM ln)
SELECT lower(regexp_extract(declared, '(?i)(z-index|position|display)', 1)) AS property, trim(regexp_extract(declared, ':\s*([^;}"''<]+)', 1)) AS value, count(*) AS n, count(DISTINCT path) AS files FROM d GROUP BY ALL""")(
    lambda t: search.styles(_pages(t)).groupBy("property", "value").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")))
_PLAIN_LINTS = search.LINTS | {"mem/global-interval": r"(^|[^=\s]|[^=]\s)setInterval\s*\("}
query("script_lints", _MARKED + _inventory_sql("mk", _PLAIN_LINTS))(lambda t: search.inventory(_marked(t), search.LINTS))
query("page_links", one("""SELECT target, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target"""))(
    lambda t: search.links(t.raw("pages")))

# Paths, sources and streams -------------------------------------------------------------


def _crawled(t: Tables) -> DataFrame:
    """Page addresses as paths: what follows the host, with the page number as a name."""
    path = F.concat(F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), "/$", ""), F.lit("/page_"), F.col("page_id").cast("string"), F.lit(".html"))
    return t.raw("pages").select(path.alias("path"), F.col("html").alias("content"))


_CRAWLED = r"""pg AS (SELECT regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '') || '/page_' || page_id || '.html' AS path, html AS content FROM pages),
"""
query("module_keys", one(f"SELECT path, {_KEY.format('path')} AS module FROM files WHERE language <> 'go' UNION ALL SELECT path, path || ':' FROM files WHERE language = 'go'"))(
    lambda t: t.files.select("path", paths.module_key(F.col("path")).alias("module")))
query("file_classes", """
k AS (SELECT CASE WHEN path LIKE '%/tests/%' THEN true ELSE false END AS test, CASE WHEN language IN ('ts', 'tsx', 'py', 'rs', 'go') THEN 'code' ELSE 'style' END AS kind, loc FROM files )
SELECT test, kind, 'product' AS artifact, count(*) AS files, sum(loc)::BIGINT AS loc FROM k GROUP BY ALL""")(
    lambda t: t.files.groupBy(paths.is_test_path(F.col("path")).alias("test"), paths.file_kind(F.col("path")).alias("kind"), paths.artifact_class(F.col("path")).alias("artifact")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc")))
query("path_suffix_matches", """
s AS (SELECT path, regexp_extract(path, '[^/]*$') AS tail FROM files UNION SELECT path, 'tests/' || regexp_extract(path, '[^/]*$') FROM files WHERE is_test UNION SELECT path, path FROM files )
SELECT tail, count(*) AS files, min(path) AS first FROM s GROUP BY tail""")(
    lambda t: t.files.select("path", F.explode(paths.suffixes(F.col("path"))).alias("tail")).groupBy("tail").agg(F.count("*").alias("files"), F.min("path").alias("first")))
query("extracted_page_links", _CRAWLED + """
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM pg WHERE content IS NOT NULL),
l AS (SELECT path, regexp_extract(text, '<a\\s[^>]*href=[''"]([^''"#]+)[''"]', 1) AS name FROM ln WHERE regexp_matches(text, '<a\\s[^>]*href=[''"]([^''"#]+)[''"]'))
SELECT name, count(*) AS n, count(DISTINCT path) AS files FROM l GROUP BY name""")(
    lambda t: extract.extract(_crawled(t)).where("kind = 'link'").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files")))
query("page_file_table", _CRAWLED + """
k AS (SELECT *, split_part(path, '/', 1) AS top FROM pg)
SELECT top, count(*) AS files, sum(len(string_split(content, chr(10))))::BIGINT AS loc, count(DISTINCT sha256(content)) AS contents FROM k GROUP BY top""")(
    lambda t: extract.file_table(_crawled(t)).groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.count_distinct("fingerprint").alias("contents")))
query("stream_newest_states", one("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"))(
    lambda t: patch.replay(t.spark, t.sf_dir, "events", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type"))
query("debounced_changes", """
e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT 'unit_' || user_id AS path, min(ts) AS first_change, max(ts) + INTERVAL 30 MINUTE AS quiet_at, count(*) AS changes FROM g GROUP BY user_id, burst""")(
    lambda t: patch.debounced(t.raw("events").select(F.concat(F.lit("unit_"), F.col("user_id").cast("string")).alias("path"), "ts")))
query("json_paths", one("SELECT (props ->> '$.k')::BIGINT AS k, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE (props ->> '$.k')::BIGINT % 2 = 0 GROUP BY ALL"))(
    lambda t: t.raw("events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", "value").where("k % 2 = 0").groupBy("k", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
query("table_fingerprint")(lambda t: diff.fingerprint(t.edges))
query("context_pack", _INCOMING + """,
h AS (SELECT path, row_number() OVER (ORDER BY importers_direct DESC, import_edges DESC, path) AS place FROM incoming WHERE importers_direct > 0),
s AS (SELECT 'hub' AS slice, path AS item FROM h WHERE place <= 5 UNION ALL
  SELECT DISTINCT 'needs', dst FROM edges WHERE src IN (SELECT path FROM h WHERE place <= 5) UNION ALL
  SELECT DISTINCT 'used_by', src FROM edges WHERE dst IN (SELECT path FROM h WHERE place <= 5))
SELECT slice, item FROM s""")(lambda t: _context_pack(t))


def _context_pack(t: Tables) -> DataFrame:
    edges = t.kept_edges()
    hubs = materialize(metrics.top_hubs(t.files, edges, 5).select("path"), "hubs")
    seed = hubs.select(F.col("path").alias("src"))
    rows = hubs.select(F.lit("hub").alias("slice"), F.col("path").alias("item"))
    rows = rows.union(edges.join(seed, "src", "left_semi").select(F.lit("needs"), "dst").distinct())
    return rows.union(edges.join(seed.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.lit("used_by"), "src").distinct())


# Bindings, cross-checks and tags ----------------------------------------------------------


def _scoped_uses(t: Tables) -> DataFrame:
    return t.imports.where("name <> '*'").select("path", F.substring_index("path", "/", 1).alias("dir"), "name").distinct()


query("bound_symbols", """
u AS (SELECT DISTINCT path, split_part(path, '/', 1) AS dir, name FROM imports WHERE name <> '*'),
n AS (SELECT dir, name, min(path) AS target FROM exports GROUP BY ALL HAVING count(DISTINCT path) = 1), a AS (SELECT name, min(path) AS target FROM exports GROUP BY ALL HAVING count(DISTINCT path) = 1)
SELECT u.path, u.name, coalesce(n.target, a.target) AS target, CASE WHEN n.target IS NOT NULL THEN 'directory' WHEN a.target IS NOT NULL THEN 'anywhere' ELSE 'unbound' END AS scope
FROM u LEFT JOIN n ON n.dir = u.dir AND n.name = u.name LEFT JOIN a ON a.name = u.name""")(lambda t: facts.bind_symbols(_scoped_uses(t), t.exports))


def _benchmark_words(t: Tables) -> DataFrame:
    words = t.raw("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    return words.where(F.length("name") > 6).distinct().withColumn("path", F.lit(None).cast("string"))


query("token_cross_check", """
c AS (SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM benchmark) WHERE length(name) > 6),
k AS (SELECT path, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM texts ),
h AS (SELECT name, count(*) AS hits, count(DISTINCT path) AS files FROM k WHERE name IN (SELECT name FROM c) GROUP BY name)
SELECT c.name, coalesce(hits, 0)::BIGINT AS hits, coalesce(files, 0)::BIGINT AS files, coalesce(files, 0) > 0 AS degraded FROM c LEFT JOIN h ON h.name = c.name""")(
    lambda t: facts.cross_check(_benchmark_words(t), t.texts))
query("opaque_types", one("""SELECT path, name FROM exports WHERE kind = 'class' AND path IN (SELECT dst FROM edges WHERE label = 'reexport')
  AND path NOT IN (SELECT dst FROM edges WHERE label <> 'reexport')"""))(lambda t: facts.opaque_types(t.exports, t.edges))
query("component_of", one("SELECT DISTINCT dst AS target, src AS path, CASE WHEN label = 'reexport' THEN 'barrel' ELSE 'parent' END AS role FROM edges WHERE dst IN (SELECT path FROM files WHERE is_test)"))(
    lambda t: facts.component_of(t.edges, t.files.where("is_test")))
query("cyclic_subset", _CLOSURE.format("", "NOT contains(src, '/tests/') AND NOT contains(dst, '/tests/')") + " SELECT * FROM scc")(
    lambda t: facts.cyclic_subset(t.kept_edges(), t.files.where("NOT is_test")))
query("symbol_anchors", one("SELECT DISTINCT path, name, substr(sha256(path), 1, 12) AS file_anchor, substr(sha256(path || '::' || name), 1, 12) AS anchor FROM exports"))(
    lambda t: facts.anchors(t.exports))
query("symbol_changes", """
a AS (SELECT path, name, min(line) AS l FROM exports WHERE dir <> 'brand_3' GROUP BY ALL), b AS (SELECT path, name, min(line + CASE WHEN line % 2 = 0 THEN 1 ELSE 0 END) AS l FROM exports WHERE dir <> 'brand_4' GROUP BY ALL),
k AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.name, b.name) AS name, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.l IS DISTINCT FROM b.l THEN 'changed' END AS change
  FROM a FULL JOIN b ON a.path = b.path AND a.name = b.name)
SELECT * FROM k WHERE change IS NOT NULL""")(
    lambda t: facts.symbol_changes(t.exports.where("dir <> 'brand_3'"), t.exports.where("dir <> 'brand_4'").withColumn("line", F.col("line") + F.when(F.col("line") % 2 == 0, 1).otherwise(0))))
query("renamed_files", """
f AS (SELECT path, CAST(loc AS VARCHAR) || dir AS fp, id FROM files ),
g AS (SELECT fp, min(path) AS old_path FROM f WHERE id % 9 = 0 GROUP BY fp HAVING count(*) = 1), n AS (SELECT fp, min('moved/' || path) AS new_path FROM f WHERE id % 9 = 0 GROUP BY fp HAVING count(*) = 1)
SELECT old_path, new_path FROM g JOIN n ON g.fp = n.fp""")(lambda t: facts.renames(*_moved(t)))


def _moved(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = t.files.select("path", F.concat(F.col("loc").cast("string"), "dir").alias("fingerprint"), "id")
    path = F.when(F.col("id") % 9 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return before.drop("id"), before.withColumn("path", path).drop("id")


_TAG = "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p_}') THEN '{k}'" for k, (c, p_) in facts.IDIOMS.items()) + " END"
query("idiom_tags", one(f"SELECT DISTINCT path, name, {_TAG} AS tag FROM exports WHERE {_TAG} IS NOT NULL"))(lambda t: facts.idiom_tags(t.exports))
query("dead_exports_less_idioms", _DEAD + f" SELECT * FROM dead WHERE coalesce({_TAG}, '') NOT IN ('style')")(
    lambda t: facts.suppressed_by_idiom(symbols.dead_exports(t.exports, t.imports), facts.idiom_tags(t.exports), ("style",)))
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{v.replace('{}', 'track').replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, v in facts.ROLES.items()) + " ELSE 'reference' END"
query("occurrence_roles", _PAGES + f"""
ln AS (SELECT path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM pg)
SELECT path, line, {_ROLE} AS role FROM ln WHERE regexp_matches(text, '\\btrack\\b')""")(lambda t: facts.occurrence_roles(_pages(t), "track"))
query("entrypoint_drift", """
d AS (SELECT path FROM files WHERE id % 5 = 0 UNION ALL SELECT 'gone/' || path FROM files WHERE id % 70 = 0), k AS (SELECT DISTINCT src AS path FROM edges WHERE src NOT IN (SELECT dst FROM edges ))
SELECT path, 'unresolved' AS drift FROM d WHERE path NOT IN (SELECT path FROM files ) UNION
SELECT path, 'declared_only' FROM d WHERE path IN (SELECT path FROM files ) AND path NOT IN (SELECT path FROM k) UNION SELECT path, 'detected_only' FROM k WHERE path NOT IN (SELECT path FROM d)""")(
    lambda t: facts.entrypoint_drift(*_entrypoints(t), t.files.select("path")))


def _entrypoints(t: Tables) -> tuple[DataFrame, DataFrame]:
    declared = t.files.where("id % 5 = 0").select("path").union(t.files.where("id % 70 = 0").select(F.concat(F.lit("gone/"), "path")))
    edges = t.edges
    return declared, edges.select(F.col("src").alias("path")).distinct().join(edges.select(F.col("dst").alias("path")), "path", "left_anti")


query("answer_receipt")(lambda t: facts.receipt(symbols.dead_exports(t.exports, t.imports), t.files))
