"""The code-graph tables, projected from the star-schema tables.

Each table is one SELECT that Spark SQL and other SQL engines read alike. Input
tables are named in braces; ``project`` binds them to DataFrames.

files    a part; directory = brand, language = type, loc = 20 x size
edges    parts of one brand in successive lines of an order; label by return flag
exports  a part exports its name; imports follow edges
calls    orders call the command of their customer; handlers are customers
emits    events of a value of at least 25, listens: the others; name from type and key
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.plans.storage import table

# The file extension that stands for each part type.
EXTENSIONS = {"ECONOMY": ".ts", "MEDIUM": ".tsx", "PROMO": ".py", "LARGE": ".rs", "SMALL": ".css", "STANDARD": ".go"}
_EXTENSION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items())

FILES = f"""
SELECT p_partkey AS id,
       concat(lower(replace(p_brand, '#', '_')), CASE WHEN p_partkey % 10 = 0 THEN '/tests/' ELSE '/' END,
              replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), CASE p_type {_EXTENSION} END) AS path,
       lower(replace(p_brand, '#', '_')) AS dir, p_name AS name, substr(CASE p_type {_EXTENSION} END, 2) AS language,
       CAST(p_size * 20 AS BIGINT) AS loc, p_partkey % 10 = 0 AS is_test, CAST(p_partkey % 97 AS BIGINT) AS mtime
FROM {{part}}"""

SUCCESSION = """
SELECT DISTINCT a.l_partkey AS src_id, b.l_partkey AS dst_id,
       CASE a.l_returnflag WHEN 'A' THEN 'reexport' WHEN 'R' THEN 'lazy_import' ELSE 'import' END AS label,
       a.l_linestatus AS half
FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey"""

#: Successions within a brand; a table of its own, which edges and imports are made of.
LINKS = f"""
SELECT e.src_id, e.dst_id, e.label, e.half FROM ({SUCCESSION}) e JOIN {{part}} s ON e.src_id = s.p_partkey JOIN {{part}} d ON e.dst_id = d.p_partkey
WHERE s.p_brand = d.p_brand"""

_EDGES = f"FROM {{links}} e JOIN ({FILES}) s ON e.src_id = s.id JOIN ({FILES}) d ON e.dst_id = d.id"

EDGES = f"SELECT DISTINCT s.path AS src, d.path AS dst, e.label AS label {_EDGES}"
#: Two snapshots of the edges.
EDGES_BEFORE = EDGES + " WHERE e.half = 'F'"
EDGES_AFTER = EDGES + " WHERE e.half = 'O'"

EXPORTS = f"""
SELECT path, name, CASE WHEN language IN ('ts', 'py') THEN 'function' WHEN language IN ('tsx', 'rs') THEN 'class' ELSE 'const' END AS kind,
       CASE WHEN mtime % 5 = 0 THEN NULL ELSE mtime END AS line, dir, language, is_test
FROM ({FILES}) f"""

IMPORTS = f"""
SELECT DISTINCT s.path AS path, d.path AS resolved_path, CASE WHEN e.label = 'lazy_import' THEN '*' ELSE d.name END AS name,
       concat('./', replace(d.name, ' ', '_')) AS source, e.label AS label, s.is_test AS is_test {_EDGES}"""

#: Exports and imports by names of which most belong to one file.
OWN_EXPORTS = f"""
SELECT path, concat(name, ' ', CAST(id % 400 AS STRING)) AS name, CASE WHEN language IN ('ts', 'py') THEN 'function' ELSE 'class' END AS kind, mtime AS line, id, dir, language, is_test
FROM ({FILES}) f"""
OWN_IMPORTS = f"""
SELECT DISTINCT s.path AS path, d.path AS resolved_path, CASE WHEN e.label = 'lazy_import' THEN '*' ELSE concat(d.name, ' ', CAST(d.id % 400 AS STRING)) END AS name {_EDGES}"""

CALLS = """
SELECT concat('view_', CAST(o_orderkey % 211 AS STRING), '.ts') AS path, concat('getCustomer', CAST(o_custkey % 900 AS STRING)) AS name,
       o_orderkey AS line
FROM {orders}"""

HANDLERS = """
SELECT concat('api_', CAST(c_nationkey AS STRING), '.rs') AS path, concat('get_customer_', CAST(c_custkey % 1100 AS STRING)) AS name,
       c_custkey AS line, c_acctbal >= 0 AS registered
FROM {customer}"""

_EVENT = """
SELECT concat('unit_', CAST(user_id AS STRING), CASE WHEN user_id % 3 = 0 THEN '.py' ELSE '.ts' END) AS path,
       concat(event_type, ':', regexp_extract(props, '([0-9]+)', 1)) AS name, event_id AS line, value % 2 < 1 AS awaited
FROM {events}"""
EMITS = _EVENT + " WHERE value >= 25"
LISTENS = _EVENT + " WHERE value < 25"

ENV_DECLARATIONS = """
SELECT concat('VAR_', CAST(s_suppkey % 61 AS STRING)) AS name, CASE s_nationkey % 5 WHEN 0 THEN 'dotenv' WHEN 1 THEN 'docker_compose'
       WHEN 2 THEN 'k8s_config_map' WHEN 3 THEN 'dockerfile' ELSE 'sealed_secret' END AS source_kind,
       concat('deploy/', CAST(s_nationkey AS STRING), '/', s_name) AS path, CAST(floor(s_acctbal) AS BIGINT) % 17 AS value_hash,
       s_suppkey % 400 AS age_days
FROM {supplier}"""

ENV_READS = """
SELECT DISTINCT concat('VAR_', regexp_extract(props, '([0-9]+)', 1)) AS name, concat('unit_', CAST(user_id AS STRING), '.ts') AS path
FROM {events}"""

TEXTS = "SELECT concat('doc/', source, '/', CAST(doc_id AS STRING), '.txt') AS path, text AS content, lang FROM {documents}"

#: Names that a file uses itself, constants with values, and files that are run by themselves.
LOCAL_USES = f"SELECT path, name FROM ({FILES}) f WHERE id % 23 = 0"
CONSTANTS = """
SELECT concat('EVENT_', CAST(c_nationkey AS STRING), '_', substr(c_mktsegment, 1, 2)) AS name, lower(c_mktsegment) AS value FROM {customer}"""
ENTRY_POINTS = f"SELECT path FROM ({FILES}) f WHERE id % 41 = 0"
SYMBOLS = f"""
SELECT path || '::' || name AS id, path, name, id AS start_line, id + loc AS end_line FROM ({FILES}) f"""
SYMBOL_EDGES = f"""
SELECT DISTINCT s.path || '::' || s.name AS src, d.path || '::' || d.name AS dst, CASE WHEN e.half = 'F' THEN 'calls' ELSE 'uses' END AS kind {_EDGES}"""
SYMBOL_USES = f"SELECT DISTINCT d.path AS owner, d.name AS name, s.path AS path {_EDGES} WHERE e.label <> 'lazy_import'"

INPUTS = ("part", "lineitem", "orders", "customer", "supplier", "events", "documents", "pages")


def brand_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of LINKS, found by brand: lines learn their part's brand first, so that only lines of one order and brand meet.

    LINKS makes all successions first and drops 24 of 25 after two more joins. Lines go through two shuffles here; an
    order may have a line number more than once. Rows differ from each other.
    """
    label = F.when(F.col("l_returnflag") == "A", "reexport").when(F.col("l_returnflag") == "R", "lazy_import").otherwise("import")
    brands = table(spark, sf_dir, "part").where("p_brand IS NOT NULL").select(F.col("p_partkey").alias("l_partkey"), "p_brand").distinct()
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", label.alias("label"), F.col("l_linestatus").alias("half")).join(brands.hint("shuffle_hash"), "l_partkey")
    order = Window.partitionBy("l_orderkey", "p_brand").orderBy("l_linenumber")
    several = lines.withColumn("n", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("n > 1")
    following = several.withColumn("next", F.collect_set("l_partkey").over(order.rangeBetween(1, 1)))
    return following.withColumn("dst_id", F.explode("next")).where("l_partkey <> dst_id").select(F.col("l_partkey").alias("src_id"), "dst_id", "label", "half").distinct()


def project(spark: SparkSession, sf_dir: str, select: str, links: DataFrame | None = None) -> DataFrame:
    """A projected table over the Parquet tables of a directory; links: the table of that name, if it is already there."""
    used = {name: table(spark, sf_dir, name) for name in INPUTS if f"{{{name}}}" in select}
    if "{links}" in select:
        used["links"] = brand_links(spark, sf_dir) if links is None else links
    return spark.sql(select, **used)


def plain(select: str) -> str:
    """The SELECT with the input tables under their own names."""
    for name in (*INPUTS, "links"):
        select = select.replace(f"{{{name}}}", name)
    return select
