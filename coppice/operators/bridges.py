"""Calls and handlers, emits and listens, and the health of what connects them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.names import command_key, event_key
from coppice.functions.paths import basename, is_template, is_test_path


def command_bridges(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """Full outer join of calls and registered handlers on the normalised command name."""
    called = calls.where(~F.contains("name", F.lit("."))).groupBy(command_key(F.col("name")).alias("command")).agg(F.count("*").alias("calls"), F.min("name").alias("call_name"))
    handled = handlers.where("registered").groupBy(command_key(F.col("name")).alias("command")).agg(F.count("*").alias("handlers"), F.min("name").alias("handler_name"), F.min("path").alias("handler_path"))
    joined = called.join(handled, "command", "full_outer").na.fill(0, ["calls", "handlers"])
    status = F.when(F.col("handlers") == 0, "missing").when(F.col("calls") == 0, "unused").otherwise("connected")
    return joined.select("command", F.coalesce("handler_name", "call_name").alias("name"), "calls", "handlers", "handler_path", status.alias("status"))


def unregistered_handlers(handlers: DataFrame) -> DataFrame:
    """Commands of which no implementation is registered."""
    grouped = handlers.groupBy(command_key(F.col("name")).alias("command")).agg(F.bool_or("registered").alias("registered"), F.count("*").alias("handlers"))
    return grouped.where("NOT registered").select("command", "handlers")


def trace_handler(calls: DataFrame, handlers: DataFrame, names: list[str]) -> DataFrame:
    """Verdict on each asked name, in whatever case style: CONNECTED, UNUSED, MISSING or NOT FOUND."""
    asked = calls.sparkSession.createDataFrame([(n,) for n in names], "asked string").withColumn("command", command_key(F.col("asked")))
    bridge = command_bridges(calls, handlers).select("command", "status")
    verdict = F.when(F.col("status") == "connected", "CONNECTED").when(F.col("status") == "unused", "UNUSED").when(F.col("status") == "missing", "MISSING").otherwise("NOT FOUND")
    return asked.join(bridge, "command", "left").select("asked", verdict.alias("verdict"))


def event_bridges(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Full outer join on the event name: counts, whether all sides are script files, whether a file is on both sides."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        script = F.col("path").rlike(r"\.(ts|tsx|js|jsx)$")
        return rows.groupBy(F.col("name").alias("event")).agg(F.count("*").alias(name), F.bool_and(script).alias(f"{name}_script"))

    both = emits.select(F.col("name").alias("event"), "path").distinct().join(listens.select(F.col("name").alias("event"), "path").distinct(), ["event", "path"], "left_semi")
    same = both.select("event").distinct().withColumn("same_file", F.lit(True))
    joined = side(emits, "emits").join(side(listens, "listens"), "event", "full_outer").join(same, "event", "left")
    sync = F.coalesce(F.col("emits_script") & F.col("listens_script"), F.lit(False))
    return joined.select(
        "event", F.coalesce("emits", F.lit(0)).cast("long").alias("emits"), F.coalesce("listens", F.lit(0)).cast("long").alias("listens"),
        sync.alias("is_fe_sync"), F.coalesce("same_file", F.lit(False)).alias("same_file_sync"),
    )


def pipelines(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Status of every event by its normalised name: ok, ghost (emitted only) or orphan (listened to only)."""
    e = emits.groupBy(event_key(F.col("name")).alias("event")).agg(F.count("*").alias("emits"))
    listened = listens.groupBy(event_key(F.col("name")).alias("event")).agg(F.count("*").alias("listens"), F.count(F.when(~F.col("awaited"), 1)).alias("not_awaited"))
    rows = e.join(listened, "event", "full_outer").na.fill(0)
    status = F.when(F.col("listens") == 0, "ghost").when(F.col("emits") == 0, "orphan").otherwise("ok")
    return rows.withColumn("status", status)


def emits_before_listens(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Per file and event on both sides: first emit and first listen, where the emit comes first."""
    first = lambda rows, name: rows.groupBy("path", "name").agg(F.min("line").alias(name))
    return first(emits, "first_emit").join(first(listens, "first_listen"), ["path", "name"]).where("first_emit < first_listen")


def wildcard_events(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Event names with `*` on both sides that are one pattern: equal parts between the stars, or equal names.

    Equality of the split parts makes it an equi-join; the smallest spelling stands for a pattern.
    """
    key = event_key(F.col("name"))
    side = lambda rows, name: rows.where(F.contains("name", F.lit("*"))).select(key.alias("spelled")).groupBy(F.split("spelled", r"\*").alias("parts")).agg(F.count("*").alias(name), F.min("spelled").alias(f"{name}_as"))
    joined = side(emits, "emits").join(side(listens, "listens"), "parts")
    return joined.select(F.least("emits_as", "listens_as").alias("pattern"), "emits", "listens")


def matching_events(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Plain emitted names that a listened-to pattern of one star matches: prefix and suffix around it.

    A name meets patterns through its prefixes only, by equality, so no pair is tried in vain.
    """
    plain = emits.where(~F.contains("name", F.lit("*"))).groupBy(event_key(F.col("name")).alias("event")).agg(F.count("*").alias("emits"))
    patterns = listens.where(F.regexp_count("name", F.lit(r"\*")) == 1).groupBy(event_key(F.col("name")).alias("pattern")).agg(F.count("*").alias("listens"))
    patterns = patterns.select("pattern", "listens", F.substring_index("pattern", "*", 1).alias("head"), F.substring_index("pattern", "*", -1).alias("tail"))
    cut = F.explode(F.sequence(F.lit(0), F.length("event")))
    heads = plain.select("event", "emits", cut.alias("n")).withColumn("head", F.substring("event", F.lit(1), F.col("n")))
    rows = heads.join(patterns, "head").where(F.endswith("event", F.col("tail")) & (F.length("event") >= F.length("head") + F.length("tail")))
    return rows.select("pattern", "event", "emits", "listens")


def handler_chains(calls: DataFrame, handlers: DataFrame, emits: DataFrame) -> DataFrame:
    """Per command: its calls, handlers, the handler's file and the number of events which that file emits."""
    called = calls.where(~F.contains("name", F.lit("."))).groupBy(command_key(F.col("name")).alias("command")).agg(F.count("*").alias("calls"))
    handled = handlers.select(command_key(F.col("name")).alias("command"), "path").distinct()
    emitted = emits.groupBy("path").agg(F.count_distinct(event_key(F.col("name"))).alias("events"))
    rows = handled.join(emitted, "path", "left").groupBy("command").agg(
        F.count("*").alias("handlers"), F.min("path").alias("handler_path"), F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("emitted_events")
    )
    joined = called.join(rows, "command", "full_outer").na.fill(0, ["calls", "handlers", "emitted_events"])
    status = F.when(F.col("handlers") == 0, "missing").when(F.col("calls") == 0, "unused").otherwise("ok")
    return joined.select("command", "calls", "handlers", "handler_path", "emitted_events", status.alias("status"))


def command_listing(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """Commands with their calling files and handling files, test files counted apart."""
    row = lambda df, side: df.select(command_key(F.col("name")).alias("command"), "path", F.lit(side).alias("side"), is_test_path(F.col("path")).alias("test"))
    rows = row(calls, "call").unionByName(row(handlers, "handler")).distinct()
    n = lambda side, test: F.count(F.when((F.col("side") == side) & (F.col("test") == test), 1))
    return rows.groupBy("command").agg(n("call", False).alias("calling_files"), n("handler", False).alias("handling_files"), (n("call", True) + n("handler", True)).alias("test_files"))


def event_listing(emits: DataFrame, listens: DataFrame) -> DataFrame:
    """Events with emitting and listening files and whether any listener is awaited."""
    row = lambda df, side: df.select(event_key(F.col("name")).alias("event"), "path", F.lit(side).alias("side"), "awaited")
    rows = row(emits, "emit").unionByName(row(listens, "listen"))
    files = lambda side: F.count_distinct(F.when(F.col("side") == side, F.col("path")))
    awaited = F.coalesce(F.bool_or(F.when(F.col("side") == "listen", F.col("awaited"))), F.lit(False))
    return rows.groupBy("event").agg(files("emit").alias("emitting_files"), files("listen").alias("listening_files"), awaited.alias("awaited"))


def route_listing(routes: DataFrame) -> DataFrame:
    """Routes by framework and path with their methods and files."""
    rows = routes.select("framework", F.upper(F.trim("method")).alias("method"), F.trim("route_path").alias("route_path"), "path")
    return rows.groupBy("framework", "route_path").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"), F.count_distinct("path").alias("files"))


def resolved_constants(names: DataFrame, constants: DataFrame) -> DataFrame:
    """(path, name, line) uses with constant names replaced by the value that exactly one file exports for them."""
    known = constants.groupBy(F.col("name").alias("constant")).agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").drop("n")
    return names.join(known, F.col("name") == F.col("constant"), "left").select("path", F.coalesce("value", "name").alias("name"), "line", F.col("value").isNotNull().alias("resolved"))


# Which source of an environment variable overrides which; more wins.
SOURCE_RANK = {
    "sealed_secret": 100, "external_secret": 95, "k8s_secret_string_data": 92, "k8s_secret": 90, "k8s_deployment_env": 85, "k8s_deployment_env_from": 82,
    "k8s_config_map": 80, "sops_file": 78, "helm_values": 65, "docker_compose": 50, "docker_compose_env_file": 45, "dockerfile": 40, "npm_script": 35,
    "dotenv": 30, "github_actions_secret": 20, "github_actions_env": 15, "tauri_conf": 12, "envrc": 8,
}


# What the name of a dotenv file adds to its rank; the first that holds.
DOTENV_RANKS = {r"production|\.prod": 8, r"staging|\.stage": 4, r"\.local": -5, r"\.test|\.dev": -8}


def _ranked(declarations: DataFrame) -> DataFrame:
    """Declarations with their rank; of dotenv files the name tells more. Templates show a shape and are no source."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv]), F.col("source_kind")), F.lit(0))
    file, more = F.lower(basename(F.col("path"))), F.lit(0)
    for pattern, by in reversed(DOTENV_RANKS.items()):
        more = F.when(file.rlike(pattern), by).otherwise(more)
    live = declarations.where(~F.coalesce(is_template(F.col("path")), F.lit(False)))
    return live.withColumn("rank", rank + F.when(F.col("source_kind") == "dotenv", more).otherwise(0))


def env_truth(declarations: DataFrame, stale_days: int = 30) -> DataFrame:
    """Per variable: the source that wins, the next one, and whether values differ or an old one overrides a fresh one."""
    key = F.struct((-F.col("rank")).alias("o"), "path", "source_kind", "age_days")
    rows = _ranked(declarations).select("name", key.alias("k"))
    best = rows.groupBy("name").agg(F.min("k").alias("w"))
    second = rows.join(best, "name").where("k > w").groupBy("name").agg(F.min("k").alias("x"))
    spread = _ranked(declarations).groupBy("name").agg(F.count("*").alias("sources"), F.count_distinct("value_hash").alias("hashes"))
    stale = F.coalesce(F.col("w.age_days") - F.col("x.age_days") >= stale_days, F.lit(False))
    return best.join(second, "name", "left").join(spread, "name").select(
        "name", F.col("w.path").alias("winner"), F.col("w.source_kind").alias("kind"), F.col("x.path").alias("next_path"), "sources",
        (F.col("hashes") > 1).alias("value_mismatch"), stale.alias("stale_overrides_fresh"),
    )


def env_orphans(declarations: DataFrame, reads: DataFrame) -> DataFrame:
    """Variables that are read but not declared, or declared but not read."""
    declared = declarations.select("name").distinct().withColumn("declared", F.lit(True))
    read = reads.groupBy("name").agg(F.count_distinct("path").alias("readers"))
    rows = declared.join(read, "name", "full_outer").where("declared IS NULL OR readers IS NULL")
    return rows.select("name", F.when(F.col("declared").isNull(), "orphan_read").otherwise("orphan_declaration").alias("finding"), F.coalesce("readers", F.lit(0)).cast("long").alias("readers"))


# Sources whose values can't be read.
ENCRYPTED = ("sealed_secret", "external_secret", "sops_file")
# Names that the system or a runtime sets.
RUNTIME_NAMES = ("PATH", "HOME", "USER", "SHELL", "PWD", "LANG", "TERM", "TMPDIR", "HOSTNAME", "NODE_ENV", "PYTHONPATH", "RUST_LOG", "CI")


def env_warnings(declarations: DataFrame, reads: DataFrame, threshold_days: int = 30) -> DataFrame:
    """name, warning and path of everything that is odd about a variable's sources, which stand by rank, then path.

    Read and nowhere declared; declared and never read (if anything is read at all); plain
    values that differ; a first source older than the second by the threshold; a first
    source that is encrypted and older than a plain one by it; each encrypted source.
    """
    rows = _ranked(declarations).withColumn("encrypted", F.col("source_kind").isin(*ENCRYPTED))
    order = Window.partitionBy("name").orderBy(F.desc("rank"), "path")
    placed = rows.withColumn("place", F.row_number().over(order))
    read, declared = reads.select("name").distinct(), declarations.select("name").distinct()
    none = F.lit(None).cast("string")
    out = read.join(declared, "name", "left_anti").where(~F.col("name").isin(*RUNTIME_NAMES)).select("name", F.lit("orphan_code_reference").alias("warning"), none.alias("path"))
    unread = declared.join(read, "name", "left_anti").crossJoin(read.limit(1).select(F.lit(True).alias("any")))
    plain = rows.where(~F.col("encrypted")).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value_hash").alias("values")).where("n > 1 AND values > 1")
    first = placed.where("place = 1").select("name", "path", F.col("encrypted").alias("sealed"), F.col("age_days").alias("first_age"))
    second = placed.where("place = 2").select("name", F.col("age_days").alias("second_age"))
    youngest = placed.where("place > 1 AND NOT encrypted").groupBy("name").agg(F.min("age_days").alias("plain_age"))
    stale = first.join(second, "name").where(F.col("first_age") - F.col("second_age") >= threshold_days)
    sealed = first.where("sealed").join(youngest, "name").where(F.col("first_age") - F.col("plain_age") >= threshold_days)
    row = lambda df, warning, path: df.select("name", F.lit(warning).alias("warning"), path.alias("path"))
    for part in (
        row(unread, "orphan_declaration", none), row(plain, "multi_source_value_mismatch", none), row(stale, "stale_overrides_fresh", F.col("path")),
        row(sealed, "sealed_secret_suspected_stale", F.col("path")), row(rows.where("encrypted"), "encrypted_decode_blocked", F.col("path")),
    ):
        out = out.union(part)
    return out


def event_risks(emits: DataFrame, listens: DataFrame, calls: DataFrame, literals: DataFrame) -> DataFrame:
    """kind, event and path of what may go wrong with events.

    orphan: listened to, emitted by no file and named by no literal of a listening file.
    name_mismatch: emitted and listened to under names that differ but for their case style. listen_not_awaited.
    call_before_listen: a file's first call stands before its first listener; awaited_listen_late: so does
    it before an awaited one.
    """
    key = event_key(F.col("name"))
    e, n = emits.select(key.alias("event"), "name", "path"), listens.select(key.alias("event"), "name", "path", "line", "awaited")
    silent = n.join(e.select("event").distinct(), "event", "left_anti").select("event", "path").distinct()
    quoted = literals.select(event_key(F.col("value")).alias("event"), "path").distinct()
    orphans = silent.join(silent.join(quoted, ["event", "path"], "left_semi").select("event").distinct(), "event", "left_anti")
    spelled = lambda df, c: df.groupBy("event").agg(F.min("name").alias(c), F.max("name").alias(f"{c}_last"), F.min("path").alias(f"{c}_path"))
    differ = spelled(e, "emitted").join(spelled(n, "heard"), "event").where("emitted <> heard OR emitted_last <> heard_last")
    first_call = calls.groupBy("path").agg(F.min("line").alias("call_line"))
    late = lambda df: df.groupBy("path", "event").agg(F.min("line").alias("listen_line")).join(first_call, "path").where("call_line < listen_line")
    row = lambda df, kind, path="path": df.select(F.lit(kind).alias("kind"), "event", F.col(path).alias("path"))
    out = row(orphans, "orphan").union(row(differ, "name_mismatch", "emitted_path")).union(row(n.where("NOT awaited").select("event", "path").distinct(), "listen_not_awaited"))
    return out.union(row(late(n), "call_before_listen")).union(row(late(n.where("awaited")), "awaited_listen_late"))


def template_drift(declarations: DataFrame, template_kind: str = "dotenv") -> DataFrame:
    """Per directory, names in its template only or outside its template only."""
    rows = declarations.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "name", (F.col("source_kind") == template_kind).alias("template"))
    grouped = rows.groupBy("directory", "name").agg(F.bool_or("template").alias("in_template"), F.bool_or(~F.col("template")).alias("outside"))
    with_template = rows.where("template").select("directory").distinct()
    return grouped.join(with_template, "directory", "left_semi").where("in_template <> outside").select("directory", "name", F.when(F.col("in_template"), "missing").otherwise("extra").alias("drift"))
