"""Environment variables that files declare: nested ones are flattened to key paths first, then every format is a rule on paths.

One pass per file of indented lines keeps a stack of (indentation, key) and gives a row per
scalar: its document, its keys from the top and its value. Lists have `[n]` as a key.
Mappings, lists, quoted and plain scalars, flow lists and maps on one line, block scalars
and several documents are read; anchors and tags are not resolved.

Values are never kept: a plain one leaves the first 12 digits of its SHA-256.

Defined results: a null content gives no rows; a line that is no pair, item or scalar is
skipped; a name that a file declares twice has two rows; files of no known format have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.functions.paths import basename, is_template

PAIR = re.compile(r"""^("(?:[^"\\]|\\.)*"|'[^']*'|[^\s#'"\[{&*!|>-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")
FLOW = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'[^']*'|[^,:\]}{\[]+?)\s*:\s+)?("(?:[^"\\]|\\.)*"|'[^']*'|[^,\]}]*)\s*(?:,|$)""")
# Kinds of objects that run containers.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob", "ReplicaSet", "Pod")
# What an encrypted file holds.
SEALED = r"ENC\[AES256_GCM|(^|\n)sops:|\"sops\":"
SECRET = r"\$\{\{\s*secrets\.([A-Z_][A-Z0-9_]*)\s*\}\}"
NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def scalar(text: str) -> str:
    """A scalar without its quotes or the comment behind it."""
    text = text.strip()
    if text[:1] in "\"'" and (end := text.rfind(text[0], 1)) > 0:
        return text[1:end]
    return re.split(r"\s#", text, maxsplit=1)[0].rstrip()


def flatten(text: str) -> list[tuple[int, list[str], str, int]]:
    """(document, keys, value, line) of every scalar of indented text."""
    rows, stack, document, block = [], [], 0, None
    counts: dict[tuple[int, ...], int] = {}

    def put(keys: list[str], value: str, line: int) -> None:
        value = value.strip()
        if value[:1] in "[{" and value[-1:] in "]}":
            for k, m in enumerate(m for m in FLOW.finditer(value[1:-1]) if m[0].strip()):
                rows.append((document, [*keys, scalar(m[1]) if m[1] else f"[{k}]"], scalar(m[2]), line))
        else:
            rows.append((document, keys, scalar(value), line))

    for number, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if block is not None:  # a block scalar goes on while lines are deeper than its key
            if not bare or indent > block[0]:
                rows[-1] = (*rows[-1][:2], (rows[-1][2] + "\n" + bare).strip(), rows[-1][3])
                continue
            block = None
        if not bare or bare[0] == "#":
            continue
        if bare == "---" or bare.startswith("--- "):
            document, stack = document + 1, []
            counts.clear()
            continue
        while bare == "-" or bare.startswith("- "):
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and stack[-1][1][0] == "[")):
                stack.pop()
            place = (indent, *(hash(k) for _, k in stack))
            counts[place] = counts.get(place, -1) + 1
            stack.append((indent, f"[{counts[place]}]"))
            rest = bare[1:].lstrip()
            indent, bare = indent + len(bare) - len(rest), rest
        if not bare:
            continue
        pair = PAIR.match(bare)
        if pair is None:
            if stack and stack[-1][1][0] == "[":
                put([k for _, k in stack], bare, number)
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        key, value = scalar(pair[1]), pair[2] or ""
        keys = [*(k for _, k in stack), key]
        stack.append((indent, key))
        if re.match(r"[|>][+-]?\d*\s*(#.*)?$", value):
            rows.append((document, keys, "", number))
            block = (indent,)
        elif value and value[0] != "#":
            put(keys, value, number)
    return rows


def flattened(texts: DataFrame) -> DataFrame:
    """path, doc, keys, value and line of every scalar of files of indented lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = flatten(content)
                columns = [[path] * len(found), *(zip(*found, strict=True) if found else [()] * 4)]
                kinds = pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "doc", "keys", "value", "line"])

    rows = texts.where("content IS NOT NULL AND lower(path) RLIKE '[.]ya?ml$'").select("path", "content")
    return rows.mapInArrow(run, "path string, doc int, keys array<string>, value string, line bigint")


def _row(rows: DataFrame, name: Column, kind: Column | str, value: Column | None, presence: Column | None = None) -> DataFrame:
    """A declaration; presence: plain, empty, from or encrypted, by the value if it isn't said."""
    value = F.lit(None).cast("string") if value is None else value
    said = F.when(F.coalesce(value, F.lit("")) == "", "empty").when(value.rlike(r"\$\{\{|\{\{|^\$"), "from").otherwise("plain") if presence is None else presence
    out = rows.select(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("source_kind"), "path", "line", said.alias("presence"), value.alias("v"))
    return out.select("name", "source_kind", "path", "line", "presence", F.when(F.col("presence") == "plain", F.substring(F.sha2("v", 256), 1, 12)).alias("value_hash"))


def _regex(pattern: str) -> str:
    """A form of key paths as a regular expression: * is any key, # any place of a list, ** any keys."""
    return pattern.replace("**/", "\0").replace("*", "[^/]+").replace("#", r"\[[0-9]+\]").replace("\0", "(?:[^/]+/)*")


def _at(pattern: str) -> Column:
    return F.array_join("keys", "/").rlike(f"^{_regex(pattern)}$")


def _pairs(rows: DataFrame, above: str) -> DataFrame:
    """Items of a list of names and values: name, value (null without one), and whether it comes from elsewhere."""
    keys, form = F.array_join("keys", "/"), rf"^({_regex(above)}/\[[0-9]+\])/(.+)$"
    keyed = rows.where(keys.rlike(form)).select("path", "doc", "line", "value", F.regexp_extract(keys, form, 1).alias("item"), F.regexp_extract(keys, form, 2).alias("field"))
    grouped = keyed.groupBy("path", "doc", "item").agg(
        F.max(F.when(F.col("field") == "name", F.col("value"))).alias("name"), F.max(F.when(F.col("field") == "value", F.col("value"))).alias("value"),
        F.bool_or(F.startswith("field", F.lit("valueFrom"))).alias("elsewhere"), F.min("line").alias("line"),
    )
    return grouped.where("name IS NOT NULL")


def declarations(texts: DataFrame) -> DataFrame:
    """name, source_kind, path, line, presence, value_hash and template of every declaration in files of the known formats."""
    flat, file, last = flattened(texts), basename(F.col("path")), F.element_at("keys", -1)
    parts = []
    compose = flat.where(F.lower(file).rlike(r"^(docker-)?compose[\w.-]*\.ya?ml$"))
    parts.append(_row(compose.where(_at("services/*/environment/*") & ~_at("services/*/environment/#")), last, "docker_compose", F.col("value")))
    listed = compose.where(_at("services/*/environment/#"))
    parts.append(_row(listed, F.substring_index("value", "=", 1), "docker_compose", F.when(F.contains("value", F.lit("=")), F.regexp_replace("value", "^[^=]*=", ""))))
    parts.append(_row(compose.where(_at("services/*/env_file(/#(/path)?)?")), F.lit("__env_file__"), "docker_compose_env_file", F.col("value"), F.lit("from")))
    # Documents by their kind.
    kinds = flat.where(_at("kind")).groupBy("path", "doc").agg(F.max("value").alias("kind"))
    objects = flat.join(kinds, ["path", "doc"])
    pods = objects.where(F.col("kind").isin(*WORKLOADS))
    for holder in ("containers", "initContainers"):
        env = _pairs(pods, f"**/{holder}/#/env")
        parts.append(_row(env, F.col("name"), "k8s_deployment_env", F.col("value"), F.when(F.col("elsewhere"), "from").when(F.coalesce("value", F.lit("")) == "", "empty").otherwise("plain")))
        parts.append(_row(pods.where(_at(f"**/{holder}/#/envFrom/#/*/name")), F.lit("__env_from__"), "k8s_deployment_env_from", F.col("value"), F.lit("from")))
    parts.append(_row(objects.where((F.col("kind") == "ConfigMap") & _at("data/*")), last, "k8s_config_map", F.col("value")))
    parts.append(_row(objects.where((F.col("kind") == "Secret") & _at("data/*")), last, "k8s_secret", F.col("value"), F.lit("encrypted")))
    parts.append(_row(objects.where((F.col("kind") == "Secret") & _at("stringData/*")), last, "k8s_secret_string_data", F.col("value")))
    parts.append(_row(objects.where((F.col("kind") == "SealedSecret") & _at("spec/encryptedData/*")), last, "sealed_secret", F.col("value"), F.lit("encrypted")))
    parts.append(_row(objects.where((F.col("kind") == "ExternalSecret") & _at("spec/data/#/secretKey")), F.col("value"), "external_secret", None, F.lit("encrypted")))
    helm = flat.where(F.lower(file).rlike(r"^values[\w.-]*\.ya?ml$"))
    parts.append(_row(helm.where(_at("**/env/*") & ~_at("**/env/#")), last, "helm_values", F.col("value")))
    parts.append(_row(_pairs(helm, "**/env"), F.col("name"), "helm_values", F.col("value")))
    flows = flat.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+$"))
    parts.append(_row(flows.where(_at("env/*") | _at("jobs/*/env/*") | _at("jobs/*/steps/#/env/*")), last, "github_actions_env", F.col("value")))
    secrets = flows.select("path", F.explode(F.regexp_extract_all("value", F.lit(SECRET), F.lit(1))).alias("secret"), "line").groupBy("path", "secret").agg(F.min("line").alias("line"))
    parts.append(_row(secrets, F.col("secret"), "github_actions_secret", None, F.lit("from")))
    # Files of one line a declaration.
    lines = texts.where("content IS NOT NULL").select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "text")).withColumn("line", (F.col("n") + 1).cast("long"))
    pair = rf"^\s*(?:export\s+)?({NAME})\s*=\s*(.*?)\s*$"
    dotted = lines.where(F.lower(file).rlike(r"^\.env(rc)?($|\.)|\.env$") & F.col("text").rlike(pair))
    raw = F.regexp_extract("text", pair, 2)
    bare = F.when(raw.rlike("^\".*\"$|^'.*'$"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(F.regexp_replace(raw, r"(^|\s+)#.*$", ""))
    parts.append(_row(dotted, F.regexp_extract("text", pair, 1), F.when(F.lower(file).rlike(r"^\.envrc($|\.)"), "envrc").otherwise("dotenv"), bare))
    docker = lines.where(F.lower(file).rlike(r"^dockerfile($|\.)|\.dockerfile$") & F.col("text").rlike(r"(?i)^\s*ENV\s+\S"))
    body = F.regexp_replace("text", r"(?i)^\s*ENV\s+", "")
    many = F.transform(F.regexp_extract_all(body, F.lit(rf"{NAME}=(?:\"[^\"]*\"|\S*)"), F.lit(0)), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), "^\"|\"$", "").alias("v")))
    spaced = F.array(F.struct(F.regexp_extract(body, rf"^({NAME})\s", 1).alias("k"), F.trim(F.regexp_extract(body, r"^\S+\s+(.*)$", 1)).alias("v")))
    each = docker.select("path", "line", F.explode(F.when(body.rlike(rf"^{NAME}="), many).otherwise(spaced)).alias("e")).select("path", "line", "e.*").where("k <> ''")
    parts.append(_row(each, F.col("k"), "dockerfile", F.col("v")))
    scripts = texts.where(basename(F.col("path")) == "package.json").select("path", F.explode(F.from_json("content", "scripts map<string,string>")["scripts"]).alias("script", "body"))
    lead = F.regexp_extract("body", rf"^\s*((?:{NAME}=\S*\s+)*)", 1)
    each = scripts.select("path", F.lit(None).cast("long").alias("line"), F.explode(F.filter(F.split(F.trim(lead), r"\s+"), lambda x: x != "")).alias("a"))
    parts.append(_row(each, F.substring_index("a", "=", 1), "npm_script", F.regexp_replace("a", "^[^=]*=", "")))
    sealed = texts.where(F.col("path").rlike(r"(?i)\.(ya?ml|json|env)$") & F.col("content").rlike(SEALED)).select("path", F.lit(None).cast("long").alias("line"))
    parts.append(_row(sealed, F.lit("__sops__"), "sops_file", None, F.lit("encrypted")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("template", is_template(F.col("path")))
