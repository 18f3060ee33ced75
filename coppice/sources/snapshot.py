"""A snapshot: the code-graph tables of one scan, saved as Parquet and patched by path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.functions.paths import dirname, extension, is_test_path
from coppice.sources import extract
from coppice.sources import names as found_names
from coppice.sources.resolution import resolve

TABLES = ("files", "symbols", "edges", "names")
#: Tables of what a file holds by itself.
PARTS = ("files", "symbols", "names", "configs")
#: Files whose content or presence tells how imports are resolved; a table that older snapshots lack.
CONFIGS = r"(^|/)([\w.-]*(ts|js)config[\w.-]*\.json|svelte\.config\.(js|ts)|pyproject\.toml|setup\.(py|cfg)|Cargo\.toml)$"
#: Kinds of names that lead to another file.
LEADING = ("static", "type", "side_effect", "dynamic", "lazy", "reexport")


@dataclass
class Snapshot:
    """files (one row a path), symbols (what extraction found), edges (src, dst, label) and names (imports, uses and exports)."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    names: DataFrame
    configs: DataFrame | None = None

    @classmethod
    def of_texts(cls, texts: DataFrame) -> Snapshot:
        """From path and content."""
        return cls.of_parts(cls.parts_of(texts))

    @staticmethod
    def parts_of(texts: DataFrame) -> dict[str, DataFrame]:
        """What each file holds by itself, without the edges that need all files."""
        configs = texts.where(F.col("path").rlike(CONFIGS)).select("path", "content")
        return {"files": extract.file_table(texts), "symbols": extract.extract(texts), "names": found_names.names(texts), "configs": configs}

    @classmethod
    def of_parts(cls, parts: dict[str, DataFrame]) -> Snapshot:
        edges = cls._edges(parts["symbols"], parts["files"], parts["configs"])
        return cls(parts["files"], parts["symbols"], edges, parts["names"], parts["configs"])

    @staticmethod
    def _edges(symbols: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
        return extract.import_edges(resolve(symbols.where("table = 'imports'").select("path", "line", "kind", "name"), files, configs))

    def _configs(self) -> DataFrame:
        if self.configs is not None:
            return self.configs
        return self.files.where(F.col("path").rlike(CONFIGS)).select("path", F.lit(None).cast("string").alias("content"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Snapshot:
        """mergeSchema lets tables of older snapshots lack later columns."""
        read = lambda name: spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")
        try:
            configs = read("configs")
        except AnalysisException:  # of an older version
            configs = None
        return cls(*map(read, TABLES), configs)

    def save(self, path: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self._configs().write.mode("overwrite").parquet(f"{path}/configs")

    def patched(self, changed: Snapshot, paths: DataFrame) -> Snapshot:
        """This snapshot with all rows of the given paths replaced by those of another; every import is resolved among the new files."""

        def swap(name: str) -> DataFrame:
            old = getattr(self, name).join(paths.select("path").distinct(), "path", "left_anti")
            return old.select(*getattr(self, name).columns).unionByName(getattr(changed, name))

        files, symbols = swap("files"), swap("symbols")
        configs = self._configs().join(paths.select("path").distinct(), "path", "left_anti").unionByName(changed._configs())
        return Snapshot(files, symbols, self._edges(symbols, files, configs), swap("names"), configs)

    # The tables that the operators on symbols read.

    def imports(self) -> DataFrame:
        """path, name ('*' for a whole module), alias, source, kind, resolved_path and is_test of every imported name."""
        rows = self.names.where(F.col("kind").isin(*LEADING)).select("path", "line", "kind", F.col("source").alias("name"), F.col("name").alias("imported"), "alias")
        resolved = resolve(rows, self.files, self._configs())
        return resolved.select("path", "line", "kind", F.col("name").alias("source"), F.col("imported").alias("name"), "alias", "resolved_path", is_test_path(F.col("path")).alias("is_test"))

    def exports(self) -> DataFrame:
        """path, name, kind, line, dir, language and is_test of every exported name, by declaration or list."""
        declared = self.symbols.where("table = 'exports'").select("path", "name", "kind", "line")
        listed = self.names.where("kind = 'export'").select("path", "name", F.lit("const").alias("kind"), "line")
        again = self.names.where("kind = 'reexport' AND name <> '*'").select("path", F.coalesce("alias", "name").alias("name"), F.lit("reexport").alias("kind"), "line")
        one = F.min(F.struct(F.when(F.col("kind") == "reexport", 1).otherwise(0).alias("o"), "line", "kind")).alias("x")
        rows = declared.unionByName(listed).unionByName(again).groupBy("path", "name").agg(one)
        rows = rows.select("path", "name", "x.kind", "x.line", dirname(F.col("path")).alias("dir"), extension(F.col("path")).alias("language"))
        return rows.withColumn("is_test", is_test_path(F.col("path")))

    def uses(self) -> DataFrame:
        """(path, name) of names that a file reads; of scripts, names that stand more often than in their declaration count."""
        return self.names.where("kind = 'use'").select("path", "name").distinct()
