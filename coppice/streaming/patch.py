"""Keeping tables of newest states from streams of changes.

A micro-batch is written as a version of its own in the shared folder, and a pointer
beside it names the versions that make up the state; a batch that is run again replaces
its version and pointer, and a new process goes on from the newest pointer. When a few
versions have come together they are merged into one and the old ones deleted, so a
batch's cost follows its own size.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.storage import delete, new_path, settled
from coppice.plans.storage import drop as delete_table
from coppice.sources.snapshot import PARTS, Snapshot

POINTER = "batch bigint, versions array<string>"


def newest_pointer(spark: SparkSession, root: str, before: int | None = None) -> tuple[int, list[str]]:
    """The last batch that is whole, of those before one that is to be run again, and the versions that make up its state."""
    try:
        rows = spark.read.schema(POINTER).json(f"{root}/pointers/*")
        last = rows.where(F.col("batch") < before if before is not None else F.lit(True)).orderBy(F.desc("batch")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (last["batch"], last["versions"]) if last else (-1, [])


def point(spark: SparkSession, root: str, batch: int, versions: list[str]) -> None:
    spark.createDataFrame([(batch, versions)], POINTER).coalesce(1).write.mode("overwrite").json(f"{root}/pointers/{batch}")


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key; a maximum over structs, so no key's rows are sorted or gathered."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return last.select(key, *(F.col("last").getField(c).alias(c) for c in (*order, *rest))).select(*rows.columns)


class Upsert:
    """A foreachBatch sink that keeps the newest row of every key."""

    def __init__(self, spark: SparkSession, key: str, order: list[str], root: str | None = None, most: int = 8):
        self.spark, self.key, self.order, self.most = spark, key, order, most
        self.root = root or new_path(spark, "upsert")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _, versions = newest_pointer(spark, self.root, batch_id)
        newest(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.root}/delta-{batch_id}")
        versions = [*versions, f"delta-{batch_id}"]
        if len(versions) <= self.most:
            point(spark, self.root, batch_id, versions)
            return
        self._read(spark, versions).write.mode("overwrite").parquet(f"{self.root}/merged-{batch_id}")
        point(spark, self.root, batch_id, [f"merged-{batch_id}"])
        # What the pointer before this one names stays, should this batch be run again.
        for old in self.__dict__.pop("merged", []):
            delete(spark, f"{self.root}/{old}")
        self.merged = versions

    def _read(self, spark: SparkSession, versions: list[str]) -> DataFrame:
        return newest(spark.read.parquet(*(f"{self.root}/{v}" for v in versions)), self.key, self.order)

    def table(self) -> DataFrame:
        return self._read(self.spark, newest_pointer(self.spark, self.root)[1])


class Patch:
    """A foreachBatch sink of (path, content, ts) changes that keeps a snapshot; a null content deletes the path.

    A batch writes what it found in its own paths, and these paths as marks: of a path the
    rows of its last mark count, and none if it was deleted there. Imports are resolved
    among all files when the snapshot is read. What a batch writes follows its changes;
    when more than `most` versions have come together they are merged into one.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, most: int = 8):
        self.spark, self.root, self.most = spark, root or new_path(spark, "snapshots"), most

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = settled(spark, "changed-files", lambda: newest(batch.select("path", "ts", "content"), "path", ["ts"]))
        _, versions = newest_pointer(spark, self.root, batch_id)
        self._write(Snapshot.parts_of(last.where("content IS NOT NULL").select("path", "content")) | {"paths": last.select("path")}, f"delta-{batch_id}", batch_id)
        delete_table(last)
        versions = [*versions, f"delta-{batch_id}"]
        if len(versions) <= self.most:
            point(spark, self.root, batch_id, versions)
            return
        parts = self._read(spark, versions)
        self._write(parts | {"paths": parts["files"].select("path")}, f"merged-{batch_id}", batch_id)
        point(spark, self.root, batch_id, [f"merged-{batch_id}"])
        # What the pointer before this one names stays, should this batch be run again.
        for old in self.__dict__.pop("merged", []):
            delete(spark, f"{self.root}/{old}")
        self.merged = versions

    def _write(self, parts: dict[str, DataFrame], version: str, batch_id: int) -> None:
        for name, rows in parts.items():
            rows.withColumn("version", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")

    def _read(self, spark: SparkSession, versions: list[str]) -> dict[str, DataFrame]:
        """The parts of the state, each row under its path's last mark."""
        read = lambda name: spark.read.parquet(*(f"{self.root}/{v}/{name}" for v in versions))
        marks = read("paths").groupBy("path").agg(F.max("version").alias("version"))
        return {name: read(name).join(marks, ["path", "version"], "left_semi").drop("version") for name in PARTS}

    def snapshot(self) -> Snapshot:
        return Snapshot.of_parts(self._read(self.spark, newest_pointer(self.spark, self.root)[1]))


def replay(spark: SparkSession, source: str, table_name: str, key: str, order: list[str], files_a_batch: int = 1) -> DataFrame:
    """Streams a Parquet table through an Upsert to its end and returns the final state."""
    sink = Upsert(spark, key, order)
    path = f"{source}/{table_name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_a_batch)
    if any(f.endswith(f"/{table_name}.parquet") for f in batch.inputFiles()):  # a table of one file: a stream reads folders
        stream = stream.option("pathGlobFilter", f"{table_name}.parquet").parquet(source)
    else:
        stream = stream.parquet(path)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.table()


def debounced(changes: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of changes (path, ts) as one row each: a session per path that ends after a quiet gap."""
    burst = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return burst.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count("*").alias("changes")).select(
        "path", F.col("w.start").alias("first_change"), F.col("w.end").alias("quiet_at"), "changes"
    )
