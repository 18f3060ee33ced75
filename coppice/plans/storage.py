"""Reading input tables and cutting lineage through the shared folder.

Long plans and loops are cut by writing a table to the folder that the session
names in ``spark.checkpoint.dir``; every executor and the driver can read it, so
a lost executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, which every executor must be able to read."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/coppice/{name}-{uuid.uuid4().hex}"


#: Of every settled() under way the tables that were written since it began.
_WRITTEN: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() makes, written; all that was written on the way to it is deleted."""
    _WRITTEN.append([])
    try:
        made = build()
        path = new_path(spark, name)
        made.write.parquet(path)
    finally:
        for on_the_way in _WRITTEN.pop():
            delete(spark, on_the_way)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(made.schema).parquet(path)


def measured(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As materialize(), with aggregates of the rows that the same job takes while it writes them."""
    seen = Observation()
    return materialize(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name), seen.get


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, root)


def release(spark: SparkSession) -> None:
    """Have the driver collect what stands for finished shuffles, upon which Spark deletes their files."""
    spark.sparkContext._jvm.System.gc()


#: Bytes of a side that is sent through the driver at most; a query's joins are few, so what they send doesn't grow with the input.
BROADCAST = 1 << 20
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40, "p": 50, "pb": 50}


def _bytes(size: str) -> int:
    digits = size.strip().lower().rstrip("bkmgtp")
    return int(digits) << _UNITS[size.strip().lower()[len(digits) :]]


def join_by_size(spark: SparkSession) -> None:
    """Have joins broadcast a side only after a shuffle has shown that it is small, BROADCAST bytes or fewer.

    Spark's guess for a file is that of its compressed columns, and made-up columns (paths, texts) count 20 bytes, so
    that it would send tables of many times the threshold through the driver. A side at Spark's own threshold is 42 MB
    as a hash table, and a dozen of such joins send half a gigabyte.
    """
    asked = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(min(_bytes(asked), BROADCAST)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key to a fixed number of parts, for small rows that take long to work on.

    Without the number adaptive execution would put parts together by their bytes, down to a few tasks.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
