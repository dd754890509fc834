"""Shared storage for intermediate tables, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F

_local_roots: dict[str, str] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

# A table is only broadcast when it has at most this many rows (each row here is
# a term or a word pair, so this stays well under 100 MB on every executor).
BROADCAST_ROWS = 500_000


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="corpusmill-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/corpusmill/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to shared storage and read it back.

    Cuts the lineage so that a lost executor re-reads a file and does not redo
    the work, and gives later scans column pruning, filters and true sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that `materialize` returned, once all that reads them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Hint a join side: broadcast when a count proves it small, else sort-merge.

    Meant for materialized tables, where the count reads only file footers.
    """
    most = BROADCAST_ROWS if max_rows is None else max_rows
    n = df.limit(most + 1).count()
    return F.broadcast(df) if n <= most else df.hint("merge")


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Inner join of `rows` with a side that has one row per key.

    A side proven small is broadcast. A larger one is copied `salts` times, so that
    the rows of a hot key, told apart by the column `by`, go to as many tasks.
    """
    most = BROADCAST_ROWS
    if side.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(side), key)
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(copies.hint("merge"), [key, "_salt"]).drop("_salt")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small input over all cores before heavy work on its rows.

    A scan with fewer splits than cores holds less than one split per core, so the
    shuffle is cheap. A large input has many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
