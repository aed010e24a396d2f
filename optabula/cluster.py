"""Session facts the library depends on: where shared files live, what may be shipped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Most bytes of parameter vectors sent to the tasks of one pass.
MAX_SHIPPED_BYTES = 64 * 1024 * 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; unset, a folder below the session's warehouse."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/optabula-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: one without any is the cluster's default file system's."""
    system, where = _located(spark, path)
    return system.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that the library itself has written, if it is there."""
    system, where = _located(spark, path)
    system.delete(where, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    root = qualified(spark, checkpoint_root(spark)).rstrip("/")
    return f"{root}/optabula/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops plan growth."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def check_shipped(n_values: int, what: str) -> None:
    """Refuse to ship vectors beyond the proven size bound."""
    n_bytes = 8 * n_values
    if n_bytes > MAX_SHIPPED_BYTES:
        raise ValueError(
            f"{what} takes {n_bytes} bytes, above the bound of {MAX_SHIPPED_BYTES}; "
            "evaluate fewer models per pass"
        )


def scan_partitions(df: DataFrame) -> int | None:
    """Partition count of a plan that shuffles nothing; None where counting would run a shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return None if "Exchange" in plan else df.rdd.getNumPartitions()
