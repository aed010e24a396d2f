"""CSV and random matrices, reference-model tables, spark.ml frames and the trace sink."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kernels
from ..functions.prep import features_only
from ..operators.blocks import BLOCK_SCHEMA

MODEL_SCHEMA = "problem string, rep int, kind string, model array<double>"


def read_csv_matrix(spark: SparkSession, path: str, n_cols: int | None = None,
                    target_last: bool = False) -> DataFrame:
    """Headerless CSV of doubles -> (values), or (features, target) with ``target_last``.

    Malformed lines fail the read. Without ``n_cols`` the first line gives the width.
    """
    if n_cols is None:
        first = spark.read.text(path).first()
        if first is None:
            raise ValueError(f"{path} is empty: pass n_cols")
        n_cols = len(first[0].split(","))
    schema = T.StructType([T.StructField(f"c{i}", T.DoubleType()) for i in range(n_cols)])
    rows = spark.read.csv(path, schema=schema, mode="FAILFAST")
    columns = [f"c{i}" for i in range(n_cols)]
    if target_last:
        return rows.select(
            F.array(*columns[:-1]).alias("features"), F.col(columns[-1]).alias("target"))
    return rows.select(F.array(*columns).alias("values"))


def random_blocks(spark: SparkSession, n_rows: int, n_cols: int, height: int,
                  blocks_per_partition: int, seed: int) -> DataFrame:
    """Uniform [0, 1) blocks: ceil(n_rows / height) of them, the last one short.

    Block k is drawn from its own stream (seed, k), so a recomputed or differently
    partitioned run gives the same rows.
    """
    if min(n_rows, n_cols, height, blocks_per_partition) < 1:
        raise ValueError("sizes must be at least 1")
    blocks = -(-n_rows // height)
    partitions = -(-blocks // blocks_per_partition)

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                n = min(height, n_rows - k * height)
                values = np.random.default_rng([seed, k]).random(n * n_cols)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k], pa.int64()), pa.array([n], pa.int32()),
                        pa.array([n_cols], pa.int32()), kernels.as_lists(values[None, :]),
                    ],
                    ["block_id", "n_rows", "n_cols", "values"],
                )

    return spark.range(0, blocks, 1, partitions).mapInArrow(draw, BLOCK_SCHEMA)


def reference_models(models: DataFrame) -> DataFrame:
    """(problem, rep, kind, model) -> (problem, rep, kind, pos, value)."""
    return models.select("problem", "rep", "kind", F.posexplode("model").alias("pos", "value"))


def reference_models_from_rows(spark: SparkSession, rows: Iterable[Sequence]) -> DataFrame:
    """The same table from a few driver rows (problem, rep, kind, list of floats)."""
    return reference_models(spark.createDataFrame(list(rows), MODEL_SCHEMA))


def to_ml_frame(df: DataFrame, features: str = "features", label: str = "label",
                drop_intercept: bool = False) -> DataFrame:
    """(label, features) with a vector column for spark.ml estimators."""
    vector = F.col(features)
    if drop_intercept:
        vector = features_only(vector)
    return df.select(F.col(label).cast("double").alias("label"),
                     array_to_vector(vector).alias("features"))


def write_trace(trace: DataFrame, path: str, fmt: str = "parquet",
                summary: DataFrame | None = None) -> None:
    """Writes the iterations, and the run summary next to them, as ``iterations``/``summary``."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    for name, table in (("iterations", trace), ("summary", summary)):
        if table is None:
            continue
        if fmt == "csv":
            vectors = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType)]
            for column in vectors:
                table = table.withColumn(
                    column, F.concat_ws(",", F.col(column).cast("array<string>")))
            table.write.mode("overwrite").csv(f"{path}/{name}", header=True)
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
