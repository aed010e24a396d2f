"""Sources: files and matrices that Spark derives from the given tables, read back."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from optabula.cluster import shared_path
from optabula.functions.vectors import at
from optabula.sources.binary import read_binary_blocks, read_binary_rows
from optabula.sources.tables import read_csv_matrix, to_ml_frame

from .fixtures import (
    EVENTS_SQL,
    P1_SQL,
    event_rows,
    p1,
    p1_training,
    write_binary,
)
from .registry import query, rounded


@query("binary_rows", f"""
    WITH {P1_SQL} SELECT x1 AS f0, x2 AS f1, x3 AS f2, y AS f3, count(*) AS n FROM p1 GROUP BY ALL""")
def binary_rows(spark, sf_dir):
    path = shared_path(spark, "rows")
    write_binary(p1(spark, sf_dir), "values", path)
    rows = read_binary_rows(spark, path, 4, split_bytes=1 << 20)
    v = F.col("values")
    return rows.groupBy(*[at(v, i).alias(f"f{i}") for i in range(4)]).agg(
        F.count(F.lit(1)).alias("n"))


@query("binary_positions", "SELECT count(*) AS n, count(*) - 1 AS last_pos, true AS dense FROM lineitem")
def binary_positions(spark, sf_dir):
    path = shared_path(spark, "rows")
    write_binary(p1(spark, sf_dir), "values", path)
    rows = read_binary_rows(spark, path, 4, split_bytes=1 << 20)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"),
        ((F.count_distinct("pos") == F.count(F.lit(1))) & (F.min("pos") == 0)).alias("dense"))


@query("binary_blocks", f"""
    WITH {EVENTS_SQL} SELECT CAST(count(*) AS INTEGER) AS n_rows, 3 AS n_cols, min_by(v1, event_id) AS first_value,
      max_by(v3, event_id) AS last_value, {rounded('sum(v1 + v2 + v3)', 6)} AS total
    FROM r GROUP BY event_id // 70""")
def binary_blocks(spark, sf_dir):
    path = shared_path(spark, "blocks")
    ordered = event_rows(spark, sf_dir).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    write_binary(ordered, "values", path)  # files that end within blocks
    return read_binary_blocks(spark, path, 70, 3).selectExpr(
        "n_rows", "n_cols", "values[0] AS first_value", "element_at(values, -1) AS last_value",
        "round(aggregate(values, 0D, (s, v) -> s + v), 6) AS total")


@query("binary_range", f"""
    WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM r),
      t AS (SELECT count(*) // 3 AS first, 2 * count(*) // 3 AS last FROM r)
    SELECT pos, v1, v2, v3 FROM n, t WHERE pos >= first AND pos < last""")
def binary_range(spark, sf_dir):
    path, rows = shared_path(spark, "range"), event_rows(spark, sf_dir)
    ordered = rows.repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    write_binary(ordered, "values", path)
    n = rows.count()
    found = read_binary_rows(spark, path, 3, 1 << 16, n // 3, 2 * n // 3)  # the middle third
    return found.selectExpr("pos", *[f"values[{i}] AS v{i + 1}" for i in range(3)])


@query("csv_matrix", f"""
    WITH {P1_SQL} SELECT x1 AS f0, x2 AS f1, x3 AS f2, y AS target, count(*) AS n FROM p1 GROUP BY ALL""")
def csv_matrix(spark, sf_dir):
    path = shared_path(spark, "csv")
    p1(spark, sf_dir).select("x1", "x2", "x3", "y").write.csv(path)
    rows = read_csv_matrix(spark, path, 4, target_last=True)
    v = F.col("features")
    return rows.groupBy(*[at(v, i).alias(f"f{i}") for i in range(3)], "target").agg(
        F.count(F.lit(1)).alias("n"))


@query("ml_frame", f"""
    WITH {P1_SQL} SELECT t AS label, x1 AS f0, x2 AS f1, x3 AS f2, count(*) AS n FROM p1 GROUP BY ALL""")
def ml_frame(spark, sf_dir):
    frame = to_ml_frame(p1_training(spark, sf_dir), drop_intercept=True)
    v = vector_to_array("features")
    return frame.groupBy("label", *[at(v, i).alias(f"f{i}") for i in range(3)]).agg(
        F.count(F.lit(1)).alias("n"))
