"""The given tables in the roles of the library: the same definitions for Spark and for SQL."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optabula.cluster import qualified
from optabula.sources.binary import data_files, open_filesystem

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
BLOCKS = 16

# P1, tall and narrow: one row per lineitem, deterministic label noise.
P1_COLUMNS = {
    "x1": "(l_quantity - CAST(25.5 AS DOUBLE)) / CAST(14.43 AS DOUBLE)",
    "x2": "(l_extendedprice - CAST(52500 AS DOUBLE)) / CAST(30300 AS DOUBLE)",
    "x3": "(l_discount - CAST(0.05 AS DOUBLE)) / CAST(0.0316 AS DOUBLE)",
    "y": "CASE WHEN CAST(0.8 AS DOUBLE) * (l_quantity - CAST(25.5 AS DOUBLE)) / CAST(14.43 AS DOUBLE)"
         " - CAST(0.5 AS DOUBLE) * (l_extendedprice - CAST(52500 AS DOUBLE)) / CAST(30300 AS DOUBLE)"
         " + ((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709) % 2001)"
         " / CAST(500 AS DOUBLE) - 2 > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END",
    "block_id": f"l_orderkey % {BLOCKS}",
}
P1_SELECT = (
    "SELECT " + ", ".join(KEYS + [f"{sql} AS {name}" for name, sql in P1_COLUMNS.items()])
    + " FROM lineitem"
)
# CTE p1, with the 0/1 label t and the intercept feature x4.
P1_SQL = (
    f"p1 AS (SELECT *, CASE WHEN y = -1 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS t, "
    f"CAST(1 AS DOUBLE) AS x4 FROM ({P1_SELECT}) raw)"
)

# Embeddings as a long table e(vec_id, label, pos, v).
EMB_SQL = (
    "e AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, "
    "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
)

# P3: least squares of price on quantity, with intercept.
P3_SQL = (
    "p3 AS (SELECT (l_quantity - CAST(25.5 AS DOUBLE)) / CAST(14.43 AS DOUBLE) AS x1, "
    "CAST(1 AS DOUBLE) AS x2, "
    "(l_extendedprice - CAST(52500 AS DOUBLE)) / CAST(30300 AS DOUBLE) AS b, "
    f"l_orderkey % {BLOCKS} AS block_id FROM lineitem)"
)

# Events as numbered rows r(event_id, v1, v2, v3).
EVENT_COLUMNS = {
    "v1": "value / CAST(10 AS DOUBLE)",
    "v2": "user_id / CAST(50 AS DOUBLE) - 1",
    "v3": "(event_id * 7919 % 101) / CAST(50 AS DOUBLE) - 1",
}
EVENTS_SQL = (
    "r AS (SELECT event_id, " + ", ".join(f"{s} AS {n}" for n, s in EVENT_COLUMNS.items())
    + " FROM events)"
)


# P4, numbered rows: event_id is dense, so it places rows in blocks on every engine.
P4_COLUMNS = {
    "e1": "(event_id * 7919 % 101) / CAST(50 AS DOUBLE) - 1",
    "e2": "(user_id * 31 % 53) / CAST(26 AS DOUBLE) - 1",
}
P4_Y = (
    f"CASE WHEN CAST(0.9 AS DOUBLE) * ({P4_COLUMNS['e1']}) - CAST(0.6 AS DOUBLE) * ({P4_COLUMNS['e2']})"
    " + ((event_id * 104729 % 97) / CAST(48 AS DOUBLE) - 1) * 2"
    " + CASE WHEN value > 20 THEN CAST(0.5 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END > 0"
    " THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END"
)
# CTE p1 with x1, x2, the intercept x3 and the 0/1 label t.
P4_SQL = (
    "p1 AS (SELECT event_id, " + ", ".join(
        f"{sql} AS x{i + 1}" for i, sql in enumerate(P4_COLUMNS.values()))
    + f", CAST(1 AS DOUBLE) AS x3, ({P4_Y} + 1) / 2 AS t FROM events)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, x1..x3, y in {-1, 1}, block_id, values = [x1, x2, x3, y]."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        *KEYS, *[f"{sql} AS {name}" for name, sql in P1_COLUMNS.items()])
    return rows.withColumn("values", F.array("x1", "x2", "x3", "y"))


def p1_training(spark: SparkSession, sf_dir: str, d: int = 4) -> DataFrame:
    """Keys, block_id, features and 0/1 label. d=4: x1, x2, x3, 1; d=2: x1, x2."""
    names = {4: "x1, x2, x3, 1D", 2: "x1, x2"}[d]
    label = "CASE WHEN y = -1 THEN 0D ELSE 1D END AS label"
    return p1(spark, sf_dir).selectExpr(*KEYS, "block_id", f"array({names}) AS features", label)


def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: vec_id, features = 8 * embedding and 1 (65 values), label = (label = 3)."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "concat(transform(embedding, v -> 8D * CAST(v AS DOUBLE)), array(1D)) AS features",
        "CASE WHEN label = 3 THEN 1D ELSE 0D END AS label")


def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, features = [x1, 1], target."""
    return p1(spark, sf_dir).selectExpr(
        "block_id", "array(x1, 1D) AS features", "x2 AS target")


def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, values = [e1, e2, y] with y in {-1, 1}."""
    columns = ", ".join([*P4_COLUMNS.values(), P4_Y])
    return table(spark, sf_dir, "events").selectExpr("event_id", f"array({columns}) AS values")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v = embedding as doubles."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", "CAST(embedding AS ARRAY<DOUBLE>) AS v")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, values = [v1, v2, v3]."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", f"array({', '.join(EVENT_COLUMNS.values())}) AS values")


def write_binary(df: DataFrame, column: str, path: str) -> None:
    """Writes a vector column as big-endian doubles, one file per partition.

    Each attempt writes under its own name and then moves the file into place, so retried
    and speculative tasks leave one complete file.
    """
    path = qualified(df.sparkSession, path)
    open_filesystem(path)[0].create_dir(open_filesystem(path)[1])

    def write(batches):
        import pyarrow as pa

        system, root = open_filesystem(path)
        part = TaskContext.get().partitionId()
        attempt = f"{root}/_part-{part:06d}-{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(attempt) as sink:
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                data = flat.astype(">f8").tobytes()
                sink.write(data)
                n += len(data)
        system.move(attempt, f"{root}/part-{part:06d}.bin")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    written = df.select(column).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
    listed = sum(size for _, size in data_files(path))
    if listed != written:
        raise OSError(f"{path} lists {listed} of {written} bytes: executors do not share it")
