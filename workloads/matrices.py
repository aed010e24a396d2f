"""Blocks, products and normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from optabula.operators import blocks as B
from optabula.operators.gram import (
    block_gram,
    gram,
    gram_entries,
    inverse_hessian_diag,
    total_gram,
)

from .fixtures import (
    EMB_SQL,
    EVENTS_SQL,
    P1_SQL,
    embeddings,
    event_rows,
    p1,
    p1_training,
    p2,
)
from .registry import query, rounded

HEIGHT = 500
NARROW_HEIGHT = 4096


def event_blocks(spark, sf_dir):
    return B.to_blocks(event_rows(spark, sf_dir), HEIGHT, 3, pos="event_id")


@query("blocks", f"""
    WITH {EVENTS_SQL}
    SELECT event_id // {HEIGHT} AS block_id, CAST(count(*) AS INTEGER) AS n_rows, 3 AS n_cols,
      min_by(v1, event_id) AS first_value, max_by(v3, event_id) AS last_value,
      {rounded('sum(v1 + v2 + v3)', 6)} AS total
    FROM r GROUP BY 1""")
def blocks(spark, sf_dir):
    return event_blocks(spark, sf_dir).selectExpr(
        "block_id", "n_rows", "n_cols", "values[0] AS first_value",
        "element_at(values, -1) AS last_value",
        "round(aggregate(values, 0D, (s, v) -> s + v), 6) AS total")


@query("blocks_narrow", f"""
    WITH {P1_SQL} SELECT count(*) AS n_rows, true AS within_height, true AS unique_ids,
      {rounded('sum(-y * x1)', 4)} AS s0, {rounded('sum(-y)', 4)} AS s3 FROM p1""")
def blocks_narrow(spark, sf_dir):
    folded = B.fold_blocks(p1_training(spark, sf_dir))
    made = B.to_blocks(folded, NARROW_HEIGHT, 4)
    column = "aggregate(sequence(0, n_rows - 1), 0D, (s, r) -> s + values[r * n_cols + {}])"
    return made.selectExpr(
        "block_id", "n_rows", f"{column.format(0)} AS c0", f"{column.format(3)} AS c3",
    ).selectExpr(
        "sum(n_rows) AS n_rows", f"max(n_rows) <= {NARROW_HEIGHT} AS within_height",
        "count(DISTINCT block_id) = count(1) AS unique_ids",
        "round(sum(c0), 4) AS s0", "round(sum(c3), 4) AS s3")


@query("fold_labeled_blocks", f"""
    WITH {EVENTS_SQL}, d AS (SELECT event_id // {HEIGHT} AS block_id, v1, v2,
      CASE WHEN v3 > 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS s FROM r)
    SELECT block_id, CAST(count(*) AS INTEGER) AS n_rows, {rounded('sum(s * v1)', 6)} AS s0,
      {rounded('sum(s * v2)', 6)} AS s1, {rounded('sum(s)', 6)} AS s2 FROM d GROUP BY block_id""")
def labeled_blocks(spark, sf_dir):
    rows = event_rows(spark, sf_dir).selectExpr(
        "event_id", "concat(slice(values, 1, 2), "
        "array(CASE WHEN values[2] > 0 THEN 1D ELSE -1D END)) AS values")
    folded = B.fold_labeled_blocks(B.to_blocks(rows, HEIGHT, 3, pos="event_id"))
    column = "aggregate(sequence(0, n_rows - 1), 0D, (s, r) -> s + values[r * n_cols + {0}])"
    return folded.selectExpr(
        "block_id", "n_rows",
        *[f"round({column.format(i)}, 6) AS s{i}" for i in range(3)])


@query("n_rows", "SELECT count(*) AS n_rows FROM events")
def n_rows(spark, sf_dir):
    return B.n_rows(event_blocks(spark, sf_dir))


@query("n_cols", f"WITH {EVENTS_SQL} SELECT CAST(max(len([v1, v2, v3])) AS INTEGER) AS n_cols FROM r")
def n_cols(spark, sf_dir):
    return B.n_cols(event_blocks(spark, sf_dir))


@query("n_blocks", f"SELECT count(DISTINCT event_id // {HEIGHT}) AS n_blocks FROM events")
def n_blocks(spark, sf_dir):
    return B.n_blocks(event_blocks(spark, sf_dir))


@query("multiply", f"""
    WITH {EMB_SQL}
    SELECT vec_id // 64 AS block_id, CAST(vec_id % 64 AS INTEGER) AS row, c AS col,
      {rounded('sum(v * ((pos * 7 + c * 13) % 11 - 5) / 10)', 8)} AS value
    FROM e, (VALUES (0), (1)) AS cols(c) GROUP BY vec_id, c""")
def multiply(spark, sf_dir):
    i, c = np.meshgrid(np.arange(64), np.arange(2), indexing="ij")
    matrix = ((i * 7 + c * 13) % 11 - 5) / 10
    made = B.to_blocks(embeddings(spark, sf_dir), 64, 64, values="v", pos="vec_id")
    rows = B.unblock(B.multiply(made, matrix))
    return rows.selectExpr("block_id", "row", "posexplode(values) AS (col, value)").withColumn(
        "value", F.round("value", 8))


@query("multiply_by_table", f"""
    WITH {EMB_SQL}, m AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS w
      FROM e a JOIN e b USING (vec_id) GROUP BY ALL)
    SELECT vec_id // 64 AS block_id, CAST(vec_id % 64 AS INTEGER) AS row, j AS col,
      {rounded('sum(v * w)', 4)} AS value
    FROM e JOIN m ON m.i = e.pos GROUP BY vec_id, j""")
def multiply_by_table(spark, sf_dir):
    rows = embeddings(spark, sf_dir)  # times their own 64 x 64 sum of squares and products
    sums = gram_entries(gram(rows.selectExpr("v AS features", "0D AS target"), 64))
    matrix = sums.where("j < 64").groupBy(F.col("i").cast("long").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("j", "value"))).alias("e")).selectExpr(
        "row", "e.value AS values")
    made = B.multiply_by_table(B.to_blocks(rows, 64, 64, values="v", pos="vec_id"), matrix, 64, 64, 24)
    cells = made.selectExpr("block_id", "first_col", "n_cols", "posexplode(values) AS (at, value)")
    return cells.selectExpr(
        "block_id", "at div n_cols AS row", "CAST(first_col + at % n_cols AS INTEGER) AS col",
        "round(value, 4) AS value").withColumn("row", F.col("row").cast("int"))


def gram_sql(source, names, target, key=None, digits=4):
    d = len(names)
    keys = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    parts = [
        f"SELECT {keys}{i} AS i, {j} AS j, {rounded(f'sum({names[i]} * {other})', digits)} AS value "
        f"FROM {source} {group}"
        for i in range(d) for j, other in enumerate([*names, target])
    ]
    return " UNION ALL ".join(parts)


P1_NAMES = ["x1", "x2", "x3", "x4"]


@query("gram_by_block", f"WITH {P1_SQL} " + gram_sql("p1", P1_NAMES, "y", "block_id"))
def gram_by_block(spark, sf_dir):
    rows = p1(spark, sf_dir).selectExpr(
        "block_id", "array(x1, x2, x3, 1D) AS features", "y AS target")
    return gram_entries(gram(rows, 4, by="block_id"), "block_id").withColumn(
        "value", F.round("value", 4))


@query("gram_total", f"WITH {P1_SQL} " + gram_sql("p1", P1_NAMES, "y", digits=3))
def gram_total(spark, sf_dir):
    rows = p1(spark, sf_dir).selectExpr(
        "block_id", "array(x1, x2, x3, 1D) AS features", "y AS target")
    total = total_gram(gram(rows, 4, by="block_id"), 4)
    return gram_entries(total).withColumn("value", F.round("value", 3))


P2_LONG = f"""
    WITH {EMB_SQL}, x AS (SELECT vec_id, pos, 8 * v AS v, label FROM e
      UNION ALL SELECT vec_id, 64, CAST(1 AS DOUBLE), label FROM embeddings),
    t AS (SELECT vec_id, CAST(label = 3 AS INTEGER) AS t FROM embeddings)"""


@query("gram_wide", P2_LONG + f"""
    SELECT a.pos AS i, b.pos AS j, {rounded('sum(a.v * b.v)', 6)} AS value
    FROM x a JOIN x b USING (vec_id) GROUP BY a.pos, b.pos
    UNION ALL SELECT pos, 65, {rounded('sum(v * t)', 6)} FROM x JOIN t USING (vec_id) GROUP BY pos""")
def gram_wide(spark, sf_dir):
    return gram_entries(gram(p2(spark, sf_dir), 65, target="label")).withColumn(
        "value", F.round("value", 6))


@query("gram_wide_by_block", P2_LONG + f"""
    SELECT CAST(x.label AS BIGINT) AS label, a.pos AS i, x.pos AS j,
      {rounded('sum(a.v * x.v)', 6)} AS value
    FROM x a JOIN x USING (vec_id) GROUP BY x.label, a.pos, x.pos
    UNION ALL SELECT CAST(label AS BIGINT), pos, 65, CAST(0 AS DOUBLE) FROM x GROUP BY label, pos""")
def gram_wide_by_block(spark, sf_dir):
    rows = p2(spark, sf_dir).drop("label").join(
        embeddings(spark, sf_dir).select("vec_id", "label"), "vec_id")
    grams = gram(rows, 65, by="label", target=None)
    return gram_entries(grams, "label").withColumn("value", F.round("value", 6))


@query("block_gram", f"""
    WITH {EVENTS_SQL}, b AS (SELECT event_id // {HEIGHT} AS block_id, v1, v2, v3 FROM r)
    {gram_sql('b', ['v1', 'v2'], 'v3', 'block_id', digits=6)}""")
def gram_of_blocks(spark, sf_dir):
    grams = block_gram(event_blocks(spark, sf_dir))
    return gram_entries(grams, "block_id").withColumn("value", F.round("value", 6))


@query("inverse_hessian_diag", f"""
    WITH {P1_SQL}, s AS (SELECT x1, x2, 1 / (1 + exp(-(0.5 * x1 - 0.3 * x2))) AS s FROM p1),
    h AS (SELECT sum(s * (1 - s) * x1 * x1) + 2 AS a, sum(s * (1 - s) * x1 * x2) AS b,
      sum(s * (1 - s) * x2 * x2) + 2 AS c FROM s)
    SELECT 0 AS pos, round(c / (a * c - b * b), 12) AS value FROM h
    UNION ALL SELECT 1, round(a / (a * c - b * b), 12) FROM h""")
def hessian_diagonal(spark, sf_dir):
    found = inverse_hessian_diag(p1_training(spark, sf_dir, 2), [0.5, -0.3], 2.0)
    return found.withColumn("value", F.round("value", 12))
