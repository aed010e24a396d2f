"""Losses, gradients and penalty values."""

from __future__ import annotations

from pyspark.sql import functions as F

from optabula.functions.prox import log1p_exp
from optabula.operators import objectives as O

from .fixtures import BLOCKS, EMB_SQL, P1_SQL, P3_SQL, embeddings, p1_training, p2, p3, table
from .matrices import P2_LONG
from .registry import query, rounded

W = [0.5, -0.3, 0.0, 0.1]
U = [0.02, -0.01, 0.03, 0.0]
Z = [0.4, -0.2, 0.1, 0.05]
RHO = 3.0
MARGIN = "(0.5e0 * x1 - 0.3e0 * x2 + 0.1e0)"
SOFTPLUS = "greatest({0}, 0) + ln(1 + exp(-abs({0})))"
LOSS = SOFTPLUS.format(f"((1 - 2 * t) * {MARGIN})")
RESIDUAL = f"(1 / (1 + exp(-{MARGIN})) - t)"
NAMES = ["x1", "x2", "x3", "x4"]


def positions(df, *keys, column="gradient", digits=6):
    exploded = df.select(*keys, F.posexplode(column).alias("pos", "value"))
    return exploded.withColumn("value", F.round("value", digits))


@query("logistic_value_grad", f"""
    WITH {P1_SQL}, s AS (SELECT count(*) AS n_rows, avg({LOSS}) AS loss,
      {', '.join(f'avg({RESIDUAL} * {x}) AS g{i}' for i, x in enumerate(NAMES))} FROM p1)
    {' UNION ALL '.join(f"SELECT n_rows, round(loss, 9) AS loss, {i} AS pos, {rounded(f'g{i}', 9)} AS value FROM s" for i in range(4))}
    """)
def value_grad(spark, sf_dir):
    found = O.logistic_value_grad(p1_training(spark, sf_dir), W)
    return positions(found.withColumn("loss", F.round("loss", 9)), "n_rows", "loss", digits=9)


@query("logistic_value_grad_wide", P2_LONG + f""",
    m AS (SELECT vec_id, sum(v * ((pos * 5) % 7 - 3) / CAST(100 AS DOUBLE)) AS m FROM x GROUP BY vec_id),
    l AS (SELECT count(*) AS n_rows, avg({SOFTPLUS.format('((1 - 2 * t) * m)')}) AS loss FROM m JOIN t USING (vec_id)),
    g AS (SELECT pos, sum((1 / (1 + exp(-m)) - t) * v) / count(*) AS g
      FROM x JOIN m USING (vec_id) JOIN t USING (vec_id) GROUP BY pos)
    SELECT n_rows, round(loss, 9) AS loss, pos, {rounded('g', 9)} AS value FROM g, l""")
def value_grad_wide(spark, sf_dir):
    w = [((i * 5) % 7 - 3) / 100 for i in range(65)]
    found = O.logistic_value_grad(p2(spark, sf_dir), w)
    return positions(found.withColumn("loss", F.round("loss", 9)), "n_rows", "loss", digits=9)


@query("log1p_exp", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
      round(greatest(m, 0) + ln(1 + exp(-abs(m))), 6) AS value
    FROM (SELECT *, (l_extendedprice - 52500) / CAST(40 AS DOUBLE) AS m FROM lineitem) s""")
def softplus(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    margin = (F.col("l_extendedprice") - 52500) / F.lit(40.0)
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        F.round(log1p_exp(margin), 6).alias("value"))


SHIFT = [w + u - z for w, u, z in zip(W, U, Z)]


def augmented_sql(times):
    penalty = RHO / 2 * sum(s * s for s in SHIFT)
    parts = [
        f"SELECT {{keys}}n_rows, round(loss + {times} * CAST({penalty!r} AS DOUBLE), 5) AS value, "
        f"{i} AS pos, {rounded(f'g{i} + {times} * CAST({RHO * SHIFT[i]!r} AS DOUBLE)', 5)} AS gradient FROM s"
        for i in range(4)
    ]
    sums = ", ".join(f"sum({RESIDUAL} * {x}) AS g{i}" for i, x in enumerate(NAMES))
    return sums, " UNION ALL ".join(parts)


def augmented_rows(found, *keys):
    rows = found.withColumn("value", F.round("value", 5)).select(
        *keys, "n_rows", "value", F.posexplode("gradient").alias("pos", "gradient"))
    return rows.withColumn("gradient", F.round("gradient", 5))


@query("augmented_block", f"""
    WITH {P1_SQL}, s AS (SELECT block_id, count(*) AS n_rows, sum({LOSS}) AS loss,
      {augmented_sql('1')[0]} FROM p1 GROUP BY block_id)
    {augmented_sql('1')[1].format(keys='block_id, ')}""")
def augmented_block(spark, sf_dir):
    rows = p1_training(spark, sf_dir)
    return augmented_rows(
        O.augmented_value_grad(rows, W, U, Z, RHO, by="block_id"), "block_id")


@query("augmented_row", f"""
    WITH {P1_SQL}, s AS (SELECT count(*) AS n_rows, sum({LOSS}) AS loss,
      {augmented_sql('n_rows')[0]} FROM p1)
    {augmented_sql('n_rows')[1].format(keys='')}""")
def augmented_row(spark, sf_dir):
    rows = p1_training(spark, sf_dir)
    return augmented_rows(O.augmented_value_grad(rows, W, U, Z, RHO, penalty_per="row"))


@query("augmented_block_wide", P2_LONG + f""",
    m AS (SELECT vec_id, any_value(label) AS block_id, sum(v * ((pos * 5) % 7 - 3) / CAST(100 AS DOUBLE)) AS m
      FROM x GROUP BY vec_id),
    l AS (SELECT block_id, count(*) AS n_rows, sum({SOFTPLUS.format('((1 - 2 * t) * m)')}) AS loss
      FROM m JOIN t USING (vec_id) GROUP BY block_id),
    p AS (SELECT 1.5e0 * sum(power((pos * 5) % 7 - 3, 2)) / 10000 AS penalty FROM (SELECT DISTINCT pos FROM x) q),
    g AS (SELECT block_id, pos, sum((1 / (1 + exp(-m)) - t) * v) AS g
      FROM x JOIN m USING (vec_id) JOIN t USING (vec_id) GROUP BY block_id, pos)
    SELECT CAST(block_id AS BIGINT) AS block_id, n_rows, round(loss + penalty, 6) AS value, pos,
      {rounded('g + 3e0 * ((pos * 5) % 7 - 3) / 100', 6)} AS gradient
    FROM g JOIN l USING (block_id), p""")
def augmented_block_wide(spark, sf_dir):
    w = [((i * 5) % 7 - 3) / 100 for i in range(65)]
    zero = [0.0] * 65
    rows = p2(spark, sf_dir).join(
        embeddings(spark, sf_dir).selectExpr("vec_id", "label AS block_id"), "vec_id")
    found = O.augmented_value_grad(rows, w, zero, zero, RHO, by="block_id")
    rows = found.withColumn("value", F.round("value", 6)).select(
        "block_id", "n_rows", "value", F.posexplode("gradient").alias("pos", "gradient"))
    return rows.withColumn("gradient", F.round("gradient", 6))


@query("logistic_loss", f"""
    WITH {P1_SQL} SELECT count(*) AS n_rows, round(sum({LOSS}), 4) AS loss FROM p1""")
def loss(spark, sf_dir):
    found = O.logistic_loss(p1_training(spark, sf_dir), W)
    return found.withColumn("loss", F.round("loss", 4))


RES3 = "(0.2e0 * x1 - 0.1e0 - b)"


@query("least_squares_value", f"""
    WITH {P3_SQL} SELECT block_id, count(*) AS n_rows, round(sum({RES3} * {RES3}), 5) AS sse,
      round(0.5e0 * sum({RES3} * {RES3}), 5) AS half_sse FROM p3 GROUP BY block_id""")
def squares(spark, sf_dir):
    found = O.least_squares_value(p3(spark, sf_dir), [0.2, -0.1], by="block_id")
    return found.select(
        "block_id", "n_rows", F.round("sse", 5).alias("sse"), F.round("half_sse", 5).alias("half_sse"))


@query("total_value", f"""
    WITH {P1_SQL}, {P3_SQL}
    SELECT 'logistic' AS objective, CAST({BLOCKS} AS BIGINT) AS n_blocks, round(sum({LOSS}), 4) AS value FROM p1
    UNION ALL SELECT 'least_squares', CAST({BLOCKS} AS BIGINT), round(sum({RES3} * {RES3}), 4) FROM p3""")
def total(spark, sf_dir):
    logistic = O.total_value(p1_training(spark, sf_dir), "logistic", W)
    squares = O.total_value(p3(spark, sf_dir), "least_squares", [0.2, -0.1])
    both = logistic.select(F.lit("logistic").alias("objective"), "*").unionByName(
        squares.select(F.lit("least_squares").alias("objective"), "*"))
    return both.withColumn("value", F.round("value", 4))


# Candidate models: one per embedding, small weights set to 0, with a made-up gradient.
RUNS = f"""{EMB_SQL}, runs AS (SELECT vec_id AS run_id, pos,
    CASE WHEN abs(v) < 0.05 THEN CAST(0 AS DOUBLE) ELSE v END AS w,
    v * 3 - CAST(0.1 AS DOUBLE) AS g,
    CASE WHEN pos = 63 THEN CAST(0 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) END AS l1 FROM e)"""


def runs(spark, sf_dir):
    long = embeddings(spark, sf_dir).selectExpr("vec_id AS run_id", "posexplode(v) AS (pos, v)")
    return long.selectExpr(
        "run_id", "pos", "CASE WHEN abs(v) < 0.05D THEN 0D ELSE v END AS w",
        "v * 3D - 0.1D AS g", "CASE WHEN pos = 63 THEN 0D ELSE 0.125D END AS l1")


@query("pseudo_gradient", f"""
    WITH {RUNS} SELECT run_id, pos, {rounded('''CASE WHEN l1 = 0 THEN g
      WHEN w > 0 THEN g + l1 WHEN w < 0 THEN g - l1
      WHEN g - l1 > 0 THEN g - l1 WHEN g + l1 < 0 THEN g + l1 ELSE 0 END''', 9)} AS pseudo_gradient
    FROM runs""")
def pseudo(spark, sf_dir):
    found = O.pseudo_gradient(runs(spark, sf_dir))
    return found.select("run_id", "pos", F.round("pseudo_gradient", 9).alias("pseudo_gradient"))


@query("l1_adjusted_value", f"""
    WITH {RUNS} SELECT run_id, round(7 + sum(abs(l1 * w)), 8) AS value FROM runs GROUP BY run_id""")
def adjusted(spark, sf_dir):
    found = O.l1_adjusted_value(runs(spark, sf_dir).withColumn("smooth", F.lit(7.0)), "smooth")
    return found.withColumn("value", F.round("value", 8))


@query("penalty_value", f"""
    WITH {RUNS}
    SELECT run_id, 'l1' AS kind, round(0.3e0 * sum(abs(w)), 8) AS penalty FROM runs GROUP BY run_id
    UNION ALL SELECT run_id, 'l1_free', round(0.3e0 * sum(abs(w)), 8)
      FROM runs WHERE pos <> 63 GROUP BY run_id
    UNION ALL SELECT run_id, 'elastic_net', round(0.3e0 * sum(abs(w)) + 0.2e0 * sum(w * w), 8)
      FROM runs GROUP BY run_id
    UNION ALL SELECT run_id, 'lower_bound', CAST(0 AS DOUBLE) FROM runs GROUP BY run_id
    UNION ALL SELECT run_id, 'zero', CAST(0 AS DOUBLE) FROM runs GROUP BY run_id""")
def penalties(spark, sf_dir):
    models = runs(spark, sf_dir)
    parts = [
        O.penalty_value(models, kind, 0.3, 0.4, value="w", free_pos=free)
        .select("run_id", F.lit(name).alias("kind"), F.round("penalty", 8).alias("penalty"))
        for name, kind, free in [
            ("l1", "l1", None), ("l1_free", "l1", 63), ("elastic_net", "elastic_net", None),
            ("lower_bound", "lower_bound", None), ("zero", "zero", None)]
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
