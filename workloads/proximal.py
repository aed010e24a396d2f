"""Proximal maps over tables of vectors, and the ADMM and SGD steps as table operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from optabula.functions import prox as P
from optabula.operators.gram import gram
from optabula.operators.proximal import prox_least_squares, prox_zip, sgd_update
from optabula.plans import admm as A

from .fixtures import EMB_SQL, P3_SQL, embeddings, p3, table
from .objectives import RUNS, runs
from .registry import query, rounded

SOFT = "sign({0}) * greatest(abs({0}) - ({1}), 0)"


def long(df, *keys, column="x", digits=9):
    exploded = df.select(*keys, F.posexplode(column).alias("pos", "value"))
    return exploded.withColumn("value", F.round("value", digits))


def emb_query(name, value_sql, column, digits=9):
    """Registers a map over all embeddings against SQL over their long form."""
    sql = f"WITH {EMB_SQL} SELECT vec_id, pos, {rounded(value_sql, digits)} AS value FROM e"

    @query(name, sql)
    def run(spark, sf_dir):
        return long(embeddings(spark, sf_dir).select("vec_id", column(F.col("v")).alias("x")),
                    "vec_id", digits=digits)


@query("prox_soft", f"""
    WITH s AS (SELECT o_orderkey, (o_totalprice - 250000) / CAST(100000 AS DOUBLE) AS v FROM orders)
    SELECT o_orderkey, {rounded(SOFT.format('v', '0.7'), 9)} AS value,
      {rounded(SOFT.format('v', '0'), 9)} AS unchanged FROM s""")
def soft(spark, sf_dir):
    v = (F.col("o_totalprice") - 250000) / F.lit(100000.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(P.soft_threshold(v, 0.7), 9).alias("value"),
        F.round(P.soft_threshold(v, 0.0), 9).alias("unchanged"))


emb_query(
    "prox_l1", f"CASE WHEN pos = 63 THEN v ELSE {SOFT.format('v', '500 * 0.02e0 / 200')} END",
    lambda v: P.prox_l1(v, 0.02, 500, 200.0))
emb_query(
    "prox_elastic_net", f"({SOFT.format('v', '0.2e0 / 4')}) / (1 + 0.5e0 / 4)",
    lambda v: P.prox_elastic_net(v, 0.2, 0.5, 4.0))
emb_query(
    "prox_elastic_net_reference", f"({SOFT.format('v', '0.2e0 / 4')}) / (1 + 0.2e0 * 0.5e0)",
    lambda v: P.prox_elastic_net(v, 0.2, 0.5, 4.0, variant="reference"))
emb_query(
    "prox_lower_bound", "greatest(v, CAST(-0.05 AS DOUBLE))",
    lambda v: P.prox_lower_bound(v, -0.05))
emb_query("prox_zero_set", "CAST(0 AS DOUBLE) * abs(v)", P.prox_zero_set)
emb_query("prox_identity", "v", P.prox_identity)


@query("prox_least_squares", f"""
    WITH {P3_SQL}, s AS (SELECT block_id, sum(x1 * x1) + 50 AS a, sum(x1) AS b, count(*) + 50 AS c,
      sum(x1 * b) + 50 * (block_id / CAST(16 AS DOUBLE) - 0.5e0) AS p, sum(b) + 50 * 0.25e0 AS q
      FROM p3 GROUP BY block_id)
    SELECT block_id, 0 AS pos, {rounded('(c * p - b * q) / (a * c - b * b)', 9)} AS value FROM s
    UNION ALL SELECT block_id, 1, {rounded('(a * q - b * p) / (a * c - b * b)', 9)} FROM s""")
def least_squares(spark, sf_dir):
    grams = gram(p3(spark, sf_dir), 2, by="block_id")
    vectors = p3(spark, sf_dir).select("block_id").distinct().selectExpr(
        "block_id", "array(block_id / 16D - 0.5D, 0.25D) AS v")
    return long(prox_least_squares(grams, vectors, 2, 50.0), "block_id")


@query("prox_zip", f"""
    WITH {EMB_SQL}
    SELECT vec_id AS block_id, pos, {rounded(
        f"CASE WHEN pos = 63 THEN v ELSE {SOFT.format('v', '0.5e0 / (10 + label)')} END", 9)} AS value
    FROM e""")
def zipped(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    blocks = emb.selectExpr("vec_id AS block_id", "CAST(10 + label AS DOUBLE) AS rho")
    vectors = emb.selectExpr("vec_id AS block_id", "v")
    found = prox_zip(blocks, vectors, lambda v, rho: P.prox_l1(v, 0.5, 1.0, rho))
    return long(found, "block_id")


STEP = "(w - 0.6e0 / sqrt(1 + run_id % 50) * g)"


@query("sgd_step", f"""
    WITH {RUNS} SELECT run_id, pos, {rounded(
        f"CASE WHEN pos = 63 THEN {STEP} ELSE {SOFT.format(STEP, '0.6e0 / sqrt(1 + run_id % 50) * 0.3e0')} END", 9)} AS w_new
    FROM runs""")
def step(spark, sf_dir):
    moved = sgd_update(runs(spark, sf_dir), 1 + F.col("run_id") % 50, 0.6, 0.3, 63)
    return moved.select("run_id", "pos", F.round("w_new", 9).alias("w_new"))


# ADMM state: one block per embedding; u, x and xhat are its parts, label is the run.
D = 64
Z = [((i * 5) % 9 - 4) / 50 for i in range(D)]
ZSQL = "(((pos * 5) % 9 - 4) / CAST(50 AS DOUBLE))"
STATE_SQL = f"{EMB_SQL}, s AS (SELECT vec_id AS block_id, label, pos, v / 2 AS u, v AS x, v * 0.9e0 AS xhat FROM e)"


def state(spark, sf_dir):
    return embeddings(spark, sf_dir).selectExpr(
        "vec_id AS block_id", "label", "transform(v, a -> a / 2) AS u", "v AS x",
        "transform(v, a -> a * 0.9D) AS xhat")


@query("admm_dual_update", f"""
    WITH {STATE_SQL}, r AS (SELECT block_id, round(sum((x - {ZSQL}) * (x - {ZSQL})), 9) AS r2 FROM s GROUP BY block_id)
    SELECT block_id, r2, pos, {rounded(f'u + xhat - {ZSQL}', 9)} AS value FROM s JOIN r USING (block_id)""")
def dual_update(spark, sf_dir):
    found = A.admm_dual_update(state(spark, sf_dir), Z)
    return long(found.withColumn("r2", F.round("r2", 9)), "block_id", "r2", column="u")


@query("admm_rescale", f"""
    WITH {STATE_SQL} SELECT block_id, pos, {rounded('u * 5 / (5 + label % 3)', 9)} AS value FROM s""")
def rescale(spark, sf_dir):
    rhos = state(spark, sf_dir).selectExpr("*", "5D AS rho_old", "5D + label % 3 AS rho_new")
    return long(A.admm_rescale_columns(rhos, "rho_old", "rho_new"), "block_id", column="u")


@query("admm_relax", f"""
    WITH {STATE_SQL} SELECT block_id, pos, {rounded(f'1.5e0 * x - 0.5e0 * {ZSQL}', 9)} AS value FROM s""")
def relax(spark, sf_dir):
    return long(A.admm_relax(state(spark, sf_dir), Z, 1.5), "block_id", column="xhat")


@query("admm_consensus", f"""
    WITH {STATE_SQL}, r AS (SELECT block_id, label, sum((x - {ZSQL}) * (x - {ZSQL})) AS r2 FROM s GROUP BY ALL),
    n AS (SELECT label, count(*) AS n_blocks, round(sqrt(sum(r2)), 8) AS r FROM r GROUP BY label),
    m AS (SELECT label, pos, avg(u + xhat - {ZSQL}) AS u, avg(xhat) AS x FROM s GROUP BY label, pos)
    SELECT label, n_blocks, r, pos, {rounded('u', 8)} AS u_mean, {rounded('x', 8)} AS x_mean,
      {rounded(f"CASE WHEN pos = 63 THEN u + x ELSE {SOFT.format('(u + x)', '0.01')} END", 8)} AS z
    FROM m JOIN n USING (label)""")
def consensus(spark, sf_dir):
    updated = A.admm_dual_update(state(spark, sf_dir), Z)
    means = A.admm_consensus(updated, "label")
    z = F.when(F.col("pos") == 63, F.col("v")).otherwise(P.soft_threshold(F.col("v"), 0.01))
    return means.select(
        "label", "n_blocks", F.round("r", 8).alias("r"), "pos", F.round("u_mean", 8).alias("u_mean"),
        F.round("x_mean", 8).alias("x_mean"), F.round(z, 8).alias("z"))


# A trace-shaped table: one row per event.
TRACE_COLUMNS = """event_id, user_id, CAST(4 + user_id % 5 AS BIGINT) AS n_blocks, CAST(3 AS BIGINT) AS d,
    CAST(1 + event_id % 7 AS DOUBLE) AS rho, CAST(value AS DOUBLE) AS norm_x, value * 2 AS norm_z,
    value / 3 AS norm_u, value / (1 + event_id % 13) AS norm_dz, value / (1 + event_id % 17) AS primal_residual"""
DUAL = "rho * sqrt(n_blocks) * norm_dz"


def trace_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    columns = TRACE_COLUMNS.replace("\n", " ").split(", ")
    return rows.selectExpr(*columns)


@query("admm_residuals", f"""
    WITH t AS (SELECT {TRACE_COLUMNS} FROM events), s AS (SELECT event_id, primal_residual, {DUAL} AS dual,
      sqrt(d) * 0.5e0 + 0.25e0 * greatest(norm_x, norm_z) AS pt, sqrt(d) * 0.5e0 + rho * 0.25e0 * norm_u AS dt FROM t)
    SELECT event_id, round(pt, 9) AS primal_tol, round(dt, 9) AS dual_tol, round(dual, 9) AS dual_residual,
      primal_residual <= pt AND dual <= dt AS stop FROM s""")
def residuals(spark, sf_dir):
    found = A.admm_residuals(trace_rows(spark, sf_dir), 0.5, 0.25)
    return found.select(
        "event_id", *[F.round(c, 9).alias(c) for c in ("primal_tol", "dual_tol", "dual_residual")],
        "stop")


@query("admm_next_rho", f"""
    WITH t AS (SELECT {TRACE_COLUMNS} FROM events), s AS (SELECT *, {DUAL} AS dual FROM t)
    SELECT event_id, CASE WHEN primal_residual > 1.5e0 * dual THEN rho * 2
      WHEN 1.5e0 * primal_residual < dual THEN rho / 2 ELSE rho END AS next_rho FROM s""")
def next_rho(spark, sf_dir):
    found = A.admm_residuals(trace_rows(spark, sf_dir), 0.5, 0.25)
    return A.admm_next_rho(found, 2.0, 1.5).select("event_id", "next_rho")


@query("admm_inner_tol", f"""
    WITH t AS (SELECT {TRACE_COLUMNS} FROM events)
    SELECT event_id, round(greatest({DUAL} + primal_residual, 30), 9) AS inner_tol FROM t""")
def inner_tol(spark, sf_dir):
    found = A.admm_residuals(trace_rows(spark, sf_dir), 0.5, 0.25)
    return A.admm_inner_tol(found, 30.0).select(
        "event_id", F.round("inner_tol", 9).alias("inner_tol"))
