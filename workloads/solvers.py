"""Fits over whole tables, checked against SQL recursions that reach the same iterates or optimum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from optabula.cluster import shared_path
from optabula.functions.prep import training_rows
from optabula.kernels import huber_objective, least_squares_objective
from optabula.operators.blocks import fold_blocks, fold_labeled_blocks, mirror_noise, to_blocks
from optabula.operators.gram import block_gram, gram
from optabula.operators.objectives import batch_of, logistic_value_grad
from optabula.operators.report import compare_methods, time_to_tolerance
from optabula.plans import admm as A
from optabula.plans.ml_baseline import ml_logistic
from optabula.plans.penalties import Penalty
from optabula.plans.quasi_newton import lbfgs, lbfgs_by_segment, owlqn, owlqn_path
from optabula.plans.sgd import sgd, sgd_grid
from optabula.plans.sweep import Problem, run_sweep, summaries, sweep, union_all
from optabula.plans.trace import iteration_times
from optabula.sources.binary import read_binary_blocks, read_binary_rows
from optabula.sources.tables import read_csv_matrix, write_trace

from .fixtures import (
    P1_SQL,
    P3_SQL,
    P4_COLUMNS,
    P4_SQL,
    p1,
    p1_training,
    p2,
    p3,
    p4,
    table,
    write_binary,
)
from .prep import mirror_sql
from .registry import query, rounded

NAMES = ("x1", "x2", "x3", "x4")
DIGITS = 5
# Enough for optimum coefficients to 1e-7 on the fixtures.
ADMM = {"alpha": 1.8, "abstol": 1e-5, "reltol": 1e-9, "max_iter": 100}


def recursion(update, steps, size, names=NAMES, extra=""):
    """CTE it(k, w0..): iterates of w <- update(w, gradient, step size) on the mean loss of p1.

    ``update`` maps (i, moved, size) to SQL, moved being the plain gradient step.
    """
    d = range(len(names))
    margin = " + ".join(f"w{i} * {x}" for i, x in enumerate(names))
    grads = ", ".join(f"avg((1 / (1 + exp(-m)) - t) * {x}) AS g{i}" for i, x in enumerate(names))
    held = ", ".join(f"any_value(w{i}) AS w{i}" for i in d)
    news = ", ".join(f"{update(i, f'(w{i} - ({size}) * g{i})', size)}" for i in d)
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in d)
    ws = ", ".join(f"w{i}" for i in d)
    return f"""it AS (SELECT 0 AS k, {zeros} UNION ALL
      SELECT k, {news} FROM (SELECT k + 1 AS k, {held}, {grads} FROM
        (SELECT k, {ws}, t, {', '.join(names)}, {margin} AS m FROM it, p1 WHERE k < {steps}) r
        GROUP BY k) s)"""


def plain(i, moved, size):
    return moved


def soft(lam, intercept=3):
    def update(i, moved, size):
        if i == intercept:
            return moved
        return f"sign({moved}) * greatest(abs({moved}) - ({size}) * {lam}, 0)"

    return update


def elastic(lam, gamma):
    def update(i, moved, size):
        if i == 3:
            return moved
        return f"({soft(lam)(i, moved, size)}) / (1 + ({size}) * {gamma})"

    return update


def bounded(threshold):
    return lambda i, moved, size: f"greatest({moved}, CAST({threshold} AS DOUBLE))"


def last_iterate(cte, steps, digits=DIGITS, d=4):
    parts = [
        f"SELECT {i} AS pos, {rounded(f'w{i}', digits)} AS weight, {str(i == d - 1).lower()} AS is_intercept "
        f"FROM it WHERE k = {steps}"
        for i in range(d)
    ]
    return f"WITH RECURSIVE {P1_SQL}, {cte} " + " UNION ALL ".join(parts)


def optimum(update, steps=80, digits=DIGITS):
    return last_iterate(recursion(update, steps, "4e0"), steps, digits)


def model(fit, digits=DIGITS):
    return fit.model.withColumn("weight", F.round("weight", digits))


@query("lbfgs_optimum", optimum(plain))
def lbfgs_optimum(spark, sf_dir):
    return model(lbfgs(p1_training(spark, sf_dir)))


@query("owlqn_optimum", optimum(soft("0.02e0")))
def owlqn_optimum(spark, sf_dir):
    return model(owlqn(p1_training(spark, sf_dir), 0.02))


@query("ml_logistic", optimum(soft("0.02e0")))
def ml_optimum(spark, sf_dir):
    return model(ml_logistic(p1_training(spark, sf_dir), reg=0.02, tol=1e-12))


def p1_blocks(spark, sf_dir):
    return to_blocks(fold_blocks(p1_training(spark, sf_dir)), 4096, 4)


@query("admm_logistic", optimum(plain))
def admm_logistic(spark, sf_dir):
    return model(A.admm_logistic(p1_blocks(spark, sf_dir), **ADMM))


@query("admm_lasso", optimum(soft("0.02e0")))
def admm_lasso(spark, sf_dir):
    return model(A.admm_logistic(p1_blocks(spark, sf_dir), prox=Penalty("l1", 0.02), **ADMM))


@query("admm_elastic_net", optimum(elastic("0.02e0", "0.05e0")))
def admm_elastic_net(spark, sf_dir):
    penalty = Penalty("elastic_net", 0.02, gamma=0.05)
    return model(A.admm_logistic(p1_blocks(spark, sf_dir), prox=penalty, **ADMM))


@query("admm_lower_bound", optimum(bounded("-0.25")))
def admm_lower_bound(spark, sf_dir):
    penalty = Penalty("lower_bound", threshold=-0.25)
    return model(A.admm_logistic(p1_blocks(spark, sf_dir), prox=penalty, **ADMM))


@query("admm_adaptive_rho", optimum(plain, digits=4))
def admm_adaptive(spark, sf_dir):
    """Starts from a rho far too large and lets the residuals adapt it."""
    fit = A.admm_logistic(
        p1_blocks(spark, sf_dir), rho=4000.0, factor=1.5, mu=10.0, alpha=1.8, abstol=1e-6,
        reltol=1e-9, max_iter=100)
    return model(fit, 4)


@query("admm_least_squares", f"""
    WITH {P3_SQL}
    SELECT 0 AS pos, {rounded('regr_slope(b, x1)', 6)} AS weight, false AS is_intercept FROM p3
    UNION ALL SELECT 1, {rounded('regr_intercept(b, x1)', 6)}, true FROM p3""")
def admm_least_squares(spark, sf_dir):
    grams = gram(p3(spark, sf_dir), 2, by="block_id")
    fit = A.admm_least_squares(grams, alpha=1.8, abstol=1e-4, reltol=1e-9, max_iter=100)
    return model(fit, 6)


def p3_optimum(update, steps=400):
    """Proximal gradient on half the mean squared residual, from the 2 x 2 moments of p3."""
    moved = ["(w0 - 0.5e0 * (a * w0 + m * w1 - c))", "(w1 - 0.5e0 * (m * w0 + w1 - d))"]
    new = ", ".join(f"{update(i, moved[i])}" for i in range(2))
    return f"""
    WITH RECURSIVE {P3_SQL}, g AS MATERIALIZED (SELECT avg(x1 * x1) AS a, avg(x1) AS m, avg(x1 * b) AS c, avg(b) AS d FROM p3),
    it AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1 UNION ALL
      SELECT k + 1, {new} FROM it, g WHERE k < {steps})
    SELECT 0 AS pos, {rounded('w0', 6)} AS weight, false AS is_intercept FROM it WHERE k = {steps}
    UNION ALL SELECT 1, {rounded('w1', 6)}, true FROM it WHERE k = {steps}"""


def p3_soft(lam, gamma="0e0"):
    return lambda i, v: v if i == 1 else (
        f"sign({v}) * greatest(abs({v}) - 0.5e0 * {lam}, 0) / (1 + 0.5e0 * {gamma})")


def p3_fit(spark, sf_dir, prox):
    grams = gram(p3(spark, sf_dir), 2, by="block_id")
    return A.admm_least_squares(
        grams, alpha=1.8, abstol=1e-5, reltol=1e-9, max_iter=150, prox=prox)


@query("admm_least_squares_bound", p3_optimum(lambda i, v: f"greatest({v}, 0.25e0)"))
def admm_least_squares_bound(spark, sf_dir):
    """Least squares with a lower bound on every coefficient."""
    return model(p3_fit(spark, sf_dir, Penalty("lower_bound", threshold=0.25)), 6)


@query("admm_least_squares_lasso", p3_optimum(p3_soft("0.1e0")))
def admm_least_squares_lasso(spark, sf_dir):
    return model(p3_fit(spark, sf_dir, Penalty("l1", 0.1)), 6)


@query("admm_least_squares_elastic_net", p3_optimum(p3_soft("0.1e0", "0.2e0")))
def admm_least_squares_elastic_net(spark, sf_dir):
    return model(p3_fit(spark, sf_dir, Penalty("elastic_net", 0.1, gamma=0.2)), 6)


# The trace of a consensus fit: blocks of p3 have closed-form solutions, so SQL can run the
# method itself and reach the same iterates, residuals and tolerances.
TRACE_STEPS, TRACE_RHO, TRACE_ALPHA = 6, 40.0, 1.6


def admm_trace_sql(residual="current"):
    gap = "z" if residual == "current" else "pz"
    held = "x" if residual == "current" else "px"
    return f"""
    WITH RECURSIVE {P3_SQL},
    g AS MATERIALIZED (SELECT block_id, count(*) AS n, sum(x1 * x1) + {TRACE_RHO}e0 AS a, sum(x1) AS m,
      count(*) + {TRACE_RHO}e0 AS e, sum(x1 * b) AS c, sum(b) AS d FROM p3 GROUP BY block_id),
    it AS (SELECT block_id, 0 AS k, 0e0 AS u0, 0e0 AS u1, 0e0 AS x0, 0e0 AS x1, 0e0 AS h0, 0e0 AS h1,
        0e0 AS z0, 0e0 AS z1, 0e0 AS pz0, 0e0 AS pz1, 0e0 AS px0, 0e0 AS px1 FROM g
      UNION ALL
      SELECT block_id, k, u0, u1, x0, x1, h0, h1, avg(u0 + h0) OVER (), avg(u1 + h1) OVER (), z0, z1, px0, px1
      FROM (SELECT *, {TRACE_ALPHA}e0 * x0 + (1 - {TRACE_ALPHA}e0) * z0 AS h0,
          {TRACE_ALPHA}e0 * x1 + (1 - {TRACE_ALPHA}e0) * z1 AS h1
        FROM (SELECT block_id, k, u0, u1, z0, z1, px0, px1,
            (e * (c + {TRACE_RHO}e0 * (z0 - u0)) - m * (d + {TRACE_RHO}e0 * (z1 - u1))) / (a * e - m * m) AS x0,
            (a * (d + {TRACE_RHO}e0 * (z1 - u1)) - m * (c + {TRACE_RHO}e0 * (z0 - u0))) / (a * e - m * m) AS x1
          FROM (SELECT block_id, k + 1 AS k, u0 + h0 - z0 AS u0, u1 + h1 - z1 AS u1, z0, z1, x0 AS px0, x1 AS px1
            FROM it WHERE k < {TRACE_STEPS}) s JOIN g USING (block_id)) q) r),
    t AS (SELECT k, any_value(z0) AS z0, any_value(z1) AS z1, count(*) AS n_blocks,
        sqrt(sum(power({held}0 - {gap}0, 2) + power({held}1 - {gap}1, 2))) AS primal,
        {TRACE_RHO}e0 * sqrt(count(*)) * sqrt(power(any_value(z0 - pz0), 2) + power(any_value(z1 - pz1), 2)) AS dual,
        sqrt(2e0) * 1e-4 + 1e-3 * greatest(sqrt(power(avg(h0), 2) + power(avg(h1), 2)),
          sqrt(power(any_value(z0), 2) + power(any_value(z1), 2))) AS primal_tol,
        sqrt(2e0) * 1e-4 + {TRACE_RHO}e0 * 1e-3 * sqrt(power(avg(u0), 2) + power(avg(u1), 2)) AS dual_tol
      FROM it WHERE k > 0 GROUP BY k)
    SELECT k AS iteration, {TRACE_RHO}e0 AS rho, {rounded('primal', 6)} AS primal_residual,
      {rounded('dual', 6)} AS dual_residual, {rounded('primal_tol', 8)} AS primal_tol,
      {rounded('dual_tol', 7)} AS dual_tol, CAST(0 AS DOUBLE) AS unsolved_blocks,
      (SELECT {rounded('avg(power(p3.b - z0 * p3.x1 - z1, 2)) / 2', 7)} FROM p3) AS objective
    FROM t"""


def admm_trace_query(residual, stopped_after=None):
    """The trace of one fit, or of one that stopped early and went on from its journal."""
    def run(spark, sf_dir):
        grams = gram(p3(spark, sf_dir), 2, by="block_id")
        options = {"rho": TRACE_RHO, "alpha": TRACE_ALPHA, "abstol": 1e-4, "reltol": 1e-3, "residual": residual}
        if stopped_after:
            options["journal"] = shared_path(spark, "journal")
            A.admm_least_squares(grams, max_iter=stopped_after, **options)
        fit = A.admm_least_squares(grams, max_iter=TRACE_STEPS, **options)
        places = {"primal_residual": 6, "dual_residual": 6, "primal_tol": 8, "dual_tol": 7, "objective": 7}
        return fit.trace.select("iteration", "rho", "unsolved_blocks", *[
            F.round(name, digits).alias(name) for name, digits in places.items()])

    return run


query("admm_trace", admm_trace_sql())(admm_trace_query("current"))
query("admm_trace_lagged", admm_trace_sql("lagged"))(admm_trace_query("lagged"))
query("admm_trace_resumed", admm_trace_sql())(admm_trace_query("current", 3))


# A consensus fit whose blocks get one Newton step in each iteration: many stay unsolved at first.
ONE_STEP = {"rho": 40.0, "inner_tol": 0.05, "steps": 7}


def one_step_sql():
    rho, tol, steps = f"{ONE_STEP['rho']}e0", f"{ONE_STEP['inner_tol']}e0", ONE_STEP["steps"]
    margin = "1 / (1 + exp(-(x0 * x1 + y0 * x2)))"  # x0, y0 the model of a block; x1, x2 a row
    kept = ", ".join(f"any_value({c}) AS {c}" for c in ("u0", "v0", "x0", "y0", "z0", "w0"))
    return f"""
    WITH RECURSIVE {P4_SQL}, b AS MATERIALIZED (SELECT event_id // 500 AS block_id, x1, x2, t FROM p1),
    it AS (SELECT DISTINCT block_id, 0 AS k, 0e0 AS u0, 0e0 AS v0, 0e0 AS x0, 0e0 AS y0, 0e0 AS z0, 0e0 AS w0,
        0e0 AS pz, 0e0 AS pw, 0 AS n FROM b
      UNION ALL
      SELECT block_id, k, u0, v0, x0, y0, avg(u0 + x0) OVER (), avg(v0 + y0) OVER (), z0, w0, n
      FROM (SELECT block_id, k, u0, v0, z0, w0, CAST(g * g + h * h > {tol} * {tol} AS INTEGER) AS n,
          x0 - CASE WHEN g * g + h * h > {tol} * {tol} THEN (c * g - e * h) / (a * c - e * e) ELSE 0 END AS x0,
          y0 - CASE WHEN g * g + h * h > {tol} * {tol} THEN (a * h - e * g) / (a * c - e * e) ELSE 0 END AS y0
        FROM (SELECT block_id, k, {kept}, sum(s * (1 - s) * x1 * x1) + {rho} AS a, sum(s * (1 - s) * x1 * x2) AS e,
            sum(s * (1 - s) * x2 * x2) + {rho} AS c,
            sum((s - t) * x1) + {rho} * any_value(x0 - z0 + u0) AS g, sum((s - t) * x2) + {rho} * any_value(y0 - w0 + v0) AS h
          FROM (SELECT i.*, x1, x2, t, {margin} AS s
            FROM (SELECT block_id, k + 1 AS k, u0 + x0 - z0 AS u0, v0 + y0 - w0 AS v0, x0, y0, z0, w0
              FROM it WHERE k < {steps}) i JOIN b USING (block_id)) r GROUP BY block_id, k) q) p),
    left_over AS (SELECT block_id, k, any_value(z0) AS z0, any_value(w0) AS w0, any_value(n) AS n,
        sqrt(power(sum((s - t) * x1) + {rho} * any_value(x0 - pz + u0), 2)
          + power(sum((s - t) * x2) + {rho} * any_value(y0 - pw + v0), 2)) AS size
      FROM (SELECT it.*, x1, x2, t, {margin} AS s FROM it JOIN b USING (block_id) WHERE k > 0) r GROUP BY block_id, k)
    SELECT k AS iteration, CAST(sum(n) AS INTEGER) AS n_eval, CAST(count(*) FILTER (size > {tol}) AS DOUBLE) AS unsolved_blocks,
      {rounded('any_value(z0)', 7)} AS w0, {rounded('any_value(w0)', 7)} AS w1 FROM left_over GROUP BY k"""


@query("admm_unsolved", one_step_sql())
def admm_unsolved(spark, sf_dir):
    """Blocks that are not within the inner tolerance after an iteration's step, and steps taken."""
    folded = p4(spark, sf_dir).selectExpr(
        "event_id", "transform(slice(values, 1, 2), v -> -values[2] * v) AS values")
    blocks = to_blocks(folded, 500, 2, pos="event_id")
    fit = A.admm_logistic(
        blocks, durable=True, rho=ONE_STEP["rho"], inner_tol=ONE_STEP["inner_tol"], inner_steps=1,
        max_iter=ONE_STEP["steps"], abstol=1e-12, reltol=1e-12)
    return fit.trace.selectExpr(
        "iteration", "n_eval", "unsolved_blocks", "round(model[0], 7) AS w0", "round(model[1], 7) AS w1")


# Single local solves: per block argmin of sum loss + rho/2 |x + u - z|^2, by SQL Newton.
LOCAL_RHO, LOCAL_HEIGHT = 30.0, 500
LOCAL_SQL = f"""
    WITH RECURSIVE {P4_SQL}, b AS (SELECT event_id // {LOCAL_HEIGHT} AS block_id, * FROM p1),
    it AS (SELECT DISTINCT block_id, 0 AS k, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1 FROM b
      UNION ALL
      SELECT block_id, k, w0 - (c * g - b * h) / (a * c - b * b), w1 - (a * h - b * g) / (a * c - b * b)
      FROM (SELECT block_id, k + 1 AS k, any_value(w0) AS w0, any_value(w1) AS w1,
          sum(s * (1 - s) * x1 * x1) + {LOCAL_RHO} AS a, sum(s * (1 - s) * x1 * x2) AS b,
          sum(s * (1 - s) * x2 * x2) + {LOCAL_RHO} AS c,
          sum((s - t) * x1) + {LOCAL_RHO} * (any_value(w0) + block_id % 7 / CAST(100 AS DOUBLE) - 0.3e0) AS g,
          sum((s - t) * x2) + {LOCAL_RHO} * (any_value(w1) - 0.05e0 + 0.2e0) AS h
        FROM (SELECT it.block_id, k, w0, w1, x1, x2, t, 1 / (1 + exp(-(w0 * x1 + w1 * x2))) AS s
          FROM it JOIN b ON it.block_id = b.block_id WHERE k < 9) r GROUP BY block_id, k) q)
    SELECT block_id, {rounded('w0', 8)} AS w0, {rounded('w1', 8)} AS w1, true AS solved FROM it WHERE k = 9"""


@query("admm_local_solve", LOCAL_SQL)
def local_solve(spark, sf_dir):
    """Blocks are placed by event_id, so none holds more than LOCAL_HEIGHT rows."""
    folded = p4(spark, sf_dir).selectExpr(
        "event_id", "transform(slice(values, 1, 2), v -> -values[2] * v) AS values")
    blocks = to_blocks(folded, LOCAL_HEIGHT, 2, pos="event_id")
    state = blocks.selectExpr(
        "block_id", "array(block_id % 7 / 100D, -0.05D) AS u", "array(0D, 0D) AS x")
    solved = A.admm_local_solve(blocks, state, [0.3, -0.2], LOCAL_RHO, 1e-9)
    return solved.selectExpr(
        "block_id", "round(x[0], 8) AS w0", "round(x[1], 8) AS w1", "grad_norm < 1e-6 AS solved")


# Fits that start from files and matrices.

P4_NAMES = ("x1", "x2", "x3")


def p4_optimum(steps=120):
    cte = recursion(plain, steps, "4e0", P4_NAMES)
    return last_iterate(cte, steps, d=3).replace(P1_SQL, P4_SQL)


@query("lbfgs_from_binary", p4_optimum())
def lbfgs_from_binary(spark, sf_dir):
    """Binary rows -> recoded labels and intercept -> quasi-Newton fit."""
    path = shared_path(spark, "rows")
    write_binary(p4(spark, sf_dir), "values", path)
    return model(lbfgs(training_rows(read_binary_rows(spark, path, 3))))


@query("admm_from_binary_blocks", p4_optimum())
def admm_from_binary_blocks(spark, sf_dir):
    """Binary records -> blocks, the last one short -> sign-folded blocks -> consensus fit."""
    path = shared_path(spark, "blocks")
    write_binary(p4(spark, sf_dir), "values", path)
    blocks = fold_labeled_blocks(read_binary_blocks(spark, path, 470, 3))
    return model(A.admm_logistic(blocks, **ADMM))


CSV_TARGET = "0.4e0 * x1 - 0.7e0 * x2 + 0.25e0 * x3 + 0.3e0 * y"


def csv_optimum(steps=600):
    """Gradient descent on half the mean squared residual, from the 3 x 3 moments of the rows."""
    names, target = ("x1", "x2", "x3"), f"({CSV_TARGET})"
    moments = ", ".join([f"avg({a} * {b}) AS a{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names)]
                        + [f"avg({a} * {target}) AS c{i}" for i, a in enumerate(names)])
    new = ", ".join(f"w{i} - 0.4e0 * (a{i}0 * w0 + a{i}1 * w1 + a{i}2 * w2 - c{i}) AS w{i}" for i in range(3))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, {rounded(f'w{i}', 6)} AS weight, {str(i == 2).lower()} AS is_intercept "
        f"FROM it WHERE k = {steps}" for i in range(3))
    return f"""
    WITH RECURSIVE {P1_SQL}, g AS MATERIALIZED (SELECT {moments} FROM p1),
    it AS (SELECT 0 AS k, 0e0 AS w0, 0e0 AS w1, 0e0 AS w2 UNION ALL
      SELECT k + 1, {new} FROM it, g WHERE k < {steps}) {rows}"""


@query("admm_from_csv", csv_optimum())
def admm_from_csv(spark, sf_dir):
    """CSV matrix with a noisy target in its last column -> grams of blocks -> least-squares consensus."""
    path = shared_path(spark, "csv")
    p1(spark, sf_dir).selectExpr("x1", "x2", "x3", CSV_TARGET.replace("e0", "D")).write.csv(path)
    grams = block_gram(to_blocks(read_csv_matrix(spark, path, 4), 2000, 4))
    return model(A.admm_least_squares(grams, alpha=1.8, abstol=1e-6, reltol=1e-10, max_iter=300), 6)


MIRROR_MODEL = (1.0, -0.8, 0.5, 0.1)
MIRROR_COLUMNS = [*P4_COLUMNS.values(), "(event_id * 104729 % 97) / CAST(48 AS DOUBLE) - 1"]


def mirror_optimum(steps=120):
    """Elastic net on the labelled rows of the mirror rule."""
    names = "f0 AS x1, f1 AS x2, f2 AS x3, 1e0 AS x4, (label + 1) / 2 AS t"
    rows = ", ".join(f"{sql} AS v{i + 1}" for i, sql in enumerate(MIRROR_COLUMNS))
    noised = mirror_sql(500, MIRROR_MODEL, f"r AS (SELECT event_id, {rows} FROM events)")
    return last_iterate(recursion(elastic("0.01e0", "0.1e0"), steps, "3e0"), steps).replace(
        P1_SQL, f"p1 AS MATERIALIZED (SELECT {names} FROM ({noised}) m)")


@query("admm_mirror_from_csv", mirror_optimum())
def admm_mirror_from_csv(spark, sf_dir):
    """CSV matrix -> numbered rows -> mirror noise and labels -> blocks, bucketed -> consensus fit."""
    path = shared_path(spark, "csv")
    table(spark, sf_dir, "events").selectExpr("CAST(event_id AS DOUBLE)", *MIRROR_COLUMNS).write.csv(path)
    numbered = read_csv_matrix(spark, path, 4).selectExpr(
        "CAST(values[0] AS BIGINT) DIV 500 AS block_id", "CAST(values[0] AS BIGINT) % 500 AS pos",
        "concat(slice(values, 2, 3), array(1D)) AS features")
    noised = mirror_noise(numbered, MIRROR_MODEL, 500).selectExpr(
        "block_id * 500 + pos AS row", "features AS values")
    blocks = fold_labeled_blocks(to_blocks(noised, 500, 4, pos="row"))
    penalty = Penalty("elastic_net", 0.01, gamma=0.1)
    return model(A.admm_logistic(blocks, durable=True, prox=penalty, **ADMM))


@query("lbfgs_least_squares", p3_optimum(lambda i, v: v))
def lbfgs_least_squares(spark, sf_dir):
    """Quasi-Newton on an objective given as a function."""
    return model(lbfgs(p3(spark, sf_dir), label="target", objective=least_squares_objective), 6)


@query("owlqn_least_squares", p3_optimum(p3_soft("0.1e0")))
def owlqn_least_squares(spark, sf_dir):
    return model(owlqn(
        p3(spark, sf_dir), 0.1, label="target", objective=least_squares_objective), 6)


HUBER = 0.5


def huber_optimum(steps=300):
    """Gradient descent on the mean Huber loss of p3: a pass over the rows in each step."""
    clipped = f"greatest(least(w0 * x1 + w1 - b, {HUBER}e0), -{HUBER}e0)"
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, {rounded(f'w{i}', 6)} AS weight, {str(i == 1).lower()} AS is_intercept "
        f"FROM it WHERE k = {steps}" for i in range(2))
    return f"""
    WITH RECURSIVE {P3_SQL}, it AS (SELECT 0 AS k, 0e0 AS w0, 0e0 AS w1 UNION ALL
      SELECT k + 1, any_value(w0) - avg({clipped} * x1), any_value(w1) - avg({clipped})
      FROM it, p3 WHERE k < {steps} GROUP BY k) {rows}"""


@query("lbfgs_huber", huber_optimum())
def lbfgs_huber(spark, sf_dir):
    """A robust fit: the user's own loss, linear for large residuals."""
    return model(lbfgs(p3(spark, sf_dir), label="target", objective=huber_objective(HUBER)), 6)


@query("sgd_least_squares", f"""
    WITH RECURSIVE {P3_SQL}, it AS (SELECT 0 AS k, 0e0 AS w0, 0e0 AS w1 UNION ALL
      SELECT k + 1, greatest(any_value(w0) - 0.4e0 / sqrt(k + 1) * avg((w0 * x1 + w1 - b) * x1), 0.25e0),
        greatest(any_value(w1) - 0.4e0 / sqrt(k + 1) * avg(w0 * x1 + w1 - b), 0.25e0)
      FROM it, p3 WHERE k < 6 GROUP BY k)
    SELECT k AS iteration, 0 AS pos, {rounded('w0', 8)} AS weight FROM it WHERE k > 0
    UNION ALL SELECT k, 1, {rounded('w1', 8)} FROM it WHERE k > 0""")
def sgd_least_squares(spark, sf_dir):
    """Gradient descent with an objective and an updater given as functions."""
    fit = sgd(p3(spark, sf_dir), step=0.4, iters=6, label="target", objective=least_squares_objective,
              updater=lambda w, size: np.maximum(w, 0.25))
    return trace_rows(fit.trace)


PER_COORDINATE = [0.02, 0.0, 0.05, 0.01]


@query("owlqn_per_coordinate", optimum(
    lambda i, moved, size: f"sign({moved}) * greatest(abs({moved}) - ({size}) * {PER_COORDINATE[i]}e0, 0)"))
def owlqn_per_coordinate(spark, sf_dir):
    """A penalty weight of its own for every coordinate, the intercept included."""
    return model(owlqn(p1_training(spark, sf_dir), PER_COORDINATE))


PATH = [0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32]


def path_sql(steps=80):
    ctes, rows = [], []
    for n, lam in enumerate(PATH):
        ctes.append(recursion(soft(f"{lam!r}e0"), steps, "4e0").replace("it AS", f"it{n} AS", 1)
                    .replace("FROM it, p1", f"FROM it{n}, p1"))
        rows += [f"SELECT CAST({lam!r} AS DOUBLE) AS l1, {i} AS pos, {rounded(f'w{i}', DIGITS)} AS weight, "
                 f"{str(i == 3).lower()} AS is_intercept FROM it{n} WHERE k = {steps}" for i in range(4)]
    return f"WITH RECURSIVE {P1_SQL}, {', '.join(ctes)} " + " UNION ALL ".join(rows)


@query("owlqn_path", path_sql())
def owlqn_path_query(spark, sf_dir):
    """A regularization path of eight weights, advanced by shared scans."""
    found = owlqn_path(p1_training(spark, sf_dir), PATH).models("l1")
    return found.withColumn("weight", F.round("weight", DIGITS))


def segments_sql(steps=150):
    d = range(4)
    margin = " + ".join(f"w{i} * {x}" for i, x in enumerate(NAMES))
    grads = ", ".join(f"avg((1 / (1 + exp(-m)) - t) * {x}) AS g{i}" for i, x in enumerate(NAMES))
    held, ws = ", ".join(f"any_value(w{i}) AS w{i}" for i in d), ", ".join(f"w{i}" for i in d)
    rows = " UNION ALL ".join(
        f"SELECT CAST(segment AS BIGINT) AS segment, {i} AS pos, {rounded(f'w{i}', 4)} AS weight, "
        f"{str(i == 3).lower()} AS is_intercept FROM it WHERE k = {steps}" for i in d)
    return f"""
    WITH RECURSIVE {P1_SQL}, it AS (SELECT DISTINCT block_id AS segment, 0 AS k,
        {", ".join(f"0e0 AS w{i}" for i in d)} FROM p1
      UNION ALL SELECT segment, k, {", ".join(f"w{i} - 4e0 * g{i}" for i in d)} FROM (
        SELECT segment, k + 1 AS k, {held}, {grads} FROM (
          SELECT segment, k, {ws}, t, {', '.join(NAMES)}, {margin} AS m
          FROM it JOIN p1 ON block_id = segment WHERE k < {steps}) r GROUP BY segment, k) s) {rows}"""


@query("lbfgs_by_segment", segments_sql())
def lbfgs_by_segment_query(spark, sf_dir):
    """One model for each of 16 segments, advanced by shared scans."""
    found = lbfgs_by_segment(p1_training(spark, sf_dir), "block_id").models("segment")
    return found.withColumn("weight", F.round("weight", 4))


SGD_STEPS = 5


def sgd_size(step):
    return f"{step} / sqrt(k)"


def iterates(lam, steps, name="lam"):
    return recursion(soft(lam), steps, sgd_size("0.6e0"))


def iterate_rows(columns, steps):
    return " UNION ALL ".join(
        f"SELECT {columns}k AS iteration, {i} AS pos, {rounded(f'w{i}', 8)} AS weight FROM it WHERE k > 0"
        for i in range(4))


def trace_rows(trace, *keys):
    rows = trace.select(*keys, "iteration", F.posexplode("model").alias("pos", "weight"))
    return rows.withColumn("weight", F.round("weight", 8))


@query("sgd_iterates", f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0', SGD_STEPS)} {iterate_rows('', SGD_STEPS)}""")
def sgd_iterates(spark, sf_dir):
    return trace_rows(sgd(p1_training(spark, sf_dir), iters=SGD_STEPS).trace)


@query("sgd_lasso_iterates", f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0.05e0', SGD_STEPS)} {iterate_rows('', SGD_STEPS)}""")
def sgd_lasso_iterates(spark, sf_dir):
    return trace_rows(sgd(p1_training(spark, sf_dir), 0.05, iters=SGD_STEPS).trace)


@query("sgd_resumed", f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0.05e0', SGD_STEPS)} {iterate_rows('', SGD_STEPS)}""")
def sgd_resumed(spark, sf_dir):
    """A fit that stopped after two iterations and goes on from its journal."""
    rows, journal = p1_training(spark, sf_dir), shared_path(spark, "journal")
    for iters in (2, SGD_STEPS):
        fit = sgd(rows, 0.05, iters=iters, journal=journal)
    return trace_rows(fit.trace)


@query("owlqn_resumed", optimum(soft("0.02e0")))
def owlqn_resumed(spark, sf_dir):
    rows, journal = p1_training(spark, sf_dir), shared_path(spark, "journal")
    owlqn(rows, 0.02, max_iter=3, journal=journal)
    return model(owlqn(rows, 0.02, journal=journal))


ROW_KEY = "l_orderkey * 8 + l_linenumber"


@query("sgd_minibatch", f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0.01e0', SGD_STEPS).replace(
        f'WHERE k < {SGD_STEPS}',
        f'WHERE k < {SGD_STEPS} AND ' + batch_of(ROW_KEY, 0.5, 7, 'k + 1'))}
    {iterate_rows('', SGD_STEPS)}""")
def sgd_minibatch(spark, sf_dir):
    """Batches drawn by a row key: the same rows on every engine."""
    rows = p1_training(spark, sf_dir)
    return trace_rows(sgd(rows, 0.01, iters=SGD_STEPS, fraction=0.5, seed=7, key=ROW_KEY).trace)


@query("batch_value_grad", f"""
    WITH {P1_SQL} SELECT count(*) AS n_rows, {rounded('avg(ln(1 + exp(m)) - t * m)', 8)} AS loss,
      {rounded('avg((1 / (1 + exp(-m)) - t) * x1)', 8)} AS g0,
      {rounded('avg((1 / (1 + exp(-m)) - t) * x2)', 8)} AS g1,
      {rounded('avg((1 / (1 + exp(-m)) - t) * x3)', 8)} AS g2,
      {rounded('avg(1 / (1 + exp(-m)) - t)', 8)} AS g3
    FROM (SELECT *, 0.5e0 * x1 - 0.3e0 * x2 + 0.2e0 * x3 + 0.1e0 AS m FROM p1
      WHERE {batch_of(ROW_KEY, 0.3, 11, 0)}) q""")
def batch_value_grad(spark, sf_dir):
    found = logistic_value_grad(p1_training(spark, sf_dir), [0.5, -0.3, 0.2, 0.1],
                                batch_fraction=0.3, seed=11, key=ROW_KEY)
    return found.select("n_rows", F.round("loss", 8).alias("loss"), *[
        F.round(F.get("gradient", F.lit(i)), 8).alias(f"g{i}") for i in range(4)])


def sweep_sql(settings):
    parts = []
    for name, lam in settings.items():
        cte = iterates(lam, 3).replace("it AS", f"it_{name} AS", 1).replace("FROM it, p1", f"FROM it_{name}, p1")
        rows = iterate_rows(f"'p1' AS problem, '{name}' AS setting, 1 AS rep, ", 3)
        parts.append((cte, rows.replace("FROM it ", f"FROM it_{name} ")))
    return (f"WITH RECURSIVE {P1_SQL}, " + ", ".join(c for c, _ in parts) + " "
            + " UNION ALL ".join(r for _, r in parts))


@query("sweep", sweep_sql({"plain": "0", "lasso": "0.05e0"}))
def sweep_query(spark, sf_dir):
    rows = p1_training(spark, sf_dir).select("features", "label")
    traces = sweep(
        {"p1": rows}, {"plain": {"lam": 0.0, "iters": 3}, "lasso": {"lam": 0.05, "iters": 3}}, sgd)
    return trace_rows(traces, "problem", "setting", "rep")


SWEEP_MODELS = {"given": [[0.8, -0.5, 0.0, 0.1], [0.7, -0.4, 0.1, 0.0]],
                "turned": [[-0.8, 0.5, 0.0, -0.1], [-0.7, 0.4, -0.1, 0.0]]}


def problems_sql():
    """Three iterates on either half of p1, with labels as they are or turned around."""
    ctes, rows = [], []
    for problem, label in (("given", "t"), ("turned", "1 - t AS t")):
        for rep in (1, 2):
            name = f"it_{problem}{rep}"
            ctes.append(iterates("0.05e0", 3).replace("it AS", f"{name} AS", 1)
                        .replace("FROM it, p1 WHERE", f"FROM {name}, p1 WHERE l_orderkey % 2 = {rep - 1} AND")
                        .replace("w3, t, x1", f"w3, {label}, x1"))
            rows += [f"""SELECT '{problem}' AS problem, {rep} AS rep, {i} AS pos,
              CAST({SWEEP_MODELS[problem][rep - 1][i]} AS DOUBLE) AS expected,
              {rounded(f'w{i}', 8)} AS final, 3 AS iterations FROM {name} WHERE k = 3""" for i in range(4)]
    return f"WITH RECURSIVE {P1_SQL}, {', '.join(ctes)} " + " UNION ALL ".join(rows)


@query("sweep_summary", problems_sql())
def sweep_summary(spark, sf_dir):
    """Two problems with rows and an expected model for each of two repetitions."""
    rows = p1_training(spark, sf_dir)
    halves = [rows.where(f"l_orderkey % 2 = {r}").select("features", "label") for r in (0, 1)]
    turned = [h.withColumn("label", 1 - F.col("label")) for h in halves]
    problems = {"given": Problem(halves, SWEEP_MODELS["given"]),
                "turned": Problem(turned, SWEEP_MODELS["turned"])}
    found = summaries(run_sweep(problems, {"lasso": {"lam": 0.05, "iters": 3}}, sgd, 2))
    return found.select("problem", "rep", "iterations", F.posexplode(
        F.arrays_zip("expected", "final")).alias("pos", "m")).select(
        "problem", "rep", "pos", "m.expected", F.round("m.final", 8).alias("final"), "iterations")


def comparison_sql():
    runs, steps = {"plain": "0", "lasso": "0.05e0"}, 4
    ctes, rows = [recursion(plain, 80, "4e0").replace("it AS", "best AS", 1)
                  .replace("FROM it, p1", "FROM best, p1")], []
    for name, lam in runs.items():
        ctes.append(iterates(lam, steps).replace("it AS", f"it_{name} AS", 1)
                    .replace("FROM it, p1", f"FROM it_{name}, p1"))
        rows.append(f"SELECT '{name}' AS run_id, * FROM it_{name} WHERE k > 0")
    loss = "greatest((1 - 2 * t) * m, 0) + ln(1 + exp(-abs((1 - 2 * t) * m)))"
    return f"""
    WITH RECURSIVE {P1_SQL}, {', '.join(ctes)}, runs AS ({' UNION ALL '.join(rows)}),
    l AS (SELECT run_id, k, avg({loss}) AS objective FROM
      (SELECT run_id, k, t, w0 * x1 + w1 * x2 + w2 * x3 + w3 AS m FROM runs, p1) q GROUP BY run_id, k),
    d AS (SELECT run_id, runs.k, sqrt(power(runs.w0 - b.w0, 2) + power(runs.w1 - b.w1, 2)
      + power(runs.w2 - b.w2, 2) + power(runs.w3 - b.w3, 2)) AS distance
      FROM runs, (SELECT * FROM best WHERE k = 80) b),
    f AS (SELECT run_id, min(k) FILTER (distance <= 0.9e0) AS first_within FROM d GROUP BY run_id)
    SELECT run_id, k AS iteration, round(objective, 7) AS objective, round(distance, 6) AS distance, first_within
    FROM l JOIN d USING (run_id, k) JOIN f USING (run_id)"""


def compared(spark, sf_dir):
    rows = p1_training(spark, sf_dir).select("features", "label").persist()
    best = lbfgs(rows)
    fits = sgd_grid(rows, [0.0, 0.05], iters=4, run_ids=["plain", "lasso"])
    found = compare_methods(union_all([f.trace for f in fits]), rows, best.weights, tol=0.9)
    rows.unpersist()
    return found


@query("method_comparison", comparison_sql())
def method_comparison(spark, sf_dir):
    return compared(spark, sf_dir).select(
        "run_id", "iteration", F.round("objective", 7).alias("objective"),
        F.round("distance", 6).alias("distance"), "first_within")


@query("method_summary", f"""
    SELECT run_id, min_by(iteration, objective) AS best_iteration, round(min(objective), 6) AS best_objective,
      any_value(first_within) AS first_within, bool_or(distance <= 0.9e0) AS timed
    FROM ({comparison_sql()}) c GROUP BY run_id""")
def method_summary(spark, sf_dir):
    found = time_to_tolerance(compared(spark, sf_dir))
    return found.select(
        "run_id", "best_iteration", F.round("best_objective", 6).alias("best_objective"),
        "first_within", F.col("seconds_within").isNotNull().alias("timed"))


@query("trace_sink", f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0', 3)} {iterate_rows("'sgd' AS run_id, ", 3)}""")
def trace_sink(spark, sf_dir):
    fit = sgd(p1_training(spark, sf_dir), iters=3)
    path = shared_path(spark, "trace")
    write_trace(fit.trace, path, "parquet", fit.summary)
    back = spark.read.parquet(f"{path}/iterations")
    summary = spark.read.parquet(f"{path}/summary").select("run_id")
    return trace_rows(back.join(summary, "run_id"), "run_id")


EXPECTED = [0.8, -0.5, 0.0, 0.1]


def trace_csv_sql(steps=3):
    ws = "[w0, w1, w2, w3]"
    margin = " + ".join(f"w{i} * {x}" for i, x in enumerate(NAMES))
    return f"""
    WITH RECURSIVE {P1_SQL}, {iterates('0.05e0', steps)},
    o AS (SELECT k + 1 AS k, avg(ln(1 + exp(m)) - t * m) + 0.05e0 * any_value(penalty) AS objective
      FROM (SELECT k, t, {margin} AS m, abs(w0) + abs(w1) + abs(w2) AS penalty FROM it, p1 WHERE k < {steps}) q GROUP BY k),
    r AS (SELECT k, unnest(range(4)) AS pos, unnest({ws}) AS w, objective, unnest({EXPECTED!r}) AS expected FROM it JOIN o USING (k))
    SELECT 'iterations' AS part, k AS iteration, 1 AS n_eval, CAST(pos AS INTEGER) AS pos, {rounded('w', 8)} AS weight,
      {rounded('objective', 8)} AS objective, CAST(NULL AS DOUBLE) AS expected, 'sgd' AS method, CAST(NULL AS VARCHAR) AS stop_reason FROM r
    UNION ALL SELECT 'summary', k, {steps}, CAST(pos AS INTEGER), {rounded('w', 8)}, {rounded('objective', 8)},
      CAST(expected AS DOUBLE), 'sgd', 'iterations' FROM r WHERE k = {steps}"""


@query("trace_csv", trace_csv_sql())
def trace_csv(spark, sf_dir):
    """Iterations and summary (expected and final model) written as CSV and read back."""
    fit = sgd(p1_training(spark, sf_dir), 0.05, iters=3)
    fit.expected = np.array(EXPECTED)
    path = shared_path(spark, "trace")
    write_trace(fit.trace, path, "csv", fit.summary)

    def read(name, *columns):
        rows = spark.read.csv(f"{path}/{name}", header=True).where(
            "run_id = 'sgd'" + (" AND CAST(init_seconds AS DOUBLE) >= 0 AND converged = 'false'" if name == "summary" else ""))
        long = rows.selectExpr("method", *columns)
        return long.selectExpr(
            f"'{name}' AS part", "iteration", "n_eval", "pos", "round(CAST(w.a AS DOUBLE), 8) AS weight",
            "round(CAST(objective AS DOUBLE), 8) AS objective", "CAST(w.b AS DOUBLE) AS expected", "method",
            "stop_reason")

    done = read("iterations", "CAST(iteration AS INT) AS iteration", "CAST(n_eval AS INT) AS n_eval", "objective",
                "CAST(NULL AS STRING) AS stop_reason",
                "posexplode(transform(split(model, ','), a -> named_struct('a', a, 'b', NULL))) AS (pos, w)")
    end = read("summary", "CAST(iterations AS INT) AS iteration", "CAST(n_eval AS INT) AS n_eval", "objective",
               "stop_reason", "posexplode(zip_with(split(final, ','), split(expected, ','), "
               "(a, b) -> named_struct('a', a, 'b', b))) AS (pos, w)")
    return done.unionByName(end)


@query("trace_time_delta", """
    SELECT user_id, event_id, round(elapsed - lag(elapsed, 1, CAST(0 AS DOUBLE))
      OVER (PARTITION BY user_id ORDER BY event_id), 6) AS iter_seconds
    FROM (SELECT user_id, event_id, value + event_id / CAST(8 AS DOUBLE) AS elapsed FROM events) e""")
def time_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "value + event_id / 8D AS elapsed")
    found = iteration_times(rows, "user_id", "event_id", "elapsed")
    return found.select("user_id", "event_id", F.round("iter_seconds", 6).alias("iter_seconds"))


def wide_optimum(lam, steps=300):
    """Accelerated proximal gradient on P2 over DuckDB lists: step 2, momentum 0.8."""
    new = f"CASE WHEN pos = 64 THEN m ELSE sign(m) * greatest(abs(m) - 2 * {lam}, 0) END"
    zeros = "list_transform(range(65), lambda i: CAST(0 AS DOUBLE))"
    return f"""
    WITH RECURSIVE x AS MATERIALIZED (SELECT list_append(list_transform(embedding,
        lambda v: 8 * CAST(v AS DOUBLE)), CAST(1 AS DOUBLE)) AS x,
        CAST(label = 3 AS DOUBLE) AS t FROM embeddings),
    it AS (SELECT 0 AS k, {zeros} AS w, {zeros} AS y
      UNION ALL
      SELECT any_value(k) + 1, list(new ORDER BY pos), list(new + 0.8e0 * (new - w) ORDER BY pos)
      FROM (SELECT k, pos, w, {new} AS new FROM (
        SELECT any_value(k) AS k, pos, any_value(w) AS w, any_value(y) - 2 * avg(r * x) AS m
        FROM (SELECT k, unnest(x) AS x, unnest(range(65)) AS pos, unnest(w) AS w, unnest(y) AS y,
            1 / (1 + exp(-list_dot_product(x, y))) - t AS r FROM it, x WHERE k < {steps}) q
        GROUP BY pos) s) u HAVING count(*) > 0)
    SELECT CAST(pos AS INTEGER) AS pos, {rounded('w', 4)} AS weight, pos = 64 AS is_intercept
    FROM (SELECT unnest(range(65)) AS pos, unnest(w) AS w FROM it WHERE k = {steps}) f"""


@query("lbfgs_wide", wide_optimum("0e0"))
def lbfgs_wide(spark, sf_dir):
    """65 coordinates: the Arrow plan."""
    return model(lbfgs(p2(spark, sf_dir), tol=1e-9), 4)


@query("owlqn_wide", wide_optimum("0.01e0"))
def owlqn_wide(spark, sf_dir):
    return model(owlqn(p2(spark, sf_dir), 0.01, tol=1e-9), 4)


@query("admm_lasso_wide", wide_optimum("0.01e0"))
def admm_lasso_wide(spark, sf_dir):
    blocks = to_blocks(fold_blocks(p2(spark, sf_dir)), 250, 65)
    return model(A.admm_logistic(
        blocks, rho=25.0, alpha=1.6, abstol=1e-7, reltol=1e-8, max_iter=150,
        prox=Penalty("l1", 0.01)), 4)
