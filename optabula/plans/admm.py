"""Consensus ADMM over row blocks.

Blocks are hash-partitioned and sorted by block_id once and kept; they never move again.
The state (u, x, xhat per block) is an immutable table, about 3/height of the data in size:
each iteration joins it to the blocks, solves every block inside its task, and writes the
next state with a reliable checkpoint. Losing executors costs recomputation, never state.
Only sums over blocks (d values) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import kernels
from ..cluster import (
    MAX_SHIPPED_BYTES,
    check_shipped,
    cut_lineage,
    remove,
    scan_partitions,
    shared_path,
)
from ..functions.vectors import array_sql, scale
from ..operators.blocks import block_totals, fold_blocks, to_blocks
from ..operators.gram import factored, total_gram
from ..operators.sums import PIECES, collect_sum, cut_and_sum
from .journal import Entries, Journal
from .passes import infer_width
from .penalties import Penalty, Prox, prox_function
from .trace import Fit, Trace

SOLVE_SCHEMA = "struct<x:array<double>,steps:int,grad_norm:double,solved:boolean>"


# Steps on the state table --------------------------------------------------------------


def admm_start(blocks: DataFrame, d: int) -> DataFrame:
    """State of iteration 0: all vectors zero."""
    zeros = F.array_repeat(F.lit(0.0), d)
    return blocks.select(
        "block_id", zeros.alias("u"), zeros.alias("x"), zeros.alias("xhat"))


def admm_dual_update(state: DataFrame, z: Sequence[float]) -> DataFrame:
    """r2 = |x - z|^2 of the old x, and u += xhat - z."""
    z = array_sql(z)
    gap = f"zip_with(x, {z}, (a, b) -> (a - b) * (a - b))"
    step = f"zip_with(xhat, {z}, (a, b) -> a - b)"
    kept = [c for c in state.columns if c not in ("u", "r2")]
    return state.selectExpr(
        *kept, f"aggregate({gap}, 0D, (s, v) -> s + v) AS r2",
        f"zip_with(u, {step}, (a, b) -> a + b) AS u")


def admm_rescale(state: DataFrame, rho_old: float, rho_new: float, eps: float = 1e-10,
                 u: str = "u") -> DataFrame:
    """u *= rho_old / rho_new where rho changed by more than eps."""
    if abs(rho_old - rho_new) <= eps:
        return state
    return state.withColumn(u, scale(F.col(u), rho_old / rho_new))


def admm_rescale_columns(state: DataFrame, rho_old: str, rho_new: str, eps: float = 1e-10,
                         u: str = "u") -> DataFrame:
    """The same for states of many runs, rho read from columns."""
    changed = F.abs(F.col(rho_old) - F.col(rho_new)) > eps
    factor = F.when(changed, F.col(rho_old) / F.col(rho_new)).otherwise(F.lit(1.0))
    return state.withColumn(u, F.transform(u, lambda v: v * factor))


def logistic_solution(z: Sequence[float], rho: float, inner_tol: float, memory: int = 7,
                      inner_steps: int | None = None) -> Column:
    """Column of x-updates for rows holding a sign-folded block and its state.

    A block that is not within ``inner_tol`` after ``inner_steps`` steps counts as unsolved; by
    default it gets 100 Newton or 500 quasi-Newton steps.
    """
    check_shipped(len(z), "the consensus vector")
    body = kernels.solve_logistic_blocks(
        np.asarray(z, dtype=float), rho, inner_tol, memory, inner_steps)
    return arrow_udf(body, SOLVE_SCHEMA)("values", "n_rows", "n_cols", "u", "x")


def least_squares_solution(z: Sequence[float], rho: float, inner_tol: float = 0.0,
                           memory: int = 0) -> Column:
    """Column of x-updates for rows holding a factored gram and its state: products only."""
    center = F.expr(f"zip_with({array_sql(z)}, u, (a, b) -> a - b)")
    x = arrow_udf(kernels.solve_eigen(len(z), rho), "array<double>")(
        "factor.vectors", "factor.values", "atb", center)
    return F.struct(x.alias("x"), F.lit(1).alias("steps"), F.lit(0.0).alias("grad_norm"),
                    F.lit(True).alias("solved"))


def admm_local_solve(blocks: DataFrame, state: DataFrame, z: Sequence[float], rho: float,
                     inner_tol: float = 1e-8,
                     solution: Callable[..., Column] = logistic_solution,
                     memory: int = 7) -> DataFrame:
    """(block_id, u, x, r2, steps, grad_norm, solved): argmin of loss + rho/2 |x + u - z|^2 per block.

    The join keeps the blocks' partitioning; only the state moves. Held blocks are sorted and merged
    with it; those of a bucketed table stream past the states of their bucket, 3 vectors per block.
    """
    if "r2" not in state.columns:
        state = state.withColumn("r2", F.expr("CAST(NULL AS DOUBLE)"))
    kept = blocks.storageLevel
    hint = "merge" if kept.useMemory or kept.useDisk else "shuffle_hash"
    solved = blocks.join(state.hint(hint), "block_id").select(
        "block_id", "u", "r2", solution(z, rho, inner_tol, memory).alias("solved"))
    return solved.select(
        "block_id", "u", "solved.x", "r2", "solved.steps", "solved.grad_norm", "solved.solved")


def admm_relax(state: DataFrame, z: Sequence[float], alpha: float) -> DataFrame:
    """xhat = alpha x + (1 - alpha) z."""
    if alpha == 1.0:
        return state.withColumn("xhat", F.col("x"))
    mixed = f"zip_with(x, {array_sql(z)}, (a, b) -> {alpha!r}D * a + {1.0 - alpha!r}D * b)"
    return state.withColumn("xhat", F.expr(mixed))


def admm_packed(z: Sequence[float]) -> str:
    """SQL vector per block: [u, xhat, x - z, |x - z|^2, r2, 1, steps, unsolved].

    Its sum over blocks is all a consensus step needs. Differences to the previous z are
    summed instead of x itself, so the residual at the new z follows without cancellation.
    """
    gap = f"zip_with(x, {array_sql(z)}, (a, b) -> a - b)"
    return (
        f"concat(u, xhat, {gap}, array(aggregate({gap}, 0D, (s, v) -> s + v * v), "
        "coalesce(r2, 0D), 1D, CAST(steps AS DOUBLE), CAST(NOT solved AS DOUBLE)))")


def admm_consensus(state: DataFrame, key: str | None = None) -> DataFrame:
    """([key], pos, n_blocks, r, u_mean, x_mean, v): block means, v = u + x being the prox input.

    One map-side combined aggregation over (key, pos).
    """
    keys = (key,) if key else ()
    rows = state.selectExpr(*keys, "r2", "posexplode(arrays_zip(u, xhat)) AS (pos, m)")
    means = rows.groupBy(*keys, "pos").agg(
        F.expr("count(1) AS n_blocks"), F.expr("sqrt(sum(r2)) AS r"),
        F.expr("avg(m.u) AS u_mean"), F.expr("avg(m.xhat) AS x_mean"))
    return means.withColumn("v", F.expr("u_mean + x_mean"))


# Steps on a trace table ----------------------------------------------------------------


def admm_residuals(trace: DataFrame, abstol: float, reltol: float) -> DataFrame:
    """Adds primal_tol, dual_tol, dual_residual and stop.

    Needs n_blocks, d, rho, norm_x, norm_z, norm_u, norm_dz (change of z), primal_residual.
    """
    root = F.sqrt(F.col("d").cast("double")) * F.lit(abstol)
    rho = F.col("rho")
    dual = rho * F.sqrt(F.col("n_blocks").cast("double")) * F.col("norm_dz")
    primal_tol = root + F.lit(reltol) * F.greatest("norm_x", "norm_z")
    dual_tol = root + rho * F.lit(reltol) * F.col("norm_u")
    return trace.withColumns({
        "primal_tol": primal_tol, "dual_tol": dual_tol, "dual_residual": dual,
        "stop": (F.col("primal_residual") <= primal_tol) & (dual <= dual_tol),
    })


def admm_next_rho(trace: DataFrame, factor: float, mu: float) -> DataFrame:
    """Adds next_rho: up if the primal residual dominates by mu, down if the dual one does."""
    primal, dual, rho = F.col("primal_residual"), F.col("dual_residual"), F.col("rho")
    changed = (
        F.when(primal > mu * dual, rho * factor).when(mu * primal < dual, rho / factor)
        .otherwise(rho)
    )
    return trace.withColumn("next_rho", changed)


def admm_inner_tol(trace: DataFrame, floor: float) -> DataFrame:
    """Adds inner_tol = max(dual residual + primal residual, floor)."""
    total = F.col("dual_residual") + F.col("primal_residual")
    return trace.withColumn("inner_tol", F.greatest(total, F.lit(float(floor))))


# Solvers -------------------------------------------------------------------------------


def _next_rho(rho, primal, dual, factor, mu):
    if primal > mu * dual:
        return rho * factor
    if mu * primal < dual:
        return rho / factor
    return rho


def consensus_admm(blocks: DataFrame, solution: Callable[..., Column], d: int, n_rows: int,
                   n_blocks: int, *, rho: float | None = None, alpha: float = 1.0,
                   factor: float = 1.0, mu: float = 10.0, abstol: float = 1e-10,
                   reltol: float = 1e-10, max_iter: int = 100, prox: Prox = Penalty(),
                   residual: str = "current", inner_tol: float = 1e-8,
                   inner_schedule: bool = False, memory: int = 7, rescale_eps: float = 1e-10,
                   run_id: str = "admm", method: str = "admm", trace: Trace | None = None,
                   losses: Callable[[DataFrame, np.ndarray], np.ndarray] | None = None,
                   journal: Journal | str | None = None) -> Fit:
    """The loop shared by all local problems; ``blocks`` must be held and keyed by block_id.

    ``residual="lagged"`` measures the old x against the old z, one iteration late.
    ``inner_schedule`` solves blocks to max(residuals of the last iteration, inner_tol).
    The fit has converged when the residuals are within their tolerances and every block of that
    iteration was solved; the trace counts unsolved blocks. Blocks with values that are not finite
    raise an error.

    ``journal`` keeps every iteration in a table and the state of all blocks next to it, and goes on
    from the last one found there; blocks must then have the same ids and rows as before.
    """
    if residual not in ("current", "lagged"):
        raise ValueError(f"unknown residual {residual!r}")
    apply_prox = prox_function(prox)
    rho = 0.13 * n_rows / n_blocks if rho is None else float(rho)
    trace = trace or Trace(run_id, method)
    z, state_rho, tol, done, converged = np.zeros(d), rho, inner_tol, 0, False
    last = None
    if journal is not None:
        last = trace.keep_in(Entries(blocks.sparkSession, journal, [trace.run_id], {
            "method": trace.method, "width": d, "rows": n_rows, "blocks": n_blocks, "rho": rho, "alpha": alpha,
            "factor": factor, "mu": mu, "residual": residual, "inner_schedule": inner_schedule,
            "prox": repr(prox) if isinstance(prox, Penalty) else getattr(prox, "__qualname__", None)}))
        trace.journal.begin(trace.run_id, z)
    if last and last["iteration"]:
        done, z, rho = last["iteration"], np.array(last["model"]), last["rho"]
        state_rho, tol = last["carried"]["state_rho"], last["carried"]["next_tol"]
        converged = last["primal_residual"] <= last["primal_tol"] and last["dual_residual"] <= last[
            "dual_tol"] and not last["unsolved_blocks"]
        state = trace.journal.read_state(trace.run_id, done)
    else:
        state = admm_start(blocks, d)
    oldest = trace.journal.oldest_state(done) if trace.journal else 0
    trace.ready()
    for k in range(done + 1, max_iter + 1 if not converged else done + 1):
        prepared = admm_rescale(admm_dual_update(state, z), state_rho, rho, rescale_eps)
        solved = admm_local_solve(blocks, prepared, z, rho, tol, solution, memory)
        keep = trace.journal.keep_state(trace.run_id, k) if trace.journal else cut_lineage
        state, sums = cut_and_sum(admm_relax(solved, z, alpha), admm_packed(z), 3 * d + 5, keep)
        state_rho = rho
        u, x, gap = sums[:d] / n_blocks, sums[d:2 * d] / n_blocks, sums[2 * d:3 * d]
        gap2, lagged2, seen, steps, unsolved = sums[3 * d:]
        if int(seen) != n_blocks:
            raise RuntimeError(f"{int(seen)} of {n_blocks} blocks answered: block ids changed")
        z_new = apply_prox(x + u, n_blocks * rho / n_rows) + 0.0  # no -0.0
        move = z_new - z
        current2 = gap2 - 2.0 * (move @ gap) + n_blocks * (move @ move)
        primal = float(np.sqrt(max(current2 if residual == "current" else lagged2, 0.0)))
        root_n = np.sqrt(n_blocks)
        next_rho = _next_rho(rho, primal, rho * root_n * np.linalg.norm(move), factor, mu)
        dual = float(next_rho * root_n * np.linalg.norm(move))
        primal_tol = float(
            np.sqrt(d) * abstol + reltol * max(np.linalg.norm(x), np.linalg.norm(z_new)))
        dual_tol = float(np.sqrt(d) * abstol + next_rho * reltol * np.linalg.norm(u))
        next_tol = max(dual + primal, inner_tol) if inner_schedule else tol
        trace.add(
            k, z_new, n_eval=int(steps), rho=next_rho, dual_residual=dual, dual_tol=dual_tol,
            primal_residual=primal, primal_tol=primal_tol, inner_tol=tol,
            unsolved_blocks=unsolved,
            state={"carried": {"state_rho": state_rho, "next_tol": float(next_tol)}})
        if trace.journal:
            oldest = trace.journal.drop_states(trace.run_id, oldest)
        z, rho, tol = z_new, next_rho, next_tol
        if primal <= primal_tol and dual <= dual_tol and not unsolved:
            converged = True
            break
    def values(models):
        extra = [prox.value(w) if isinstance(prox, Penalty) else 0.0 for w in models]
        return losses(blocks, models) / n_rows + extra

    if trace.journal:
        trace.journal.commit()
        trace.journal.drop_states(trace.run_id, oldest)
        at_once = max(1, MAX_SHIPPED_BYTES // (8 * d))
        for part, models in trace.journal.unevaluated(trace.run_id, at_once) if losses else ():
            found = values(models)
            trace.journal.add_objectives(trace.run_id, part, found)
            if part[-1] == trace.rows[-1]["iteration"]:
                trace.rows[-1]["objective"] = float(found[-1])
        if losses and trace.rows and trace.rows[-1]["objective"] is None:  # evaluated before
            end = trace.rows[-1]["iteration"]
            trace.rows[-1]["objective"] = trace.frame(blocks.sparkSession).where(
                F.col("iteration") == end).first()["objective"]
    elif losses is not None and trace.rows:
        # One more pass over the blocks gives the objective of every iterate.
        for row, value in zip(trace.rows, values(np.array([r["model"] for r in trace.rows]))):
            row["objective"] = float(value)
    return Fit(blocks.sparkSession, z, trace, converged,
               trace.rows[-1]["objective"] if trace.rows else None,
               stop_reason="residuals" if converged else "iterations")


def logistic_losses(blocks: DataFrame, models: np.ndarray) -> np.ndarray:
    """Summed logistic loss of every model over sign-folded blocks.

    One pass for as many models as may be shipped to the tasks at once.
    """
    k, d = models.shape
    check_shipped(d, "one iterate")
    at_once = max(1, MAX_SHIPPED_BYTES // (8 * d))
    rows, found = blocks.select("values", "n_rows", "n_cols"), []
    for lo in range(0, k, at_once):
        part = models[lo:lo + at_once]
        found.append(collect_sum(rows.mapInArrow(kernels.block_losses(part), PIECES), len(part)))
    return np.concatenate(found)


def least_squares_losses(grams: DataFrame, models: np.ndarray) -> np.ndarray:
    """Half the summed squared residuals of every model, from the total of the grams."""
    d = models.shape[1]
    total = total_gram(grams, d).first()
    ata, atb = np.array(total["ata"]).reshape(d, d), np.array(total["atb"])
    return 0.5 * (np.einsum("ki,ij,kj->k", models, ata, models) - 2.0 * models @ atb + total["btb"])


def bucketed(blocks: DataFrame, buckets: int) -> tuple[str, str]:
    """Writes blocks bucketed by id to the shared folder: (table, path) of the session's catalog."""
    spark = blocks.sparkSession
    path = shared_path(spark, "blocks")
    name = "optabula_" + path.rsplit("/", 1)[1].replace("-", "_")
    blocks.repartition(buckets, "block_id").write.bucketBy(buckets, "block_id").sortBy(
        "block_id").option("path", path).saveAsTable(name)
    return name, path


@contextmanager
def co_partitioned(blocks: DataFrame, partitions: int | None = None, durable: bool = False):
    """Hash-partitions and sorts blocks by id, once, and keeps them (memory, then disk).

    The number of partitions defaults to the scan's (at least one per core), so that a task
    sorts about one input split; where the rows were shuffled before, to
    spark.sql.shuffle.partitions.

    ``durable`` writes them to the shared folder instead, as a table bucketed by id with one file
    per bucket, which is removed at the end: every iteration streams the buckets past their states,
    executors hold no blocks, and a lost one costs a read. Use it for blocks beyond the executors'
    memory, or when the rows below them come in no reproducible order (after a shuffle, say): a lost
    cached block would then be rebuilt from other rows.
    """
    if partitions is None:
        spark = blocks.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        scanned = scan_partitions(blocks)
        if scanned is not None:
            cores = spark.sparkContext.defaultParallelism
            partitions = max(cores, scanned)
    if durable:
        name, path = bucketed(blocks, partitions)
        try:
            yield blocks.sparkSession.table(name)
        finally:
            blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            remove(blocks.sparkSession, path)
        return
    placed = blocks.repartition(partitions, "block_id").sortWithinPartitions("block_id")
    placed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield placed
    finally:
        placed.unpersist()


def admm_logistic(blocks: DataFrame, partitions: int | None = None, durable: bool = False,
                  run_id: str = "admm_logistic", inner_steps: int | None = None, **options) -> Fit:
    """Logistic regression over sign-folded blocks (see ``fold_blocks``, ``to_blocks``).

    ``inner_steps`` bounds the steps of a block in one iteration; later iterations go on from there.
    """
    trace = Trace(run_id, "admm_logistic")
    with co_partitioned(blocks, partitions, durable) as held:
        n_blocks, n_rows, d = block_totals(held)
        return consensus_admm(
            held, partial(logistic_solution, inner_steps=inner_steps), d, n_rows, n_blocks, trace=trace,
            losses=logistic_losses, **options)


def admm_logistic_rows(rows: DataFrame, height: int = 4096, features: str = "features",
                       label: str = "label", **options) -> Fit:
    """The same from training rows (features, label 0/1)."""
    d = infer_width(rows, features)
    blocks = to_blocks(fold_blocks(rows, features, label), height, d)
    return admm_logistic(blocks, **options)


def admm_least_squares(grams: DataFrame, partitions: int | None = None, durable: bool = False,
                       run_id: str = "admm_least_squares", rescale_eps: float = 1e-2,
                       **options) -> Fit:
    """Least squares over a per-block gram table; iterations never read raw rows.

    Every gram is factored once, before the first iteration, and the factors are kept with it: an
    iteration costs two products per block, and a change of ``rho`` nothing.
    ``rho`` defaults to the rows per block, the curvature of standardized features.
    """
    trace = Trace(run_id, "admm_least_squares")
    first = grams.select("n_cols").first()
    if first is None:
        raise ValueError("no blocks")
    with co_partitioned(factored(grams, first.n_cols), partitions, durable) as held:
        n_blocks, n_rows, d = block_totals(held)
        options.setdefault("rho", n_rows / n_blocks)
        return consensus_admm(
            held, least_squares_solution, d, n_rows, n_blocks, trace=trace,
            rescale_eps=rescale_eps, losses=least_squares_losses, **options)
