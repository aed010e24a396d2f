"""Edge cases of the single-pass operators, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optabula.functions import prep, prox
from optabula.operators import blocks as B
from optabula.operators import objectives as O
from optabula.operators.gram import block_gram, gram, inverse_hessian_diag, total_gram
from optabula.plans.trace import iteration_times

RNG = np.random.default_rng(3)


def frame(spark, x, y):
    rows = [([float(v) for v in row], float(t)) for row, t in zip(x, y)]
    return spark.createDataFrame(rows, "features array<double>, label double")


def loss_and_grad(x, y, w):
    m = x @ w
    loss = np.logaddexp(0, (1 - 2 * y) * m)
    return loss.sum(), x.T @ (1 / (1 + np.exp(-m)) - y)


@pytest.mark.parametrize("narrow", [True, False])
@pytest.mark.parametrize("d", [1, 3, 30])
def test_both_plans_agree_with_numpy(spark, narrow, d):
    x, y = RNG.normal(size=(50, d)), RNG.integers(0, 2, 50).astype(float)
    models = RNG.normal(size=(3, d))
    found = O.logistic_pass(frame(spark, x, y), models, narrow=narrow)
    assert found.n == 50
    for j, w in enumerate(models):
        loss, grad = loss_and_grad(x, y, w)
        assert np.isclose(found.loss[j], loss, rtol=1e-12)
        assert np.allclose(found.grad[j], grad, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("narrow", [True, False])
def test_huge_margins_stay_finite(spark, narrow):
    x, y = np.array([[1000.0], [-1000.0], [1000.0]]), np.array([1.0, 0.0, 0.0])
    found = O.logistic_pass(frame(spark, x, y), [1.0], narrow=narrow)
    assert np.isclose(found.loss[0], 1000.0) and np.isclose(found.grad[0, 0], 1000.0)


def test_gradient_matches_finite_differences(spark):
    x, y = RNG.normal(size=(40, 3)), RNG.integers(0, 2, 40).astype(float)
    w, h = np.array([0.3, -0.2, 0.1]), 1e-6
    steps = [w + s * h * e for e in np.eye(3) for s in (1, -1)]
    found = O.logistic_pass(frame(spark, x, y), [w, *steps])
    slopes = (found.loss[1::2] - found.loss[2::2]) / (2 * h)
    assert np.allclose(found.grad[0], slopes, atol=1e-6)


@pytest.mark.parametrize("narrow", [True, False])
@pytest.mark.parametrize("bad", [[1.0], [1.0, None], [1.0, 2.0, 3.0], None])
def test_unusable_rows_fail(spark, narrow, bad):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), (bad, 0.0)], "features array<double>, label double")
    with pytest.raises(Exception):
        O.logistic_pass(df, [0.1, 0.2], narrow=narrow)


@pytest.mark.parametrize("narrow", [True, False])
def test_nan_and_empty_fail(spark, narrow):
    with pytest.raises(ValueError, match="finite"):
        O.logistic_pass(frame(spark, [[float("nan")]], [1.0]), [0.5], narrow=narrow)
    with pytest.raises(ValueError, match="no training rows"):
        O.logistic_pass(frame(spark, [], []), [0.5], narrow=narrow)


def test_require_clean(spark):
    good = frame(spark, [[1.0, 2.0]], [1.0])
    assert prep.require_clean(good, 2) is good
    with pytest.raises(ValueError, match="'bad_label': 1"):
        prep.require_clean(frame(spark, [[1.0, 2.0]], [-1.0]), 2)
    with pytest.raises(ValueError, match="'not_finite': 1"):
        prep.require_clean(frame(spark, [[1.0, float("inf")]], [1.0]), 2)


def test_too_many_candidates_are_refused(spark):
    with pytest.raises(ValueError, match="above the bound"):
        O.logistic_pass(frame(spark, [[1.0]], [1.0]), np.zeros((1, 9_000_000)))


def test_augmented_block_counts_the_penalty_once_per_block(spark):
    x, y = RNG.normal(size=(30, 2)), RNG.integers(0, 2, 30).astype(float)
    df = frame(spark, x, y).withColumn("block_id", F.lit(0).cast("long"))
    w, u, z, rho = np.array([0.2, 0.1]), np.array([0.1, 0.0]), np.array([0.0, 0.3]), 5.0
    loss, grad = loss_and_grad(x, y, w)
    shift = w + u - z
    one = O.augmented_value_grad(df, w, u, z, rho, by="block_id").first()
    per_row = O.augmented_value_grad(df, w, u, z, rho, penalty_per="row").first()
    assert np.isclose(one["value"], loss + rho / 2 * shift @ shift)
    assert np.allclose(one["gradient"], grad + rho * shift)
    assert np.isclose(per_row["value"], loss + 30 * rho / 2 * shift @ shift)
    assert np.allclose(per_row["gradient"], grad + 30 * rho * shift)


def test_soft_threshold_at_zero(spark):
    row = spark.range(1).select(
        prox.soft_threshold(F.lit(0.0), 0.0).alias("a"),
        prox.soft_threshold(F.lit(-0.5), 0.5).alias("b"),
        prox.soft_threshold(F.lit(-2.0), 0.5).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.0, 0.0, -1.5)


def test_elastic_net_prox_minimizes(spark):
    v, lam, gamma, rho = 1.7, 0.4, 0.8, 3.0
    exact = spark.range(1).select(
        prox.prox_elastic_net(F.array(F.lit(v)), lam, gamma, rho)[0].alias("x")).first()["x"]
    grid = np.linspace(-3, 3, 600001)
    value = lam * np.abs(grid) + gamma / 2 * grid**2 + rho / 2 * (grid - v) ** 2
    assert abs(exact - grid[value.argmin()]) < 1e-4


def test_pseudo_gradient_at_zero(spark):
    rows = [(1, 0, 0.0, 2.0, 0.5), (1, 1, 0.0, -2.0, 0.5), (1, 2, 0.0, 0.3, 0.5), (1, 3, 0.0, 0.3, 0.0)]
    df = spark.createDataFrame(rows, "run_id int, pos int, w double, g double, l1 double")
    found = [r[0] for r in O.pseudo_gradient(df).orderBy("pos").select("pseudo_gradient").collect()]
    assert found == [1.5, -1.5, 0.0, 0.3]


# Blocks ---------------------------------------------------------------------------------


def values_frame(spark, n, d=2, partitions=3):
    return spark.range(0, n, 1, partitions).select(
        F.col("id"), F.array(*[(F.col("id") * 1.0 + i) for i in range(d)]).alias("values"))


@pytest.mark.parametrize("n,height", [(0, 4), (1, 4), (10, 4), (12, 4), (25, 100)])
@pytest.mark.parametrize("placed", [True, False])
def test_blocks_hold_every_row_once(spark, n, height, placed):
    rows = values_frame(spark, n)
    made = B.to_blocks(rows, height, 2, pos="id" if placed else None)
    found = made.collect()
    back = sorted(r["values"][0] for r in B.unblock(made).collect())
    assert back == [float(i) for i in range(n)]
    assert all(1 <= b["n_rows"] <= height and b["n_cols"] == 2 for b in found)
    assert len({b["block_id"] for b in found}) == len(found)
    if placed:
        assert len(found) == -(-n // height)


@pytest.mark.parametrize("n,sizes", [
    (9, [5, 4]), (3, [3]), (40, [5] * 8), (41, [5, 5, 5, 5, 5, 4, 4, 4, 4]), (402, [5] * 78 + [4] * 3)])
def test_last_blocks_are_even(spark, n, sizes):
    """The rows left over make no short block; ids and rows stay in order."""
    made = B.to_blocks(values_frame(spark, n, partitions=1), 5, 2).orderBy("block_id").collect()
    assert [b["n_rows"] for b in made] == sizes and [b["block_id"] for b in made] == list(range(len(sizes)))
    assert [v for b in made for v in b["values"][::2]] == [float(i) for i in range(n)]


def test_last_rows_of_large_blocks_are_not_held_back(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_BLOCK_BYTES", 3 * 8 * 5 * 2)  # two blocks and the rest in memory
    made = B.to_blocks(values_frame(spark, 41, partitions=1), 5, 2).orderBy("block_id").collect()
    assert [b["n_rows"] for b in made] == [5] * 6 + [4, 4, 3]
    monkeypatch.setattr(B, "MAX_BLOCK_BYTES", 8 * 5 * 2)
    made = B.to_blocks(values_frame(spark, 41, partitions=1), 5, 2).orderBy("block_id").collect()
    assert [b["n_rows"] for b in made] == [5] * 8 + [1]


def test_narrow_blocks_do_not_shuffle(spark):
    plan = B.to_blocks(values_frame(spark, 50), 4, 2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_repeated_positions_fail(spark):
    rows = values_frame(spark, 10).withColumn("id", F.lit(0).cast("long"))
    with pytest.raises(Exception, match="more than 4 rows"):
        B.to_blocks(rows, 4, 2, pos="id").collect()


def test_oversized_blocks_are_refused(spark):
    with pytest.raises(ValueError, match="lower height"):
        B.to_blocks(values_frame(spark, 1), 1 << 20, 1000)


def test_counts_of_nothing(spark):
    made = B.to_blocks(values_frame(spark, 0), 4, 2)
    assert B.n_rows(made).first()[0] == 0 and B.n_blocks(made).first()[0] == 0
    assert B.n_cols(made).first()[0] is None
    with pytest.raises(ValueError, match="no blocks"):
        B.block_totals(made)


def test_blocks_of_different_width_fail(spark):
    made = B.to_blocks(values_frame(spark, 5), 4, 2).unionByName(
        B.to_blocks(values_frame(spark, 5, 3), 4, 3))
    with pytest.raises(Exception, match="differ in column count"):
        B.n_cols(made).collect()


@pytest.mark.parametrize("tile, spread", [(1, 1), (3, 4), (5, 2), (64, 3)])
def test_multiply_by_a_table(spark, tile, spread):
    rng = np.random.default_rng(2)
    a, m = rng.random((23, 7)), rng.random((7, 11))
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(a)],
                                 "pos long, values array<double>")
    made = B.to_blocks(rows, 4, 7, pos="pos")
    table = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(m)],
                                  "row long, values array<double>")
    out = np.full((23, 11), np.nan)
    for r in B.multiply_by_table(made, table, 7, 11, tile, spread).collect():
        at, lo = 4 * r["block_id"], r["first_col"]
        out[at:at + r["n_rows"], lo:lo + r["n_cols"]] = np.reshape(r["values"], (r["n_rows"], -1))
    assert np.allclose(out, a @ m, rtol=1e-13)
    assert B.multiply_by_table(made.limit(0), table, 7, 11, tile, spread).count() == 0
    for wrong in (table.where("row <> 3"), table.where("row < 6"), table.union(table.where("row = 2")),
                  table.selectExpr("row", "slice(values, 1, 10) AS values"),
                  table.selectExpr("nullif(row, 4) AS row", "values"),
                  table.selectExpr("row", "transform(values, v -> nullif(v, values[2])) AS values")):
        with pytest.raises(Exception, match="matrix"):
            B.multiply_by_table(made, wrong, 7, 11, tile, spread).collect()


def test_multiply_and_grams(spark):
    made = B.to_blocks(values_frame(spark, 11, 3), 4, 3, pos="id")
    x = np.array([[i, i + 1, i + 2] for i in range(11)], dtype=float)
    m = RNG.normal(size=(3, 2))
    rows = B.unblock(B.multiply(made, m)).orderBy("block_id", "row").collect()
    assert np.allclose([r["values"] for r in rows], x @ m)
    total = total_gram(block_gram(made), 2).first()
    a, b = x[:, :2], x[:, 2]
    assert np.allclose(np.reshape(total["ata"], (2, 2)), a.T @ a)
    assert np.allclose(total["atb"], a.T @ b) and np.isclose(total["btb"], b @ b)
    assert total["n_rows"] == 11


@pytest.mark.parametrize("d", [3, 12])
def test_gram_with_a_hot_group(spark, d):
    x, b = RNG.normal(size=(90, d)), RNG.normal(size=90)
    keys = np.where(np.arange(90) < 70, 7, np.arange(90))
    df = spark.createDataFrame(
        [(int(k), r.tolist(), float(t)) for k, r, t in zip(keys, x, b)],
        "block_id long, features array<double>, target double").repartition(4)
    found = {r["block_id"]: r for r in gram(df, d, by="block_id").collect()}
    assert len(found) == len(set(keys))
    for k in set(keys):
        mine = keys == k
        assert np.allclose(np.reshape(found[k]["ata"], (d, d)), x[mine].T @ x[mine])
        assert np.allclose(found[k]["atb"], x[mine].T @ b[mine])
        assert found[k]["n_rows"] == mine.sum()


@pytest.mark.parametrize("d", [2, 10])
def test_inverse_hessian_diag(spark, d):
    x, y = RNG.normal(size=(60, d)), np.zeros(60)
    w = RNG.normal(size=d)
    s = 1 / (1 + np.exp(-x @ w))
    want = np.diag(np.linalg.inv((x * (s * (1 - s))[:, None]).T @ x + 2.0 * np.eye(d)))
    rows = inverse_hessian_diag(frame(spark, x, y), w, 2.0).orderBy("pos").collect()
    assert np.allclose([r["value"] for r in rows], want)


def test_fold_labeled_blocks(spark):
    rows = spark.createDataFrame(
        [(0, [2.0, 3.0, 1.0]), (1, [4.0, 5.0, -1.0])], "id long, values array<double>")
    folded = B.fold_labeled_blocks(B.to_blocks(rows, 5, 3, pos="id")).first()
    assert folded["values"] == [-2.0, -3.0, -1.0, 4.0, 5.0, 1.0]


@pytest.mark.parametrize("n", [1, 2, 7, 10])
def test_mirror_noise_against_a_loop(spark, n):
    x = np.column_stack([RNG.normal(size=(n, 3)), np.ones(n)])
    model = np.array([0.5, -0.3, 0.2, 0.1])
    want, labels = x.copy(), np.where(x @ model < 0, -1.0, 1.0)
    for i in range(n - 1):
        for j in range(2):
            want[i, j] += 0.2 * want[n - 1 - i, j]
    df = spark.createDataFrame(
        [(0, i, row.tolist()) for i, row in enumerate(x)],
        "block_id long, pos long, features array<double>")
    found = B.mirror_noise(df, model, n).orderBy("pos").collect()
    got = np.array([r["features"] for r in found])
    assert np.allclose(got[:, :3], want[:, :3], atol=1e-12)
    assert np.array_equal(got[:, 3], labels) and [r["label"] for r in found] == list(labels)


def test_mirror_noise_refuses_positions_beyond_the_block(spark):
    df = spark.createDataFrame([(0, 9, [1.0, 1.0, 1.0])], "block_id long, pos long, features array<double>")
    with pytest.raises(Exception, match="block height"):
        B.mirror_noise(df, [1.0, 1.0, 1.0], 5).collect()


def test_block_quality(spark):
    rows = [(0, 1.0)] * 12 + [(1, -1.0)] * 12 + [(2, 1.0), (2, -1.0)] + [(3, 1.0), (3, -1.0)] * 6
    df = spark.createDataFrame(rows, "block_id long, label double")
    found = {r["block_id"]: r["status"] for r in B.block_quality(df).collect()}
    assert found == {0: 20, 1: 40, 2: 62, 3: 0}


@pytest.mark.parametrize("bucket_rows", [1, 3, 1000])
def test_iteration_times_do_not_depend_on_buckets(spark, bucket_rows):
    rows = [("a", i, i * i * 0.5) for i in range(1, 12)] + [("b", 5, 7.0), ("b", 90, 9.5)]
    df = spark.createDataFrame(rows, "run_id string, iteration int, elapsed_seconds double")
    found = iteration_times(df, bucket_rows=bucket_rows).orderBy("run_id", "iteration").collect()
    want = [0.5] + [(i * i - (i - 1) ** 2) * 0.5 for i in range(2, 12)] + [7.0, 2.5]
    assert [r["iter_seconds"] for r in found] == want
