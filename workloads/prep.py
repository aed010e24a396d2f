"""Row preparation, scores and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from optabula.functions.prep import (
    add_intercept,
    features_only,
    label01,
    label_by_model,
    label_slot,
    row_defects,
    sign_fold,
    target_by_model,
    training_rows,
    with_intercept,
)
from optabula.functions.vectors import at
from optabula.operators.blocks import block_quality, mirror_noise
from optabula.operators.report import accuracy, score
from optabula.sources.tables import reference_models

from .fixtures import (
    EMB_SQL,
    EVENTS_SQL,
    KEYS,
    P1_SQL,
    embeddings,
    event_rows,
    p1,
    p1_training,
    table,
)
from .registry import query, rounded

K = ", ".join(KEYS)
MODEL = [0.5, -0.3, 0.2, 0.1]
MARGIN = "(x1 * CAST(0.5 AS DOUBLE) + x2 * CAST(-0.3 AS DOUBLE) + x3 * CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE))"


def coordinates(vector, n, prefix="f"):
    return [at(vector, i).alias(f"{prefix}{i}") for i in range(n)]


@query("label_recode", f"WITH {P1_SQL} SELECT {K}, y, t AS label FROM p1")
def label_recode(spark, sf_dir):
    return p1(spark, sf_dir).select(*KEYS, "y", label01(F.col("y")).alias("label"))


@query("with_intercept", f"""
    WITH {P1_SQL} SELECT {K}, x1 AS f0, x2 AS f1, x3 AS f2, x4 AS f3, 4 AS n FROM p1""")
def intercept_slot(spark, sf_dir):
    rows = p1(spark, sf_dir).withColumn("f", with_intercept(F.col("values")))
    return rows.select(*KEYS, *coordinates(F.col("f"), 4), F.size("f").alias("n"))


@query("features_only", f"""
    WITH {P1_SQL} SELECT {K}, x1 AS f0, x2 AS f1, x3 AS f2, 3 AS n FROM p1""")
def drop_label_slot(spark, sf_dir):
    rows = p1(spark, sf_dir).withColumn("f", features_only(F.col("values")))
    return rows.select(*KEYS, *coordinates(F.col("f"), 3), F.size("f").alias("n"))


@query("training_rows", f"""
    WITH {P1_SQL} SELECT t AS label, count(*) AS n, {rounded('sum(x1)', 4)} AS s0,
      {rounded('sum(x2)', 4)} AS s1, {rounded('sum(x3)', 4)} AS s2, sum(x4) AS s3
    FROM p1 GROUP BY t""")
def training(spark, sf_dir):
    rows = training_rows(p1(spark, sf_dir))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(at(F.col("features"), i)), 4).alias(f"s{i}") for i in range(4)])


@query("sign_fold", f"""
    WITH {P1_SQL} SELECT {K}, -y * x1 AS d0, -y * x2 AS d1, -y * x3 AS d2, -y AS d3 FROM p1""")
def fold(spark, sf_dir):
    rows = p1(spark, sf_dir)
    features = add_intercept(features_only(F.col("values")))
    folded = rows.withColumn("d", sign_fold(features, label_slot(F.col("values"))))
    return folded.select(*KEYS, *coordinates(F.col("d"), 4, "d"))


@query("label_by_model", f"""
    WITH {P1_SQL} SELECT {K}, CASE WHEN {MARGIN} < 0 THEN CAST(0 AS DOUBLE)
      ELSE CAST(1 AS DOUBLE) END AS label FROM p1""")
def true_labels(spark, sf_dir):
    rows = p1_training(spark, sf_dir)
    return rows.select(*KEYS, label_by_model(F.col("features"), MODEL).alias("label"))


@query("target_by_model", f"WITH {P1_SQL} SELECT {K}, {rounded(MARGIN, 9)} AS target FROM p1")
def targets(spark, sf_dir):
    rows = p1_training(spark, sf_dir)
    return rows.select(
        *KEYS, F.round(target_by_model(F.col("features"), MODEL), 9).alias("target"))


@query("row_defects", """
    SELECT count(*) AS n_rows, count(*) FILTER (l_tax = 0.08) AS wrong_width,
      count(*) FILTER (l_discount = 0 OR l_discount = 0.01) AS not_finite,
      count(*) FILTER (l_linenumber = 7) AS bad_label FROM lineitem""")
def defects(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_discount = 0 THEN CAST(NULL AS DOUBLE) WHEN l_discount = 0.01D "
        "THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS x", "l_tax", "l_linenumber")
    rows = rows.selectExpr(
        "CASE WHEN l_tax = 0.08D THEN array(x) ELSE array(x, 1D) END AS features",
        "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE) ELSE 1D END AS label")
    return row_defects(rows, 2)


@query("score_model", f"""
    WITH {P1_SQL} SELECT {K}, round(1 / (1 + exp(-{MARGIN})), 9) AS probability,
      CASE WHEN {MARGIN} < 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS prediction
    FROM p1""")
def scores(spark, sf_dir):
    scored = score(p1_training(spark, sf_dir), MODEL)
    return scored.select(
        *KEYS, F.round("probability", 9).alias("probability"), "prediction")


@query("score_defects", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02e0 OR l_tax = 0.08e0 THEN NULL
        ELSE round(1 / (1 + exp(-(0.5e0 * l_discount - 0.2e0))), 9) END AS probability,
      CASE WHEN l_discount < 0.02e0 OR l_tax = 0.08e0 THEN NULL
        ELSE CAST(0.5e0 * l_discount - 0.2e0 >= 0 AS DOUBLE) END AS prediction FROM lineitem""")
def score_defects(spark, sf_dir):
    """Rows with a NULL, a NaN or a missing feature have no score."""
    scored = score(defective_rows(spark, sf_dir), [0.5, -0.2])
    return scored.select("l_orderkey", "l_linenumber", F.round("probability", 9).alias("probability"),
                         "prediction")


@query("label_defects", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 OR l_discount < 0.02e0 THEN NULL
        WHEN l_linenumber < 3 THEN 0e0 ELSE 1e0 END AS label,
      CASE WHEN l_discount < 0.02e0 OR l_tax = 0.08e0 THEN NULL
        ELSE CAST(0.5e0 * l_discount - 0.02e0 >= 0 AS DOUBLE) END AS by_model,
      CASE WHEN l_discount < 0.02e0 OR l_tax = 0.08e0 THEN NULL
        ELSE round(0.5e0 * l_discount - 0.02e0, 9) END AS target FROM lineitem""")
def label_defects(spark, sf_dir):
    """NULL and NaN labels stay unknown, and so do labels and targets of defective rows."""
    raw = F.expr("CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE) WHEN l_discount < 0.02D "
                 "THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber < 3 THEN -1D ELSE 1D END")
    rows, model = defective_rows(spark, sf_dir), [0.5, -0.02]
    target = target_by_model(F.col("features"), model)
    return rows.select(
        "l_orderkey", "l_linenumber", label01(raw).alias("label"),
        label_by_model(F.col("features"), model).alias("by_model"),
        F.round(F.when(~F.isnan(target), target), 9).alias("target"))


def defective_rows(spark, sf_dir):
    """features = [l_discount, 1], with NULLs, NaNs and missing values in some rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_discount",
        "CASE WHEN l_discount = 0 THEN CAST(NULL AS DOUBLE) WHEN l_discount < 0.02D "
        "THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS x", "l_tax").selectExpr(
        "l_orderkey", "l_linenumber", "l_discount",
        "CASE WHEN l_tax = 0.08D THEN array(x) ELSE array(x, 1D) END AS features")


@query("score_accuracy", f"""
    WITH {P1_SQL} SELECT count(*) AS n_rows,
      round(avg(CASE WHEN ({MARGIN} < 0) = (t = 0) THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM p1""")
def score_accuracy(spark, sf_dir):
    found = accuracy(score(p1_training(spark, sf_dir), MODEL))
    return found.select("n_rows", F.round("accuracy", 9).alias("accuracy"))


def mirror_sql(height, model=(0.5, -0.3, 0.2, -0.1), rows=EVENTS_SQL):
    a, b, c, d = (f"CAST({m} AS DOUBLE)" for m in model)
    score_sql = f"(v1 * {a} + v2 * {b} + v3 * {c} + {d})"

    def noised(v):
        return f"""CASE WHEN a.pos = n - 1 THEN a.{v} WHEN a.pos < n - 1 - a.pos
            THEN a.{v} + 0.2 * b.{v} WHEN a.pos = n - 1 - a.pos THEN 1.2 * a.{v}
            ELSE a.{v} + 0.2 * (b.{v} + 0.2 * a.{v}) END"""

    return f"""
    WITH {rows},
    a AS (SELECT event_id // {height} AS block_id, event_id % {height} AS pos, v1, v2, v3 FROM r),
    s AS (SELECT block_id, count(*) AS n FROM a GROUP BY block_id)
    SELECT a.block_id, a.pos, {rounded(noised('v1'), 9)} AS f0, {rounded(noised('v2'), 9)} AS f1,
      a.v3 AS f2, CASE WHEN {score_sql.replace('v', 'a.v')} < 0 THEN CAST(-1 AS DOUBLE)
      ELSE CAST(1 AS DOUBLE) END AS label
    FROM a JOIN s USING (block_id) JOIN a b ON a.block_id = b.block_id AND b.pos = n - 1 - a.pos
    """


def mirror_query(height):
    def run(spark, sf_dir):
        rows = event_rows(spark, sf_dir).selectExpr(
            f"event_id DIV {height} AS block_id", f"event_id % {height} AS pos",
            "concat(values, array(1D)) AS features")
        noised = mirror_noise(rows, [0.5, -0.3, 0.2, -0.1], height)
        f = F.col("features")
        return noised.select(
            "block_id", "pos", F.round(at(f, 0), 9).alias("f0"), F.round(at(f, 1), 9).alias("f1"),
            at(f, 2).alias("f2"), "label")

    return run


query("mirror_noise", mirror_sql(500))(mirror_query(500))
query("mirror_noise_odd", mirror_sql(77))(mirror_query(77))


@query("block_quality", """
    WITH b AS (SELECT (event_id + user_id) // 9 AS block_id,
      CASE WHEN value > 40 THEN 1 ELSE -1 END AS label FROM events)
    SELECT block_id, count(*) AS n, count(*) FILTER (label > 0) AS n_pos,
      CAST(CASE WHEN count(*) FILTER (label > 0) = count(*) THEN 20
        WHEN count(*) FILTER (label > 0) = 0 THEN 40
        WHEN count(*) < 10 THEN 60 + count(*) ELSE 0 END AS INTEGER) AS status
    FROM b GROUP BY block_id""")
def quality(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "(event_id + user_id) DIV 9 AS block_id",
        "CASE WHEN value > 40 THEN 1D ELSE -1D END AS label")
    return block_quality(rows)


@query("reference_models", f"""
    WITH {EMB_SQL}
    SELECT 'label-' || label AS problem, CAST(vec_id AS INTEGER) AS rep, kind, pos,
      CASE WHEN kind = 'optimal' THEN v WHEN pos % 2 = 1 THEN CAST(0 AS DOUBLE) ELSE v END AS value
    FROM e, (VALUES ('true'), ('optimal')) AS kinds(kind)""")
def models(spark, sf_dir):
    emb = embeddings(spark, sf_dir).selectExpr(
        "concat('label-', label) AS problem", "CAST(vec_id AS INT) AS rep", "v")
    sparse = "transform(v, (x, i) -> CASE WHEN i % 2 = 1 THEN 0D ELSE x END)"
    kinds = emb.selectExpr(
        "problem", "rep",
        f"stack(2, 'true', {sparse}, 'optimal', v) AS (kind, model)")
    return reference_models(kinds)
