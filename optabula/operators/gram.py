"""Normal equations: A'A, A'b and b'b, per block or in total."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import kernels
from ..functions.prox import sigmoid
from ..functions.vectors import at, checked, dot, finite, rows_counted
from .sums import grouped_sums

FACTOR_SCHEMA = "struct<vectors:array<double>,values:array<double>>"
# Widths up to this one sum the upper triangle with generated columns.
NARROW_GRAM = 8

GRAM_COLUMNS = ("n_rows", "n_cols", "ata", "atb", "btb")
GRAM_SCHEMA = "n_rows long, n_cols int, ata array<double>, atb array<double>, btb double"


def gram(df: DataFrame, width: int, by: str | None = None, features: str = "features",
         target: str | None = "target", weights_at=None) -> DataFrame:
    """([by], n_rows, n_cols, ata, atb, btb), ata row-major of width * width values.

    Both plans pre-aggregate per partition, so the shuffle carries one d x d sum per
    partition and group, whatever the group size. Wide sums travel as tiles of the upper
    triangle, and tasks add tile by tile. ``weights_at`` (a model) weights every
    row by its logistic curvature s(1-s).
    """
    x = F.col(features)
    b = F.col(target).cast("double") if target else F.lit(0.0)
    keys = (by,) if by else ()
    if width > NARROW_GRAM:
        model = None if weights_at is None else np.asarray(weights_at, dtype=float)
        size = kernels.packed_size(width) + width + 2
        return grouped_sums(df, kernels.gram_sums(model), width, size, x, b, by,
                            kernels.finish_grams(width), GRAM_SCHEMA)
    weight = F.lit(1.0)
    if weights_at is not None:
        s = sigmoid(dot(x, list(weights_at)))
        weight = s * (F.lit(1.0) - s)
    all_of = b + F.when(F.size(x) == width, sum((at(x, i) for i in range(width)), F.lit(0.0)))
    rows = df.select(
        *keys, *[at(x, i).alias(f"x{i}") for i in range(width)],
        b.alias("b"), weight.alias("weight"), finite(all_of).alias("usable"),
    )
    product = {
        (i, j): F.sum(F.col("weight") * F.col(f"x{i}") * F.col(f"x{j}"))
        for i in range(width) for j in range(i, width)
    }
    sums = rows.groupBy(*keys).agg(
        rows_counted(F.col("usable"), f"a complete vector of {width} features with a target")
        .alias("n_rows"),
        *[v.alias(f"s{i}_{j}") for (i, j), v in product.items()],
        *[F.sum(F.col("weight") * F.col(f"x{i}") * F.col("b")).alias(f"t{i}")
          for i in range(width)],
        F.sum(F.col("b") * F.col("b")).alias("btb"),
    )
    ata = [f"s{min(i, j)}_{max(i, j)}" for i in range(width) for j in range(width)]
    return sums.select(
        *keys, "n_rows", F.lit(width).alias("n_cols"), checked(F.array(*ata)).alias("ata"),
        checked(F.array(*[f"t{i}" for i in range(width)])).alias("atb"), checked("btb").alias("btb"),
    )


def block_gram(blocks: DataFrame, target_last: bool = True) -> DataFrame:
    """Grams of block rows, one per block and without a shuffle."""
    sums = arrow_udf(
        kernels.gram_blocks(target_last), "struct<ata:array<double>,atb:array<double>,btb:double>")
    width = F.col("n_cols") - (1 if target_last else 0)
    return blocks.select(
        "block_id", F.col("n_rows").cast("long").alias("n_rows"), width.alias("n_cols"),
        sums("values", "n_rows", "n_cols").alias("s"),
    ).select("block_id", "n_rows", "n_cols", "s.ata", "s.atb", "s.btb")


def total_gram(grams: DataFrame, width: int) -> DataFrame:
    """Sum of per-block grams: (n_rows, n_cols, ata, atb, btb)."""
    from .sums import sum_vectors

    packed = F.concat(
        "ata", "atb", F.array(F.col("btb"), F.col("n_rows").cast("double"))).alias("packed")
    total = sum_vectors(grams.select(packed), "packed", width * width + width + 2)
    s = F.col("packed")
    return total.select(
        F.element_at(s, -1).cast("long").alias("n_rows"), F.lit(width).alias("n_cols"),
        F.slice(s, 1, width * width).alias("ata"), F.slice(s, width * width + 1, width).alias("atb"),
        F.element_at(s, -2).alias("btb"),
    )


def factored(grams: DataFrame, width: int) -> DataFrame:
    """Adds ``factor``, the eigenvectors and eigenvalues of A'A: solves for any rho are products."""
    body = arrow_udf(kernels.eigen_grams(width), FACTOR_SCHEMA)
    return grams.withColumn("factor", body("ata"))


def gram_entries(grams: DataFrame, *keys: str) -> DataFrame:
    """Vectors of a gram table -> (keys, i, j, value); j = n_cols stands for A'b."""
    d = F.col("n_cols")
    p = F.col("p")
    entries = grams.select(*keys, d, F.posexplode(F.concat("ata", "atb")).alias("p", "value"))
    square = p < d * d
    return entries.select(
        *keys, F.when(square, F.floor(p / d)).otherwise(p - d * d).cast("int").alias("i"),
        F.when(square, p % d).otherwise(d).alias("j"), "value")


def inverse_hessian_diag(df: DataFrame, w, rho: float, features: str = "features") -> DataFrame:
    """(pos, value): diagonal of (D' diag(s(1-s)) D + rho I)^-1 at ``w``.

    The weighted Gram is summed by Spark; only the d x d inverse is taken on one row.
    """
    d = len(w)

    def body(ata):
        import pyarrow as pa

        left = kernels.as_matrix(ata, d * d).reshape(-1, d, d) + rho * np.eye(d)
        if not len(left):
            return pa.array([], kernels.DOUBLES)
        return kernels.as_lists(np.diagonal(np.linalg.inv(left), axis1=1, axis2=2))

    diagonal = arrow_udf(body, "array<double>")
    hessian = gram(df, d, features=features, target=None, weights_at=w)
    return hessian.select(F.posexplode(diagonal("ata")).alias("pos", "value"))
