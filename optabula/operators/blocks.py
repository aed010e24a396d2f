"""Row blocks: (block_id, n_rows, n_cols, values) with values row-major."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .. import kernels
from ..cluster import check_shipped
from .sums import added

BLOCK_SCHEMA = "block_id long, n_rows int, n_cols int, values array<double>"

# Status codes of degenerate blocks and the weight of the mirror row.
ALL_POSITIVE, ALL_NEGATIVE, TOO_FEW, MIN_ROWS = 20, 40, 60, 10
MIRROR_WEIGHT = 0.2

# Largest block a task has to hold.
MAX_BLOCK_BYTES = 256 << 20

# Full blocks of a partition that share its last rows, as far as MAX_BLOCK_BYTES holds them.
EVEN_BLOCKS = 7

# Block ids of one partition: partition id in the high bits, running number in the low ones.
IDS_PER_PARTITION = 1 << 33


def to_blocks(df: DataFrame, height: int, width: int, values: str = "values",
              pos: str | None = None) -> DataFrame:
    """Groups rows into blocks of at most ``height`` rows.

    Without ``pos``: consecutive rows of each partition, its last blocks (``EVEN_BLOCKS`` and the rest)
    being shorter and of even size: one block far below the others slows every consensus fit down.
    Blocks above half of ``MAX_BLOCK_BYTES`` are not held back, and the last one may be of any size.
    A narrow step: no shuffle, and skewed keys cannot make a big block.
    Row order must be reproducible (a file scan is; after a shuffle, cut lineage first).

    With ``pos`` (unique dense row number): block floor(pos / height), the same on every
    engine. One shuffle; rows are streamed from a sort, so memory holds one block.
    """
    if height < 1:
        raise ValueError("height must be at least 1")
    if 8 * height * width > MAX_BLOCK_BYTES:
        raise ValueError(
            f"blocks of {height} x {width} values are above {MAX_BLOCK_BYTES} bytes; lower height")
    if pos is None:
        tail = min(EVEN_BLOCKS, max(1, MAX_BLOCK_BYTES // (8 * height * width)) - 1)

        def first_id():
            return TaskContext.get().partitionId() * IDS_PER_PARTITION

        return df.select(F.col(values).cast("array<double>")).mapInArrow(
            kernels.rechunk(width, height, first_id, tail), BLOCK_SCHEMA
        )
    ordered = df.select(
        F.floor(F.col(pos) / height).cast("long").alias("block_id"),
        F.col(pos).alias("pos"), F.col(values).cast("array<double>").alias("values"),
    ).repartition("block_id").sortWithinPartitions("block_id", "pos")
    return ordered.select("block_id", "values").mapInArrow(
        kernels.rechunk_sorted(width, height), BLOCK_SCHEMA
    )


def unblock(blocks: DataFrame) -> DataFrame:
    """Blocks -> rows (block_id, row, values)."""
    width = F.col("n_cols")
    rows = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1),
        lambda r: F.slice("values", r * width + 1, width),
    )
    return blocks.where("n_rows > 0").select(
        "block_id", F.posexplode(rows).alias("row", "values"))


def n_rows(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"))


def n_cols(blocks: DataFrame) -> DataFrame:
    """Column count; fails if blocks disagree."""
    low, high = F.min("n_cols"), F.max("n_cols")
    checked = F.when(low == high, low).when(
        low.isNotNull(), F.raise_error(F.lit("blocks differ in column count")).cast("int"))
    return blocks.agg(checked.alias("n_cols"))


def n_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"))


def block_totals(blocks: DataFrame) -> tuple[int, int, int]:
    """(blocks, rows, columns) on the driver, from one aggregation."""
    low, high = F.min("n_cols"), F.max("n_cols")
    row = blocks.agg(F.count(F.lit(1)), F.sum("n_rows"), low, high).first()
    if not row[0]:
        raise ValueError("no blocks")
    if row[2] != row[3]:
        raise ValueError(f"blocks of {row[2]} to {row[3]} columns")
    return row[0], row[1], row[2]


def multiply(blocks: DataFrame, matrix) -> DataFrame:
    """Blocks times a local (n_cols, m) matrix; a narrow step."""
    matrix = np.asarray(matrix, dtype=float)
    check_shipped(matrix.size, "the right-hand matrix")
    product = arrow_udf(kernels.multiply_blocks(matrix), "array<double>")
    return blocks.select(
        "block_id", "n_rows", F.lit(matrix.shape[1]).alias("n_cols"),
        product("values", "n_rows", "n_cols").alias("values"),
    )


def matrix_tiles(matrix: DataFrame, n_rows: int, n_cols: int, tile: int) -> DataFrame:
    """(row, values), one per matrix row -> (band, strip, height, tile) of at most tile x tile.

    A repeated row, one outside 0 .. n_rows - 1 or NULL, and one of another length are errors. A group
    holds one tile.
    """
    last = (n_cols - 1) // tile
    refused = F.raise_error(F.lit(f"a row of the matrix is not one of {n_rows} of {n_cols} numbers"))
    usable = F.col("row").between(0, n_rows - 1) & (F.size("values") == n_cols)
    cut = matrix.select(
        F.when(usable, F.col("row")).otherwise(refused.cast("long")).alias("row"),
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(last)),
                                 lambda k: F.slice("values", k * tile + 1, tile)))
        .alias("strip", "part"))
    held = cut.groupBy(F.floor(F.col("row") / tile).cast("int").alias("band"), "strip").agg(
        F.count_distinct("row").cast("int").alias("height"),
        F.sort_array(F.collect_list(F.struct("row", "part"))).alias("rows"))
    complete = (F.size("rows") == F.col("height")) & (
        F.col("height") == F.least(F.lit(tile), n_rows - F.col("band") * tile))
    missing = F.raise_error(F.lit("rows of the matrix are missing or repeated")).cast("array<double>")
    return held.select("band", "strip", "height", F.when(
        complete, F.flatten("rows.part")).otherwise(missing).alias("tile"))


def multiply_by_table(blocks: DataFrame, matrix: DataFrame, n_cols: int, out_cols: int,
                      tile: int = 512, spread: int = 16) -> DataFrame:
    """Blocks times an (n_cols, out_cols) matrix of any size, given as a table (row, values).

    Gives the product in strips of `tile` columns: (block_id, first_col, n_rows, n_cols, values).
    Blocks are cut into bands of `tile` columns and meet the tiles of their band; a band is spread
    over `spread` keys, so that narrow inputs also use many tasks, and tiles are repeated as often.
    Partial products are added per block and strip, one after the other. Block ids are unique;
    blocks without rows give none. Entries are not looked at, so NaN gives NaN; NULL is an error, and
    so is a matrix that lacks a row.
    """
    if min(n_cols, out_cols, tile, spread) < 1:
        raise ValueError("sizes must be at least 1")
    bands = blocks.where("n_rows > 0").select("block_id", "n_rows", "n_cols", "values").mapInArrow(
        kernels.cut_bands(n_cols, tile), "block_id long, n_rows int, band int, values array<double>")
    tiles = matrix_tiles(matrix, n_cols, out_cols, tile).withColumn(
        "key", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    product = arrow_udf(kernels.multiply_tiles, "array<double>")
    keyed = bands.withColumn("key", F.pmod("block_id", F.lit(spread)).cast("int"))
    # Outer, so that a band that meets no tile is noticed: its product is an error.
    parts = keyed.join(tiles, ["band", "key"], "left").select(
        "block_id", F.col("strip").alias("piece"),
        product("values", "n_rows", "height", "tile").alias("values"))
    width = F.least(F.lit(tile), out_cols - F.col("piece") * tile)
    return added(parts, keyed=True).select(
        "block_id", (F.col("piece") * tile).alias("first_col"),
        (F.size("values") / width).cast("int").alias("n_rows"), width.alias("n_cols"), "values")


def fold_blocks(rows: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """Training rows (label 0/1) -> a ``values`` column of sign-folded rows, ready to block.

    Any other label, NULL included, is an error.
    """
    return rows.selectExpr(
        f"CASE WHEN {label} = 1 THEN transform({features}, v -> -v) WHEN {label} = 0 THEN {features} "
        "ELSE raise_error('a label is not 0 or 1') END AS values")


def fold_labeled_blocks(blocks: DataFrame) -> DataFrame:
    """Raw blocks whose last column is a -1/1 label -> sign-folded blocks with intercept.

    One multiplication per block; any other label is an error.
    """
    folded = arrow_udf(kernels.fold_blocks(), "array<double>")
    return blocks.select(
        "block_id", "n_rows", "n_cols", folded("values", "n_rows", "n_cols").alias("values"))


def block_quality(df: DataFrame, by: str = "block_id", label: str = "label",
                  min_rows: int = MIN_ROWS) -> DataFrame:
    """(block_id, n, n_pos, status): 0 usable, 20 all positive, 40 all negative, 60+n too few."""
    n, n_pos = F.count(F.lit(1)), F.count(F.when(F.col(label) > 0, 1))
    status = (
        F.when(n_pos == n, F.lit(ALL_POSITIVE)).when(n_pos == 0, F.lit(ALL_NEGATIVE))
        .when(n < min_rows, (n + TOO_FEW).cast("int")).otherwise(F.lit(0))
    )
    return df.groupBy(by).agg(n.alias("n"), n_pos.alias("n_pos"), status.alias("status"))


def mirror_noise(df: DataFrame, model, height: int, block: str = "block_id", pos: str = "pos",
                 features: str = "features", c: float = MIRROR_WEIGHT) -> DataFrame:
    """Deterministic label noise inside a block: (block_id, pos, features, label).

    The label is the sign of the raw row under ``model`` (0 counts as 1). Features then get c
    times the mirror row n-1-pos, rows behind the middle seeing an already noised mirror;
    the last feature stays raw, and so does row n-1. The label also takes the last slot.
    One shuffle by block. Positions of a block are 0 .. n-1 and below ``height``, so that a block
    fits a task; missing or repeated positions are an error.
    """
    position = F.when(F.col(pos) < height, F.col(pos)).otherwise(
        F.raise_error(F.lit(f"position not below the block height {height}")).cast("long"))
    placed = df.select(block, position.cast("long").alias(pos),
                       F.col(features).cast("array<double>").alias("features"))
    kind = placed.schema[block].dataType.simpleString()
    return placed.groupBy(block).applyInArrow(
        kernels.mirror_rows(np.asarray(model, dtype=float), c, block, pos),
        f"{block} {kind}, {pos} long, features array<double>, label double")
